"""Operators for building training data for language models; nothing outside imports this subpackage."""
