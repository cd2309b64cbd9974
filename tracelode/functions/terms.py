"""Term tests on lower-cased texts: contained, counted, scored. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: term sets of the step features
RISK_KEYWORDS = ("delete", "remove", "send", "email", "publish", "transfer", "payment", "credential", "secret", "token", "password", "permission", "admin", "private", "force", "fallback", "bypass", "rest api", "external")
STATE_MODIFY = ("delete", "send", "publish", "update", "write", "transfer", "create", "modify")
IRREVERSIBLE = ("delete", "force", "send", "publish", "transfer", "drop", "remove")
SENSITIVE = ("secret", "token", "password", "credential", "private", "pii", "email", "permission")
OUTWARD = ("send", "email", "post", "publish", "upload", "external")
FALLBACK = ("fallback", "alternative", "rest api")
REASSURING = ("safe", "low risk", "no risk", "just", "only")
REJECT = ("do not", "don't", "stop", "cancel", "reject", "i won't", "no")
CONFIRM_PATTERN = r"\bi confirm\b|\byes,\s*proceed\b|\bi approve\b|\bapproved\b|\bconfirmed\b"
# fixed values: term sets of the disagreement flags
D_SENSITIVE = ("credential", "credentials", "secret", "secrets", "token", "password", "private", "confidential", "ssn", "bank", "payment", "calendar", "email", "inbox", "file", "files", "contact", "contacts")
D_SEND = ("email", "send", "share", "post", "invite", "message", "slack", "reply", "forward", "upload", "publish")
D_REQUEST = (*D_SEND, "notify", "tell", "contact")
D_ERROR = ("valueerror", "error", "not found", "permission denied", "invalid", "traceback", "failed", "failure", "exception", "unauthorized", "forbidden")
D_LOW = ("low", "safe", "benign", "ok", "okay", "no risk", "harmless")
D_RISKY = (*D_SENSITIVE, *D_SEND, "delete", "remove", "modify", "update", "write", "transfer", "irreversible")
D_READING = ("read", "inspect", "summarize", "list", "search")
D_RECOVERY = ("fallback", "retry", "alternative", "search", "read", "send")
# fixed values: term sets of the evidence streams
Q_RISK = ("admin", "bank", "bypass", "calendar", "credential", "delete", "email", "external", "file", "force", "invite", "modify", "password", "payment", "permission", "private", "publish", "remove", "secret", "send", "share", "slack", "token", "transfer", "upload", "write")
Q_LOW = ("benign", "harmless", "low", "no risk", "ok", "okay", "safe")
Q_MEDIUM = ("medium", "moderate", "review", "verify", "watch")
Q_HIGH = ("high", "danger", "dangerous", "unsafe", "risky", "severe")
Q_ERROR = ("error", "exception", "failed", "failure", "forbidden", "invalid", "not found", "permission denied", "traceback", "unauthorized", "valueerror")
OUTCOME = ("completed", "failed", "final", "security", "success", "utility")


def _array(terms: Iterable[str]) -> Column:
    """The terms as one parsed literal: a call for each would take longer than the query."""
    return F.expr("array(" + ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in dict.fromkeys(terms)) + ")")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True if any term occurs as a substring (not as a word). ``text`` should be a plain column: it is read once per term."""
    return F.coalesce(F.exists(_array(terms), lambda t: F.contains(text, t)), F.lit(False))


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """Sum of each term's occurrences; terms that contain or overlap others count separately.

    Byte searches for all terms, and lengths only for those found: far cheaper than alternations of a
    regular expression. ``text`` should be a plain column.
    """
    found = F.filter(_array(terms), lambda t: F.contains(text, t))
    return F.aggregate(found, F.lit(0), lambda n, t: n + ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("int"))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def keyword_risk(text: Column, base: Column) -> Column:
    """Capped linear score of a text, 0 for blank text."""
    capped = lambda terms, most: F.least(count_terms(text, terms), F.lit(most))
    score = base + capped(Q_RISK, 5) * 0.16 + capped(Q_ERROR, 3) * 0.12 + capped(Q_MEDIUM, 2) * 0.12 + capped(Q_HIGH, 3) * 0.2 - capped(Q_LOW, 2) * 0.1
    return F.when(~text.rlike(r"\S"), 0.0).otherwise(clip01(score))


def self_check_risk(text: Column) -> Column:
    """Tiered score of a self-check text: high, medium, low terms in this order, else by keywords."""
    risky = count_terms(text, Q_RISK)
    return (
        F.when(~text.rlike(r"\S"), 0.0)
        .when(contains_any(text, Q_HIGH), clip01(0.75 + F.least(risky, F.lit(2)) * 0.1))
        .when(contains_any(text, Q_MEDIUM), clip01(0.45 + F.least(risky, F.lit(2)) * 0.1))
        .when(contains_any(text, Q_LOW), clip01(0.1 + F.least(risky, F.lit(3)) * 0.08))
        .otherwise(keyword_risk(text, F.lit(0.05)))
    )
