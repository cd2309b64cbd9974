"""How dirty identifying fields are read: hook kinds, instants, blank ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the four hook kinds of a trace, in their order within a step
HOOKS = ("pre_step", "post_step", "checkpoint", "final")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(r"[^\s\u00a0]")


def read_hook(c: Column) -> Column:
    """Hook kind without regard to case, spaces, hyphens and underscores; null if it is none of the four."""
    bare = F.lower(F.regexp_replace(c, r"[\s_\-\u00a0]+", ""))
    out = F.lit(None).cast("string")
    for h in HOOKS:
        out = F.when(bare == h.replace("_", ""), F.lit(h)).otherwise(out)
    return F.when(c.isin(*HOOKS), c).otherwise(out)


def hook_ord(hook: Column) -> Column:
    """Position of a read hook kind within its step, unknown kinds last."""
    out = F.lit(len(HOOKS))
    for i, h in enumerate(HOOKS):
        out = F.when(hook == h, F.lit(i)).otherwise(out)
    return out


def read_instant(c: Column) -> Column:
    """Microseconds since the epoch that a timestamp text denotes, null if unreadable.

    Digits alone are epoch milliseconds; a text without zone means UTC, whatever the
    session's zone is; offsets may lack their colon.
    """
    s = F.upper(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    zone = r":[0-9]{2}([.,][0-9]+)? ?(Z|UTC|GMT|[+-][0-9]{2}(:?[0-9]{2})?)$"
    s2 = F.regexp_replace(s, r"(:[0-9]{2}(?:[.,][0-9]+)?) ?([+-][0-9]{2})([0-9]{2})$", "$1$2:$3")
    s2 = F.regexp_replace(s2, r"(:[0-9]{2}(?:[.,][0-9]+)?) ?([+-][0-9]{2})$", "$1$2:00")
    zoned = F.when(s.rlike(zone), s2).when(s.rlike(r"[0-9]:[0-9]{2}"), F.concat(s2, F.lit("Z"))).otherwise(
        F.concat(s2, F.lit("T00:00:00Z"))
    )
    iso = F.when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.unix_micros(zoned.try_cast("timestamp")))
    # the usual notation needs no rewriting; at most 15 digits, so that the product stays a long
    usual = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(usual, F.unix_micros(c.try_cast("timestamp"))).when(s.rlike(r"^[0-9]{1,15}$"), s.try_cast("long") * 1000).otherwise(iso)


def has_words(c: Column) -> Column:
    """True if the text has a letter or a digit; null counts as none."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column; one without zone means UTC, whatever the session's zone is."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
