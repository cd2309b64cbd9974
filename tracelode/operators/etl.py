"""Merging, deduplication, splitting, metadata and coverage of batches of prefix rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("episode_id", "step_id", "hook_type")


def is_recovery(batch: Column) -> Column:
    """Whether a batch's name says recovery, in any case; null does not."""
    return F.coalesce(F.lower(batch).contains("recovery"), F.lit(False))


def stamped(df: DataFrame) -> DataFrame:
    """Adds suite (``slack`` before ``workspace`` in the batch's name, else unknown) and the suite prefix of the id."""
    b = F.lower(F.coalesce("source_batch", F.lit("")))
    suite = F.when(b.contains("slack"), "slack").when(b.contains("workspace"), "workspace").otherwise("unknown")
    return df.withColumns({"source_suite": suite, "id_suite": F.split_part("episode_id", F.lit(":"), F.lit(1))})


def union_batches(*batches: DataFrame) -> DataFrame:
    """Union by name; columns that a batch lacks are null."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def exact_duplicates_dropped(df: DataFrame, keep: Sequence[str], ignored: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """``keep`` and ``seq`` of the first row of every set of rows that agree in all columns but ``seq`` and ``ignored``.

    A partial minimum, no window; the columns beyond ``keep`` go through the shuffle as 128 bits of hash, so
    that texts are never keys.
    """
    rest = [c for c in df.columns if c not in (*keep, *ignored, seq)]
    return df.groupBy(*keep, F.xxhash64(*rest).alias("_h"), F.xxhash64(F.lit("second"), *rest).alias("_i")).agg(F.min(seq).alias(seq)).drop("_h", "_i")


def recovery_override(primary: DataFrame, recovery: DataFrame, key: Sequence[str], order: str, status: str = "status") -> DataFrame:
    """Results of ``primary``, the stopped ones replaced where ``recovery`` has their key; adds ``overridden``.

    Of several rows with one key the last by ``order`` counts on both sides; keys that only ``recovery`` has are dropped.
    """
    body = [c for c in primary.columns if c not in key]
    last = lambda d: d.groupBy(*key).agg(F.max(F.struct(order, *[c for c in body if c != order])).alias("x"))
    both = last(primary).join(last(recovery).withColumnRenamed("x", "y"), list(key), "left")
    swap = F.coalesce(F.col("x")[status] == "stopped", F.lit(False)) & F.col("y").isNotNull()
    chosen = F.when(swap, F.col("y")).otherwise(F.col("x"))
    return both.select(*key, *[chosen[c].alias(c) for c in body], swap.alias("overridden"))


def recovery_preferred(df: DataFrame, key: Sequence[str] = KEY, seq: str = "seq", always: bool = False) -> DataFrame:
    """Where a key has a recovery row, only its first one stays; other duplicate keys stay, or with ``always`` the first row of each key.

    The winner of a key is a minimum combined before the shuffle, so a key may hold any share of the rows.
    """
    rec = is_recovery(F.col("source_batch"))
    best = df.groupBy(*key).agg(F.min(F.struct((~rec).alias("other"), F.col(seq).alias("s"))).alias("b"))
    win = best.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("b.other").alias("_other"), F.col("b.s").alias("_s"))
    cond = F.lit(True)
    for k in key:
        cond = cond & (df[k].eqNullSafe(win[f"_{k}"]))
    joined = df.join(win, cond)
    stays = F.col(seq) == F.col("_s")
    return joined.where(stays if always else stays | F.col("_other")).select(*df.columns)


def keep_last(df: DataFrame, key: Sequence[str], value: Sequence[str], seq: str = "seq") -> DataFrame:
    """Last row of each key by ``seq`` (a lookup table)."""
    return df.groupBy(*key).agg(F.max(F.struct(seq, *[v for v in value if v != seq])).alias("x")).select(*key, *[F.col("x")[v].alias(v) for v in value])


def attach(base: DataFrame, lookup: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join on a key that must be unique in the lookup; raises if it isn't."""
    if lookup.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError("the lookup's key is not unique")
    return base.join(lookup, list(key), "left")


def allocation(n: int, shares: Sequence[float] = (0.6, 0.2, 0.2)) -> list[int]:
    """Largest-remainder counts of ``n`` episodes; from three on no split with a positive share stays empty while another has more than one."""
    total = sum(shares)
    share = [s / total for s in shares]
    counts = [int(n * s) for s in share]
    rest = n - sum(counts)
    for i in sorted(range(len(share)), key=lambda i: (-(n * share[i] - counts[i]), -share[i], i))[:rest]:
        counts[i] += 1
    for i, s in enumerate(share):
        if n >= 3 and s > 0 and counts[i] == 0:
            big = max(range(len(counts)), key=lambda j: counts[j])
            if counts[big] > 1:
                counts[big] -= 1
                counts[i] += 1
    return counts


def episode_split(df: DataFrame, seed: str = "20260601", shares: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """``episode_id, split``: episodes in order of a seeded hash, cut at exact counts.

    The rank is counted in 256 ranges of the hash and carried over them, so no task orders all episodes.
    """
    eps = df.select("episode_id").distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col("episode_id"))))
    eps = eps.withColumn("r", F.substring("h", 1, 2))
    sizes = eps.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    carry = sizes.select("r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("r").orderBy("h", "episode_id")) + F.col("c")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    a, b, _ = allocation(n, shares)
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test")
    return eps.join(carry, "r").withColumn("rank", rank).select("episode_id", split.alias("split"))


def reuse_split(prior: dict[str, list[str]], episodes: Sequence[str], shares: dict[str, float]) -> dict[str, list[str]]:
    """Keep earlier assignments, the first one of an episode that has several; give each new episode to the split most short of its share. Sequential by nature: new ids only, on the driver."""
    present, known = set(episodes), set()
    out: dict[str, list[str]] = {}
    for s, es in prior.items():
        out[s] = [e for e in dict.fromkeys(es) if e in present and e not in known]
        known.update(out[s])
    total = len(present)
    for e in (x for x in episodes if x not in known):
        s = min(out, key=lambda s: (len(out[s]) / total - shares[s], len(out[s])))
        out[s].append(e)
    return out


def aligned(df: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of assigned episodes with their split; episodes without assignment; assignments without rows."""
    eps = df.select("episode_id").distinct()
    return df.join(manifest, "episode_id"), eps.join(manifest, "episode_id", "left_anti"), manifest.join(eps, "episode_id", "left_anti")


def episode_metadata(df: DataFrame, known: Column, value: Column) -> DataFrame:
    """``episode_id, value, status, batches``: the one known value of an episode, or conflict, or unknown."""
    agg = df.groupBy("episode_id").agg(
        F.max(F.when(known, value)).alias("hi"), F.min(F.when(known, value)).alias("lo"), F.max(known).alias("any"), F.array_join(F.array_sort(F.collect_set("source_batch")), ";").alias("batches")
    )
    status = F.when(~F.coalesce("any", F.lit(False)), "unknown_not_evaluated").when(F.col("hi") != F.col("lo"), "conflict").when(F.col("hi"), "known_true").otherwise("known_false")
    return agg.select("episode_id", F.when(F.col("hi") == F.col("lo"), F.col("hi")).alias("value"), status.alias("status"), "batches")


def natural_task(c: Column) -> tuple[Column, Column]:
    """Prefix and number of a task id for natural order; -1 without number."""
    return F.regexp_extract(c, r"^(.*?)([0-9]*)$", 1), F.coalesce(F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("long"), F.lit(-1).cast("long"))


def family_quota(df: DataFrame, family: str, order: str, quota: int) -> DataFrame:
    """First ``quota`` rows of each family in order; Spark prunes the ranks before the shuffle."""
    w = Window.partitionBy(family).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def value_counts(df: DataFrame, columns: Sequence[str], missing: str = "") -> DataFrame:
    """``column_name, value, n`` of several columns in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns])
    return df.select(F.explode(each).alias("x")).groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))
