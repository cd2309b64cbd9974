"""Splits that keep related records together.

``related_groups`` finds connected components with alternating large-star and small-star steps over
distributed edge tables; nothing about single nodes, links or components reaches the driver, only
three numbers per round that tell whether the edges still change. ``grouped_splits`` assigns whole
components by a swap search: a hashed start, then annealing chains that move or exchange components,
run in parallel over shards of components, of which each shard keeps its best. The search goes in rounds:
each deals the components to other shards, tells every shard its part of what the whole assignment is off
by, and so lets shards exchange; the best assignment of all rounds is kept.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.readings import is_blank
from tracelode.session import written

SPLITS = ("train", "validation", "test")


def task_key(episode: Column) -> Column:
    """Suite and user task that an id names; an id of another form stands for itself alone."""
    parts = F.split(episode, ":")
    return F.when(F.size(parts) >= 3, F.concat_ws(":", parts[0], parts[1])).otherwise(F.concat(F.lit("\x00"), episode))


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    r = edges.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(F.shiftright(h, 20) % 1_000_003)).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``edges(a, b)`` the smallest node it is connected with.

    Each round halves the distance to the root, so a chain of n nodes takes about log2(n) rounds. The
    minimum per node is combined before the shuffle; the joins back to the edges are shuffled joins
    whose skewed side, an oversized hub, AQE splits. Rounds are written tables in the shared folder.
    """
    star = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    before = None
    while True:
        now = _signature(star)
        if now == before or now[0] == 0:
            break
        before = now
        # large star: hang each larger neighbour of a node on the least of its neighbourhood
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # small star: hang a node and its smaller neighbours on the least of these (all edges point down)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        star = written(small.where(F.col("a") != F.col("b")).distinct(), "edges")
    roots = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def episode_components(events: DataFrame, links: DataFrame) -> DataFrame:
    """``episode_id, n_rows, n_risky, root`` of each listed episode; the task is contracted before links are followed."""
    listed = (
        events.where(~is_blank(F.col("episode_id")))
        .groupBy("episode_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("risk_event")).alias("n_risky"))
        .withColumn("node", task_key(F.col("episode_id")))
    )
    sound = links.where(~is_blank(F.col("episode_id")) & ~is_blank(F.col("linked_episode_id")))
    edges = sound.select(task_key(F.col("episode_id")).alias("a"), task_key(F.col("linked_episode_id")).alias("b"))
    found = components(edges.where(F.col("a") != F.col("b")).distinct())
    return listed.join(found, "node", "left").select("episode_id", "n_rows", "n_risky", F.coalesce("root", "node").alias("root"))


def related_groups(events: DataFrame, links: DataFrame) -> DataFrame:
    """``episode_id, group_id``: every listed episode that belongs together with another one.

    ``group_id`` is the smallest listed id of the group in byte order. Ids without rows join others but
    are not listed; null and blank ids, links without target and links of an id to itself count for
    nothing; repeated and reversed links change nothing.
    """
    at = written(episode_components(events, links).select("episode_id", "root"), "listed")
    groups = at.groupBy("root").agg(F.min("episode_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return at.join(groups, "root").select("episode_id", "group_id")


# -- assignment -----------------------------------------------------------------------------------


def _cost(sizes: np.ndarray, labels: np.ndarray, want: np.ndarray, want_labels: np.ndarray, over: bool = False) -> float:
    """Deviation of sizes and labels; with ``over`` only what is too much, as the rest can still be filled."""
    a, b = sizes - want, labels - want_labels
    return float(np.maximum(a, 0).sum() + np.maximum(b, 0).sum()) if over else float(np.abs(a).sum() + np.abs(b).sum())


def anneal(size: np.ndarray, label: np.ndarray, start: np.ndarray, want: np.ndarray, want_labels: np.ndarray, seed: int, chains: int, moves: int, over: bool = False) -> np.ndarray:
    """Best assignment of several chains; every chain moves or exchanges whole components."""
    k, n = len(want), len(size)
    best, best_cost = start.copy(), None
    for chain in range(chains):
        rng = np.random.default_rng([seed, chain])
        at = start.copy()
        s = np.bincount(at, weights=size, minlength=k)
        l = np.bincount(at, weights=label, minlength=k)  # noqa: E741
        cost = _cost(s, l, want, want_labels, over)
        if best_cost is None:
            best_cost = cost
        heat, cool = max(cost / 20, 1.0), 0.001 ** (1 / max(moves, 1))
        picks, others = rng.integers(0, n, moves), rng.integers(0, n, moves)
        to, kind, luck = rng.integers(0, k, moves), rng.random(moves), rng.random(moves)
        for m in range(moves):
            i, a = picks[m], at[picks[m]]
            j = others[m] if kind[m] < 0.5 else -1
            b = at[j] if j >= 0 else to[m]
            heat *= cool
            if a == b:
                continue
            ds, dl = size[i] - (size[j] if j >= 0 else 0), label[i] - (label[j] if j >= 0 else 0)
            s[a] -= ds
            s[b] += ds
            l[a] -= dl
            l[b] += dl
            after = _cost(s, l, want, want_labels, over)
            if after <= cost or luck[m] < np.exp((cost - after) / heat):
                at[i], cost = b, after
                if j >= 0:
                    at[j] = a
                if cost < best_cost:
                    best, best_cost = at.copy(), cost
            else:
                s[a] += ds
                s[b] -= ds
                l[a] += dl
                l[b] -= dl
    return best


def grouped_splits(
    events: DataFrame,
    links: DataFrame,
    shares: tuple[float, ...] = (0.8, 0.1, 0.1),
    seed: int = 7,
    shard_components: int = 4000,
    heavy_share: float = 0.002,
    chains: int = 4,
    moves: int = 10,
) -> DataFrame:
    """``episode_id, group_id, split``: every listed episode, whole components in one split.

    Components with at least ``heavy_share`` of all rows (so at most ``1 / heavy_share`` of them) are
    placed first, in one search against the global targets in which rows and labels above a split's share
    count; a component larger than a split's share can only overfill it as little as possible. The others
    are searched in shards of about ``shard_components`` with ``moves`` tries a component and chain, in
    rounds until one improves the whole by less than a tenth. An empty table gives no rows.
    """
    at = written(episode_components(events, links), "listed")
    comps = at.groupBy("root").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_risky").alias("n_risky"), F.min("episode_id").alias("group_id"), F.count(F.lit(1)).alias("n")
    )
    comps = written(comps, "components")
    total = comps.agg(F.sum("n_rows"), F.sum("n_risky"), F.count(F.lit(1))).first()
    if not total[2]:
        return at.select("episode_id", F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("split"))
    share = np.array(shares) / sum(shares)
    k = len(share)
    rows, risky = float(total[0]), float(total[1] or 0)
    weight = rows / risky if risky else 0.0  # a risky row counts so much that rows and labels matter alike
    is_heavy = F.col("n_rows") >= max(heavy_share * rows, 2)
    # at most 1 / heavy_share rows by the definition of heavy
    heavy = comps.where(is_heavy).orderBy(F.desc("n_rows"), "root").toPandas()
    want, want_labels = share * rows, share * risky * weight
    fixed = []
    if len(heavy):
        size, label = heavy.n_rows.to_numpy(float), heavy.n_risky.to_numpy(float) * weight
        start = np.zeros(len(heavy), int)
        room = want.copy()
        for i, x in enumerate(size):  # largest first into the split with most room
            start[i] = int(np.argmax(room))
            room[start[i]] -= x
        chosen = anneal(size, label, start, want, want_labels, seed, chains, 300 * moves, over=True)
        want = want - np.bincount(chosen, weights=size, minlength=k)
        want_labels = want_labels - np.bincount(chosen, weights=label, minlength=k)
        fixed = list(zip(heavy.root, chosen.tolist(), strict=True))
    light = comps.where(~is_heavy).select("root", "n_rows", "n_risky")
    part = np.maximum(want, 0) / max(np.maximum(want, 0).sum(), 1e-9)
    shards = max(1, int(np.ceil((total[2] - len(heavy)) / shard_components)))
    edges = np.cumsum(part)[:-1]
    u = F.pmod(F.xxhash64("root", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    now = written(light.withColumn("k", sum((F.when(u >= float(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("int")), "placed")

    def measured(df: DataFrame) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Cost of an assignment, what it is off by in rows and labels, and all its rows."""
        s, lab = np.zeros(k), np.zeros(k)
        for r in df.groupBy("k").agg(F.sum("n_rows").alias("s"), F.sum("n_risky").alias("l")).collect():
            s[r["k"]], lab[r["k"]] = r["s"], r["l"] * weight
        return _cost(s, lab, want, want_labels), s - want, lab - want_labels, s.sum()

    best, (cost, off, off_labels, light_rows) = now, measured(now)
    turn = 0
    while light_rows:
        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("root", ignore_index=True)
            size, label, start = pdf.n_rows.to_numpy(float), pdf.n_risky.to_numpy(float) * weight, pdf.k.to_numpy(int)
            mine = size.sum() / light_rows
            have, have_labels = np.bincount(start, weights=size, minlength=k), np.bincount(start, weights=label, minlength=k)
            got = anneal(size, label, start, have - off * mine, have_labels - off_labels * mine, seed + 1000 * turn + int(pdf.shard.iloc[0]), chains, moves * len(pdf))
            return pd.DataFrame({"root": pdf.root, "n_rows": pdf.n_rows, "n_risky": pdf.n_risky, "k": got.astype("int32")})

        dealt = best.withColumn("shard", F.pmod(F.xxhash64("root", F.lit(seed + turn)), F.lit(shards)).cast("int"))
        now = written(dealt.groupBy("shard").applyInPandas(search, "root string, n_rows bigint, n_risky bigint, k int"), "placed")
        before, after = cost, measured(now)
        if after[0] < cost:
            best, (cost, off, off_labels, light_rows) = now, after
        turn += 1
        if cost > 0.9 * before:
            break
    placed = best.select("root", "k")
    if fixed:
        placed = placed.unionByName(at.sparkSession.createDataFrame(fixed, "root string, k int"))
    names = F.array(*[F.lit(s) for s in SPLITS[:k]])
    named = comps.join(placed, "root").select("root", "group_id", names[F.col("k")].alias("split"))
    return at.join(named, "root").select("episode_id", "group_id", "split")


def split_report(splits: DataFrame, events: DataFrame) -> DataFrame:
    """``split, n_groups, n_episodes, n_rows, n_risky, row_share`` of an assignment."""
    sizes = events.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("risk_event")).alias("n_risky"))
    per = splits.join(sizes, "episode_id").groupBy("split").agg(
        F.count_distinct("group_id").alias("n_groups"), F.count(F.lit(1)).alias("n_episodes"), F.sum("n_rows").alias("n_rows"), F.sum("n_risky").alias("n_risky")
    )
    total = per.agg(F.sum("n_rows").alias("_all"))
    return per.crossJoin(F.broadcast(total)).select(*per.columns, F.round(F.col("n_rows") / F.col("_all"), 6).alias("row_share"))


def split_balance(splits: DataFrame, events: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), bound: float = 0.005) -> DataFrame:
    """``split, share_kept, labels_kept, groups_cut``: whether the shares of rows and of risky rows are within ``bound`` (of all, four times that for labels), and how many groups are in several splits."""
    report = split_report(splits, events)
    want = splits.sparkSession.createDataFrame(list(zip(SPLITS, shares, strict=False)), "split string, want double")
    cut = splits.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups_cut"))
    risky = report.agg(F.sum("n_risky").alias("all_risky"))
    joined = want.join(report, "split", "left").crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(risky))  # two tables of one row
    label_share = F.col("n_risky") / F.col("all_risky")
    return joined.select(
        "split", F.coalesce(F.abs(F.col("row_share") - F.col("want")) <= bound, F.lit(False)).alias("share_kept"),
        F.coalesce(F.abs(label_share - F.col("want")) <= 4 * bound, F.col("all_risky") == 0).alias("labels_kept"), "groups_cut",
    )
