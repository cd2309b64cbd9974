"""Consensus from several annotators' labels by a competence-and-spamming mixture.

Every vote is either truthful (with the annotator's competence ``theta``) or drawn from the
annotator's own guess distribution ``xi``. Expectation-maximisation yields the posterior of each
item's label and both parameters. Some annotators answer the opposite of what they see; a mixture
without them could only call such votes guesses. So every annotator has a polarity as well: where the
votes of one contradict the posterior beyond chance, they are read inverted from then on (and back, at
most ``TURNS`` times), and the mixture is fitted to the inverted votes. Several chains (one informed
start, the others at random by a hash of the annotator's id) run in the same passes, until the
likelihood of the best stands still and no vote is read anew; the likeliest chain is kept.

An E-step and the annotators' sums are one pass over items that hold their votes as a short array;
per task the sums are added up before the shuffle. Parameters go out as a broadcast as long as there
are at most ``local_annotators`` of them (a bound on bytes); beyond that the same chains with the same
starts, rules and end run on shuffled joins, with the same result but for the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.readings import is_blank
from tracelode.session import written

# fixed values: the answers that count, in lower case without outer spaces
_ANNOTATORS = "annotator_id string, n_votes long, competence double, guess_risky double, inverted boolean"
RISKY, SAFE = ("1", "true", "risky", "risk"), ("0", "false", "safe")


def read_label(c: Column) -> Column:
    """1, 0 or null for an answer that is no label."""
    bare = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(bare.isin(*RISKY), F.lit(1)).when(bare.isin(*SAFE), F.lit(0))


def usable_votes(labels: DataFrame) -> DataFrame:
    """``episode_id, annotator_id, vote, severity_score, first_risk_step``: each annotator's latest usable vote.

    Votes without episode or annotator count for nothing; undated votes are oldest, ties go to the largest label_id.
    """
    rows = labels.withColumn("vote", read_label(F.col("binary_risk_label"))).where(
        F.col("vote").isNotNull() & ~is_blank(F.col("episode_id")) & ~is_blank(F.col("annotator_id"))
    )
    latest = F.max(F.struct("labelled_at", "label_id", "vote", F.col("severity_score").alias("sev"), F.col("first_risk_step").alias("step"))).alias("v")
    return rows.groupBy("episode_id", "annotator_id").agg(latest).select(
        "episode_id", "annotator_id", "v.vote", F.col("v.sev").alias("severity_score"), F.col("v.step").alias("first_risk_step")
    )


#: How often the reading of an annotator's votes may turn in a chain, so that every chain comes to an end.
TURNS = 2
#: Every so many rounds the polarities are looked at; the end is judged in these rounds only.
EVERY = 5


class Fit(NamedTuple):
    items: DataFrame
    annotators: DataFrame
    rounds: int


def _starts(chains: int, seed: int) -> list[Column]:
    """Start of competence and guess of each chain: a half in the first one, else by hash in 0.2..0.8."""
    u = lambda c, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(k), F.col("annotator_id")), F.lit(1 << 20)) / float(1 << 20) * 0.6 + 0.2
    pairs = [(F.lit(0.5), F.lit(0.5)) if c == 0 else (u(c, 0), u(c, 1)) for c in range(chains)]
    return [x.alias(f"{n}{c}") for c, pair in enumerate(pairs) for n, x in zip(("t", "x"), pair, strict=True)]


def _log_tables(theta: np.ndarray, xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(vote | truth 1) and log P(vote | truth 0) by code = 2 * annotator + vote."""
    one, zero = np.empty((2 * len(theta), theta.shape[1])), np.empty((2 * len(theta), theta.shape[1]))
    one[1::2], one[0::2] = np.log(theta + (1 - theta) * xi), np.log((1 - theta) * (1 - xi))
    zero[1::2], zero[0::2] = np.log((1 - theta) * xi), np.log(theta + (1 - theta) * (1 - xi))
    return one, zero


def _inverted(n: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Annotators (by chain) whose share of 1 is lower where the posterior says 1, by three standard errors."""
    one_true, zero_true = agree[:, 1] + (n[:, 0] - agree[:, 0]), agree[:, 0] + (n[:, 1] - agree[:, 1])
    p, q = (agree[:, 1] + 0.5) / (one_true + 1), (n[:, 1] - agree[:, 1] + 0.5) / (zero_true + 1)
    spread = np.sqrt(p * (1 - p) / (one_true + 1) + q * (1 - q) / (zero_true + 1))
    return (q - p) / np.maximum(spread, 1e-9) > 3


def _turned(x: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Rows by annotator and vote, with the votes of inverted annotators exchanged."""
    return np.where(flip[:, None, :], x[:, ::-1, :], x)


def _posterior(values: np.ndarray, offsets: np.ndarray, one: np.ndarray, zero: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.add.reduceat(one[values], offsets[:-1], axis=0) + np.log(prior)
    b = np.add.reduceat(zero[values], offsets[:-1], axis=0) + np.log(1 - prior)
    top = np.maximum(a, b)
    z = top + np.log(np.exp(a - top) + np.exp(b - top))
    return np.exp(a - z), z


def _update(n: np.ndarray, agree: np.ndarray, theta: np.ndarray, xi: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """M-step. ``n`` votes and ``agree`` posterior mass that the voted label is true, by annotator, vote and chain."""
    truthful = agree * np.stack([theta / (theta + (1 - theta) * (1 - xi)), theta / (theta + (1 - theta) * xi)], axis=1)
    guessed = n - truthful
    new_theta = (truthful.sum(1) + smooth) / (n.sum(1) + 2 * smooth)
    new_xi = (guessed[:, 1] + smooth) / (guessed.sum(1) + 2 * smooth)
    return np.clip(new_theta, 1e-4, 1 - 1e-4), np.clip(new_xi, 1e-4, 1 - 1e-4)


def _arrays(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index(name))
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _over(likelihood: float, previous: float | None, tolerance: float) -> bool:
    return previous is not None and abs(likelihood - previous) <= tolerance * max(1.0, abs(previous))


def fit(votes: DataFrame, tolerance: float = 1e-8, chains: int = 6, smooth: float = 0.5, seed: int = 11, local_annotators: int = 200_000) -> Fit:
    """``items``: ``episode_id, n_votes, n_risky, p_risky``; ``annotators``: ``annotator_id, n_votes, competence, guess_risky, inverted``; and the rounds it took.

    It ends when the likelihood of the best chain changes by at most ``tolerance`` of itself in a round
    and none of its polarities turns; no number of rounds ends it.
    """
    spark = votes.sparkSession
    votes = written(votes.select("episode_id", "annotator_id", "vote"), "votes")
    names = written(votes.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_votes"), F.sum("vote").alias("n_one")).select("*", *_starts(chains, seed)), "annotators")
    if names.count() > local_annotators:
        return _fit_joined(votes, names, tolerance, chains, smooth)
    known = names.orderBy("annotator_id").toPandas()  # at most local_annotators rows
    if not len(known):
        return Fit(spark.createDataFrame([], "episode_id string, n_votes long, n_risky long, p_risky double"), spark.createDataFrame([], _ANNOTATORS), 0)
    j = len(known)
    index = spark.createDataFrame([(a, i) for i, a in enumerate(known.annotator_id)], "annotator_id string, i int")
    # an item has at most one vote per annotator, and there are at most local_annotators of them
    coded = votes.join(index, "annotator_id").groupBy("episode_id").agg(F.collect_list(F.col("i") * 2 + F.col("vote")).alias("codes"))
    items = written(coded, "vote-items")

    theta, xi = (known[[f"{n}{c}" for c in range(chains)]].to_numpy(float) for n in ("t", "x"))
    prior = np.full(chains, 0.5)
    counts = np.stack([known.n_votes - known.n_one, known.n_one], axis=1).astype(float)[:, :, None]
    counts = np.repeat(counts, chains, axis=2)
    flip, turns = np.zeros((j, chains), bool), np.zeros((j, chains), int)
    n_items, previous, k = items.count(), None, 0

    def tables() -> tuple[np.ndarray, np.ndarray]:
        return tuple(_turned(x.reshape(j, 2, chains), flip).reshape(2 * j, chains) for x in _log_tables(theta, xi))

    while True:
        one, zero = tables()
        shipped = spark.sparkContext.broadcast((one, zero, prior))

        def pass_over(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            one, zero, prior = shipped.value
            agree = np.zeros((2 * j, chains))
            total = np.zeros((2, chains))  # likelihood, posterior mass of 1
            for batch in batches:
                if not batch.num_rows:
                    continue
                values, offsets = _arrays(batch, "codes")
                p, z = _posterior(values, offsets, one, zero, prior)
                each = np.repeat(p, np.diff(offsets), axis=0)
                mass = np.where((values % 2 == 1)[:, None], each, 1 - each)
                for c in range(chains):
                    agree[:, c] += np.bincount(values, weights=mass[:, c], minlength=2 * j)
                total += np.stack([z.sum(0), p.sum(0)])
            codes = np.arange(-2, 2 * j, dtype="int32")
            both = np.concatenate([total, agree])
            seen = np.flatnonzero(np.abs(both).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(codes[seen]), *[pa.array(both[seen, c]) for c in range(chains)]], ["code", *[f"c{c}" for c in range(chains)]])

        kinds = "code int, " + ", ".join(f"c{c} double" for c in range(chains))
        got = items.select("codes").mapInArrow(pass_over, kinds).groupBy("code").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(chains)]).toPandas()
        dense = np.zeros((2 * j + 2, chains))
        dense[got.code.to_numpy() + 2] = got.drop(columns="code").to_numpy()
        likelihood, agree = dense[0], dense[2:].reshape(j, 2, chains)
        best = int(np.argmax(likelihood))
        # what the reading of the votes makes of counts and agreement
        n_read = _turned(counts, flip)
        agree_read = np.where(flip[:, None, :], _turned(counts - agree, flip), agree)
        theta, xi = _update(n_read, agree_read, theta, xi, smooth)
        looked, turned, k = k % EVERY == EVERY - 1, False, k + 1
        if looked:
            wrong = _inverted(n_read, agree_read) & (turns < TURNS)
            flip, turns, theta, xi = flip ^ wrong, turns + wrong, np.where(wrong, 0.5, theta), np.where(wrong, 1 - xi, xi)
            turned = bool(wrong[:, best].any())
        prior = np.clip((dense[1] + 1) / (n_items + 2), 1e-3, 1 - 1e-3)
        shipped.unpersist()
        if looked and not turned and _over(likelihood[best], previous, tolerance):
            break
        previous = likelihood[best]
    final = spark.sparkContext.broadcast((*[x[:, [best]] for x in tables()], prior[[best]]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, offsets = _arrays(batch, "codes")
                p, _ = _posterior(values, offsets, *final.value)
                n_one = np.add.reduceat((values % 2).astype("int64"), offsets[:-1])
                cols = [batch.column(batch.schema.get_field_index("episode_id")), pa.array(np.diff(offsets).astype("int64")), pa.array(n_one), pa.array(p[:, 0])]
                yield pa.RecordBatch.from_arrays(cols, ["episode_id", "n_votes", "n_risky", "p_risky"])

    known["competence"], known["guess_risky"], known["inverted"] = theta[:, best], np.where(flip[:, best], 1 - xi[:, best], xi[:, best]), flip[:, best]
    annotators = spark.createDataFrame(known[["annotator_id", "n_votes", "competence", "guess_risky", "inverted"]], _ANNOTATORS)
    return Fit(items.mapInArrow(label, "episode_id string, n_votes long, n_risky long, p_risky double"), annotators, k)


def _fit_joined(votes: DataFrame, names: DataFrame, tolerance: float, chains: int, smooth: float) -> Fit:
    """``fit`` with shuffled joins, all chains side by side in columns, for more annotators than a broadcast may hold."""
    each = range(chains)
    people = names.select("annotator_id", "n_votes", *[f"{n}{c}" for c in each for n in ("t", "x")], *[F.lit(False).alias(f"f{c}") for c in each], *[F.lit(0).alias(f"r{c}") for c in each])
    prior, previous, k = [0.5] * chains, None, 0
    n_items = votes.select("episode_id").distinct().count()
    clip = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    read = lambda c: F.when(F.col(f"f{c}"), 1 - F.col("vote")).otherwise(F.col("vote"))
    guess = lambda c: F.when(read(c) == 1, F.col(f"x{c}")).otherwise(1 - F.col(f"x{c}"))

    def posteriors(people: DataFrame) -> DataFrame:
        """``episode_id, n_votes, n_risky`` and by chain the posterior ``p`` and the log-likelihood ``z``; written."""
        seen = votes.join(people, "annotator_id")
        log = lambda c, y: F.log(F.when(read(c) == y, F.col(f"t{c}")).otherwise(0.0) + (1 - F.col(f"t{c}")) * guess(c))
        sums = seen.groupBy("episode_id").agg(
            F.count(F.lit(1)).alias("n_votes"), F.sum("vote").alias("n_risky"), *[F.sum(log(c, 1)).alias(f"a{c}") for c in each], *[F.sum(log(c, 0)).alias(f"b{c}") for c in each]
        )
        out = []
        for c in each:
            a, b = F.col(f"a{c}") + float(np.log(prior[c])), F.col(f"b{c}") + float(np.log(1 - prior[c]))
            z = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
            out += [F.exp(a - z).alias(f"p{c}"), z.alias(f"z{c}")]
        return written(sums.select("episode_id", "n_votes", "n_risky", *out), "posteriors")

    while True:
        items = posteriors(people)
        total = items.agg(*[F.sum(f"z{c}").alias(f"z{c}") for c in each], *[F.sum(f"p{c}").alias(f"p{c}") for c in each]).first()
        likelihood = [total[f"z{c}"] for c in each]
        best = int(np.argmax(likelihood))
        aggs = []
        for c in each:
            p, r, t = F.col(f"p{c}"), read(c), F.col(f"t{c}")
            truthful = F.when(r == 1, p).otherwise(1 - p) * t / (t + (1 - t) * guess(c))
            aggs += [
                F.sum(truthful).alias(f"true{c}"), F.sum(F.when(r == 1, 1 - truthful).otherwise(0.0)).alias(f"one{c}"), F.sum(p).alias(f"risky{c}"),
                F.sum(1 - p).alias(f"safe{c}"), F.sum(p * r).alias(f"hit{c}"), F.sum((1 - p) * r).alias(f"slip{c}"),
            ]
        sums = votes.join(people, "annotator_id").join(items.select("episode_id", *[f"p{c}" for c in each]), "episode_id").groupBy("annotator_id").agg(*aggs)
        looked, k = k % EVERY == EVERY - 1, k + 1
        columns, wrongs = [], []
        for c in each:
            get = lambda n, c=c: F.col(f"{n}{c}")
            hit, slip = (get("hit") + 0.5) / (get("risky") + 1), (get("slip") + 0.5) / (get("safe") + 1)
            spread = F.sqrt(hit * (1 - hit) / (get("risky") + 1) + slip * (1 - slip) / (get("safe") + 1))
            wrong = ((slip - hit) / F.greatest(spread, F.lit(1e-9)) > 3) & (get("r") < TURNS) if looked else F.lit(False)
            theta = clip((get("true") + smooth) / (F.col("n_votes") + 2 * smooth))
            xi = clip((get("one") + smooth) / (F.col("n_votes") - get("true") + 2 * smooth))
            columns += [F.when(wrong, 0.5).otherwise(theta).alias(f"t{c}"), F.when(wrong, 1 - xi).otherwise(xi).alias(f"x{c}"), (get("f") != wrong).alias(f"f{c}"), (get("r") + wrong.cast("int")).alias(f"r{c}")]
            wrongs.append(wrong.alias(f"w{c}"))
        people = written(people.select("annotator_id", "n_votes", *[f"{n}{c}" for c in each for n in ("t", "x", "f", "r")]).join(sums, "annotator_id").select("annotator_id", "n_votes", *columns, *wrongs), "annotators")
        turned = looked and bool(people.agg(F.max(f"w{best}")).first()[0])
        prior = [min(max((total[f"p{c}"] + 1) / (n_items + 2), 1e-3), 1 - 1e-3) for c in each]
        if looked and not turned and _over(likelihood[best], previous, tolerance):
            break
        previous = likelihood[best]
    xi = F.when(F.col(f"f{best}"), 1 - F.col(f"x{best}")).otherwise(F.col(f"x{best}"))
    annotators = people.select("annotator_id", "n_votes", F.col(f"t{best}").alias("competence"), xi.alias("guess_risky"), F.col(f"f{best}").alias("inverted"))
    return Fit(posteriors(people).select("episode_id", "n_votes", "n_risky", F.col(f"p{best}").alias("p_risky")), annotators, k)


def consensus(labels: DataFrame, least: int = 3, **how) -> DataFrame:
    """``episode_id, binary_risk_label, p_risky, n_annotators, agreement`` for episodes with ``least`` annotators or more.

    ``agreement`` is the share of its annotators whose vote is the consensus. Votes of episodes with fewer
    annotators still count for the annotators' parameters. A posterior of exactly a half is read as 0.
    """
    items = fit(usable_votes(labels), **how).items
    label = (F.col("p_risky") > 0.5).cast("long")
    agreed = F.when(label == 1, F.col("n_risky")).otherwise(F.col("n_votes") - F.col("n_risky"))
    return items.where(F.col("n_votes") >= least).select(
        "episode_id", label.alias("binary_risk_label"), "p_risky", F.col("n_votes").alias("n_annotators"), (agreed / F.col("n_votes")).alias("agreement")
    )


def annotator_reliability(labels: DataFrame, **how) -> DataFrame:
    """``annotator_id, n_votes, competence, guess_risky, inverted``: share of truthful votes, share of 1 among the guesses, polarity."""
    return fit(usable_votes(labels), **how).annotators


def full_consensus(labels: DataFrame, least: int = 3, **how) -> DataFrame:
    """``consensus`` with ``severity_score`` in 0..1 and ``first_risk_step`` of the risky episodes.

    Severities are brought to one scale by the annotator's own largest value (1, 10 or 100); both are
    medians over the votes that agree with the consensus, weighted by repeating nothing: null if no
    agreeing vote has one.
    """
    votes = written(usable_votes(labels), "usable-votes")
    items = fit(votes, **how).items
    label = (F.col("p_risky") > 0.5).cast("long")
    agreed = F.when(label == 1, F.col("n_risky")).otherwise(F.col("n_votes") - F.col("n_risky"))
    found = items.where(F.col("n_votes") >= least).select(
        "episode_id", label.alias("binary_risk_label"), "p_risky", F.col("n_votes").alias("n_annotators"), (agreed / F.col("n_votes")).alias("agreement")
    )
    top = votes.groupBy("annotator_id").agg(F.max("severity_score").alias("top"))
    scale = F.when(F.col("top") <= 1, 1.0).when(F.col("top") <= 10, 10.0).otherwise(100.0)
    sound = F.when((F.col("severity_score") >= 0) & (F.col("severity_score") <= scale), F.col("severity_score") / scale)
    details = (
        votes.join(top, "annotator_id")
        .join(found.select("episode_id", "binary_risk_label"), "episode_id")
        .where(F.col("vote") == F.col("binary_risk_label"))
        .groupBy("episode_id")
        .agg(
            F.median(sound).alias("severity_score"),
            F.median(F.when((F.col("vote") == 1) & (F.col("first_risk_step") >= 0), F.col("first_risk_step"))).cast("long").alias("first_risk_step"),
        )
    )
    return found.join(details, "episode_id", "left")
