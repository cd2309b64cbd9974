"""Evaluation texts that leak into a training corpus, found by a positional inverted index.

``index_corpus`` stores the training postings that a test set can meet: the positions of its terms in
runs of at least ``SEED`` words whose neighbours are neighbours in some test item, as told by a bitmap of
fixed size (any match contains such runs, see below, so nothing is lost; a false neighbour costs a posting).
``leaks`` intersects these lists: for every word sequence of length ``SEED`` of the test items it starts
from the postings of its rarest term, shifts them by the term's offset, and keeps the positions that the
lists of the other terms, from rare to frequent, have as well. What remains are exact phrases. The
documents and items that share one are then verified word by word for the proximity match, with at most
one word in ``TOLERANCE`` changed, missing or added: that is an alignment, not an index operation.

Why seeds of 4 lose nothing: a run of L words with at most k = floor(L / 6) edits has at least
L - k words in at most k + 1 exact stretches, so at least L - 4k - 3 seeds, which is 3 or more for
every L from 16 to 31; and a longer run has such a run in one of its halves.

Why phrases that many items share may be left out of the search: sequences are left out only where no
``WINDOW`` = 15 neighbouring ones of the item lose more than ``SPARED`` = 2. A run of L words has L - 3
sequences, its edits spoil 4k at most, and 2 for each 15 of them (and up to 2 of the rest) are left out,
which leaves one or more for every L from 16 to 31 (``test_spared_sequences_leave_a_seed``). So every
admissible pair is a candidate by a sequence that stays, and its seeds are counted again in verification.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import spread, written

LEAST, TOLERANCE, SEED, LEAST_SEEDS = 16, 6, 4, 3
#: Word sequences that more items than this share are left out where enough others remain.
SHARED, WINDOW, SPARED = 4, 15, 2
#: Bits of the bitmap of neighbours: 8 MB, whatever the size of the test set.
_BITS = 26
_MOST_EDITS = (2 * LEAST - 1) // TOLERANCE
_TERMS = [f"t{k}" for k in range(SEED)]


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, character references, soft hyphens; [] for null."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = re.sub(r"</?[a-zA-Z][^<>]*>", " ", text)
    if not text.isascii():
        text = re.sub("[\u00ad\u200b-\u200d\u2060\ufeff]", "", unicodedata.normalize("NFKC", text))
    return re.findall(r"[^\W_]+", text.casefold())


class _Terms(dict):
    """64-bit hash of each word, remembered; forgotten as a whole beyond a million words, which changes no result."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))


def _slots(terms: np.ndarray) -> np.ndarray:
    """Bit of each pair of neighbours."""
    u = terms.view(np.uint64)
    return ((u[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (u[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - _BITS)


def _layers(least: int, tolerance: int) -> np.ndarray:
    """Item words that a run with 0, 1, ... edits must have."""
    return np.array([max(least, tolerance * e) for e in range((2 * least - 1) // tolerance + 1)])[:, None]


def _aligned(item: np.ndarray, d: np.ndarray, need: np.ndarray) -> bool:
    """Whether two sequences of codes share a run. Layer e of the table holds, for each end in ``d``, the most item words that e edits allow."""
    before = np.zeros((len(need), len(d) + 1), np.int32)
    for w in item:
        best = np.where(d == w, before[:, :-1] + 1, 0)
        if (best >= need).any():
            return True
        skipped = np.maximum(before[:-1, :-1], before[:-1, 1:])
        np.maximum(best[1:], np.where(skipped > 0, skipped + 1, 0), out=best[1:])
        for e in range(1, len(need)):
            np.maximum(best[e, 1:], best[e - 1, :-1], out=best[e, 1:])
        before[:, 1:] = best
    return False


def _coded(item: list[str], doc: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return np.array([codes[w] for w in item]), np.array([codes.get(w, -1) for w in doc])


def holds_run(item: list[str], doc: list[str], least: int = LEAST, tolerance: int = TOLERANCE) -> bool:
    """Whether ``doc`` has a run of ``least`` words of ``item`` with at most one edit per ``tolerance`` of its words.

    A run begins and ends with a word that both have. Runs of up to twice the least length decide it.
    """
    return len(item) >= least and len(doc) > 0 and _aligned(*_coded(item, doc), _layers(least, tolerance))


def _stretches(item: np.ndarray, d: np.ndarray, diagonals: range) -> tuple[int, int]:
    """Seeds on the diagonals, and the longest exact stretch."""
    seeds, longest = 0, 0
    for g in diagonals:
        a, b = max(0, -g), min(len(item), len(d) - g)
        if b - a < SEED:
            continue
        same = np.concatenate([[False], item[a:b] == d[a + g : b + g], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        length = edge[1::2] - edge[::2]
        if len(length):
            longest = max(longest, int(length.max()))
            seeds += int(np.maximum(length - SEED + 1, 0).sum())
    return seeds, longest


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, words, terms, slots`` of the items that are long enough to leak; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Terms()
        for batch in batches:
            rows = [(i, ws) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(ws := words(t)) >= LEAST]
            terms = [hashed.of(ws) for _, ws in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows], pa.int64()), pa.array([ws for _, ws in rows], pa.list_(pa.string())),
                    pa.array(terms, pa.list_(pa.int64())), pa.array([np.unique(_slots(t)).astype(np.int64) for t in terms], pa.list_(pa.int64())),
                ],
                ["item_id", "words", "terms", "slots"],
            )

    rows = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "item_text")
    return written(rows.mapInArrow(run, "item_id long, words array<string>, terms array<long>, slots array<long>"), "items")


def neighbours(coded: DataFrame) -> np.ndarray:
    """Bitmap of the pairs of neighbours in the items: 64 bits a row, so at most ``2 ** _BITS / 64`` rows come to the driver."""
    slot = coded.select(F.explode("slots").alias("s"))
    bits = slot.groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("bits")).toPandas()
    out = np.zeros((1 << _BITS) // 64, np.uint64)
    out[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def index_corpus(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``doc_id, words, runs(start, terms)`` of the documents with runs that hold ``LEAST_SEEDS`` word sequences or more; written."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("terms", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, bits = _Terms(), shipped.value
        for batch in batches:
            ids, texts, runs = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(text.as_py())
                if len(ws) < SEED + LEAST_SEEDS - 1:
                    continue
                terms = hashed.of(ws)
                slots = _slots(terms)
                near = np.zeros(len(slots) + 2, bool)
                near[1:-1] = (bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)
                edge = np.flatnonzero(near[1:] != near[:-1])
                starts, ends = edge[::2], edge[1::2] + 1
                long = ends - starts >= SEED
                if (ends - starts - SEED + 1)[long].sum() < LEAST_SEEDS:
                    continue
                ids.append(doc_id)
                texts.append(ws)
                runs.append([{"start": a, "terms": terms[a:b]} for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(runs, kind)], ["doc_id", "words", "runs"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return written(spread(rows).mapInArrow(run, "doc_id bigint, words array<string>, runs array<struct<start: int, terms: array<bigint>>>"), "postings")


def spared(shared: list[int], most: int = SHARED) -> list[bool]:
    """Which word sequences of an item to search by, given how many items share each: the most shared ones are
    left out as long as no ``WINDOW`` neighbouring ones lose more than ``SPARED``."""
    n = len(shared)
    keep, lost = [True] * n, [0] * n  # lost[a]: left out among a .. a + WINDOW - 1
    for k in sorted((k for k in range(n) if shared[k] > most), key=lambda k: (-shared[k], k)):
        windows = range(max(0, k - WINDOW + 1), k + 1)
        if all(lost[a] < SPARED for a in windows):
            keep[k] = False
            for a in windows:
                lost[a] += 1
    return keep


def places(coded: DataFrame) -> DataFrame:
    """``gram, t0.., item_id, off``: the word sequences that items are searched by; written."""
    at = F.sequence(F.lit(0), F.size("terms") - SEED)
    each = coded.select("item_id", F.explode(F.transform(at, lambda o: F.struct(o.alias("off"), *[F.get("terms", o + k).alias(t) for k, t in enumerate(_TERMS)]))).alias("x")).select("item_id", "x.*")
    each = each.withColumn("gram", F.xxhash64(*_TERMS))
    counts = each.groupBy("gram").agg(F.count_distinct("item_id").cast("int").alias("shared"))
    per_item = each.join(counts, "gram").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("off", "gram", *_TERMS, "shared"))).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(1)
            keep = [spared([x["shared"] for x in one]) for one in xs.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), xs, pa.array(keep, pa.list_(pa.bool_()))], ["item_id", "xs", "keep"])

    kind = "array<struct<off: int, gram: bigint, " + ", ".join(f"{t}: bigint" for t in _TERMS) + ", shared: int>>"
    chosen = per_item.mapInArrow(run, f"item_id long, xs {kind}, keep array<boolean>")
    return written(chosen.select("item_id", F.explode(F.arrays_zip("xs", "keep")).alias("x")).where("x.keep").select("item_id", "x.xs.off", "x.xs.gram", *[f"x.xs.{t}" for t in _TERMS]), "places")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: every document with a passage of a test item, exact or nearly so.

    Whole texts, all documents and all items are searched in one pass; neither a vocabulary nor item
    texts nor postings go through the driver. Null texts and ids give no rows; items shorter than
    ``LEAST`` words cannot leak; repeated documents are found under each of their ids, repeated ids once.
    """
    spark = docs.sparkSession
    coded = item_terms(items)
    index = index_corpus(docs, neighbours(coded))
    place = places(coded)
    postings = index.select("doc_id", F.inline("runs")).select("doc_id", F.posexplode("terms").alias("k", "term"), "start").select("doc_id", (F.col("start") + F.col("k")).alias("pos"), "term")
    df = written(postings.groupBy("term").agg(F.count_distinct("doc_id").alias("df")), "frequencies")
    # every sequence with its terms from rare to frequent; one whose term the corpus lacks has no hits
    gram = place.select("gram", *_TERMS).distinct()
    for k, t in enumerate(_TERMS):
        gram = gram.join(df.select(F.col("term").alias(t), F.struct("df", F.lit(k).alias("o"), F.col("term").alias("t")).alias(f"s{k}")), t)
    ordered = F.sort_array(F.array(*[f"s{k}" for k in range(SEED)]))
    gram = gram.select("gram", ordered.alias("x")).select("gram", *[c for k in range(SEED) for c in (F.col("x")[k]["t"].alias(f"t{k}"), F.col("x")[k]["o"].alias(f"o{k}"))])
    # from the rarest term on: shifted lists, intersected one after the other
    hits = postings.join(gram.withColumnRenamed("t0", "term"), "term").withColumn("at", F.col("pos") - F.col("o0"))
    for k in range(1, SEED):
        other = postings.select("doc_id", F.col("pos").alias("_pos"), F.col("term").alias("_term"))
        on = (hits["doc_id"] == other["doc_id"]) & (hits["at"] + hits[f"o{k}"] == other["_pos"]) & (hits[f"t{k}"] == other["_term"])
        hits = hits.join(other, on, "left_semi")
    seeds = hits.select("doc_id", "at", "gram").join(place.select("gram", "item_id", "off"), "gram").select("doc_id", "item_id", (F.col("at") - F.col("off")).alias("diagonal"))
    pairs = seeds.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack, need = 2 * _MOST_EDITS, _layers(LEAST, TOLERANCE)
        for batch in batches:
            out_doc, out_item = [], []
            for doc_id, item_id, diagonals, ws, item in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                first = 0
                for k in range(1, len(diagonals) + 1):
                    if k == len(diagonals) or diagonals[k] - diagonals[k - 1] > slack:
                        a, b = max(0, diagonals[first] - slack), max(0, diagonals[k - 1] + len(item) + slack)
                        codes, d = _coded(item, ws[a:b])
                        found, longest = _stretches(codes, d, range(diagonals[first] - slack - a, diagonals[k - 1] + slack - a + 1))
                        if longest >= LEAST or found >= LEAST_SEEDS and _aligned(codes, d, need):
                            out_doc.append(doc_id)
                            out_item.append(item_id)
                            break
                        first = k
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_item, pa.int64())], ["doc_id", "item_id"])

    candidates = pairs.join(index.select("doc_id", "words"), "doc_id").join(coded.select("item_id", F.col("words").alias("item_words")), "item_id")
    # verification is all computation, so its rows are spread by number, not by bytes
    spread = candidates.select("doc_id", "item_id", "diagonals", "words", "item_words").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id", "item_id")
    return spread.mapInArrow(verify, "doc_id long, item_id long").distinct()
