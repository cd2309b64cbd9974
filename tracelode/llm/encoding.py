"""Encoding of a corpus with a public byte-level BPE vocabulary, by a pair occurrence index.

Each task gathers the distinct pieces of its texts, lays their bytes out as one linked sequence and
keeps an index from every mergeable pair to all its positions. Active ranks come off a heap in
ascending order; all positions of a rank merge from left to right, and only the lists of the two
neighbouring pairs are updated. A piece costs O(n log n) however long it is, and a piece that
occurs a million times in a task is merged once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelode.session import spread

# fixed value: the pattern that splits text into pieces before the merges
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept between batches, and characters of text merged at once: bounds on a worker's memory, not on the result.
_KEEP, _CHARS = 400_000, 8_000_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairIndexEncoder:
    """Encodes pieces by the ranks of a vocabulary; ``merge`` does a whole set of pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(PIECES).findall
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _rank(self, a: int, b: int) -> int:
        r = self.pair_rank.get((a, b))
        if r is None:
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            self.pair_rank[a, b] = r
        return r

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        single = [self.ranks[bytes([b])] for b in range(256)]
        tok: list[int] = []
        starts = []
        for p in pieces:
            starts.append(len(tok))
            tok.extend(single[b] for b in p)
        n = len(tok)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            if s < n:
                left[s] = -1
            if s:
                right[s - 1] = -1
        if n:
            right[n - 1] = -1
        at: dict[int, list[int]] = {}
        for i in range(n):
            j = right[i]
            if j >= 0 and (r := self._rank(tok[i], tok[j])) >= 0:
                at.setdefault(r, []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = at.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = right[i]
                # a position is stale if a merge consumed either side since it was entered
                if tok[i] < 0 or j < 0 or self._rank(tok[i], tok[j]) != r:
                    continue
                tok[i], tok[j] = r, -1
                after, before = right[j], left[i]
                right[i] = after
                lower = False
                if after >= 0:
                    left[after] = i
                    q = self._rank(r, tok[after])
                    if q >= 0:
                        if q in at:
                            at[q].append(i)
                        else:
                            at[q] = [i]
                            heapq.heappush(active, q)
                        lower |= q < r
                if before >= 0:
                    q = self._rank(tok[before], r)
                    if q >= 0:
                        if q in at:
                            at[q].append(before)
                        else:
                            at[q] = [before]
                            heapq.heappush(active, q)
                        lower |= q < r
                if lower and k + 1 < len(places):
                    # a pair of lower rank came up: it goes first, the rest of this list waits
                    at.setdefault(r, []).extend(places[k + 1 :])
                    heapq.heappush(active, r)
                    break
        out = []
        for p, s in zip(pieces, starts, strict=True):
            ids, i = [], s if p else -1
            while i >= 0:
                ids.append(tok[i])
                i = right[i]
            out.append(tuple(ids))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for null and for empty texts."""
        split = [self.split(t) if t else [] for t in texts]
        new = list({p for ps in split for p in ps if p not in self.known})
        if new:
            if len(self.known) + len(new) > _KEEP:
                self.known.clear()
                new = list({p for ps in split for p in ps})
            self.known.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        known = self.known
        out = []
        for ps in split:
            ids: list[int] = []
            for p in ps:
                ids += known[p]
            out.append(ids)
        return out


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``out``, an array of integers, for every row of ``df``.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list,
    blank ones their pieces; no text is cut. The vocabulary is read on the driver from the path given
    and broadcast: its size is that of the file, whatever the corpus is.
    """
    sc = df.sparkSession.sparkContext
    ranks = sc.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(ranks.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            ids: list[list[int]] = []
            pending: list[str | None] = []
            chars = 0
            for t in texts:
                t = t.as_py()
                pending.append(t)
                chars += len(t or "")
                if chars > _CHARS:
                    ids += encoder.encode(pending)
                    pending, chars = [], 0
            ids += encoder.encode(pending)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32()))], [*keep, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in df.schema.fields if f.name == c)
    return spread(df.select(*keep, text)).mapInArrow(run, f"{kinds}, `{out}` array<int>")
