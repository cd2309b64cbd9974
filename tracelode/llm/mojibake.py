"""Garbled text from wrong character encodings: found and restored as decoding of a noisy channel.

The channel turned a character into the bytes of one encoding and read these with the table of
another one. For texts whose bytes were UTF-8, each run of characters outside ASCII becomes a lattice
of bytes per table: an arc reads one character as it stands, or two to four characters as the bytes
of one UTF-8 character, where a byte lost to U+FFFD, the first one too, is a wildcard that any byte may
fill as long as one byte is left; U+FFFD may also be a whole character that was lost, and a C1 control
the byte of another table. No true text has either, so as they stand they cost more than any character.
Viterbi search finds the cheapest path under the character frequencies of the whole corpus; it is
repeated on its own result until nothing is gained, as texts are read wrongly more than once. Where one
single-byte table was taken for another (nothing in the bytes tells then), the corpus's word frequencies
decide, summed up over the words of a document. Words that lost characters to U+FFFD are filled from the
most frequent corpus word of the same pattern. Words are costed one by one, so that a path's best reading
is each word's best reading and the frequencies can be joined instead of shipped.

Corpus statistics cover all documents. Character counts are broadcast (there are at most as many as
Unicode has characters); word counts are joined, never collected.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import spread, written

# fixed values: tables that UTF-8 bytes are read with, the more usual first
UTF8_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866")
# fixed values: single-byte tables (true, taken for)
SINGLE = (("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("koi8_r", "cp1252"), ("cp866", "cp1252"))
#: Log-odds that a run was garbled at all, and what each valid UTF-8 sequence adds by its length (its chance by accident).
LEAST_GAIN, VALID = 4.5, {2: 2.5, 3: 5.0, 4: 7.0}
#: Sum of the words' log-odds above which a document counts as read with another single-byte table.
LEAST_WORD_GAIN = 8.0
#: Cost of U+FFFD or a C1 control as true text, and of a character lost as a whole; what a lost byte adds, more for a first one.
IMPOSSIBLE, ERASED, LOST_BYTE, LOST_LEAD = 14.0, 6.0, 2.0, 4.0
LOST = "\ufffd"
_REF = re.compile(r"&(?:#[xX]([0-9a-fA-F]{2,6})|#([0-9]{3,7})|([A-Za-z][A-Za-z0-9]{1,31}));")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Runs in which some or all characters are written as references.
_CHUNK = re.compile(f"(?:[^\\x00-\\x7f]|{_REF.pattern})+")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_QUOTES = "`\"'"
_SUSPECT = r"[^\x00-\x7F]|&(#[xX][0-9a-fA-F]{2,6}|#[0-9]{3,7}|[A-Za-z][A-Za-z0-9]{1,31});"
_WORD = r"[\p{L}\p{M}]*[\p{L}&&[^\x00-\x7F]][\p{L}\p{M}]*"


def _bytes_of(table: str) -> dict[str, int]:
    """Byte of each character that a table reads from 0x80 on; bytes it doesn't know are read as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(table)] = b
        except UnicodeDecodeError:
            pass
        if table in ("cp1252", "cp1250", "cp1251"):
            out.setdefault(chr(b), b) if b < 0xA0 else None
    return out


TABLES = {t: _bytes_of(t) for t in UTF8_AS}


def _pattern(table: dict[str, int]) -> re.Pattern:
    """Character sequences whose bytes in a table are one UTF-8 character, U+FFFD for any byte, but not for all."""
    cls = lambda lo, hi, more="": "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + more + "]"
    tail = cls(0x80, 0xBF, LOST)
    return re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{tail}|{cls(0xF0, 0xF4)}{tail}{tail}{tail}|{LOST}{{1,3}}{cls(0x80, 0xBF)}")


PATTERNS = {t: _pattern(b) for t, b in TABLES.items()}
#: What a C1 control is if its byte was meant in the usual Western table.
C1_MEANT = {chr(b): c for c, b in TABLES["cp1252"].items() if 0x80 <= b < 0xA0 and ord(c) > 0x9F}


def _pseudo(ch: str) -> float:
    """Prior count of a character by its block, so that rare letters aren't impossible in a small corpus."""
    o = ord(ch)
    if 0xC0 <= o <= 0x17F or 0x410 <= o <= 0x44F or o in (0x401, 0x451) or 0x2010 <= o <= 0x2044 or 0xA1 <= o <= 0xBF or o in (0x20AC, 0x2122, 0xA0):
        return 1.0
    if 0x3040 <= o <= 0x30FF or 0x3000 <= o <= 0x3020 or 0x1F300 <= o <= 0x1FAFF or 0x370 <= o <= 0x3FF or 0x2190 <= o <= 0x27BF:
        return 0.3
    if 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFFEF or 0x5D0 <= o <= 0x64A:
        return 0.1
    return 0.001


class Channel:
    """Costs of characters by their corpus counts, and the search for what was meant."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = math.log(sum(counts.values()) + 1000.0)
        self.costs: dict[str, float] = {}
        self.fills: dict[tuple[int | None, ...], str | None] = {}

    def cost(self, ch: str) -> float:
        c = self.costs.get(ch)
        if c is None:
            o = ord(ch)
            c = 0.0 if o < 0x80 else IMPOSSIBLE if ch == LOST or _C1.match(ch) else self.total - math.log(self.counts.get(ch, 0) + _pseudo(ch))
            self.costs[ch] = c
        return c

    def _fill(self, key: tuple[int | None, ...]) -> str | None:
        """Most frequent character whose UTF-8 bytes fit, None for lost bytes."""
        if key not in self.fills:
            best = None
            for ch, n in self.counts.items():
                b = ch.encode("utf-8", "replace")
                if len(b) == len(key) and ch != LOST and all(k is None or k == x for k, x in zip(key, b, strict=True)) and (best is None or n > best[0]):
                    best = (n, ch)
            self.fills[key] = best[1] if best else None
        return self.fills[key]

    def _read(self, codes: list[int | None]) -> str | None:
        if None in codes:
            return self._fill(tuple(codes))
        try:
            return bytes(codes).decode("utf-8")
        except UnicodeDecodeError:
            return None

    def viterbi(self, run: str, table: dict[str, int]) -> tuple[str, float, int, int]:
        """Cheapest reading of a run, its gain over the run as it stands, how many characters arcs of several consumed, and how many signs of loss it explains."""
        n = len(run)
        codes = [table.get(c) if c != LOST else None for c in run]
        known = [c == LOST or c in table for c in run]
        best = [0.0] + [math.inf] * n
        back: list[tuple[int, str]] = [(0, "")] * (n + 1)

        def arc(i: int, size: int, ch: str, cost: float) -> None:
            if best[i] + cost < best[i + size]:
                best[i + size], back[i + size] = best[i] + cost, (i, ch)

        for i, ch in enumerate(run):
            arc(i, 1, ch, self.cost(ch))
            if ch == LOST:
                arc(i, 1, LOST, ERASED)
            elif ch in C1_MEANT:
                arc(i, 1, C1_MEANT[ch], self.cost(C1_MEANT[ch]) + LOST_BYTE)
            b = codes[i]
            sizes = () if not known[i] else (2, 3, 4) if b is None else (2,) if 0xC2 <= b <= 0xDF else (3,) if 0xE0 <= b <= 0xEF else (4,) if 0xF0 <= b <= 0xF4 else ()
            for size in sizes:
                if i + size > n or not all(known[i + 1 : i + size]) or not all(c is None or 0x80 <= c <= 0xBF for c in codes[i + 1 : i + size]):
                    continue
                lost = codes[i + 1 : i + size].count(None)
                if b is None and lost == size - 1:
                    continue
                ch = self._read(codes[i : i + size])
                # a character that the corpus never has, of a script it hardly has, is an accident
                if ch is not None and (self.counts.get(ch, 0) or _pseudo(ch) >= 0.3):
                    arc(i, size, ch, self.cost(ch) - VALID[size] + LOST_BYTE * lost + (LOST_LEAD if b is None else 0.0))
        out, used, signs, i = [], 0, 0, n
        while i:
            j, ch = back[i]
            out.append(ch)
            used += i - j if i - j > 1 else 0
            signs += sum(c == LOST or c in C1_MEANT for c in run[j:i])
            i = j
        return "".join(reversed(out)), sum(map(self.cost, run)) - best[n], used, signs

    def restore_run(self, run: str, least: float = LEAST_GAIN) -> tuple[str, float]:
        """Best reading of a run over all tables, once or more until nothing is gained, and its gain; the run itself if nothing gains ``least``.

        Every reading has fewer characters than the one before, or fewer C1 controls, so it comes to an end.
        """
        text, gain = run, 0.0
        while True:
            found = None
            for t in UTF8_AS:
                if PATTERNS[t].search(text):
                    got, g, used, signs = self.viterbi(text, TABLES[t])
                    # true text may stand beside garbled text in a run, but most of the run must be read anew, and a lone pair must be all of it
                    need = least if used > 3 or used == len(text) else least + 4
                    if got != text and g >= need and (2 * used >= len(text) or used and signs) and (found is None or g > found[1]):
                        found = (got, g)
            if found is None and (LOST in text or _C1.search(text)):
                # no table explains it: characters lost as a whole, or bytes of the usual Western table
                got, g, _, _ = self.viterbi(text, {})
                if got == text:
                    return text, gain + g
                found = (got, g) if g >= least else None
            if found is None:
                return text, gain
            text, gain = found[0], gain + found[1]


def unreferenced(text: str) -> str:
    """References, by number or name, to characters outside ASCII resolved."""

    def put(m: re.Match) -> str:
        if m[3]:
            c = html.unescape(m[0])
            return c if len(c) == 1 and ord(c) >= 0x80 else m[0]
        o = int(m[1], 16) if m[1] else int(m[2])
        return chr(o) if 0x80 <= o <= 0x10FFFF and not 0xD800 <= o <= 0xDFFF else m[0]

    return _REF.sub(put, text) if "&" in text else text


def _mentioned(text: str, a: int, b: int) -> bool:
    """Whether a run stands, with at most a few letters, inside straight quotes or backticks: text about such signs."""
    while a > 0 and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    return 0 < a and b < len(text) and b - a <= 24 and text[a - 1] in _QUOTES and text[b] == text[a - 1]


def restore(text: str, channel: Channel) -> tuple[str, bool, int]:
    """Restored text, whether garbled characters were found, and how many stay lost.

    A text in which something was found is read once more with a lower bar, as its other runs are
    garbled more likely than those of a text chosen at random.
    """
    for m in _CHUNK.finditer(text):
        if not _mentioned(text, m.start(), m.end()) and any(channel.restore_run(run)[1] > 0 for run in _RUN.findall(unreferenced(m[0]))):
            break
    else:
        return text, False, 0
    new = "\n".join(_line(line, channel) for line in text.split("\n"))
    return new, True, new.count(LOST)


def _line(line: str, channel: Channel) -> str:
    """A line with its runs restored, references that are right as they stand kept; with C1 controls also read as bytes of the Japanese table, whichever costs less."""

    def put(m: re.Match) -> str:
        if _mentioned(line, m.start(), m.end()):
            return m[0]
        plain = unreferenced(m[0])
        new = _RUN.sub(lambda r: channel.restore_run(r[0], 1.0)[0], plain)
        return m[0] if new == plain else new

    new, plain = _CHUNK.sub(put, line), unreferenced(line)
    if _C1.search(plain):
        try:
            other = plain.encode("latin-1").decode("cp932")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return new
        if sum(map(channel.cost, other)) < sum(map(channel.cost, unreferenced(new))):
            return other
    return new


#: Runs outside ASCII without white space and quotes: a letter of one table may be a sign in another.
_FOREIGN = re.compile("[^\\x00-\\x7f\\s\u00ab\u00bb\u201e\u201c\u201d\u2014\u2013\u2026]{2,}")


def other_words(text: str) -> dict[tuple[int, str, str], int]:
    """Words wholly outside ASCII with what they would be under another pair of tables, in lower case, and their counts."""
    out: dict[tuple[int, str, str], int] = {}
    for w in _FOREIGN.findall(text):
        for k, (true, taken) in enumerate(SINGLE):
            try:
                meant = w.encode(taken).decode(true)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if meant.isalpha():
                key = (k, w.lower(), meant.lower())
                out[key] = out.get(key, 0) + 1
    return out


def character_counts(docs: DataFrame) -> dict[str, int]:
    """How often each character outside ASCII occurs in the corpus: at most as many rows as Unicode has characters."""
    chars = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("c"))
    return {r["c"]: r["n"] for r in chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: words with a letter outside ASCII, in lower case, over the whole corpus."""
    words = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text, restored, found, lost, others(pair, word, meant, n)`` of the documents with anything to look at; written."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    shipped = docs.sparkSession.sparkContext.broadcast(character_counts(docs))
    kind = pa.list_(pa.struct([("pair", pa.int32()), ("word", pa.string()), ("meant", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shipped.value)
        names = ["doc_id", "text", "restored", "found", "lost", "others"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), kind]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                restored, found, lost = restore(text, channel)
                others = [] if found and not lost and restored.isascii() else [dict(pair=k, word=w, meant=m, n=n) for (k, w, m), n in other_words(restored).items()]
                if found or others:
                    for col, v in zip(rows, (doc_id, text, restored, found, lost, others), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

    schema = "doc_id bigint, text string, restored string, found boolean, lost int, others array<struct<pair: int, word: string, meant: string, n: int>>"
    return written(spread(docs.where(F.col("text").rlike(_SUSPECT))).mapInArrow(run, schema), "scanned")


def other_tables(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, pair, words``: documents read with another single-byte table, and which of their words, by the corpus frequencies."""
    pairs = scanned.select("doc_id", F.inline("others"))
    # one row per distinct word pair before the joins: a word of a million documents is looked up once
    distinct = pairs.select("word", "meant").distinct()
    f = words.select(F.col("word").alias("meant"), F.col("n").alias("f_meant"))
    g = words.select("word", F.col("n").alias("f_word"))
    gains = distinct.join(f, "meant", "left").join(g, "word", "left").select(
        "word", "meant", F.log((F.coalesce("f_meant", F.lit(0)) + 0.1) / (F.coalesce("f_word", F.lit(0)) + 0.1)).alias("gain")
    )
    # only a passage may be garbled, so words that are right as they stand don't count against it
    better = pairs.join(gains.where(F.col("gain") > 0), ["word", "meant"])
    sums = better.groupBy("doc_id", "pair").agg(F.sum("gain").alias("gain"), F.collect_list("word").alias("words"))
    best = sums.where((F.col("gain") >= LEAST_WORD_GAIN) & (F.size("words") >= 2)).groupBy("doc_id").agg(F.max(F.struct("gain", (-F.col("pair")).alias("k"), "words")).alias("b"))
    return best.select("doc_id", (-F.col("b.k")).alias("pair"), "b.words")


def garbled(docs: DataFrame) -> DataFrame:
    """``doc_id`` of every document whose text shows wrongly read characters, each once.

    Found are sequences that are UTF-8 under another table (once or more, also as character references),
    characters lost to U+FFFD, C1 controls, and words of another single-byte table. Runs inside straight
    quotes or backticks are text about such signs and no case. Null and empty texts are no cases.
    """
    scanned = scan(docs)
    return scanned.where("found").select("doc_id").union(other_tables(scanned, word_counts(docs)).select("doc_id")).distinct()


def repaired(docs: DataFrame) -> DataFrame:
    """``doc_id, restored, still_lost``: the original text of every garbled document as far as it can be had."""
    words = written(word_counts(docs), "words")
    scanned = scan(docs)
    tables = other_tables(scanned, words)
    cases = scanned.join(tables, "doc_id", "left").where(F.col("found") | F.col("pair").isNotNull()).select("doc_id", "restored", "pair", F.col("words").alias("wrong"))
    # words that lost characters, filled from the most frequent corpus word of the same pattern
    hole = r"[\p{L}\p{M}�]*�[\p{L}\p{M}�]*"
    holes = cases.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("restored", F.lit(hole), F.lit(0)))).alias("hole")).where(F.col("hole").rlike(r"\p{L}"))
    # joined on length and the longest known piece of up to three letters with its place: a word has at most
    # three such keys a letter, and no key stands for a script as a whole
    piece = lambda w, p, k: F.struct(F.length(w).alias("size"), p.alias("at"), F.substring(w, p, k).alias("letters"))
    pieces = lambda k: F.transform(places, lambda p: piece(F.col("word"), p, F.lit(k)))
    places = F.sequence(F.lit(1), F.length("word"))
    sound = words.where(~F.col("word").contains(LOST) & (F.length("word") > 0))
    keyed = sound.select("word", "n", F.explode(F.array_distinct(F.concat(*[pieces(k) for k in (1, 2, 3)]))).alias("key"))
    low = F.lower("hole")
    known = F.transform(F.sequence(F.lit(1), F.length(low)), lambda p: F.struct(F.length(F.regexp_extract(F.substring(low, p, F.lit(3)), f"^[^{LOST}]*", 0)).alias("k"), (-p).alias("minus")))
    most = F.array_max(known)
    patterns = holes.select("hole").distinct().withColumn("key", piece(low, -most["minus"], most["k"]))
    fits = patterns.join(keyed, "key").where(F.expr(f"word like replace(lower(hole), '{LOST}', '_')"))
    best = fits.groupBy("hole").agg(F.max(F.struct("n", "word"))["word"].alias("word"))
    fills = holes.join(best, "hole").groupBy("doc_id").agg(F.collect_list(F.struct("hole", "word")).alias("fills"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_id, text, pair, wrong, fill in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if pair is not None:
                    true, taken = SINGLE[pair]

                    def put(m: re.Match, true=true, taken=taken, wrong=frozenset(wrong)) -> str:
                        return m[0].encode(taken).decode(true) if m[0].lower() in wrong else m[0]

                    text = _FOREIGN.sub(put, text)
                for f in sorted(fill or [], key=lambda f: -len(f["hole"])):
                    word = f["word"]
                    if f["hole"][0] == LOST and f["hole"][1:].isupper() or f["hole"].replace(LOST, "").isupper() and len(word) > 2:
                        word = word.upper()
                    elif f["hole"][0].isupper():
                        word = word[0].upper() + word[1:]
                    text = text.replace(f["hole"], word)
                for col, v in zip(out, (doc_id, text, text.count(LOST)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["doc_id", "restored", "still_lost"])

    return cases.join(fills, "doc_id", "left").select("doc_id", "restored", "pair", "wrong", "fills").mapInArrow(run, "doc_id bigint, restored string, still_lost int")
