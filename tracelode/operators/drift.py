"""Schemas that drift between files: ingestion with a rescue column, promotion, and a report of each change.

``ingest`` enforces a target schema on raw lines. What the target does not know, or what does not fit
its type, is preserved as JSON in ``rescued`` together with the flat list of its leaves. ``changes``
compares each file with the one before it in its feed on those leaves. ``promote`` replays rescued
values of approved fields into typed columns, under whatever name a file had them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import spread, written

#: Target schema: the fields every event has. The rest is rescued.
TARGET = {"episode_id": "string", "step_id": "bigint", "hook_type": "string", "severity": "double"}
ROOTS = ("tool_args", "notes")
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


class _Integer(str):
    """A JSON number without fraction, as written."""

    __slots__ = ()


class _Real(str):
    """Any other JSON number, as written."""

    __slots__ = ()


_HOOKS = dict(parse_int=_Integer, parse_float=_Real, parse_constant=_Real)
_quoted = json.encoder.encode_basestring
_KINDS = {_Integer: "integer", _Real: "number", bool: "boolean", list: "array"}


def _json(v: object) -> str:
    kind = type(v)
    if kind is str:
        return _quoted(v)
    if kind is _Integer or kind is _Real:
        return str(v)
    if kind is dict:
        return "{" + ", ".join([f"{json.dumps(k)}: {_json(v[k])}" for k in sorted(v)]) + "}"
    if kind is list:
        return "[" + ", ".join([_json(x) for x in v]) + "]"
    return "null" if v is None else "true" if v else "false"


def _as_object(text: str) -> dict | None:
    """The object that a text keeps as JSON, if it is one."""
    if text.lstrip()[:1] != "{":
        return None
    try:
        o = json.loads(text.strip(), **_HOOKS)
    except (ValueError, RecursionError):
        return None
    return o if type(o) is dict else None


def leaves(name: str, value: object) -> list[tuple[str, str, str | None]]:
    """``path, type, text`` of a root field and of the leaves below it. A null is no field, an array is a leaf."""
    out: list[tuple[str, str, str | None]] = []
    todo = [(name, value, True)]
    while todo:
        path, v, top = todo.pop()
        kind = type(v)
        inner = v if kind is dict else _as_object(v) if kind is str and "{" in v else None
        if inner is not None:
            if top:
                out.append((path, "object" if kind is dict else "string", None))
            todo.extend([(f"{path}.{k}", x, False) for k, x in inner.items() if x is not None])
        elif kind is str:
            out.append((path, "string", v))
        elif v is not None:
            out.append((path, _KINDS[kind], _json(v)))
    return out


def _fit(v: object, kind: str) -> tuple[bool, object]:
    """Whether a value fits a type of the target, and the value in it."""
    try:
        if v is None:
            return True, None
        if kind == "string":
            return type(v) is str, str(v)
        if kind == "boolean":
            return type(v) is bool, v
        if not isinstance(v, str):
            return False, None
        if kind == "bigint":
            n = int(v)
            return -(2**63) <= n < 2**63, n
        return True, float(v)
    except ValueError:
        return False, None


def ingest(lines: DataFrame, target: dict[str, str] | None = None, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """``line_id, feed, file_no, line_no, readable``, the target's columns, ``rescued`` (JSON) and ``leaves``.

    Every line gives one row. Lines that are no JSON object (truncated, blank, foreign, null) are not
    readable: the target's columns are null and ``rescued`` has the raw line as a JSON string.
    """
    target = dict(TARGET if target is None else target)
    keep = ("line_id", "feed", "file_no", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = json.JSONDecoder(**_HOOKS).decode
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("readable", *target, "rescued")}
            found: list[tuple[str, str, str | None]] = []
            ends = [0]
            for raw in batch.column(batch.schema.get_field_index("raw_line")).to_pylist():
                try:
                    o = decode(raw.strip()) if raw else None
                except (ValueError, RecursionError):
                    o = None
                ok = isinstance(o, dict)
                cols["readable"].append(ok)
                rest = dict(o) if ok else {}
                for c, kind in target.items():
                    fits, v = _fit(rest.get(c), kind)
                    cols[c].append(v if fits and ok else None)
                    if fits:
                        rest.pop(c, None)
                cols["rescued"].append(_json(rest) if ok else None if raw is None else json.dumps(raw, ensure_ascii=False))
                for r in roots:
                    found.extend(leaves(r, rest.get(r)))
                ends.append(len(found))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            kinds = [pa.bool_(), *[_ARROW[k] for k in target.values()], pa.string()]
            parts = [pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else ([], [], []))]
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["path", "kind", "value"]))
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], flat], [*keep, *cols, "leaves"])

    columns = ", ".join(f"`{c}` {k}" for c, k in target.items())
    schema = f"line_id bigint, feed string, file_no bigint, line_no bigint, readable boolean, {columns}, rescued string, leaves array<struct<path: string, kind: string, value: string>>"
    return spread(lines.select(*[F.col(c).cast("string" if c == "feed" else "bigint").alias(c) for c in keep], "raw_line")).mapInArrow(run, schema)


def changes(ingested: DataFrame, agree: float = 0.9) -> DataFrame:
    """``feed, file_no, change_kind, field_path, detail``: every change of a file against the one before it in its feed.

    ``ingested`` is read several times and should be a written table. A path's type in a file is that of
    most of its lines (ties: the first by name). A path gone is ``renamed`` to the new path that holds
    the same text in at least ``agree`` of the events found in both files that had the old one; a path
    takes part in one renaming only, the best first. Events are joined for gone and new paths alone.
    Lines without feed or file number are in no file; the first file of a feed changes nothing.
    """
    ingested = ingested.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull())
    per_feed = Window.partitionBy("feed").orderBy("file_no")
    files = ingested.select("feed", "file_no").distinct().withColumn("prev", F.lag("file_no").over(per_feed))
    pairs = files.where(F.col("prev").isNotNull())
    flat = ingested.where("readable").select("feed", "file_no", "episode_id", "step_id", F.inline("leaves"))
    typed = flat.groupBy("feed", "file_no", "path", "kind").agg(F.count(F.lit(1)).alias("n"))
    by_rank = F.max(F.struct("n", F.transform(F.split(F.col("kind"), ""), lambda c: -F.ascii(c)).alias("r"), "kind"))["kind"].alias("kind")
    present = written(typed.groupBy("feed", "file_no", "path").agg(by_rank), "paths")
    old = present.join(pairs.select("feed", F.col("prev").alias("file_no"), F.col("file_no").alias("at")), ["feed", "file_no"]).select(
        "feed", F.col("at").alias("file_no"), F.col("file_no").alias("prev"), "path", F.col("kind").alias("old_kind")
    )
    now = present.join(pairs, ["feed", "file_no"])
    both = written(old.drop("prev").join(now.drop("prev"), ["feed", "file_no", "path"], "full_outer").join(pairs, ["feed", "file_no"]), "path-changes")
    gone = both.where(F.col("kind").isNull()).select("feed", "file_no", "prev", F.col("path").alias("old"))
    new = both.where(F.col("old_kind").isNull()).select("feed", "file_no", "prev", F.col("path").alias("new"))

    event = ["episode_id", "step_id"]
    keyed = flat.where(F.col("value").isNotNull() & F.col("episode_id").isNotNull() & F.col("step_id").isNotNull())
    found = ingested.where(F.col("readable") & F.col("episode_id").isNotNull() & F.col("step_id").isNotNull()).select("feed", "file_no", *event).distinct()
    was = (
        gone.withColumnRenamed("file_no", "at")
        .join(keyed.select("feed", F.col("file_no").alias("prev"), *event, F.col("path").alias("old"), "value"), ["feed", "prev", "old"])
        .select("feed", F.col("at").alias("file_no"), "old", *event, "value")
        .distinct()
        .join(found, ["feed", "file_no", *event], "left_semi")
    )
    was = written(was, "gone-values")
    has = new.join(keyed.withColumnRenamed("path", "new"), ["feed", "file_no", "new"]).select("feed", "file_no", "new", *event, "value").distinct()
    had = was.select("feed", "file_no", "old", *event).distinct().groupBy("feed", "file_no", "old").agg(F.count(F.lit(1)).alias("had"))
    same = (
        was.join(has, ["feed", "file_no", *event, "value"])
        .select("feed", "file_no", "old", "new", *event)
        .distinct()
        .groupBy("feed", "file_no", "old", "new")
        .agg(F.count(F.lit(1)).alias("same"))
    )
    ratio = F.col("same") / F.col("had")
    fits = same.join(had, ["feed", "file_no", "old"]).where(ratio >= agree).select("feed", "file_no", "old", "new", ratio.alias("ratio"))
    # the candidates of one file, at most its gone paths times its new ones, stand together and in order
    ordered = fits.repartition("feed", "file_no").sortWithinPartitions("feed", "file_no", F.desc("ratio"), "old", "new")
    renamed = written(ordered.mapInArrow(_pair_off, "feed string, file_no bigint, old string, new string"), "renamed")

    lit = lambda k: F.lit(k).alias("change_kind")
    empty = F.lit("").alias("detail")
    keys = ["feed", "file_no"]
    rename_rows = renamed.select(*keys, lit("renamed"), F.col("old").alias("field_path"), F.col("new").alias("detail"))
    removed = gone.join(renamed.select(*keys, "old"), [*keys, "old"], "left_anti").select(*keys, lit("removed"), F.col("old").alias("field_path"), empty)
    added = new.join(renamed.select(*keys, "new"), [*keys, "new"], "left_anti").select(*keys, lit("added"), F.col("new").alias("field_path"), empty)
    stayed = both.where(F.col("kind") != F.col("old_kind")).select(*keys, F.col("path").alias("field_path"), F.col("kind").alias("detail"))
    moved = (
        renamed.join(old.select(*keys, F.col("path").alias("old"), "old_kind"), [*keys, "old"])
        .join(now.select(*keys, F.col("path").alias("new"), "kind"), [*keys, "new"])
        .where(F.col("kind") != F.col("old_kind"))
        .select(*keys, F.col("new").alias("field_path"), F.col("kind").alias("detail"))
    )
    retyped = stayed.unionByName(moved).select(*keys, lit("retyped"), "field_path", "detail")
    return rename_rows.unionByName(removed).unionByName(added).unionByName(retyped)


def _pair_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the candidates of each file, best first, those whose paths are both still free."""
    file, old, new = None, set(), set()
    for batch in batches:
        rows = []
        for feed, no, a, b, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (feed, no) != file:
                file, old, new = (feed, no), set(), set()
            if a not in old and b not in new:
                old.add(a)
                new.add(b)
                rows.append((feed, no, a, b))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["feed", "file_no", "old", "new"])


def canonical_names(ingested: DataFrame, report: DataFrame) -> DataFrame:
    """``feed, file_no, path, canonical`` of every path that goes by another name in a file than its first one in the feed.

    A name holds until the path is renamed again or gone, so the same path can mean different fields in
    different files. A path added while its name still stands for a renamed field is a field of its own,
    ``name~2`` and so on. One group per feed: its files and its renamings, additions and removals.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, str] = {}
        rows = []
        for (feed, file_no), part in pdf.sort_values("file_no").groupby(["feed", "file_no"], sort=True):
            of = lambda k: part[part["change_kind"] == k].sort_values("field_path").itertuples()  # noqa: B023, E731
            step = {r.detail: names.pop(r.field_path, r.field_path) for r in of("renamed")}
            for r in of("removed"):
                names.pop(r.field_path, None)
            names.update(step)
            for r in of("added"):
                taken, n, name = set(names.values()), 1, r.field_path
                while name in taken:
                    n += 1
                    name = f"{r.field_path}~{n}"
                if n > 1:
                    names[r.field_path] = name
            rows += [(feed, file_no, p, c) for p, c in names.items() if p != c]
        return pd.DataFrame(rows, columns=["feed", "file_no", "path", "canonical"])

    few = report.where(F.col("change_kind").isin("renamed", "removed", "added")).select("feed", "file_no", "change_kind", "field_path", "detail")
    files = ingested.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).select("feed", "file_no").distinct()
    files = files.select("feed", "file_no", F.lit("file").alias("change_kind"), F.lit("").alias("field_path"), F.lit("").alias("detail"))
    return few.unionByName(files).groupBy("feed").applyInPandas(follow, "feed string, file_no bigint, path string, canonical string")


def _named(ingested: DataFrame, report: DataFrame) -> DataFrame:
    """Readable rows with ``_fields``: canonical path, kind and text of each leaf."""
    names = canonical_names(ingested, report).groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("path", "canonical"))).alias("_names"))
    rows = ingested.where("readable").join(names, ["feed", "file_no"], "left")
    field = lambda x: F.struct(F.coalesce(F.try_element_at("_names", x["path"]), x["path"]).alias("name"), x["kind"].alias("kind"), x["value"].alias("value"))
    fields = F.transform(F.filter("leaves", lambda x: x["value"].isNotNull()), field)
    return rows.select(*[c for c in ingested.columns if c not in ("leaves", "readable")], fields.alias("_fields"))


def _widest(named: DataFrame) -> dict[str, str]:
    """Every canonical path with the narrowest type that holds all its values in all feeds; ``string`` where kinds mix."""
    flat = named.select(F.inline("_fields"))
    whole = F.col("value").try_cast("bigint")
    is_int, is_num = F.col("kind") == "integer", F.col("kind").isin("integer", "number")
    exact = ~is_int | F.coalesce(whole.between(-(2**53), 2**53), F.lit(False))
    kind = (
        F.when(F.min(F.coalesce(is_int & whole.isNotNull(), F.lit(False))), "bigint")
        .when(F.min(is_num & exact), "double")
        .when(F.min(F.col("kind") == "boolean"), "boolean")
        .otherwise("string")
    )
    return {r["name"]: r["type"] for r in flat.groupBy("name").agg(kind.alias("type")).orderBy("name").collect()}


def _columns(paths: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """Column names of paths: ``_`` for other signs than letters and digits, numbered where they would be the same but for case."""
    used, out = {t.lower() for t in taken}, {}
    for path in paths:
        base = name = re.sub(r"\W", "_", path)
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out[path] = name
    return out


def _found(path: str) -> Column:
    """Text of the first field that has the canonical path."""
    return F.get(F.filter("_fields", lambda x: x["name"] == path), F.lit(0))["value"]


def promote(ingested: DataFrame, report: DataFrame, approved: dict[str, str] | None = None) -> DataFrame:
    """One consistent table of all events: the target's columns, one typed column per approved field, and what stays rescued.

    ``approved`` maps canonical paths to types; without it every path of every feed is approved, with the
    type that holds all its values. Columns are named with ``_`` for ``.``. Rescued values are replayed
    with ``try_cast``; what does not fit stays in ``rescued`` alone, which is never changed. A field is
    found under the name it has in that file of its feed.
    """
    rows = written(_named(ingested, report), "named")
    approved = _widest(rows) if approved is None else approved
    known = [c for c in rows.columns if c not in ("_fields", "rescued")]
    columns = [_found(path).try_cast(approved[path]).alias(name) for path, name in _columns(approved, [*known, "rescued"]).items()]
    return rows.select(*known, *columns, "rescued")
