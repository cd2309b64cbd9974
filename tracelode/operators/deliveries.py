"""Messages delivered more than once: a store with an identifier index that keeps one copy of each.

A message is identified by episode, step, hook kind and the instant its timestamp denotes. The store
is partitioned by the time of arrival, so where a message lies does not follow from what it is: the
index says so. It holds the hash of each identifier and the partition of its stored copy, laid out by
the span of the message's own instant and a prefix of the hash, so that a load reads no more of it than
its identifiers can be in. A load

1. looks its identifiers up in the index to learn which historical partitions hold one of them,
2. reads those partitions only, combines them with the incoming rows and recomputes the single winner
   of each identifier (combined before the shuffle, so that a message delivered a billion times leaves
   each map task once),
3. writes the affected partitions anew and the new ones beside them, under names of its own, and
   commits all of it by creating the next manifest, which succeeds for one writer only. Readers see the
   old or the new state, never a mixture; a load that dies or loses the race leaves the state untouched.

A load that lost the race starts over from the new state. Rows that lost are kept once each in the
store's log of removed rows, however often they are delivered.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.readings import is_blank, micros, read_hook, read_instant

ID = ("episode_id", "step_id", "hook", "at")
_DAY_MICROS = 86_400_000_000
_COLUMNS = "episode_id string, step_id bigint, hook string, at bigint, arrived bigint, ingest_id bigint"
#: Bounds of a rank: years 1 to 9999 in microseconds lie within, rows without arrival come after all.
_EARLIEST, _UNDATED, _ID_SPAN = 10**17, 9 * 10**17, 10**20


class LostRaceError(RuntimeError):
    """Another load committed the same version first."""


def identified(events: DataFrame) -> DataFrame:
    """``episode_id, step_id, hook, at, arrived, ingest_id`` of every row whose four identifying fields are all readable.

    ``arrived`` is ``ingested_at`` in microseconds, null if unknown. Rows without ``ingest_id`` cannot be
    named and are left out. Other columns are dropped.
    """
    hook = read_hook(F.col("hook_type"))
    at = read_instant(F.col("timestamp"))
    rows = events.where(~is_blank(F.col("episode_id")) & F.col("step_id").isNotNull() & F.col("ingest_id").isNotNull()).select(
        "episode_id",
        F.col("step_id").cast("long").alias("step_id"),
        hook.alias("hook"),
        at.alias("at"),
        micros(events, "ingested_at").alias("arrived"),
        F.col("ingest_id").cast("long").alias("ingest_id"),
    )
    return rows.where(F.col("hook").isNotNull() & F.col("at").isNotNull())


def _rank() -> Column:
    """Arrival and id as one number, so that the winner is a plain minimum that a hash aggregation can keep."""
    when = F.coalesce(F.col("arrived") + F.lit(_EARLIEST), F.lit(_UNDATED)).cast("decimal(18,0)")
    named = F.col("ingest_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    return (when * F.lit(str(_ID_SPAN)).cast("decimal(21,0)") + named).cast("decimal(38,0)")


def _arrived(rank: str) -> Column:
    when = F.expr(f"`{rank}` div cast('{_ID_SPAN}' as decimal(21,0))")
    return F.when(when < _UNDATED, when - _EARLIEST)


def _ingest_id(rank: str) -> Column:
    return (F.expr(f"`{rank}` % cast('{_ID_SPAN}' as decimal(21,0))").cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def winners(rows: DataFrame) -> DataFrame:
    """The one copy of each identifier that stays: earliest arrival (unknown: last), on a tie the smallest ``ingest_id``."""
    return rows.groupBy(*ID).agg(F.min(_rank()).alias("rank")).select(*ID, _arrived("rank").alias("arrived"), _ingest_id("rank").alias("ingest_id"))


def keep_one(events: DataFrame) -> DataFrame:
    """``events`` without its superfluous deliveries; rows that are no case stay."""
    rows = identified(events)
    lost = rows.select("ingest_id").join(winners(rows).select("ingest_id"), "ingest_id", "left_anti")
    return events.join(lost, "ingest_id", "left_anti")


class DeliveryStore:
    """Deduplicated messages below ``root``: ``data/``, ``index/`` and ``removed/`` with one folder per load, and ``manifest/``."""

    def __init__(self, spark: SparkSession, root: str, span_days: int = 28, prefixes: int = 16):
        self.spark, self.root, self.span_days, self.prefixes = spark, root.rstrip("/"), span_days, prefixes

    # -- manifest ---------------------------------------------------------------------------------
    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> dict:
        """The newest committed manifest; an empty one if nothing was loaded yet."""
        fs, path = self._fs()
        folder = path(f"{self.root}/manifest")
        none = {"version": 0, "parts": {}, "loads": []}
        if not fs.exists(folder):
            return none
        names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json") and not n.startswith("."))
        if not names:
            return none
        stream = fs.open(path(f"{self.root}/manifest/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Creates the manifest of its version, or raises if there is one.

        A hard link (local folders) and a rename that may not overwrite (HDFS) fail atomically where the
        name exists. Other stores get one write without leave to overwrite, which those with conditional
        writes refuse to the second writer.
        """
        fs, path = self._fs()
        final = f"{self.root}/manifest/{manifest['version']:08d}.json"
        draft = f"{self.root}/manifest/.draft-{uuid.uuid4().hex}.json"
        scheme = fs.getUri().getScheme()
        lost = LostRaceError(f"another load committed version {manifest['version']} first")
        body = bytearray(json.dumps(manifest).encode())

        def put(at: str) -> None:
            out = fs.create(path(at), False)
            out.write(body)
            out.close()

        if fs.exists(path(final)):
            raise lost
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                put(final)
            except Exception as e:
                raise lost from e
            return
        put(draft)
        try:
            if scheme == "file":
                os.link(urlparse(draft).path, urlparse(final).path)
            else:
                jvm = self.spark._jvm
                keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(path(draft), path(final), keep)
        except Exception as e:
            if not fs.exists(path(final)):
                raise
            raise lost from e
        finally:
            fs.delete(path(draft), False)

    # -- reading ----------------------------------------------------------------------------------
    def _read(self, kind: str, loads: list[str], schema: str) -> DataFrame:
        """The index or the log of several loads; partition columns in the schema are read from the folders' names."""
        if not loads:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{kind}"
        return self.spark.read.schema(f"{schema}, load string").option("basePath", base).parquet(*[f"{base}/load={x}" for x in loads]).drop("load")

    def current(self) -> DataFrame | None:
        """The messages that stay, all partitions; null before the first load."""
        paths = [p for ps in self.manifest()["parts"].values() for p in ps]
        return self.spark.read.schema(_COLUMNS).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else None

    def removed(self) -> DataFrame:
        """``ingest_id`` of every row that lost, over all loads, each once."""
        return self._read("removed", self.manifest()["loads"], "ingest_id long, span int").select("ingest_id")

    # -- loading ----------------------------------------------------------------------------------
    def load(self, events: DataFrame) -> None:
        """Merge incoming rows. An empty load commits an unchanged state."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        identified(events).write.parquet(staged)
        try:
            self.load_identified(self.spark.read.schema(_COLUMNS).parquet(staged))
        finally:
            self._drop(staged)

    def load_identified(self, rows: DataFrame, attempts: int = 5) -> None:
        """Merge rows as ``identified`` gives them; they are read several times and should be a written table."""
        for left in reversed(range(attempts)):
            manifest = self._merge(self.manifest(), rows)
            try:
                return self._commit(manifest)
            except LostRaceError:
                for kind in ("data", "index", "removed"):
                    self._drop(f"{self.root}/{kind}/load={manifest['loads'][-1]}")
                if not left:
                    raise

    def _drop(self, at: str) -> None:
        fs, path = self._fs()
        fs.delete(path(at), True)

    def _span(self, c: Column) -> Column:
        return F.floor(c / (_DAY_MICROS * self.span_days)).cast("int")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*ID)
        return rows.withColumns({"span": self._span(F.col("at")), "prefix": F.pmod(h, F.lit(self.prefixes)).cast("int"), "id_hash": h})

    def _affected(self, old: dict, rows: DataFrame) -> tuple[list[int], list[int]]:
        """Spans of the incoming messages, and the historical partitions that hold one of their identifiers."""
        keyed = self._keyed(rows).select("span", "prefix", "id_hash")
        # spans of the calendar times prefixes bound what comes to the driver
        places = keyed.select("span", "prefix").distinct().collect()
        spans = sorted({r["span"] for r in places})
        index = self._read("index", old["loads"], "id_hash long, part int, span int, prefix int")
        index = index.where(F.col("span").isin(spans) & F.col("prefix").isin(sorted({r["prefix"] for r in places})))
        hit = index.join(keyed.hint("merge"), ["span", "prefix", "id_hash"], "left_semi").select("part").distinct()
        return spans, sorted(r["part"] for r in hit.collect())

    def _merge(self, old: dict, rows: DataFrame) -> dict:
        """Writes what a load adds and rewrites under a name that no other load has, and gives the manifest to commit."""
        name = uuid.uuid4().hex
        at = lambda kind: f"{self.root}/{kind}/load={name}"
        spans, affected = self._affected(old, rows) if old["loads"] else ([], [])
        new = rows.select(*ID, "arrived", "ingest_id", F.lit(None).cast("int").alias("part"))
        before = [q for p in affected for q in old["parts"][str(p)]]
        if before:
            new = new.unionByName(self.spark.read.schema(f"{_COLUMNS}, part int").parquet(*[f"{self.root}/{p}" for p in before]))
        stored = F.col("part").isNotNull()
        stay = new.groupBy(*ID).agg(F.min(_rank()).alias("rank"), F.max("part").alias("old_part"), F.max(F.when(stored, F.col("ingest_id"))).alias("was"))
        stay = stay.select(*ID, _arrived("rank").alias("arrived"), _ingest_id("rank").alias("ingest_id"), "old_part", "was")
        # a stored message stays in its partition, so that the index holds; a new one goes by its arrival
        part = F.coalesce("old_part", self._span(F.col("arrived")), F.lit(-1))
        stay = stay.select(*ID, "arrived", "ingest_id", part.alias("part"), "was", F.col("old_part").isNull().alias("fresh"), part.alias("dir"))
        # rebalance: a partition that holds a third of all messages is split over several files
        stay.hint("rebalance", "dir").write.partitionBy("dir").parquet(at("data"))
        data = self.spark.read.schema(f"{_COLUMNS}, part int, was bigint, fresh boolean").parquet(at("data"))

        fresh = self._keyed(data.where("fresh")).select("id_hash", "part", "span", "prefix")
        fresh.hint("rebalance", "span", "prefix").write.partitionBy("span", "prefix").parquet(at("index"))
        lost = rows.select("ingest_id", "at").join(data.select("ingest_id").hint("merge"), "ingest_id", "left_anti")
        lost = lost.unionByName(data.where(F.col("was") != F.col("ingest_id")).select(F.col("was").alias("ingest_id"), "at"))
        lost = lost.select("ingest_id", self._span(F.col("at")).alias("span")).distinct()
        if old["loads"]:
            logged = self._read("removed", old["loads"], "ingest_id long, span int").where(F.col("span").isin(spans))
            lost = lost.join(logged.hint("merge"), ["span", "ingest_id"], "left_anti")
        lost.hint("rebalance", "span").write.partitionBy("span").parquet(at("removed"))

        fs, path = self._fs()
        parts = dict(old["parts"])
        for folder in (s.getPath().getName() for s in fs.listStatus(path(at("data"))) if s.isDirectory()):
            p, here = folder.removeprefix("dir="), f"data/load={name}/{folder}"
            parts[p] = [here] if int(p) in affected else [*parts.get(p, []), here]
        return {"version": old["version"] + 1, "parts": parts, "loads": [*old["loads"], name]}
