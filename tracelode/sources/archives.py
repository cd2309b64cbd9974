"""Zipped trajectory archives and their conversion to trace events."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: step numbering of converted trajectories
STEP_SCALE, PRE_OFFSET, POST_OFFSET = 10_000, -1_000, 1_000
FAMILIES = ("claudecode", "iflow")
_MEMBER = re.compile(r"(^|/)trajectory_[^/]*\.jsonl$")


def _ignorable(name: str) -> bool:
    return "__MACOSX" in name or name.rsplit("/", 1)[-1].startswith("._") or name.endswith("/")


def member_class(name: str) -> str:
    low = name.lower()
    for kind, pattern in (("trajectory", r"trajectory"), ("label", r"label|score|judg"), ("metadata", r"dataset|meta"), ("readme", r"readme|\.md$")):
        if re.search(pattern, low):
            return kind
    return "other"


def members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, size, member_class``: what zip files contain, ignorable entries left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i.filename, i.file_size, member_class(i.filename)) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in zipfile.ZipFile(io.BytesIO(c)).infolist() if not _ignorable(i.filename)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["archive", "member", "size", "member_class"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, "archive string, member string, size long, member_class string")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, line_no, record``: one row per line of the trajectory members, undecodable bytes replaced. A task streams one archive at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = zipfile.ZipFile(io.BytesIO(c))
                for name in sorted(n for n in z.namelist() if _MEMBER.search(n) and not _ignorable(n)):
                    lines = [(k, x.strip()) for k, x in enumerate(z.read(name).decode("utf-8", "replace").split("\n"), 1) if x.strip()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(lines)), pa.array([name] * len(lines)), pa.array([k for k, _ in lines], pa.int64()), pa.array([x for _, x in lines], pa.string())], ["archive", "member", "line_no", "record"]
                    )

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, "archive string, member string, line_no long, record string")


def _step(*options: object, default: int) -> int:
    """The first option that counts as present, as a whole number; ``default`` if it is none. Zero and empty count as missing."""
    v = next((v for v in options if v), None)
    try:
        return int(v)
    except (TypeError, ValueError, OverflowError):
        return default


def _sequence(v: object, default: int) -> int:
    """All digits of a sequence label as one number."""
    digits = "".join(c for c in str(v or "") if c.isdigit())
    return int(digits) if digits else default


def _say(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)


def convert(record: dict, source: str, family: str, collection: str = "trajectories") -> list[dict]:
    """Events of one trajectory: turns as checkpoints, tool calls as pre_step and post_step, and a closing final. ``collection`` begins the episode ids."""
    task = record.get("id") or record.get("instance_id") or record.get("original_id")
    stem = re.sub(r"\.[^.]*$", "", source.replace("\\", "/").rsplit("/", 1)[-1])
    episode = f"{collection}:{family}:{stem}:{record.get('category') or record.get('risk_category') or 'unknown'}:{task}"
    ask = record.get("query") or ""
    out: list[dict] = []

    base_notes = {"source": family, "category": record.get("category") or record.get("risk_category"), "original_id": task}

    def put(step: int, hook: str, kind: str, seen_in: dict, *names: str, **more: object) -> None:
        notes = base_notes | {"event_kind": kind} | {n: seen_in.get(n) for n in names}
        out.append(
            {"episode_id": episode, "step_id": step, "hook_type": hook, "user_instruction": ask, "plan_summary": None, "proposed_tool": None, "tool_args": "{}", "observation": None}
            | more
            | {"notes": json.dumps(notes, ensure_ascii=False, sort_keys=True)}
        )

    logs = record.get("detail_logs")
    if isinstance(logs, list):
        seen: Counter = Counter()
        for k, log in enumerate(logs, 1):
            kind = str(log.get("type") or "") if isinstance(log, dict) else ""
            if kind in ("pre_tool", "post_tool"):
                base = _sequence(log.get("sequence"), k)
                seen[base, kind] += 1
                args = log.get("tool_input") if isinstance(log.get("tool_input"), dict) else {}
                pre = kind == "pre_tool"
                put(base * STEP_SCALE + (PRE_OFFSET if pre else POST_OFFSET) + seen[base, kind], "pre_step" if pre else "post_step", kind, log, "tool_use_id", "session_id", "cwd", "permission_mode", "timestamp", proposed_tool=_say(log.get("tool_name")), tool_args=json.dumps(args, sort_keys=True), observation=None if pre else _say(log.get("tool_response")))
    elif isinstance(logs, dict):
        seen = Counter()
        calls = logs.get("tool_calls") or []
        for k, call in enumerate(calls if isinstance(calls, list) else [], 1):
            if isinstance(call, dict):
                first = lambda *names, c=call: next((c[n] for n in names if c.get(n)), None)
                base = _step(call.get("turn_idx"), call.get("step"), call.get("step_id"), default=k)
                seen[base] += 1
                args = first("tool_input", "arguments", "args", "input")
                put(base * STEP_SCALE + PRE_OFFSET + seen[base], "pre_step", "iflow_tool_call", call, "timestamp", proposed_tool=_say(first("tool_name", "name", "tool")), tool_args=json.dumps(args if isinstance(args, dict) else {}, sort_keys=True), observation=_say(first("tool_response", "response", "result", "output")))
    turns = record.get("turns") or []
    for k, turn in enumerate(turns if isinstance(turns, list) else [], 1):
        if isinstance(turn, dict):
            put(_step(turn.get("turn_idx"), turn.get("step_id"), turn.get("step"), default=k) * STEP_SCALE, "checkpoint", "turn", turn, "turn_idx", "start_time", "end_time", plan_summary=_say(turn.get("input")), observation=_say(turn.get("output")))
    put(max((e["step_id"] for e in out), default=0) + STEP_SCALE, "final", "final", {})
    order = {"pre_step": 0, "checkpoint": 1, "post_step": 2, "final": 3}
    return sorted(out, key=lambda e: (e["step_id"], order[e["hook_type"]]))


def trajectory_events(rows: DataFrame, collection: str = "trajectories") -> DataFrame:
    """Trace events of ``trajectories``; lines that are no JSON object give none."""
    fields = ("episode_id", "step_id", "hook_type", "user_instruction", "plan_summary", "proposed_tool", "tool_args", "observation", "notes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for archive, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    r = json.loads(record)
                except ValueError:
                    continue
                family = next((f for f in FAMILIES if f"/{f}/" in archive.lower().replace("\\", "/")), FAMILIES[1] if isinstance(r, dict) and isinstance(r.get("detail_logs"), dict) else FAMILIES[0])
                if isinstance(r, dict):
                    out += convert(r, archive, family, collection)
            yield pa.RecordBatch.from_arrays([pa.array([e[f] for e in out], pa.int64() if f == "step_id" else pa.string()) for f in fields], list(fields))

    return rows.select("archive", "record").mapInArrow(run, ", ".join(f"{f} {'long' if f == 'step_id' else 'string'}" for f in fields))


def key_inventory(records: DataFrame, column: str = "record") -> DataFrame:
    """``key, n``: keys of JSON objects and, dotted, of the objects in them, for unknown layouts; read from the merged schema of all rows."""
    v = records.select(F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull())
    top = v.select(F.explode(F.json_object_keys(F.to_json("v"))).alias("key"), "v")
    nested = top.select(F.col("key"), F.call_function("get_json_object", F.to_json("v"), F.concat(F.lit("$['"), F.col("key"), F.lit("']"))).alias("t"))
    deeper = nested.where(F.substring("t", 1, 1) == "{").select(F.col("key").alias("a"), F.explode(F.json_object_keys("t")).alias("b")).select(F.concat_ws(".", "a", "b").alias("key"))
    return top.select("key").unionByName(deeper).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
