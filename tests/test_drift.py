"""Drifting schemas: leaves, ingestion, every kind of change, promotion; brute force over random feeds."""

import json
import random

from pyspark.sql import functions as F

from tracelode.operators import drift
from tracelode.plans import training_core
from tracelode.session import written

SCHEMA = "line_id long, feed string, file_no long, file_name string, line_no long, raw_line string, written_at timestamp"


def lines(spark, *files, feed="f"):
    rows = []
    for n, file in enumerate(files, 1):
        for k, x in enumerate(file, 1):
            rows.append((len(rows), feed, n, f"{n}.jsonl", k, x if x is None or isinstance(x, str) else json.dumps(x), None))
    return spark.createDataFrame(rows, SCHEMA)


def event(k, **args):
    return {"episode_id": f"e{k}", "step_id": k, "hook_type": "pre_step", "tool_args": args}


def report(spark, *files):
    return {tuple(r) for r in drift.changes(written(drift.ingest(lines(spark, *files)), "t")).drop("feed").collect()}


def test_each_kind_of_change(spark):
    a = [event(k, n=k, gone=1, kept="x", r=k + 0.5) for k in range(10)]
    b = [event(k, renamed=k, kept=["x"], new=None, r=str(k + 0.5)) for k in range(10)]
    got = report(spark, a, b)
    assert got == {(2, "renamed", "tool_args.n", "tool_args.renamed"), (2, "removed", "tool_args.gone", ""), (2, "retyped", "tool_args.kept", "array"), (2, "retyped", "tool_args.r", "string")}


def test_renamed_into_object_as_text_and_retyped(spark):
    a = [event(k, n=k) for k in range(10)]
    b = [dict(event(k), tool_args=json.dumps({"in": {"m": str(k)}})) for k in range(10)]
    assert report(spark, a, b) == {(2, "renamed", "tool_args.n", "tool_args.in.m"), (2, "retyped", "tool_args.in.m", "string"), (2, "retyped", "tool_args", "string")}


def test_nine_tenths_of_common_events(spark):
    a = [event(k, n=k) for k in range(12)]
    shared = [event(k, m=k if k < 9 else -1) for k in range(10)]
    assert (2, "renamed", "tool_args.n", "tool_args.m") in report(spark, a, shared + [event(50, m=1)])
    worse = [event(k, m=k if k < 8 else -1) for k in range(10)]
    assert report(spark, a, worse) == {(2, "removed", "tool_args.n", ""), (2, "added", "tool_args.m", "")}


def test_dirty_lines_repeats_and_empty_tables(spark):
    a = [event(1, n=1), event(1, n=1), None, "", "  ", "[]", "null", '{"tool_args": {"x"', "12"]
    assert report(spark, a, list(reversed(a))) == set()
    assert drift.changes(drift.ingest(lines(spark, a).limit(0))).count() == 0
    assert report(spark, [None, "[]"], a) == {(2, "added", "tool_args", ""), (2, "added", "tool_args.n", "")}


def test_ingest_preserves_what_does_not_fit(spark):
    odd = {"episode_id": "e", "step_id": "7", "hook_type": 5, "severity": "high", "extra": {"z": 1.50}, "notes": None, "tool_args": "text"}
    rows = drift.ingest(lines(spark, [odd, '{"a": 1'], [])).withColumn("x", F.lit(1)).orderBy("line_no").collect()
    first = rows[0]
    assert (first.episode_id, first.step_id, first.hook_type, first.severity) == ("e", 7, None, None)
    assert json.loads(first.rescued) == {"hook_type": 5, "severity": "high", "extra": {"z": 1.5}, "notes": None, "tool_args": "text"}
    assert [tuple(x) for x in first.leaves] == [("tool_args", "string", "text")]
    assert rows[1].readable is False and json.loads(rows[1].rescued) == '{"a": 1'


def test_promotion_follows_names_and_casts(spark):
    a = [event(k, n=k) for k in range(3)]
    b = [event(k, m=str(k)) for k in range(3)]
    c = [event(9, m="no number")]
    ing = written(drift.ingest(lines(spark, a, b, c)), "t")
    got = drift.promote(ing, written(drift.changes(ing), "r"), {"tool_args.n": "bigint"}).orderBy("file_no", "line_no").select("file_no", "tool_args_n", "rescued").collect()
    assert [(r.file_no, r.tool_args_n) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, None)]
    assert json.loads(got[-1].rescued)["tool_args"] == {"m": "no number"}


def test_every_field_of_every_feed_gets_a_column_of_its_widest_type(spark, tmp_path):
    a = [event(k, a=k, x=100 + k, mixed=[k]) for k in range(3)]
    b = [event(k, m=k, x=100 + k, mixed=str(k)) for k in range(3)]
    c = [event(k, x=100 + k, mixed=True) for k in range(3)]
    d = [event(k, m=100 + k, mixed=k + 0.5) for k in range(3)]
    other = [event(k, real=k if k else 0.5, flag=k > 0, big=2**70, **{"Real": "r"}) for k in range(3)]
    lines(spark, a, b, c, d).union(lines(spark, other, feed="g")).write.parquet(f"{tmp_path}/trace_file_lines.parquet")
    got = training_core.p6_events(spark, str(tmp_path))
    types = dict(got.dtypes)
    assert {n: types[n] for n in types if n.startswith("tool_args")} == {
        "tool_args_a": "bigint", "tool_args_x": "bigint", "tool_args_mixed": "string", "tool_args_Real": "string", "tool_args_real_2": "double", "tool_args_flag": "boolean", "tool_args_big": "string"
    }
    rows = got.where("step_id = 1").orderBy("feed", "file_no").collect()
    assert [(r.tool_args_a, r.tool_args_x, r.tool_args_mixed) for r in rows[:4]] == [(1, 101, "[1]"), (1, 101, "1"), (None, 101, "true"), (None, 101, "1.5")]
    assert (rows[4].tool_args_real_2, rows[4].tool_args_flag, rows[4].tool_args_big) == (1.0, True, str(2**70))


def test_a_name_taken_again_is_a_field_of_its_own(spark):
    a = [event(k, n=k) for k in range(3)]
    b = [event(k, m=k) for k in range(3)]
    c = [event(k, m=k, n=50 + k) for k in range(3)]
    ing = written(drift.ingest(lines(spark, a, b, c)), "t")
    got = drift.promote(ing, written(drift.changes(ing), "r")).where("step_id = 2").orderBy("file_no").collect()
    assert [(r.tool_args_n, r["tool_args_n_2"]) for r in got] == [(2, None), (2, None), (2, 52)]


def brute(files):
    def flat(o):
        out = {}

        def walk(p, v, top):
            inner = v if isinstance(v, dict) else None
            if isinstance(v, str) and v.startswith("{"):
                inner = json.loads(v)
            if v is None:
                return
            if inner is None:
                kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "array" if isinstance(v, list) else "string"
                out[p] = (kind, v if isinstance(v, str) else json.dumps(v))
                return
            if top:
                out[p] = ("object" if isinstance(v, dict) else "string", None)
            for k, x in inner.items():
                walk(f"{p}.{k}", x, False)

        walk("tool_args", o.get("tool_args"), True)
        return out

    got = set()
    for n in range(1, len(files)):
        was, now = ({e["episode_id"]: flat(e) for e in f} for f in files[n - 1 : n + 1])
        kinds = [{p: k for leaf in side.values() for p, (k, _) in leaf.items()} for side in (was, now)]
        gone, new = set(kinds[0]) - set(kinds[1]), set(kinds[1]) - set(kinds[0])
        used = set()
        for g in sorted(gone):
            both = [e for e in was if e in now and g in was[e] and was[e][g][1] is not None]
            for m in sorted(new - used):
                if both and sum(now[e].get(m, (0, None))[1] == was[e][g][1] for e in both) >= 0.9 * len(both):
                    used.add(m)
                    got.add((n + 1, "renamed", g, m))
                    if kinds[0][g] != kinds[1][m]:
                        got.add((n + 1, "retyped", m, kinds[1][m]))
                    break
            else:
                got.add((n + 1, "removed", g, ""))
        got |= {(n + 1, "added", m, "") for m in new - used}
        got |= {(n + 1, "retyped", p, kinds[1][p]) for p in kinds[0] if p in kinds[1] and kinds[0][p] != kinds[1][p]}
    return got


def test_random_feeds_equal_brute_force(spark):
    rng = random.Random(8)
    names, files = ["a", "b", "c"], []
    value = {}
    for n in range(6):
        if n:
            act = rng.choice(["add", "drop", "rename", "retype", "text"])
            if act == "add":
                names.append(f"n{n}")
            elif act == "drop" and len(names) > 1:
                names.pop(rng.randrange(len(names)))
            elif act == "rename":
                k = rng.randrange(len(names))
                value[f"r{n}"] = names[k]
                names[k] = f"r{n}"
        file = []
        for k in range(20):
            if rng.random() < 0.15:
                continue
            args = {}
            for x in names:
                root = x
                while root in value:
                    root = value[root]
                args[x] = hash((root, k)) % 100000 + 1000 if n < 3 or root != "a" else str(hash((root, k)) % 100000 + 1000)
            file.append(event(k, **args) if n != 4 else dict(event(k), tool_args=json.dumps(args)))
        files.append(file)
    assert report(spark, *files) == brute(files)
