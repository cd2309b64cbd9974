"""One copy per message: reading of identifiers, winners, the store's loads, and the edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelode.functions.readings import read_hook, read_instant
from tracelode.operators.deliveries import DeliveryStore, LostRaceError, identified, keep_one, winners

T0 = datetime(2026, 1, 5)


def row(ep="a", step=1, hook="pre_step", at="2026-01-05T00:00:00Z", day=0, **more):
    return dict(episode_id=ep, step_id=step, hook_type=hook, timestamp=at, ingested_at=None if day is None else T0 + timedelta(days=day), **more)


@pytest.mark.parametrize(
    "text, same",
    [
        ("2026-01-05T01:00:00.000+01:00", True), ("2026-01-05 00:00:00", True), ("2026-01-04T19:00:00.000-05:00", True), ("1767571200000", True), (" 2026-01-05t00:00:00z ", True),
        ("2026-01-05T01:00:00+0100", True), ("2026-01-05T01:00:00+01", True), ("2026-01-05", True), ("2026-01-05T00:00:00.000001Z", False), ("yesterday", None), ("", None), (None, None), ("2026-13-45T00:00:00Z", None), ("99999999999999999999", None),
    ],
)
def test_instants(spark, text, same):
    got = spark.createDataFrame([(text,)], "t string").select(read_instant(F.col("t")).alias("x")).first().x
    assert got is None if same is None else (got == 1767571200000000) is same


def test_hooks(spark):
    texts = ["pre_step", " Pre-Step", "preStep", "PRE STEP", "final\n", "check-point", "post__step", "finalize", "", None, "step"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(read_hook(F.col("t")).alias("x")).collect()]
    assert got == ["pre_step"] * 4 + ["final", "checkpoint", "post_step", None, None, None, None]


def removed(spark, tmp_path, *loads):
    store = DeliveryStore(spark, f"file://{tmp_path}/store", span_days=7)
    for e in loads:
        store.load(e)
    return store, sorted(r.ingest_id for r in store.removed().collect())


def test_winner_is_earliest_then_smallest_id(spark, make_events, tmp_path):
    e = make_events(row(day=2), row(hook="Pre-Step", day=1), row(at="1767571200000", day=1), row(day=None), row(step=2), row(step=None), row(ep=" "), row(hook="x"), row(at="?"), row(ep=None))
    _, got = removed(spark, tmp_path, e)
    assert got == [1, 3, 4]
    assert sorted(r.ingest_id for r in keep_one(e).collect()) == [2, 5, 6, 7, 8, 9, 10]


def test_late_load_takes_over_and_rewrites_only_the_partition_that_the_index_names(spark, make_events, tmp_path):
    early = make_events(row(day=5), row(ep="b", at="2026-06-01T00:00:00Z", day=40), row(ep="d", day=40))
    store, got = removed(spark, tmp_path, early)
    assert got == []
    before = store.manifest()
    assert len(before["parts"]) == 2
    # the copy that comes again arrived in another span than the stored one: only the index leads to it
    store.load(make_events(dict(row(day=-60), ingest_id=10), dict(row(ep="c", at="2026-09-01T00:00:00Z", day=200), ingest_id=11)))
    after = store.manifest()
    assert sorted(r.ingest_id for r in store.removed().collect()) == [1]
    assert sorted(r.ingest_id for r in store.current().collect()) == [2, 3, 10, 11]
    changed = {p for p in after["parts"] if after["parts"][p] != before["parts"].get(p)}
    assert len(changed) == 2 and len(after["parts"]) == 3 and after["version"] == 2
    untouched = (set(after["parts"]) - changed).pop()
    assert after["parts"][untouched] == before["parts"][untouched]
    # and again, with the partition found under its old place
    store.load(make_events(dict(row(day=-90), ingest_id=12)))
    assert sorted(r.ingest_id for r in store.removed().collect()) == [1, 10]


def test_a_batch_loaded_twice_changes_nothing(spark, make_events, tmp_path):
    e = make_events(row(), row(), row(step=2))
    store, got = removed(spark, tmp_path, e, e, e.union(e))
    assert got == [2] and sorted(r.ingest_id for r in store.current().collect()) == [1, 3]


def test_rank_keeps_ids_and_arrivals(spark, make_events):
    e = make_events(dict(row(day=None), ingest_id=-(2**63)), dict(row(step=2), ingest_id=2**63 - 1), dict(row(step=3, day=-400000), ingest_id=0), dict(row(step=4), ingest_id=5), dict(row(step=4), ingest_id=-5))
    got = {r.step_id: (r.arrived, r.ingest_id) for r in winners(identified(e)).collect()}
    want = {r.step_id: (r.arrived, r.ingest_id) for r in identified(e).where("ingest_id <> 5").collect()}
    assert got == want and got[1] == (None, -(2**63)) and got[4][1] == -5


def test_new_ids_are_appended_without_rewriting(spark, make_events, tmp_path):
    store, _ = removed(spark, tmp_path, make_events(row()), make_events(dict(row(step=2), ingest_id=7)))
    assert [len(v) for v in store.manifest()["parts"].values()] == [2]
    assert sorted(r.ingest_id for r in store.current().collect()) == [1, 7]


def test_empty_and_extra_columns(spark, make_events, tmp_path):
    e = make_events(row(), row()).withColumns({"hook": F.lit("x"), "at": F.lit(1), "best": F.lit(2), "part": F.lit("y")})
    _, got = removed(spark, tmp_path, e.limit(0), e, e.limit(0))
    assert got == [2]
    assert identified(e.limit(0)).count() == 0


def test_many_loads_equal_brute_force(spark, make_events, tmp_path):
    rng = random.Random(4)
    rows = [row(ep=rng.choice("abc"), step=rng.randint(1, 3), hook=rng.choice(["pre_step", "preStep", "final"]), at=rng.choice(["2026-01-05T00:00:00Z", "1767571200000", "2026-03-05T00:00:00Z"]), day=rng.choice([None, 0, 1, 2])) for _ in range(150)]
    rows = [dict(r, ingest_id=i) for i, r in enumerate(rows)]
    groups = {}
    for r in rows:
        key = (r["episode_id"], r["step_id"], r["hook_type"].lower().replace("_", ""), r["timestamp"].replace("1767571200000", "2026-01-05T00:00:00Z"))
        groups.setdefault(key, []).append((r["ingested_at"] is None, r["ingested_at"] or T0, r["ingest_id"]))
    expected = sorted(set(range(150)) - {min(g)[2] for g in groups.values()})
    rng.shuffle(rows)
    _, got = removed(spark, tmp_path, make_events(*rows[:60]), make_events(*rows[60:100]), make_events(*rows[100:]))
    assert got == expected
    assert sorted(r.ingest_id for r in _.current().collect()) == sorted(set(range(150)) - set(expected))


def test_a_lost_race_destroys_nothing(spark, make_events, tmp_path):
    root = f"file://{tmp_path}/store"
    a, b = DeliveryStore(spark, root), DeliveryStore(spark, root)
    rows = identified(make_events(dict(row(step=3), ingest_id=3)))
    theirs = b._merge(b.manifest(), rows)  # b starts from the empty state,
    a.load(make_events(row(), row(step=2)))  # a commits first
    with pytest.raises(LostRaceError):
        b._commit(theirs)
    assert sorted(r.ingest_id for r in b.current().collect()) == [1, 2]
    b.load_identified(rows)
    assert sorted(r.ingest_id for r in a.current().collect()) == [1, 2, 3] and a.manifest()["version"] == 2


def test_a_load_that_lost_starts_over(spark, make_events, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    a, b = DeliveryStore(spark, root), DeliveryStore(spark, root)
    merge, calls = b._merge, []

    def late(old, rows):
        out = merge(old, rows)
        if not calls:
            a.load(make_events(row(day=1), row(step=2)))
        calls.append(out["loads"][-1])
        return out

    monkeypatch.setattr(b, "_merge", late)
    b.load(make_events(dict(row(day=0), ingest_id=7)))
    assert len(calls) == 2 and sorted(r.ingest_id for r in b.current().collect()) == [2, 7]
    assert [r.ingest_id for r in b.removed().collect()] == [1]
    assert not (tmp_path / "store" / "data" / f"load={calls[0]}").exists()
