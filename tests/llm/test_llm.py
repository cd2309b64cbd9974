"""Problems on training data for language models: small cases, brute force, exact round trips, held-out accuracy."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import consensus, conversations, encoding, grouped_splits, leakage, mojibake, survivorship

T0 = datetime(2026, 1, 5)


# -- p1 -------------------------------------------------------------------------------------------
def step(ep, n, hook, obs=None, plan=None, **more):
    return dict(episode_id=ep, step_id=n, hook_type=hook, observation=obs, plan_summary=plan, timestamp=None, **more)


def sound(ep, n=2):
    rows = [r for k in range(1, n + 1) for r in (step(ep, k, "pre_step", plan="go"), step(ep, k, "Post-Step", obs="done"))]
    return [*rows, step(ep, n, "final", obs="all done")]


def reasons(events):
    return sorted(tuple(r) for r in conversations.dropped_conversations(events).collect())


@pytest.mark.parametrize(
    "rows, want",
    [
        (sound("a"), []),
        (sound("a") * 2, []),
        (sound("a")[:-1], ["missing_reply"]),
        ([*sound("a"), step("a", None, "final", obs="x")], ["broken"]),
        ([*sound("a"), step("a", 1, "heartbeat")], ["broken"]),
        ([*sound("a"), step("a", 4, "checkpoint")], ["broken"]),
        ([*sound("a"), step("a", 3, "post_step", obs="x")], ["broken"]),
        ([*sound("a"), step("a", 3, "pre_step"), step("a", 3, "post_step", obs=" ...! ")], ["missing_reply"]),
        ([*sound("a"), step("a", 0, "checkpoint")], []),
        ([step("a", 1, "pre_step", obs="\t"), step("a", None, None)], ["empty"]),
        ([step("a", 1, "x", obs="w")], ["broken", "missing_reply"]),
        ([step(None, 1, "x"), step("  ", 9, "final")], []),
    ],
)
def test_conversation_reasons(make_events, rows, want):
    assert reasons(make_events(*rows)) == [("a", w) for w in want]


def test_automaton_equals_loop_across_blocks(make_events, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 2)
    rng = random.Random(2)
    rows = [step(f"e{rng.randint(0, 25)}", rng.choice([None, 1, 1, 2, 2, 3, 4, 5]) if rng.random() < 0.5 else rng.randint(1, 3), rng.choice(["pre_step", "pre_step", "post_step", "post_step", "final", "checkpoint", "odd" if rng.random() < 0.1 else "final"]), rng.choice([None, "", "yes", "ok"]), rng.choice([None, "p"])) for _ in range(260)]
    want = []
    for e in {r["episode_id"] for r in rows}:
        mine = [r for r in rows if r["episode_id"] == e]
        if not any(r["observation"] or r["plan_summary"] for r in mine):
            want.append((e, "empty"))
            continue
        ok = [r for r in mine if r["step_id"] is not None and r["hook_type"] != "odd"]
        steps = {r["step_id"] for r in ok}
        at = lambda s, h, ok=ok: [r for r in ok if r["step_id"] == s and r["hook_type"] == h]
        if len(ok) < len(mine) or any(s not in steps for s in range(1, max(steps, default=0) + 1)) or any(at(s, "post_step") and not at(s, "pre_step") for s in steps):
            want.append((e, "broken"))
        if any(at(s, "pre_step") and not any(r["observation"] for r in at(s, "post_step")) for s in steps) or not any(r["observation"] for r in ok if r["hook_type"] == "final"):
            want.append((e, "missing_reply"))
    assert reasons(make_events(*rows)) == sorted(want)


def test_conversation_turns(make_events):
    rows = [dict(r, user_instruction="please", proposed_tool="t" if r["hook_type"] == "pre_step" else None, timestamp="2026-01-05T00:00:00Z") for r in sound("a")]
    got = conversations.conversations(make_events(*reversed(rows), rows[0], *sound("b")[:1])).orderBy("turn_no").collect()
    assert [(r.turn_no, r.role, r.text) for r in got] == [(1, "user", "please"), (2, "assistant", "go\nt"), (3, "tool", "done"), (4, "assistant", "go\nt"), (5, "tool", "done"), (6, "assistant", "all done")]
    empty = make_events(*rows).limit(0)
    assert conversations.conversations(empty).count() == 0 and reasons(empty) == []


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_an_instruction_is_said_once_whatever_the_block(make_events, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    asks = {1: "please", 2: "please", 3: None, 4: " ", 5: "please", 6: "now this", 9: "now this", 10: "please"}
    rows = [dict(r, user_instruction=asks.get(r["step_id"]), timestamp="2026-01-05T00:00:00Z") for r in sound("a", 12)]
    got = conversations.conversations(make_events(*rows)).where("role = 'user'").orderBy("turn_no").collect()
    assert [(r.turn_no, r.step_id, r.text) for r in got] == [(1, 1, "please"), (12, 6, "now this"), (21, 10, "please")]


def test_extra_columns_do_not_clash(make_events):
    e = make_events(*sound("a")).withColumns({c: F.lit(1) for c in ("hook", "block", "turns", "obs", "at")})
    assert reasons(e) == []


# -- p3 -------------------------------------------------------------------------------------------
LABEL = "label_id long, episode_id string, annotator_id string, source string, binary_risk_label string, severity_score double, first_risk_step long, risk_category string, judge_version string, residual_concern boolean, labelled_at timestamp"


def votes(spark, rows):
    return spark.createDataFrame([(i, e, a, "s", v, s, f, None, None, None, t) for i, (e, a, v, s, f, t) in enumerate(rows)], LABEL)


def test_usable_votes(spark):
    rows = [("e", "a", " TRUE ", 0.5, 1, T0), ("e", "a", "skip", 0.1, None, T0 + timedelta(1)), ("e", "a", "safe", None, None, T0 - timedelta(1)), ("e", "b", "0", 0.0, None, None), ("e", "b", "Risk", 5.0, 2, None), (None, "a", "1", None, None, T0), ("e", " ", "1", None, None, T0), ("e", "c", None, None, None, None), ("e", "c", "2", None, None, None)]
    assert sorted((r.annotator_id, r.vote) for r in consensus.usable_votes(votes(spark, rows)).collect()) == [("a", 1), ("b", 1)]


def simulated(seed=1, n=400, people=40):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.45
    kind = rng.choice(["good", "fair", "one", "zero", "coin", "inverse"], people, p=[0.35, 0.2, 0.12, 0.12, 0.11, 0.1])
    rows = []
    for i in range(n):
        for a in rng.choice(people, rng.integers(2, 9), replace=False):
            t = truth[i]
            p = {"good": 0.93 if t else 0.07, "fair": 0.75 if t else 0.25, "one": 0.95, "zero": 0.05, "coin": 0.5, "inverse": 0.08 if t else 0.92}[kind[a]]
            rows.append((f"e{i}", f"a{a}", str(int(rng.random() < p)), None, None, None))
    return rows, truth, kind


def test_consensus_beats_majority_and_both_ways_agree(spark):
    rows, truth, kind = simulated()
    d = votes(spark, rows)
    got = consensus.consensus(d).toPandas()
    right = (got.binary_risk_label == truth[got.episode_id.str[1:].astype(int)]).mean()
    maj = d.groupBy("episode_id").agg(F.avg(F.col("binary_risk_label").cast("double")).alias("m"), F.count("*").alias("n")).where("n >= 3").toPandas()
    majority = ((maj.m > 0.5) == truth[maj.episode_id.str[1:].astype(int)]).mean()
    assert right > 0.9 and right > majority + 0.05 and len(got) == len(maj)
    people = consensus.annotator_reliability(d).toPandas().set_index("annotator_id")
    assert {a for a in people.index[people.inverted]} == {f"a{k}" for k in range(40) if kind[k] == "inverse"}


def test_the_end_is_a_standstill_and_shuffled_joins_give_the_same(spark):
    rows, _, _ = simulated(seed=3, n=100, people=12)
    d = consensus.usable_votes(votes(spark, rows)).coalesce(1).cache()
    rough, fine = consensus.fit(d, chains=2), consensus.fit(d, tolerance=1e-10, chains=2)
    want = {r.episode_id: r.p_risky for r in fine.items.collect()}
    assert fine.rounds > rough.rounds and all(abs(r.p_risky - want[r.episode_id]) < 0.01 for r in rough.items.collect())
    here, there = consensus.fit(d, tolerance=1e-3, chains=2), consensus.fit(d, tolerance=1e-3, chains=2, local_annotators=0)
    assert here.rounds == there.rounds
    want = {r.episode_id: r for r in here.items.collect()}
    got = {r.episode_id: r for r in there.items.collect()}
    assert want.keys() == got.keys() and all(abs(got[e].p_risky - r.p_risky) < 1e-6 and got[e].n_risky == r.n_risky for e, r in want.items())
    people = {r.annotator_id: r for r in there.annotators.collect()}
    assert all(abs(people[r.annotator_id].competence - r.competence) < 1e-6 and people[r.annotator_id].inverted == r.inverted for r in here.annotators.collect())


def test_consensus_edges(spark):
    d = votes(spark, [("e", "a", "1", 0.5, 3, T0), ("e", "b", "1", 5.0, 2, T0), ("e", "c", "1", None, None, T0), ("f", "a", "0", 0.0, None, T0), ("f", "b", "0", 10.0, None, T0)])
    got = consensus.full_consensus(d).collect()
    assert [(r.episode_id, r.binary_risk_label, r.n_annotators, r.agreement, r.severity_score, r.first_risk_step) for r in got] == [("e", 1, 3, 1.0, 0.5, 2)]
    assert consensus.consensus(d.limit(0)).count() == 0 and consensus.annotator_reliability(d.limit(0)).count() == 0


# -- p4 -------------------------------------------------------------------------------------------
CONTEXT = "record_id long, episode_id string, suite_name string, user_task_id string, injection_task_id string, attack_type string, prompt string, step_id long, agent_name string, sandbox_id string, source_batch string, updated_at timestamp"


def contexts(spark, *rows):
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CONTEXT)


def test_spellings_of_an_episode(spark):
    same = ["slack:user_task_7:direct:injection_task_1", " SLACK:USER_TASK_7:DIRECT:INJECTION_TASK_1\t", "Collection:slack:user_task_7:direct:injection_task_1", "slack%3Auser_task_7%3Adirect%3Ainjection_task_1", "slack/user-task-7/direct/injection-task-1", "slack | user_task_0007 | direct | injection_task_1", "slack:user_task_7", None, " "]
    more = dict(suite_name="slack", user_task_id="user_task_7", attack_type="direct", injection_task_id="injection_task_1")
    other = [dict(episode_id="slack:user_task_7:none:none"), dict(episode_id="slack:user_task_70:direct:injection_task_1", **more), dict(episode_id=None, suite_name="slack", user_task_id="user_task_7"), dict(episode_id="slack:user_task_7")]
    keys = [r.k for r in contexts(spark, *[dict(episode_id=e, **more) for e in same], *other, dict(episode_id=None)).select(survivorship.episode_key().alias("k")).collect()]
    assert len(set(keys[: len(same)])) == 1
    a, b, c, d, none = keys[len(same) :]
    assert a == c == d != keys[0] and b not in (a, keys[0]) and none is None


def test_survivors(spark):
    trust = spark.createDataFrame([("hi", 5), ("lo", 1), ("hi", 4)], "source_batch string, trust long")
    e = dict(episode_id="s:user_task_1:none:none", user_task_id="user_task_1")
    rows = [
        dict(e, record_id=5, prompt="old", source_batch="hi", updated_at=T0, agent_name="n/a", sandbox_id=" "),
        dict(e, record_id=3, prompt="new", source_batch="hi", updated_at=T0 + timedelta(1), agent_name="TBD"),
        dict(e, record_id=9, prompt="new", source_batch="hi", updated_at=T0 + timedelta(1), agent_name="low", sandbox_id="null"),
        dict(e, record_id=1, prompt="untrusted", source_batch=None, updated_at=T0 + timedelta(9), agent_name=None),
        dict(episode_id="s:user_task_2:none:none", record_id=20, prompt="alone"),
        dict(e, record_id=None, prompt="unnamed", source_batch="hi", updated_at=T0 + timedelta(99)),
    ]
    d = contexts(spark, *rows).withColumns({"trust": F.lit(1), "key": F.lit(2)})
    got = {(r.group_id, r.field_name): r.record_id for r in survivorship.surviving_fields(d, trust).collect()}
    assert got == {(1, "user_task_id"): 3, (1, "prompt"): 3, (1, "agent_name"): 9}
    gold = survivorship.golden_records(d, trust).collect()
    assert [(r.prompt, r.agent_name, r.sandbox_id) for r in gold] == [("new", "low", None)]
    assert survivorship.surviving_fields(d.limit(0), trust.limit(0)).count() == 0


# -- p5 -------------------------------------------------------------------------------------------
def links(spark, *pairs):
    return spark.createDataFrame([(i, a, b, "t", None) for i, (a, b) in enumerate(pairs)], "link_id long, episode_id string, linked_episode_id string, link_type string, created_at timestamp")


def test_components_equal_union_find(spark, make_events):
    rng = random.Random(5)
    ids = [f"s{k % 3}:user_task_{rng.randint(0, 60)}:a{k}:none" for k in range(120)] + ["odd", "odd:two"]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(30)] + [(ids[0], "s9:user_task_1:gone:none"), ("s9:user_task_1:other:none", ids[5]), (None, ids[1]), (ids[1], " "), ("odd", ids[2])]
    pairs += [(f"c:user_task_{k}:x:none", f"c:user_task_{k + 1}:x:none") for k in range(40)]  # a long chain
    ids += [f"c:user_task_{k}:x:none" for k in (0, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i in {*ids, *[p for ab in pairs for p in ab if p and p.strip()]}:
        key = ":".join(i.split(":")[:2]) if i.count(":") >= 2 else "!" + i
        parent[find(i)] = find(key)
    for a, b in pairs:
        if a and b and a.strip() and b.strip():
            parent[find(a)] = find(b)
    groups = {}
    for i in set(ids):
        groups.setdefault(find(i), []).append(i)
    want = {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}
    events = make_events(*[dict(episode_id=i) for i in ids * 2], dict(episode_id=None), dict(episode_id=" "))
    assert {tuple(r) for r in grouped_splits.related_groups(events, links(spark, *pairs, *pairs[::-1])).collect()} == want
    assert grouped_splits.related_groups(events.limit(0), links(spark, *pairs).limit(0)).count() == 0


def test_split_keeps_groups_whole_and_shares(spark, make_events):
    rng = random.Random(6)
    rows = [dict(episode_id=f"s:user_task_{k}:a{j}:none", risk_event=rng.random() < 0.2) for k in range(150) for j in range(rng.randint(1, 3)) for _ in range(rng.randint(1, 6))]
    rows += [dict(episode_id="s:user_task_900:a:none")] * 300
    events = make_events(*rows)
    lk = links(spark, ("s:user_task_1:a0:none", "s:user_task_2:a0:none"))
    got = grouped_splits.grouped_splits(events, lk).toPandas()
    assert set(got.episode_id) == {r["episode_id"] for r in rows} and got.groupby("group_id").split.nunique().max() == 1
    report = {r.split: r for r in grouped_splits.split_report(spark.createDataFrame(got), events).collect()}
    assert abs(report["train"].row_share - 0.8) < 0.01 and abs(report["test"].row_share - 0.1) < 0.01 and abs(report["validation"].row_share - 0.1) < 0.01
    risky = sum(r.n_risky for r in report.values())
    assert abs(report["test"].n_risky - 0.1 * risky) <= 0.05 * risky
    assert grouped_splits.grouped_splits(events.limit(0), lk).count() == 0
    # in many small shards, which have to exchange to come to the same balance
    many = grouped_splits.grouped_splits(events, lk, shard_components=20)
    assert [(r.share_kept, r.labels_kept, r.groups_cut) for r in grouped_splits.split_balance(many, events, bound=0.01).collect()] == [(True, True, 0)] * 3


# -- p7 -------------------------------------------------------------------------------------------
def test_ids_equal_the_public_libraries(spark):
    import tiktoken

    ranks = encoding.read_ranks()
    public = tiktoken.Encoding("own", pat_str=encoding.PIECES, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "abab" * 50, "Hello  world\r\n\t x's 12345 <|endoftext|> naïve 日本語 🙏🏽", "\x00\x85�", "x" * 3000]
    texts += ["".join(rng.choice("ab cde'ß\n1é") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encoding.encode_column(d).collect()}
    assert [got[i] for i in range(len(texts))] == [public.encode_ordinary(t) for t in texts] and got[len(texts)] == []
    assert public.decode(got[5]) == texts[5]
    assert encoding.encode_column(d.limit(0)).count() == 0


def test_lower_ranks_that_come_up_late_go_first():
    # bc only forms out of (b, c), but abc may also merge as (ab, c) with a lower rank than ab itself
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"abab": 258}
    e = encoding.PairIndexEncoder(ranks)
    assert e.merge([b"abcab", b"ababc", b"ab"]) == [(256, 257), (257, 256), (257,)]


# -- p8 -------------------------------------------------------------------------------------------
ITEM = "If Alpha counts more than 620 tiles, Bravo locks the hidden vault. Until Charlie moves, idle Delta copies nine drawers for Echo near Foxtrot harbour tonight"


def run_of(spark, *texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("item_id", F.lit(9))
    it = spark.createDataFrame([(i, "s", "test", t, "") for i, t in items], "item_id long, suite_name string, held_out_split string, item_text string, answer_text string")
    return sorted(tuple(r) for r in leakage.leaks(docs, it).collect())


def test_leaks(spark):
    w = ITEM.split()
    cut = lambda n: " ".join(w[:n])
    two = " ".join(x if k not in (5, 11) else "changed" for k, x in enumerate(w[:16]))
    three = " ".join(x if k not in (4, 9, 13) else "changed" for k, x in enumerate(w[:16]))
    added = " ".join(x + (" really" if k in (5, 10) else "") for k, x in enumerate(w[:16]))
    missing = " ".join(x for k, x in enumerate(w[:19]) if k not in (5, 9, 13))
    shuffled = " ".join(sorted(w))
    marked = "<p>" + " ".join(f"<b>{x.upper()}</b>" if k % 2 else f"**{x}**" for k, x in enumerate(w[:16])).replace(" ", "&nbsp;\n> // ") + "</p>"
    got = run_of(spark, cut(16), cut(15), two, three, added, missing, shuffled, marked, None, "", "x " * 5000 + cut(20), cut(16))
    assert got == [(0, 1), (2, 1), (4, 1), (5, 1), (7, 1), (10, 1), (11, 1)]


def test_leaks_edges(spark):
    assert run_of(spark, ITEM, items=((1, "too short"), (2, None))) == []
    other = ITEM.replace("Alpha", "Zulu").replace("Bravo", "Yankee")
    assert run_of(spark, ITEM, items=((1, ITEM), (2, other), (3, ITEM))) == [(0, 1), (0, 2), (0, 3)]
    assert run_of(spark, ITEM, items=()) == [] and run_of(spark, items=((1, ITEM),)) == []


def test_items_that_share_a_template(spark):
    rng = random.Random(12)
    own = lambda k: [f"w{k}n{j}" for j in range(9)]
    template = "which tool call should the agent make first and why does it matter here".split()
    items = [(k, " ".join([*own(k), *template, *own(k + 500)])) for k in range(300)]
    texts, want = [], []
    for n, k in enumerate(rng.sample(range(300), 25)):
        ws = items[k][1].split()
        a = rng.randint(0, len(ws) - 18)
        part = ws[a : a + 18]
        for e in rng.sample(range(1, 17), 3):
            part[e] = "changed"
        texts.append("so " + " ".join(part) + " then")
        if leakage.holds_run(ws, texts[-1].split()):
            want.append((n, k))
    texts += [" ".join(template[:12])] * 20  # the template alone is no passage
    assert len(want) == 25 and run_of(spark, *texts, items=tuple(items)) == want


def test_spared_sequences_leave_a_seed():
    for length in range(leakage.LEAST, 2 * leakage.LEAST):
        n = length - leakage.SEED + 1
        lost = leakage.SPARED * (n // leakage.WINDOW) + min(leakage.SPARED, n % leakage.WINDOW)
        assert n - leakage.SEED * (length // leakage.TOLERANCE) - lost >= 1
    rng = random.Random(1)
    for _ in range(50):
        keep = leakage.spared([rng.choice([1, 2, 5, 300]) for _ in range(rng.randint(1, 60))])
        assert all(sum(not x for x in keep[a : a + leakage.WINDOW]) <= leakage.SPARED for a in range(len(keep)))
    assert leakage.spared([9, 4, 300, 300, 5]) == [True, True, False, False, True]


def test_runs_equal_brute_force():
    rng = random.Random(9)

    def distance_ok(item, doc):
        for a in range(len(item)):
            for i in (k for k, x in enumerate(doc) if x == item[a]):
                row = list(range(len(doc) - i + 1))
                for n, x in enumerate(item[a : a + 2 * leakage.LEAST], 1):
                    new = [n]
                    for j, y in enumerate(doc[i:], 1):
                        new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
                    row = new
                    if n >= leakage.LEAST and any(row[j] * leakage.TOLERANCE <= n and doc[i + j - 1] == x for j in range(1, len(row))):
                        return True
        return False

    for _ in range(25):
        item = [f"w{rng.randint(0, 25)}" for _ in range(24)]
        doc = ["z"] * 3 + item[rng.randint(0, 6) :] + ["z"]
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(doc))
            doc[k : k + rng.randint(0, 1)] = [rng.choice(["z", "w1"])] if rng.random() < 0.7 else []
        assert leakage.holds_run(item, doc) == distance_ok(item, doc)


# -- p9 -------------------------------------------------------------------------------------------
CLEAN = ["Même problème ici : le nœud reste bloqué et l’âge dépasse la limite, déjà été très près.", "Можно ли ускорить разбор без лишней памяти, ключ не уникален?", "Für jede Prüfung überschreibt das die Größe, möchte löschen – „schön“ …", "同じ記録が二度届くので、片方だけ残したいです。", "Não consigo abrir a sessão após a atualização, é só isso às vezes. ATENÇÃO: SÃO", "Thanks 😀 it doesn’t matter → 5 µs ≥ 4 × 3 °C, £5 © ½ naïve façade", "└── a\n├── b │ c", "plain ascii &#9; &amp; text", "Należy usunąć żaden właściwego źródło"]


def bad(text, wrong):
    return text.encode("utf-8").decode(wrong, "replace")


def sloppy(text):
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())


GARBLED = [sloppy(CLEAN[0]), bad(CLEAN[2], "latin-1"), bad(CLEAN[5], "cp437"), bad(CLEAN[0], "mac_roman"), bad(CLEAN[1], "cp1251"), sloppy(sloppy(CLEAN[4])), bad(CLEAN[3], "latin-1"), CLEAN[1].encode("cp1251").decode("cp1252"), CLEAN[1].encode("koi8_r").decode("cp1251"), "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in sloppy(CLEAN[0])), CLEAN[0].replace("é", "�"), bad(CLEAN[8], "cp1250"), CLEAN[3].encode("cp932").decode("latin-1"), "fine text, one â€¢ only"]


def test_garbled_found_and_restored(spark):
    mentions = ["Why do I see `Ã©` instead of `é`?", 'I know "Ã¼" stands for "ü".', "the sign `�` means what?", "it says `Ð¿Ñ€Ð¸` here"]
    texts = [*CLEAN * 30, *GARBLED, *mentions, None, "", "  "]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("found", F.lit(1))
    first = len(CLEAN) * 30
    assert sorted(r.doc_id for r in mojibake.garbled(d).collect()) == list(range(first, first + len(GARBLED)))
    fixed = {r.doc_id - first: r for r in mojibake.repaired(d).collect()}
    want = [CLEAN[0], CLEAN[2], CLEAN[5], CLEAN[0], CLEAN[1], CLEAN[4], CLEAN[3], CLEAN[1], CLEAN[1], CLEAN[0], CLEAN[0], CLEAN[8], CLEAN[3], "fine text, one • only"]
    assert [(k, fixed[k].restored) for k, t in enumerate(want) if fixed[k].restored != t] == []
    assert mojibake.garbled(d.limit(0)).count() == 0


def test_lost_bytes_are_wildcards():
    channel = mojibake.Channel({"é": 500, "è": 20, "”": 300, "“": 300, "Ã": 5, "’": 200, "ñ": 90})
    assert channel.restore_run("Ã\ufffd")[0] == "é"
    assert channel.restore_run("\ufffd©")[0] == "é"  # the first byte was lost
    assert channel.restore_run("â€œ")[0] == "“"
    assert channel.restore_run("\ufffd€œ")[0] == "“"
    assert channel.restore_run("Ã")[0] == "Ã"
    assert channel.restore_run("\x92")[0] == "’"  # the byte of another table
    text, gain = channel.restore_run("\ufffd")
    assert text == "\ufffd" and gain > 0  # lost as a whole: found, but not to be had


def test_readings_go_on_until_nothing_is_gained():
    stages = ["é"]
    for _ in range(6):
        stages.append(sloppy(stages[-1]))
    channel = mojibake.Channel({"é": 500} | {c: 5 for t in stages[1:] for c in t})
    assert all(channel.restore_run(t)[0] == "é" for t in stages)


def test_references_by_name(spark):
    texts = ["d&Atilde;&copy;j&Atilde;&nbsp; vu", "d&eacute;j&agrave; vu &nbsp; &amp;", "a&nbsp;b d&#xC3;&#xA9;j d&Atilde;&copy;"] + [CLEAN[0]] * 30
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.restored for r in mojibake.repaired(d).collect()} == {0: "déj\u00e0 vu", 2: "a&nbsp;b déj dé"}
