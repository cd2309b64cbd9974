"""Queries of the engine's own operators, each with its SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import audits, etl, labels, metrics, models, prefix
from tracelode.operators import features as P
from tracelode.plans import prefix_sql as S
from tracelode.sources.tables import checked, trace_events
from tracelode.session import spread, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SPARK = {"l": "bigint", "s": "string", "b": "boolean"}
#: Digits of doubles; variances have finite decimals of up to eight places, so they are compared on nine.
_DIGITS = {"d": 6, "e": 9}


def query(columns: str, sql: str | None = None):
    """Registers a query; ``columns`` are names with a type letter, brought to the same types on both sides."""
    spec = [c.split(":") if ":" in c else (c, "l") for c in columns.split()]

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            cast = lambda n, k: F.round(F.col(n).cast("double"), _DIGITS[k]) if k in _DIGITS else F.col(n).cast(_SPARK[k])
            return df.select(*[cast(n, k).alias(n) for n, k in spec])

        QUERIES[fn.__name__] = run
        if sql:
            cast = {"d": "round(cast({0} as double), 6)", "e": "round(cast({0} as double), 9)", "l": "cast({0} as bigint)", "s": "cast({0} as varchar)", "b": "cast({0} as boolean)"}
            SQL[fn.__name__] = f"select {', '.join(cast[k].format(n) + ' as ' + n for n, k in spec)} from ({sql})"
        return fn

    return add


def _typed(names: tuple[str, ...] | list[str]) -> str:
    text = {"episode_id", "hook_type", "oracle_rules", "policy"}
    return " ".join(n + (":s" if n in text else ":e" if "variance" in n else ":d" if n.startswith(("q_", "d_", "max_", "f_self_check_gap", "cumulative_stream", "risk_score", "future_severity")) else "") for n in names)


# -- scans and row-local features -----------------------------------------------------------------


@query("hook_type:s n_events n_episodes n_tools", f"with {S.EV} select hook_type, count(*) as n_events, count(distinct episode_id) as n_episodes, count(distinct case when hook_type = 'pre_step' then proposed_tool end) as n_tools from ev group by 1")
def trace_scan_hooks(spark, sf):
    tool = F.when(F.col("hook_type") == "pre_step", F.col("proposed_tool"))
    return trace_events(spark, sf).groupBy("hook_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("episode_id").alias("n_episodes"), F.count_distinct(tool).alias("n_tools"))


_REASON = f"""case when episode_id is null or not regexp_matches(episode_id, '\\S') then 'episode_id' when step_id is null then 'step_id' when {S.HOOK} is null then 'hook_type'
  when not {S.OBJECT.format('tool_args')} or not {S.OBJECT.format('state_delta')} or not {S.OBJECT.format('self_check')} then 'json' else 'valid' end"""


@query("reason:s n_rows", f"select {_REASON} as reason, count(*) as n_rows from trace_events group by 1")
def trace_rejects(spark, sf):
    d = checked(table(spark, sf, "trace_events"))
    return d.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


_K = "seq episode_id:s step_id hook_type:s"


@query(f"{_K} {_typed(P.STEP_FEATURES)} raw_score:d", f"{S.UPTO_STEP} select *, {S._RAW} as raw_score from st")
def step_features(spark, sf):
    return P.step_features(spread(trace_events(spark, sf))).withColumn("raw_score", P.raw_score())


@query(f"{_K} {_typed(P.STREAM_FEATURES)}", f"{S.UPTO_STREAM} select * from sq")
def stream_q(spark, sf):
    return P.stream_features(spread(trace_events(spark, sf)))


@query(f"{_K} {_typed(prefix.FLAGS)}", f"{S.UPTO_FLAGS} select * from fl")
def heuristic_disagreement(spark, sf):
    return prefix.scan(trace_events(spark, sf))


# -- prefix windows -------------------------------------------------------------------------------
_COUNTS = [c for c in prefix.COUNTED if c != "cumulative_stream_variance"]


@query(f"{_K} {_typed([*_COUNTS, 'cumulative_disagreement_count', 'confirmation_seen_so_far'])}", f"{S.UPTO_PREFIX} select * from px")
def cumulative_counts(spark, sf):
    return prefix.scan(trace_events(spark, sf))


_TOPS = [c for c in prefix.HIGHEST if c != "confirmation_seen_so_far"]


@query(f"{_K} {_typed(_TOPS)} cumulative_stream_variance:e", f"{S.UPTO_PREFIX} select * from px")
def running_maxima(spark, sf):
    return prefix.scan(trace_events(spark, sf))


@query(f"{_K} oracle_violation risk_score:d policy:s", f"{S.UPTO_PREFIX} select * from px")
def decayed_risk_score(spark, sf):
    return prefix.risk_scores(trace_events(spark, sf))


@query(f"{_K} v1 v2 v3", f"{S.UPTO_PREFIX} select * from px")
def oracle_violations(spark, sf):
    return prefix.scan(trace_events(spark, sf), full=False)


@query("episode_id:s first_risk last_risk", f"{S.UPTO_PREFIX} select * from er")
def episode_risk_steps(spark, sf):
    return prefix.episode_risk(prefix.scan(trace_events(spark, sf), full=False))


@query(f"{_K} future_risk_label future_severity:d t_risk lead_time_if_alert_now", f"{S.UPTO_PREFIX} select * from px")
def future_labels(spark, sf):
    return prefix.prefix_dataset(trace_events(spark, sf))


@query(f"seq {_typed(prefix.PREFIX_COLUMNS)}", f"{S.UPTO_PREFIX} select * from px")
def prefix_dataset(spark, sf):
    return prefix.prefix_dataset(trace_events(spark, sf))


@query("policy:s n", f"{S.UPTO_PREFIX} select policy, count(*) as n from px group by 1")
def policy_histogram(spark, sf):
    return prefix.risk_scores(trace_events(spark, sf)).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("surface_benign_risky deceptive_or_miscalibrated self_check_low_external_high plan_benign_action_risky n_rows", f"""{S.UPTO_PREFIX} select sum((d_intent_action_gap >= 0.5 and future_risk_label = 1)::int) as surface_benign_risky,
  sum((q_self_check <= 0.3 and q_action >= 0.7 and future_risk_label = 1)::int) as deceptive_or_miscalibrated, sum((q_self_check <= 0.3 and q_action >= 0.7)::int) as self_check_low_external_high,
  sum((d_plan_action_gap >= 0.5 and future_risk_label = 1)::int) as plan_benign_action_risky, count(*) as n_rows from px""")
def deceptive_slices(spark, sf):
    d = labels.deceptive_slices(prefix.prefix_dataset(trace_events(spark, sf)))
    names = ("surface_benign_risky", "deceptive_or_miscalibrated", "self_check_low_external_high", "plan_benign_action_risky")
    return d.agg(*[F.count_if(n).alias(n) for n in names], F.count(F.lit(1)).alias("n_rows"))


# -- merging, splitting, metadata -----------------------------------------------------------------
#: Order and arrival of a row, which say nothing about the event.
_ARRIVAL = ("timestamp",)
_RECOVERY = "coalesce(contains(lower(source_batch), 'recovery'), false)"


@query("seq episode_id:s step_id hook_type:s source_batch:s", f"""with {S.EV}, u as (select min(seq) as seq, * exclude (seq) from ev group by all),
  r as (select *, {_RECOVERY} as rec from u),
  k as (select *, max(rec) over (partition by episode_id, step_id, hook_type) as any_rec, row_number() over (partition by episode_id, step_id, hook_type order by rec desc, seq) as nth from r)
  select * from k where not any_rec or nth = 1""")
def merge_dedupe_recovery(spark, sf):
    return etl.recovery_preferred(etl.exact_duplicates_dropped(trace_events(spark, sf), ["episode_id", "step_id", "hook_type", "source_batch"], _ARRIVAL))


@query("seq episode_id:s step_id hook_type:s", f"""with {S.EV} select * from (select *, row_number() over (partition by episode_id, step_id, hook_type order by {_RECOVERY} desc, seq) as nth from ev) where nth = 1""")
def full_dedupe(spark, sf):
    return etl.recovery_preferred(trace_events(spark, sf).select("seq", "episode_id", "step_id", "hook_type", "source_batch"), always=True)


@query("source_batch:s episode_id:s step_id hook_type:s seq severity:d", f"""with {S.EV} select source_batch, episode_id, step_id, hook_type, max(seq) as seq, arg_max(coalesce(severity, -1.0), seq) as severity from ev group by 1, 2, 3, 4""")
def lookup_keep_last(spark, sf):
    d = trace_events(spark, sf).withColumn("sev", F.coalesce("severity", F.lit(-1.0)))
    return etl.keep_last(d, ["source_batch", "episode_id", "step_id", "hook_type"], ["seq", "sev"]).withColumnRenamed("sev", "severity")


_SPLITS = """e as (select episode_id, row_number() over (order by md5('{seed}' || episode_id), episode_id) as rank, count(*) over () as n from (select distinct episode_id from ev)),
  c as (select *, cast(floor(n * 0.6::double + 1e-9) as bigint) as a0, cast(floor(n * 0.2::double + 1e-9) as bigint) as b0 from e),
  f as (select *, n - a0 - 2 * b0 as rest, n * 0.6::double - a0 as fa, n * 0.2::double - b0 as fb from c),
  g as (select *, a0 + case when rest >= 1 and (fa >= fb - 1e-9 or rest = 3) then 1 when rest >= 3 then 1 else 0 end as a,
     b0 + case when fa >= fb - 1e-9 then case when rest >= 2 then 1 else 0 end else case when rest >= 1 then 1 else 0 end end as b from f),
  sp as (select episode_id, case when rank <= a then 'train' when rank <= a + b then 'val' else 'test' end as split from g)"""
_SPLIT = f"with {S.EV}, {_SPLITS.format(seed='20260601')}"


@query("split:s n_episodes n_rows n_risky", f"{_SPLIT} select split, count(distinct ev.episode_id) as n_episodes, count(*) as n_rows, count(*) filter (where coalesce(step_id <= t_risk, false)) as n_risky from ev join sp using (episode_id) group by 1")
def split_manifest_counts(spark, sf):
    d = trace_events(spark, sf).select("episode_id", "step_id", "t_risk")
    split = written(etl.episode_split(d), "split")
    risky = F.coalesce(F.col("step_id") <= F.col("t_risk"), F.lit(False))
    return d.join(split, "episode_id").groupBy("split").agg(F.count_distinct("episode_id").alias("n_episodes"), F.count(F.lit(1)).alias("n_rows"), F.count_if(risky).alias("n_risky"))


@query("episode_id:s n_splits", f"""with {S.EV}, sp as (select episode_id, batch_kind as split from ev join (select source_batch, max(batch_kind) as batch_kind from source_batches group by 1) using (source_batch)) select episode_id, count(distinct split) as n_splits from sp group by 1 having count(distinct split) > 1""")
def split_overlap(spark, sf):
    """Episodes that have rows in batches of several kinds."""
    kinds = table(spark, sf, "source_batches").groupBy("source_batch").agg(F.max("batch_kind").alias("split"))
    return audits.split_overlap(trace_events(spark, sf).select("episode_id", "source_batch").join(kinds, "source_batch").select("episode_id", "split"))


@query("matched_rows extra missing", f"""with {S.EV}, m as (select distinct episode_id from episode_links where episode_id is not null), e as (select distinct episode_id from ev)
  select (select count(*) from ev where episode_id in (select episode_id from m)) as matched_rows, (select count(*) from e where episode_id not in (select episode_id from m)) as extra, (select count(*) from m where episode_id not in (select episode_id from e)) as missing""")
def align_split(spark, sf):
    manifest = table(spark, sf, "episode_links").where("episode_id is not null").select("episode_id").distinct()
    rows, extra, missing = etl.aligned(trace_events(spark, sf).select("episode_id"), manifest)
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return one(rows, "matched_rows").crossJoin(one(extra, "extra")).crossJoin(one(missing, "missing"))  # three rows of one


_META = f"""with {S.EV}, a as (select episode_id, max(risk_event) filter (where risk_event is not null or hook_type = 'final') as x, bool_or(hook_type = 'final') as fin from ev group by 1),
  k as (select episode_id, hook_type = 'final' and (json_extract_string(notes, '$.utility') in ('true', 'false')) as known, json_extract_string(notes, '$.utility') = 'true' as v, source_batch from ev),
  g as (select episode_id, bool_or(v) filter (where known) as hi, bool_and(v) filter (where known) as lo, coalesce(bool_or(known), false) as anyk, array_to_string(list_sort(list(distinct source_batch) filter (where source_batch is not null)), ';') as batches from k group by 1)"""


@query("episode_id:s value:b status:s batches:s", f"""{_META} select episode_id, case when hi = lo then hi end as value, case when not anyk then 'unknown_not_evaluated' when hi <> lo then 'conflict' when hi then 'known_true' else 'known_false' end as status, coalesce(batches, '') as batches from g""")
def metadata_backfill(spark, sf):
    d = trace_events(spark, sf)
    u = F.get_json_object("notes", "$.utility")
    return etl.episode_metadata(d, (F.col("hook_type") == "final") & F.coalesce(u.isin("true", "false"), F.lit(False)), u == "true")


@query("status:s n_episodes", f"""{_META} select case when not anyk then 'unknown_not_evaluated' when hi <> lo then 'conflict' when hi then 'known_true' else 'known_false' end as status, count(*) as n_episodes from g group by 1""")
def metadata_buckets(spark, sf):
    return metadata_backfill(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n_episodes"))


@query("episode_id:s source_batch:s n_rows status:s overridden:b", f"""with {S.EV}, b as (select episode_id, source_batch, {_RECOVERY} as rec, count(*) as n_rows, case when bool_or(hook_type = 'final') then 'ok' else 'stopped' end as status from ev where source_batch is not null group by 1, 2, 3),
  x as (select * from (select *, row_number() over (partition by episode_id, rec order by source_batch desc) as nth from b) where nth = 1),
  p as (select p.*, r.source_batch as rb, r.n_rows as rn, r.status as rs, p.status = 'stopped' and r.episode_id is not null as overridden from x p left join x r on r.episode_id = p.episode_id and r.rec where not p.rec)
  select episode_id, case when overridden then rb else source_batch end as source_batch, case when overridden then rn else n_rows end as n_rows, case when overridden then rs else status end as status, overridden from p""")
def recovery_override(spark, sf):
    """Runs of an episode in a batch, stopped if they have no final row; the last recovery run replaces a stopped last run."""
    d = trace_events(spark, sf).where("source_batch is not null").groupBy("episode_id", "source_batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.when(F.max(F.col("hook_type") == "final"), "ok").otherwise("stopped").alias("status")
    )
    rec = etl.is_recovery(F.col("source_batch"))
    return etl.recovery_override(d.where(~rec), d.where(rec), ["episode_id"], "source_batch")


@query("suite:s chunk n_tasks tasks:s", """with done as (select distinct split_part(episode_id, ':', 1) as suite, split_part(episode_id, ':', 2) as task from trace_events where regexp_matches(episode_id, '\\S')),
  want as (select distinct suite_name as suite, user_task_id as task from episode_contexts where suite_name is not null and regexp_matches(user_task_id, '^user_task_[0-9]+$')),
  miss as (select suite, task, row_number() over (partition by suite order by cast(regexp_extract(task, '([0-9]+)$', 1) as bigint), task) as r from want anti join done using (suite, task))
  select suite, (r - 1) // 10 + 1 as chunk, count(*) as n_tasks, string_agg(task, ',' order by r) as tasks from miss group by 1, 2""")
def missing_tasks_chunks(spark, sf):
    from pyspark.sql import Window

    ev = table(spark, sf, "trace_events").where(F.col("episode_id").rlike(r"\S"))
    done = ev.select("episode_id").distinct().select(F.split_part("episode_id", F.lit(":"), F.lit(1)).alias("suite"), F.split_part("episode_id", F.lit(":"), F.lit(2)).alias("task")).distinct()
    want = table(spark, sf, "episode_contexts").where(F.col("suite_name").isNotNull() & F.col("user_task_id").rlike(r"^user_task_[0-9]+$")).select(F.col("suite_name").alias("suite"), F.col("user_task_id").alias("task")).distinct()
    _, number = etl.natural_task(F.col("task"))
    # a chunk is ten tasks in natural order; ranks are counted per thousand numbers and carried over
    miss = want.join(done, ["suite", "task"], "left_anti").withColumn("no", number).withColumn("t", F.floor(F.col("no") / 1000))
    sizes = miss.groupBy("suite", "t").agg(F.count(F.lit(1)).alias("n"))
    carry = sizes.select("suite", "t", F.coalesce(F.sum("n").over(Window.partitionBy("suite").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c"))
    r = F.row_number().over(Window.partitionBy("suite", "t").orderBy("no", "task")) + F.col("c")
    ranked = miss.join(carry, ["suite", "t"]).withColumn("r", r)
    return ranked.groupBy("suite", (F.floor((F.col("r") - 1) / 10) + 1).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "task"))), lambda x: x["task"]), ",").alias("tasks")
    )


@query("link_id task:s record_id", """with m as (select user_task_id as task, attack_type as cat, min(record_id) as r from episode_contexts where user_task_id is not null and attack_type is not null group by 1, 2), t as (select user_task_id as task, min(record_id) as r from episode_contexts where user_task_id is not null group by 1)
  select link_id, x.task, coalesce(m.r, t.r) as record_id from (select link_id, split_part(episode_id, ':', 2) as task, split_part(episode_id, ':', 3) as cat from episode_links where episode_id is not null) x left join m on m.task = x.task and m.cat = x.cat left join t on t.task = x.task""")
def two_key_metadata_join(spark, sf):
    c = table(spark, sf, "episode_contexts").where("user_task_id is not null")
    both = c.where("attack_type is not null").groupBy(F.col("user_task_id").alias("task"), F.col("attack_type").alias("cat")).agg(F.min("record_id").alias("r1"))
    one = c.groupBy(F.col("user_task_id").alias("task")).agg(F.min("record_id").alias("r2"))
    part = lambda i: F.split_part("episode_id", F.lit(":"), F.lit(i))
    x = table(spark, sf, "episode_links").where("episode_id is not null").select("link_id", part(2).alias("task"), part(3).alias("cat"))
    return x.join(both, ["task", "cat"], "left").join(one, "task", "left").withColumn("record_id", F.coalesce("r1", "r2"))


@query("seq source_batch:s", f"with {S.EV} select seq, source_batch from (select seq, source_batch, row_number() over (partition by source_batch order by seq) as r from ev where source_batch is not null) where r <= 25")
def family_quota_preview(spark, sf):
    return etl.family_quota(trace_events(spark, sf).where("source_batch is not null").select("seq", "source_batch"), "source_batch", "seq", 25)


@query("column_name:s value:s n", f"with {S.EV} select 'hook_type' as column_name, coalesce(hook_type, '') as value, count(*) as n from ev group by 2 union all select 'risk_type', coalesce(risk_type, ''), count(*) from ev group by 2 union all select 't_risk', coalesce(cast(t_risk as varchar), ''), count(*) from ev group by 2")
def value_counts(spark, sf):
    return etl.value_counts(trace_events(spark, sf), ["hook_type", "risk_type", "t_risk"])


@query("source_suite:s id_suite:s n_rows", f"""with {S.EV} select case when contains(lower(coalesce(source_batch, '')), 'slack') then 'slack' when contains(lower(coalesce(source_batch, '')), 'workspace') then 'workspace' else 'unknown' end as source_suite, split_part(episode_id, ':', 1) as id_suite, count(*) as n_rows from ev group by 1, 2""")
def suite_inference(spark, sf):
    return etl.stamped(trace_events(spark, sf)).groupBy("source_suite", "id_suite").agg(F.count(F.lit(1)).alias("n_rows"))


@query("hook_type:s n_args min_limit:d max_limit:d mean_limit:d", f"""with {S.EV}, j as (select hook_type, try_cast(json_extract_string(tool_args, '$.limit') as double) as v from ev) select hook_type, count(v) as n_args, min(v) as min_limit, max(v) as max_limit, avg(v) as mean_limit from j group by 1""")
def numeric_stats(spark, sf):
    d = trace_events(spark, sf).select("hook_type", F.get_json_object("tool_args", "$.limit").try_cast("double").alias("v"))
    return d.groupBy("hook_type").agg(F.count("v").alias("n_args"), F.min("v").alias("min_limit"), F.max("v").alias("max_limit"), F.avg("v").alias("mean_limit"))


# -- audits ---------------------------------------------------------------------------------------


@query("duplicate_keys duplicate_rows", f"with {S.EV}, k as (select count(*) as n from ev group by episode_id, step_id, hook_type) select count(*) as duplicate_keys, coalesce(sum(n), 0) as duplicate_rows from k where n > 1")
def semantic_duplicates(spark, sf):
    return audits.duplicate_rows(trace_events(spark, sf), ["episode_id", "step_id", "hook_type"])


@query("episode_id:s n_batches batches:s", f"with {S.EV} select episode_id, count(distinct source_batch) as n_batches, array_to_string(list_sort(list(distinct source_batch)), ';') as batches from ev where source_batch is not null group by 1 having count(distinct source_batch) > 1")
def cross_batch_episodes(spark, sf):
    return audits.episodes_in_several_batches(trace_events(spark, sf))


@query("source_batch:s n_tasks n_outside n_missing", f"""with {S.EV}, t as (select distinct source_batch, try_cast(regexp_extract(episode_id, 'user_task_([0-9]+)', 1) as bigint) as t from ev)
  select source_batch, count(*) as n_tasks, count(*) filter (where t not between 0 and 99) as n_outside, 100 - count(*) filter (where t between 0 and 99) as n_missing from t where t is not null group by 1""")
def expected_range_audit(spark, sf):
    no = F.regexp_extract("episode_id", "user_task_([0-9]+)", 1).try_cast("long")
    return audits.range_coverage(trace_events(spark, sf), no, 0, 99)


@query("term:s n_events n_final", f"with {S.EV}, t as (select unnest({list(audits.OUTCOME)}) as term) select term, count(*) as n_events, count(*) filter (where hook_type = 'final') as n_final from ev, t where contains(lower(notes), term) group by 1")
def notes_leakage(spark, sf):
    return audits.notes_leakage(trace_events(spark, sf))


@query("dimension:s value:s n_events n_episodes n_large", f"""with {S.EV}, x as (select hook_type, source_batch, episode_id, (octet_length(encode(coalesce(observation, ''))) > 32000)::int as big from ev)
  select 'hook_type' as dimension, coalesce(hook_type, '') as value, count(*) as n_events, count(distinct episode_id) as n_episodes, sum(big) as n_large from x group by 2
  union all select 'source_batch', coalesce(source_batch, ''), count(*), count(distinct episode_id), sum(big) from x group by 2 union all select 'all', '', count(*), count(distinct episode_id), sum(big) from x""")
def trace_event_audit(spark, sf):
    return audits.stream_audit(trace_events(spark, sf))


@query("only_a only_b differing", f"""with {S.EV}, x as (with {_SPLITS.format(seed='20260601')} select * from sp), y as (with {_SPLITS.format(seed='7')} select * from sp)
  select count(*) filter (where y.episode_id is null) as only_a, count(*) filter (where x.episode_id is null) as only_b, count(*) filter (where x.split <> y.split) as differing from x full join y on x.episode_id = y.episode_id""")
def assignment_difference(spark, sf):
    """The assignments of two seeds compared."""
    d = written(trace_events(spark, sf).select("episode_id").distinct(), "episodes")
    return audits.same_assignment(etl.episode_split(d), etl.episode_split(d, seed="7"))


# -- metrics over scored rows ---------------------------------------------------------------------
_SC = f"{S.EV}, sc as (select *, coalesce((step_id <= t_risk)::int, 0) as label, ((seq * 37) % 101) * 0.6::double + case when coalesce(step_id <= t_risk, false) then 40.0::double else 0.0::double end as score from ev)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Trace events with a label (risk still ahead) and a pseudo-score with ties."""
    d = trace_events(spark, sf).select("seq", "episode_id", "step_id", "hook_type", "t_risk", "risk_event", "severity", "source_batch", "self_check", "proposed_tool")
    risky = F.coalesce(F.col("step_id") <= F.col("t_risk"), F.lit(False))
    return d.withColumns({"label": risky.cast("int"), "score": (F.col("seq") * 37) % 101 * F.lit(0.6) + F.when(risky, 40.0).otherwise(0.0)})


_RANK = """, r as (select {by} score, sum(label) as p, sum(1 - label) as n from {src} group by {by} score), c as (select *, sum(p) over (w rows unbounded preceding) as tp, sum(n) over (w rows unbounded preceding) as fp, sum(p) over (v) as pp, sum(n) over (v) as nn
  from r window w as ({part} order by score desc), v as ({part}))"""
_RANKED = "sum(p + n) as n, sum(p) as positives, case when max(pp) * max(nn) > 0 then sum(n * (tp - p / 2.0::double)) / (max(pp) * max(nn)) end as auroc, case when max(nn) > 0 and max(pp) > 0 then sum(p * tp::double / (tp + fp)) / max(pp) end as average_precision"


@query("hook_type:s n positives auroc:d average_precision:d", f"with {_SC} {_RANK.format(by='hook_type,', src='sc', part='partition by hook_type')} select hook_type, {_RANKED} from c group by 1")
def auroc_ap_by_hook(spark, sf):
    return metrics.ranking(scored(spark, sf), ["hook_type"])


_FR = """, fr as (select episode_id, coalesce(min(t_risk), min(step_id) filter (where risk_event), min(step_id) filter (where t_risk - step_id <= 0), min(step_id) filter (where label = 1 and severity > 0)) as first_risk from sc group by 1)"""


@query("n positives auroc:d average_precision:d", f"with {_SC} {_FR}, pr as (select score, case when first_risk is not null then 1 else 0 end as label from sc join fr using (episode_id) where first_risk is null or step_id < first_risk) {_RANK.format(by='', src='pr', part='')} select {_RANKED} from c")
def pre_risk_auroc_ap(spark, sf):
    d = written(scored(spark, sf), "scored")
    d = d.join(metrics.first_risk(d), "episode_id").where(F.col("first_risk").isNull() | (F.col("step_id") < F.col("first_risk")))
    return metrics.ranking(d.select("score", F.col("first_risk").isNotNull().cast("int").alias("label")))


@query("episode_id:s first_risk", f"with {_SC} {_FR} select * from fr")
def first_risk_step(spark, sf):
    return metrics.first_risk(scored(spark, sf))


@query("hook_type:s brier:d f1:d mean_risky:d mean_safe:d", f"""with {_SC} select hook_type, avg((score / 100 - label) * (score / 100 - label)) as brier, coalesce(2.0 * count(*) filter (where score >= 50 and label = 1) / nullif(2.0 * count(*) filter (where score >= 50 and label = 1)
  + count(*) filter (where score >= 50 and label = 0) + count(*) filter (where score < 50 and label = 1), 0), 0.0) as f1, avg(score) filter (where label = 1) as mean_risky, avg(score) filter (where label = 0) as mean_safe from sc group by 1""")
def brier_f1_means(spark, sf):
    return metrics.brier_f1(scored(spark, sf), ["hook_type"])


_ECE = "select sum(n * abs(mp - my)) / sum(n) as ece from (select bin, count(*) as n, avg(p) as mp, avg(label::double) as my from b group by 1)"


@query("ece:d", f"with {_SC}, b as (select score / 100 as p, label, {' + '.join(f'(score / 100 >= {i * 0.1!r}::double)::int' for i in range(1, 10))} as bin from sc) {_ECE}")
def ece_10bin(spark, sf):
    return metrics.ece_fixed(scored(spark, sf))


@query("ece:d", f"with {_SC}, l as (select min(score / 100) as lo, max(score / 100) as hi from sc), b as (select score / 100 as p, label, case when hi = lo then 0 else {' + '.join(f'(score / 100 > lo + (hi - lo) / 5 * {i})::int' for i in range(1, 5))} end as bin from sc, l) {_ECE}")
def ece_cut5(spark, sf):
    return metrics.ece_range(scored(spark, sf))


def _outcomes(thresholds: str) -> str:
    return f"""with {_SC} {_FR}, th as (select unnest([{thresholds}])::double as threshold), hw as (select episode_id, bool_or(coalesce(step_id < first_risk, false)) as has_window from sc join fr using (episode_id) group by 1),
  w as (select episode_id, threshold, step_id as warn_step, hook_type as warn_hook from (select *, row_number() over (partition by episode_id, threshold order by step_id, {S.ORD}, hook_type) as r from sc, th where score >= threshold) where r = 1),
  o0 as (select fr.episode_id, th.threshold, warn_step, warn_hook, has_window, first_risk, first_risk is not null as risky, case when first_risk is not null then first_risk - warn_step end as lead from fr cross join th join hw using (episode_id) left join w on w.episode_id = fr.episode_id and w.threshold = th.threshold),
  o1 as (select *, risky and coalesce(lead > 0, false) as positive, risky and coalesce(lead = 0 and warn_hook = 'pre_step', false) as jit from o0),
  o as (select *, jit and not has_window as no_window_jit, jit and has_window as late_jit, risky and not positive and not (jit and not has_window) as missed, not risky and warn_step is not null as false_alert from o1)"""


_CONT = """threshold, count(*) filter (where risky) as risky_episodes, count(*) filter (where positive) as positive_lead, count(*) filter (where no_window_jit) as no_window_jit, count(*) filter (where late_jit) as late_jit, count(*) filter (where missed) as missed,
  count(*) filter (where missed and has_window) as missed_with_window, count(*) filter (where false_alert) as false_alerts, (count(*) filter (where positive or no_window_jit))::double / nullif(count(*) filter (where risky), 0) as operational_rate,
  (count(*) filter (where positive))::double / nullif(count(*) filter (where risky and has_window), 0) as opportunity_rate, avg(lead) as mean_lead, median(lead) as median_lead, (count(*) filter (where false_alert))::double / nullif(count(*) filter (where not risky), 0) as false_alert_rate"""


@query("threshold:d risky_episodes positive_lead no_window_jit late_jit missed missed_with_window false_alerts operational_rate:d opportunity_rate:d mean_lead:d median_lead:d", f"{_outcomes('40.0, 60.0, 80.0')} select {_CONT} from o group by 1")
def containment_table(spark, sf):
    return metrics.containment(written(scored(spark, sf), "scored"), (40, 60, 80))


_GRID = f"""{_outcomes('20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0')}, ct as (select {_CONT} from o group by 1), ar as (select a as alert, (select count(*) filter (where score >= a)::double / count(*) from sc) as alert_rate from (select unnest([40.0, 45.0, 50.0, 55.0, 60.0, 65.0, 70.0])::double as a)), vr as (select v, (select count(*) filter (where score >= v)::double / count(*) from sc) as verify_or_higher_rate from (select unnest([20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0])::double as v)),
  grid as (select ct.threshold as verify, ar.alert, b.block, ct.* exclude (threshold), ar.alert_rate, vr.verify_or_higher_rate from ct join vr on vr.v = ct.threshold, ar, (select unnest([60.0, 70.0, 80.0, 90.0])::double as block) b where ct.threshold <= ar.alert and ar.alert <= b.block)"""
_GRIDCOLS = "verify:d alert:d block:d risky_episodes positive_lead no_window_jit missed false_alerts operational_rate:d mean_lead:d false_alert_rate:d alert_rate:d verify_or_higher_rate:d"


@query(_GRIDCOLS, f"{_GRID} select * from grid")
def threshold_sweep(spark, sf):
    return metrics.sweep(written(scored(spark, sf), "scored"))


@query(_GRIDCOLS, f"{_GRID} select * from grid order by coalesce(false_alert_rate, 0.0) <= 0.25 desc, operational_rate desc nulls last, mean_lead desc nulls last, alert_rate asc nulls last, verify_or_higher_rate asc nulls last, verify, alert, block limit 1")
def recommended_policy(spark, sf):
    return metrics.recommended(metrics.sweep(written(scored(spark, sf), "scored")))


@query("episode_id:s first_risk warn_step warn_hook:s n_rows pre_risk_rows max_pre_risk_score:d last_pre_risk_score:d reason:s", f"""{_outcomes('35.0')}, pre as (select episode_id, count(*) as n_rows, count(*) filter (where step_id < first_risk) as pre_risk_rows, max(score) filter (where step_id < first_risk) as max_pre_risk_score,
    (max({{'a': step_id, 'b': hook_type, 'c': score}}) filter (where step_id < first_risk)).c as last_pre_risk_score from sc join fr using (episode_id) group by 1)
  select o.episode_id, first_risk, warn_step, warn_hook, n_rows, pre_risk_rows, max_pre_risk_score, last_pre_risk_score, case when not risky then 'safe_episode' when warn_step is null then case when has_window then 'score_never_crossed_before_risk' else 'no_actionable_pre_risk_window' end
    when positive then 'positive_lead_time_contained' when late_jit then 'late_just_in_time_after_missed_window' when no_window_jit then 'just_in_time_contained' else 'score_crossed_only_after_risk' end as reason from o join pre using (episode_id)""")
def episode_diagnostics(spark, sf):
    return metrics.diagnostics(written(scored(spark, sf), "scored"))


@query("slice:s n_rows n_episodes mean_score:d n_alert", f"""with {_SC}, m as (select episode_id, bool_or(v) filter (where known) as hi, bool_and(v) filter (where known) as lo from (select episode_id, hook_type = 'final' and json_extract_string(notes, '$.utility') in ('true', 'false') as known, json_extract_string(notes, '$.utility') = 'true' as v from ev) group by 1),
  x as (select sc.*, case when hi is null then 'unknown' when hi <> lo then 'conflict' when hi then 'true' else 'false' end as u from sc join m using (episode_id)), y as (select *, unnest(['all', u]) as slice from x)
  select slice, count(*) as n_rows, count(distinct episode_id) as n_episodes, avg(score) as mean_score, count(*) filter (where score >= 60) as n_alert from y group by 1""")
def utility_slices(spark, sf):
    d = trace_events(spark, sf)
    u = F.get_json_object("notes", "$.utility")
    meta = etl.episode_metadata(d, (F.col("hook_type") == "final") & F.coalesce(u.isin("true", "false"), F.lit(False)), u == "true")
    bucket = F.when(F.col("status") == "unknown_not_evaluated", "unknown").when(F.col("status") == "conflict", "conflict").when(F.col("value"), "true").otherwise("false")
    x = scored(spark, sf).join(meta.select("episode_id", bucket.alias("u")), "episode_id").select("episode_id", "score", F.explode(F.array(F.lit("all"), F.col("u"))).alias("slice"))
    return x.groupBy("slice").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("episode_id").alias("n_episodes"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= 60).alias("n_alert"))


@query("hook_type:s delta_mean:d delta_alert", f"with {_SC}, s as (select hook_type, seq % 2 as g, avg(score) as m, count(*) filter (where score >= 60) as a from sc group by 1, 2) select x.hook_type, x.m - y.m as delta_mean, x.a - y.a as delta_alert from s x join s y on x.hook_type = y.hook_type and x.g = 1 and y.g = 0")
def ablation_deltas(spark, sf):
    agg = [F.avg("score").alias("m"), F.count_if(F.col("score") >= 60).alias("a")]
    wide = scored(spark, sf).withColumn("setting", F.col("seq") % 2).groupBy("hook_type").pivot("setting", [0, 1]).agg(*agg)
    return wide.select("hook_type", (F.col("1_m") - F.col("0_m")).alias("delta_mean"), (F.col("1_a") - F.col("0_a")).alias("delta_alert"))


@query("policy:s total:d n", f"""with {_SC}, x as (select case when score <= 20 then 'continue' when score <= 40 then 'watch' when score <= 60 then 'verify' when score <= 80 then 'alert' else 'block' end as policy, label, t_risk - step_id as lead from sc)
  select policy, sum(case when policy in ('alert', 'block', 'verify') then case when label = 1 and lead > 0 then 1.0::double when label = 1 then 0.0 else -0.3::double end when policy = 'continue' then case when label = 1 then -1.0::double else 0.2::double end else 0.0 end) as total, count(*) as n from x group by 1""")
def rl_reward(spark, sf):
    d = scored(spark, sf).withColumn("policy", prefix.policy(F.col("score")))
    return d.groupBy("policy").agg(F.sum(metrics.reward(F.col("policy"), F.col("label"), F.col("t_risk") - F.col("step_id"))).alias("total"), F.count(F.lit(1)).alias("n"))


# -- labels ---------------------------------------------------------------------------------------
_Y = "case when lower(trim(binary_risk_label)) in ('1', 'true', 'risky', 'risk') then 1 when lower(trim(binary_risk_label)) in ('0', 'false', 'safe', 'none') then 0 end"
_ERRS = [
    ("y is null", "binary_risk_label"), ("severity_score is null or severity_score < 0 or severity_score > 1", "severity_score"), (f"cat not in ({', '.join(S.q(c) for c in labels.CATEGORIES)})", "risk_category"), ("coalesce(judge_version, '') = ''", "judge_version"),
    ("y = 0 and severity_score <> 0 and not kept", "safe with severity"), ("y = 0 and first_risk_step is not null", "safe with first_risk_step"), ("y = 0 and cat <> 'none' and not kept", "safe with category"),
    ("y = 1 and (first_risk_step is null or first_risk_step < 0)", "risky without first_risk_step"), ("y = 1 and severity_score <= 0", "risky without severity"), ("y = 1 and cat = 'none'", "risky without category"),
]
_LB = f"lb as (select *, {_Y} as y, coalesce(risk_category, '') as cat, coalesce(residual_concern, false) as kept from source_labels)"
_LE = f"le as (select *, coalesce(array_to_string(list_filter([{', '.join(f'case when {c} then {S.q(m)} end' for c, m in _ERRS)}], lambda x: x is not null), '; '), '') as errors from {{0}})"


@query("label_id errors:s", f"with {_LB}, {_LE.format('lb')} select label_id, errors from le where source = 'llm_judge'")
def judge_label_validation(spark, sf):
    return table(spark, sf, "source_labels").where("source = 'llm_judge'").withColumn("errors", labels.label_errors())


_MERGED = f"""with {_LB}, lt as (select * from (select *, row_number() over (partition by episode_id, source order by labelled_at desc nulls last, label_id desc) as r from lb where episode_id is not null and source is not null) where r = 1), {_LE.format('lt')},
  e as (select distinct episode_id from lt), x as (select e.episode_id, j.y as jy, j.severity_score as js, j.first_risk_step as jf, j.cat as jc, j.errors as je, j.label_id is not null as hasj, coalesce(j.errors = '', false) as valid, m.y as my, m.severity_score as ms, m.first_risk_step as mf, m.cat as mc, m.label_id is not null as hasm
    from e left join le j on j.episode_id = e.episode_id and j.source = 'llm_judge' left join le m on m.episode_id = e.episode_id and m.source = 'benchmark_metadata'),
  mg as (select episode_id, case when valid then jy else my end as binary_risk_label, case when valid then js else ms end as severity_score, case when valid then jf else mf end as first_risk_step, nullif(case when valid then jc else mc end, '') as risk_category,
    case when valid then 'llm_judge' when hasm then 'benchmark_metadata' end as label_source, coalesce(array_to_string(list_filter([case when hasj and je <> '' then je end, case when valid and jy = 1 and my = 0 then 'judge risky but metadata safe' end, case when valid and jy = 0 and my = 1 then 'metadata risky but judge safe' end,
      case when not valid and not hasm then 'no usable label source' end], lambda z: z is not null), '; '), '') as conflicts from x)"""


@query("episode_id:s binary_risk_label severity_score:d first_risk_step risk_category:s label_source:s conflicts:s status:s", f"{_MERGED} select *, case when conflicts = '' then 'ok' else 'conflict' end as status from mg")
def label_merge_conflicts(spark, sf):
    return labels.merged(table(spark, sf, "source_labels"))


_PROP = f"{_MERGED}, {S.EV}, pp as (select seq, ev.episode_id, ev.step_id, ev.hook_type, coalesce((binary_risk_label = 1 and ev.step_id <= first_risk_step)::int, 0) as future_risk_label, case when binary_risk_label = 1 and ev.step_id <= first_risk_step then coalesce(mg.severity_score, 0.0) else 0.0 end as future_severity, case when binary_risk_label = 1 and ev.step_id <= first_risk_step then mg.risk_category else 'none' end as risk_category, first_risk_step from ev join mg on mg.episode_id = ev.episode_id)"


def _propagated(spark: SparkSession, sf: str) -> DataFrame:
    return labels.propagated(trace_events(spark, sf).select("seq", "episode_id", "step_id", "hook_type"), labels.merged(table(spark, sf, "source_labels")))


@query("seq episode_id:s step_id hook_type:s future_risk_label future_severity:d severity_weighted_future_risk:d risk_category:s first_risk_step", f"{_PROP} select *, future_risk_label * future_severity as severity_weighted_future_risk from pp")
def label_propagation(spark, sf):
    return _propagated(spark, sf)


@query("errors:s n", f"{_PROP} select case when future_severity < 0 or future_severity > 1 then 'future_severity outside [0, 1]; severity_weighted_future_risk outside [0, 1]' else '' end as errors, count(*) as n from pp group by 1")
def target_validation(spark, sf):
    return _propagated(spark, sf).groupBy(labels.target_errors().alias("errors")).agg(F.count(F.lit(1)).alias("n"))


# -- models (no SQL) ------------------------------------------------------------------------------
def _modelled(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        data = prefix.prefix_dataset(trace_events(spark, sf))
        features = audits.selected_features(data)
        rows = written(data.select("seq", "episode_id", F.col("future_risk_label").alias("label"), *features), "model-rows")
        split = etl.episode_split(rows.select("episode_id"))
        train = rows.join(split.where("split = 'train'").select("episode_id"), "episode_id", "left_semi")
        return models.train_and_score(train, rows, features, kind=kind).select("seq", "label", F.round("score", 6).alias("score"))

    return run


for _kind in ("logistic", "forest", "boosted"):
    QUERIES[f"{_kind}_scores"] = _modelled(_kind)


@query("seq label score:d calibrated:d")
def isotonic_calibration(spark, sf):
    return models.isotonic(scored(spark, sf))


@query("hook_type:s n_events max_score:d")
def online_prefix_scores(spark, sf):
    """The streaming form over the table as a stream that ends; equal to the batch form where one trigger holds an episode."""
    from tracelode.session import scratch
    from tracelode.sources.tables import valid_events
    from tracelode.streaming.online import online_scores

    raw = table(spark, sf, "trace_events")
    path = f"{sf}/trace_events.parquet"
    stream = spark.readStream.schema(raw.schema).parquet(path if _is_dir(spark, path) else f"{sf}/trace_event[s].parquet")
    out, check = scratch(spark, "online"), scratch(spark, "online-state")
    online_scores(valid_events(stream)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("hook_type").agg(F.count(F.lit(1)).alias("n_events"), F.max("risk_score").alias("max_score"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
