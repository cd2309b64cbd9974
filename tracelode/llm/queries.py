"""Queries of the problems on training data for language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import consensus, conversations, encoding, grouped_splits, leakage, mojibake, survivorship
from tracelode.plans import training_core
from tracelode.session import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_conversations(table(spark, sf_dir, "trace_events"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "trace_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "source_labels")).select("episode_id", "binary_risk_label")


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.full_consensus(table(spark, sf_dir, "source_labels"))


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.annotator_reliability(table(spark, sf_dir, "source_labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.surviving_fields(table(spark, sf_dir, "episode_contexts"), table(spark, sf_dir, "source_batches"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden_records(table(spark, sf_dir, "episode_contexts"), table(spark, sf_dir, "source_batches"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.related_groups(table(spark, sf_dir, "trace_events"), table(spark, sf_dir, "episode_links"))


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.grouped_splits(table(spark, sf_dir, "trace_events"), table(spark, sf_dir, "episode_links"))


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the split keeps its shares and its groups whole."""
    splits = written(p5_split(spark, sf_dir), "split")
    return grouped_splits.split_balance(splits, table(spark, sf_dir, "trace_events"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_column(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_conversations": p1_conversations,
        "p3_found": p3_found, "p3_consensus": p3_consensus, "p3_annotators": p3_annotators,
        "p4_found": p4_found, "p4_records": p4_records,
        "p5_found": p5_found, "p5_split": p5_split, "p5_balance": p5_balance,
        "p7_ids": p7_ids,
        "p8_found": p8_found, "p8_items": p8_items,
        "p9_found": p9_found, "p9_texts": p9_texts,
    }


_HOOK = "case regexp_replace(lower(hook_type), '[\\s_\\-]+', '', 'g') when 'prestep' then 'pre_step' when 'poststep' then 'post_step' when 'checkpoint' then 'checkpoint' when 'final' then 'final' end"

P1 = f"""
with e as (select episode_id, step_id, {_HOOK} as hook,
    coalesce(regexp_matches(observation, '[\\p{{L}}\\p{{N}}]'), false) as obs, coalesce(regexp_matches(plan_summary, '[\\p{{L}}\\p{{N}}]'), false) as plan
  from trace_events where regexp_matches(episode_id, '\\S')),
r as (select * from e where step_id is not null and hook is not null),
s as (select episode_id, step_id, bool_or(hook = 'pre_step') as pre, bool_or(hook = 'post_step') as post, bool_or(hook = 'post_step' and obs) as reply, bool_or(hook = 'final' and obs) as fin
  from r group by 1, 2),
g as (select episode_id, count(*) filter (where step_id >= 1) as n, coalesce(max(step_id) filter (where step_id >= 1), 0) as last, bool_or(post and not pre) as orphan,
    bool_or(pre and not reply) as missing, bool_or(fin) as fin from s group by 1),
a as (select episode_id, bool_or(obs or plan) as words, bool_or(step_id is null or hook is null) as bad from e group by 1),
x as (select a.episode_id, words, bad or coalesce(orphan, false) or coalesce(n < last, false) as broken, coalesce(missing, false) or not coalesce(fin, false) as missing from a left join g using (episode_id))
select episode_id, 'empty' as reason from x where not words
union all select episode_id, 'broken' from x where words and broken
union all select episode_id, 'missing_reply' from x where words and missing
"""

P1_TURNS = f"""
with {training_core.CASES}, bad as (select distinct episode_id from ({P1.strip()})),
d as (select e.*, {_HOOK} as hook, {training_core.AT} as moment from trace_events e where regexp_matches(episode_id, '\\S') and episode_id not in (select episode_id from bad)
  and coalesce(ingest_id not in (select ingest_id from cases where nth > 1), true)),
w as (select *, case hook when 'pre_step' then 0 when 'post_step' then 1 when 'checkpoint' then 2 else 3 end as ord, case when regexp_matches(user_instruction, '[\\p{{L}}\\p{{N}}]') then user_instruction end as asked,
  concat_ws(chr(10), case when regexp_matches(plan_summary, '[\\p{{L}}\\p{{N}}]') then plan_summary end, proposed_tool) as plan from d),
s as (select *, last_value(asked ignore nulls) over (partition by episode_id order by step_id, ord, moment nulls last, ingest_id rows between unbounded preceding and 1 preceding) as said from w),
t as (select *, 0 as k, 'user' as role, asked as text from s where asked is not null and asked is distinct from said
  union all select *, 1, case hook when 'checkpoint' then 'user' when 'post_step' then 'tool' else 'assistant' end, case hook when 'pre_step' then plan when 'post_step' then observation else coalesce(observation, plan_summary) end from s)
select episode_id, row_number() over (partition by episode_id order by step_id, ord, moment nulls last, ingest_id, k) as turn_no, step_id, hook as hook_type, role, text from t where regexp_matches(text, '[\\p{{L}}\\p{{N}}]')
"""

_PART = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), '(^|[a-z])0+([0-9])', '\\1\\2', 'g')"
_NONE = "('null', 'none', '(none)', 'n/a', 'na', 'nan', 'nil', 'unknown', 'missing', 'tbd', '?', '-', '')"


def _own(i: int, column: str, last: str) -> str:
    raw = f"case when {_PART.format(f'parts[{i}]')} <> '' then parts[{i}] end"
    other = f"case when lower(trim({column}, ' \t\r\n')) not in {_NONE} then {column} end"
    return _PART.format(f"coalesce({raw}, {other}{last})")


_KEYED = f"""split as (select c.*, t.trust, string_split(replace(replace(replace(replace(replace(lower(episode_id), '%3a', ':'), '%2f', '/'), '%7c', '|'), '/', ':'), '|', ':'), ':') as raw_parts
    from episode_contexts c left join (select source_batch, max(trust) as trust from source_batches group by 1) t using (source_batch)),
  parted as (select *, case when len(raw_parts) > 4 then raw_parts[2:5] else raw_parts end as parts from split),
  keyed as (select *, {_own(1, 'suite_name', '')} || ':' || {_own(2, 'user_task_id', '')} || ':' || {_own(3, 'attack_type', ", 'none'")} || ':' || {_own(4, 'injection_task_id', ", 'none'")} as key from parted)"""
P4 = f"""
with {_KEYED},
g as (select key, min(record_id) as group_id from keyed where key is not null group by 1 having count(*) >= 2),
f as (select key, record_id, trust, updated_at, unnest(['user_task_id', 'prompt', 'agent_name', 'sandbox_id']) as field_name, unnest([user_task_id, prompt, agent_name, sandbox_id]) as value from keyed where key is not null)
select group_id, field_name, record_id from (
  select g.group_id, f.field_name, f.record_id, row_number() over (partition by g.group_id, field_name order by trust desc nulls last, updated_at desc nulls last, record_id) as nth
  from f join g using (key) where value is not null and lower(trim(value, ' \t\r\n')) not in {_NONE}) where nth = 1
"""

P4_RECORDS = f"""
with {_KEYED},
g as (select key, min(record_id) as group_id from keyed where key is not null group by 1 having count(*) >= 2),
f as (select key, record_id, trust, updated_at, unnest(['user_task_id', 'prompt', 'agent_name', 'sandbox_id']) as field_name, unnest([user_task_id, prompt, agent_name, sandbox_id]) as value from keyed where key is not null),
b as (select key, field_name, value from (select *, row_number() over (partition by key, field_name order by trust desc nulls last, updated_at desc nulls last, record_id) as nth from f
  where value is not null and lower(trim(value, ' \t\r\n')) not in {_NONE}) where nth = 1)
select group_id, {', '.join(f"max(value) filter (where field_name = '{n}') as {n}" for n in survivorship.FIELDS)} from g left join b using (key) group by 1
"""

P5 = """
with recursive ids as (select distinct episode_id from trace_events where regexp_matches(episode_id, '\\S')),
l as (select episode_id as a, linked_episode_id as b from episode_links where regexp_matches(episode_id, '\\S') and regexp_matches(linked_episode_id, '\\S')),
k as (select id, case when len(string_split(id, ':')) >= 3 then string_split(id, ':')[1] || ':' || string_split(id, ':')[2] else id end as node
  from (select episode_id as id from ids union select a from l union select b from l)),
e as (select distinct x.node as a, y.node as b from l join k x on x.id = l.a join k y on y.id = l.b where x.node <> y.node),
u as (select a, b from e union select b, a from e),
reach as (select node as a, node as b from (select distinct node from k) union select r.a, u.b from reach r join u on u.a = r.b),
root as (select a as node, min(b) as root from reach group by 1),
m as (select i.episode_id, root from ids i join k on k.id = i.episode_id join root using (node)),
g as (select root, min(episode_id) as group_id from m group by 1 having count(*) >= 2)
select episode_id, group_id from m join g using (root)
"""


#: What every split has to come to.
P5_BALANCE = "select unnest(['train', 'validation', 'test']) as split, true as share_kept, true as labels_kept, cast(0 as bigint) as groups_cut"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_conversations": P1_TURNS, "p4_found": P4, "p4_records": P4_RECORDS, "p5_found": P5, "p5_balance": P5_BALANCE}
