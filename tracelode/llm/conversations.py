"""Rebuilding conversations from trace rows, and naming those that are broken, empty or lack replies.

Rows are partitioned by episode and a block of step numbers, put in order of step and hook inside
each block, and folded by a finite-state automaton. A block holds a bounded number of symbols (at
most ``BLOCK`` steps with one symbol per hook kind, after repeated rows were merged before the
shuffle), so an episode with a third of all rows is spread over many tasks and nothing unbounded is
ever collected. The automaton never looks across a step's edge except for gaps, so the blocks of an
episode combine by sums and maxima.

States within a step: ``0`` nothing asked, ``1`` asked (a pre_step was read), ``2`` answered (a
post_step with words followed). Symbols: the four hook kinds with or without words in the
observation, and unreadable rows.

==========  =========================  ==========================================
state       symbol                     next state, output
==========  =========================  ==========================================
any         unreadable                 same state, output *bad*
any         first symbol of a step     close the step before: in 1 output *missing*
0           pre_step                   1
0           post_step                  0, output *orphan*
1           post_step with words       2
any         final with words           same state, output *finished*
otherwise                              same state
==========  =========================  ==========================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.readings import has_words, hook_ord, is_blank, read_hook, read_instant
from tracelode.operators.deliveries import keep_one
from tracelode.session import written

BLOCK = 1024


def _block(step: Column) -> Column:
    return F.floor(step / BLOCK).cast("long")


def symbols(events: DataFrame) -> DataFrame:
    """One row per episode, step and read hook kind; repeated rows merge before the shuffle."""
    return (
        events.where(~is_blank(F.col("episode_id")))
        .select(
            "episode_id",
            F.col("step_id").cast("long").alias("step_id"),
            read_hook(F.col("hook_type")).alias("hook"),
            has_words(F.col("observation")).alias("obs"),
            has_words(F.col("plan_summary")).alias("plan"),
        )
        .groupBy("episode_id", "step_id", "hook")
        .agg(F.max("obs").alias("obs"), F.max("plan").alias("plan"))
    )


_START = dict(step=None, state=0, steps=0, last=0, bad=False, orphan=False, missing=False, finished=False, words=False)


def _start() -> Column:
    kinds = {"step": "long", "state": "int", "steps": "long", "last": "long"}
    return F.struct(*[F.lit(v).cast(kinds.get(k, "boolean")).alias(k) for k, v in _START.items()])


def _advance(s: Column, x: Column) -> Column:
    """One transition of the automaton in the module's table."""
    readable = x["step_id"].isNotNull() & x["hook"].isNotNull()
    opens = readable & ~s["step"].eqNullSafe(x["step_id"])
    before = F.when(opens, F.lit(0)).otherwise(s["state"])
    pre, post, final = (F.coalesce(x["hook"] == h, F.lit(False)) & readable for h in ("pre_step", "post_step", "final"))
    state = F.when(pre & (before == 0), F.lit(1)).when(post & (before == 1) & x["obs"], F.lit(2)).otherwise(before)
    numbered = opens & (x["step_id"] >= 1)
    return F.struct(
        F.when(readable, x["step_id"]).otherwise(s["step"]).alias("step"),
        state.cast("int").alias("state"),
        (s["steps"] + F.when(numbered, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("steps"),
        F.when(numbered, F.greatest(s["last"], x["step_id"])).otherwise(s["last"]).alias("last"),
        (s["bad"] | ~readable).alias("bad"),
        (s["orphan"] | (post & (before == 0))).alias("orphan"),
        (s["missing"] | (opens & (s["state"] == 1))).alias("missing"),
        (s["finished"] | (final & x["obs"])).alias("finished"),
        (s["words"] | x["obs"] | x["plan"]).alias("words"),
    )


def run_automaton(syms: DataFrame) -> DataFrame:
    """Per episode the automaton's outputs over all its blocks."""
    turn = F.struct("step_id", hook_ord(F.col("hook")).alias("ord"), "hook", "obs", "plan")
    blocks = syms.groupBy("episode_id", _block(F.col("step_id")).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    folded = blocks.select("episode_id", F.aggregate("turns", _start(), _advance).alias("s"))
    return folded.groupBy("episode_id").agg(
        F.sum("s.steps").alias("steps"),
        F.max("s.last").alias("last"),
        F.max("s.bad").alias("bad"),
        F.max("s.orphan").alias("orphan"),
        F.max(F.col("s.missing") | (F.col("s.state") == 1)).alias("missing"),
        F.max("s.finished").alias("finished"),
        F.max("s.words").alias("words"),
    )


def dropped_conversations(events: DataFrame) -> DataFrame:
    """``episode_id, reason``: every episode that has to be left out, one row per reason.

    ``empty``: no words in any plan or observation (no other reason is given then). ``broken``: an
    unreadable row, a gap in the step numbers from 1 to the last, or a post_step without pre_step.
    ``missing_reply``: a pre_step without a post_step with words, or no final row with words. Rows
    without episode are ignored; an empty table gives no rows; columns beyond those read are ignored.
    """
    runs = run_automaton(symbols(events))
    broken = F.col("bad") | F.col("orphan") | (F.col("steps") < F.col("last"))
    missing = F.col("missing") | ~F.col("finished")
    reasons = F.when(~F.col("words"), F.array(F.lit("empty"))).otherwise(
        F.array_compact(F.array(F.when(broken, F.lit("broken")), F.when(missing, F.lit("missing_reply"))))
    )
    return runs.select("episode_id", F.explode(reasons).alias("reason"))


def conversations(events: DataFrame) -> DataFrame:
    """The sound conversations: ``episode_id, turn_no, step_id, hook_type, role, text`` in order.

    A row yields up to three turns: the user's instruction (only where it differs from the last one that
    had words, however far back) or checkpoint, the assistant's plan and proposed tool or final answer,
    the tool's observation. Superfluous deliveries are removed first, attempts at a step stay in order of
    their instants. ``turn_no`` starts at 1 and has no gaps.
    """
    bad = dropped_conversations(events).select("episode_id").distinct()
    texts = ("user_instruction", "plan_summary", "proposed_tool", "observation")
    rows = (
        keep_one(events)
        .where(~is_blank(F.col("episode_id")))
        .join(bad, "episode_id", "left_anti")
        .select(
            "episode_id", _block(F.col("step_id")).alias("block"), "step_id", read_hook(F.col("hook_type")).alias("hook"), read_instant(F.col("timestamp")).alias("at"), "ingest_id", *texts,
        )
        .withColumn("mark", F.when(has_words(F.col("user_instruction")), F.md5("user_instruction")))
    )
    rows = written(rows, "sound-rows")
    place = [F.col("step_id"), hook_ord(F.col("hook")).alias("ord"), F.col("at").isNull().alias("undated"), F.col("at"), F.col("ingest_id")]
    by_block = Window.partitionBy("episode_id", "block")
    in_block = by_block.orderBy("step_id", hook_ord(F.col("hook")), F.col("at").asc_nulls_last(), "ingest_id")
    earlier = Window.partitionBy("episode_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what was asked last before a block: one hash per block, so that no task needs an episode's rows
    asked = rows.groupBy("episode_id", "block").agg(F.max(F.when(F.col("mark").isNotNull(), F.struct(*place, "mark")))["mark"].alias("m"))
    asked = asked.select("episode_id", "block", F.last("m", ignorenulls=True).over(earlier).alias("asked"))
    said = F.coalesce(F.last("mark", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.col("asked"))
    hook = F.col("hook")
    plan = F.concat_ws("\n", F.when(has_words(F.col("plan_summary")), F.col("plan_summary")), F.col("proposed_tool"))

    def turn(cond: Column, role: str, text: Column) -> Column:
        return F.when(cond & has_words(text), F.struct(F.lit(role).alias("role"), text.alias("text")))

    turns = F.array_compact(
        F.array(
            turn(F.col("mark").isNotNull() & ~F.col("mark").eqNullSafe(F.col("said")), "user", F.col("user_instruction")),
            turn(hook == "checkpoint", "user", F.coalesce("observation", "plan_summary")),
            turn(hook == "pre_step", "assistant", plan),
            turn(hook == "post_step", "tool", F.col("observation")),
            turn(hook == "final", "assistant", F.coalesce("observation", "plan_summary")),
        )
    )
    per_row = rows.join(asked, ["episode_id", "block"]).withColumn("said", said).withColumn("turns", turns)
    upto = in_block.rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_row.select("episode_id", "block", "step_id", "hook", "turns", F.coalesce(F.sum(F.size("turns")).over(upto), F.lit(0)).alias("before_in_block"))
    numbered = written(numbered, "numbered-turns")
    blocks = numbered.groupBy("episode_id", "block").agg(F.sum(F.size("turns")).alias("n"))
    offsets = blocks.select("episode_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (
        numbered.join(offsets, ["episode_id", "block"])
        .select("episode_id", "step_id", F.col("hook").alias("hook_type"), (F.col("before") + F.col("before_in_block")).alias("base"), F.posexplode("turns").alias("k", "turn"))
        .select("episode_id", (F.col("base") + F.col("k") + 1).alias("turn_no"), "step_id", "hook_type", "turn.role", "turn.text")
    )
