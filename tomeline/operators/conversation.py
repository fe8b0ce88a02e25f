"""Conversation turns folded into facts, sessions and state.

facts: conv_id, case_id, turn, slot, value, provenance (stated, observed, carried,
denied), and optionally nth (order in the turn) and keep.  turns: conv_id, turn, role, text, at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_FACTS, TRANSCRIPT, CUT, SESSIONS = 24, 8, 400, 512


#: What a slot knows: its value with origin, turn and status (active or conflicting; all null: nothing), the
#: values given up and those seen beside it.
FOLDED = "struct<value:string,provenance:string,turn:bigint,status:string,superseded:array<string>,conflicting:array<string>>"
_FIELDS = ("value", "provenance", "turn", "status", "superseded", "conflicting")


def _with(state, **changed):
    return F.struct(*(changed.get(n, state[n]).alias(n) for n in _FIELDS)).cast(FOLDED)


def _step(a, x):
    """One fact x put to what a slot knows: see merge_facts."""
    held, person = a["value"].isNotNull(), a["provenance"].isin("stated", "carried")
    same, nothing = a["value"] == x["value"], F.lit(None)
    fact = {"value": x["value"], "provenance": x["provenance"], "turn": x["turn"], "status": F.lit("active")}
    none = F.array().cast("array<string>")
    older = F.array_append(a["superseded"], a["value"])
    beside = _with(a, conflicting=F.array_append(a["conflicting"], x["value"]))
    return (
        F.when(x["provenance"] == "denied", F.when(held & (x["value"].isNull() | same), _with(a, value=nothing, provenance=nothing, turn=nothing, status=nothing, superseded=older, conflicting=none)).otherwise(a))
        .when(~held, _with(a, **fact))
        .when(x["provenance"] == "stated", F.when(same & person, _with(a, **fact)).otherwise(_with(a, **fact, superseded=older, conflicting=none)))
        .when((x["provenance"] == "observed") & person, F.when(same, a).when(a["turn"] == x["turn"], beside).otherwise(_with(beside, status=F.lit("conflicting"))))
        .when((x["provenance"] == "carried") & person, a)
        .otherwise(_with(a, **fact))
    )


def fold_fact(state: dict | None, fact: dict) -> dict:
    """The same for one fact as Python values, for folds that go on from a stored state."""
    a = state or {"value": None, "provenance": None, "turn": None, "status": None, "superseded": [], "conflicting": []}
    x = {"value": fact["value"], "provenance": fact["provenance"], "turn": fact["turn"], "status": "active"}
    person, same = a["provenance"] in ("stated", "carried"), a["value"] == x["value"]
    if x["provenance"] == "denied":
        if a["value"] is None or x["value"] is not None and not same:
            return a
        return {"value": None, "provenance": None, "turn": None, "status": None, "superseded": [*a["superseded"], a["value"]], "conflicting": []}
    if a["value"] is None:
        return a | x
    if x["provenance"] == "stated":
        return a | x if same and person else a | x | {"superseded": [*a["superseded"], a["value"]], "conflicting": []}
    if not person:
        return a | x
    if x["provenance"] == "observed" and not same:
        beside = a | {"conflicting": [*a["conflicting"], x["value"]]}
        return beside if a["turn"] == x["turn"] else beside | {"status": "conflicting"}
    return a


def counted_facts(facts: DataFrame) -> DataFrame:
    """The facts that count, with nth: at most MOST_FACTS of a turn, in the order given by nth
    (without that column: by slot, value and provenance); of the turn that opens a later case
    those with keep (without that column: those that aren't carried).  A fact without a value is
    a denial of whatever the slot holds, or nothing."""
    f = facts if "nth" in facts.columns else facts.withColumn("nth", F.lit(0))
    keep = F.coalesce(F.col("keep"), F.lit(True)) if "keep" in facts.columns else F.col("provenance") != "carried"
    f = f.withColumn("n", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("nth", "slot", "value", "provenance")))
    f = f.withColumn("opens", (F.col("case_id") > 0) & (F.col("turn") == F.min("turn").over(W.partitionBy("conv_id", "case_id"))))
    f = f.where((F.col("n") <= MOST_FACTS) & (~F.col("opens") | keep) & (F.col("value").isNotNull() | (F.col("provenance") == "denied")))
    return f.select("conv_id", "case_id", "slot", F.col("turn").cast("long").alias("turn"), F.col("n").cast("long").alias("nth"), "provenance", "value")


def merge_facts(facts: DataFrame) -> DataFrame:
    """conv_id, case_id, slot, value, provenance, turn, status, superseded, conflicting.

    A fold by turn and order in the turn.  A stated value beats all: restated, it is refreshed;
    changed, the old one is superseded and conflicts are settled.  An observed value fills a gap
    or replaces what no person said; against a person's word of the same turn it is noted beside
    it, against an older one the slot is conflicting.  A carried value, a person's of an earlier
    turn, fills gaps and replaces observed ones.  A denial retires a matching value, and leaves a
    gap.  A new case starts empty, but for what the turn that opens it keeps (counted_facts).
    A slot of a case is a group, so groups are as small as a dialogue."""
    g = counted_facts(facts).groupBy("conv_id", "case_id", "slot").agg(F.array_sort(F.collect_list(F.struct("turn", "nth", "provenance", "value"))).alias("x"))
    none = F.struct(*(F.lit(None).alias(n) for n in _FIELDS[:4]), F.array().alias("superseded"), F.array().alias("conflicting")).cast(FOLDED)
    return g.select("conv_id", "case_id", "slot", F.aggregate("x", none, _step).alias("f")).select("conv_id", "case_id", "slot", "f.*")


def case_boundaries(turns: DataFrame, opener: str, correction: str) -> DataFrame:
    """conv_id, turn, case_id: a case opens where a user's turn has an opener and no
    earlier correction marker; the first turn is case 0."""
    low = F.lower("text")
    opens = (F.col("role") == "user") & F.regexp_like(low, F.lit(opener)) & ~F.regexp_like(low, F.lit(correction)) & (F.col("turn") > 0)
    return turns.select("conv_id", "turn", F.sum(opens.cast("long")).over(W.partitionBy("conv_id").orderBy("turn")).alias("case_id"))


def carried_slots(turns: DataFrame, slots: list[str]) -> DataFrame:
    """Each turn with the latest value so far of every slot."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", *[F.last(s, ignorenulls=True).over(w).alias(s) for s in slots])


def transcript(turns: DataFrame, n: int = TRANSCRIPT, cut: int = CUT) -> DataFrame:
    """conv_id, lines: the last n turns, assistant texts cut, oldest first."""
    t = turns.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("r") <= n)
    line = F.concat(F.col("role"), F.lit(": "), F.when(F.col("role") == "assistant", F.substring("text", 1, cut)).otherwise(F.col("text")))
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def sessionize(turns: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """conv_id, turn, session: an idle gap of the given length closes a session."""
    w = W.partitionBy("conv_id").orderBy("at", "turn")
    new = F.coalesce(F.col("at") >= F.lag("at").over(w) + F.expr(f"interval {idle}"), F.lit(True))
    return turns.withColumn("new", new.cast("long")).select("conv_id", "turn", (F.sum("new").over(w) - 1).alias("session"))


def active_sessions(sessions: DataFrame, most: int = SESSIONS) -> DataFrame:
    return sessions.orderBy(F.desc("touched"), "session_id").limit(most)


def resume_pending(turns: DataFrame) -> DataFrame:
    """conv_id, turn, resumes: the question that an answering turn re-asks: the one
    before, if that was asked back.  turns: conv_id, turn, text, asks_back, answers."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.when(F.col("answers") & F.coalesce(F.lag("asks_back").over(w), F.lit(False)), F.lag("text").over(w)).alias("resumes"))


def active_facts(folded: DataFrame) -> DataFrame:
    """Settled values that a later turn may take over."""
    return folded.where("status = 'active'").select("conv_id", "case_id", "slot", "value", "provenance")


def unsettled(folded: DataFrame) -> DataFrame:
    """Slots on which a person and a picture of another turn disagree."""
    return folded.where("status = 'conflicting'").select("conv_id", "case_id", "slot")


def drop_observations(facts: DataFrame) -> DataFrame:
    """The facts as if no image had been seen."""
    return facts.where("provenance != 'observed'")


def recall_state(asks: DataFrame, folded: DataFrame) -> DataFrame:
    """conv_id, slot, kind, value: what the person said about a slot: stated,
    retracted, assumed (not by the person) or not stated.  asks: conv_id, slot."""
    j = asks.join(folded, ["conv_id", "slot"], "left")
    kind = F.when(F.col("provenance") == "stated", "stated").when(F.col("value").isNull() & (F.size(F.coalesce("superseded", F.array().cast("array<string>"))) > 0), "retracted").when(F.col("value").isNotNull(), "assumed").otherwise("not stated")
    return j.select("conv_id", "slot", kind.alias("kind"), F.when(F.col("provenance") == "stated", F.col("value")).alias("value"))
