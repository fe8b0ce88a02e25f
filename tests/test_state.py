"""Facts folded in batches and live."""

import random
from datetime import datetime, timedelta

import pytest

from tomeline.operators import conversation as cv
from tomeline.streaming import streams as st

FACT = "conv_id long, case_id long, turn long, nth long, slot string, value string, provenance string, keep boolean"
TURN = f"conv_id long, case_id long, turn long, at timestamp, opens boolean, facts {st.TURN_FACTS}"
START = datetime(2024, 1, 1, 10)


def folded(spark, *facts):
    rows = [(1, 0, turn, nth, "s", value, provenance, None) for nth, (turn, value, provenance) in enumerate(facts)]
    r = cv.merge_facts(spark.createDataFrame(rows, FACT)).first()
    return r.value, r.provenance, r.status, r.superseded, r.conflicting


@pytest.mark.parametrize(
    ("facts", "known"),
    [
        ([(0, "a", "stated"), (1, "a", "stated")], ("a", "stated", "active", [], [])),
        ([(0, "a", "stated"), (1, "b", "stated")], ("b", "stated", "active", ["a"], [])),
        ([(0, "a", "observed"), (1, "b", "observed")], ("b", "observed", "active", [], [])),
        ([(0, "a", "observed"), (1, "a", "stated")], ("a", "stated", "active", ["a"], [])),
        ([(0, "a", "observed"), (1, "b", "carried")], ("b", "carried", "active", [], [])),
        ([(0, "a", "stated"), (0, "b", "observed")], ("a", "stated", "active", [], ["b"])),  # the same turn: noted beside it
        ([(0, "a", "stated"), (1, "b", "observed")], ("a", "stated", "conflicting", [], ["b"])),  # an older word: unsettled
        ([(0, "a", "carried"), (1, "b", "observed")], ("a", "carried", "conflicting", [], ["b"])),
        ([(0, "a", "stated"), (1, "b", "observed"), (2, "a", "stated")], ("a", "stated", "active", [], ["b"])),
        ([(0, "a", "stated"), (1, "b", "observed"), (2, "c", "stated")], ("c", "stated", "active", ["a"], [])),
        ([(0, "a", "stated"), (1, "b", "denied")], ("a", "stated", "active", [], [])),
        ([(0, "a", "stated"), (1, "a", "denied"), (2, "b", "observed")], ("b", "observed", "active", ["a"], [])),
        ([(0, "a", "stated"), (1, None, "denied")], (None, None, None, ["a"], [])),
        ([(0, "a", "denied")], (None, None, None, [], [])),
        ([(0, "b", "observed"), (0, "a", "stated")], ("a", "stated", "active", ["b"], [])),  # order in the turn counts
    ],
)
def test_each_rule_of_the_fold(spark, facts, known):
    assert folded(spark, *facts) == known


def test_a_new_case_starts_with_what_it_keeps(spark):
    rows = [(1, 0, 0, 0, "s", "a", "stated", None), (1, 1, 1, 0, "t", "x", "stated", True), (1, 1, 1, 1, "s", "a", "carried", False), (1, 1, 2, 0, "u", "y", "carried", False)]
    got = {(r.case_id, r.slot): r.value for r in cv.merge_facts(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {(0, "s"): "a", (1, "t"): "x", (1, "u"): "y"}
    without = spark.createDataFrame(rows, FACT).drop("keep", "nth")
    assert {(r.case_id, r.slot) for r in cv.merge_facts(without).collect()} == {(0, "s"), (1, "t"), (1, "u")}


def test_at_most_so_many_facts_of_a_turn(spark):
    rows = [(1, 0, 0, i, f"s{i:02}", "a", "stated", None) for i in range(cv.MOST_FACTS + 5)]
    assert cv.merge_facts(spark.createDataFrame(rows, FACT)).count() == cv.MOST_FACTS


def some_turns(rnd, conv, n):
    kinds = ["stated", "observed", "carried", "denied"]
    fact = lambda: (rnd.choice("st"), rnd.choice(["a", "b", None]), rnd.choice(kinds), rnd.choice([True, False, None]))
    return [(conv, i // 5, i, START + timedelta(minutes=i), i % 5 == 0 and i > 0, [fact() for _ in range(rnd.randint(0, 3))]) for i in range(n)]


def as_facts(turns):
    return [(c, case, turn, nth, *f) for c, case, turn, _, _, facts in turns for nth, f in enumerate(facts)]


def rows_of(df):
    return {(r.conv_id, r.case_id, r.slot): (r.value, r.provenance, r.turn, r.status, r.superseded, r.conflicting) for r in df.collect()}


def test_stream_equals_batch_whatever_the_order_and_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(7)
    turns = [t for conv in (1, 2, 3) for t in some_turns(rnd, conv, 10)]
    rnd.shuffle(turns)  # all within the lateness
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    keys = ["conv_id", "case_id", "slot"]
    for i in range(3):
        spark.createDataFrame(turns[i::3], TURN).coalesce(1).write.parquet(f"{source}/f{i}")
        stream = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        table = st.run_upserts(st.session_facts(stream, late="30 minutes"), keys, path)
    want = rows_of(cv.merge_facts(spark.createDataFrame(as_facts(turns), FACT)))
    live = table.read(spark).where("not expired")
    assert rows_of(live) == want and live.count() == len(want)
    assert rows_of(table.compact(spark, f"{tmp_path}/small").read(spark)) == want


def test_idle_slots_end_late_turns_are_left_out_and_a_new_one_starts_empty(spark, tmp_path):
    source, path, keys = f"{tmp_path}/in", f"{tmp_path}/out", ["conv_id", "case_id", "slot"]
    minute = lambda m: START + timedelta(minutes=m)
    fact = lambda v, kind="stated": [("s", v, kind, True)]
    steps = [
        [(1, 0, 0, minute(0), False, fact("a"))],
        [(9, 0, 0, minute(120), False, fact("z"))],  # the watermark passes the idle time of conversation 1
        [(1, 0, 1, minute(1), False, fact("late")), (9, 0, 1, minute(121), False, fact("y"))],
        [(1, 0, 2, minute(122), False, fact("b", "observed"))],
    ]
    seen = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, TURN).coalesce(1).write.parquet(f"{source}/f{i}")
        stream = spark.readStream.schema(TURN).parquet(f"{source}/*")
        table = st.run_upserts(st.session_facts(stream), keys, path)
        seen.append({r.conv_id: (r.value, r.superseded, r.expired) for r in table.read(spark).collect()})
    assert seen[0][1] == ("a", [], False)
    assert seen[1][1] == ("a", [], True) and seen[2][1] == ("a", [], True)
    assert seen[3][1] == ("b", [], False) and seen[3][9] == ("y", ["z"], False)
    sessions = {r.conv_id: (r.cases, r.slots, r.expired) for r in st.session_rows(table.read(spark)).collect()}
    assert sessions == {1: (1, 1, False), 9: (1, 1, False)}


SPAN = "span_id long, name string, started_at timestamp, duration_ms double, session_id long, status string, source string, hit boolean, top_score double, path string, failed array<string>"


def test_windowed_measures_have_close_quantiles_and_late_rows_are_counted(spark, tmp_path):
    rnd = random.Random(9)
    at = lambda m: START + timedelta(minutes=m)
    span = lambda i, m, ms=None, name="generation": (i, name, at(m), ms, 1, "ok", "cli", None, None, None, None)
    times = [float(rnd.randint(0, 10**6)) for _ in range(4_000)]
    first = [span(i, rnd.randint(0, 59), ms) for i, ms in enumerate(times)]
    first += [span(0, 1, 5.0), (5_000, "checks", at(5), 1.0, 1, "error", "cli", None, None, None, ["check 1", "check 1", "odd"]), (5_001, "retrieval", at(5), 1.0, 1, "ok", "cli", None, 0.3, None, None), (5_002, "part", at(5), 1.0, 1, "ok", "cli", None, None, "refuse", None)]
    steps = [first, [span(6_000, 180, 1.0)], [span(6_001, 5, 1.0), span(6_002, 185, 3.0)]]
    source, path, late = f"{tmp_path}/in", f"{tmp_path}/out", []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, SPAN).coalesce(1).write.parquet(f"{source}/f{i}")
        stream = spark.readStream.schema(SPAN).parquet(f"{source}/*")
        table = st.run_upserts(st.metrics_stream(stream, ["compose", "refuse"]), ["start", "source", "name"], path)
        late.append(table.late_rows)
    assert late == [0, 0, 1]
    got = {(r.start.hour - START.hour, r["name"]): r for r in table.read(spark).collect()}
    r = got[0, "generation"]
    assert (r.n, got[3, "generation"].n, got[3, "generation"].total_ms) == (4_000, 2, 4.0)  # a repeated id counts once
    times.sort()
    for q, value in zip((0.5, 0.9, 0.95, 0.99), r.quantiles):
        assert abs(times.index(value) + 1 - q * len(times)) <= len(times) / 1_000 + 1
    assert got[0, "checks"].runs == got[0, "checks"].errors == 1 and got[0, "checks"].failures[:2] == [2, 0]
    assert got[0, "retrieval"].scores[:2] == [1, 1] and got[0, "part"].paths == [0, 1]
