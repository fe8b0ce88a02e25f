"""Publication by one writer only, versions as of a time, trees of any depth, headings by layout."""

import random
import threading
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tomeline.functions import text
from tomeline.operators import sections, telemetry, versions
from tomeline.sources import sinks

START = datetime(2024, 1, 1)


def test_of_two_writers_with_one_parent_one_publishes(spark, tmp_path):
    root, tables = f"{tmp_path}/s", {"t": spark.range(3)}
    sinks.write_snapshot(spark, tables, "a", root, None)
    n = sinks.guard_parent(spark, root, "a")  # both have passed the guard
    assert sinks._claim(spark, f"{root}/pointer", n + 1, "b") and not sinks._claim(spark, f"{root}/pointer", n + 1, "c")
    assert sinks.current_snapshot(spark, root) == "b"
    with pytest.raises(sinks.StaleParent):
        sinks.write_snapshot(spark, tables, "d", root, "a")


def test_writers_at_the_same_time(spark, tmp_path):
    root, won, lost = f"{tmp_path}/s", [], []

    def publish(name):
        try:
            sinks.write_snapshot(spark, {"t": spark.range(2)}, name, root, None)
            won.append(name)
        except sinks.StaleParent:
            lost.append(name)

    writers = [threading.Thread(target=publish, args=(f"w{i}",)) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and len(lost) == 3 and sinks.current_snapshot(spark, root) == won[0]
    assert spark.read.parquet(f"{root}/pointer").count() == 1


def test_curated_versions_come_one_after_another(spark, tmp_path):
    cases = spark.createDataFrame([(1,)], "case_id long")
    writers = [threading.Thread(target=sinks.write_curated, args=(cases, cases, f"{tmp_path}/c", f"v{i}")) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/c/pointer").collect()) == [1, 2, 3]


def test_as_of_equals_the_latest_version_by_then(spark):
    rnd = random.Random(4)
    hour = lambda: START + timedelta(hours=rnd.randint(0, 90))  # noqa: E731  several days, many equal times
    v = [(rnd.choice(["hot", "hot", "a", "b"]), i, rnd.random() < 0.5, rnd.choice([hour(), hour(), None])) for i in range(120)]
    asks = [(f"q{i}", f"c{i}", rnd.choice(["hot", "a", "b", "none"]), rnd.choice([hour(), hour(), hour(), None])) for i in range(80)]
    got = versions.as_of(spark.createDataFrame(asks, "answer_id string, chunk_id string, url string, asked_at timestamp"), spark.createDataFrame(v, "url string, version long, is_active boolean, fetched_at timestamp"))
    want = {}
    for q, c, url, at in asks:
        seen = [(f, n) for u, n, _, f in v if u == url and f is not None and at is not None and f <= at]
        if seen:
            want[q, c] = max(seen)[1]
    assert {(r.answer_id, r.chunk_id): r.as_of for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of asks with a row for each bucket


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = telemetry.materialise
    monkeypatch.setattr(telemetry, "materialise", lambda df, name: written.append(name) or real(df, name))
    n = 1_500
    rows = [(1, i, i - 1 if i else None) for i in range(n)] + [(2, 0, 1), (2, 1, 0), (2, 5, 9)]  # a circle, and an absent parent
    got = {(r.trace_id, r.span_id): (r.depth, r.path.count("/")) for r in telemetry.span_tree(spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long")).collect()}
    assert got == {(1, i): (i, i) for i in range(n)} | {(2, 5): (0, 0)}
    assert written.count("pointers") <= 14


def test_quantiles_are_the_observed_nearest_ranks(spark):
    rnd = random.Random(6)
    rows = [("cli", rnd.choice(["part", "checks"]), float(rnd.choice([rnd.randint(0, 40), rnd.randint(0, 10**6)]))) for _ in range(3_000)] + [("web", "part", 5.0), ("web", "checks", None)]
    df = spark.createDataFrame(rows, "source string, name string, duration_ms double")
    want = {}
    for key in {(s, n) for s, n, d in rows if d is not None}:
        values = sorted(d for s, n, d in rows if (s, n) == key and d is not None)
        want[key] = tuple(values[max(1, -(-q * len(values) // 100)) - 1] for q in (50, 90, 95, 99))
    for accuracy in (1_000, 40):  # with a coarse sketch brackets are wider, and the values the same
        got = {(r.source, r["name"]): (r.q5, r.q9, r.q95, r.q99) for r in telemetry.latency_quantiles(df, accuracy=accuracy).collect()}
        assert got == want


def test_plain_headings_are_told_by_the_line_that_follows(spark):
    long = "This line goes on for rather more than fifty-five characters, as a body does."
    page = ["Mixing", long, "Add water", "Short line", "Coverage", long, "n/a", long, "ends with a stop.", long, "lower case", long, "Nine words are too many for a heading here", long, "Contents:", long, "Tools:", long, "Stop:", long]
    rows = [("d", 0, i, t, 10.0, False) for i, t in enumerate(page)] + [("e", 0, 0, "Title", 12.0, False), ("e", 0, 1, "x", 10.0, False), ("e", 0, 2, "y" * 30, 10.0, False), ("f", 0, 0, "only", 10.0, False)]
    got = sections.lines_to_sections(spark.createDataFrame(rows, "doc_id string, page long, line long, text string, size double, bold boolean")).collect()
    heads = {d: [r.heading for r in sorted(got, key=lambda r: r.seq) if r.doc_id == d] for d in "def"}
    assert heads == {"d": ["Mixing", "Coverage", "Contents:", "Tools:"], "e": ["Title"], "f": [""]}


def test_product_names_from_titles_and_urls(spark):
    rows = [("Solo Mortar for Old Walls, Duo | Brand", "", "u", "Solo Mortar"), ("  ", "Duo - | x", "u", "Duo"), ("A", "", "http://h/a/fine%20lime-mortar_2.PDF", "Fine Lime Mortar 2"), (None, None, "http://h/trio/", "Trio"), ("Format: ", "", "u", "Format")]
    df = spark.createDataFrame(rows, "entry string, title string, url string, want string")
    assert [r.got for r in df.select(text.product_name(F.col("entry"), F.col("title"), F.col("url")).alias("got")).collect()] == [r[3] for r in rows]
