"""Literal cases for what the tables don't show."""

import pytest
from pyspark.sql import functions as F

from tomeline.functions import text
from tomeline.operators import boundary, chunking, conversation, embeddings, labelling, retrieval, sections, telemetry, verification, versions
from tomeline.sources import readers, sinks
from tomeline.streaming import streams


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<html><head><title>no</title></head><body><header>Site</header><article><p>{'An article that stays. ' * 3}</p></article><footer>no</footer></body>", "Site" + ("An article that stays. " * 3).rstrip()),
        (f"<p>{'Text around a form. ' * 3}</p><form>a<script>x</script>secret field</form >", ("Text around a form. " * 3).rstrip()),
    ],
)
def test_html_sections_end_elements_at_their_own_tags(spark, html, text):
    got = sections.html_sections(spark.createDataFrame([(1, html)], "doc_id long, html string")).where("seq >= 0").collect()
    assert [(r.heading, r.text) for r in got] == [("", text)]


def test_html_sections_split_at_headings_and_drop_what_is_no_content(spark):
    body = "word " * 30
    html = f"<head><title>t</title></head><script>x('</p>')</script><h1>Solo</h1><p>{body}</p><h2>Mixing &amp; use</h2><p>{body}</p><h2>Short</h2><p>tiny</p><form>{body}</form><h2>Cover</h2><ul><li>{body}</li></ul>"
    got = rows(sections.html_sections(spark.createDataFrame([(1, html)], "doc_id long, html string")), "seq")
    assert [(r[1], r[2]) for r in got] == [(1, "Solo"), (2, "Mixing & use"), (4, "Cover")]
    assert sections.html_sections(spark.createDataFrame([(1, None)], "doc_id long, html string")).count() == 0


def test_hazard_block_lasts_until_a_figure(spark):
    t = "Keep this\nHazard statements\nH315\nH319\nCoverage 2 mm\nafter"
    got = sections.strip_hazard(spark.createDataFrame([(1, 0, "h", t)], "doc_id long, seq long, heading string, text string"), "hazard", "^hazard").first()
    assert got.text == "Keep this\nCoverage 2 mm\nafter"


def test_caveats_keep_the_first_of_equal_sentences(spark):
    t = "Do not apply below 5 degrees. Mix well today now. Do not apply below 5 degrees."
    df = spark.createDataFrame([(1, 0, "h", t), (1, 1, "i", t.upper())], "doc_id long, seq long, heading string, text string")
    assert rows(sections.caveats(df, [("temperature", "below [0-9]+ degrees")], "zzz").select("type", "heading"), "type") == [("temperature", "h")]


def test_chunks_carry_short_sections_and_pack_bullets(spark):
    long = "x" * 1000
    bullets = "Lead\n- " + "a" * 900 + "\n- " + "b" * 900 + "\n- " + "c" * 900
    df = spark.createDataFrame([(1, 0, "A", "short"), (1, 1, "B", long), (1, 2, "C", bullets), (1, 3, "D", "end"), (2, 0, "Only", "tiny")], "doc_id long, seq long, heading string, text string")
    got = rows(chunking.chunk_sections(df).select("doc_id", "chunk_index", "heading", F.length("content")), "doc_id", "chunk_index")
    assert got[0] == (1, 0, "A / B", 1006)
    assert [g[2] for g in got if g[0] == 1] == ["A / B", "C", "C"] or len([g for g in got if g[0] == 1]) == 4
    assert got[-1] == (2, 0, "Only", 4)


def test_text_functions(spark):
    r = one(spark, a="1.5 m 2  at 8 ° C, 5 %\n\n\n\nx").select(text.clean_text(F.col("a"))).first()[0]
    assert r == "1.5 m2 at 8 °C, 5%\n\nx"
    assert one(spark, a="the 3/4/2021").select(text.iso_date(F.col("a"), F.lit("x"))).first()[0] == "2021-04-03"


def test_boundary_order_of_rules(spark):
    rules = spark.createDataFrame([("include", "/a", None, 0), ("exclude", "/a/x", "no x", 0), ("exact", "/a/b", "one page", 0)], "kind string, rule string, reason string, nth int")
    urls = spark.createDataFrame([(u,) for u in ("http://h/a/b", "http://h/a/x1", "http://h/a/c?q", "http://h/z")], "url string")
    assert rows(boundary.corpus_boundary(urls, rules), "url") == [("http://h/a/b", False, "one page"), ("http://h/a/c?q", True, None), ("http://h/a/x1", False, "no x"), ("http://h/z", False, boundary.OUTSIDE)]


def test_empty_sitemap_fails(spark):
    assert boundary.sitemap_urls(one(spark, xml="<loc> a </loc>")).collect()[0].url == "a"
    with pytest.raises(Exception, match="empty sitemap"):
        boundary.sitemap_urls(one(spark, xml="<urlset/>")).collect()


def test_embed_isolates_bad_texts(spark):
    inner = embeddings.letter_embedder(4)

    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return inner(texts)

    df = spark.createDataFrame([(str(i), "bad" if i == 7 else f"t{i}") for i in range(20)], "key string, text string").coalesce(1)
    got = embeddings.embed_missing(df, embed, 4).collect()
    assert [r.key for r in got if r.error] == ["7"] and sum(r.embedding is not None for r in got) == 19


def test_stated_facts_beat_others_and_denials_retract(spark):
    f = [(1, 0, 0, "s", "brick", "observed"), (1, 0, 1, "s", "stone", "stated"), (1, 0, 2, "s", "brick", "observed"), (1, 0, 3, "s", "lime", "carried"), (2, 0, 0, "s", "a", "stated"), (2, 0, 1, "s", "a", "denied")]
    got = {r.conv_id: r for r in conversation.merge_facts(spark.createDataFrame(f, "conv_id long, case_id long, turn long, slot string, value string, provenance string")).collect()}
    assert (got[1].value, got[1].superseded, got[1].conflicting) == ("stone", ["brick"], ["brick"])
    assert got[2].value is None and got[2].superseded == ["a"]


def test_topk_prefers_newer_and_caps_documents(spark):
    p = [(i, f"d{i // 4}", i % 4, "p", 6, "guide", "public", f"2024-01-0{i // 4 + 1}", "s", f"c{i}", [1.0, 0.0]) for i in range(8)]
    passages = spark.createDataFrame(p, "passage_id long, canonical_url string, chunk_index long, product string, authority long, document_type string, audience string, source_date string, section string, content string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], ["public"], "")], "qid long, embedding array<float>, audiences array<string>, product string")
    assert [r.passage_id for r in retrieval.topk(q, passages, 5, 3).orderBy("rank").collect()] == [4, 5, 6, 0, 1]
    assert retrieval.topk(q.withColumn("audiences", F.array(F.lit("staff"))), passages).count() == 0
    assert retrieval.abstain(q, retrieval.topk(q, passages).limit(0)).first().below


def test_relations_need_the_same_polarity(spark):
    c = spark.createDataFrame([(1, 0, "Use duo over solo [1].", "Never put duo over solo."), (2, 0, "Use duo over solo [1].", "Put duo over solo.")], "aid long, seq long, sentence string, cited string")
    assert rows(verification.check_relations(c, ["duo", "solo"]).select("aid", "note"), "aid") == [(1, "duo layer solo")]


def test_denied_slots(spark):
    v = spark.createDataFrame([("substrate", "brick", "brick", False)], "slot string, value string, term string, ask_only boolean")
    q = spark.createDataFrame([(1, "It is not a brick wall"), (2, "not a brick, well, brick it is"), (3, "brick")], "qid long, text string")
    assert rows(labelling.denied_slots(q, v), "qid") == [(1, "substrate", "brick")]


def test_quantiles_are_observed_values(spark):
    s = spark.createDataFrame([("cli", "turn", float(i)) for i in range(1, 11)], "source string, name string, duration_ms double")
    assert telemetry.latency_quantiles(s).first().q5 == 5.0


def test_delta_keeps_what_failed_or_is_protected(spark):
    served = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "url string, content_hash string")
    fetched = spark.createDataFrame([("a", "1", "1"), ("b", "2", "2"), ("e", "1", None)], "url string, content_hash string, read_hash string")
    protected = spark.createDataFrame([("c",)], "url string")
    want = [("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "removed"), ("e", "failed")]
    assert rows(versions.classify_delta(served, fetched, protected, False), "url") == want
    assert dict(rows(versions.classify_delta(served, fetched, protected, True), "url"))["d"] == "unchanged"


def test_snapshot_pointer_moves_last_and_guards_its_parent(spark, tmp_path):
    root = str(tmp_path / "kb")
    sinks.write_snapshot(spark, {"t": spark.range(3)}, "s1", root, None)
    assert sinks.current_snapshot(spark, root) == "s1"
    with pytest.raises(sinks.StaleParent):
        sinks.write_snapshot(spark, {"t": spark.range(4)}, "s2", root, None)
    assert sinks.read_snapshot(spark, root, ["t"])["t"].count() == 3


def test_authored_documents_are_quarantined_with_a_reason(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"canonical_url":"u1","audience":"staff","sections":[{"heading":"h","text":"x"}],"approved":true,"approved_by":"me"}')
    (tmp_path / "b.json").write_text('{"canonical_url":"u2","audience":"all","sections":[]}')
    (tmp_path / "c.json").write_text("{not json")
    valid, bad = readers.read_authored(spark, str(tmp_path), require_approval=True)
    assert [r.canonical_url for r in valid.collect()] == ["u1"]
    assert sorted(r.reason for r in bad.collect()) == ["unknown audience", "unreadable"]


def test_release_cases_and_expectations(spark, tmp_path):
    (tmp_path / "current.json").write_text('{"bundle":"r.json"}')
    (tmp_path / "r.json").write_text('{"log":{"fetched":[{"url":"a","content_hash":"1","version":1}],"skipped":[{"url":"b","reason":"x"}],"errors":[]},"ledger":{"a":{"content_hash":"1","version":1}}}')
    fetched, skipped, errors, ledger = readers.read_release(spark, str(tmp_path))
    assert (fetched.count(), skipped.count(), errors.count(), ledger.first().url) == (1, 1, 0, "a")
    (tmp_path / "2024-01-02").mkdir()
    (tmp_path / "2024-01-02" / "x.json").write_text('{"case_id":"1","expert_diagnosis":"d"}')
    (tmp_path / "2024-01-02" / "y.json").write_text("{")
    assert [str(r.day) for r in readers.read_cases(spark, str(tmp_path)).collect()] == ["2024-01-02"]
    (tmp_path / "e.json").write_text('[{"id":"s1","question":"q","expect":{"path_in":["a","b"],"refused":true}}]')
    assert rows(readers.read_expectations(spark, str(tmp_path / "e.json")), "key") == [("s1", "path_in", ["a", "b"]), ("s1", "refused", ["true"])]


def test_rule_tables_skip_comments(spark):
    j = one(spark, json='{"topics":{"_note":["x"],"a":["p1","p2"]},"slots":{"s":{"v":["t"],"_w":["u"]}}}')
    topics, slots = readers.rule_tables(spark, j)
    assert rows(topics.select("topic", "pattern"), "pattern") == [("a", "p1"), ("a", "p2")] and rows(slots, "term") == [("s", "v", "t")]


def test_append_once_replaces_its_own_batch(spark, tmp_path):
    write = streams.append_once(str(tmp_path / "spans"))
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "spans")).count() == 5


def test_answer_log_never_stores_text(spark, tmp_path):
    df = spark.sql("select 1L answer_id, cast(null as timestamp) asked_at, cast(null as string) source, '' snapshot_id, 'secret' text")
    sinks.append_answer_log(df, str(tmp_path / "log"))
    r = spark.read.parquet(str(tmp_path / "log")).first()
    assert "text" not in r.asDict() and r.source == "unknown" and r.snapshot_id is None and r.asked_at


def test_span_tree_goes_down_to_the_last_level(spark):
    from tomeline.operators import telemetry

    rows = [(1, i, i - 1 if i else None) for i in range(12)] + [(2, 5, 77), (3, 1, 2), (3, 2, 1)]
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in telemetry.span_tree(spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long")).collect()}
    assert got == {(1, i): (i, "/".join(map(str, range(i + 1)))) for i in range(12)} | {(2, 5): (0, "5")}


def test_appended_rows_are_not_held_by_the_driver(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    got = streams.run_available(stream, "appended")
    assert sorted(r.id for r in got.collect()) == list(range(50)) and got.columns == ["id"]
    assert len(got.inputFiles()) > 0 and not spark.catalog.tableExists("appended")


def test_curated_versions_carry_version_and_time(spark, tmp_path):
    root = str(tmp_path / "curated")
    for v in ("v1", "v2"):
        sinks.write_curated(spark.range(2).withColumnRenamed("id", "case_id"), spark.range(1), root, v, "2024-01-01 00:00:00")
    got, statistics = sinks.read_curated(spark, root)
    assert [(r.version, str(r.curated_at)) for r in got.collect()] == [("v2", "2024-01-01 00:00:00")] * 2 and statistics.count() == 1
    assert spark.read.parquet(f"{root}/pointer").count() == 2  # nothing is replaced
    with pytest.raises(LookupError):
        sinks.read_snapshot(spark, str(tmp_path / "none"), ["t"])


def test_spans_get_defaults(spark, tmp_path):
    df = spark.sql("select 1L span_id, cast(null as string) status, ' ' source, cast(null as timestamp) started_at union all select 2L, 'error', 'cli', timestamp'2024-01-02 00:00:00'")
    write = streams.append_spans(str(tmp_path), "2024-01-01 00:00:00")
    write(df, 0)
    write(df, 0)  # the same batch again
    got = sorted((r.span_id, r.status, r.source, str(r.started_at)) for r in spark.read.parquet(str(tmp_path)).collect())
    assert got == [(1, "ok", "unknown", "2024-01-01 00:00:00"), (2, "error", "cli", "2024-01-02 00:00:00")]


def test_alternatives_near_a_product_compare(spark):
    aliases = spark.createDataFrame([("duro", "Duro"), ("solo", "Solo")], "alias string, product string")
    q = spark.createDataFrame([("a", "Duro or Solo, what is drier?"), ("b", "Can Duro go on old brick or stone?"), ("c", "Compare Duro and Solo"), ("d", "Compare Duro and Solo: which one?")], "qid string, text string")
    got = {r.qid: (r.compares, r.topic_product, r.compared) for r in labelling.compares_products(q, aliases).collect()}
    assert got == {"a": (True, None, []), "b": (False, "Duro", []), "c": (True, None, ["Duro", "Solo"]), "d": (True, None, [])}


def test_answers_fail_on_property_and_scope(spark):
    answers = spark.createDataFrame([(1, "q", "Duro is thin [1].", ["thick"], ["Solo"])], "aid long, question string, text string, terms array<string>, asked array<string>")
    evidence = spark.createDataFrame([(1, 1, "Duro", "s", "Duro is thin.")], "aid long, marker long, product string, section string, content string")
    got = {r.check for r in verification.verify(answers, evidence, ["duro", "solo"], spark.createDataFrame([("x",)], "name string"), []).collect()}
    assert {6, 7} <= got


def test_retention_keeps_the_newest_ids(spark):
    s = spark.range(1000).selectExpr("id % 700 as span_id", "timestamp'2024-01-10 00:00:00' - make_dt_interval(cast(id % 20 as int)) as started_at")
    got = sorted(r.span_id for r in telemetry.retain(s, "2024-01-10 00:00:00", 14, 101).collect())
    want = sorted((r.span_id for r in s.where("started_at >= timestamp'2023-12-27 00:00:00'").collect()))[-101:]
    assert got == want


def test_pieces_lose_no_characters_that_spell_their_place(spark):
    """F.transform hands a function of two parameters the place as well, and trim() would take it for what to trim."""
    said = "One here. 1st day ends on 1. 2 of them, not 12.  3 \n 43 are there 4"
    assert one(spark, t=said).select(text.sentences(F.col("t"))).first()[0] == ["One here.", "1st day ends on 1.", "2 of them, not 12.", "3", "43 are there 4"]
    assert one(spark, t="0 coats\n- 1 tin\n- 2 tins 2").select(chunking.split_on_bullets(F.col("t"))).first()[0] == ["0 coats\n", "- 1 tin\n", "- 2 tins 2"]
    claim = verification.claims(spark.createDataFrame([(1, "0 is none: 1 is one; 2 is 2.")], "aid long, text string")).first()
    assert claim.clauses == ["0 is none", "1 is one", "2 is 2."]


def test_caveat_keeps_the_figure_it_starts_with(spark):
    parts = spark.createDataFrame([(1, 0, "Use", "A first sentence of some length. 1 coat of primer is the least there is.")], "doc_id long, seq long, heading string, text string")
    got = sections.caveats(parts, [("coats", "coat")], "contact us")
    assert [r.sentence for r in got.collect()] == ["1 coat of primer is the least there is."]
