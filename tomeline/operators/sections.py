"""Text to sections: pages and page-line tables become (doc_id, seq, heading, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

LEAST_BODY, LEAST_TOTAL, LEAD = 40, 300, 8
#: Elements that are no text; each ends with its own end tag, at the first one.
NOT_SHOWN = ("script", "style", "noscript", "form", "svg", "head", "nav", "footer")
_NOT_SHOWN = "(?s)<!--.*?-->|" + "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in NOT_SHOWN)


def _plain(c: Column) -> Column:
    return t.clean_text(t.unescape(F.regexp_replace(F.regexp_replace(c, "<br */?>", "\n"), "<[^>]*>", "")))


def html_sections(pages: DataFrame, skip_headings=(), tail: str | None = None) -> DataFrame:
    """doc_id, seq, heading, text of pages(doc_id, html).

    Scripts, styles, forms and drawings go; a section starts at each heading of
    level 1 to 5; text after the tail marker and skipped headings are left out; so
    are bodies under 40 characters.  A page with under 300 characters in all gets a
    lead of up to 8 paragraphs of over 60 characters in front."""
    body = F.regexp_replace("html", _NOT_SHOWN, "")
    if tail:
        body = F.substring_index(body, tail, 1)
    p = pages.select("doc_id", body.alias("body"))
    parts = p.select("doc_id", F.posexplode(F.split(F.regexp_replace("body", "<h[1-5][^>]*>", t.MARK), t.MARK)).alias("seq", "part"))
    two = F.split("part", "</h[1-5]>", 2)  # heading and rest, or all of it as the rest
    s = parts.select("doc_id", F.col("seq").cast("long").alias("seq"), F.array_size(two).alias("n"), two.alias("two"))
    s = s.select("doc_id", "seq", _plain(F.when(F.col("n") == 2, F.col("two")[0]).otherwise("")).alias("heading"), _plain(F.element_at("two", -1)).alias("text"))
    s = s.where((F.length("text") >= LEAST_BODY) & ~F.lower("heading").isin(*[h.lower() for h in skip_headings], "\x00"))
    total = s.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total"))
    paragraphs = F.filter(F.transform(F.regexp_extract_all("body", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), _plain), lambda x: F.length(x) > 60)
    lead = p.join(total, "doc_id", "left").where(F.coalesce("total", F.lit(0)) < LEAST_TOTAL).select("doc_id", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("heading"), F.concat_ws("\n", F.slice(paragraphs, 1, LEAD)).alias("text")).where("text != ''")
    return s.unionByName(lead)


def faq_sections(pages: DataFrame) -> DataFrame:
    """One section for each question (dt) and its answer (dd)."""
    pair = "(?s)<dt[^>]*>(.*?)</dt>\\s*<dd[^>]*>(.*?)</dd>"
    x = F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(pair), F.lit(1)).alias("q"), F.regexp_extract_all("html", F.lit(pair), F.lit(2)).alias("a"))).alias("seq", "x")
    return pages.select("doc_id", x).select("doc_id", F.col("seq").cast("long").alias("seq"), _plain(F.col("x.q")).alias("heading"), _plain(F.col("x.a")).alias("text"))


# What a cell prints that has nothing to report, and the longest heading.
PLACEHOLDERS, HEADING = ("none", "nil", "n/a", "na", "tbc", "tba", "-", "–", "—"), 60


def heading_like(line: Column) -> Column:
    """Whether a line has the shape of a heading: 3 to 60 characters and at most eight words, with a
    letter, a capital or a figure first, no mark of a sentence last, and no placeholder."""
    c = F.trim(line)
    ends = F.regexp_like(c, F.lit("[.,;:]$")) & ~c.endswith("s:")
    shape = F.length(c).between(3, HEADING) & F.regexp_like(c, F.lit("^[A-Z0-9]")) & F.regexp_like(c, F.lit("[A-Za-z]")) & (F.size(F.regexp_extract_all(c, F.lit("[^ \\t]+"), F.lit(0))) <= 8)
    return shape & ~ends & ~F.lower(c).isin(*PLACEHOLDERS)


def lines_to_sections(lines: DataFrame, share: float = 0.6, body_line: int = 55) -> DataFrame:
    """doc_id, seq, heading, text from lines(doc_id, page, line, text, size, bold).

    Furniture: the same short line on max(3, share of the pages) pages or more.
    Body size: the size with the most characters.  A heading has the shape of one, and is
    larger than the body, or bold, or stands before a line of over body_line characters that
    has not.  Headings start sections; a document without any has one section for each page."""
    ahead = F.coalesce(F.lead("text").over(W.partitionBy("doc_id").orderBy("page", "line")), F.lit(""))
    lines = lines.withColumn("leads", (F.length(ahead) > body_line) & ~heading_like(ahead))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = lines.where(F.length("text") <= 90).groupBy("doc_id", "text").agg(F.count_distinct("page").alias("on"))
    furniture = seen.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))).select("doc_id", "text")
    kept = lines.join(furniture, ["doc_id", "text"], "left_anti")
    by_size = kept.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    body = by_size.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", "size")).alias("body"))
    head = heading_like(F.col("text")) & ((F.col("size") > F.col("body") + 0.4) | (F.col("bold") & (F.col("size") >= F.col("body") - 0.2)) | F.col("leads"))
    k = kept.join(body, "doc_id").withColumn("head", head)
    order = W.partitionBy("doc_id").orderBy("page", "line")
    k = k.withColumn("heads", F.sum(F.col("head").cast("long")).over(order)).withColumn("all_heads", F.max("heads").over(W.partitionBy("doc_id")))
    k = k.withColumn("seq", F.when(F.col("all_heads") > 0, F.col("heads")).otherwise(F.col("page")))
    g = k.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("page", "line", "head", "text"))).alias("x"))
    heading = F.coalesce(F.try_element_at(F.filter("x", lambda r: r["head"]), F.lit(1))["text"], F.lit(""))
    return g.select("doc_id", "seq", heading.alias("heading"), F.concat_ws("\n", F.transform(F.filter("x", lambda r: ~r["head"]), lambda r: r["text"])).alias("text"))


def strip_hazard(sections: DataFrame, hazard: str, label: str, figure: str = "[0-9] ?(mm|kg|m2|litres|%)") -> DataFrame:
    """Sections without hazard text: hazard headings go; a label line opens a block
    that lasts until a line with a figure or of 60 characters or more; empty ones go."""
    lines = sections.where(~F.regexp_like(F.lower("heading"), F.lit(hazard))).select("doc_id", "seq", "heading", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    has_figure = F.regexp_like("t", F.lit(figure))
    mark = F.when(F.regexp_like(F.lower("t"), F.lit(label)) & ~has_figure, True).when(has_figure | (F.length("t") >= 60), False)
    inside = F.last(mark, ignorenulls=True).over(W.partitionBy("doc_id", "seq").orderBy("line"))
    kept = lines.withColumn("inside", F.coalesce(inside, F.lit(False))).where("not inside")
    g = kept.groupBy("doc_id", "seq", "heading").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("x"))
    return g.select("doc_id", "seq", "heading", F.concat_ws("\n", F.transform("x", lambda r: r["t"])).alias("text")).where(F.trim("text") != "")


def harvest_names(links: DataFrame, skip: str, longest: int = 60) -> DataFrame:
    """Names in link texts that start with a capital: first spelling by page and
    place, without regard to case.  links: page_id, nth, text."""
    c = links.where((F.length("text") <= longest) & F.regexp_like("text", F.lit("^[A-Z]")) & ~F.regexp_like(F.lower("text"), F.lit(skip)))
    return c.groupBy(F.lower("text").alias("key")).agg(F.min_by("text", F.struct("page_id", "nth")).alias("name"))


def contact_details(pages: DataFrame) -> DataFrame:
    """First phone number and opening hours line of each page."""
    phone = F.regexp_extract("text", "(\\+?[0-9][0-9 ()-]{7,}[0-9])", 1)
    hours = F.regexp_extract("text", "(?i)((?:mon|tue|wed|thu|fri)[a-z]*[^\\n]{0,60}[0-9]{1,2}[:.][0-9]{2}[^\\n]{0,20})", 1)
    return pages.select("doc_id", F.nullif(phone, F.lit("")).alias("phone"), F.nullif(F.trim(hours), F.lit("")).alias("hours"))


def extraction_quality(sections: DataFrame) -> DataFrame:
    """clean (3 sections or more), partial, flat or failed (under 200 characters) for each document."""
    g = sections.groupBy("doc_id").agg(F.count_if(F.col("heading") != "").alias("headed"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return g.select("doc_id", "n", "chars", F.when(F.col("chars") < 200, "failed").when(F.col("headed") >= 3, "clean").when(F.col("headed") >= 1, "partial").otherwise("flat").alias("quality"))


def caveats(sections: DataFrame, rules: list[tuple[str, str]], skip: str) -> DataFrame:
    """doc_id, type, sentence, heading: sentences of 16 to 319 characters that match a
    rule (first rule wins) and aren't skipped; each sentence once a document, first kept."""
    s = sections.select("doc_id", "seq", "heading", F.posexplode(t.sentences(F.col("text"))).alias("nth", "s"))
    s = s.withColumn("s", F.trim(F.regexp_replace("s", "^[-*•·–— ]+", "")))
    s = s.where((F.length("s") > 15) & (F.length("s") < 320) & ~F.regexp_like(F.lower("s"), F.lit(skip)))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        kind = F.when(F.regexp_like(F.lower("s"), F.lit(pattern)), name).otherwise(kind)
    s = s.withColumn("type", kind).where("type is not null")
    return s.groupBy("doc_id", F.lower("s").alias("key")).agg(F.min(F.struct("seq", "nth", "type", F.col("s").alias("sentence"), "heading")).alias("x")).select("doc_id", "x.type", "x.sentence", "x.heading")
