"""Sections to chunks, and the identity and statistics of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK

SHORT, TARGET, LARGEST, HEADING = 120, 1800, 4000, 70
BULLET = "(?m)^[ \\t]*(?:[-–—•*·]|[a-z]\\)|[0-9]{1,2}\\.)[ \\t]+"


def split_on_bullets(c: Column) -> Column:
    """Pieces of a text: the prose before, then one for each bullet; whole with fewer than two."""
    marked = F.regexp_replace(c, BULLET, MARK + "$0")
    pieces = F.filter(F.transform(F.split(marked, MARK), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(F.regexp_count(c, F.lit(BULLET)) >= 2, pieces).otherwise(F.array(F.trim(c)))


def _pack(pieces: Column, joiner: str) -> Column:
    """Greedy packing of pieces to TARGET characters; no piece is cut."""
    start = F.array().cast("array<string>")
    fits = lambda acc, p: (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) + 1 <= TARGET)
    last = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    return F.aggregate(pieces, start, lambda acc, p: F.when(fits(acc, p), F.concat(last(acc), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(joiner), p)))).otherwise(F.concat(acc, F.array(p))))


def section_chunks(text: Column) -> Column:
    """Chunks of one section: whole up to TARGET, else bullets packed, else whole up
    to LARGEST, else blank-line pieces packed."""
    bullets = split_on_bullets(text)
    blocks = F.filter(F.transform(F.split(text, "\\n[ \\t]*\\n"), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(F.length(text) <= TARGET, F.array(text)).when(F.size(bullets) >= 2, _pack(bullets, "\n")).when(F.length(text) <= LARGEST, F.array(text)).otherwise(_pack(blocks, "\n\n"))


def chunk_sections(sections: DataFrame) -> DataFrame:
    """doc_id, chunk_index, heading, content from sections(doc_id, seq, heading, text).

    Sections under SHORT characters are carried onto the next one, headings joined;
    what is left at the end goes to the last chunk.  Order-dependent, so it is a fold
    over a document's sections; a document is one row."""
    s = sections.where(F.trim("text") != "")
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "heading", F.trim("text").alias("text")))).alias("s"))
    kind = "struct<carry_h:string,carry_t:string,out:array<struct<heading:string,text:string>>>"
    start = F.struct(F.lit("").alias("carry_h"), F.lit("").alias("carry_t"), F.array().cast("array<struct<heading:string,text:string>>").alias("out")).cast(kind)

    def heads(a, b):
        both = F.concat_ws(" / ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
        return F.when(F.length(both) <= HEADING, both).otherwise(F.concat(F.when(a != "", a).otherwise(b), F.lit(" …")))

    def step(acc, x):
        text = F.when(acc["carry_t"] != "", F.concat(acc["carry_t"], F.lit("\n"), x["text"])).otherwise(x["text"])
        heading = F.when(acc["carry_t"] != "", heads(acc["carry_h"], x["heading"])).otherwise(x["heading"])
        short = F.length(text) < SHORT
        made = F.transform(section_chunks(text), lambda c: F.struct(heading.alias("heading"), c.alias("text")))
        return F.struct(
            F.when(short, heading).otherwise("").alias("carry_h"),
            F.when(short, text).otherwise("").alias("carry_t"),
            F.when(short, acc["out"]).otherwise(F.concat(acc["out"], made)).alias("out"),
        ).cast(kind)

    def finish(acc):
        n = F.size(acc["out"])
        last = F.try_element_at(acc["out"], F.lit(-1))
        merged = F.concat(F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["heading"].alias("heading"), F.concat(last["text"], F.lit("\n"), acc["carry_t"]).alias("text"))))
        alone = F.array(F.struct(acc["carry_h"].alias("heading"), acc["carry_t"].alias("text")))
        return F.when(acc["carry_t"] == "", acc["out"]).when(n > 0, merged).otherwise(alone)

    return g.select("doc_id", F.posexplode(F.aggregate("s", start, step, finish)).alias("i", "c")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "c.heading", F.col("c.text").alias("content"))


def paragraph_chunks(df: DataFrame) -> DataFrame:
    """Blank-line pieces; empty ones are skipped, but keep their number."""
    p = df.select("doc_id", F.posexplode(F.split("text", "\\n[ \\t]*\\n")).alias("i", "p"))
    return p.where(F.trim("p") != "").select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.concat(F.lit("Paragraph "), (F.col("i") + 1).cast("string")).alias("section"), F.trim("p").alias("content"))


def chunk_id(url: Column, version: Column, index: Column) -> Column:
    return F.concat(url, F.lit("#v"), version.cast("string"), F.lit("-"), index.cast("string"))


def embedding_text(product: Column, section: Column, content: Column) -> Column:
    prefix = F.concat_ws(" — ", F.nullif(product, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(prefix == "", content).otherwise(F.concat(prefix, F.lit("\n"), content))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"))
