"""Column functions for text.  ASCII classes only, so that results don't depend on the engine."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "\x01"  # put between pieces before splitting


def clean_text(c: Column) -> Column:
    """Plain spaces, no zero-width characters, units joined to their figures, at most one empty line."""
    c = F.translate(c, " ​‌‍﻿", " ")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, "([0-9]) ?m ([23])([^0-9]|$)", "$1 m$2$3")
    c = F.regexp_replace(c, "([0-9]) ?° ?([CF])", "$1 °$2")
    c = F.regexp_replace(c, "([0-9]) %", "$1%")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    return F.trim(c)


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Composed forms of letters and marks (Unicode NFC), which no built-in function gives; to be put
    before clean_text where texts may hold decomposed ones."""
    return c.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def squash(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " ")))


def sentences(c: Column) -> Column:
    """Array of the sentences of a text: it is split after . ! ? and at line breaks."""
    marked = F.regexp_replace(F.regexp_replace(c, "([.!?])[ \\t\\r\\n]+", "$1" + MARK), "\\n+", MARK)
    return F.filter(F.transform(F.split(marked, MARK), lambda x: F.trim(x)), lambda s: s != "")


def words(c: Column) -> Column:
    """Array of the lower-cased words (ASCII letters and digits, and all beyond ASCII)."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9\\x{80}-\\x{10FFFF}]+"), F.lit(0))


def whole_word(text: Column, term: Column) -> Column:
    """term stands in text between other characters than letters and digits."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), F.lower(term), F.lit(" ")))


def content_words(c: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(words(c), lambda w: F.length(w) >= least))


def citable_heading(heading: Column, title: Column) -> Column:
    """A heading short enough to cite: itself, its first part, the title before the pipe, or Introduction."""
    h = F.trim(heading)
    cut = F.trim(F.regexp_extract(h, "^(.{3,60}?)(?: [-–—] |: |\\. )", 1))
    name = F.trim(F.substring_index(title, "|", 1))
    return F.when((h != "") & (F.length(h) <= 60) & ~h.endswith("."), h).when(cut != "", cut).when(F.coalesce(name, F.lit("")) != "", name).otherwise("Introduction")


def printed_date(c: Column) -> Column:
    """First day-first date in a text: numeric, or with an English month."""
    numeric = F.regexp_extract(c, "([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})", 1)
    named = F.regexp_extract(c, "([0-9]{1,2})(?:st|nd|rd|th)? (January|February|March|April|May|June|July|August|September|October|November|December) ([0-9]{4})", 0)
    tidy = F.regexp_replace(named, "^([0-9]{1,2})(st|nd|rd|th)", "$1")
    return F.coalesce(F.try_to_date(F.regexp_replace(numeric, "[/.]", "-"), "d-M-yyyy"), F.try_to_date(tidy, "d MMMM yyyy"))


def iso_date(c: Column, fallback: Column) -> Column:
    return F.coalesce(printed_date(c).cast("string"), F.substring(fallback, 1, 10))


def product_name(entry: Column, title: Column, url: Column) -> Column:
    """Name before the pipe, first of a list, without a 'for ...' tail and marks at its ends; under three
    characters, the url's last part without its ending, %20 and dashes as spaces; at most 80 characters."""
    name = F.element_at(F.split(F.substring_index(F.coalesce(F.nullif(F.trim(entry), F.lit("")), title), "|", 1), "[/,]"), 1)
    name = F.trim(F.regexp_replace(name, "(?i)[ \\t]*\\bfor\\b.*$", ""), F.lit(" -–:"))
    slug = F.regexp_replace(F.regexp_extract(url, "([^/?#]*)/*(?:[?#].*)?$", 1), "(?i)[.](?:pdf|html?)$", "")
    slug = F.initcap(F.regexp_replace(F.replace(slug, F.lit("%20"), F.lit(" ")), "[-_]+", " "))
    return F.trim(F.substring(F.when(F.length(name) >= 3, name).otherwise(slug), 1, 80))


def same_product(named: Column, candidate: Column, brand: str, apart: str = "primer") -> Column:
    """Whether two names are of one product: without the brand, equal or one the other's first
    words, and both or neither with the word that sets products apart.  Empty and null ones: no."""
    a, b = (F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"^{brand} ", "")) for c in (named, candidate))
    has = lambda c: F.regexp_like(c, F.lit(f"\\b{apart}\\b"))
    return (a != "") & (b != "") & (has(a) == has(b)) & ((a == b) | F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" "))))


def citation_name(link_text: Column, title: Column, url: Column) -> Column:
    """Link text, else title, else url; before the first pipe."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.trim(F.substring_index(F.coalesce(some(link_text), some(title), url), "|", 1))


def unescape(c: Column) -> Column:
    """The five named references, the no-break space and decimal references of ASCII."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return c
