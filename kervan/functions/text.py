"""Text normalisation as columns. NFKC is the one Arrow stage; everything else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC; texts that need nothing pass through."""
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_whitespace(c: Column) -> Column:
    """CRLF to LF, runs of blanks to one space, lines trimmed, at most one empty line, ends trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def tidy(c: Column) -> Column:
    """normalize_text without NFKC: for text that is known to be composed, e.g. rendered from columns."""
    # Characters without a replacement, the zero-width ones, are dropped.
    c = F.translate(F.coalesce(c, F.lit("")), V.WIDE_SPACES + V.DASHES + V.ZERO_WIDTH, " " * len(V.WIDE_SPACES) + "-" * len(V.DASHES))
    return collapse_whitespace(c)


def normalize_text(c: Column) -> Column:
    """Zero-width characters go first, then NFKC, spaces, dashes, blanks."""
    bare = F.translate(F.coalesce(c, F.lit("")), V.ZERO_WIDTH, "")
    return tidy(nfkc(bare))


def lower_tr(c: Column) -> Column:
    """Turkish lower case: İ to i, I to ı, then lower."""
    return F.lower(F.translate(c, "İI", "iı"))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, V.FOLD_FROM, V.FOLD_TO)


def match_key(c: Column, composed: bool = False) -> Column:
    """The folded comparison key of a text; composed=True skips NFKC."""
    return ascii_fold(lower_tr(tidy(c) if composed else normalize_text(c)))


def fold_literal(word: str) -> str:
    """match_key of a rule's word, on the driver."""
    lowered = unicodedata.normalize("NFKC", word).translate(str.maketrans("İI", "iı")).lower()
    return lowered.translate(str.maketrans(V.FOLD_FROM, V.FOLD_TO))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_boilerplate(c: Column, composed: bool = False, patterns: tuple[str, ...] = V.BOILERPLATE) -> Column:
    """Lines without boilerplate; tags are stripped first where both < and > occur."""
    c = F.coalesce(c, F.lit(""))
    c = F.when(c.contains("<") & c.contains(">"), strip_tags(c)).otherwise(c)
    c = tidy(c) if composed else normalize_text(c)
    unwanted = "(?iuU)" + "|".join(f"(?:{p})" for p in patterns)
    lines = F.filter(F.split(c, "\n"), lambda line: (line != "") & ~line.rlike(unwanted))
    return collapse_whitespace(F.array_join(lines, "\n"))


def first_line(c: Column, least: int = 40, most: int = 500, skip: Column | None = None) -> Column:
    """First line of at least `least` characters, cut to `most`; lines equal to an entry of `skip` are passed over."""
    lines = F.split(c, "\n")
    if skip is None:
        good = F.filter(lines, lambda line: F.length(line) >= least)
    else:
        good = F.filter(lines, lambda line: (F.length(line) >= least) & ~F.array_contains(skip, line))
    return F.substring(F.try_element_at(good, F.lit(1)), 1, most)


def first_paragraph(c: Column, title: Column, least: int = 80, most: int = 500) -> Column:
    """Consecutive lines joined until `least` characters; blank or title lines restart; too short gives null."""
    start = F.struct(F.lit("").alias("buffer"), F.lit(False).alias("done"))

    def step(state: Column, line: Column, title: Column) -> Column:
        joined = F.trim(F.concat_ws(" ", F.nullif(state["buffer"], F.lit("")), line))
        grown = F.when((line == "") | line.eqNullSafe(title), F.lit("")).otherwise(joined)
        return F.when(state["done"], state).otherwise(let(grown, lambda g: F.struct(g.alias("buffer"), (F.length(g) >= least).alias("done"))))

    # The title is bound: inside the steps it would be worked out anew for every line.
    end = let(title, lambda bound: F.aggregate(F.split(c, "\n"), start, lambda state, line: step(state, line, bound)))
    return let(end, lambda e: F.when(e["done"], F.substring(e["buffer"], 1, most)))


def fingerprint(c: Column) -> Column:
    """sha256 of a clean text; empty stays empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.sha2(c, 256))


def slugify(c: Column, most: int = 80, composed: bool = False) -> Column:
    slug = F.regexp_replace(match_key(c, composed), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, most), "-+$", "")
