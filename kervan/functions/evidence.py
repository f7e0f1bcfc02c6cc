"""Evidence: every match of every extractor with its place in the text.

A pattern's matches and the gaps between them come from two scans of the text (extract all, split); their lengths add up
to each match's place, so a value that stands twice has two spans of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract as E
from . import vocabulary as V
from .text import ascii_fold, let

CONTEXT = 40


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct(raw, start, end)> of all matches in order. Places count from 1, the end is excluded."""
    none = F.array().cast("array<struct<raw:string,start:int,end:int>>")
    begin = F.struct(F.lit(1).alias("at"), none.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["g"])
        end = start + F.length(pair["m"])
        span = F.struct(pair["m"].alias("raw"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, begin, step)["spans"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


@dataclass(frozen=True)
class Field:
    """A field's pattern, the value of one match, its unit, and how far it is to be trusted."""

    pattern: str
    value: Callable[[Column], Column]
    unit: Callable[[Column], Column]
    confidence: str = "0.750"
    folded: bool = False  # matched on the text without Turkish letters, which keeps its length


def _text(name: str) -> Callable[[Column], Column]:
    return lambda m: F.lit(name)


def _plain(c: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _group(pattern: str, i: int) -> Callable[[Column], Column]:
    return lambda m: F.regexp_extract(m, f"(?U){pattern}", i)


def _bounds(b: Column) -> Column:
    return F.concat_ws("-", *[F.coalesce(b[end].cast("string"), F.lit("")) for end in ("low", "high")])


def _tier(m: Column) -> Column:
    first = F.try_element_at(E.tiers(m), F.lit(1))
    return F.concat_ws(":", _plain(first["threshold"]), _plain(first["reward"]))


_AMOUNT = rf"({V.NUMBER}){V.MULTIPLIER}\s*{V.CURRENCY}"
#: Field name to its rule. Dates are what stands in the text, validity windows are put together from them elsewhere.
FIELDS: dict[str, Field] = {
    "amount": Field(f"(?U){_AMOUNT}", lambda m: _plain(E.money(m)["amount"]), lambda m: E.currency(m)),
    "rate_pct": Field(f"(?U){V.RATE}", lambda m: _plain(E.decimal_tr(m)), _text("percent")),
    "term_months": Field(f"(?U){V.TERM_RANGE}|{V.TERM_SINGLE}", lambda m: _bounds(E.term_months(m)), _text("month")),
    "instalments": Field(f"(?U){V.INSTALMENTS_NAMED}|{V.INSTALMENTS_LABEL}", lambda m: E.instalments(m).cast("string"), _text("count")),
    "reward_tier": Field(f"(?U){V.REWARD_TIER}", _tier, _text("TRY")),
    "date": Field(f"(?U){E.dated(V.DATE_CANDIDATE)}", lambda m: E.first_date(m).cast("string"), _text("date")),
    "ltv_pct": Field(f"(?iU)(?:{V.LTV_OF_VALUE})|(?:{V.LTV_FINANCED})", lambda m: _plain(E.ltv_percent(m)), _text("percent"), folded=True),
    "vehicle_age": Field(f"(?U)(?:{V.AGE_RANGE})|(?:{V.AGE_MOST})|(?:{V.AGE_USED})", lambda m: _bounds(E.vehicle_age(m)), _text("year"), "0.500", folded=True),
}


def evidence(df: DataFrame, id_col: str, text_col: str, url_col: str | None = None, fields: dict[str, Field] | None = None) -> DataFrame:
    """One row per field and match in a prepared text (see extract.prepare): id, field_name, seq, value_raw,
    value_normalized, unit, evidence_text (the match with CONTEXT characters around it), evidence_char_start,
    evidence_char_end, evidence_source_url, confidence, extraction_method. Matches without a valid value give no row; null
    texts give none."""
    fields = fields or FIELDS
    text = F.col("_text")
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("_url"))

    def matches(name: str, f: Field) -> Column:
        """The field's matches with a valid value, which is worked out once, and their numbers among all of its matches."""
        typed = lambda s, i: F.struct(F.lit(name).alias("field_name"), i.alias("seq"), s.alias("span"), f.value(s["raw"]).alias("value"), f.unit(s["raw"]).alias("unit"), F.lit(f.confidence).alias("confidence"))
        spans = let(ascii_fold(text), lambda folded: match_spans(folded, f.pattern)) if f.folded else match_spans(text, f.pattern)
        return F.filter(F.transform(spans, typed), lambda m: m["value"] != "")

    found = F.concat(*[matches(name, f) for name, f in fields.items()])
    rows = base.filter(text.isNotNull()).select("_id", "_text", "_url", F.explode(found).alias("m")).select("_id", "_text", "_url", "m.*")
    raw = F.col("span.raw")
    begin = F.greatest(F.col("span.start") - CONTEXT, F.lit(1))
    return rows.select(
        F.col("_id").alias(id_col), "field_name", "seq", F.substring(text, F.col("span.start"), F.length(raw)).alias("value_raw"),
        F.col("value").alias("value_normalized"), "unit", F.substring(text, begin, F.col("span.end") + CONTEXT - begin).alias("evidence_text"),
        F.col("span.start").alias("evidence_char_start"), F.col("span.end").alias("evidence_char_end"), F.col("_url").alias("evidence_source_url"),
        F.col("confidence").cast("decimal(4,3)").alias("confidence"), F.lit("rule").alias("extraction_method"),
    )
