"""Filters of questions: recorded decisions laid over by rules, and rows that they admit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import asks_trailing_year, mentioned, period_code
from quarry.operators.predicates import LABEL_YEAR, YEAR

# Fields that may be filtered, and words that make a decision about filings worth asking for.
FIELDS = ("filing_type", "fiscal_year", "fiscal_period", "report_period_code", "ticker", "period_basis")
FILING_WORDS = r"(?iu)10\s*-?\s*[kq]|annual\s+report|quarterly\s+report|\bannual\b|\bquarterly\b|\bfiscal\b|\bfy\b|\bq[1-4]\b|年報|季報|年度|季度|財年|會計年度|全年|第\s*[一二三四1-4]\s*季|\b20\d{2}\b"
FILTERS = "array<struct<field string, values array<string>, include boolean>>"


def gate(query: Column) -> Column:
    """The question speaks of filings or periods, so that a decision is asked for."""
    return F.coalesce(query, F.lit("")).rlike(FILING_WORDS)


def decided(raw: Column) -> Column:
    """The filters of a decision ``{"filters": [{"field", "value", "polarity"}]}``; unknown fields and empty values go, any polarity but exclude includes. A code fence around it goes; what then does not parse as a whole gives none."""
    body = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s*```(?:json)?|```\s*$", ""))
    listed = F.from_json(F.get_json_object(F.to_json(F.try_parse_json(body)), "$.filters"), "array<string>")
    item = lambda x: F.when(x.startswith("{"), x)
    value = lambda x: F.get_json_object(item(x), "$.value")
    good = F.filter(listed, lambda x: F.coalesce(F.get_json_object(item(x), "$.field").isin(*FIELDS) & ~value(x).isin("", "false", "[]", "{}"), F.lit(False)))
    made = F.transform(good, lambda x: F.struct(
        F.get_json_object(x, "$.field").alias("field"), F.array(value(x)).alias("values"), (~F.get_json_object(x, "$.polarity").eqNullSafe("exclude")).alias("include")))
    return F.coalesce(made, F.array()).cast(FILTERS)


def ruled(query: Column) -> Column:
    """The filters that a question's letters tell: a period code, the companies it names, the trailing year."""
    q = F.coalesce(query, F.lit(""))
    one = lambda field, values: F.struct(F.lit(field).alias("field"), values.alias("values"), F.lit(True).alias("include"))
    code, basis = period_code(q), asks_trailing_year(q)
    every = F.array(one("report_period_code", F.array(code)), one("ticker", mentioned(q)), one("period_basis", F.array(basis)))
    return F.filter(every.cast(FILTERS), lambda f: (F.size(f["values"]) > 0) & F.get(f["values"], F.lit(0)).isNotNull())


def filters(query: Column, decision: Column) -> Column:
    """Array of (field, values, include): the decision's, if the gate lets it in, and the rules' for fields that it leaves open."""
    told = F.when(gate(query), decided(decision)).otherwise(F.array().cast(FILTERS))
    return F.concat(told, F.filter(ruled(query), lambda r: ~F.exists(told, lambda d: d["field"] == r["field"])))


def admits(filters: Column, schema: T.StructType) -> Column:
    """Whether a row of ``schema`` passes all filters beside it, never null: ``predicates.compile_clauses``, strict, for filters that differ by row.

    Included, the row's value is among the filter's; excluded, it is not, and an empty one stays. A fiscal year also matches by the label year. Array columns
    match by any of their values. A field that the schema lacks matches nothing.
    """

    def among(f: Column, name: str) -> Column:
        if name not in schema.names:
            return F.lit(False)
        if isinstance(schema[name].dataType, T.ArrayType):
            return F.coalesce(F.arrays_overlap(F.col(name).cast("array<string>"), f["values"]), F.lit(False))
        return F.coalesce(F.array_contains(f["values"], F.col(name).cast("string")), F.lit(False))

    def hit(f: Column) -> Column:
        each = [(f["field"] == name) & ((among(f, name) | among(f, LABEL_YEAR)) if name == YEAR else among(f, name)) for name in FIELDS]
        return reduce(lambda a, b: a | b, each)

    return F.coalesce(F.forall(filters, lambda f: hit(f) == f["include"]), F.lit(True))
