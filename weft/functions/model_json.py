"""Repair and validation of JSON that a model wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import vocab

GATE_SCHEMA = "pass boolean, score double, reason string, content_type string, evidence string"


def json_part(raw: Column) -> Column:
    """From the first brace to the last; null without braces."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), "(?s)\\{.*\\}", 0), F.lit(""))


def gate_result(raw: Column) -> Column:
    """struct<pass, score, reason, content_type, evidence, ok>: scores kept to 0..1, other content types made noise; not ok and nulls where it can't be read."""
    got = F.from_json(json_part(raw), GATE_SCHEMA)
    ok = got.isNotNull() & got["pass"].isNotNull()
    kind = F.when(got["content_type"].isin(*vocab.CONTENT_TYPES), got["content_type"]).otherwise("noise")
    return F.struct(
        F.when(ok, got["pass"]).alias("pass"), F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(got["score"], F.lit(0.0))))).alias("score"),
        F.when(ok, F.coalesce(got["reason"], F.lit(""))).alias("reason"), F.when(ok, kind).alias("content_type"), F.when(ok, got["evidence"]).alias("evidence"), ok.alias("ok"),
    )


def indicators(raw: Column) -> Column:
    """map<flag, boolean> of the known flags whose value is a boolean; others are out."""
    got = F.from_json(F.get_json_object(json_part(raw), "$.practical_indicators"), "map<string,string>")
    allowed = F.array(*map(F.lit, vocab.INDICATORS))
    kept = F.map_filter(got, lambda k, v: F.array_contains(allowed, k) & v.isin("true", "false"))
    return F.transform_values(kept, lambda _, v: v == "true")
