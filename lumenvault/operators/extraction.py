"""Candidates for knowledge from a model's answers, each held against the schema by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kinds of candidates and their details, and the characters below which a report has nothing to tell.
KINDS = ("codebase_fact", "bug_lesson")
DETAILS = ("module", "symbol", "architecture")
LEAST_CHARS = 40
FIRST_CONFIDENCE = 0.6
#: Texts of a candidate that are empty if they are not given.
TEXTS = ("detail", "symptom", "root_cause", "fix_patch")


def answer_object(answer: Column) -> Column:
    """The JSON object of an answer as a variant: from the first brace to the last, fences left out; null if that is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def _kind(v: Column, path: str) -> Column:
    """The type of what stands at a path, null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text_or_none(v: Column, name: str) -> Column:
    kind = _kind(v, f"$.{name}")
    return kind.isNull() | (kind == "STRING")


def _whole(kind: Column) -> Column:
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")


def _good_evidence(e: Column) -> Column:
    line = _kind(e, "$.line")
    return F.schema_of_variant(e).startswith("OBJECT") & F.coalesce(_kind(e, "$.file") == "STRING", F.lit(False)) & (line.isNull() | (line == "VOID") | _whole(line)) & _text_or_none(e, "snippet")


def _list(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def candidates(answers: DataFrame) -> DataFrame:
    """(report, place, kind, summary, detail, symptom, root_cause, fix_patch, blast_radius, kind_detail, evidence, confidence) of answers (report, text, answer).

    A report of fewer than LEAST_CHARS characters, and an answer without an object that has items, give none. An item that breaks the schema is left out and
    the others stay: kind is one of KINDS, kind_detail, if given, of DETAILS, the summary is text and not blank, other texts are texts, evidence is a list of
    objects with a file, and a whole line or none, the radius is a list of texts, and confidence is a number from 0 to 1. What is not given has the
    schema's default.
    """
    told = answers.where(F.length(F.trim("text")) >= LEAST_CHARS).select("report", answer_object(F.col("answer")).alias("said"))
    each = told.select("report", F.posexplode(_list(F.col("said"), "items")).alias("place", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    v = F.col("v")
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    number, score = _kind(v, "$.confidence"), get("confidence", "double")
    detail = _kind(v, "$.kind_detail")
    good = (
        (_kind(v, "$.kind") == "STRING") & get("kind").isin(*KINDS) & (_kind(v, "$.summary") == "STRING") & (F.trim(get("summary")) != "")
        & (detail.isNull() | ((detail == "STRING") & get("kind_detail").isin(*DETAILS)))
        & (number.isNull() | (~number.isin("VOID", "BOOLEAN") & score.between(0.0, 1.0)))
    )
    for name in TEXTS:
        good = good & _text_or_none(v, name)
    for name, fits in (("blast_radius_files", lambda x: F.schema_of_variant(x) == "STRING"), ("evidence", _good_evidence)):
        kind = _kind(v, f"$.{name}")
        good = good & (kind.isNull() | (kind.startswith("ARRAY") & F.forall(_list(v, name), fits)))
    evidence = F.transform(_list(v, "evidence"), lambda e: F.struct(F.try_variant_get(e, "$.file", "string").alias("file"), F.try_variant_get(e, "$.line", "bigint").alias("line"), F.coalesce(F.try_variant_get(e, "$.snippet", "string"), F.lit("")).alias("snippet")))
    radius = F.transform(_list(v, "blast_radius_files"), lambda x: F.try_variant_get(x, "$", "string"))
    return each.where(F.coalesce(good, F.lit(False))).select(
        "report", "place", get("kind").alias("kind"), F.trim(get("summary")).alias("summary"), *(F.coalesce(get(n), F.lit("")).alias(n) for n in TEXTS), radius.alias("blast_radius"),
        F.coalesce(get("kind_detail"), F.lit(DETAILS[0])).alias("kind_detail"), evidence.alias("evidence"), F.coalesce(score, F.lit(FIRST_CONFIDENCE)).alias("confidence"),
    )
