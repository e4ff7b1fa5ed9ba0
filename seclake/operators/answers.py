"""Prompts for, and answers of, a language model, as tables. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import (
    ANSWER_DEFAULTS,
    ANSWER_FIXED,
    ANSWER_SCORE_WITH_FINDINGS,
    BAD_JSON_MESSAGE,
    FAILED_ANSWER_LEVEL,
    FAILED_ANSWER_SCORE,
    NO_JSON_MESSAGE,
    PROMPT_FORMAT,
)
from seclake.schemas import ANSWER


def findings_json(hits: Column) -> Column:
    """JSON array of id, line and content of each hit."""
    return F.to_json(F.transform(hits, lambda h: F.struct(
        h["vuln_id"].alias("id"), h["line_number"].alias("line"),
        h["line_content"].alias("content"))))


def prompts(scanned: DataFrame) -> DataFrame:
    """Prompt text of each scanned file, made inside its row."""
    return scanned.select(
        "file_path", "language", findings_json(F.col("hits")).alias("findings_json"),
        F.format_string(
            PROMPT_FORMAT, F.col("language"), F.col("file_path"), F.col("text"),
            findings_json(F.col("hits"))).alias("prompt"))


def json_block(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, empty when there is none."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Add ``answer``, the parsed JSON, and ``problem``, why there is none.

    The block is read as the only element of an array, so that anything after the first
    object makes it bad instead of being left unread.
    """
    block = answers.withColumn("_block", json_block(F.col("raw")))
    schema = f"array<{ANSWER.simpleString()}>"
    read = block.withColumn("_read", F.from_json(
        F.concat(F.lit("["), F.col("_block"), F.lit("]")), schema,
        {"allowSingleQuotes": "false"}))
    good = (F.size("_read") == 1) & F.get("_read", F.lit(0)).isNotNull()
    answer = F.get("_read", F.lit(0))
    # Items are read as text, too: one that is no object makes the answer bad.
    listed = F.get_json_object("_block", "$.analyzed_vulnerabilities")
    items = F.from_json(listed, "array<string>")
    items_ok = listed.isNull() | F.coalesce(
        F.forall(items, lambda i: F.startswith(F.ltrim(i), F.lit("{"))), F.lit(False))
    score = answer["overall_risk_score"]
    lines_ok = items_ok & (score.isNull() | score.try_cast("double").isNull() | _fits(score)
                           ) & F.forall(
        F.coalesce(answer["analyzed_vulnerabilities"],
                   F.array().cast(ANSWER["analyzed_vulnerabilities"].dataType)),
        lambda v: v["line_number"].isNull() | _fits(v["line_number"]))
    return read.withColumn(
        "problem",
        F.when((F.col("_block") == "") | F.col("_block").isNull(), NO_JSON_MESSAGE)
        .when(~F.coalesce(good & lines_ok, F.lit(False)), BAD_JSON_MESSAGE),
    ).withColumn("answer", F.when(F.col("problem").isNull(), answer)).drop("_block", "_read")


def _fits(text: Column) -> Column:
    """Whether the text is a number that an INT can hold; NaN is none."""
    number = text.try_cast("double")
    return F.coalesce(~F.isnan(number) & number.between(-(1 << 31), (1 << 31) - 1), F.lit(False))


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"),
                      F.when(_fits(text), text.try_cast("double")).try_cast("int"))


def answers_with_defaults(answers: DataFrame) -> DataFrame:
    """Analysis of each answer with defaults filled in.

    Deliberate difference: a JSON null counts as missing, since ``from_json`` cannot tell
    the two apart. A failed answer has no findings and keeps ``analysis_failed`` true.
    """
    d, fixed = ANSWER_DEFAULTS, ANSWER_FIXED
    parsed = parsed_answers(answers)
    a = F.col("answer")

    def finding(v: Column) -> Column:
        return F.struct(
            F.lit(fixed["vuln_id"]).alias("vuln_id"),
            F.coalesce(v["category"], F.lit(d["category"])).alias("category"),
            F.coalesce(_whole(v["line_number"]), F.lit(d["line_number"])).alias("line_number"),
            F.coalesce(v["line_content"], F.lit(d["line_content"])).alias("line_content"),
            F.coalesce(v["severity"], F.lit(d["severity"])).alias("severity"),
            F.coalesce(v["explanation"], F.lit(d["ai_explanation"])).alias("ai_explanation"),
            F.coalesce(v["recommendation"], F.lit(d["recommendation"])).alias("recommendation"),
            *[F.lit(fixed[c]).alias(c) for c in (
                "cwe_id", "owasp_category", "confidence", "exploit_scenario",
                "secure_code_snippet", "false_positive_likelihood")],
            F.array().cast("array<string>").alias("references"))

    failed = F.col("problem").isNotNull()
    found = F.transform(a["analyzed_vulnerabilities"], finding)
    with_list = parsed.withColumn("findings", F.coalesce(found, F.array().cast(
        parsed.select(found.alias("x")).schema["x"].dataType)))
    score = F.coalesce(
        _whole(a["overall_risk_score"]),
        F.when(F.size("findings") > 0, ANSWER_SCORE_WITH_FINDINGS).otherwise(0))
    with_score = with_list.withColumn("overall_risk_score", F.when(
        failed, FAILED_ANSWER_SCORE).otherwise(score))
    texts = F.array().cast("array<string>")
    return with_score.withColumns({
        "analysis_failed": failed,
        "overall_risk_level": F.when(failed, FAILED_ANSWER_LEVEL).otherwise(F.coalesce(
            a["overall_risk_level"],
            F.when(F.col("overall_risk_score") > 50, "High").otherwise("Low"))),
        "executive_summary": F.coalesce(
            F.col("problem"), a["executive_summary"], F.lit(d["executive_summary"])),
        "top_priority_fixes": F.coalesce(a["top_priority_fixes"], texts),
        "secure_code": F.coalesce(a["secure_code"], F.lit(d["secure_code"])),
    }).drop("answer", "problem", "raw")


def answer_findings(analyses: DataFrame, key: str) -> DataFrame:
    """One row per finding of the analyses."""
    rows = analyses.select(key, F.posexplode_outer("findings").alias("source_order", "_f"))
    return rows.filter(F.col("_f").isNotNull()).select(key, "source_order", "_f.*")
