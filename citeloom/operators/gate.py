"""Evidence gate: coverage of required terms, reject reasons, qualified order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx


def significant_terms(base_terms: Column, stop=fv.STOP_TERMS, low_value=fv.LOW_VALUE_TERMS) -> Column:
    """Question terms that evidence must cover: no stop or low-value term, no lone letter."""
    out = sorted({*stop, *low_value})
    return F.array_distinct(F.filter(base_terms, lambda a: ~a.isin(out) & ((F.length(a) > 1) | tx.is_digits(a))))


def is_heading_only(text: Column) -> Column:
    """One non-blank line that is marked as a heading or short. A stripped text starts and
    ends with a non-blank line, so any break inside means a second one."""
    bare = tx.strip(text)
    return (bare != "") & ~bare.rlike(tx.LINE_BREAK) & (bare.startswith("#") | (F.length(bare) <= fv.HEADING_MAX_CHARS))


def is_broad_heading(text: Column) -> Column:
    bare = tx.fold_plain(F.regexp_replace(tx.strip(text), "^[#*` ]+|[#*` ]+$", ""))
    starts = reduce(lambda a, b: a | b, [bare.startswith(p) for p in fv.BROAD_HEADING_PREFIXES])
    return bare.isin(list(fv.BROAD_HEADINGS)) | starts


def has_path_intent(question: Column) -> Column:
    return tx.contains_any(tx.fold_plain(question), fv.PATH_INTENT_WORDS)


def has_true_path(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in fv.TRUE_PATH_PATTERNS])


def qualify(candidates: DataFrame, questions: DataFrame, *, top_k: int, small: bool,
            stop=fv.STOP_TERMS, low_value=fv.LOW_VALUE_TERMS) -> DataFrame:
    """Candidates with their gate receipt and final ranks. ``location_rank`` numbers accepted
    candidates up to ``top_k``; ``rejected_rank`` numbers rejected ones up to ``top_k``; both
    are null beyond that, but no receipt is dropped."""
    from citeloom.session import broadcast_if

    ask = questions.select("question_id", significant_terms(F.col("base_terms"), stop, low_value).alias("required_terms"),
                           has_path_intent(F.col("question")).alias("path_intent"))
    rows = candidates.join(broadcast_if(ask, small), "question_id")
    required, n = F.col("required_terms"), F.size("required_terms")
    rows = (rows.withColumn("covered_terms", F.sort_array(F.array_intersect(required, F.col("block_terms"))))
            .withColumn("heading_only", is_heading_only(F.col("text"))))
    rows = (rows.withColumn("_coverage", F.size("covered_terms") / F.greatest(F.lit(1), n))
            .withColumn("broad_heading", F.col("heading_only") & is_broad_heading(F.col("text")))
            .withColumn("path_candidate", has_true_path(F.col("text"))))
    cov = F.col("_coverage")
    reasons = F.array_compact(F.array(
        F.when(F.col("broad_heading"), F.lit("section_heading_ambiguity")),
        F.when(F.col("heading_only") & (cov < fv.HEADING_COVERAGE), F.lit("heading_without_content")),
        F.when(F.col("path_intent") & F.col("text").rlike(fv.SLASH_PHRASE) & ~F.col("path_candidate"),
               F.lit("path_config_classifier_miss")),
        F.when((n >= fv.REFUSAL_TERMS) & (cov < fv.REFUSAL_COVERAGE), F.lit("unsupported_refusal_threshold")),
        F.when((n >= fv.OBJECT_TERMS) & (cov < fv.OBJECT_COVERAGE), F.lit("predicate_object_coverage_miss"))))
    points = (F.col("density_score") + fv.COVERAGE_WEIGHT * cov
              + F.least(F.lit(fv.MAX_HIT_BONUS), F.col("direct_hit_count").cast("double"))
              - F.when(F.col("heading_only"), F.lit(fv.HEADING_PENALTY)).otherwise(F.lit(0.0)))
    rows = (rows.withColumn("reject_reasons", reasons)
            .withColumn("qualified", F.size("reject_reasons") == 0)
            .withColumn("qualified_score", tx.round_to(points, 4))
            .withColumn("missing_terms", F.slice(F.sort_array(F.array_except(required, F.col("covered_terms"))), 1, 20))
            .withColumn("coverage", tx.round_to(cov, 4)).drop("_coverage"))
    best = W.partitionBy("question_id", "qualified").orderBy(
        F.desc("qualified_score"), F.desc("density_score"), F.desc("score"), F.asc("candidate_rank"))
    as_found = W.partitionBy("question_id", "qualified").orderBy("candidate_rank")
    place, found = F.row_number().over(best), F.row_number().over(as_found)
    return (rows.withColumn("_place", place).withColumn("_found", found)
            .withColumn("location_rank", F.when(F.col("qualified") & (F.col("_place") <= top_k), F.col("_place")))
            .withColumn("rejected_rank", F.when(~F.col("qualified") & (F.col("_found") <= top_k), F.col("_found")))
            .drop("_place", "_found"))


def summary(qualified: DataFrame, questions: DataFrame, stop=fv.STOP_TERMS, low_value=fv.LOW_VALUE_TERMS) -> DataFrame:
    """Counts of the gate per question; questions without candidates are kept."""
    n = qualified.groupBy("question_id").agg(
        F.count("*").alias("raw_candidate_count"), F.count_if("qualified").alias("qualified_count"),
        F.count_if(~F.col("qualified")).alias("rejected_count"))
    out = questions.select("question_id", "question", significant_terms(F.col("base_terms"), stop, low_value).alias("required_terms"),
                           has_path_intent(F.col("question")).alias("path_intent")).join(n, "question_id", "left")
    out = out.na.fill(0, ["raw_candidate_count", "qualified_count", "rejected_count"])
    return out.withColumn("support_state", F.when(F.col("qualified_count") > 0, F.lit("qualified_evidence"))
                          .otherwise(F.lit("no_qualified_evidence")))
