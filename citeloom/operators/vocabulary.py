"""Speech vocabulary: which terms may be said, with what authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx
from citeloom.session import materialise


def key_of(c: Column) -> Column:
    return F.lower(tx.strip(c))


def term_class(term: Column, glue=fv.GLUE_TERMS) -> Column:
    key = key_of(term)
    return (F.when(key.isin([g.lower() for g in glue]), F.lit("glue")).when(key.rlike("[0-9]"), F.lit("measure_or_identifier"))
            .when((F.length(key) == 1) & ~key.rlike(r"^[\p{L}\p{N}]$"), F.lit("punctuation_or_symbol"))
            .otherwise(F.lit("evidence_anchor")))


def build_vocabulary(lexicon: DataFrame, *, glue=fv.GLUE_TERMS, forbidden=fv.STRONG_CLAIM_TERMS,
                     phrases: dict[str, str] | None = None) -> DataFrame:
    """Every sayable or forbidden term once: forbidden beats observed, observed beats glue,
    glue beats relation phrases."""
    spark = lexicon.sparkSession
    glue = [g.strip().lower() for g in glue]
    phrases = fv.RELATION_PHRASES if phrases is None else phrases
    rows = ([(g, 3, "glue", "speech_glue_only", True, False, True, False) for g in glue]
            + [(p.strip().lower(), 4, "relation_phrase", "relation_surface_only", True, False, True, False)
               for p in phrases.values()]
            + [(t.strip().lower(), 1, "forbidden", "forbidden_claim_term", False, False, False, True) for t in forbidden])
    listed = spark.createDataFrame(rows, "term string, precedence int, term_class string, authority string, can_emit boolean, "
                                         "meaningful boolean, is_glue boolean, forbidden boolean")
    listed = listed.withColumn("symbol", F.lit(None).cast("string")).withColumn("observations", F.lit(0).cast("bigint"))
    is_glue = F.col("term_class") == "glue"
    observed = (lexicon.withColumn("term", key_of(F.col("anchor"))).filter(F.col("term") != "")
                .withColumn("term_class", term_class(F.col("term"), glue))
                .select("term", F.lit(2).alias("precedence"), "term_class",
                        F.when(is_glue, F.lit("speech_glue_observed")).otherwise(F.lit("observed_anchor_only")).alias("authority"),
                        F.lit(True).alias("can_emit"), (~is_glue).alias("meaningful"), is_glue.alias("is_glue"),
                        F.lit(False).alias("forbidden"), "symbol", "observations"))
    first = W.partitionBy("term").orderBy("precedence")
    return (observed.unionByName(listed).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
            .drop("_n", "precedence"))


def surface_decisions(terms: DataFrame, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """Whether each term may be said and mean something, by which authority and why."""
    asked = terms.withColumn("_key", key_of(F.col(term)))
    got = asked.join(vocabulary.withColumnRenamed("term", "_key"), "_key", "left")
    reason = (F.when(F.col("_key") == "", F.lit("empty_surface")).when(F.col("forbidden"), F.lit("forbidden_claim_term"))
              .when(F.col("is_glue"), F.lit("allowed_glue")).when(F.col("meaningful"), F.lit("observed_anchor"))
              .when(F.col("can_emit"), F.lit("allowed_surface")).otherwise(F.lit("not_observed_and_not_glue")))
    off = F.lit(False)
    return got.select(*terms.columns, F.coalesce("can_emit", off).alias("allowed"), F.coalesce("meaningful", off).alias("meaningful"),
                      F.coalesce("authority", F.lit("not_allowed")).alias("authority"), reason.alias("reason"))


def class_histogram(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("term_class", "authority").agg(F.count("*").alias("terms"), F.sum("observations").alias("observations"))


def relation_phrase(name: str, phrases: dict[str, str] | None = None) -> str:
    return (fv.RELATION_PHRASES if phrases is None else phrases).get(name.strip().lower(), name)


def assemble_paths(paths: DataFrame, vocabulary: DataFrame, glue=fv.GLUE_PREFERENCE) -> DataFrame:
    """Sentences from term paths: (path_id, terms, citations). Every term must carry meaning;
    the first unsupported one refuses the path. Allowed glue only joins. Paths are written once, for what makes their terms may
    be dear and both the decisions and the sentences read them."""
    usable = vocabulary.filter(F.col("term").isin(list(glue)) & F.col("can_emit")).agg(
        F.collect_set("term").alias("_glue")).withColumn("_k", F.lit(1))
    joiner = F.coalesce(*[F.when(F.array_contains("_glue", g), F.lit(g)) for g in glue], F.lit(""))
    cleaned = materialise(paths.withColumn("terms", F.transform("terms", tx.squeeze)), "paths")
    flat = cleaned.select("path_id", F.posexplode("terms").alias("at", "term"))
    bad = surface_decisions(flat, vocabulary).filter(~F.col("meaningful")).groupBy("path_id").agg(
        F.min_by(F.struct(F.lower("term").alias("term"), "authority"), "at").alias("_bad"))
    rows = cleaned.withColumn("_k", F.lit(1)).join(F.broadcast(usable), "_k").drop("_k").join(bad, "path_id", "left")
    gap = F.when(joiner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), joiner, F.lit(" ")))
    said = F.substring(F.aggregate("terms", F.lit("").cast("string"), lambda acc, x: F.concat(acc, F.col("_gap"), x)),
                       F.length("_gap") + 1, F.lit(1 << 30))
    rows = rows.withColumn("_gap", gap)
    closed = F.when(F.substring(said, -1, 1).isin(".", "?", "!"), said).otherwise(F.concat(said, F.lit(".")))
    cited = F.array_distinct(F.filter("citations", lambda c: c != ""))
    none = F.size("terms") == 0
    return rows.select(
        "path_id",
        F.when(none, F.lit("not_enough_evidence")).when(F.col("_bad").isNotNull(), F.lit("refused_unsupported_surface"))
        .otherwise(F.lit("assembled_from_anchor_path")).alias("status"),
        F.when(none | F.col("_bad").isNotNull(), F.lit("")).otherwise(F.concat_ws(" ", closed, F.when(F.size(cited) > 0, F.array_join(cited, " ")))).alias("surface"),
        "terms", F.when(none, F.array().cast("array<string>")).otherwise(cited).alias("citations"),
        F.when(none, F.lit("no_anchor_path")).when(F.col("_bad").isNotNull(), F.concat(F.lit("unsupported_meaning_anchor:"), F.col("_bad.term")))
        .alias("refusal_reason"))
