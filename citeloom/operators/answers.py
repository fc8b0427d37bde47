"""Cited extractive answers and the support ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom import fixed_values as fv
from citeloom.functions import text as tx

REFUSAL = "The admitted evidence does not answer this question."
ANSWERED, REFUSED = "answered_from_locations", "not_enough_information"


def cited_answers(locations: DataFrame, questions: DataFrame, *, depth: int = 3, refusal: str = REFUSAL) -> DataFrame:
    """Best sentence of each of the first locations, each followed by its citation."""
    rows = locations.filter(F.col("location_rank") <= depth).join(
        questions.select("question_id", tx.plain_words(F.col("question")).alias("question_words")), "question_id")
    sentence = tx.best_sentence(F.col("text"), F.col("question_words"))
    rows = rows.select("question_id", "location_rank", "citation", sentence.alias("sentence")).filter(F.col("sentence") != "")
    cited = F.when(F.col("sentence").contains(F.col("citation")), F.col("sentence")).otherwise(
        F.concat_ws(" ", "sentence", "citation"))
    parts = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(
        F.struct("location_rank", cited.alias("cited"), "citation"))).alias("parts"))
    out = questions.select("question_id", "question").join(parts, "question_id", "left")
    return out.select(
        "question_id", "question",
        F.when(F.col("parts").isNull(), F.lit(REFUSED)).otherwise(F.lit(ANSWERED)).alias("status"),
        F.coalesce(F.array_join(F.col("parts.cited"), " "), F.lit(refusal)).alias("answer"),
        F.coalesce(F.col("parts.citation"), F.array().cast("array<string>")).alias("citations"))


def support_ladder(locations: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Which support states the accepted text establishes, the level and a conclusion."""
    text = F.concat_ws("\n", F.transform("packed", lambda p: p["text"]))
    packed = locations.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("location_rank", "text", "citation", "block_terms"))).alias("packed"))
    rows = (questions.select("question_id", "base_terms").join(answers.select("question_id", "status"), "question_id")
            .join(packed, "question_id", "left"))
    rows = rows.select(
        "question_id", "base_terms", "status", F.col("packed").isNotNull().alias("located"),
        F.coalesce(F.transform("packed", lambda p: p["citation"]), F.array().cast("array<string>")).alias("citations"),
        F.coalesce(F.array_distinct(F.flatten(F.transform("packed", lambda p: p["block_terms"]))),
                   F.array().cast("array<string>")).alias("evidence_terms"),
        tx.fold_plain(F.coalesce(text, F.lit(""))).alias("folded"))
    shared = F.size(F.array_intersect("base_terms", "evidence_terms"))
    cue = {level: tx.contains_any(F.col("folded"), words) for level, words in fv.LADDER_CUES.items()}
    n = F.size("base_terms")
    rows = rows.withColumn("_l4", cue["L4"])
    met = {"L1": F.col("located"),
           "L2": F.col("located") & (n > 0) & (shared >= F.least(F.lit(2), n)),
           "L3": cue["L3"], "L4": F.col("_l4"), "L5": F.col("_l4") & cue["L5"],
           "L6": cue["L6"], "L7": cue["L7"], "L8": cue["L8"], "L9": cue["L9"]}
    names = dict(fv.LADDER)
    hits = F.array_compact(F.array(*[F.when(met[k], F.lit(k)) for k in names]))
    rows = rows.withColumn("ladder_hits", hits)
    meaning = F.create_map(*[F.lit(x) for pair in fv.LADDER for x in pair])
    rows = rows.withColumn("supported", F.transform("ladder_hits", lambda h: F.element_at(meaning, h)))
    rows = rows.withColumn("not_supported", F.array_except(F.array(*[F.lit(v) for v in names.values()]), "supported"))
    has = lambda level: F.array_contains("ladder_hits", level)
    level = (F.when((F.size("ladder_hits") == 0) | (F.col("status") == REFUSED), F.lit("insufficient"))
             .when(has("L8"), F.lit("conflict")).when(has("L9") | has("L3"), F.lit("strong"))
             .when(F.size("ladder_hits") >= 2, F.lit("partial")).otherwise(F.lit("weak")))
    rows = rows.withColumn("support_level", level)
    open_states = F.array_join(F.slice("not_supported", 1, 4), ", ")
    conclusion = F.when(F.col("support_level") == "insufficient", F.lit("Not enough cited evidence.")).otherwise(
        F.concat(F.lit("Established: "), F.array_join("supported", ", "), F.lit(". Not established: "),
                 F.when(open_states == "", F.lit("none")).otherwise(open_states), F.lit(".")))
    return rows.select("question_id", "support_level", "ladder_hits", "supported", "not_supported", "citations",
                       conclusion.alias("conclusion"))
