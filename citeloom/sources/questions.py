"""Question sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.blocks import assign_ordinals


def _numbered(lines: DataFrame) -> DataFrame:
    """Line numbers in file order. A text scan reads a file's splits in order, so the
    generated ids are ordered; ordinals make them dense."""
    return assign_ordinals(lines.withColumn("_line", F.monotonically_increasing_id()), ["_line"], "at", 1).drop("_line")


def question_lines(spark: SparkSession, path: str) -> DataFrame:
    """One question per line, blanks skipped."""
    lines = spark.read.text(path).select(tx.strip(F.col("value")).alias("question")).filter(F.col("question") != "")
    return _numbered(lines).select(F.format_string("q%d", "at").alias("question_id"), "question")


def question_list(spark: SparkSession, questions: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Questions given as arguments, then those of a file."""
    given = [q.strip() for q in questions or [] if q.strip()]
    parts = [spark.createDataFrame([(f"a{i}", q) for i, q in enumerate(given, 1)],
                                   "question_id string, question string")]
    if path:
        parts.append(question_lines(spark, path))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def mixed_questions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Comment lines dropped; a JSON object, a tab-separated pair or a plain question."""
    rows = lines.withColumn("_t", tx.strip(F.col(line))).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    t = F.col("_t")
    is_json, is_pair = t.startswith("{"), t.contains("\t")
    pair = F.split(t, "\t", 2)
    question = (F.when(is_json, F.coalesce(F.get_json_object(t, "$.question"),
                                           F.raise_error(F.lit("question row lacks question")).cast("string")))
                .when(is_pair, tx.strip(F.get(pair, F.lit(0)))).otherwise(t))
    mirror = F.when(is_json, F.get_json_object(t, "$.mirror_answer_starter")).when(is_pair, tx.strip(F.get(pair, F.lit(1))))
    return rows.select(*[c for c in lines.columns if c != line], question.alias("question"),
                       F.when(mirror != "", mirror).alias("mirror_starter"))


def benchmark_map(spark: SparkSession, path: str) -> DataFrame:
    """Query map ``{"test_queries": [{query_id, question, …}]}``; missing fields are errors."""
    schema = ("test_queries array<struct<query_id:string,question:string,line_number:bigint,"
              "test_line_number:bigint>>")
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("test_queries").alias("r")).select("r.*")
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"query row lacks {c}")).cast("string"))
    return rows.select(need("query_id").alias("question_id"), need("question").alias("question"), "line_number",
                       "test_line_number")
