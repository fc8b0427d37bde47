"""Corpora over the given tables, built once per session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import ranking
from citeloom.plans import ask as ak
from citeloom.plans.index import CorpusIndex, build_index
from citeloom.session import materialise
from citeloom.sources import corpus


class Tables:
    """Lazily built indexes and packets of one data folder."""

    _known: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, root: str) -> "Tables":
        key = (spark.sparkContext.applicationId, root)
        if key not in cls._known:
            cls._known[key] = cls(spark, root)
        return cls._known[key]

    def holds(self, name: str) -> bool:
        """Whether a corpus was built before in this session."""
        return name in self.__dict__

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @property
    def document_rows(self) -> DataFrame:
        return corpus.from_table(self.read("documents"), "doc_id", "text", "documents")

    @property
    def message_rows(self) -> DataFrame:
        stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
        return corpus.from_messages(self.read("conversations"), conversation="conv_id", turn="turn", role="role", text="text",
                                    created_at=stamp)

    @cached_property
    def docs(self) -> CorpusIndex:
        return build_index(self.document_rows, "documents")

    @cached_property
    def chat(self) -> CorpusIndex:
        return build_index(self.message_rows, "conversations")

    @property
    def questions(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))

    @cached_property
    def batch(self) -> ranking.QuestionBatch:
        """The questions' terms alone; nothing is ranked for them."""
        return ranking.question_batch(self.questions, self.docs.stop)

    @cached_property
    def packets(self) -> ak.Packets:
        return ak.ask(self.docs, self.batch)

    @cached_property
    def chat_ranking(self) -> ak.Ranking:
        """The questions ranked over the conversations; links and comparisons take their own depth of it."""
        return ak.rank_blocks(self.chat, self.questions)

    @cached_property
    def triggers(self) -> DataFrame:
        """The 25 most frequent longer terms of the conversations as a trigger list."""
        top = (self.chat.counts.filter(F.length("anchor") >= 4).orderBy(F.desc("observations"), "anchor").limit(25))
        from pyspark.sql import Window as W

        n = F.row_number().over(W.orderBy(F.desc("observations"), "anchor"))
        return materialise(top.select(n.alias("source_index"), F.col("anchor").alias("surface"),
                                      F.when(F.length("anchor") <= 5, F.lit("praise")).otherwise(F.lit("coding_building")).alias("class")),
                           "triggers")

    @cached_property
    def phrases(self) -> DataFrame:
        """The first two words of every message, or the first four of odd turns that have them, as a phrase watchlist."""
        words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
        width = F.when((F.col("turn") % 2 == 1) & (F.size(words) >= 4), 4).otherwise(2)
        rows = self.read("conversations").filter(F.size(words) >= 2)
        return materialise(rows.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("source_index"), F.array_join(F.slice(words, F.lit(1), width), " ").alias("surface"),
            F.col("role").alias("class"), F.when(F.length("text") > 400, F.lit("high")).otherwise(F.lit("low")).alias("severity")), "phrases")
