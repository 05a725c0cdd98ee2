"""From raw documents to packed training sequences, in five stages.

Every stage reads all rows that the one before kept. All but the last return the columns of ``documents``:

1. ``language_id`` drops documents whose language is not told clearly, and those without a letter;
2. ``line_dedup`` keeps one line of each group of equal or nearly equal lines; a document left without any text goes;
3. ``near_dedup`` keeps one document of each group that is linked by five-word shingles at similarity 0.8;
4. ``decontaminate`` drops documents that overlap with a benchmark item;
5. ``pack`` returns the pieces of the packed sequences.

The first stage drops null texts. Rows without a ``doc_id`` pass the stages that need one unchanged. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import decontam, forest, language, lines, packing
from tabulith.llm.components import sized
from tabulith.session import written_once


def _with_own_names(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage keeps of ``docs``, whose columns other than those a stage works on go under private names meanwhile: none
    can be taken for a column that the stage adds."""
    used = ("doc_id", "text", "lang", "n_chars")
    private = [c if c in used else f"__own{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*private)).select(private).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_own_names(docs, lambda rows: language.identify(rows, language.learn(rows)).where("accepted"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(rows: DataFrame) -> DataFrame:
        found = lines.deduplicated(rows)
        changed = F.size("dropped_lines") > 0
        found = found.where(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
        if "n_chars" in rows.columns:
            found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return found

    return _with_own_names(docs, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = forest.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]

#: compression, MinHash bands and a tokenizer have no SQL twin; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
