"""The corpus pipeline: quality rules, toxicity, line deduplication, near duplicates, packing.

Every stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of the documents. Rows are matched by their id and a hash of
what the decision rests on, so rows that share an id are decided each by their own text. Nulls, empty texts, ties and
repeated rows have the results that the operators define; an empty table gives an empty result; further columns pass
through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.llm import line_dedup, ngram_join, packing, quality, toxicity
from chatterlens.llm.base import fresh_name, row_key, table, written
from chatterlens.llm.queries import tokenizer


def _matching(docs: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose id and hash of ``columns`` are among the chosen ones (doc_id, row_key)."""
    chosen_id, chosen_key = fresh_name(docs, "chosen_id"), fresh_name(docs, "chosen_key")
    picked = chosen.select(F.col("doc_id").alias(chosen_id), F.col("row_key").alias(chosen_key))
    same = F.col("d.doc_id").eqNullSafe(F.col(chosen_id)) & (row_key(*[f"d.{c}" for c in columns]) == F.col(chosen_key))
    return docs.alias("d").join(picked, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier estimate reject go."""
    return _matching(docs, quality.quality(docs).filter("kept"), "text", "lang", "source")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _matching(docs, scored.filter("predicted = 0"), "text")


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites stay in one document only; ``n_chars`` follows the text."""
    made = line_dedup.without_widespread_lines(docs).drop("n_lines_removed")
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents that with the smallest id stays; documents without words all stay."""
    groups = written(ngram_join.jaccard_components(docs), "groups")
    first = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("m")).select("m.*")
    one_each = _matching(docs, first, "text").dropDuplicates(["doc_id", "text"])
    return one_each.unionByName(_matching(docs, groups.filter("component IS NULL"), "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("line dedup", boilerplate_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packed),
]

#: SQL expresses neither the toxicity model nor the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
