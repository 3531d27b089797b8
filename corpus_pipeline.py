"""A training-data pipeline over `documents`: language, lines, near copies, benchmark leaks, packing.

Each stage takes what the one before kept; all but the last return the columns of documents, whatever other
columns there are and what they are called. An empty table gives an empty one; texts are read whole,
however long; rows that repeat are rows of their own but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalens.llm import decontam, jaccard, language, line_dedup, packing
from lokalens.llm.common import materialize, table

#: A document goes if it has no letter or if no learned language reaches this share of certainty.
MIN_LANGUAGE_SCORE = 0.3
#: The score says which language fits best, not how well: a text of so many words also goes if a smaller share of them is known. Of held-out texts of sf0.01 in learned languages the least has 0.33.
FEW_WORDS, MIN_KNOWN = 20, 0.2
#: Chunks that a worker remembers while packing; it lives through the other stages of later runs too, so it is smaller than where packing runs alone.
PACKING_MEMO = 400_000


def keep_determined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model fit on the labelled ones among them; long texts in none of its languages go.

    Null, empty and letterless texts go, and all of them if no document is labelled; a null id or label doesn't matter."""
    return language.reject_undetermined(docs, language.fit(docs), MIN_LANGUAGE_SCORE, MIN_KNOWN, FEW_WORDS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that one of smaller id has; n_chars is counted anew.

    A null text becomes an empty one; a null id is larger than all others; rows of one id keep their lines."""
    return line_dedup.without_repeated_lines(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of smallest id and of null only if all are, of each group of near copies. Of equal ids any row may stay. Rows are told apart by a number of their own, as ids may be null or repeat; texts without words stay."""
    row = "row"
    while row.lower() in (c.lower() for c in docs.columns):  # a name that no column has
        row += "_"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    linked = materialize(jaccard.jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text")).where("doc_id <> component_id"), "groups")
    members = linked.select(F.col("doc_id").alias(row), "component_id").unionByName(linked.select(F.col("component_id").alias(row), "component_id").distinct())
    named = members.join(rows.select(row, "doc_id"), row)
    least = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("least"))
    gone = members.select(row).join(least.select(f"least.{row}"), row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item; null and empty texts hold none."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left; of a null or empty text the end token alone."""
    return packing.pack(docs, memo=PACKING_MEMO)


STAGES = [("language", keep_determined), ("lines", drop_repeated_lines), ("near_copies", keep_one_of_group), ("benchmark", drop_leaks), ("packing", pack)]
#: Not to be expressed in SQL; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
