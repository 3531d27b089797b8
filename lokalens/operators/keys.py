"""Joins of locales by key: what is missing, what is extra, what stands side by side.

Tables of segments have (lang, key, value, vtype, ord); a key whose value is null is present. Those of several
source files have a column `file` as well, and keys meet within a file only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_file(*tables: DataFrame) -> list[str]:
    """The column that tells source files apart, if the tables have it."""
    return ["file"] if all("file" in t.columns for t in tables) else []


def missing_keys(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Rows of source whose key the target lacks."""
    return source.join(target.select(*on).distinct(), on, "left_anti")


def extra_keys(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Rows of target whose key the source lacks."""
    return target.join(source.select(*on).distinct(), on, "left_anti")


def by_language(source: DataFrame, langs: DataFrame) -> DataFrame:
    """Every source row for every language. langs is the stated list of languages, a small set against all rows."""
    return source.drop("lang").join(F.broadcast(langs.select("lang").distinct()), how="cross")


def missing_locales(langs: DataFrame, target: DataFrame) -> DataFrame:
    """Languages without any row in target."""
    return langs.select("lang").distinct().join(target.select("lang").distinct(), "lang", "left_anti")


def aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """([file,] lang, key, ord, src, tgt): strings of both sides under one key, in the source's order."""
    file = of_file(source, target)
    a = source.where("vtype = 'string'").select(*file, "key", "ord", F.col("value").alias("src"))
    b = target.where("vtype = 'string'").select(*file, "lang", "key", F.col("value").alias("tgt"))
    return b.join(a, [*file, "key"]).select(*file, "lang", "key", "ord", "src", "tgt")


def side_by_side(source: DataFrame, target: DataFrame, langs: DataFrame) -> DataFrame:
    """([file,] lang, key, ord, here, there, src, tgt): every key of either side in every language, in one join. here and there tell which side has it; src and tgt are its strings, null for other values. ord is the source's, or the target's where the source lacks the key."""
    file = of_file(source, target)
    string = F.when(F.col("vtype") == "string", F.col("value"))
    a = by_language(source, langs).select(*file, "lang", "key", F.col("ord").alias("ord_a"), F.lit(True).alias("here"), string.alias("src"))
    b = target.select(*file, "lang", "key", F.col("ord").alias("ord_b"), F.lit(True).alias("there"), string.alias("tgt"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return a.join(b, [*file, "lang", "key"], "full").select(*file, "lang", "key", F.coalesce("ord_a", "ord_b").alias("ord"), flag("here"), flag("there"), "src", "tgt")


def catalog_languages(segments: DataFrame, source_lang: str) -> DataFrame:
    """The languages of a catalog's entries and its source language."""
    return segments.select("lang").unionByName(segments.sparkSession.createDataFrame([(source_lang,)], "lang string")).distinct()


def merged(existing: DataFrame, translated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Existing segments with translated ones put in by key (of each document that `by` names), whatever their value; new keys come after the old ones."""
    a = existing.select(*by, "key", F.col("ord").alias("o1"), F.col("value").alias("v1"), F.col("vtype").alias("t1"), F.lit(True).alias("in1"))
    b = translated.select(*by, "key", F.col("ord").alias("o2"), F.col("value").alias("v2"), F.col("vtype").alias("t2"), F.lit(True).alias("in2"))
    won = F.col("in2").isNotNull()
    return a.join(b, [*by, "key"], "full").select(
        *by,
        "key",
        F.when(won, F.col("v2")).otherwise(F.col("v1")).alias("value"),
        F.when(won, F.col("t2")).otherwise(F.col("t1")).alias("vtype"),
        F.struct(F.col("in1").isNull().alias("new"), F.coalesce("o1", "o2").alias("ord")).alias("place"),
    )


def subset(source: DataFrame, keys: DataFrame) -> DataFrame:
    return source.join(keys.select("key").distinct(), "key", "left_semi")
