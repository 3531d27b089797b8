"""A content-addressed translation memory: (entry_id, source, lang, translated)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incremental import entry_id
from .keys import of_file


def recalled(source: DataFrame, memory: DataFrame, langs: DataFrame, of: dict | str) -> DataFrame:
    """([file,] lang, key, translated): non-empty remembered translations of the source's strings."""
    file = of_file(source)
    asked = source.where("vtype = 'string'").select(*file, "key", entry_id(F.col("value"), of).alias("entry_id"))
    known = memory.where("translated IS NOT NULL AND translated <> ''").join(F.broadcast(langs.select("lang").distinct()), "lang", "left_semi")
    return asked.join(known.select("entry_id", "lang", "translated"), "entry_id").select(*file, "lang", "key", "translated")


def made(source: DataFrame, translations: DataFrame, of: dict | str) -> DataFrame:
    """(entry_id, lang, fresh, fresh_source): translations (lang, key, value, vtype, ord) worth remembering; blank ones and those equal to the source are not. Of several for one entry the last stays."""
    on = [*of_file(source, translations), "key"]
    texts = source.where("vtype = 'string'").select(*on, F.col("value").alias("source"))
    rows = translations.where("vtype = 'string'").select(*on, "lang", F.struct(*on[:-1], "ord").alias("ord"), F.col("value").alias("translated")).join(texts, on)
    rows = rows.where((F.trim("translated") != "") & (F.col("translated") != F.col("source"))).withColumn("entry_id", entry_id(F.col("source"), of))
    return rows.groupBy("entry_id", "lang").agg(F.max_by("translated", "ord").alias("fresh"), F.first("source").alias("fresh_source"))


def recorded(memory: DataFrame, source: DataFrame, translations: DataFrame, of: dict | str) -> DataFrame:
    """The memory with what made() gives put in. `is_new` tells pairs that were absent or other."""
    last = made(source, translations, of)
    joined = memory.join(last, ["entry_id", "lang"], "full")
    is_new = F.col("fresh").isNotNull() & (F.col("translated").isNull() | (F.col("translated") != F.col("fresh")))
    return joined.select("entry_id", F.coalesce("source", "fresh_source").alias("source"), "lang", F.coalesce("fresh", "translated").alias("translated"), F.coalesce(is_new, F.lit(False)).alias("is_new"))


def counted(memory: DataFrame) -> DataFrame:
    """One row (entries, pairs)."""
    return memory.agg(F.countDistinct("entry_id").alias("entries"), F.count("*").alias("pairs"))
