"""Documents that are kept beside a project, the lock and the translation memory: read as rows, written from rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship
from .documents import leaf, put, quoted

# Versions of the documents.
LOCK_VERSION, MEMORY_VERSION = 4, 1
#: Their names beside the source file, if no other is asked for.
LOCK_NAME, MEMORY_NAME = "lokalens.lock", "lokalens-memory.json"


def beside(source: str, name: str) -> str:
    """The path of a document that lies in the source file's folder."""
    folder, slash, _ = source.rpartition("/")
    return f"{folder}{slash}{name}"


def _map(of: Column) -> Column:
    """A JSON object (a variant) as a map of its values; null for anything else."""
    return F.try_variant_get(of, "$", "map<string,variant>")


def _strings(of: Column) -> Column:
    """The strings among the values of a map."""
    return F.transform_values(F.map_filter(of, lambda _, v: F.schema_of_variant(v) == "STRING"), lambda _, v: F.try_variant_get(v, "$", "string"))


@F.pandas_udf(StringType())
def _last_of_repeated(texts: pd.Series) -> pd.Series:
    """JSON texts whose objects name a key once: of a key that comes again its last value. Null where the text is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def _documents(texts: DataFrame) -> DataFrame:
    """texts with `doc`, the text as a variant. Texts that no variant can hold as they are, as a key comes twice, are read by Python."""
    ship(texts.sparkSession)
    first = texts.withColumn("doc", F.try_parse_json("text"))
    return first.withColumn("doc", F.coalesce("doc", F.try_parse_json(_last_of_repeated(F.when(F.col("doc").isNull(), F.col("text"))))))


def lock_rows(texts: DataFrame) -> DataFrame:
    """(path, lang, key, hash) of lock documents (path, text): rows of null lang are the record of all languages.

    An old lock is the flat map itself. Of a key named twice the last counts; a text that is no JSON object gives no rows."""
    top = _documents(texts).select("path", _map(F.col("doc")).alias("doc"))
    versioned = F.map_contains_key("doc", F.lit("version"))
    every = F.when(versioned, _strings(_map(F.col("doc")["keys"]))).otherwise(_strings(F.col("doc")))
    shared = top.select("path", F.lit(None).cast("string").alias("lang"), F.explode(every).alias("key", "hash"))
    langs = top.where(versioned).select("path", F.explode(_map(F.col("doc")["langs"])).alias("lang", "own"))
    return shared.unionByName(langs.select("path", "lang", F.explode(_strings(_map(F.col("own")))).alias("key", "hash")))


def recorded_settings(texts: DataFrame) -> DataFrame:
    """(path, settings) of lock documents (path, text): their settings as JSON, null where there are none."""
    return _documents(texts).select("path", F.to_json(F.try_variant_get("doc", "$.settings", "map<string,variant>")).alias("settings"))


def lock_settings(text: str | None) -> dict | None:
    """The settings a lock was written under; None if it is old, absent or damaged, which is no reason to translate anew."""
    try:
        doc = json.loads(text or "")
    except ValueError:
        return None
    return doc.get("settings") if isinstance(doc, dict) and "version" in doc else None


def memory_rows(texts: DataFrame) -> DataFrame:
    """(entry_id, source, lang, translated) of memory documents (path, text); a damaged one is empty."""
    entries = _documents(texts).select(F.explode(_map(_map(F.col("doc"))["entries"])).alias("entry_id", "entry"))
    fields = entries.select("entry_id", _strings(_map(F.col("entry"))).alias("entry"))
    return fields.select("entry_id", F.col("entry")["source"].alias("source"), F.explode(F.map_filter("entry", lambda k, _: k != "source")).alias("lang", "translated"))


def lock_leaves(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """The leaves (target, names, place, json) of locks from (path, lang, key, hash), rows of null lang being the record of all languages, and (path, settings), a row for each lock."""
    path = F.col("path")
    shared = rows.where("lang IS NULL").select(*leaf(path, [F.lit("keys"), F.col("key")], quoted(F.col("hash"))))
    langs = rows.where("lang IS NOT NULL").select(*leaf(path, [F.lit("langs"), F.col("lang"), F.col("key")], quoted(F.col("hash"))))
    bare = lambda which, name: settings.join(rows.where(which).select("path").distinct(), "path", "left_anti").select(*leaf(path, [F.lit(name)], F.lit("{}")))
    other = settings.select(*leaf(path, [F.lit("settings")], F.coalesce("settings", F.lit("null")))).unionByName(settings.select(*leaf(path, [F.lit("version")], F.lit(str(LOCK_VERSION)))))
    return shared.unionByName(langs).unionByName(bare("lang IS NULL", "keys")).unionByName(bare("lang IS NOT NULL", "langs")).unionByName(other)


def memory_leaves(path: str, rows: DataFrame) -> DataFrame:
    """The leaves of the memory document of (entry_id, source, lang, translated)."""
    at = lambda name: [F.lit("entries"), F.col("entry_id"), name]
    texts = rows.where("translated IS NOT NULL").select(*leaf(F.lit(path), at(F.col("lang")), quoted(F.col("translated"))))
    sources = rows.groupBy("entry_id").agg(F.max("source").alias("source")).where("source IS NOT NULL").select(*leaf(F.lit(path), at(F.lit("source")), quoted(F.col("source"))))
    one = rows.sparkSession.range(1).select(*leaf(F.lit(path), [F.lit("version")], F.lit(str(MEMORY_VERSION))))
    empty = rows.sparkSession.range(1).join(rows.limit(1).select(F.lit(0).cast("long").alias("id")), "id", "left_anti").select(*leaf(F.lit(path), [F.lit("entries")], F.lit("{}")))
    return texts.unionByName(sources).unionByName(one).unionByName(empty)


def write_lock(path: str, rows: DataFrame, settings: dict | None) -> None:
    """Writes (lang, key, hash) as a lock, sorted, by executors; rows of null lang are the record of all languages."""
    spark = rows.sparkSession
    said = None if settings is None else json.dumps(settings, ensure_ascii=False, sort_keys=True)
    put(lock_leaves(rows.withColumn("path", F.lit(path)), spark.createDataFrame([(path, said)], "path string, settings string")))


def write_memory(path: str, rows: DataFrame) -> None:
    """Writes (entry_id, source, lang, translated) as a memory, sorted, by executors."""
    put(memory_leaves(path, rows))
