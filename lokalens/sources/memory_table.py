"""A translation memory as a bucketed table, for memories that outgrow one document.

An entry is a row: its id, its source and a map of languages to translations. Entries are dealt to folders by the
first digits of their id (a hash), and within a folder to buckets by the whole id. So what is looked up or recorded
goes to the memory's buckets, and the memory itself is not shuffled. Recording writes the touched folders anew, as
another generation; a property of the table names the generation of each folder that counts. It is set last and at
once, so that a run that stops before leaves the memory as it was. Only one run may record at a time.

A bucket is one task's, so a memory whose buckets would outgrow BUCKET_BYTES is dealt anew to more of them, in a table
beside the first that the same property names. There are at least four times as many buckets then, so that happens
seldom, and a bucket is of one size whatever the memory's.

The table lives in the session's catalog: use a lasting one to keep it between applications.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators.incremental import entry_id
from ..operators.keys import of_file
from ..staging import staged

# Properties of the table: digits that name a folder, and each folder's generation, as in "0:5e1f03aa,7:9b20c4d1".
_DIGITS, _CURRENT = "lokalens.digits", "lokalens.current"
# The table that holds the rows, its number of buckets, and about how many bytes of text they have.
_ROWS, _BUCKETS, _BYTES = "lokalens.rows", "lokalens.buckets", "lokalens.bytes"
#: Bytes of text that a bucket has at most; a quarter of it when buckets are dealt.
BUCKET_BYTES = 128 << 20
#: What recorded() counts.
COUNTS = ("entries_added", "pairs_added", "pairs_changed", "pairs_same")


def create(spark: SparkSession, name: str, digits: int = 2, buckets: int = 64) -> None:
    """Creates an empty memory of 16 ** digits folders, each in so many buckets to begin with. Rows of a bucket are read by one task, from all folders."""
    if digits not in (1, 2):
        raise ValueError("1 or 2 digits name a folder, as the property that lists the folders has to stay short")
    _make(spark, name, buckets, {_DIGITS: digits, _CURRENT: "", _ROWS: "", _BUCKETS: int(buckets), _BYTES: 0})


def _make(spark: SparkSession, name: str, buckets: int, properties: dict) -> None:
    spark.sql(
        f"CREATE TABLE {name} (entry_id STRING, source STRING, texts MAP<STRING, STRING>, part STRING, generation STRING) USING parquet "
        f"PARTITIONED BY (part, generation) CLUSTERED BY (entry_id) SORTED BY (entry_id) INTO {int(buckets)} BUCKETS" + (f" TBLPROPERTIES ({_listed(properties)})" if properties else "")
    )


def _listed(properties: dict) -> str:
    return ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())


def drop(spark: SparkSession, name: str) -> None:
    """Drops the memory with the tables that hold or held its rows."""
    for held in [*_beside(spark, name), name]:
        spark.sql(f"DROP TABLE IF EXISTS {held}")


def _property(spark: SparkSession, name: str, key: str) -> str:
    return spark.sql(f"SHOW TBLPROPERTIES {name} ('{key}')").first()["value"]


def _rows(spark: SparkSession, name: str) -> str:
    """The table that holds the rows: the first one until it is dealt anew."""
    return _property(spark, name, _ROWS) or name


def _beside(spark: SparkSession, name: str) -> list[str]:
    """The tables that the memory was dealt to, also those of runs that stopped."""
    database, dot, own = name.rpartition(".")
    found = spark.sql("SHOW TABLES" + (f" IN {database}" if database else "") + f" LIKE '{own}__*'").collect()
    return [database + dot + r["tableName"] for r in found if re.fullmatch(re.escape(own.lower()) + "__[0-9a-f]{32}", r["tableName"].lower())]


def _generations(spark: SparkSession, name: str) -> dict[str, str]:
    return dict(x.split(":") for x in _property(spark, name, _CURRENT).split(",") if x)


def entries(spark: SparkSession, name: str) -> DataFrame:
    """(entry_id, source, texts)."""
    return _entries(spark, _rows(spark, name), _generations(spark, name))


def _entries(spark: SparkSession, rows: str, generations: dict[str, str]) -> DataFrame:
    now = [f"{p}:{g}" for p, g in generations.items()]
    return spark.table(rows).where(F.concat_ws(":", "part", "generation").isin(now) if now else F.lit(False)).select("entry_id", "source", "texts")


def pairs(spark: SparkSession, name: str) -> DataFrame:
    """The memory as rows (entry_id, source, lang, translated), as its document has them."""
    return entries(spark, name).select("entry_id", "source", F.explode("texts").alias("lang", "translated"))


def recalled(spark: SparkSession, name: str, source: DataFrame, langs: DataFrame, of: dict | str) -> DataFrame:
    """([file,] lang, key, translated): what memory.recalled() gives. Each text is looked up once, however many keys have it."""
    file = of_file(source)
    asked = source.where("vtype = 'string'").select(*file, "key", entry_id(F.col("value"), of).alias("entry_id"))
    # langs is the stated list of languages: dealt by language, what is found would be a task's for each of them
    # written, so that what is asked takes on the memory's partitioning, and what is found none: a text of very many keys can be split
    wanted = staged(asked.select("entry_id").distinct(), "asked")
    known = entries(spark, name).join(wanted, "entry_id").select("entry_id", F.explode("texts").alias("lang", "translated"))
    known = staged(known.where("translated <> ''").join(F.broadcast(langs.select("lang").distinct()), "lang", "left_semi"), "known")
    return asked.join(known, "entry_id").select(*file, "lang", "key", "translated")


def recorded(spark: SparkSession, name: str, source: DataFrame, translations: DataFrame, of: dict | str) -> dict[str, int]:
    """Puts translations in as memory.recorded() does, and returns COUNTS, taken while the folders are written. Without translations nothing is written."""
    return _put(spark, name, M.made(source, translations, of))


def imported(spark: SparkSession, name: str, rows: DataFrame) -> dict[str, int]:
    """Puts (entry_id, source, lang, translated) in, such as the rows of a memory document; of a pair named twice the greater translation stays."""
    last = rows.where("translated IS NOT NULL").groupBy("entry_id", "lang").agg(F.max("translated").alias("fresh"), F.max("source").alias("fresh_source"))
    return _put(spark, name, last)


def _put(spark: SparkSession, name: str, last: DataFrame) -> dict[str, int]:
    digits = int(_property(spark, name, _DIGITS))
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "fresh")))  # an entry has as many as there are languages
    fresh = staged(last.groupBy("entry_id").agg(F.max("fresh_source").alias("fresh_source"), by_lang.alias("fresh")).withColumn("part", F.substring("entry_id", 1, digits)), "recorded")
    size = lambda source, texts: F.coalesce(F.octet_length(source), F.lit(0)) + F.aggregate(F.map_values(texts), F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    added = {r["part"]: r["bytes"] for r in fresh.groupBy("part").agg(F.sum(size("fresh_source", "fresh")).alias("bytes")).collect()}  # 256 at most
    if not added:
        return dict.fromkeys(COUNTS, 0)
    before, buckets, rows = _generations(spark, name), int(_property(spark, name, _BUCKETS)), _rows(spark, name)
    held_bytes = int(_property(spark, name, _BYTES)) + sum(added.values())
    placed = lambda df, generation: df.select("entry_id", "source", "texts", F.substring("entry_id", 1, digits).alias("part"), F.lit(generation).alias("generation"))
    if held_bytes > buckets * BUCKET_BYTES:  # dealt anew, to a table that counts once the property says so
        while held_bytes > buckets * BUCKET_BYTES // 4:
            buckets *= 2
        dealt = f"{name}__{uuid.uuid4().hex}"
        _make(spark, dealt, buckets, {})
        if before:
            generation = uuid.uuid4().hex[:8]
            placed(_entries(spark, rows, before), generation).repartition(buckets, "entry_id").write.insertInto(dealt)
            before = dict.fromkeys(before, generation)
        rows = dealt
    old = _entries(spark, rows, {p: g for p, g in before.items() if p in added}).withColumnRenamed("texts", "old")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = old.join(fresh.drop("part").repartition(buckets, "entry_id"), "entry_id", "full").withColumn("is_added", F.col("old").isNull()).withColumns({"old": F.coalesce("old", none), "fresh": F.coalesce("fresh", none)})
    held = lambda k: F.map_contains_key("old", k)
    n = lambda which: F.coalesce(F.sum(F.size(F.map_filter("fresh", which))), F.lit(0))
    seen = Observation()
    kept = F.map_filter("old", lambda k, _: ~F.map_contains_key("fresh", k))
    both = both.withColumns({"source": F.coalesce("source", "fresh_source"), "texts": F.map_concat(kept, "fresh")}).observe(
        seen,
        F.count_if("is_added").alias("entries_added"),
        n(lambda k, _: ~held(k)).alias("pairs_added"),
        n(lambda k, v: held(k) & (F.col("old")[k] != v)).alias("pairs_changed"),
        n(lambda k, v: held(k) & (F.col("old")[k] == v)).alias("pairs_same"),
        F.sum(size("source", "texts")).alias("bytes"),
    )
    generation = uuid.uuid4().hex[:8]
    placed(both, generation).write.insertInto(rows)
    now = before | dict.fromkeys(added, generation)
    set_ = {_CURRENT: ",".join(f"{p}:{g}" for p, g in sorted(now.items())), _ROWS: "" if rows == name else rows, _BUCKETS: buckets}
    set_[_BYTES] = seen.get["bytes"] * len(now) // len(added)  # folders are about equally large, as ids are hashes
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({_listed(set_)})")
    return {c: seen.get[c] for c in COUNTS}


def vacuum(spark: SparkSession, name: str) -> int:
    """Drops the generations that no longer count, and the tables that hold none; how many generations. Those who still read them must have finished."""
    now, rows, dropped = set(_generations(spark, name).items()), _rows(spark, name), 0
    for table in [*_beside(spark, name), name]:
        held = [tuple(x.split("=")[1] for x in r["partition"].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
        old = [(p, g) for p, g in held if table != rows or (p, g) not in now]
        if table not in (name, rows):
            spark.sql(f"DROP TABLE {table}")
        elif old:
            spark.sql(f"ALTER TABLE {table} DROP " + ", ".join(f"PARTITION (part = '{p}', generation = '{g}')" for p, g in old))
        dropped += len(old)
    return dropped
