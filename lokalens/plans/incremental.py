"""The incremental run over a source and its translations: what is to be translated, what memory knows of it, and the locks afterwards.

All languages are planned in one join. Translations themselves are input: between todo() and finished()
someone makes them, and hands them over as segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import keys as K
from ..operators import memory as M
from ..staging import staged


def judged(source: DataFrame, targets: DataFrame, lock: DataFrame, langs: DataFrame, all_anew: bool | DataFrame = False) -> DataFrame:
    """([file,] lang, key, hash, reason): every string of the source in every language that is not up to date.

    reason: 'missing' in the language, 'changed' since its lock, 'settings' (all others, if all_anew, or of the files in it), or
    'unverified': there, but in no lock, so that it is neither translated nor locked."""
    on = [*K.of_file(source, targets, lock), "lang", "key"]
    every = K.by_language(I.hashed(source), langs)
    anew = F.lit(all_anew) if isinstance(all_anew, bool) else F.coalesce("anew", F.lit(False))
    if not isinstance(all_anew, bool):
        every = every.join(all_anew.select("file", F.lit(True).alias("anew")).distinct(), "file", "left")
    held = targets.select(*on, F.lit(True).alias("there")).distinct()
    joined = every.join(held, on, "left").join(I.lock_of(lock, langs).select(*on, F.col("hash").alias("locked")), on, "left")
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("locked") != F.col("hash"), "changed")
    reason = reason.when(anew, "settings").when(F.col("locked").isNull(), "unverified")
    return joined.select(*on, "hash", reason.alias("reason")).where("reason IS NOT NULL")


def todo(found: DataFrame) -> DataFrame:
    """Of judged() the rows to translate."""
    return found.where("reason <> 'unverified'")


def reused(source: DataFrame, found: DataFrame, memory: DataFrame, of: dict | str) -> DataFrame:
    """([file,] lang, key, translated): what the memory knows of the rows to translate."""
    on = [*K.of_file(source, found), "lang", "key"]
    work = todo(found).select(*on)
    return M.recalled(source, memory, work, of).join(work, on, "left_semi")


def finished(source: DataFrame, lock: DataFrame, langs: DataFrame, found: DataFrame, failed: DataFrame, assume_current: bool = False) -> DataFrame:
    """([file,] lang, key, hash): the lock after the run; rows of null lang are the record of all languages.

    failed has the languages (of files) whose translations were not merged: their rows stay as they were locked, and so
    do unverified ones unless assume_current. Languages that were not in the run keep their records."""
    file = K.of_file(source, lock, found)
    on = [*file, "lang", "key"]
    bad = todo(found).join(failed.select(*file, "lang").distinct(), [*file, "lang"], "left_semi").select(*on)
    skipped = bad if assume_current else bad.unionByName(found.where("reason = 'unverified'").select(*on))
    old = I.lock_of(lock, langs).select(*on, F.col("hash").alias("old"))
    every = K.by_language(I.hashed(source), langs).join(old, on, "left").join(skipped.withColumn("skip", F.lit(True)).distinct(), on, "left")
    own = every.select(*on, F.when(F.col("skip").isNull(), F.col("hash")).otherwise(F.col("old")).alias("hash")).where("hash IS NOT NULL")
    others = lock.where("lang IS NOT NULL").join(langs.select("lang"), "lang", "left_anti").select(*on, "hash")
    by_lang = staged(own.unionByName(others), "by-lang")
    shared = I.advanced_global(source, lock.where("lang IS NULL").select(*file, "key", "hash"), by_lang, skipped)
    return by_lang.unionByName(shared.select(*file, F.lit(None).cast("string").alias("lang"), "key", "hash"))


def final_settings(recorded: dict | None, current: dict, any_failed: bool) -> dict | None:
    """The settings to record: the old ones while a change of settings has not reached every language."""
    return recorded if any_failed and I.settings_changed(recorded, current) else current
