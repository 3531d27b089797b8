"""Change detection against a lock of source hashes: joins by key. Where tables have a column `file`, each source file is by itself."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import by_language, of_file


def hashed(source: DataFrame) -> DataFrame:
    """([file,] key, hash) of string segments."""
    return source.where("vtype = 'string'").select(*of_file(source), "key", F.sha2("value", 256).alias("hash"))


def lock_of(lock: DataFrame, langs: DataFrame) -> DataFrame:
    """([file,] lang, key, hash): each language's own record, else the global one (rows of null lang)."""
    file = of_file(lock)
    own, shared = lock.where("lang IS NOT NULL").select(*file, "lang", "key", "hash"), lock.where("lang IS NULL").select(*file, "key", "hash")
    every = by_language(shared.select(*file).distinct(), langs) if file else langs.select("lang").distinct()
    without = every.join(own.select(*file, "lang").distinct(), [*file, "lang"], "left_anti")
    passed_on = shared.join(without, file) if file else shared.join(F.broadcast(without), how="cross")
    return own.unionByName(passed_on.select(*file, "lang", "key", "hash"))


def pending(source: DataFrame, target: DataFrame, lock: DataFrame) -> DataFrame:
    """(key, hash, reason): source strings the target lacks ('missing') or whose locked hash is another ('changed')."""
    held = target.select("key", F.lit(True).alias("there")).distinct()
    known = lock.select("key", F.col("hash").alias("locked"))
    joined = hashed(source).join(held, "key", "left").join(known, "key", "left")
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("locked") != F.col("hash"), "changed")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("key", "hash", "reason")


def unverified(source: DataFrame, target: DataFrame, lock: DataFrame) -> DataFrame:
    """Source strings that the target has but no lock entry vouches for."""
    return hashed(source).join(target.select("key").distinct(), "key", "left_semi").join(lock.select("key").distinct(), "key", "left_anti")


def advanced(source: DataFrame, lock: DataFrame, skipped: DataFrame) -> DataFrame:
    """(lang, key, hash): each language's lock after a run. skipped (lang, key) failed or are unverified and keep what they had; keys no longer in the source go."""
    now = hashed(source)
    langs = lock.select("lang").unionByName(skipped.select("lang")).where("lang IS NOT NULL").distinct()
    every = now.join(F.broadcast(langs), how="cross")
    joined = every.join(lock.where("lang IS NOT NULL").select("lang", "key", F.col("hash").alias("old")), ["lang", "key"], "left").join(skipped.select("lang", "key", F.lit(True).alias("skip")).distinct(), ["lang", "key"], "left")
    return joined.select("lang", "key", F.when(F.col("skip").isNull(), F.col("hash")).otherwise(F.col("old")).alias("hash")).where("hash IS NOT NULL")


def advanced_global(source: DataFrame, before: DataFrame, by_lang: DataFrame, skipped: DataFrame) -> DataFrame:
    """([file,] key, hash): the lock of all languages: the current hash where every language holds it; skipped keys keep theirs; any other goes."""
    now = hashed(source)
    file = of_file(source)
    on = [*file, "key"]
    langs = by_lang.select(*file, "lang").distinct()
    n = langs.groupBy(*file).agg(F.count("*").alias("langs")) if file else langs.agg(F.count("*").alias("langs"))
    held = by_lang.join(now, [*on, "hash"]).groupBy(*on).agg(F.count("*").alias("n"))
    fresh = now.join(held, on, "left")
    fresh = fresh.join(n, file, "left") if file else fresh.join(F.broadcast(n), how="cross")
    fresh = fresh.join(skipped.select(*on).distinct().withColumn("skip", F.lit(True)), on, "left").join(before.select(*on, F.col("hash").alias("old")), on, "full")
    keep = F.when(F.col("hash").isNull() | F.col("skip").isNotNull(), F.col("old")).when(F.coalesce("n", F.lit(0)) == F.col("langs"), F.col("hash"))
    return fresh.select(*on, keep.alias("hash")).where("hash IS NOT NULL")


def settings(tone: str = "", icu: bool = False, keep: list[str] | str = (), model: str = "", app_context: str = "") -> dict:
    """The settings a translation was made under, in one form; a neutral tone is none."""
    tone = "" if (tone or "").strip() == "neutral" else tone
    terms = keep.split(",") if isinstance(keep, str) else keep
    return {"tone": (tone or "").strip(), "icu": bool(icu), "keep": sorted(t.strip() for t in terms or [] if t and t.strip()), "model": (model or "").strip(), "app_context": (app_context or "").strip()}


def settings_changed(recorded: dict | None, current: dict) -> bool:
    """Whether a recorded setting differs; one that was not recorded never does, and models only if both are known."""
    if not isinstance(recorded, dict) or not recorded:
        return False
    if any(k in recorded and recorded[k] != current.get(k) for k in ("tone", "icu", "keep", "app_context")):
        return True
    return bool(recorded.get("model") and current.get("model") and recorded["model"] != current["model"])


def signature(of: dict | str | None) -> str:
    return of if isinstance(of, str) else json.dumps(of or {}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def entry_id(text: Column, of: dict | str | None) -> Column:
    """The key of a remembered translation: the text under these settings."""
    return F.substring(F.sha2(F.concat(F.lit(signature(of)), F.lit("\x00"), text), 256), 1, 32)
