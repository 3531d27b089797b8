"""The incremental run over files: sources, translations, locks and the memory are read at once, and written at once.

open_run() tells what is to be translated and what the memory knows of it; someone translates; close_run()
merges, advances the locks, records in the memory, and commits all files together. A run that stops while they are
put in place is finished by the next one. No language or file is planned by itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import keys as K
from ..operators import memory as M
from ..sources import decode, documents, stores
from ..staging import staged
from . import incremental as P
from . import projects as R

#: What is put behind a source file's name for its lock.
LOCK_SUFFIX = ".lock"

# No key of a document stands as far back; of two such numbers the sum is a long.
_LAST = (1 << 61) - 1


@dataclass
class Run:
    """An open run: what was read, and what is judged. recorded (file, settings, changed) are the locks' settings as JSON."""

    spark: SparkSession
    folder: str
    langs: DataFrame
    settings: dict
    project: R.Project
    source: DataFrame
    lock: DataFrame
    memory: DataFrame
    recorded: DataFrame
    found: DataFrame

    def work(self) -> DataFrame:
        """(file, lang, key, ord, text, hash, reason, translated): the strings to translate; translated is the memory's, null where someone has to."""
        known = P.reused(self.source, self.found, self.memory, self.settings)
        texts = self.source.select("file", "key", "ord", F.col("value").alias("text"))
        return P.todo(self.found).join(texts, ["file", "key"]).join(known, ["file", "lang", "key"], "left").select("file", "lang", "key", "ord", "text", "hash", "reason", "translated")

    def counts(self) -> DataFrame:
        """(file, lang, new, edited, from_memory, unverified): what there is to do, a row for each file and language."""
        every = K.by_language(self.source.select("file").distinct(), self.langs)
        n = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
        judged = self.found.groupBy("file", "lang").agg(n("missing").alias("new"), n("changed", "settings").alias("edited"), n("unverified").alias("unverified"))
        known = self.work().groupBy("file", "lang").agg(F.count("translated").alias("from_memory"))
        return every.join(judged, ["file", "lang"], "left").join(known, ["file", "lang"], "left").fillna(0).select("file", "lang", "new", "edited", "from_memory", "unverified")


def _changed(settings: Column, current: dict) -> Column:
    """Whether recorded settings (JSON) differ from the current ones; what was not recorded never does, and models only if both are known."""
    doc = F.try_parse_json(settings)
    read = lambda name, kind: F.try_variant_get(doc, f"$.{name}", kind)
    differs = F.lit(False)
    for name, kind, now in (("tone", "string", F.lit(current["tone"])), ("icu", "boolean", F.lit(current["icu"])), ("app_context", "string", F.lit(current["app_context"])), ("keep", "array<string>", F.array(*map(F.lit, current["keep"])).cast("array<string>"))):
        differs = differs | F.coalesce(read(name, kind) != now, F.lit(False))
    model = F.coalesce(read("model", "string"), F.lit(""))
    return differs | ((model != "") & (model != current["model"])) if current["model"] else differs


def open_run(spark: SparkSession, folder: str, specs: str | list[str], langs: list[str], settings: dict | None = None, out: str = "", source_lang: str = "en", pattern: str | None = None) -> Run:
    """Reads a project: sources that the paths and globs name, their translations, each source's lock beside it (its name and LOCK_SUFFIX) and the project folder's memory.

    Before that, a commit in the folder that was interrupted is finished. Catalogs are left out, as they have no file a language. A source that cannot be read is an error."""
    home = spark.range(1).select(R.whole_path(spark, F.lit(folder)).alias("at")).first()["at"]
    documents.finish(spark, home)
    asked = spark.createDataFrame([(x,) for x in langs], "lang string").distinct()
    sources = R.resolve_sources(spark, specs).where(F.lower("file").rlike(r"\.(json|arb)$"))
    project = R.read_project(spark, sources, asked, out, source_lang, pattern)
    bad = project.problems.where("lang IS NULL").first()
    if bad:
        raise ValueError(f"{bad['file']}: {bad['error']}")
    current = settings or I.settings()
    files = project.files.select("file").distinct()
    locks = R.listed(spark, R._globs(files.select(F.concat("file", F.lit(LOCK_SUFFIX)).alias("path"))), "content")
    texts = staged(decode.texts(locks).withColumn("file", F.regexp_replace("path", r"\.lock$", "")).join(files, "file", "left_semi").select(F.col("file").alias("path"), "text"), "locks")
    lock = staged(stores.lock_rows(texts).withColumnRenamed("path", "file"), "lock")
    recorded = staged(stores.recorded_settings(texts).select(F.col("path").alias("file"), "settings", _changed(F.col("settings"), current).alias("changed")), "settings")
    memory = staged(stores.memory_rows(decode.texts(R.listed(spark, [_literal(f"{home}/{stores.MEMORY_NAME}")], "content"))), "memory")
    source = project.source.where("vtype = 'string'")
    found = staged(P.judged(source, project.target, lock, asked, recorded.where("changed").select("file")), "judged")
    return Run(spark, home, asked, current, project, source, lock, memory, recorded, found)


def _literal(path: str) -> str:
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def merged_locales(run: Run, made: DataFrame) -> DataFrame:
    """(target, key, place, value, vtype, flat): the documents of the files and languages that got translations, with them put in.

    A document keeps its style, flat or nested; a new one has its source's. An ARB document says its language in @@locale."""
    by = ["file", "lang"]
    touched = made.select(*by).distinct()
    old = run.project.target.unionByName(run.project.metadata).join(touched, by, "left_semi")
    stamp = touched.where(F.lower("file").endswith(".arb")).select(*by, F.lit("@@locale").alias("key"), F.lit(_LAST).alias("ord"), F.col("lang").alias("value"), F.lit("string").alias("vtype"))
    fresh = made.select(*by, "key", "ord", "value", F.lit("string").alias("vtype")).unionByName(stamp)
    own = documents.styles(old, by)
    theirs = documents.styles(run.project.source, ["file"]).withColumnRenamed("flat", "of_source")
    style = touched.join(own, by, "left").join(theirs, "file", "left").join(run.project.files.select(*by, F.col("path").alias("target")), by)
    style = style.select(*by, "target", F.coalesce("flat", "of_source", F.lit(True)).alias("flat"))
    # one number sorts and is aggregated faster than a struct: new keys come after all old ones
    place = F.when(F.col("place.new"), F.lit(_LAST + 1)).otherwise(F.lit(0)) + F.col("place.ord")
    return K.merged(old, fresh, ("file", "lang")).join(style, by).select("target", "key", place.alias("place"), "value", "vtype", "flat")


def stage_run(run: Run, translations: DataFrame, failed: DataFrame | None = None, assume_current: bool = False) -> list[tuple[str, str]]:
    """Writes all documents of a run beside the project's, and returns what is to be moved where.

    translations (file, lang, key, value) are merged where they were asked for; those of failed (file, lang) are not, nor are
    files and languages of which nothing came. See close_run."""
    on = ["file", "lang", "key"]
    spark, asked = run.spark, P.todo(run.found)
    failed = failed.select("file", "lang").distinct() if failed is not None else spark.createDataFrame([], "file string, lang string")
    ords = run.source.select("file", "key", "ord")
    made = translations.select(*on, "value").join(asked.select(*on), on, "left_semi").join(failed, ["file", "lang"], "left_anti").dropDuplicates(on)
    made = staged(made.join(ords, ["file", "key"]).select(*on, "ord", "value"), "made")
    # a string that did not come is not done, whatever came for its language
    lost = staged(asked.join(made.select(*on), on, "left_anti"), "lost")
    lock = P.finished(run.source, run.lock, run.langs, run.found.where("reason = 'unverified'").unionByName(lost), lost.select("file", "lang"), assume_current)
    broken = lost.select("file").distinct().withColumn("broken", F.lit(True))
    now = F.lit(json.dumps(run.settings, ensure_ascii=False, sort_keys=True))
    kept = F.coalesce("changed", F.lit(False)) & F.coalesce("broken", F.lit(False))
    said = run.project.files.select("file").distinct().join(run.recorded, "file", "left").join(broken, "file", "left").select("file", F.when(kept, F.col("settings")).otherwise(now).alias("settings"))
    at = F.concat("file", F.lit(LOCK_SUFFIX))
    # leaves are made of tables that are written: each is read several times, and the documents' names come from it
    merged = staged(merged_locales(run, made), "merged")
    moves = documents.stage(documents.placed(merged, ["target"]), run.folder, merged)
    lock, said = staged(lock.select(at.alias("path"), "lang", "key", "hash"), "locked"), staged(said.select(at.alias("path"), "settings"), "said")
    moves += documents.stage(stores.lock_leaves(lock, said), run.folder, said.select(F.col("path").alias("target")))
    memory = staged(M.recorded(run.memory, run.source, made.withColumn("vtype", F.lit("string")), run.settings), "remembered")
    if not memory.where("is_new").isEmpty():
        path = f"{run.folder}/{stores.MEMORY_NAME}"
        moves += documents.stage(stores.memory_leaves(path, memory.drop("is_new")), run.folder, spark.range(1).select(F.lit(path).alias("target")))
    return moves


def close_run(run: Run, translations: DataFrame, failed: DataFrame | None = None, assume_current: bool = False) -> int:
    """Merges translations (file, lang, key, value), advances the locks, records in the memory; how many files that changed.

    All are written first and put in place together. Strings whose translation did not come, or came for a failed (file, lang),
    stay as they were locked and are due again."""
    moves = stage_run(run, translations, failed, assume_current)
    documents.commit(run.spark, run.folder, moves)
    return len(moves)
