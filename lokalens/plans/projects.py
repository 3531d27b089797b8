"""The check of many source files at once: where their translations lie, one scan of all files, one plan of all findings.

Sources and languages make a table of the files that are wanted. The folders they lie in are listed and read
in one scan, and files meet the table by their path: nothing is planned file by file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import decode
from ..sources import segments as S
from ..staging import staged
from .check import check

_GLOB = "*?["


def working_folder(spark: SparkSession) -> str:
    """The folder that relative paths start from, as Hadoop names it."""
    return spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(spark._jvm.org.apache.hadoop.fs.Path(".")).mkString("")


def whole_path(spark: SparkSession, path: Column) -> Column:
    """A path with its scheme, as the scans name it."""
    home = working_folder(spark)
    scheme = home[: home.index(":") + 1] if ":" in home else ""
    seen = P.within(F.lit(home), path)
    return F.when(seen.startswith("/"), F.concat(F.lit(scheme), seen)).otherwise(seen)


def literal(path: Column) -> Column:
    """A path as a glob that matches nothing else."""
    return F.regexp_replace(path, r"([\\*?\[\]{}])", r"\\$1")


def _unescaped(glob: str) -> str | None:
    """The one path that a glob without * ? [ means."""
    return None if re.search(r"(?<!\\)[*?\[]", glob) else re.sub(r"\\(.)", r"\1", glob)


def _pattern(glob: str) -> str:
    """A glob as a regular expression; * and ? stay within a name."""
    parts = re.findall(r"\\.|\[[^\]]*\]|.", glob, re.S)
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(x, x.replace("[!", "[^") if len(x) > 2 else re.escape(x[-1])) for x in parts)


def listed(spark: SparkSession, globs: list[str], *columns: str) -> DataFrame:
    """(path, *columns) of the files that the globs match, a file once; content is read only if it is asked for."""
    util, path = spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get(), spark._jvm.org.apache.hadoop.fs.Path
    found = [g for g in dict.fromkeys(globs) if not util.globPath(path(g)).isEmpty()]  # a scan fails on a glob without a match
    if not found:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary").select("path", *columns)
    single = {g: _unescaped(g) for g in found}
    fits = F.col("path").isin([p for p in single.values() if p is not None])
    for g in (g for g, p in single.items() if p is None):
        fits = fits | F.col("path").rlike(f"^{_pattern(g)}$")
    # a scan of a folder that a glob matches gives the files in it, and a file that two globs match twice
    rows = spark.read.format("binaryFile").load(found).select("path", *columns).where(fits)
    return rows if "content" in columns or len(found) == 1 else rows.dropDuplicates(["path"])


def resolve_sources(spark: SparkSession, specs: str | list[str]) -> DataFrame:
    """(file): the files that paths and globs name, each once; what does not exist is left out. A path that is there as written is meant so, even with * ? [ in it; braces are no alternatives."""
    given = [str(x).strip() for x in ([specs] if isinstance(specs, str) else specs)]
    rows = spark.createDataFrame([(x, any(c in x for c in _GLOB)) for x in given if x], "spec string, glob boolean")
    path = whole_path(spark, F.col("spec"))
    shown = rows.select(F.explode(F.array_compact(F.array(literal(path), F.when(F.col("glob"), F.regexp_replace(path, r"([{}])", r"\\$1"))))).alias("glob"))
    return listed(spark, [r["glob"] for r in shown.distinct().collect()]).select(F.col("path").alias("file"))


def one_source(spark: SparkSession, spec: str) -> tuple[str | None, int]:
    """The first of the files that a path or glob names, none if there is none, and how many others there are."""
    r = resolve_sources(spark, spec).agg(F.min("file").alias("first"), F.count("*").alias("n")).first()
    return r["first"], max(r["n"] - 1, 0)


def wanted(spark: SparkSession, sources: DataFrame, langs: DataFrame, out: str = "", source_lang: str = "en", pattern: str | None = None) -> DataFrame:
    """(file, lang, path): where the translation of each source into each language lies. A catalog holds its own."""
    each = sources.join(F.broadcast(langs.select("lang").distinct()), how="cross")
    out_dir = whole_path(spark, F.lit(out)) if out else F.lit("")
    if pattern:
        folder = out_dir if out else F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
        target = P.normal(F.concat(folder, F.lit("/"), S.pattern_path(F.lit(pattern), F.col("lang"))))
    else:
        target = P.normal(S.target_path(F.col("file"), F.col("lang"), out_dir, F.lit(source_lang)))
    return each.select("file", "lang", F.when(_catalog(F.col("file")), F.col("file")).otherwise(target).alias("path"))


def _catalog(path: Column) -> Column:
    return F.lower(path).endswith(".xcstrings")


def _globs(files: DataFrame) -> list[str]:
    """Globs of the files (path): of a folder that holds many, all files of their extension. They are as many as folders and extensions, and no two match one file."""
    folder, ext = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    by = files.select("path", literal(folder).alias("folder"), literal(ext).alias("ext")).groupBy("folder", "ext").agg(F.count_distinct("path").alias("n"), F.min(literal(F.col("path"))).alias("one"))
    return [r["glob"] for r in by.select(F.when(F.col("n") == 1, F.col("one")).otherwise(F.concat("folder", F.lit("/*"), "ext")).alias("glob")).collect()]


@dataclass
class Project:
    """What was read of sources and their translations.

    source (file, key, ord, value, vtype, level) and target (file, lang, key, ord, value, vtype, level) are segments; metadata has those
    of ARB files' metadata, like target; files (file, lang, path, there) are the translations looked for; problems
    (file, lang, path, error) could not be read, lang is null for sources."""

    source: DataFrame
    target: DataFrame
    metadata: DataFrame
    files: DataFrame
    problems: DataFrame


def read_project(spark: SparkSession, sources: DataFrame, langs: DataFrame, out: str = "", source_lang: str = "en", pattern: str | None = None) -> Project:
    """Sources (file) and their translations, in one scan. A translation that cannot be read, or is no object, counts as missing."""
    sources = staged(sources.select("file"), "sources")
    aims = staged(wanted(spark, sources, langs, out, source_lang, pattern), "targets")
    roles = sources.select("file", F.lit(None).cast("string").alias("lang"), F.col("file").alias("path")).unionByName(aims.where(~_catalog(F.col("file"))))
    files = listed(spark, _globs(roles), "content").join(roles.select("path").distinct(), "path", "left_semi")
    texts = staged(decode.texts(files), "texts")
    plain = S.flatten(texts.where(~_catalog(F.col("path")) & F.col("error").isNull()))
    catalogs = S.catalog(texts.where(_catalog(F.col("path")) & F.col("error").isNull())).withColumn("level", F.lit(0).cast("long"))
    leaves = ["key", "ord", "value", "vtype", "level", "error"]
    bad = texts.where("error IS NOT NULL").join(roles, "path").select("file", "lang", "path", *(F.lit(None).cast(t).alias(c) for c, t in zip(leaves, ("string", "long", "string", "string", "long"), strict=False)), "error")
    own = F.when(F.col("lang") != F.col("source_lang"), F.col("lang"))
    rows = plain.join(roles, "path").select("file", "lang", "path", *leaves).unionByName(catalogs.select(F.col("path").alias("file"), own.alias("lang"), "path", *leaves)).unionByName(bad)
    rows = staged(rows, "segments")
    meta = F.lower("path").endswith(".arb") & F.col("key").startswith("@")
    fine = rows.where(F.col("error").isNull() & ~meta)
    metadata = rows.where(F.col("error").isNull() & meta & F.col("lang").isNotNull()).select("file", "lang", *leaves[:-1])
    target = fine.where("lang IS NOT NULL").select("file", "lang", *leaves[:-1])
    # an object without leaves is there all the same; a catalog has the languages of which it has entries
    there = texts.where("error IS NULL").select("path").join(aims.where(~_catalog(F.col("file"))), "path").join(rows.where("error IS NOT NULL").select("path").distinct(), "path", "left_anti").select("file", "lang")
    there = there.unionByName(target.where(_catalog(F.col("file"))).select("file", "lang").distinct()).withColumn("there", F.lit(True))
    return Project(fine.where("lang IS NULL").select("file", *leaves[:-1]), target, metadata, aims.join(there, ["file", "lang"], "left").fillna(False, ["there"]), rows.where("error IS NOT NULL").select("file", "lang", "path", "error"))


def check_project(project: Project, langs: DataFrame, glossary: list[str] | None = None, counts: Observation | None = None) -> DataFrame:
    """Findings (see check, with detail) of every source, each with its file and the path of the translation it is about."""
    found = check(project.source, project.target, langs, glossary, counts, detail=True).where("kind <> 'missing_file'")
    absent = project.files.where(~F.col("there")).select("file", "lang", F.lit("missing_file").alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("ord", "long"))), F.lit(0).alias("seq"), F.lit("missing-key").alias("rule"), F.lit(None).cast("string").alias("text"))
    return found.unionByName(absent, allowMissingColumns=True).join(project.files.select("file", "lang", "path"), ["file", "lang"], "left")


def check_sources(spark: SparkSession, specs: str | list[str], langs: list[str], out: str = "", source_lang: str = "en", pattern: str | None = None, glossary: list[str] | None = None) -> tuple[DataFrame, Project]:
    """check_project of the files that paths and globs name."""
    asked = spark.createDataFrame([(x,) for x in langs], "lang string")
    project = read_project(spark, resolve_sources(spark, specs), asked, out, source_lang, pattern)
    return check_project(project, asked, glossary), project
