"""The check of locale files: where they lie, what they hold, and the report."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import segments as S
from . import projects as R

# Settings of a project that are not given, and the longest application context that is heeded.
DEFAULTS = {"source": "locales/en.json", "source_lang": "en", "langs": ["es", "fr", "de"], "keep": [], "context": "", "tone": "neutral", "icu": False, "only_new": False, "out": "locales", "format": "auto"}
CONTEXT_LIMIT = 300
# What the layouts of common frameworks set otherwise.
PRESETS = {
    "i18next": {"source": "locales/en/translation.json", "out": "locales"},
    "react-i18next": {"source": "locales/en/translation.json", "out": "locales"},
    "next-intl": {"source": "messages/en.json", "icu": True, "out": "messages"},
    "react-intl": {"icu": True},
    "vue-i18n": {"source": "src/locales/en.json", "out": "src/locales"},
    "flutter-arb": {"source": "lib/l10n/app_en.arb", "format": "arb", "out": "lib/l10n"},
}


def config(text: str | None, preset: str | None = None, **given) -> dict:
    """Settings: what is given, else the JSON text's, else the preset's, else the defaults. Keys that start with // or _ are comments; the context is trimmed and cut to its limit."""
    read = json.loads(text) if text else {}
    own = {k: v for k, v in read.items() if not k.startswith(("//", "_"))}
    out = DEFAULTS | (PRESETS[preset] if preset else {}) | own | {k: v for k, v in given.items() if v is not None}
    return out | {"context": (out["context"] or "").strip()[:CONTEXT_LIMIT]}


def check_files(spark: SparkSession, source: str | list[str], langs: list[str], out: str = "", source_lang: str = "en", pattern: str | None = None, glossary: list[str] | None = None) -> tuple[DataFrame, R.Project]:
    """Findings (projects.check_project) of the files that paths and globs name, and what was read. An error if there are none, or one of them cannot be read; a translation that cannot be read counts as missing."""
    found, project = R.check_sources(spark, source, langs, out, source_lang, pattern, glossary)
    bad = project.problems.where("lang IS NULL").first()
    if bad:
        raise ValueError(f"{bad['file']}: {bad['error']}")
    if project.files.isEmpty():
        raise ValueError(f"no source file: {source}")
    return found, project


def shown(found: DataFrame, first: int = 10) -> DataFrame:
    """(file, lang, kind, n, keys, rank, text): rows of a report. Of missing and extra keys one row with the number and the first of them, of others a row for each, in order."""
    by = ["file", "lang", "kind"]
    of_key = Window.partitionBy(*by).orderBy("name")
    listed = found.where("kind IN ('missing', 'extra')").withColumn("name", S.shown_key(F.col("key"))).withColumn("rank", F.row_number().over(of_key))
    n = found.groupBy(*by).agg(F.count("*").alias("n"))
    keys = listed.where(F.col("rank") <= first).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("keys")).withColumns({"rank": F.lit(0).cast("long"), "text": F.lit(None).cast("string")})
    text = F.concat_ws(": ", S.shown_key(F.col("key")), S.shown_key(F.col("text")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("seq", "ord", "text")).cast("long")
    others = found.where("kind NOT IN ('missing', 'extra')").select(*by, "seq", "ord", text.alias("text")).select(*by, F.lit(None).cast("array<string>").alias("keys"), place.alias("rank"), "text")
    return keys.select(*by, "keys", "rank", "text").unionByName(others).join(n, by)


def report(found: DataFrame, project: R.Project, first: int = 10) -> Iterator[str]:
    """Lines for people, which come to the driver a partition at a time: of keys the first few, of faults and warnings all."""
    labels = {"missing_file": "", "missing": "missing key(s)", "placeholder": "placeholder mismatch(es)", "error": "translation fault(s)", "warning": "warning(s)", "extra": "extra/stale key(s)"}
    order = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, i)])[F.col("kind")]
    absent = project.files.where(~F.col("there")).select("file", "lang")
    rows = shown(found, first).join(absent.withColumn("gone", F.lit(True)), ["file", "lang"], "left").where(F.col("gone").isNull() | (F.col("kind") == "missing_file"))
    rows = project.files.select("file", "lang", "path").join(rows, ["file", "lang"], "left").orderBy("file", "lang", order, "rank")
    many, file, kind = project.files.select("file").distinct().limit(2).count() > 1, None, None
    for r in rows.toLocalIterator():
        if many and r["file"] != file:
            yield f"── {r['file']} ──"
        if r["kind"] is None:
            yield f"{r['lang']}: complete & placeholder-safe"
        elif r["kind"] == "missing_file":
            yield f"{r['lang']}: locale file not found ({r['path']})"
        elif r["keys"] is not None:
            yield f"{r['lang']}: {r['n']} {labels[r['kind']]}: {', '.join(r['keys'])}" + (" ..." if r["n"] > first else "")
        else:
            if (r["file"], r["lang"], r["kind"]) != kind:
                yield f"{r['lang']}: {r['n']} {labels[r['kind']]}:"
            yield f"    {r['text']}"
        file, kind = r["file"], (r["file"], r["lang"], r["kind"])


def result_json(found: DataFrame, ok: bool) -> Iterator[str]:
    """The result of one source's check as JSON, in pieces: ok, missing and extra keys by language, placeholder_issues, missing_files, faults, warnings. Rows come to the driver a partition at a time."""
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    yield f'{{"ok": {dump(ok)}'

    def by_language(kind: str) -> Iterator[str]:
        lang = None
        for r in found.where(F.col("kind") == kind).orderBy("lang", "key").select("lang", "key").toLocalIterator():
            yield ", " if r["lang"] == lang else f"{'], ' if lang is not None else ''}{dump(r['lang'])}: ["
            yield dump(r["key"])
            lang = r["lang"]
        yield "" if lang is None else "]"

    def each(rows: DataFrame, of: Callable) -> Iterator[str]:
        for i, r in enumerate(rows.orderBy("lang", "seq", "ord", "text").toLocalIterator()):
            yield (", " if i else "") + dump(of(r))

    kind = lambda k: found.where(F.col("kind") == k)
    said = lambda severity: lambda r: {"lang": r["lang"], **({"key": r["key"]} if r["key"] is not None else {}), "severity": severity, "msg": r["text"]}
    for name in ("missing", "extra"):
        yield f', "{name}": {{'
        yield from by_language(name)
        yield "}"
    lists = {
        "placeholder_issues": each(kind("placeholder"), lambda r: {"lang": r["lang"], "key": r["key"], "missing": r["lost"], "added": r["added"]}),
        "missing_files": each(kind("missing_file"), lambda r: r["lang"]), "faults": each(kind("error"), said("error")), "warnings": each(kind("warning"), said("warn")),
    }
    for name, parts in lists.items():
        yield f', "{name}": ['
        yield from parts
        yield "]"
    yield "}"
