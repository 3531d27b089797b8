"""Reports and documents written from tables: SARIF, locks, locale JSON."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import SARIF_RULES, SARIF_SCHEMA
from .documents import placed, put


def key_lines(texts: DataFrame) -> DataFrame:
    """(path, leaf, line): the first line on which each JSON key of (path, text) is defined."""
    lines = texts.select("path", F.posexplode(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("pos", "line"))
    leaf = F.regexp_extract("line", r'(?U)^\s*"((?:[^"\\]|\\.)*)"\s*:', 1)
    return lines.select("path", leaf.alias("leaf"), "pos").where("leaf <> ''").groupBy("path", "leaf").agg((F.min("pos") + 1).alias("line"))


def sarif_results(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row per finding (kind, lang, key, text, path): its result as SARIF has it, (rule, level, text, uri, line).

    kind: missing, extra, placeholder, error, warning, missing_file. Missing keys and files stand on line 1."""
    rules = F.create_map(*[F.lit(x) for kv in {"missing": "missing-key", "extra": "extra-key", "placeholder": "placeholder", "error": "translation-fault", "warning": "translation-warning", "missing_file": "missing-key"}.items() for x in kv])
    levels = F.create_map(*[F.lit(x) for kv in {"missing": "error", "extra": "note", "placeholder": "error", "error": "error", "warning": "warning", "missing_file": "error"}.items() for x in kv])
    head = F.concat(F.lit("["), F.col("lang"), F.lit("] "))
    text = (
        F.when(F.col("kind") == "missing", F.concat(head, F.lit('missing translation for key "'), F.col("key"), F.lit('"')))
        .when(F.col("kind") == "extra", F.concat(head, F.lit('key "'), F.col("key"), F.lit('" is not in the source file')))
        .when(F.col("kind") == "missing_file", F.concat(head, F.lit("no locale file found for this language")))
        .otherwise(F.concat(head, F.coalesce("key", F.lit("None")), F.lit(": "), F.coalesce("text", F.lit(""))))
    )
    out = findings.select("kind", "lang", "key", rules[F.col("kind")].alias("rule"), levels[F.col("kind")].alias("level"), text.alias("message"), F.col("path").alias("uri"))
    if lines is None:
        return out.select("rule", "level", F.col("message").alias("text"), "uri", F.lit(1).alias("line"))
    leaf = F.when(~F.col("kind").isin("missing", "missing_file"), F.element_at(F.split("key", r"\."), -1))
    joined = out.withColumn("leaf", leaf).join(lines.withColumnRenamed("path", "uri"), ["uri", "leaf"], "left")
    return joined.select("rule", "level", F.col("message").alias("text"), "uri", F.coalesce("line", F.lit(1)).cast("int").alias("line"))


def sarif_document(results: DataFrame, tool: str = "lokalens") -> str:
    """The SARIF log of results, for a report of bounded size: rows come to the driver one partition at a time."""
    listed = []
    for r in results.orderBy("uri", "line", "rule", "text").toLocalIterator():
        listed.append({"ruleId": r["rule"], "level": r["level"], "message": {"text": r["text"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": max(1, r["line"])}}}]})
    rules = [{"id": i, "name": name, "shortDescription": {"text": name}, "fullDescription": {"text": text}} for i, name, text in SARIF_RULES]
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": listed}]}, ensure_ascii=False, indent=1)


def write_whole(path: str, text: str) -> None:
    """Replace a file at once: readers see the old text or the new one."""
    write_parts(path, [text])


def write_parts(path: str, parts: Iterable[str]) -> None:
    """A file of these parts, one after the other, that takes the old one's place when it is whole."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(parts)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def locale_leaves(segments: DataFrame) -> DataFrame:
    """The leaves of locale documents from segments (target, key, place, value, vtype, flat), place a struct that sorts as leaves came."""
    return placed(segments, ["target"])


def write_locales(segments: DataFrame) -> None:
    """Writes locale documents (target, key, place, value, vtype, flat) by executors, each whole or not at all."""
    put(locale_leaves(segments), segments.select("target"))
