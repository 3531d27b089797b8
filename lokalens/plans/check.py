"""The check of locales against their source: all findings, and a verdict for each language.

Both sides meet in one join. What is to be said of a key is one array, made where its texts are read, and
the rows with it are staged: findings, the checks of whole locales and the missing ones read that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import findings as O
from ..operators import keys as K
from ..staging import staged

KINDS = ("missing", "extra", "placeholder", "error", "warning", "missing_file")


def check(source: DataFrame, target: DataFrame, langs: DataFrame, glossary: list[str] | None = None, counts: Observation | None = None, detail: bool = False) -> DataFrame:
    """([file,] lang, kind, key, ord, seq, rule, text), and with detail lost and added, the placeholders that differ: source and target are segments, langs the languages asked for. Where both have a column `file`, every source file is checked by itself.

    kind: missing, extra, placeholder, error, warning, missing_file. Non-string values count for keys only.
    counts gets the number of findings of each kind, the checks of whole locales and missing files apart, as soon as this returns."""
    asked = langs.select("lang").distinct()
    by = [*K.of_file(source, target), "lang"]
    rows = K.side_by_side(source, target.join(F.broadcast(asked), "lang", "left_semi"), asked)
    read = O.read_once(rows, glossary)
    if counts is not None:
        n = lambda kind: F.coalesce(F.sum(F.size(F.filter("found", lambda f: f["kind"] == kind))), F.lit(0)).alias(kind)
        read = read.observe(counts, *map(n, KINDS[:5]))
    read = staged(read, "checked")
    pairs = read.where("src IS NOT NULL AND tgt IS NOT NULL")
    none, columns = F.lit(None).cast("string"), [*by, "kind", "key", "ord", "seq", "rule", "text"]
    more = ["lost", "added"] if detail else []
    keys = read.select(*by, "key", "ord", F.explode("found").alias("f")).select(*by, "f.kind", "key", "ord", "f.seq", "f.rule", "f.text", *(f"f.{c}" for c in more))
    no_ord, blank = F.lit(None).cast("long").alias("ord"), none.alias("key")
    whole = O.locale_findings(pairs).select(*by, F.lit("warning").alias("kind"), blank, no_ord, (F.col("seq") + 100).alias("seq"), F.lit("locale").alias("rule"), F.col("msg").alias("text"))
    every = K.by_language(source.select("file").distinct(), asked) if len(by) == 2 else asked
    gone = every.join(read.where("there").select(*by).distinct(), by, "left_anti")
    files = gone.select(*by, F.lit("missing_file").alias("kind"), blank, no_ord, F.lit(0).alias("seq"), F.lit("missing-key").alias("rule"), none.alias("text"))
    return keys.select(*columns, *more).unionByName(whole, allowMissingColumns=detail).unionByName(files, allowMissingColumns=detail)


def verdict(found: DataFrame, langs: DataFrame, strict: bool = False) -> DataFrame:
    """([file,] lang, missing, extra, placeholders, errors, warnings, ok): a row for each language, or for each file and language that langs lists; strict lets extra keys and warnings fail it too."""
    n = lambda k: F.count_if(F.col("kind") == k)
    by = [*K.of_file(found, langs), "lang"]
    counts = found.groupBy(*by).agg(n("missing").alias("missing"), n("extra").alias("extra"), n("placeholder").alias("placeholders"), n("error").alias("errors"), n("warning").alias("warnings"), n("missing_file").alias("absent"))
    full = langs.select(*by).distinct().join(counts, by, "left").fillna(0)
    bad = F.col("missing") + F.col("placeholders") + F.col("errors") + F.col("absent") + (F.col("extra") + F.col("warnings") if strict else F.lit(0))
    return full.withColumn("ok", bad == 0).drop("absent")
