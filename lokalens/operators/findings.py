"""Findings: the string checks in one pass over aligned pairs, and the checks of a whole locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import tables as T
from ..functions.icu import parse_column
from ..functions.text import base_language, let, normalized, one_if, strip
from ..shipping import ship

ERROR, WARN = "error", "warn"


def _tagged(seq: int, severity: str, detector: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(seq).alias("seq"), F.lit(severity).alias("severity"), F.lit(detector).alias("detector"), m.alias("msg")))


def with_icu(pairs: DataFrame) -> DataFrame:
    """Pairs with the parsed message of both sides; one Python pass, and only texts with an ICU head are sent. Pairs are dealt to all tasks first: a file of few row groups would leave all checks to as many tasks."""
    ship(pairs.sparkSession)
    pairs = pairs.repartition(*[c for c in (*group_of(pairs), "key", "ord") if c in pairs.columns])
    return pairs.withColumns({"src_icu": parse_column(F.col("src")), "tgt_icu": parse_column(F.col("tgt"))})


def string_checks(glossary: list[str] | None = None) -> Column:
    """All string checks of a pair (src, tgt, lang, src_icu, tgt_icu) in their fixed order, as one array."""
    src, tgt, lang, a, b = (F.col(c) for c in ("src", "tgt", "lang", "src_icu", "tgt_icu"))
    placeholders = lambda names_a, names_b: F.concat(
        _tagged(0, ERROR, "lost_placeholder", F.transform(D.lost_placeholders(names_a, names_b), lambda x: F.concat(F.lit("lost placeholder "), x))),
        _tagged(1, ERROR, "placeholder_count", D.placeholder_counts(names_a, names_b, a, b)),
    )
    prefixed = lambda text, found: F.transform(found, lambda x: F.concat(F.lit(text), x))
    checks = [
        (ERROR, "number", D.number_drift(src, tgt, lang)),
        (ERROR, "entity", D.entity_faults(src, tgt)),
        (ERROR, "currency", D.currency_change(src, tgt)),
        (ERROR, "icu", D.icu_faults(a, b, lang)),
        (ERROR, "tag", prefixed("lost inline tag ", D.lost_tags(src, tgt))),
    ]
    if glossary:
        checks += [
            (ERROR, "glossary_dropped", prefixed("glossary term dropped: ", D.lost_terms(src, tgt, glossary))),
            (ERROR, "glossary_collapse", D.collapsed_to_term(src, tgt, glossary)),
            (WARN, "glossary_case", prefixed("glossary case: ", D.recased_terms(src, tgt, glossary))),
        ]
    checks += [
        (ERROR, "answered", one_if(D.answered(src, tgt), F.lit("not a translation — the model answered the string instead of translating it"))),
        (WARN, "untranslated", D.untranslated(src, tgt, lang, glossary)),
    ]
    return F.concat(let(placeholders, names_a=D.placeholder_names(src, a), names_b=D.placeholder_names(tgt, b)), *[_tagged(i, *c) for i, c in enumerate(checks, 2)])


def group_of(pairs: DataFrame) -> list[str]:
    """What tells locales apart: the language, and the source file where there are several."""
    return [c for c in ("file", "lang") if c in pairs.columns]


def string_findings(pairs: DataFrame, glossary: list[str] | None = None) -> DataFrame:
    """(lang, key, ord, seq, severity, detector, msg) of pairs (lang, key, ord, src, tgt) of which both sides are there."""
    by = [*group_of(pairs), "key", "ord"]
    both = with_icu(pairs.where("src IS NOT NULL AND tgt IS NOT NULL"))
    return both.select(*by, F.explode(string_checks(glossary)).alias("f")).select(*by, "f.*")


def placeholder_issues(pairs: DataFrame) -> DataFrame:
    """(lang, key, ord, missing, added) where the placeholder sets of the key check differ."""
    ship(pairs.sparkSession)
    by = [*group_of(pairs), "key", "ord"]
    sets = pairs.where("src IS NOT NULL AND tgt IS NOT NULL").select(*by, D.placeholder_set(F.col("src")).alias("a"), D.placeholder_set(F.col("tgt")).alias("b"))
    return sets.where("a <> b").select(*by, F.array_except("a", "b").alias("missing"), F.array_except("b", "a").alias("added"))


def read_once(rows: DataFrame, glossary: list[str] | None = None) -> DataFrame:
    """rows (keys.side_by_side) with `found`, an array of (kind, seq, rule, text, lost, added) of all that is to be said of a key, and the shown lengths of both texts. Each text is parsed once.

    kind: missing, extra, placeholder, error, warning."""
    ship(rows.sparkSession)
    both = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    only = lambda c: F.when(both, F.col(c))
    read = rows.withColumns({"src_icu": parse_column(only("src")), "tgt_icu": parse_column(only("tgt")), "a": D.placeholder_set(only("src")), "b": D.placeholder_set(only("tgt"))})
    names = lambda x, name: x.cast("array<string>").alias(name)
    nothing = F.lit(None)
    note = lambda kind, rule, text, lost=nothing, added=nothing: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("seq"), F.lit(rule).alias("rule"), text.cast("string").alias("text"), names(lost, "lost"), names(added, "added"))
    gone, new = F.array_except("a", "b"), F.array_except("b", "a")
    said = F.concat_ws("; ", F.when(F.size(gone) > 0, F.concat(F.lit("missing "), F.array_join(gone, ", "))), F.when(F.size(new) > 0, F.concat(F.lit("added "), F.array_join(new, ", "))))
    faults = F.transform(string_checks(glossary), lambda f: F.struct(F.when(f["severity"] == ERROR, "error").otherwise("warning").alias("kind"), f["seq"].alias("seq"), f["detector"].alias("rule"), f["msg"].alias("text"), names(nothing, "lost"), names(nothing, "added")))
    none = F.array().cast("array<struct<kind:string,seq:int,rule:string,text:string,lost:array<string>,added:array<string>>>")
    found = (
        F.when(~F.col("there"), F.array(note("missing", "missing-key", nothing)))
        .when(~F.col("here"), F.array(note("extra", "extra-key", nothing)))
        .when(both, F.concat(F.when(F.col("a") != F.col("b"), F.array(note("placeholder", "placeholder", said, gone, new))).otherwise(none), faults))
        .otherwise(none)
    )
    return read.select(*rows.columns, found.alias("found"), *(F.length(F.coalesce(F.col(f"{x}_icu")["visible"], F.col(x))).alias(f"{x}_shown") for x in ("src", "tgt")))


def register_mix(pairs: DataFrame) -> DataFrame:
    """(lang, informal, formal, msg) of languages whose translations use both registers at least twice."""
    base, tgt = base_language(F.col("lang")), F.col("tgt")
    informal, formal = F.lit(0), F.lit(0)
    for lang, (a, b) in T.REGISTER.items():
        informal = F.when(base == lang, F.regexp_count(tgt, F.lit(a))).otherwise(informal)
        formal = F.when(base == lang, F.regexp_count(tgt, F.lit(b))).otherwise(formal)
    counted = pairs.where(base.isin(list(T.REGISTER))).groupBy(*group_of(pairs)).agg(F.sum(informal).alias("informal"), F.sum(formal).alias("formal"))
    said = F.concat(F.lit("file mixes informal and formal address ("), F.col("informal").cast("string"), F.lit(" informal vs "), F.col("formal").cast("string"), F.lit(" formal markers) — pick one register"))
    return counted.where("informal >= 2 AND formal >= 2").withColumn("msg", said)


def inconsistent_terms(pairs: DataFrame, top: int = 30, longest: int = 60) -> DataFrame:
    """(lang, term, n_keys, variants, keys, rank, msg): short sources translated in several ways, most keys first.

    Variants stand as first seen, in that order. Terms are ranked by counts; variants and keys are gathered for the `top` of a language only."""
    by = group_of(pairs)
    s = strip(F.col("src"))
    shown = pairs.where((s != "") & (F.length(s) <= longest) & (strip(F.col("tgt")) != "")).select(*by, "key", "ord", s.alias("s"), strip(F.col("tgt")).alias("t"), normalized(F.col("src")).alias("ns"), normalized(F.col("tgt")).alias("nt"))
    variants = shown.groupBy(*by, "ns", "nt").agg(F.min_by("t", "ord").alias("t"), F.min_by("s", "ord").alias("s"), F.min("ord").alias("ord"), F.count("*").alias("n_keys"))
    terms = variants.groupBy(*by, "ns").agg(F.min_by("s", "ord").alias("term"), F.min("ord").alias("ord"), F.count("*").alias("n"), F.sum("n_keys").cast("int").alias("n_keys"))
    ranked = terms.where("n >= 2").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_keys"), "ord"))).where(F.col("rank") <= top)
    named = ranked.select(*by, "ns", "term", "n_keys", "rank")
    term = [*by, "ns"]
    listed = variants.join(named.select(*term), term).groupBy(*term).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]).alias("variants"))
    held = shown.join(named.select(*term), term).groupBy(*term).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ranked = named.join(listed, term).join(held, term)
    said = F.concat(F.lit('inconsistent translation of "'), F.col("term"), F.lit('" across '), F.col("n_keys").cast("string"), F.lit(" keys: "), F.array_join("variants", ", "))
    return ranked.select(*by, "term", "n_keys", "variants", "keys", "rank", said.alias("msg"))


def absent_terms(source: DataFrame, glossary: list[str]) -> DataFrame:
    """(term): the glossary's terms that no string of the source holds, in either case, in the glossary's order; blank ones are none. One pass, whatever the number of terms."""
    terms = list(dict.fromkeys(t.strip() for t in glossary if t and t.strip()))
    if not terms:
        return source.sparkSession.createDataFrame([], "term string")
    text = F.lower(F.col("value"))
    held = source.where("vtype = 'string'").agg(*(F.coalesce(F.bool_or(text.contains(t.lower())), F.lit(False)).alias(str(i)) for i, t in enumerate(terms)))
    said = F.array(*(F.when(~F.col(str(i)), F.lit(t)) for i, t in enumerate(terms)))
    return held.select(F.explode(F.array_compact(said)).alias("term"))


def overflowing(pairs: DataFrame, top: int = 50) -> DataFrame:
    """([file,] lang, key, pct, typical, rank, msg): short sources whose shown text grew beyond what the language's does, most first."""
    by = group_of(pairs)
    expected = F.coalesce(T.literal_map(T.EXPANSION)[base_language(F.col("lang"))], F.lit(T.DEFAULT_EXPANSION))
    parsed = pairs.where("src IS NOT NULL")
    if "src_shown" in pairs.columns:
        a, b = F.col("src_shown"), F.coalesce("tgt_shown", F.lit(0))
    else:
        parsed = with_icu(parsed.withColumn("tgt", F.coalesce("tgt", F.lit(""))))
        a, b = (F.length(F.coalesce(F.col(f"{x}_icu")["visible"], F.col(x))) for x in ("src", "tgt"))
    ratio = b / F.when(a > 0, a)
    hits = parsed.where((a > 0) & (a <= 60) & (b >= 8) & (ratio >= F.greatest(F.lit(1.4), expected * 1.18))).select(*by, "key", "ord", F.rint((ratio - 1) * 100).cast("int").alias("pct"), F.rint((expected - 1) * 100).cast("int").alias("typical"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pct"), "ord"))).where(F.col("rank") <= top)
    said = F.concat("key", F.lit(": translation +"), F.col("pct").cast("string"), F.lit("% vs source (typical +"), F.col("typical").cast("string"), F.lit("%) — may overflow UI"))
    return ranked.select(*by, "key", "pct", "typical", "rank", said.alias("msg"))


def locale_findings(pairs: DataFrame) -> DataFrame:
    """([file,] lang, seq, rank, severity, msg): the checks of whole locales, in their order. Pairs that read_once has read are not parsed anew."""
    parts = [(0, register_mix(pairs).withColumn("rank", F.lit(1))), (1, inconsistent_terms(pairs)), (2, overflowing(pairs))]
    out = None
    for seq, df in parts:
        df = df.select(*group_of(pairs), F.lit(seq).alias("seq"), "rank", F.lit(WARN).alias("severity"), "msg")
        out = df if out is None else out.unionByName(df)
    return out
