"""Registered queries over the test tables, and the SQL that gives the same rows.

The tables hold no translations, so pairs are derived from them by expressions that both sides share.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import detectors as D
from .functions import quota
from .functions import tables as T
from .functions.text import base_language
from .operators import findings as O
from .operators import incremental as I
from .operators import keys as K
from .operators import memory as M
from .functions import paths as A
from .plans import check as C
from .plans import incremental as P
from .plans import projects as R
from .plans import runs as U
from .sources import archives, decode, memory_table, sinks, stores
from .sources import segments as S
from .shipping import ship
from .staging import shared_folder, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GLOSSARY = ["Brand", "STEEL", "Copper"]

# Pairs: (table, expressions of key, ord, lang, src, tgt), in SQL that Spark and DuckDB both read.
_SIZE = "CAST(p_size AS STRING)"
_NAMED = f"p_name || ' {{name}} %s ' || {_SIZE}"
PAIRS = {
    "part_pairs": ("part", "CAST(p_partkey AS STRING)", "p_partkey", "'de'", _NAMED,
        f"CASE p_partkey % 8 WHEN 0 THEN p_name || ' %s ' || {_SIZE} WHEN 1 THEN p_name || ' {{nom}} %s ' || {_SIZE} WHEN 2 THEN p_name || ' {{name}} {{name}} %s ' || {_SIZE} "
        f"WHEN 3 THEN p_name || ' {{name}} %s ' || CAST(p_size + 1 AS STRING) WHEN 4 THEN p_name || ' {{name}} %d ' || {_SIZE} WHEN 5 THEN p_name || ' {{name}} %s' ELSE {_NAMED} END"),
    "price_pairs": ("orders", "CAST(o_orderkey AS STRING)", "o_orderkey", "'fr'", "'Total $' || CAST(o_orderkey % 1000 AS STRING)",
        "CASE o_orderkey % 5 WHEN 0 THEN 'Total €' || CAST(o_orderkey % 1000 AS STRING) WHEN 1 THEN 'Total ' || CAST(o_orderkey % 1000 AS STRING) || ' USD' "
        "WHEN 2 THEN 'Total ' || CAST(o_orderkey % 1000 AS STRING) WHEN 3 THEN 'Total R$' || CAST(o_orderkey % 1000 AS STRING) ELSE 'Total $' || CAST(o_orderkey % 1000 AS STRING) END"),
    "page_pairs": ("pages", "CAST(page_id AS STRING)", "page_id", "'de'", "html",
        "CASE page_id % 3 WHEN 0 THEN replace(html, '</p>', '') WHEN 1 THEN replace(html, '&amp;', '&amp;amp;') ELSE html END"),
    "term_pairs": ("part", "CAST(p_partkey AS STRING)", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'de-DE' WHEN 1 THEN 'fr' WHEN 2 THEN 'ja' ELSE 'xx' END", "p_name", "p_name || ' ' || p_type"),
    "brand_pairs": ("part", "CAST(p_partkey AS STRING)", "p_partkey", "'es'", "'the part by Brand is ' || p_name",
        "CASE p_partkey % 4 WHEN 0 THEN 'la pieza de BRAND es ' || p_name WHEN 1 THEN 'la pieza es ' || p_name WHEN 2 THEN 'Brand!' ELSE 'la pieza de Brand es ' || p_name END"),
    "doc_pairs": ("documents", "CAST(doc_id AS STRING)", "doc_id", "CASE doc_id % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' ELSE lang END", "text",
        "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' нет' ELSE 'x' || text END"),
    "address_pairs": ("documents", "CAST(doc_id AS STRING)", "doc_id", "lang", "text",
        "text || CASE lang WHEN 'de' THEN ' du und Sie, dein Ihnen' WHEN 'fr' THEN ' tu votre toi vous' ELSE ' usted' END"),
}


def pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, *exprs = PAIRS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for e, c in zip(exprs, ("key", "ord", "lang", "src", "tgt"), strict=True)))


def _pairs_sql(name: str) -> str:
    table, *exprs = PAIRS[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for e, c in zip(exprs, ("key", "ord", "lang", "src", "tgt"), strict=True)) + f" FROM {table}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _each(df: DataFrame, found: Column) -> DataFrame:
    return df.select("key", F.explode(found).alias("msg"))


_PH = T.PLACEHOLDER.replace("(?U)", "").replace("'", "''")
_MORE = "list_sort(list_filter(list_distinct({a}), lambda x: len(list_filter({a}, lambda y: y = x)) > len(list_filter({b}, lambda y: y = x))))"


# --- key joins ------------------------------------------------------------------------------------


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 0)")
def missing_keys(spark, sf_dir):
    key = lambda c: F.col(c).cast("string").alias("key")
    return K.missing_keys(_table(spark, sf_dir, "customer").select(key("c_custkey")), _table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").select(key("o_custkey")), ["key"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def extra_keys(spark, sf_dir):
    key = lambda c: F.col(c).cast("string").alias("key")
    return K.extra_keys(_table(spark, sf_dir, "supplier").select(key("s_suppkey")), _table(spark, sf_dir, "customer").select(key("c_custkey")), ["key"])


@query("SELECT DISTINCT lower(n_name) AS lang FROM nation WHERE lower(n_name) NOT IN (SELECT lower(n_name) FROM nation, supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 3 = 0)")
def missing_locales(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").withColumn("lang", F.lower("n_name"))
    served = _table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return K.missing_locales(nation.select("lang"), nation.join(served, "n_nationkey", "left_semi").select("lang"))


@query("SELECT r_name AS lang, CAST(n_nationkey AS VARCHAR) AS key FROM nation, region WHERE n_regionkey <> r_regionkey")
def missing_by_language(spark, sf_dir):
    source = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"))
    regions = _table(spark, sf_dir, "region").select(F.col("r_name").alias("lang"), F.col("r_regionkey").alias("n_regionkey"))
    target = _table(spark, sf_dir, "nation").join(F.broadcast(regions), "n_regionkey").select("lang", F.col("n_nationkey").cast("string").alias("key"))
    return K.missing_keys(K.by_language(source, regions), target, ["lang", "key"]).select("lang", "key")


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments of part as it was, and as it is: some names edited, some rows gone, some keys renamed."""
    part = _table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    old = part.select(key.alias("key"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"), F.lit("string").alias("vtype"))
    new = part.where("p_partkey % 11 <> 0").select(F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("new."), key)).otherwise(key).alias("key"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name")).alias("value"), F.lit("string").alias("vtype"))
    return old, new


_SNAPSHOTS = """o AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey AS ord, p_name AS value FROM part),
n AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'new.' ELSE '' END || CAST(p_partkey AS VARCHAR) AS key, p_partkey AS ord, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' v2' ELSE '' END AS value FROM part WHERE p_partkey % 11 <> 0)"""


@query(f"WITH {_SNAPSHOTS} SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value, n.key IS NOT NULL AND o.key IS NULL AS added FROM o FULL JOIN n ON o.key = n.key")
def merged_locale(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return K.merged(old, new).select("key", "value", F.col("place.new").alias("added"))


@query("SELECT DISTINCT coalesce(d.lang, 'en') AS lang FROM documents d UNION SELECT 'en'")
def catalog_languages(spark, sf_dir):
    return K.catalog_languages(_table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("en")).alias("lang")), "en")


# --- string checks --------------------------------------------------------------------------------


@query(f"""WITH p AS ({_pairs_sql('part_pairs')}), a AS (SELECT key, regexp_extract_all(src, '{_PH}') AS s, regexp_extract_all(tgt, '{_PH}') AS t FROM p)
SELECT key, unnest(list_distinct(list_filter(s, lambda x: NOT list_contains(t, x)))) AS msg FROM a""")
def lost_placeholders(spark, sf_dir):
    both = O.with_icu(pairs(spark, sf_dir, "part_pairs"))
    return _each(both, D.lost_placeholders(D.placeholder_names(F.col("src"), F.col("src_icu")), D.placeholder_names(F.col("tgt"), F.col("tgt_icu"))))


@query(f"""WITH p AS ({_pairs_sql('part_pairs')}), a AS (SELECT key, regexp_extract_all(src, '{_PH}') AS s, regexp_extract_all(tgt, '{_PH}') AS t FROM p),
e AS (SELECT key, s, t, unnest(list_distinct(list_concat(s, t))) AS x FROM a), c AS (SELECT key, x, len(list_filter(s, lambda y: y = x)) AS ns, len(list_filter(t, lambda y: y = x)) AS nt FROM e)
SELECT key, CASE WHEN nt > ns AND ns = 0 THEN 'invented placeholder ' || x || ' (not in source)' WHEN nt > ns THEN 'placeholder ' || x || ' appears ' || nt || '× vs ' || ns || '× in source (duplicated)'
 ELSE 'placeholder ' || x || ' appears ' || ns || '× in source but ' || nt || '× in translation' END AS msg FROM c WHERE x <> '%%' AND (nt > ns OR ns > nt AND nt > 0)""")
def placeholder_counts(spark, sf_dir):
    both = O.with_icu(pairs(spark, sf_dir, "part_pairs"))
    a, b = F.col("src_icu"), F.col("tgt_icu")
    return _each(both, D.placeholder_counts(D.placeholder_names(F.col("src"), a), D.placeholder_names(F.col("tgt"), b), a, b))


_SET = r"list_sort(list_distinct(list_concat(regexp_extract_all({x}, '\{{[^{{}}]*\}}'), regexp_extract_all(regexp_replace({x}, '\{{[^{{}}]*\}}', ' ', 'g'), '%\d+\$[@a-zA-Z]|%@|%[sdifxocegpnXOCEGP%]'))))"


@query(f"""WITH p AS ({_pairs_sql('part_pairs')}), a AS (SELECT key, {_SET.format(x='src')} AS s, {_SET.format(x='tgt')} AS t FROM p)
SELECT key, array_to_string(list_filter(s, lambda x: NOT list_contains(t, x)), ' ') AS missing, array_to_string(list_filter(t, lambda x: NOT list_contains(s, x)), ' ') AS added FROM a WHERE s <> t""")
def placeholder_issues(spark, sf_dir):
    return O.placeholder_issues(pairs(spark, sf_dir, "part_pairs")).select("key", F.array_join("missing", " ").alias("missing"), F.array_join("added", " ").alias("added"))


def _nums(x: str) -> str:
    return f"regexp_extract_all(regexp_replace({x}, '{_PH}', ' ', 'g'), '[0-9]+')"


@query(f"""WITH p AS ({_pairs_sql('part_pairs')}), a AS (SELECT key, {_nums('src')} AS s, {_nums('tgt')} AS t FROM p)
SELECT key, 'number ' || unnest({_MORE.format(a='t', b='s')}) || ' appears in the translation but not the source' AS msg FROM a
UNION ALL SELECT key, 'number ' || unnest({_MORE.format(a='s', b='t')}) || ' from the source is missing or changed in the translation' FROM a WHERE len(t) > 0""")
def number_drift(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "part_pairs"), D.number_drift(F.col("src"), F.col("tgt"), F.col("lang")))


_CUR = r"list_sort(list_distinct(list_filter([CASE WHEN regexp_matches({x}, '(^|[^A-Za-z0-9])\$ ?[0-9]') OR regexp_matches({x}, '[0-9] ?USD($|[^A-Za-z])') THEN 'USD' END, CASE WHEN regexp_matches({x}, '€ ?[0-9]') THEN 'EUR' END, CASE WHEN regexp_matches({x}, 'R\$ ?[0-9]') THEN 'BRL' END], lambda c: c IS NOT NULL)))"


@query(f"""WITH p AS ({_pairs_sql('price_pairs')}), a AS (SELECT key, {_CUR.format(x='src')} AS s, {_CUR.format(x='tgt')} AS t FROM p)
SELECT key, CASE WHEN len(t) = 0 THEN 'currency dropped — the source priced this in ' || array_to_string(s, ', ') || ', the translation has no currency'
 WHEN len(s) = 0 THEN 'currency invented — the translation quotes ' || array_to_string(t, ', ') || ', the source quoted none'
 ELSE 'currency changed: ' || array_to_string(s, ', ') || ' → ' || array_to_string(t, ', ') || ' — this is a different price, not a translation' END AS msg FROM a WHERE s <> t""")
def currency_change(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "price_pairs"), D.currency_change(F.col("src"), F.col("tgt")))


_ENT = "regexp_extract_all({x}, '&amp;(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{{1,7}}|#x[0-9a-fA-F]{{1,6}});')"


@query(f"""WITH p AS ({_pairs_sql('page_pairs')}), a AS (SELECT key, {_ENT.format(x='src')} AS s, {_ENT.format(x='tgt')} AS t FROM p)
SELECT key, 'double-encoded entity ' || unnest({_MORE.format(a='t', b='s')}) || ' — the & was re-escaped (renders literally)' AS msg FROM a""")
def entity_faults(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "page_pairs"), D.entity_faults(F.col("src"), F.col("tgt")))


_TAGS = r"""SELECT key, CASE WHEN starts_with(x, '</') THEN '</' || n || '>' WHEN ends_with(x, '/>') THEN '<' || n || '/>' ELSE '<' || n || '>' END AS msg
FROM (SELECT key, x, regexp_extract(x, '</?\s*([a-zA-Z0-9][\w:-]*)', 1) AS n FROM (SELECT key, unnest(regexp_extract_all({x}, '</?[a-zA-Z0-9][\w:-]*(?:\s[^<>]*?)?/?>')) AS x FROM p))"""


@query(f"""WITH p AS ({_pairs_sql('page_pairs')}), s AS (SELECT key, msg, count(*) AS n FROM ({_TAGS.format(x='src')}) GROUP BY ALL), t AS (SELECT key, msg, count(*) AS n FROM ({_TAGS.format(x='tgt')}) GROUP BY ALL)
SELECT key, msg, CAST(s.n - coalesce(t.n, 0) AS BIGINT) AS times FROM s LEFT JOIN t USING (key, msg) WHERE s.n > coalesce(t.n, 0)""")
def lost_tags(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "page_pairs"), D.lost_tags(F.col("src"), F.col("tgt"))).groupBy("key", "msg").agg(F.count("*").alias("times"))


@query(f"""WITH p AS ({_pairs_sql('brand_pairs')}), g AS (SELECT key, src, tgt, unnest(['Brand', 'STEEL', 'Copper']) AS msg FROM p)
SELECT key, msg FROM g WHERE contains(lower(src), lower(msg)) AND NOT contains(lower(tgt), lower(msg))""")
def glossary_dropped(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "brand_pairs"), D.lost_terms(F.col("src"), F.col("tgt"), GLOSSARY))


@query(f"""WITH p AS ({_pairs_sql('brand_pairs')}) SELECT key, 'translation collapsed to the glossary term "Brand" — the sentence is gone' AS msg FROM p
WHERE len(regexp_extract_all(src, '\\p{{L}}{{2,}}')) >= 3 AND contains(lower(tgt), 'brand') AND NOT regexp_matches(regexp_replace(tgt, '(?i)brand|steel|copper', ' ', 'g'), '\\p{{L}}')""")
def glossary_collapse(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "brand_pairs"), D.collapsed_to_term(F.col("src"), F.col("tgt"), GLOSSARY))


@query(f"""WITH p AS ({_pairs_sql('brand_pairs')}) SELECT key, 'Brand appears as "' || regexp_extract(tgt, '(?i)brand') || '" — a kept term keeps its exact case' AS msg FROM p
WHERE contains(lower(tgt), 'brand') AND NOT contains(tgt, 'Brand') AND NOT contains(tgt, 'brand')""")
def glossary_case(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "brand_pairs"), D.recased_terms(F.col("src"), F.col("tgt"), ["Brand"]))


_TURNS = """t AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


@query(f"WITH {_TURNS} SELECT conv_id, turn FROM t WHERE length(trim(src, ' \t\n')) BETWEEN 1 AND 80 AND length(trim(tgt, ' \t\n')) >= greatest(4 * length(trim(src, ' \t\n')), 120)".replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '"))
def answered_not_translated(spark, sf_dir):
    a = _table(spark, sf_dir, "conversations")
    b = a.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return a.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src")).join(b, ["conv_id", "turn"]).where(D.answered(F.col("src"), F.col("tgt"))).select("conv_id", "turn")


_LEFT = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(tgt, '{_PH}', ' ', 'g'), '</?[a-zA-Z0-9][\\w:-]*(?:\\s[^<>]*?)?/?>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[0-9]+', ' ', 'g')"


@query(f"""WITH p AS ({_pairs_sql('doc_pairs')}), a AS (SELECT key, lang, src = tgt AS same, lang = 'ru' AND NOT regexp_matches(tgt, '[Ѐ-ӿ]') AS absent, {_LEFT} AS s FROM p WHERE lang <> 'en'),
w AS (SELECT *, list_filter(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: x <> '') AS words FROM a),
r AS (SELECT key, same, absent, len(regexp_extract_all(s, '\\p{{L}}{{2,}}')) AS n, len(list_filter(words, lambda x: regexp_full_match(x, '[a-zß-öø-ÿ][A-Za-zÀ-ÿ]{{3,}}'))) > 0 OR absent AND len(regexp_extract_all(s, '\\p{{L}}+')) >= 3 AND len(list_filter(regexp_extract_all(s, '\\p{{L}}+'), lambda x: regexp_matches(x, '^\\p{{Ll}}'))) > 0 AS reads FROM w)
SELECT key, CASE WHEN absent THEN 'may be untranslated — no target-language script, still reads as source text' ELSE 'may be untranslated — identical to the source text' END AS msg FROM r WHERE reads AND (absent OR same AND n >= 3)""")
def untranslated(spark, sf_dir):
    return _each(pairs(spark, sf_dir, "doc_pairs").where("tgt IS NOT NULL"), D.untranslated(F.col("src"), F.col("tgt"), F.col("lang")))


_ICU_SRC = "'{n, plural, =0 {no {name}} one {# part {name}} other {# parts {name}}} ' || p_name"
_ICU_TGT = ("CASE p_partkey % 4 WHEN 0 THEN '{n, plural, one {# деталь {name}} few {# детали {name}} many {# деталей {name}} other {# детали {name}}} ' || p_name "
            "WHEN 1 THEN '{n, plural, =0 {нет} one {# деталь {name}} other {# детали}} ' || p_name WHEN 2 THEN '{n, plural, =0 {нет} one {# деталь {name}} ' || p_name ELSE '{n, plural, =0 {нет} one {1} few {2}} ' || p_name END")  # fmt: skip


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, unnest(CASE p_partkey % 4
 WHEN 0 THEN ['ICU exact-match branch =0 {…} was dropped in the translation']
 WHEN 1 THEN ['placeholder {name} is missing from some plural/select arms', 'ICU plural is missing the few/many form(s) ru requires']
 WHEN 2 THEN ['ICU plural/select construct dropped or broken (1 in source, 0 in translation)', 'ICU exact-match branch =0 {…} was dropped in the translation', 'lost placeholder {n}']
 ELSE ['ICU plural is missing the required ''other'' branch', 'ICU plural is missing the many form(s) ru requires', 'lost placeholder {name}'] END) AS msg FROM part""")
def icu_faults(spark, sf_dir):
    p = _table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS key", f"{_ICU_SRC} AS src", f"{_ICU_TGT} AS tgt", "'ru-RU' AS lang")
    both = O.with_icu(p)
    a, b = F.col("src_icu"), F.col("tgt_icu")
    na, nb = D.placeholder_names(F.col("src"), a), D.placeholder_names(F.col("tgt"), b)
    arms = F.filter(D.placeholder_counts(na, nb, a, b), lambda m: m.contains("arms"))
    short = F.transform(arms, lambda m: F.regexp_replace(m, r" \(.*$", ""))
    lost = F.transform(D.lost_placeholders(na, nb), lambda x: F.concat(F.lit("lost placeholder "), x))
    return _each(both, F.concat(D.icu_faults(a, b, F.col("lang")), short, lost))


# --- whole locales --------------------------------------------------------------------------------

_WORDS = r"regexp_split_to_array(tgt, '[^\p{L}\p{N}\p{M}_]+')"


@query(f"""WITH p AS ({_pairs_sql('address_pairs')}), w AS (SELECT lang, unnest({_WORDS}) AS w FROM p WHERE lang IN ('de', 'fr', 'es')), c AS (SELECT lang,
 sum(CASE WHEN lang = 'de' THEN CAST(regexp_full_match(lower(w), 'du|dich|dir|dein[\\p{{L}}\\p{{N}}\\p{{M}}_]*') AS INT) WHEN lang = 'fr' THEN CAST(lower(w) IN ('tu', 'toi', 'ton', 'tes') AS INT) ELSE CAST(lower(w) IN ('tú', 'ti', 'tus') AS INT) END) AS a,
 sum(CASE WHEN lang = 'de' THEN CAST(w IN ('Sie', 'Ihnen') AS INT) WHEN lang = 'fr' THEN CAST(lower(w) IN ('vous', 'votre', 'vos') AS INT) ELSE CAST(lower(w) IN ('usted', 'ustedes') AS INT) END) AS b FROM w GROUP BY lang)
SELECT lang, CAST(a AS BIGINT) AS informal, CAST(b AS BIGINT) AS formal FROM c WHERE a >= 2 AND b >= 2""")
def register_mix(spark, sf_dir):
    return O.register_mix(pairs(spark, sf_dir, "address_pairs")).select("lang", "informal", "formal")


@query(f"""WITH p AS ({_pairs_sql('term_pairs')}), v AS (SELECT lang, lower(src) AS ns, lower(tgt) AS nt, arg_min(trim(tgt), ord) AS t, arg_min(trim(src), ord) AS s, min(ord) AS o, list(key) AS ks FROM p WHERE length(trim(src)) BETWEEN 1 AND 60 GROUP BY ALL),
x AS (SELECT lang, ns, arg_min(s, o) AS term, min(o) AS o, string_agg(t, ', ' ORDER BY o) AS variants, list_sort(flatten(list(ks))) AS ks FROM v GROUP BY lang, ns HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY len(ks) DESC, o) AS rank FROM x)
SELECT lang, CAST(rank AS INT) AS rank, term, CAST(len(ks) AS INT) AS n_keys, variants, array_to_string(ks, ' ') AS keys FROM r WHERE rank <= 30""")
def inconsistent_terms(spark, sf_dir):
    return O.inconsistent_terms(pairs(spark, sf_dir, "term_pairs")).select("lang", "rank", "term", "n_keys", F.array_join("variants", ", ").alias("variants"), F.array_join("keys", " ").alias("keys"))


@query(f"""WITH p AS ({_pairs_sql('term_pairs')}), e AS (SELECT *, CASE split_part(lower(lang), '-', 1) WHEN 'de' THEN 1.35::DOUBLE WHEN 'fr' THEN 1.25::DOUBLE WHEN 'ja' THEN 0.55::DOUBLE ELSE 1.2::DOUBLE END AS x, length(tgt)::DOUBLE / length(src) AS r FROM p),
h AS (SELECT lang, key, ord, CAST(round_even((r - 1) * 100, 0) AS INT) AS pct, CAST(round_even((x - 1) * 100, 0) AS INT) AS typical FROM e WHERE length(src) BETWEEN 1 AND 60 AND length(tgt) >= 8 AND r >= greatest(1.4::DOUBLE, x * 1.18::DOUBLE)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pct DESC, ord) AS rank FROM h)
SELECT lang, key, pct, typical, CAST(rank AS INT) AS rank FROM k WHERE rank <= 50""")
def overflow(spark, sf_dir):
    return O.overflowing(pairs(spark, sf_dir, "term_pairs")).select("lang", "key", "pct", "typical", "rank")


def _check(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    old, new = _snapshots(spark, sf_dir)
    target = new.withColumn("lang", F.lit("de"))
    langs = spark.createDataFrame([("de",), ("fr",)], "lang string")
    return C.check(old, target, langs), langs


@query(f"""WITH {_SNAPSHOTS}, m AS (SELECT count(*) AS n FROM o WHERE key NOT IN (SELECT key FROM n)), x AS (SELECT count(*) AS n FROM n WHERE key NOT IN (SELECT key FROM o)),
e AS (SELECT count(*) AS n FROM o JOIN n USING (key) WHERE o.value <> n.value)
SELECT 'de' AS lang, m.n AS missing, x.n AS extra, e.n AS errors, m.n + e.n = 0 AS ok FROM m, x, e
UNION ALL SELECT 'fr', (SELECT count(*) FROM o), 0, 0, (SELECT count(*) FROM o) = 0""")
def verdict_by_language(spark, sf_dir):
    """Edited names gain ' v2', a number that the source lacks: one error each."""
    found, langs = _check(spark, sf_dir)
    return C.verdict(found, langs).select("lang", "missing", "extra", "errors", "ok")


@query(f"""WITH {_SNAPSHOTS}, p AS (SELECT o.key, o.ord, o.value AS src, n.value AS tgt FROM o JOIN n USING (key)),
v AS (SELECT lower(src) AS ns, lower(tgt) AS nt, arg_min(tgt, ord) AS t, arg_min(src, ord) AS s, min(ord) AS o, count(*) AS c FROM p WHERE length(src) BETWEEN 1 AND 60 GROUP BY ALL),
x AS (SELECT arg_min(s, o) AS term, min(o) AS o, string_agg(t, ', ' ORDER BY o) AS variants, CAST(sum(c) AS BIGINT) AS c FROM v GROUP BY ns HAVING count(*) >= 2)
SELECT 'missing' AS kind, 'de' AS lang, key, ord, 0 AS seq, 'missing-key' AS rule, '' AS text FROM o WHERE key NOT IN (SELECT key FROM n)
UNION ALL SELECT 'missing', 'fr', key, ord, 0, 'missing-key', '' FROM o
UNION ALL SELECT 'extra', 'de', key, ord, 0, 'extra-key', '' FROM n WHERE key NOT IN (SELECT key FROM o)
UNION ALL SELECT 'missing_file', 'fr', '', -1, 0, 'missing-key', ''
UNION ALL SELECT 'error', 'de', key, ord, 2, 'number', 'number 2 appears in the translation but not the source' FROM p WHERE src <> tgt
UNION ALL SELECT 'warning', 'de', key, ord, 8, 'untranslated', 'may be untranslated — identical to the source text' FROM p WHERE src = tgt AND len(regexp_extract_all(src, '\\p{{L}}{{2,}}')) >= 3
 AND len(list_filter(regexp_split_to_array(src, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-zß-öø-ÿ][A-Za-zÀ-ÿ]{{3,}}'))) > 0
UNION ALL SELECT 'warning', 'de', '', -1, 101, 'locale', 'inconsistent translation of "' || term || '" across ' || c || ' keys: ' || variants FROM (SELECT *, row_number() OVER (ORDER BY c DESC, o) AS r FROM x) WHERE r <= 30""")
def check_findings(spark, sf_dir):
    """All findings; where there is no key, order or text, '' and -1 stand for it."""
    return _check(spark, sf_dir)[0].fillna({"key": "", "ord": -1, "text": ""})


_TERMS = "(?i)brand|steel|copper"


@query(f"""WITH p AS ({_pairs_sql('brand_pairs')} UNION ALL {_pairs_sql('part_pairs')}),
a AS (SELECT *, regexp_extract_all(src, '{_PH}') AS s, regexp_extract_all(tgt, '{_PH}') AS t, {_nums('src')} AS ns, {_nums('tgt')} AS nt, regexp_replace({_LEFT}, '{_TERMS}', ' ', 'g') AS rest FROM p),
c AS (SELECT lang, key, ord, x, len(list_filter(s, lambda y: y = x)) AS ns, len(list_filter(t, lambda y: y = x)) AS nt FROM (SELECT *, unnest(list_distinct(list_concat(s, t))) AS x FROM a)),
g AS (SELECT *, unnest(['Brand', 'STEEL', 'Copper']) AS term FROM p),
f AS (SELECT lang, key, ord, term, list_sort(list_distinct(regexp_extract_all(src, '(?i)' || term))) AS forms, regexp_extract_all(tgt, '(?i)' || term) AS seen, tgt FROM g)
SELECT lang, key, ord, 0 AS seq, 'error' AS severity, 'lost_placeholder' AS detector, 'lost placeholder ' || x AS msg FROM c WHERE nt = 0
UNION ALL SELECT lang, key, ord, 1, 'error', 'placeholder_count', CASE WHEN ns = 0 THEN 'invented placeholder ' || x || ' (not in source)' WHEN nt > ns THEN 'placeholder ' || x || ' appears ' || nt || '× vs ' || ns || '× in source (duplicated)' ELSE 'placeholder ' || x || ' appears ' || ns || '× in source but ' || nt || '× in translation' END FROM c WHERE x <> '%%' AND (nt > ns OR ns > nt AND nt > 0)
UNION ALL SELECT lang, key, ord, 2, 'error', 'number', 'number ' || unnest({_MORE.format(a='nt', b='ns')}) || ' appears in the translation but not the source' FROM a
UNION ALL SELECT lang, key, ord, 2, 'error', 'number', 'number ' || unnest({_MORE.format(a='ns', b='nt')}) || ' from the source is missing or changed in the translation' FROM a WHERE len(nt) > 0
UNION ALL SELECT lang, key, ord, 7, 'error', 'glossary_dropped', 'glossary term dropped: ' || term FROM g WHERE contains(lower(src), lower(term)) AND NOT contains(lower(tgt), lower(term))
UNION ALL SELECT lang, key, ord, 8, 'error', 'glossary_collapse', 'translation collapsed to the glossary term "' || list_filter(['Brand', 'STEEL', 'Copper'], lambda x: contains(lower(tgt), lower(x)))[1] || '" — the sentence is gone' FROM a
 WHERE len(regexp_extract_all(src, '\\p{{L}}{{2,}}')) >= 3 AND NOT regexp_matches(regexp_replace(regexp_replace(tgt, '{_TERMS}', ' ', 'g'), '{_PH}', ' ', 'g'), '\\p{{L}}') AND regexp_matches(tgt, '{_TERMS}')
UNION ALL SELECT lang, key, ord, 9, 'warn', 'glossary_case', 'glossary case: ' || forms[1] || ' appears as "' || seen[1] || '" — a kept term keeps its exact case' FROM f
 WHERE len(forms) > 0 AND len(seen) > 0 AND len(list_filter(forms, lambda x: contains(tgt, x) OR contains(tgt, upper(x[1]) || x[2:]) OR contains(tgt, lower(x[1]) || x[2:]))) = 0
UNION ALL SELECT lang, key, ord, 11, 'warn', 'untranslated', 'may be untranslated — identical to the source text' FROM a WHERE src = tgt AND len(regexp_extract_all(rest, '\\p{{L}}{{2,}}')) >= 3
 AND len(list_filter(regexp_split_to_array(rest, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-zß-öø-ÿ][A-Za-zÀ-ÿ]{{3,}}'))) > 0""")
def string_findings(spark, sf_dir):
    return O.string_findings(pairs(spark, sf_dir, "brand_pairs").unionByName(pairs(spark, sf_dir, "part_pairs")), GLOSSARY)


@query(f"""WITH {_SNAPSHOTS} SELECT 'missing-key' AS rule, 'error' AS level, '[de] missing translation for key "' || key || '"' AS text FROM o WHERE key NOT IN (SELECT key FROM n)
UNION ALL SELECT 'extra-key', 'note', '[de] key "' || key || '" is not in the source file' FROM n WHERE key NOT IN (SELECT key FROM o)""")
def sarif_results(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    found = K.missing_keys(old, new, ["key"]).select(F.lit("missing").alias("kind"), "key").unionByName(K.extra_keys(old, new, ["key"]).select(F.lit("extra").alias("kind"), "key"))
    full = found.select("kind", F.lit("de").alias("lang"), "key", F.lit(None).cast("string").alias("text"), F.lit("de.json").alias("path"))
    return sinks.sarif_results(full).select("rule", "level", "text")


# --- change detection and memory ------------------------------------------------------------------


@query(f"""WITH {_SNAPSHOTS}, l AS (SELECT key, sha256(value) AS hash FROM o WHERE ord % 5 <> 0)
SELECT n.key, sha256(n.value) AS hash, CASE WHEN o.key IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM n LEFT JOIN o ON n.key = o.key LEFT JOIN l ON n.key = l.key WHERE o.key IS NULL OR l.hash <> sha256(n.value)""")
def lock_pending(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return I.pending(new, old, I.hashed(old.where("ord % 5 <> 0")))


@query(f"""WITH {_SNAPSHOTS} SELECT n.key, sha256(n.value) AS hash FROM n WHERE key IN (SELECT key FROM o) AND key NOT IN (SELECT key FROM o WHERE ord % 5 <> 0)""")
def lock_unverified(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return I.unverified(new, old, I.hashed(old.where("ord % 5 <> 0")))


def _advance(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    old, new = _snapshots(spark, sf_dir)
    langs = spark.createDataFrame([("de",), ("fr",)], "lang string")
    lock = I.lock_of(I.hashed(old).withColumn("lang", F.lit(None).cast("string")).select("lang", "key", "hash"), langs)
    skipped = new.where("ord % 3 = 0").select(F.lit("fr").alias("lang"), "key")
    return new, I.hashed(old), I.advanced(new, lock, skipped), skipped


@query(f"""WITH {_SNAPSHOTS} SELECT 'de' AS lang, key, sha256(value) AS hash FROM n
UNION ALL SELECT 'fr', n.key, CASE WHEN n.ord % 3 = 0 THEN sha256(o.value) ELSE sha256(n.value) END FROM n LEFT JOIN o ON n.key = o.key WHERE n.ord % 3 <> 0 OR o.key IS NOT NULL""")
def lock_advance(spark, sf_dir):
    return _advance(spark, sf_dir)[2]


@query(f"""WITH {_SNAPSHOTS} SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL OR n.ord % 3 = 0 THEN sha256(o.value) ELSE sha256(n.value) END AS hash
FROM n FULL JOIN o ON n.key = o.key WHERE NOT (n.key IS NOT NULL AND n.ord % 3 = 0 AND o.key IS NULL)""")
def lock_global(spark, sf_dir):
    new, before, by_lang, skipped = _advance(spark, sf_dir)
    return I.advanced_global(new, before, by_lang, skipped)


@query(f"""WITH {_SNAPSHOTS} SELECT key, value FROM n WHERE key IN (SELECT key FROM o WHERE ord % 4 = 1)""")
def key_subset(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return K.subset(new, old.where("ord % 4 = 1")).select("key", "value")


# An incremental run: German has its own record, French the one of all languages, Spanish none of its strings but some.
_RUN = f"""{_SNAPSHOTS}, l AS (SELECT lang FROM (VALUES ('de'), ('fr'), ('es')) t(lang)),
k AS (SELECT 'de' AS lang, key, sha256(value) AS hash FROM o WHERE ord % 5 <> 0 UNION ALL SELECT lang, key, sha256(value) FROM o, (VALUES ('fr'), ('es')) t(lang) WHERE ord % 3 <> 0),
t AS (SELECT lang, key FROM o, l WHERE lang <> 'es' OR ord % 2 = 0),
j AS (SELECT l.lang, n.key, sha256(n.value) AS hash, k.hash AS locked, CASE WHEN t.key IS NULL THEN 'missing' WHEN k.hash <> sha256(n.value) THEN 'changed' WHEN k.hash IS NULL THEN 'unverified' END AS reason
  FROM n CROSS JOIN l LEFT JOIN t ON t.lang = l.lang AND t.key = n.key LEFT JOIN k ON k.lang = l.lang AND k.key = n.key)"""


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    old, new = _snapshots(spark, sf_dir)
    langs = spark.createDataFrame([("de",), ("fr",), ("es",)], "lang string")
    locked = lambda lang, where: I.hashed(old.where(where)).select(F.lit(lang).cast("string").alias("lang"), "key", "hash")
    lock = locked("de", "ord % 5 <> 0").unionByName(locked(None, "ord % 3 <> 0"))
    targets = K.by_language(old, langs).where("lang <> 'es' OR ord % 2 = 0")
    return new, lock, langs, P.judged(new, targets, lock, langs)


@query(f"WITH {_RUN} SELECT lang, key, hash, reason FROM j WHERE reason IS NOT NULL")
def incremental_plan(spark, sf_dir):
    return _run(spark, sf_dir)[3]


@query(f"""WITH {_RUN}, a AS (SELECT lang, key, CASE WHEN reason = 'unverified' OR lang = 'fr' AND reason IS NOT NULL THEN locked ELSE hash END AS hash, reason = 'unverified' OR lang = 'fr' AND reason IS NOT NULL AS skip, hash AS now FROM j),
g AS (SELECT key, bool_or(coalesce(skip, false)) AS skip, count(*) FILTER (WHERE hash = now) AS n, max(now) AS now FROM a GROUP BY key),
b AS (SELECT key, sha256(value) AS hash FROM o WHERE ord % 3 <> 0)
SELECT lang, key, hash FROM a WHERE hash IS NOT NULL
UNION ALL SELECT NULL, key, hash FROM (SELECT coalesce(g.key, b.key) AS key, CASE WHEN g.key IS NULL OR g.skip THEN b.hash WHEN g.n = 3 THEN g.now END AS hash FROM g FULL JOIN b ON g.key = b.key) WHERE hash IS NOT NULL""")
def incremental_locks(spark, sf_dir):
    new, lock, langs, found = _run(spark, sf_dir)
    return P.finished(new, lock, langs, found, spark.createDataFrame([("fr",)], "lang string"))


@query("""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS key, sha256(p_name) AS hash, p_size % 10 AS lock FROM part)
SELECT CAST(lock AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS lang, key, hash FROM s WHERE lock <> 3
UNION ALL SELECT CAST(lock AS VARCHAR), 'de', key, hash FROM s WHERE lock > 4 UNION ALL SELECT CAST(lock AS VARCHAR), 'pt-BR', key, hash FROM s WHERE lock > 4""")
def lock_documents(spark, sf_dir):
    """Ten lock documents, of which some are old, one is damaged, and the others hold languages."""
    part = _table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("lock"), F.struct(F.col("p_partkey").cast("string").alias("key"), F.sha2("p_name", 256).alias("hash")).alias("e"))
    held = part.groupBy("lock").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("m"))
    new = F.concat(F.lit('{"version": 2, "settings": {"tone": "x"}, "keys": '), "m", F.lit(', "langs": {"de": '), "m", F.lit(', "pt-BR": '), "m", F.lit(', "xx": 5}}'))
    old = F.regexp_replace("m", r"\}$", ', "number": 12, "object": {"a": "b"}, "list": ["a"]}')
    text = F.when(F.col("lock") == 3, F.substring("m", 1, 40)).when(F.col("lock") > 4, new).otherwise(old)
    return stores.lock_rows(held.select(F.col("lock").cast("string").alias("path"), text.alias("text")))


@query("""SELECT 'e' || CAST(p_partkey AS VARCHAR) AS entry_id, p_name AS source, lang, lang || ' "' || p_type || '"' AS translated FROM part, (VALUES ('de'), ('fr')) t(lang) WHERE p_size % 10 <> 3""")
def memory_documents(spark, sf_dir):
    """Ten memory documents, one of them damaged."""
    entry = F.to_json(F.struct(F.col("p_name").alias("source"), *(F.concat(F.lit(f'{x} "'), "p_type", F.lit('"')).alias(x) for x in ("de", "fr"))))
    entries = F.concat_ws(", ", F.collect_list(F.concat(F.lit('"e'), F.col("p_partkey").cast("string"), F.lit('": '), entry)))
    held = _table(spark, sf_dir, "part").groupBy((F.col("p_size") % 10).alias("path")).agg(entries.alias("m"))
    whole = F.concat(F.lit('{"version": 1, "entries": {'), "m", F.lit("}}"))
    return stores.memory_rows(held.select(F.col("path").cast("string"), F.when(F.col("path") == 3, F.substring(whole, 1, 60)).otherwise(whole).alias("text")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE p_name || ' é' END AS text, p_partkey % 6 = 5 AS refused FROM part""")
def decoded_texts(spark, sf_dir):
    """Names in UTF-8 with and without a mark, in UTF-16 with and without one, as a .properties file in Latin-1, and in Latin-1 elsewhere, which is refused."""
    text, mark = F.concat("p_name", F.lit(" é")), lambda x: F.unhex(F.lit(x))
    kinds = [F.encode(text, "UTF-8"), F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")), F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")), F.encode(text, "UTF-16BE"), F.encode(text, "ISO-8859-1"), F.encode(text, "ISO-8859-1")]
    content = F.coalesce(*(F.when(F.col("p_partkey") % 6 == i, x) for i, x in enumerate(kinds)))
    path = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 6 == 4, ".properties").otherwise(".json"))
    read = decode.texts(_table(spark, sf_dir, "part").select(path.alias("path"), content.alias("content")))
    return read.select(F.regexp_replace("path", r"\..*$", "").alias("path"), "text", F.col("error").isNotNull().alias("refused"))


_SIGNATURE = I.settings(tone="formal", keep="Brand, ACME")


def _entry(x: str) -> str:
    settings = '{"app_context":"","icu":false,"keep":["ACME","Brand"],"model":"","tone":"formal"}'
    return f"substr(sha256('{settings}' || chr(0) || {x}), 1, 32)"


def _memory(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(I.entry_id(F.col("p_name"), _SIGNATURE).alias("entry_id"), F.col("p_name").alias("source"), F.lit("de").alias("lang"), F.concat(F.lit("de:"), "p_name").alias("translated")).distinct()


@query(f"WITH {_SNAPSHOTS}, m AS (SELECT DISTINCT {_entry('p_name')} AS e, 'de:' || p_name AS translated FROM part) SELECT 'de' AS lang, key, translated FROM n JOIN m ON {_entry('n.value')} = m.e")
def memory_recall(spark, sf_dir):
    _, new = _snapshots(spark, sf_dir)
    return M.recalled(new, _memory(spark, sf_dir), spark.createDataFrame([("de",), ("fr",)], "lang string"), _SIGNATURE)


_RECORD = f"""WITH {_SNAPSHOTS}, m AS (SELECT DISTINCT {_entry('p_name')} AS entry_id, p_name AS source, 'de:' || p_name AS translated FROM part),
f AS (SELECT {_entry('value')} AS entry_id, min(value) AS source, arg_max(CASE WHEN ord % 2 = 0 THEN 'de:' ELSE 'neu:' END || value, ord) AS fresh FROM n GROUP BY 1),
r AS (SELECT coalesce(m.entry_id, f.entry_id) AS entry_id, coalesce(m.source, f.source) AS source, 'de' AS lang, coalesce(fresh, translated) AS translated, coalesce(fresh IS NOT NULL AND (translated IS NULL OR translated <> fresh), false) AS is_new FROM m FULL JOIN f ON m.entry_id = f.entry_id)"""


@query(_RECORD + " SELECT * FROM r")
def memory_record(spark, sf_dir):
    _, new = _snapshots(spark, sf_dir)
    made = new.select(F.lit("de").alias("lang"), "key", "ord", F.concat(F.when(F.col("ord") % 2 == 0, "de:").otherwise("neu:"), "value").alias("value"), "vtype")
    return M.recorded(_memory(spark, sf_dir), new, made, _SIGNATURE)


@query(_RECORD + " SELECT count(DISTINCT entry_id) AS entries, count(*) AS pairs FROM r")
def memory_count(spark, sf_dir):
    return M.counted(memory_record(spark, sf_dir))


# --- documents and helpers ------------------------------------------------------------------------


@query("SELECT CAST(event_id AS VARCHAR) AS path, 'k' AS key, json_extract_string(props, '$.k') AS value, 'number' AS vtype FROM events WHERE props IS NOT NULL")
def flatten_props(spark, sf_dir):
    texts = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    return S.flatten(texts).where("error IS NULL").select("path", "key", "value", "vtype")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS path, CASE n_nationkey % 4 WHEN 0 THEN 'out/de.json' WHEN 1 THEN 'loc/de/' || n_name || '.json' WHEN 2 THEN 'app_de.arb' ELSE 'x/de/' || n_name || '.json' END AS target FROM nation""")
def target_paths(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    kind = F.col("n_nationkey") % 4
    source = F.when(kind == 0, F.lit("loc/en.json")).when(kind == 1, F.concat(F.lit("loc/en/"), "n_name", F.lit(".json"))).when(kind == 2, F.lit("app_en.arb")).otherwise(F.concat(F.lit("x/"), "n_name", F.lit(".json")))
    out = F.when(kind == 0, F.lit("out")).otherwise(F.lit(""))
    return n.select(F.col("n_nationkey").cast("string").alias("path"), S.target_path(source, F.lit("de"), out, F.lit("en")).alias("target"))


@query("""SELECT c_custkey AS id, CASE WHEN n >= 1000000 THEN CAST(n // 1000000 AS VARCHAR) || CASE WHEN n // 100000 % 10 <> 0 THEN '.' || CAST(n // 100000 % 10 AS VARCHAR) ELSE '' END || 'M' WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END AS shown,
 CASE WHEN n >= 9500000 THEN 'crit' WHEN n >= 8000000 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT c_custkey, greatest(CAST(floor(c_acctbal * 1000) AS BIGINT), 0) AS n FROM customer)""")
def volumes(spark, sf_dir):
    n = F.floor(F.col("c_acctbal") * 1000)
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), quota.short_count(n).alias("shown"), quota.quota_level(n, F.lit(10_000_000)).alias("level"))


# Documents made of rows of part: a nested one, an ARB file and a string catalog for each.


def _documents(spark, sf_dir) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    head = F.concat(F.lit('{"part": {"name": "'), "p_name", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit(', "tags": ["a", 1]}, "@part": {"description": "x"}, "sold": '))
    whole = F.concat(head, F.when(F.col("p_size") > 25, "true").otherwise("null"), F.lit("}"))
    return part.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 10 == 9, F.substring(whole, 1, 30)).otherwise(whole).alias("text"))


_WHOLE = "part WHERE p_partkey % 10 <> 9"


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(0 AS BIGINT) AS ord, 'part.name' AS key, p_name AS value, 'string' AS vtype FROM {_WHOLE}
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'part.size', CAST(p_size AS VARCHAR), 'number' FROM {_WHOLE}
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, 'part.tags', '["a", 1]', 'array' FROM {_WHOLE}
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 4, 'sold', CASE WHEN p_size > 25 THEN 'true' ELSE 'null' END, CASE WHEN p_size > 25 THEN 'boolean' ELSE 'null' END FROM {_WHOLE}""")
def arb_segments(spark, sf_dir):
    """Leaves of every type of ARB documents without their metadata; a tenth of the documents is damaged and gives none."""
    return S.without_metadata(S.flatten(_documents(spark, sf_dir)).where("error IS NULL")).select("path", "ord", "key", "value", "vtype")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, count(*) FILTER (WHERE p_partkey % 10 <> 9) * 2 AS strings, count(*) FILTER (WHERE p_partkey % 10 = 9) AS damaged FROM part GROUP BY p_partkey""")
def translatable_strings(spark, sf_dir):
    """How many leaves of a document can be translated: its name, and the description in its metadata."""
    rows = S.flatten(_documents(spark, sf_dir))
    return rows.groupBy("path").agg(F.count_if(F.col("vtype") == "string").alias("strings"), F.count("error").alias("damaged"))


@query(r"""WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_name, p_partkey % 4 AS kind FROM part)
SELECT path, 'en' AS lang, p_name AS key, p_name AS value FROM c WHERE kind <> 3
UNION ALL SELECT path, 'de', p_name, 'de ' || p_name FROM c WHERE kind = 0
UNION ALL SELECT path, 'de', p_name || ' (plural)', '{count, plural, one {# ' || p_name || '} other {#x ' || p_name || '}}' FROM c WHERE kind = 1
UNION ALL SELECT path, 'de', p_name || ' (device ' || d || ')', d || ' ' || p_name FROM c, (VALUES ('mac'), ('iphone')) t(d) WHERE kind = 2
UNION ALL SELECT path, 'de', p_name || ' (sub n, plural)', '{count, plural, other {%d of %s ' || p_name || '}}' FROM c WHERE kind = 2""")
def catalog_segments(spark, sf_dir):
    """String catalogs: plain texts, plurals as one message, devices and substitutions, entries that are not to be translated; keys as people read them."""
    part = _table(spark, sf_dir, "part")
    unit = lambda *x: F.concat(F.lit('{"stringUnit": {"state": "translated", "value": "'), *x, F.lit('"}}'))
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    plural = F.concat(F.lit('{"variations": {"plural": {"one": '), unit(F.lit("%lld "), name), F.lit(', "other": '), unit(F.lit("%lldx "), name), F.lit("}}}"))
    below = F.concat(F.lit('{"variations": {"device": {"mac": '), unit(F.lit("mac "), name), F.lit(', "iphone": '), unit(F.lit("iphone "), name),
                     F.lit('}}, "substitutions": {"n": {"variations": {"plural": {"other": '), unit(F.lit("%d of %s "), name), F.lit("}}}}}"))
    german = F.when(kind == 0, unit(F.lit("de "), name)).when(kind == 1, plural).otherwise(below)
    entry = F.when(kind == 3, F.lit('{"shouldTranslate": false}')).otherwise(F.concat(F.lit('{"localizations": {"de": '), german, F.lit("}}")))
    text = F.concat(F.lit('{"sourceLanguage": "en", "strings": {"'), name, F.lit('": '), entry, F.lit("}}"))
    rows = S.catalog(part.select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))
    return rows.where("error IS NULL").select("path", "lang", S.shown_key(F.col("key")).alias("key"), "value")


@query("""SELECT n_name AS lang, 'out/' || n_name || '/app.' || n_name || '.json' AS target FROM nation""")
def pattern_targets(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_name").alias("lang"), S.pattern_path(F.lit("out/{lang}/app.{lang}.json"), F.col("n_name")).alias("target"))


_MEMBERS = ["de/{}.json", "../{}.json", "/abs/{}", "C:\\{}", "a/b/{}.json", "a\\..\\{}", "..{}/x", "a//{}."]


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 8 IN (0, 6, 7) AS safe FROM part""")
def archive_members(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    name = F.coalesce(*(F.when(F.col("p_partkey") % 8 == i, F.replace(F.lit(m), F.lit("{}"), key)) for i, m in enumerate(_MEMBERS)))
    return _table(spark, sf_dir, "part").select(key.alias("id"), S.safe_member(name).alias("safe"))


@query("""WITH n AS (SELECT o_orderkey AS id, 1000 + o_orderkey % 9000 AS n, o_orderkey % 6 AS kind FROM orders)
SELECT id, CASE kind WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN CAST(n AS VARCHAR) || '.5' WHEN 3 THEN CAST(n AS VARCHAR) || '.25' WHEN 4 THEN CAST(n AS VARCHAR) ELSE CAST(n AS VARCHAR) || '000' END AS key FROM n""")
def number_keys(spark, sf_dir):
    """Numbers as languages write them: grouped by commas or spaces, decimal commas and points, foreign digits."""
    n = (F.col("o_orderkey") % 9000 + 1000).cast("string")
    grouped = lambda by: F.concat(F.substring(n, 1, 1), F.lit(by), F.substring(n, 2, 3))
    kinds = [grouped(","), grouped("\u00a0"), F.concat(grouped("."), F.lit(",5")), F.concat(n, F.lit(".25")), F.translate(n, T.ASCII_DIGITS[:10], T.FOREIGN_DIGITS[:10]), F.concat(grouped("'"), F.lit("'000"))]
    shown = F.coalesce(*(F.when(F.col("o_orderkey") % 6 == i, x) for i, x in enumerate(kinds)))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), D.number_key(shown).alias("key"))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey % 13 AS k, p_partkey % 3 AS lang FROM part)
SELECT key, 'number ' || k || ' appears in the translation but not the source' AS msg FROM p WHERE k NOT IN (3, 7, 12) AND NOT (k = 1 AND lang = 0)""")
def spelled_number_drift(spark, sf_dir):
    """Numbers that the source spells as words, or in languages of counters as an article, may be digits in the translation."""
    part = _table(spark, sf_dir, "part")
    lang = F.when(F.col("p_partkey") % 3 == 0, "ja").when(F.col("p_partkey") % 3 == 1, "de-AT").otherwise("fr")
    both = part.select(F.col("p_partkey").cast("string").alias("key"), lang.alias("lang"), F.lit("Take a Seventh of three boxes, TWELVE times: no.").alias("src"), F.concat(F.lit("x "), (F.col("p_partkey") % 13).cast("string"), F.lit(" y")).alias("tgt"))
    return _each(both, D.number_drift(F.col("src"), F.col("tgt"), F.col("lang")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 3 WHEN 0 THEN 'Sold ' || p_name || ' or more' || ' today' WHEN 1 THEN p_name ELSE 'it: ' || p_type || ' and ' || p_name END AS shown FROM part""")
def visible_texts(spark, sf_dir):
    """What of a message is shown at most: of each plural or choice the longest arm, also inside of others."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 3
    one = F.concat(F.lit("Sold {n, plural, one {x} other {"), name, F.lit(" or more}} today"))
    two = F.concat(F.lit("{who, select, a {it} other {it: {n, selectordinal, one {z} other {"), "p_type", F.lit("}} and "), name, F.lit("}}"))
    both = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.when(kind == 0, one).when(kind == 1, name).otherwise(two).alias("src"), F.lit("").alias("tgt"))
    return O.with_icu(both).select("key", F.coalesce(F.col("src_icu")["visible"], "src").alias("shown"))


@query("SELECT n_nationkey AS id, lower(split_part(replace(n_name, '_', '-'), '-', 1)) AS base FROM nation")
def base_languages(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), base_language(F.col("n_name")).alias("base"))


@query("SELECT CAST(page_id AS VARCHAR) AS path, 'title' AS leaf, CAST(2 AS BIGINT) AS line FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 'url', 3 FROM pages")
def key_lines(spark, sf_dir):
    text = F.concat(F.lit('{\n  "title": "'), F.col("page_id").cast("string"), F.lit('",\n  "url": "x",\n  "title": ""\n}'))
    return sinks.key_lines(_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), text.alias("text"))).select("path", "leaf", F.col("line").cast("long").alias("line"))


# --- projects of many files -----------------------------------------------------------------------

# Twenty source files of the names of parts, in folders of languages. German has translations of most, French of every second file.
_FILES = """s AS (SELECT 'n' || CAST(p_partkey % 20 AS VARCHAR) || '.json' AS file, 'part.p' || CAST(p_partkey AS VARCHAR) AS key, p_partkey AS id, p_name FROM part)"""


def _project(spark, sf_dir) -> str:
    """Writes the files, and returns their folder."""
    folder = f"{shared_folder(spark)}/project-{uuid.uuid4().hex}"
    part = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("n"), F.col("p_partkey").alias("id"), "p_name")
    name = F.concat(F.lit("/n"), F.col("n").cast("string"), F.lit(".json"))

    def of(rows: DataFrame, lang: str, value: Column) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{folder}/locales/{lang}"), name).alias("target"), F.concat(F.lit("part.p"), F.col("id").cast("string")).alias("key"), F.col("id").alias("place"), value.alias("value"), F.lit("string").alias("vtype"), F.lit(False).alias("flat"))

    edited = F.concat(F.lit("x"), "p_name", F.when(F.col("id") % 7 == 0, " v2").otherwise(""))
    extra = of(part.where("id % 17 = 0"), "de", F.lit("x")).withColumn("key", F.concat("key", F.lit(".old"))).withColumns({"key": F.regexp_replace("key", "^part", "gone"), "place": F.col("place") + (1 << 40)})
    german = of(part.where("id % 11 <> 0"), "de", edited).unionByName(extra)
    sinks.write_locales(of(part, "en", F.col("p_name")).unionByName(german).unionByName(of(part.where("n % 2 = 0"), "fr", F.concat(F.lit("x"), "p_name"))))
    return folder


def _file(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


@query(f"""WITH {_FILES}, odd AS (SELECT DISTINCT file FROM s WHERE id % 2 = 1)
SELECT 'missing' AS kind, file, 'de' AS lang, key, '' AS text FROM s WHERE id % 11 = 0
UNION ALL SELECT 'missing', file, 'fr', key, '' FROM s WHERE id % 2 = 1 UNION ALL SELECT 'missing_file', file, 'fr', '', '' FROM odd
UNION ALL SELECT 'extra', file, 'de', 'gone.p' || CAST(id AS VARCHAR) || '.old', '' FROM s WHERE id % 17 = 0
UNION ALL SELECT 'error', file, 'de', key, 'number 2 appears in the translation but not the source' FROM s WHERE id % 7 = 0 AND id % 11 <> 0""")
def many_sources(spark, sf_dir):
    """Twenty files in two languages, written by executors and checked in one plan; what warns is left out."""
    found, _ = R.check_sources(spark, f"{_project(spark, sf_dir)}/locales/en/*.json", ["de", "fr"])
    return found.where("kind <> 'warning'").select("kind", _file(F.col("file")).alias("file"), "lang", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH {_FILES}, t AS (SELECT *, sha256(p_name) AS hash FROM s), m AS (SELECT DISTINCT {_entry('p_name')} AS entry_id, p_name FROM t WHERE id % 22 = 0)
SELECT 'text' AS what, file, 'de' AS lang, key, CASE WHEN id % 11 <> 0 THEN 'x' || p_name || CASE WHEN id % 7 = 0 THEN ' v2' ELSE '' END ELSE 'de ' || p_name END AS value FROM s WHERE id % 11 <> 0 OR id % 22 = 0
UNION ALL SELECT 'text', file, 'de', 'gone.p' || CAST(id AS VARCHAR) || '.old', 'x' FROM s WHERE id % 17 = 0
UNION ALL SELECT 'lock', file, lang, key, hash FROM t, (VALUES ('de'), ('')) l(lang) WHERE id % 22 = 0
UNION ALL SELECT 'memory', '', 'de', entry_id, 'de ' || p_name FROM m
UNION ALL SELECT 'due', file, 'de', key, 'missing' FROM s WHERE id % 22 = 11 UNION ALL SELECT 'due', file, 'de', key, 'unverified' FROM s WHERE id % 11 <> 0""")
def file_run(spark, sf_dir):
    """A run over twenty files of which half the missing strings come back translated: documents, locks and memory as it leaves them, and what the next run finds due."""
    folder, of = _project(spark, sf_dir), _SIGNATURE
    sources = f"{folder}/locales/en/*.json"
    run = U.open_run(spark, folder, sources, ["de"], of)
    due = run.work().where(F.regexp_extract("key", r"(\d+)$", 1).cast("long") % 2 == 0)
    U.close_run(run, due.select("file", "lang", "key", F.concat(F.lit("de "), "text").alias("value")))
    after = U.open_run(spark, folder, sources, ["de"], of)
    row = lambda what, file, lang, key, value: [F.lit(what).alias("what"), file.alias("file"), lang.alias("lang"), F.col(key).alias("key"), value.alias("value")]
    file, lang = _file(F.col("file")), F.coalesce("lang", F.lit(""))
    out = after.project.target.select(*row("text", file, lang, "key", F.col("value")))
    out = out.unionByName(after.lock.select(*row("lock", file, lang, "key", F.col("hash"))))
    out = out.unionByName(after.memory.select(*row("memory", F.lit(""), lang, "entry_id", F.col("translated"))))
    return out.unionByName(after.found.select(*row("due", file, lang, "key", F.col("reason"))))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name AS n FROM part)
SELECT id, CASE k WHEN 0 THEN '/a/' || n || '/c.json' WHEN 1 THEN '/c.json' WHEN 2 THEN '../' || n WHEN 3 THEN 'C:/a/' || n WHEN 4 THEN 'file:/' || n || '/x' ELSE '.' END AS normal,
CASE k WHEN 0 THEN n || '/c.json' WHEN 1 THEN '../c.json' WHEN 2 THEN '../' || n WHEN 3 THEN 'C:/a/' || n WHEN 4 THEN 'file:/' || n || '/x' ELSE '.' END AS seen,
CASE WHEN k IN (0, 3) THEN 'https://h' || id || '.example/v1' WHEN k = 1 THEN 'http://user:pw@localhost:80' || id % 10 WHEN k = 4 THEN 'http://[::1]:8000' END AS url,
CASE k WHEN 0 THEN 'key-' || id WHEN 1 THEN 'a b' WHEN 3 THEN '~' END AS header, k IN (4, 5) AS refused FROM p""")
def paths_and_addresses(spark, sf_dir):
    """Paths with dots, drives and schemes, in their shortest form and as seen from /a; addresses with users and ports; keys for headers."""
    part, kind = _table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    pick = lambda *x: F.coalesce(*(F.when(kind == i, v if isinstance(v, Column) else F.lit(v)) for i, v in enumerate(x)))
    name, id_ = F.col("p_name"), F.col("p_partkey").cast("string")
    path = pick(F.concat(F.lit("/a//./b/../"), name, F.lit("/c.json")), "/../a/../c.json", F.concat(F.lit("x/../../"), name), F.concat(F.lit("C:\\a\\b\\..\\"), name), F.concat(F.lit("file:///"), name, F.lit("//x/")), "./a/..")
    root = F.when(kind.isin(2, 5), F.lit(".")).otherwise(F.lit("/a"))
    url = pick(F.concat(F.lit(" h"), id_, F.lit(".example/v1/ ")), F.concat(F.lit("http://user:pw@localhost:80"), F.col("p_partkey") % 10), F.lit("http://localhost@evil.example"), F.concat(F.lit("https://h"), id_, F.lit(".example/v1")), "http://[::1]:8000/", "ftp://127.0.0.1")
    key = pick(F.concat(F.lit(" key-"), id_, F.lit("\n")), "a b", "  ", "~", "clé", "a\tb")
    a, b = A.service_url(url), A.header_value(key)
    return part.select(F.col("p_partkey").alias("id"), A.normal(path).alias("normal"), A.relative(path, root).alias("seen"), a["url"].alias("url"), b["value"].alias("header"), b["refused"].isNotNull().alias("refused"))


@query("""WITH p AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS path, p_partkey % 40 AS a, 'p' || p_partkey AS key, p_name, lang FROM part, (VALUES ('de'), ('fr')) t(lang))
SELECT path, '/app/locales/' || lang || '.json' AS target, key, lang || ' ' || p_name AS value, '' AS refused FROM p WHERE a >= 3
UNION ALL SELECT DISTINCT path, '', '', '', CASE a WHEN 0 THEN 'outside' WHEN 1 THEN 'size' ELSE 'damaged' END FROM p WHERE a < 3""")
def unpacked_archives(spark, sf_dir):
    """Forty archives made of parts: members by the file they belong to; one leads outside, one grows beyond its bound, one is cut off."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        n, buffer = int(rows["n"].iloc[0]), io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for lang in ("de", "fr"):
                z.writestr(("../" if n == 0 else "") + f"{lang}.json", json.dumps({k: f"{lang} {v}" for k, v in zip(rows["key"], rows["p_name"], strict=True)}))
            if n == 1:
                z.writestr("es.json", b" " * (2 << 20))
        content = buffer.getvalue()
        return pd.DataFrame({"path": [str(n)], "content": [content[: len(content) // 2] if n == 2 else content]})

    part = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("n"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), "p_name")
    ship(spark)
    found = staged(archives.members(part.groupBy("n").applyInPandas(pack, "path string, content binary"), member_bytes=1 << 20), "members")
    target = archives.member_target(F.col("name"), F.lit("/app/locales/en.json"), F.lit(""), F.lit("en"))
    texts = found.where("error IS NULL").select(F.concat_ws("|", "path", target).alias("path"), "content")
    rows = S.flatten(decode.texts(texts)).select(F.split("path", r"\|")[0].alias("path"), F.split("path", r"\|")[1].alias("target"), "key", "value", F.lit("").alias("refused"))
    why = F.when(F.col("error").contains("outside"), "outside").when(F.col("error").contains("larger"), "size").otherwise("damaged")
    return rows.unionByName(found.where("error IS NOT NULL").select("path", *(F.lit("").alias(c) for c in ("target", "key", "value")), why.alias("refused")))


@query(f"""WITH d AS (SELECT doc_id, text, {_entry('text')} AS e FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT e, text FROM d WHERE doc_id % 3 <> 0), f AS (SELECT DISTINCT e, text FROM d WHERE doc_id % 2 = 0), n AS (SELECT DISTINCT e, text FROM d WHERE doc_id % 5 = 0)
SELECT 'pair' AS what, e AS id, 'fr' AS lang, 'fr ' || text AS translated FROM f UNION ALL SELECT 'pair', e, 'de', 'neu ' || text FROM n
UNION ALL SELECT 'pair', e, 'de', 'de ' || text FROM a WHERE e NOT IN (SELECT e FROM n)
UNION ALL SELECT 'reused', CAST(doc_id AS VARCHAR), 'de', 'de ' || text FROM d WHERE e IN (SELECT e FROM a)
UNION ALL SELECT 'count', 'entries_added', '', CAST(count(DISTINCT e) AS VARCHAR) FROM d WHERE (doc_id % 2 = 0 OR doc_id % 5 = 0) AND e NOT IN (SELECT e FROM a)
UNION ALL SELECT 'count', 'pairs_added', '', CAST((SELECT count(*) FROM f) + (SELECT count(*) FROM n WHERE e NOT IN (SELECT e FROM a)) AS VARCHAR)
UNION ALL SELECT 'count', 'pairs_changed', '', CAST(count(*) AS VARCHAR) FROM n WHERE e IN (SELECT e FROM a) UNION ALL SELECT 'count', 'pairs_same', '', '0'""")
def memory_in_buckets(spark, sf_dir):
    """Documents as strings of a project whose memory is a table: two runs record in it, and between them the next run looks up what it knows."""
    name, of = f"memory_{uuid.uuid4().hex}", _SIGNATURE
    memory_table.create(spark, name, digits=1, buckets=8)
    source = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("ord"), F.col("text").alias("value"), F.lit("string").alias("vtype"))
    made = lambda lang, word, nth: source.where(nth).select(F.lit(lang).alias("lang"), "key", "ord", F.concat(F.lit(word), "value").alias("value"), "vtype")
    memory_table.recorded(spark, name, source, made("de", "de ", "ord % 3 <> 0"), of)
    langs = spark.createDataFrame([("de",), ("fr",)], "lang string")
    known = memory_table.recalled(spark, name, source, langs, of)
    counts = memory_table.recorded(spark, name, source, made("fr", "fr ", "ord % 2 = 0").unionByName(made("de", "neu ", "ord % 5 = 0")), of)
    out = memory_table.pairs(spark, name).select(F.lit("pair").alias("what"), F.col("entry_id").alias("id"), "lang", "translated")
    out = out.unionByName(known.select(F.lit("reused").alias("what"), F.col("key").alias("id"), "lang", "translated"))
    return out.unionByName(spark.createDataFrame([("count", k, "", str(v)) for k, v in counts.items()], "what string, id string, lang string, translated string"))


@query("""WITH t(term) AS (VALUES ('Plate'), ('STEEL'), ('hot r'), ('copper'), ('zz%q')) SELECT term FROM t WHERE NOT EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name), lower(term)))""")
def glossary_absent(spark, sf_dir):
    """Terms that no source string holds, so that nothing kept them."""
    source = _table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), F.lit("string").alias("vtype"))
    return O.absent_terms(source, ["Plate", " STEEL", "hot r", "copper", "", "zz%q"])
