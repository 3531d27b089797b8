"""Key joins, documents, locks, memory, reports, and every query against its SQL."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lokalens import queries as library
from lokalens.functions.detectors import placeholder_set
from lokalens.functions.icu import parsed
from lokalens.functions.quota import quota_level, short_count
from lokalens.operators import findings as O
from lokalens.operators import incremental as I
from lokalens.operators import keys as K
from lokalens.operators import memory as M
from lokalens.plans import check as C
from lokalens.sources import segments as S
from lokalens.sources import sinks
from lokalens.sources.decode import UnreadableText, decode, read_texts

DATA = "/root/testdata/sf0.001"
SEGMENTS = "lang string, key string, ord long, value string, vtype string"


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, oracle, name):
    df = library.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in library.SQL:
        assert rows
        return
    columns = sorted(df.columns)
    got = oracle.execute(library.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert plain([tuple(r[c] for c in columns) for r in rows]) == plain(want)


def test_placeholder_sets_of_the_key_check(spark):
    cases = {
        "Hi ${name}": ["${name}"], "Hi {name} {{name}}": ["{name}"], ":smile:": [], "%1$s %@ %d 5%%": ["%%", "%1$s", "%@", "%d"],
        "{n, plural, one {# a} other {# {x}}}": ["{n}"], "{a {b}": ["{b}"], "a } b {c}": ["{c}"], "{}": ["{}"], "": [],
        "{ spaced , number}": ["{spaced}"], "{{{x}}} %s": ["%s", "{x}"], "{a {b} %s": ["%s", "{b}"],
    }
    df = spark.createDataFrame(list(cases), "string").select("value", placeholder_set(F.col("value")).alias("p"))
    assert {r["value"]: r["p"] for r in df.collect()} == cases


def test_visible_text_and_depth():
    assert parsed("{n, plural, one {# Fehler} other {# sehr viele}} da")["visible"] == "# sehr viele da"
    deep = "{a, select, x {" * 1000 + "y" + "}}" * 1000
    assert parsed(deep)["blocks"] == [{"type": "select", "keywords": ["x"], "exacts": []}]


def test_check_of_locales(spark):
    source = spark.createDataFrame([("en", "a", 0, "Hi {x}", "string"), ("en", "b", 1, "Bye", "string"), ("en", "n", 2, "null", "null"), ("en", "k", 3, "7", "number")], SEGMENTS)
    target = spark.createDataFrame([("de", "a", 0, "Hallo", "string"), ("de", "n", 1, "null", "null"), ("de", "old", 2, "x", "string"), ("de", "k", 3, "8", "number"), ("xx", "a", 0, "", "string")], SEGMENTS)
    langs = spark.createDataFrame([("de",), ("fr",)], "lang string")
    found = C.check(source, target, langs)
    kinds = sorted((r["lang"], r["kind"], r["key"] or "") for r in found.collect())
    assert kinds == [("de", "error", "a"), ("de", "extra", "old"), ("de", "missing", "b"), ("de", "placeholder", "a"), ("fr", "missing", "a"), ("fr", "missing", "b"), ("fr", "missing", "k"), ("fr", "missing", "n"), ("fr", "missing_file", "")]
    verdicts = {r["lang"]: (r["missing"], r["extra"], r["placeholders"], r["errors"], r["ok"]) for r in C.verdict(found, langs).collect()}
    assert verdicts == {"de": (1, 1, 1, 1, False), "fr": (4, 0, 0, 0, False)}
    clean = C.check(source, source.withColumn("lang", F.lit("de")), langs.where("lang = 'de'"))
    assert C.verdict(clean, langs.where("lang = 'de'"), strict=True).first()["ok"]


def test_locale_findings(spark):
    rows = [("de", "k1", 1, "Cancel", "Abbrechen"), ("de", "k2", 2, "cancel ", "Stornieren"), ("de", "k3", 3, "OK", "In Ordnung bringen"), ("de", "k4", 4, "x", "du dich Sie Ihnen"), ("fr", "k1", 1, "Cancel", "Annuler")]
    found = O.locale_findings(spark.createDataFrame(rows, "lang string, key string, ord long, src string, tgt string")).where("lang = 'de'").orderBy("seq", "rank").collect()
    said = [r["msg"] for r in found]
    assert said[0] == "file mixes informal and formal address (2 informal vs 2 formal markers) — pick one register"
    assert said[1] == 'inconsistent translation of "Cancel" across 2 keys: Abbrechen, Stornieren'
    assert said[3] == "k3: translation +800% vs source (typical +35%) — may overflow UI"


@pytest.mark.parametrize("raw, name, text", [
    (b"\xef\xbb\xbfa", "x", "a"), ("hé".encode("utf-16"), "x", "hé"), ("{\"a\":1}".encode("utf-16-le"), "x", "{\"a\":1}"), ("{\"a\":1}".encode("utf-16-be"), "x", "{\"a\":1}"),
    ("ab".encode("utf-32"), "x", "ab"), ("abcd".encode("utf-32-le"), "x", "abcd"), (b"caf\xe9", "x.properties", "café"), (b"", "x", ""), ("ж".encode(), "x", "ж"),
])
def test_decode(raw, name, text):
    assert decode(raw, name) == text


@pytest.mark.parametrize("raw", [b"caf\xe9", b"a\0b", "привет".encode("cp1251"), b"\xef\xbb\xbf\xff"])
def test_decode_refuses(raw):
    with pytest.raises(UnreadableText):
        decode(raw, "x.json")


def test_documents(spark, tmp_path):
    doc = '{"@@locale": "en", "btn": {"save": "Save", "n": 3}, "l": [1, {"a": 2}], "t": true, "z": null, "hi": "Hi", "hi": "Ho", "@hi": {"description": "d"}}'
    (tmp_path / "a.arb").write_text(doc)
    (tmp_path / "b.arb").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "c.arb").write_text("[1]")
    texts = read_texts(spark, str(tmp_path / "*.arb"))
    rows = S.flatten(texts.where("error IS NULL"))
    assert [r["error"] for r in rows.where("error IS NOT NULL").collect()] == ["the document is not an object"]
    assert texts.where("error IS NOT NULL").count() == 1
    good = S.without_metadata(rows.where("error IS NULL"))
    assert [(r["key"], r["value"], r["vtype"]) for r in good.orderBy("ord").collect()] == [("btn.save", "Save", "string"), ("btn.n", "3", "number"), ("l", '[1, {"a": 2}]', "array"), ("t", "true", "boolean"), ("z", "null", "null"), ("hi", "Ho", "string")]
    document = {"btn": {"save": "Save", "n": 3}, "l": [1, {"a": 2}], "t": True, "z": None, "hi": "Ho"}
    sinks.write_locales(good.select(F.lit(str(tmp_path / "out" / "x.json")).alias("target"), "key", F.struct("ord").alias("place"), "value", "vtype", F.lit(False).alias("flat")))
    assert (tmp_path / "out" / "x.json").read_text() == json.dumps(document, ensure_ascii=False, indent=2) + "\n"
    deep = '{"a":' * 60 + "1" + "}" * 60
    assert S.flatten(spark.createDataFrame([("p", deep), ("q", None)], "path string, text string")).where("error IS NOT NULL").count() == 2


def test_catalog(spark):
    unit = lambda v: {"stringUnit": {"state": "translated", "value": v}}
    doc = {"sourceLanguage": "en", "strings": {
        "own": {}, "skip": {"shouldTranslate": False},
        "%lld items": {"localizations": {"de": {"variations": {"plural": {"one": unit("%lld Ding"), "other": unit("%lld Dinge")}}}, "en": unit("items")}},
        "tap": {"localizations": {"de": {"variations": {"device": {"mac": unit("Klick"), "iphone": unit("Tipp")}}}}},
        "cart": {"localizations": {"de": {"substitutions": {"n": {"variations": {"plural": {"other": unit("%arg")}}}}, "stringUnit": {"value": "  "}}}},
    }}
    rows = S.catalog(spark.createDataFrame([("c", json.dumps(doc)), ("d", "{}")], "path string, text string"))
    assert rows.where("error IS NOT NULL").count() == 1
    got = {(r["lang"], r["key"]): r["value"] for r in rows.where("error IS NULL").collect()}
    assert got == {("en", "own"): "own", ("de", "%lld items⟦plural⟧"): "{count, plural, one {# Ding} other {# Dinge}}", ("en", "%lld items"): "items", ("de", "tap⟦device:mac⟧"): "Klick", ("de", "tap⟦device:iphone⟧"): "Tipp", ("en", "tap"): "tap", ("de", "cart⟦sub:n⟧⟦plural⟧"): "{count, plural, other {#rg}}", ("en", "cart"): "cart"}
    shown = spark.createDataFrame(["cart⟦sub:count⟧⟦plural⟧", "plain", "x⟦device:mac⟧ y"], "string").select(S.shown_key(F.col("value"))).collect()
    assert [r[0] for r in shown] == ["cart (sub count, plural)", "plain", "x (device mac) y"]


def test_target_paths(spark):
    cases = [("locales/en.json", "", "locales/de.json"), ("en.json", "", "de.json"), ("en.json", "out", "out/de.json"), ("l/en/common.json", "", "l/de/common.json"), ("/a/en/x/en/c.json", "", "/a/en/x/de/c.json"), ("l/en/ns/c.json", "out", "out/de/ns/c.json"), ("app_en.arb", "", "app_de.arb"), ("lib/app_en.arb", "o", "o/app_de.arb"), ("l/strings.json", "", "l/de/strings.json"), ("strings.json", "", "de/strings.json"), ("/en.json", "", "/de.json")]
    df = spark.createDataFrame(cases, "p string, o string, want string").select("p", "want", S.target_path(F.col("p"), F.lit("de"), F.col("o"), F.lit("en")).alias("got"))
    for r in df.collect():
        assert r["got"] == r["want"], r


def test_safe_members(spark):
    cases = [("de.json", True), ("a/b.json", True), ("../x", False), ("/etc/x", False), ("C:\\x", False), ("a/../../b", False), ("", False), ("./", False), ("values-de/nested/x.xml", False), ("./a/x.json", True), ("..\\x", False)]
    df = spark.createDataFrame(cases, "n string, ok boolean").select("ok", S.safe_member(F.col("n")).alias("got"))
    assert all(r["ok"] == r["got"] for r in df.collect())


def test_merge_takes_null_values(spark):
    schema = "key string, ord long, value string, vtype string"
    got = K.merged(spark.createDataFrame([("a", 0, "x", "string"), ("b", 1, "y", "string")], schema), spark.createDataFrame([("a", 0, "null", "null"), ("c", 1, "z", "string")], schema)).orderBy("place").collect()
    assert [(r["key"], r["value"]) for r in got] == [("a", "null"), ("b", "y"), ("c", "z")]


def test_settings_and_memory(spark):
    base = I.settings(tone=" formal ", keep="B, A,")
    assert base == {"tone": "formal", "icu": False, "keep": ["A", "B"], "model": "", "app_context": ""}
    assert not I.settings_changed({}, base) and not I.settings_changed(base | {"model": "m"}, base) and I.settings_changed(base, base | {"tone": "x"})
    assert not I.settings_changed({"icu": False}, base) and I.settings_changed(base | {"model": "a"}, base | {"model": "b"})
    seg = "key string, ord long, value string, vtype string"
    source = spark.createDataFrame([("a", 0, "Save", "string"), ("b", 1, "Open", "string"), ("c", 2, "Save", "string")], seg)
    made = spark.createDataFrame([("de", "a", 0, "Sichern", "string"), ("de", "b", 1, "Open", "string"), ("de", "c", 2, "Speichern", "string"), ("fr", "a", 0, " ", "string")], "lang string, " + seg)
    empty = spark.createDataFrame([], "entry_id string, source string, lang string, translated string")
    first = M.recorded(empty, source, made, base)
    assert [(r["source"], r["lang"], r["translated"], r["is_new"]) for r in first.collect()] == [("Save", "de", "Speichern", True)]
    again = M.recorded(first.drop("is_new"), source, made, base)
    assert [r["is_new"] for r in again.collect()] == [False]
    langs = spark.createDataFrame([("de",)], "lang string")
    assert sorted((r["key"], r["translated"]) for r in M.recalled(source, first, langs, base).collect()) == [("a", "Speichern"), ("c", "Speichern")]
    assert M.recalled(source, first, langs, base | {"tone": "x"}).count() == 0


def test_sarif(spark, tmp_path):
    found = spark.createDataFrame([("extra", "de", "menu.save", None, "de.json"), ("missing", "de", "menu.open", None, "de.json"), ("warning", "de", "nowhere", "m", "de.json")], "kind string, lang string, key string, text string, path string")
    lines = sinks.key_lines(spark.createDataFrame([("de.json", '{\n "menu": {\n  "save": "x"\n }\n}')], "path string, text string"))
    doc = json.loads(sinks.sarif_document(sinks.sarif_results(found, lines)))
    got = [(r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in doc["runs"][0]["results"]]
    assert sorted(got) == [("extra-key", "note", 3), ("missing-key", "error", 1), ("translation-warning", "warning", 1)]
    sinks.write_whole(str(tmp_path / "d" / "x.sarif"), json.dumps(doc))
    assert json.loads((tmp_path / "d" / "x.sarif").read_text()) == doc


def test_volumes(spark):
    df = spark.createDataFrame([(29_786_587, "29.7M"), (45_600, "45k"), (-5, "0"), (999, "999"), (2_000_000, "2M")], "n long, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", short_count(F.col("n")).alias("got")).collect())
    levels = spark.createDataFrame([(79, 100, "ok"), (80, 100, "warn"), (95, 100, "crit"), (5, 0, None)], "u long, c long, want string")
    assert all(r["want"] == r["got"] for r in levels.select("want", quota_level(F.col("u"), F.col("c")).alias("got")).collect())


def test_stream(spark, tmp_path):
    from lokalens.streaming.check_stream import stream_findings

    spark.createDataFrame([("de", "a", 1, "Hi {x}", "Hallo")], "lang string, key string, ord long, src string, tgt string").write.parquet(str(tmp_path / "in"))
    schema = "lang string, key string, ord long, src string, tgt string"
    stream_findings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["msg"] for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()] == ["lost placeholder {x}"]
