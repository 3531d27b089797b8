"""Locks and memories as documents, and an incremental run from end to end."""

import hashlib
import json

import pytest

from lokalens.operators import incremental as I
from lokalens.operators import memory as M
from lokalens.plans import incremental as P
from lokalens.sources import stores

SEG = "key string, ord long, value string, vtype string"
LOCK = "lang string, key string, hash string"
MEMORY = "entry_id string, source string, lang string, translated string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def segments(spark, texts, lang=None):
    rows = [(k, i, v, "string") for i, (k, v) in enumerate(texts.items())]
    return spark.createDataFrame([(lang, *r) for r in rows], "lang string, " + SEG) if lang else spark.createDataFrame(rows, SEG)


def held(df):
    return {(r["lang"], r["key"]): r["hash"] for r in df.collect()}


@pytest.mark.parametrize("text, rows, settings", [
    ('{"a": "1", "b": 2, "c": null, "d": {"x": "y"}}', {(None, "a"): "1"}, None),
    ('{"version": 3, "settings": {"tone": "x"}, "keys": {"a": "1"}, "langs": {"de": {"a": "2", "b": "3"}, "fr": 5}}', {(None, "a"): "1", ("de", "a"): "2", ("de", "b"): "3"}, {"tone": "x"}),
    ('{"version": 1, "keys": {"a": "1"}}', {(None, "a"): "1"}, None),
    ('{"version": 1}', {}, None), ("[1]", {}, None), ('{"a"', {}, None), ("", {}, None), (None, {}, None),
])
def test_lock_documents(spark, text, rows, settings):
    assert held(stores.lock_rows(spark.createDataFrame([("p", text)], "path string, text string"))) == rows
    assert stores.lock_settings(text) == settings


def test_documents_round_trip(spark, tmp_path):
    rows = {(None, "b"): "1", (None, 'a "q"'): "2", ("de", "é"): "3", ("fr", "b"): "4"}
    lock = spark.createDataFrame([(*k, v) for k, v in rows.items()], LOCK)
    for df, want in ((lock, rows), (lock.limit(0), {})):
        stores.write_lock(str(tmp_path / "x.lock"), df, {"tone": "formal"})
        text = (tmp_path / "x.lock").read_text()
        doc = json.loads(text)
        assert doc["settings"] == {"tone": "formal"} and list(doc) == sorted(doc) and list(doc["keys"]) == sorted(doc["keys"])
        assert held(stores.lock_rows(spark.createDataFrame([("p", text)], "path string, text string"))) == want
    memory = [("e1", "Save", "de", 'Sichern "x"'), ("e1", "Save", "fr", "Garder"), ("e0", "[1]", "de", "x")]
    stores.write_memory(str(tmp_path / "m.json"), spark.createDataFrame(memory, MEMORY))
    text = (tmp_path / "m.json").read_text()
    assert json.loads(text) == {"version": 1, "entries": {"e0": {"source": "[1]", "de": "x"}, "e1": {"source": "Save", "de": 'Sichern "x"', "fr": "Garder"}}}
    assert stores.memory_rows(spark.createDataFrame([("p", '{"entries": [1]}'), ("q", "{"), ("r", None)], "path string, text string")).count() == 0
    assert stores.beside("a/b/en.json", "x.lock") == "a/b/x.lock" and stores.beside("en.json", "x.lock") == "x.lock"


def test_languages_are_planned_apart(spark):
    """A run for German alone must not mark an edit as done for French."""
    v1, v2 = {"a": "Save", "b": "Open"}, {"a": "Save all", "b": "Open", "c": "New"}
    langs = lambda *x: spark.createDataFrame([(i,) for i in x], "lang string")
    targets = segments(spark, {"a": "Sichern", "b": "Öffnen"}, "de").unionByName(segments(spark, {"a": "Garder", "b": "Ouvrir"}, "fr"))
    lock = spark.createDataFrame([(None, k, sha(v)) for k, v in v1.items()], LOCK)
    source, none = segments(spark, v2), spark.createDataFrame([], "lang string")
    found = P.judged(source, targets, lock, langs("de"))
    assert {(r["key"], r["reason"]) for r in found.collect()} == {("a", "changed"), ("c", "missing")}
    after = P.finished(source, lock, langs("de"), found, none)
    assert held(after) == {("de", k): sha(v) for k, v in v2.items()} | {(None, k): sha(v) for k, v in v2.items()}
    french = P.judged(source, targets, lock.unionByName(after.where("lang = 'de'")), langs("fr"))
    assert {(r["key"], r["reason"]) for r in french.collect()} == {("a", "changed"), ("c", "missing")}
    failed = held(P.finished(source, lock, langs("de", "fr"), P.judged(source, targets, lock, langs("de", "fr")), langs("fr")))
    assert failed[("de", "a")] == sha("Save all") and failed[("fr", "a")] == sha("Save") and ("fr", "c") not in failed
    assert failed[(None, "a")] == sha("Save") and failed[(None, "b")] == sha("Open") and (None, "c") not in failed


def test_unverified_settings_and_memory(spark):
    source, langs = segments(spark, {"a": "Save", "b": "Open", "c": "Save"}), spark.createDataFrame([("de",)], "lang string")
    targets, empty = segments(spark, {"a": "Sichern", "b": "Auf"}, "de"), spark.createDataFrame([], LOCK)
    none = spark.createDataFrame([], "lang string")
    found = P.judged(source, targets, empty, langs)
    assert {(r["key"], r["reason"]) for r in found.collect()} == {("a", "unverified"), ("b", "unverified"), ("c", "missing")}
    assert set(held(P.finished(source, empty, langs, found, none))) == {("de", "c"), (None, "c")}
    assert set(held(P.finished(source, empty, langs, found, none, assume_current=True))) == {(x, k) for x in ("de", None) for k in "abc"}
    anew = P.judged(source, targets, empty, langs, all_anew=True)
    assert P.todo(anew).count() == 3
    of = I.settings(tone="formal")
    memory = M.recorded(spark.createDataFrame([], MEMORY), source, segments(spark, {"a": "Sichern"}, "de"), of)
    assert [(r["lang"], r["key"], r["translated"]) for r in P.reused(source, found, memory, of).collect()] == [("de", "c", "Sichern")]
    assert P.final_settings({"tone": "x"}, of, True) == {"tone": "x"} and P.final_settings({"tone": "x"}, of, False) == of and P.final_settings(None, of, True) == of


def test_a_neutral_tone_is_none():
    assert I.settings(tone="neutral") == I.settings() and I.settings(tone=" formal ")["tone"] == "formal"
    assert not I.settings_changed(I.settings(), I.settings(tone="neutral"))
