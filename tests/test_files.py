"""The check of files on disk, its report and its exit code."""

import json

import pytest

from lokalens.__main__ import main
from lokalens.plans import projects as R
from lokalens.plans.files import check_files, config, report


def test_files(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "en.json").write_text(json.dumps({"a": "Hi {x}", "menu": {"b": "Bye"}, "n": 5}))
    (tmp_path / "de.json").write_text(json.dumps({"a": "Hallo", "menu": {"old": "x"}, "n": 6}), encoding="utf-16")
    (tmp_path / "es.json").write_text(json.dumps({"a": "Hola {x}", "menu": {"b": "Chao"}, "n": 5}))
    source = str(tmp_path / "en.json")
    found, project = check_files(spark, source, ["de", "es", "fr"])
    assert {r["path"] for r in project.files.where("lang = 'fr'").collect()} == {f"file:{tmp_path}/fr.json"}
    lines = ["de: 1 missing key(s): menu.b", "de: 1 placeholder mismatch(es):", "    a: missing {x}", "de: 1 translation fault(s):", "    a: lost placeholder {x}", "de: 1 extra/stale key(s): menu.old", "es: complete & placeholder-safe", f"fr: locale file not found (file:{tmp_path}/fr.json)"]
    assert list(report(found, project)) == lines
    sarif = tmp_path / "out" / "r.sarif"
    monkeypatch.setattr(R, "working_folder", lambda _: f"file:{tmp_path}/out")
    assert main(["--source", source, "--langs", "de", "--sarif", str(sarif)]) == 1
    results = json.loads(sarif.read_text())["runs"][0]["results"]
    assert sorted(r["ruleId"] for r in results) == ["extra-key", "missing-key", "placeholder", "translation-fault"]
    assert {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results} == {"../de.json"}
    capsys.readouterr()
    assert main(["--source", source, "--langs", "de,es,fr", "--json"]) == 1
    assert json.loads(capsys.readouterr().out) == {
        "ok": False, "missing": {"de": ["menu.b"], "fr": ["a", "menu.b", "n"]}, "extra": {"de": ["menu.old"]}, "placeholder_issues": [{"lang": "de", "key": "a", "missing": ["{x}"], "added": []}],
        "missing_files": ["fr"], "faults": [{"lang": "de", "key": "a", "severity": "error", "msg": "lost placeholder {x}"}], "warnings": [],
    }
    assert main(["--source", str(tmp_path / "none.json"), "--langs", "de"]) == 2


def test_catalog_file(spark, tmp_path):
    doc = {"sourceLanguage": "en", "strings": {"Save %@": {}, "Open": {"localizations": {"de": {"stringUnit": {"value": "Öffnen"}}}}}}
    (tmp_path / "a.xcstrings").write_text(json.dumps(doc))
    found, _ = check_files(spark, str(tmp_path / "a.xcstrings"), ["de", "fr"])
    assert {(r["kind"], r["lang"], r["key"]) for r in found.collect()} == {("missing", "de", "Save %@"), ("missing", "fr", "Save %@"), ("missing", "fr", "Open"), ("missing_file", "fr", None)}
    (tmp_path / "b.xcstrings").write_text("{}")
    with pytest.raises(ValueError):
        check_files(spark, str(tmp_path / "b.xcstrings"), ["de"])


def test_config():
    c = config('{"source": "a.json", "// note": 1, "_x": 2, "tone": "formal"}', langs=["ja"], tone=None)
    assert (c["source"], c["tone"], c["langs"], c["icu"]) == ("a.json", "formal", ["ja"], False) and "_x" not in c and "// note" not in c
    assert config(None)["source"] == "locales/en.json" and config(None, "next-intl")["icu"] and config('{"source": "x"}', "next-intl")["source"] == "x"
    assert config(None, context="  " + "c" * 400)["context"] == "c" * 300
