"""Many sources in one check, documents written by executors, and the incremental run over files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lokalens.functions import paths as A
from lokalens.operators import incremental as I
from lokalens.plans import projects as R
from lokalens.plans import runs as U
from lokalens.sources import documents as D


def put(at, document):
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(document, ensure_ascii=False, indent=2) + "\n")


def named(df):
    return sorted(r["file"].rsplit("/", 1)[1] for r in df.collect())


def test_sources(spark, tmp_path):
    for name in ("a.json", "b.json", "c.arb", "[x].json", "folder.json/d.json"):
        put(tmp_path / name, {})
    at = lambda *x: [str(tmp_path / n) for n in x]
    assert named(R.resolve_sources(spark, at("*.json", "a.json", "b.json", "none.json", "x/*.json", " "))) == ["[x].json", "a.json", "b.json"]
    assert named(R.resolve_sources(spark, at("[x].json", "{a,b}.json"))) == ["[x].json"]
    assert named(R.resolve_sources(spark, at("?.arb", "[ab].json"))) == ["a.json", "b.json", "c.arb"]
    assert R.one_source(spark, at("[ab].json")[0]) == (f"file:{tmp_path}/a.json", 1)
    assert R.one_source(spark, at("none*.json")[0]) == (None, 0)


def test_many_sources_in_one_scan(spark, tmp_path):
    langs, want = [f"l{i}" for i in range(6)], set()
    for i in range(30):
        put(tmp_path / f"loc/en/n{i}.json", {"a": "Hi {x}", "b": {"c": "Bye"}})
        for k, lang in enumerate(langs):
            path = f"n{i}.json"
            if (i + k) % 5 == 0:
                want |= {("missing_file", path, lang, None), ("missing", path, lang, "a"), ("missing", path, lang, "b.c")}
                continue
            put(tmp_path / f"loc/{lang}/n{i}.json", {"a": "Ho" if k == 3 else "Ho {x}", "b": {"c": "Tschau"}, **({"z": 1} if k == 4 else {})})
            want |= {("placeholder", path, lang, "a"), ("error", path, lang, "a")} if k == 3 else {("extra", path, lang, "z")} if k == 4 else set()
    put(tmp_path / "loc/l0/other.json", {"not": "asked for"})
    put(tmp_path / "app/[locale]/en.json", {"k": "Save"})
    put(tmp_path / "app/[locale]/l1.json", {})
    (tmp_path / "app/[locale]/l2.json").write_text("[]")
    (tmp_path / "app/[locale]/l3.json").write_bytes(b"\xff\xfe\xff")
    want |= {("missing", "en.json", x, "k") for x in langs} | {("missing_file", "en.json", x, None) for x in langs if x != "l1"}
    found, project = R.check_sources(spark, [str(tmp_path / "loc/en/*.json"), str(tmp_path / "app/[locale]/en.json")], langs)
    assert {(r["kind"], r["file"].rsplit("/", 1)[1], r["lang"], r["key"]) for r in found.where("kind <> 'warning'").collect()} == want
    assert {r["lang"] for r in project.problems.collect()} == {"l2", "l3"}
    assert R._globs(project.files) and len(R._globs(project.files)) <= 2 * len(langs) + 1
    with pytest.raises(ValueError):
        U.open_run(spark, str(tmp_path), str(tmp_path / "app/[locale]/l2.json"), ["de"])


def random_document(rng, depth=0):
    out = {}
    for _ in range(rng.randint(1, 4)):
        key = rng.choice(["a", "b", "c", "d é", 'q"', "x\\y"])
        out[key] = random_document(rng, depth + 1) if depth < 4 and rng.random() < 0.5 else rng.choice(["text", "", "日本\n\t", 5, 1.5, True, None, [], [1, {"a": [2]}]])
    return out


def test_documents_are_written_as_json_has_them(spark, tmp_path):
    rng = random.Random(3)
    documents = {f"{tmp_path}/out/{i}.json": random_document(rng) for i in range(40)}
    rows, place = [], 0
    for target, document in documents.items():
        todo = [([], document)]
        while todo:
            names, value = todo.pop(0)
            if isinstance(value, dict):
                todo = [(names + [k], v) for k, v in value.items()] + todo
            else:
                place += 1
                rows.append((target, ".".join(names), (place,), value if isinstance(value, str) else json.dumps(value), "string" if isinstance(value, str) else "other", False))
    rng.shuffle(rows)
    segments = spark.createDataFrame(rows, "target string, key string, place struct<ord:long>, value string, vtype string, flat boolean").repartition(5)
    D.put(D.placed(segments, ["target"]))
    for target, document in documents.items():
        with open(target) as f:
            assert f.read() == json.dumps(document, ensure_ascii=False, indent=2) + "\n"
    assert not list((tmp_path / "out").glob(".*"))


@pytest.mark.parametrize("flat", [False, True])
def test_leaves_and_branches_of_one_name(spark, tmp_path, flat):
    keys = ["a", "b.x", "a.c", "d.e.f", "b.y", "d.e", "d.g"]
    rows = [(str(tmp_path / "x.json"), k, (i,), str(i), "string", flat) for i, k in enumerate(keys)]
    D.put(D.placed(spark.createDataFrame(rows, "target string, key string, place struct<ord:long>, value string, vtype string, flat boolean"), ["target"]))
    want = {k: str(i) for i, k in enumerate(keys)} if flat else {"a": {"c": "2"}, "b": {"x": "1", "y": "4"}, "d": {"e": "5", "g": "6"}}
    assert (tmp_path / "x.json").read_text() == json.dumps(want, indent=2) + "\n"


class Stopped(Exception):
    pass


def test_a_commit_that_stops_anywhere_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    replace, files = D.Files.replace, [f"{x}.json" for x in "abc"]
    for stop in range(5):  # the manifest, then three files
        home = tmp_path / str(stop)
        for name in files:
            put(home / name, {"k": "old"})
        rows = [(str(home / name), ["k"], [0], f'"new {name}"') for name in files]
        moves = D.stage(spark.createDataFrame(rows, "target string, names array<string>, place array<int>, json string"), str(home))
        done = []

        def counted(self, source, target, stop=stop, done=done):
            if len(done) == stop:
                raise Stopped
            done.append(target)
            replace(self, source, target)

        monkeypatch.setattr(D.Files, "replace", counted)
        if stop < 4:
            with pytest.raises(Stopped):
                D.commit(spark, str(home), moves)
        else:
            D.commit(spark, str(home), moves)
        monkeypatch.setattr(D.Files, "replace", replace)
        assert D.finish(spark, str(home)) == (0 if stop in (0, 4) else 4 - stop)
        assert {n: json.loads((home / n).read_text())["k"] for n in files} == {n: "old" if stop == 0 else f"new {n}" for n in files}
        assert D.finish(spark, str(home)) == 0 and not (home / D.MANIFEST).exists()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_run_over_files(spark, tmp_path, monkeypatch):
    of = I.settings(tone="formal")
    put(tmp_path / "en/a.json", {"hi": "Hello", "menu": {"open": "Open", "n": 3}, "bye": "Bye"})
    put(tmp_path / "de/a.json", {"menu": {"open": "Öffnen", "n": 4}, "hi": "Hallo"})
    put(tmp_path / "en/a.json.lock", {"version": 4, "settings": of, "keys": {"hi": sha("Hello")}, "langs": {"de": {"hi": sha("Hi"), "menu.open": sha("Open")}}})
    put(tmp_path / "l10n/app_en.arb", {"@@locale": "en", "save": "Save", "@save": {"description": "x"}})
    put(tmp_path / "l10n/app_de.arb", {"@@locale": "xx", "@old": {"description": "stays"}})
    specs = [str(tmp_path / "en/*.json"), str(tmp_path / "l10n/app_en.arb")]
    run = U.open_run(spark, str(tmp_path), specs, ["de", "fr"], of)
    due = {(r["file"].rsplit("/", 1)[1], r["lang"], r["key"]): r["reason"] for r in run.work().collect()}
    assert due == {("a.json", "de", "hi"): "changed", ("a.json", "de", "bye"): "missing", **{("a.json", "fr", k): "missing" for k in ("hi", "menu.open", "bye")}, ("app_en.arb", "de", "save"): "missing", ("app_en.arb", "fr", "save"): "missing"}
    counts = {(r["file"].rsplit("/", 1)[1], r["lang"]): (r["new"], r["edited"], r["from_memory"], r["unverified"]) for r in run.counts().collect()}
    assert counts == {("a.json", "de"): (1, 1, 0, 0), ("a.json", "fr"): (3, 0, 0, 0), ("app_en.arb", "de"): (1, 0, 0, 0), ("app_en.arb", "fr"): (1, 0, 0, 0)}
    made = run.work().select("file", "lang", "key", F.concat("lang", F.lit(" "), "text").alias("value"))
    failed = run.source.where("file LIKE '%a.json'").select("file", F.lit("fr").alias("lang")).distinct()
    replace, moved = D.Files.replace, []

    def stops(self, source, target):
        moved.append(target)
        if len(moved) == 3:
            raise Stopped
        replace(self, source, target)

    monkeypatch.setattr(D.Files, "replace", stops)
    with pytest.raises(Stopped):
        U.close_run(run, made, failed)
    monkeypatch.setattr(D.Files, "replace", replace)
    again = U.open_run(spark, str(tmp_path), specs, ["de", "fr"], of)  # finishes what was stopped
    assert (tmp_path / "de/a.json").read_text() == json.dumps({"menu": {"open": "Öffnen", "n": 4}, "hi": "de Hello", "bye": "de Bye"}, ensure_ascii=False, indent=2) + "\n"
    assert json.loads((tmp_path / "l10n/app_de.arb").read_text()) == {"@@locale": "de", "@old": {"description": "stays"}, "save": "de Save"}
    assert (tmp_path / "l10n/app_fr.arb").read_text() == json.dumps({"save": "fr Save", "@@locale": "fr"}, indent=2) + "\n"
    assert not (tmp_path / "fr").exists() and not list(tmp_path.glob(".lokalens*"))
    lock = json.loads((tmp_path / "en/a.json.lock").read_text())
    assert lock["langs"] == {"de": {"bye": sha("Bye"), "hi": sha("Hello"), "menu.open": sha("Open")}, "fr": {"hi": sha("Hello")}} and lock["keys"] == {"hi": sha("Hello")} and lock["settings"] == of
    memory = json.loads((tmp_path / "lokalens-memory.json").read_text())["entries"]
    assert sorted((e["source"], e.get("de"), e.get("fr")) for e in memory.values()) == [("Bye", "de Bye", None), ("Hello", "de Hello", None), ("Save", "de Save", "fr Save")]
    assert {(r["lang"], r["key"]) for r in again.work().collect()} == {("fr", k) for k in ("hi", "menu.open", "bye")}
    # the same text under another key comes from the memory; other settings make all due, and stay unrecorded while a string lacks
    put(tmp_path / "en/b.json", {"greeting": "Hello"})
    third = U.open_run(spark, str(tmp_path), [str(tmp_path / "en/b.json")], ["de"], of)
    assert [(r["key"], r["translated"]) for r in third.work().collect()] == [("greeting", "de Hello")]
    other = U.open_run(spark, str(tmp_path), specs, ["de"], I.settings(tone="casual"))
    work = other.work().select("file", "lang", "key", F.lit("neu").alias("value"))
    assert work.count() == 5
    U.close_run(other, work.where("key <> 'bye'"))
    assert json.loads((tmp_path / "en/a.json.lock").read_text())["settings"] == of
    assert json.loads((tmp_path / "l10n/app_en.arb.lock").read_text())["settings"] == I.settings(tone="casual")


def test_paths(spark):
    rows = [("/a/b/../c", "/a/x", "../c"), ("a/./b", "a/b", "."), ("C:\\a\\b", "C:/a", "b"), ("D:/a", "C:/a", "D:/a"), ("file:/a/b", "file:///a", "b"), ("/a", "b", "/a"), ("../x", "../y/z", "../../x"), ("s3://k/a/b", "s3://k/a/c", "../b"), ("s3://k/a", "s3://l/a", "s3://k/a")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert [r["got"] for r in df.select(A.relative(F.col("a"), F.col("b")).alias("got")).collect()] == [w for _, _, w in rows]
    urls = {"x.y/": "https://x.y", "http://127.0.0.1:80": "http://127.0.0.1:80", "http://127.evil.com": None, "http://[::1]": "http://[::1]", "http://localhost@evil.com": None, "": None, "ftp://localhost": None}
    got = {r["u"]: r["s"]["url"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", A.service_url(F.col("u")).alias("s")).collect()}
    assert got == urls


def test_leaves_are_made_once_where_their_documents_are_known(spark, tmp_path):
    """Naming the documents took a pass of its own over all leaves; an inner branch, a leaf that a branch replaces and one that replaces a branch keep their places."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    at = str(tmp_path / "a.json")
    rows = [(at, k, i, str(i), "number", False) for i, k in enumerate(["x.a.b", "y", "x.c", "y.d.e", "x.a.f", "z.g", "z"])]
    segments = spark.createDataFrame(rows, "target string, key string, place long, value string, vtype string, flat boolean")
    leaves = D.placed(segments, ["target"]).withColumn("json", seen.asNondeterministic()("json"))
    D.put(leaves, segments.select("target"))
    assert made.value == 5
    with open(at) as f:
        text = f.read()
    assert json.loads(text) == {"x": {"a": {"b": 0, "f": 4}, "c": 2}, "y": {"d": {"e": 3}}, "z": 6}
    assert [x.strip()[1] for x in text.splitlines() if '"' in x] == list("xabfcydez")


def test_a_run_names_its_documents_without_making_them(spark, tmp_path, monkeypatch):
    """Names of locales, locks and the memory come from tables that are there; the leaves, and the joins under them, are made once."""
    for lang, texts in (("en", {"hi": "Hello", "menu": {"open": "Open"}}), ("de", {"old": "alt"})):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "a.json").write_text(json.dumps(texts))
    stage, plans = D.stage, []

    def watched(rows, near=None, targets=None):
        plans.append([x if x is None else x._jdf.queryExecution().executedPlan().toString() for x in (targets, rows.select("target").distinct())])
        return stage(rows, near, targets)

    monkeypatch.setattr(D, "stage", watched)
    run = U.open_run(spark, str(tmp_path), str(tmp_path / "en/a.json"), ["de"])
    U.close_run(run, run.work().select("file", "lang", "key", F.concat(F.lit("de "), "text").alias("value")))
    assert len(plans) == 3
    assert all(named and "Join" not in named for named, _ in plans)
    assert json.loads((tmp_path / "de/a.json").read_text()) == {"old": "alt", "hi": "de Hello", "menu.open": "de Open"}
    assert list(json.loads((tmp_path / "de/a.json").read_text())) == ["old", "hi", "menu.open"]
