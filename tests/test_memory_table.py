"""A memory as a bucketed table: the same as the one in a document, never shuffled, written anew where it is touched."""

import re
import uuid

import pytest

from lokalens.operators import findings as O
from lokalens.operators import incremental as I
from lokalens.operators import memory as M
from lokalens.sources import documents
from lokalens.sources import memory_table as T
from lokalens.sources import segments as S
from lokalens.staging import staged

OF = I.settings(tone="formal")
ROWS = "lang string, key string, ord long, value string, vtype string"
MEMORY = "entry_id string, source string, lang string, translated string"


@pytest.fixture
def name(spark):
    name = f"memory_{uuid.uuid4().hex}"
    T.create(spark, name, digits=1, buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def strings(spark, rows):
    return spark.createDataFrame([(lang, key, i, value, "string") for i, (lang, key, value) in enumerate(rows)], ROWS)


def source_of(spark, n):
    return strings(spark, [("en", f"k{i}", f"text {i % (n // 2)}") for i in range(n)]).drop("lang")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_same_as_in_a_document(spark, name):
    source = source_of(spark, 60)
    runs = [
        [("de", f"k{i}", f"Text {i}") for i in range(40)],
        [("fr", "k1", "un"), ("fr", "k1", "deux"), ("de", "k2", "anders"), ("de", "k3", "  "), ("de", "k4", "text 4"), ("de", "gone", "x"), ("it", "k59", "è")],
        [("fr", "k1", "deux")],
    ]
    memory = spark.createDataFrame([], MEMORY)
    for i, made in enumerate(runs):
        made = strings(spark, made)
        want = M.recorded(memory, source, made, OF)
        counts = T.recorded(spark, name, source, made, OF)
        assert counts["pairs_added"] + counts["pairs_changed"] == want.where("is_new").count()
        assert counts["pairs_same"] == (1 if i == 2 else 0)
        memory = spark.createDataFrame(want.drop("is_new").collect(), MEMORY)
        assert rows(T.pairs(spark, name)) == rows(memory)
    for langs in (["de", "fr", "ja"], ["it"], []):
        langs = spark.createDataFrame([(x,) for x in langs], "lang string")
        assert rows(T.recalled(spark, name, source, langs, OF)) == rows(M.recalled(source, memory, langs, OF))


def test_only_touched_folders_are_written(spark, name):
    source = source_of(spark, 80)
    T.recorded(spark, name, source, strings(spark, [("de", f"k{i}", f"T {i}") for i in range(40)]), OF)
    before, rows_before = T._generations(spark, name), rows(T.pairs(spark, name))
    assert T.recorded(spark, name, source, strings(spark, [("fr", "k7", "sept")]), OF) == {"entries_added": 0, "pairs_added": 1, "pairs_changed": 0, "pairs_same": 0}
    after = T._generations(spark, name)
    assert before.keys() == after.keys() and sum(before[p] != after[p] for p in before) == 1
    assert T.recorded(spark, name, source, strings(spark, [("fr", "k7", "")]), OF) == dict.fromkeys(T.COUNTS, 0) and T._generations(spark, name) == after
    assert T.vacuum(spark, name) == 1 and T.vacuum(spark, name) == 0
    assert len(T.pairs(spark, name).collect()) == len(rows_before) + 1


def test_a_run_that_stops_leaves_the_memory(spark, name, monkeypatch):
    source = source_of(spark, 20)
    T.recorded(spark, name, source, strings(spark, [("de", "k1", "eins")]), OF)
    before = rows(T.pairs(spark, name))
    real = spark.sql

    def stops(text, *a, **k):
        if "SET TBLPROPERTIES" in text:
            raise RuntimeError("stopped")
        return real(text, *a, **k)

    monkeypatch.setattr(spark, "sql", stops)
    with pytest.raises(RuntimeError):
        T.recorded(spark, name, source, strings(spark, [("de", "k1", "uno"), ("de", "k2", "zwei")]), OF)
    monkeypatch.undo()
    assert rows(T.pairs(spark, name)) == before and T.vacuum(spark, name) >= 1
    T.recorded(spark, name, source, strings(spark, [("de", "k1", "uno"), ("de", "k2", "zwei")]), OF)
    assert {r[3] for r in rows(T.pairs(spark, name))} == {"uno", "zwei"}


def test_the_memory_is_not_shuffled(spark, name, monkeypatch):
    """Looking up and recording move what is asked to the memory's buckets, not the memory, whatever the number of shuffle partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    plans = []

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, label)

    classic = type(spark.range(1))
    put = classic.observe
    monkeypatch.setattr(T, "staged", watched)
    monkeypatch.setattr(classic, "observe", lambda df, *a: plans.append(("written", df._jdf.queryExecution().executedPlan().toString())) or put(df, *a))
    try:
        source = source_of(spark, 40)
        made = strings(spark, [("de", f"k{i}", f"T {i}") for i in range(20)])
        T.recorded(spark, name, source, made, OF)
        T.recorded(spark, name, source, made, OF)
        T.recalled(spark, name, source, spark.createDataFrame([("de",)], "lang string"), OF).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    read = [(label, plan) for label, plan in plans if "SelectedBucketsCount: 4 out of 4" in plan]
    assert [label for label, _ in read] == ["written", "known"]
    for _, plan in read:
        moved = re.findall(r"Exchange hashpartitioning\(entry_id#\d+, (\d+)\)", plan)
        assert moved == ["4"], plan  # only what is put in or asked for


def test_import_and_limits(spark, name):
    given = [("ab", "Save", "de", "Sichern"), ("ab", "Save", "de", "Aichern"), ("ab", "Save", "fr", None), ("cd", None, "fr", "x")]
    assert T.imported(spark, name, spark.createDataFrame(given, MEMORY))["entries_added"] == 2
    assert rows(T.pairs(spark, name)) == [("ab", "Save", "de", "Sichern"), ("cd", None, "fr", "x")]
    with pytest.raises(ValueError):
        T.create(spark, "other", digits=3)


def test_absent_terms_and_styles(spark):
    source = strings(spark, [("en", "a", "Use STEEL now"), ("en", "b", None)]).drop("lang")
    terms = lambda of, *t: [r["term"] for r in O.absent_terms(of, list(t)).collect()]
    assert terms(source, "steel", " Brass ", "", "b_ss", "Brass") == ["Brass", "b_ss"] and terms(source) == []
    assert terms(source.limit(0), "x", "y") == ["x", "y"]
    texts = spark.createDataFrame([("flat", '{"a.b": "x", "c": [{}]}'), ("nested", '{"a": {"b": "x"}, "c.d": "y"}')], "path string, text string")
    assert {r["path"]: r["flat"] for r in documents.styles(S.flatten(texts), ["path"]).collect()} == {"flat": True, "nested": False}


def test_a_memory_that_grows_is_dealt_to_more_buckets(spark, name, monkeypatch):
    """No bucket outgrows its bound, counts and rows are those of a memory that was never dealt anew, and a stop before the end leaves the memory."""
    monkeypatch.setattr(T, "BUCKET_BYTES", 800)
    source, other = source_of(spark, 400), f"{name}_plain"
    T.create(spark, other, digits=1, buckets=4)
    runs = [[("de", f"k{i}", f"Text {i}") for i in range(lo, hi)] for lo, hi in ((0, 40), (20, 200), (0, 1))]
    numbers = []
    for made in runs:
        counts = T.recorded(spark, name, source, strings(spark, made), OF)
        with monkeypatch.context() as m:
            m.setattr(T, "BUCKET_BYTES", 1 << 30)
            assert T.recorded(spark, other, source, strings(spark, made), OF) == counts
        assert rows(T.pairs(spark, name)) == rows(T.pairs(spark, other))
        numbers.append(int(T._property(spark, name, T._BUCKETS)))
        in_bucket = T.entries(spark, name).selectExpr(f"pmod(hash(entry_id), {numbers[-1]}) AS b", "length(source) + length(texts['de']) AS n").groupBy("b").sum("n")
        assert max(r[1] for r in in_bucket.collect()) <= 800
    assert 4 == numbers[0] < numbers[1] == numbers[2] and T._property(spark, other, T._BUCKETS) == "4"
    langs = spark.createDataFrame([("de",)], "lang string")
    assert rows(T.recalled(spark, name, source, langs, OF)) == rows(T.recalled(spark, other, source, langs, OF))
    before = rows(T.pairs(spark, name))
    assert T.vacuum(spark, name) > 0 and T.vacuum(spark, name) == 0 and rows(T.pairs(spark, name)) == before
    real = spark.sql

    def stops(text, *a, **k):
        if "SET TBLPROPERTIES" in text:
            raise RuntimeError("stopped")
        return real(text, *a, **k)

    monkeypatch.setattr(T, "BUCKET_BYTES", 100)
    monkeypatch.setattr(spark, "sql", stops)
    with pytest.raises(RuntimeError):
        T.recorded(spark, name, source, strings(spark, [("fr", "k1", "un")]), OF)
    monkeypatch.undo()
    assert rows(T.pairs(spark, name)) == before and len(T._beside(spark, name)) == 2
    T.vacuum(spark, name)
    assert rows(T.pairs(spark, name)) == before and len(T._beside(spark, name)) == 1
    T.drop(spark, other)
    for table in T._beside(spark, name):
        spark.sql(f"DROP TABLE {table}")


def test_languages_do_not_deal_the_memory(spark, name, monkeypatch):
    """What is found for a language is not brought to one task for it, also where nothing is broadcast of itself."""
    source, plans = source_of(spark, 40), []
    T.recorded(spark, name, source, strings(spark, [("de", f"k{i}", f"T {i}") for i in range(20)]), OF)
    monkeypatch.setattr(T, "staged", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        T.recalled(spark, name, source, spark.createDataFrame([("de",)], "lang string"), OF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    known = plans[-1]
    joined = [x for x in known.splitlines() if "Join" in x and "lang#" in x]
    assert joined and all("BroadcastHashJoin" in x for x in joined), known
