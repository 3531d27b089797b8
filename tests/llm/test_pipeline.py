"""The pipeline's stages, each against a brute-force version on its own input."""

import numpy as np
import public_tokenizers
from test_llm import DATA, slow_groups, slow_lines
from tokenizers import Tokenizer

import corpus_pipeline
from lokalens.llm.common import materialize, table


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, DATA), name)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, rows = seen["language"]
    assert {r["doc_id"] for r in rows} == {d for d, t in before.items() if any(c.isalpha() for c in t)}
    before, rows = seen["lines"]
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((d, t) for d, _, _, t in slow_lines(list(before.items())))
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    before, rows = seen["near_copies"]
    groups = slow_groups(list(before.items()))
    assert {r["doc_id"] for r in rows} == {d for d, (_, g) in groups.items() if d == g}
    before, rows = seen["benchmark"]
    items = [" ".join(r["text"].lower().split()) for r in table(spark, DATA, "benchmark").collect()]
    verbatim = {d for d, t in before.items() if any(i in " ".join(t.lower().split()) for i in items)}
    gone = set(before) - {r["doc_id"] for r in rows}
    assert verbatim <= gone and len(gone) <= len(verbatim) + 3
    before, rows = seen["packing"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in rows) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
    assert np.all([r["length"] & (r["length"] - 1) == 0 for r in rows])


def test_junk_goes_and_empty_tables_stand(spark):
    schema = table(spark, DATA, "documents").schema
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 19), (2, "### 123 !!", None, "s", 10), (3, None, "en", "s", 0), (4, "жжж", None, "s", 3)], schema)
    kept = corpus_pipeline.keep_determined(spark, docs, DATA)
    assert 1 in {r["doc_id"] for r in kept.collect()} and not {2, 3} & {r["doc_id"] for r in kept.collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_one_row_of_a_group_stays(spark):
    """Ids that are null or repeat neither save copies nor take other rows along."""
    schema = table(spark, DATA, "documents").schema
    copy, other, third = ("the same text in " + " ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(None, copy), (None, copy), (5, copy), (3, copy), (3, copy), (5, other), (7, other), (None, third), (None, third), (5, "alone"), (8, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], schema)
    kept = corpus_pipeline.keep_one_of_group(spark, docs, DATA)
    assert kept.columns == docs.columns
    want = [(3, copy), (5, other), (None, third), (5, "alone"), (8, None), (8, ""), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_long_foreign_text_goes(spark):
    docs = table(spark, DATA, "documents")
    known = next(w for w in docs.where("lang = 'en'").first()["text"].split() if w.isalpha())
    foreign = " ".join(["съешь ещё этих мягких французских булок да выпей чаю"] * 10)
    latin = " ".join(["zażółć gęślą jaźń chrząszcz brzmi w trzcinie szczebrzeszyn słynie"] * 10)
    rows = [(-1, f"{foreign} {known}"), (-2, f"{latin} {known}"), (-3, f"{known} жжж")]
    more = docs.unionByName(spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in rows], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_determined(spark, more, DATA).collect()}
    assert not {-1, -2} & kept and -3 in kept


def test_columns_of_any_name_come_through(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 1, 7, "x"), (2, text, "en", "a", 1, 8, "y"), (3, "other words altogether stand here in this text", "en", "a", 1, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, ROW_ string")
    kept = corpus_pipeline.keep_one_of_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
