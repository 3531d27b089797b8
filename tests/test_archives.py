"""Archives of translated files: what is refused, and where members belong."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lokalens.sources import archives as A


def zipped(members, damage=None):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return damage(buffer.getvalue()) if damage else buffer.getvalue()


def test_sizes_are_counted_not_believed():
    bomb = zipped({"de.json": b"\0" * 50_000})
    lying = bomb.replace((50_000).to_bytes(4, "little"), (10).to_bytes(4, "little"))  # headers that promise ten bytes
    for content in (bomb, lying, zipped({f"{i}.json": b"x" * 900 for i in range(5)}), b"", b"PK", bomb[:-30]):
        with pytest.raises(A.Refused):
            list(A.unzipped(content, member_bytes=1000, archive_bytes=4000))
    with pytest.raises(A.Refused):
        list(A.unzipped(zipped({"a": b"", "b": b""}), most=1))
    assert list(A.unzipped(zipped({"a/": b"", "a/b": b"x" * 1000, "c": b""}), 1000, 1000)) == [("a/b", b"x" * 1000), ("c", b"")]


def test_members(spark):
    rows = [("good", zipped({"de.json": b'{"a": "x"}', "values/fr.xml": b"<x/>"})), ("bad", zipped({"de.json": b"{}", "../x.json": b"{}"})), ("null", None), ("empty", zipped({}))]
    found = A.members(spark.createDataFrame(rows, "path string, content binary"))
    got = sorted((r["path"], r["name"] or "", bytes(r["content"] or b""), (r["error"] or "")[:12]) for r in found.collect())
    assert got == [("bad", "", b"", "the member ."), ("good", "de.json", b'{"a": "x"}', ""), ("good", "values/fr.xml", b"<x/>", ""), ("null", "", b"", "the archive ")]


def test_targets(spark):
    rows = [("de.json", "l/en/a.json", "", "l/de/a.json"), ("pt-BR.json", "/l/en.json", "out", "out/pt-BR.json"), ("x.xcstrings", "a/Local.xcstrings", "", "a/Local.xcstrings"), ("de.xcstrings", "a/Local.xcstrings", "out/", "out/Local.xcstrings")]
    df = spark.createDataFrame(rows, "name string, source string, out string, want string")
    assert [r["got"] for r in df.select(A.member_target(F.col("name"), F.col("source"), F.col("out"), F.lit("en")).alias("got")).collect()] == [r[3] for r in rows]


def test_members_become_documents(spark, tmp_path):
    from lokalens.sources import documents

    rows = [(str(tmp_path / "de.json"), b'{"a": {"b": "x"}, "n": 1}'), (str(tmp_path / "fr.json"), b'\xef\xbb\xbf{"a.b": "y"}')]
    documents.put(A.member_leaves(spark.createDataFrame(rows, "target string, content binary")))
    assert (tmp_path / "de.json").read_text() == '{\n  "a": {\n    "b": "x"\n  },\n  "n": 1\n}\n' and (tmp_path / "fr.json").read_text() == '{\n  "a.b": "y"\n}\n'
    with pytest.raises(A.Refused):
        A.member_leaves(spark.createDataFrame([("x.json", b"[1]")], "target string, content binary"))
