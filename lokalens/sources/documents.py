"""JSON documents written by executors, and put in place together.

Rows of a document go to one task, sorted as the document has them, and are streamed to lines there: the task
holds a row and the open branches, whatever the document's size. Spark's own writer puts the lines under a
staging folder. A manifest then names what replaces what; a run that stops while files are moved is finished
from it by the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import staged

#: The file in a project's folder that names the files of an unfinished commit.
MANIFEST = ".lokalens-commit.json"


# --- segments to the order and names of a document ------------------------------------------------


def styles(segments: DataFrame, by: list[str]) -> DataFrame:
    """(*by, flat): whether no object lies in another in a document, so that dots are part of its keys."""
    return segments.groupBy(*by).agg((F.max("level") == 0).alias("flat"))


def placed(segments: DataFrame, by: list[str]) -> DataFrame:
    """(*by, names, place, json) of segments (*by, key, place, value, vtype, flat), place a number or a struct that sorts as leaves came and tells them apart (numbers are faster): leaves of a nested document under their branches.

    A branch stands where its first leaf came. Of a leaf and a branch of one name, what came last stays, at the place of what came first."""
    rows = segments.withColumn("names", F.when(F.col("flat"), F.array("key")).otherwise(F.split("key", r"\.")))
    rows = rows.withColumn("above", F.slice("names", 1, F.size("names") - 1))
    # what is said of branches is made from one row for each innermost branch, and leaves meet it in one pass
    inner = staged(rows.where(F.size("names") > 1).groupBy(*by, "above").agg(F.min("place").alias("first"), F.max("place").alias("last")), "inner")
    heads = F.transform(F.sequence(F.lit(1), F.size("above")), lambda n: F.slice("above", 1, n))
    each = inner.select(*by, "above", "first", "last", F.explode(heads).alias("head"))
    branches = staged(each.groupBy(*by, "head").agg(F.min("first").alias("first_below"), F.max("last").alias("last_below")), "branches")
    own = branches.withColumnRenamed("head", "names")
    leaves = rows.join(own, [*by, "names"]).groupBy(*by, F.col("names").alias("head")).agg(F.min("place").alias("first_leaf"), F.max("place").alias("last_leaf"))
    met = each.select(*by, "above", "head").join(branches.join(leaves, [*by, "head"], "left"), [*by, "head"])
    first = F.least("first_below", F.coalesce("first_leaf", "first_below"))
    order = met.groupBy(*by, "above").agg(F.array_sort(F.collect_list(F.struct(F.size("head").alias("n"), first.alias("first")))).alias("order"), F.max("last_leaf").alias("last_above"))
    order = staged(order.select(*by, "above", F.transform("order", lambda o: o["first"]).alias("order"), "last_above"), "order")
    text = F.when(F.col("vtype") == "string", quoted(F.col("value"))).otherwise(F.col("value"))
    over = lambda last: F.coalesce(F.col(last) > F.col("place"), F.lit(False))
    here = F.array(F.least("place", F.coalesce("first_below", "place")))
    kept = rows.join(order, [*by, "above"], "left").join(own, [*by, "names"], "left").where(~over("last_above") & ~over("last_below"))
    return kept.select(*by, "names", F.when(F.col("order").isNull(), here).otherwise(F.concat("order", here)).alias("place"), text.alias("json"))


# --- rows to lines --------------------------------------------------------------------------------


_name = json.JSONEncoder(ensure_ascii=False).encode


def _value(text: str, indent: str) -> str:
    """A leaf as the document has it: objects and lists over several lines."""
    if text[:1] not in "[{":
        return text
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2).replace("\n", "\n" + indent)


def lines_of(leaves: Iterator[tuple[list[str], str]]) -> Iterator[str]:
    """The lines of one document from its leaves (names, JSON text), sorted so that those of a branch follow each other; held back by one line, as the next one decides on the comma."""
    open_: list[str] = []
    held, opened = "{", True  # opened: the held line opens an object, so no comma follows it
    for names, text in leaves:
        if names[:-1] == open_:
            yield held if opened else held + ","
            indent = "  " * len(names)
            held, opened = f"{indent}{_name(names[-1])}: {_value(text, indent)}", False
            continue
        shared = 0
        while shared < min(len(open_), len(names) - 1) and open_[shared] == names[shared]:
            shared += 1
        while len(open_) > shared:
            yield held
            held, opened = "  " * len(open_) + "}", False
            open_.pop()
        for depth in range(shared, len(names)):
            yield held if opened else held + ","
            indent = "  " * (depth + 1)
            opened = depth < len(names) - 1
            held = f"{indent}{_name(names[depth])}: " + ("{" if opened else _value(text, indent))
        open_ = names[:-1]
    while open_:
        yield held
        held = "  " * len(open_) + "}"
        open_.pop()
    yield held
    yield "}"


def lines(rows: DataFrame) -> DataFrame:
    """(doc, seq, line) of leaves (doc, names, place, json)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def leaves() -> Iterator[tuple]:
            for b in batches:
                names, at = b.column("names").flatten().to_pylist(), np.cumsum([0, *b.column("names").value_lengths().to_pylist()]).tolist()
                yield from zip(b.column("doc").to_pylist(), (names[a:z] for a, z in pairwise(at)), b.column("json").to_pylist(), strict=True)

        source = leaves()
        ahead = next(source, None)
        while ahead is not None:
            doc = ahead[0]

            def own() -> Iterator[tuple[list[str], str]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == doc:  # noqa: B023
                    yield ahead[1], ahead[2]
                    ahead = next(source, None)

            for seq, line in enumerate(lines_of(own())):
                out.append((doc, seq, line))
                if len(out) == 4096:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    ship(rows.sparkSession)
    ready = rows.select("doc", "names", "place", "json").repartition("doc").sortWithinPartitions("doc", "place").select("doc", "names", "json")
    return ready.mapInArrow(run, "doc long, seq long, line string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, seq, line = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(seq, pa.int64()), pa.array(line, pa.string())], ["doc", "seq", "line"])


# --- files ----------------------------------------------------------------------------------------


class Files:
    """Single files of a Hadoop file system, which the driver moves but does not fill."""

    def __init__(self, spark: SparkSession):
        self.hadoop, self.gateway, self.jvm = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, at: str):
        """The file system and the path; of local files the plain system, which leaves no checksums beside them."""
        path = self.hadoop.Path(at)
        fs = path.getFileSystem(self.conf)
        return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), path

    def exists(self, at: str) -> bool:
        fs, path = self._at(at)
        return fs.exists(path)

    def replace(self, source: str, target: str) -> None:
        """Moves a file over another at once: readers see the old one or the new one."""
        fs, path = self._at(target)
        fs.mkdirs(path.getParent())
        if fs.getUri().getScheme() == "file":
            fs.delete(self.hadoop.Path(path.getParent(), f".{path.getName()}.crc"), False)
            if not fs.rename(self.hadoop.Path(source), path):
                raise OSError(f"{source} could not be moved to {target}")
            return
        overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.hadoop.FileContext.getFileContext(fs.getUri(), self.conf).rename(self.hadoop.Path(source), path, overwrite)

    def read(self, at: str) -> str:
        fs, path = self._at(at)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, at: str, text: str) -> None:
        """A small file, whole or not at all."""
        beside = f"{at}.{uuid.uuid4().hex}"
        fs, path = self._at(beside)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        self.replace(beside, at)

    def delete(self, at: str) -> None:
        fs, path = self._at(at)
        fs.delete(path, True)

    def matching(self, glob: str) -> list[str]:
        found = self.jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(self.hadoop.Path(glob)).mkString("\0")
        return [x for x in found.split("\0") if x]


def stage(rows: DataFrame, near: str | None = None, targets: DataFrame | None = None) -> list[tuple[str, str]]:
    """Writes the documents of leaves (target, names, place, json), each as one file in a staging folder, and returns (file, target) of each.

    near: the folder that holds the staging folder, so that moving files is a rename; else that of the first target. targets (target):
    the documents of the leaves, where that is told with less work than by making the leaves."""
    spark = rows.sparkSession
    named = (rows if targets is None else targets).select("target").distinct()
    of = dict(enumerate(sorted(r["target"] for r in named.collect())))  # files, not rows: the driver moves each
    if not of:
        return []
    at = f"{near or of[0].rpartition('/')[0] or '.'}/.lokalens-staged-{uuid.uuid4().hex}"
    names = spark.createDataFrame([(t, d) for d, t in of.items()], "target string, doc long")
    text = lines(rows.join(names, "target").select("doc", "names", "place", "json"))
    text.sortWithinPartitions("doc", "seq").select("doc", F.col("line").alias("value")).write.partitionBy("doc").option("maxRecordsPerFile", 0).text(at)
    parts = {int(p.rsplit("/", 2)[1].partition("=")[2]): p for p in Files(spark).matching(f"{at}/doc=*/part-*")}
    return [(parts[d], t) for d, t in of.items()]


def put(rows: DataFrame, targets: DataFrame | None = None) -> None:
    """Writes the documents of leaves one by one, each whole or not at all. The target's folder holds what is staged. targets: as of stage."""
    files = Files(rows.sparkSession)
    moves = stage(rows, targets=targets)
    for source, target in moves:
        files.replace(source, target)
    for staging in {source.rsplit("/", 2)[0] for source, _ in moves}:
        files.delete(staging)


def commit(spark: SparkSession, folder: str, moves: list[tuple[str, str]]) -> None:
    """Puts staged files in place, all of them or, if this stops halfway, all of them once finish() is called."""
    files = Files(spark)
    files.write(f"{folder}/{MANIFEST}", json.dumps({"moves": moves}, ensure_ascii=False))
    finish(spark, folder)


def finish(spark: SparkSession, folder: str) -> int:
    """Does what is left of an unfinished commit in a project's folder; how many files that was."""
    files, at, moved = Files(spark), f"{folder}/{MANIFEST}", 0
    if not files.exists(at):
        return 0
    moves = json.loads(files.read(at))["moves"]
    for source, target in moves:
        if files.exists(source):  # else it is in its place already
            files.replace(source, target)
            moved += 1
    for staging in sorted({source.rsplit("/", 2)[0] for source, _ in moves}):
        files.delete(staging)
    files.delete(at)
    return moved


def leaf(target: Column, names: list[Column], text: Column) -> list[Column]:
    """The columns of a leaf of a document with sorted keys."""
    return [target.alias("target"), F.array(*names).alias("names"), F.array(*names).alias("place"), text.alias("json")]


def quoted(text: Column) -> Column:
    """A text as JSON has it."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)
