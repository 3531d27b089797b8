"""Archives of translated files: members are read where the archive's bytes are, and told where they belong.

An archive is taken whole or not at all. It is refused if a member's name leads outside of the folder it is
unpacked to, or if members hold more than they may, whatever their headers say.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import decode, documents
from . import segments as S

#: Bytes of one member, of an archive's members together, and how many members there may be.
MEMBER_BYTES, ARCHIVE_BYTES, MOST_MEMBERS = 16 << 20, 64 << 20, 2000


class Refused(ValueError):
    """The archive is damaged, or holds more than it may."""


def unzipped(content: bytes, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES, most: int = MOST_MEMBERS) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of an archive's files. No more is unpacked than may be: sizes are counted as bytes come."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = [e for e in z.infolist() if not e.is_dir()]
            if len(entries) > most:
                raise Refused(f"the archive has more than {most} members")
            left = archive_bytes
            for e in entries:
                with z.open(e) as f:
                    data = f.read(min(member_bytes, left) + 1)
                if len(data) > min(member_bytes, left):
                    raise Refused(f"the member {e.filename} is larger than it may be")
                left -= len(data)
                yield e.filename, data
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as e:
        raise Refused(f"the archive cannot be read: {e}") from e


def members(archives: DataFrame, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, name, content, error) of archives (path, content): a row for each file in them, or one with an error for an archive that is refused. Null content is no archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # an archive at a time: what is held is bounded by archive_bytes
                path, content = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                try:
                    rows = [(path, name, data, None) for name, data in unzipped(content or b"", member_bytes, archive_bytes)]
                except Refused as e:
                    rows = [(path, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "name", "content", "error"])

    ship(archives.sparkSession)
    read = archives.select("path", "content").mapInArrow(run, "path string, name string, content binary, error string")
    unsafe = F.col("error").isNull() & ~S.safe_member(F.col("name"))
    bad = read.where(unsafe).groupBy("path").agg(F.min("name").alias("bad"))
    fine = read.join(bad.select("path"), "path", "left_anti")
    return fine.unionByName(bad.select("path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit("the member "), "bad", F.lit(" would lie outside of the folder")).alias("error")))


def member_target(name: Column, source: Column, out_dir: Column, source_lang: Column) -> Column:
    """Where a member belongs: the translation of a source file into the language that the member's name is. A catalog holds all languages and takes the source's place, or its name in out_dir."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    own = F.regexp_extract(source, r"([^/]*)$", 1)
    whole = F.when(out_dir == "", source).otherwise(F.concat(F.regexp_replace(out_dir, "/+$", ""), F.lit("/"), own))
    return F.when(F.lower(base).endswith(".xcstrings"), whole).otherwise(S.target_path(source, F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), out_dir, source_lang))


def member_leaves(found: DataFrame) -> DataFrame:
    """The leaves of the JSON documents among members (target, content), as documents.stage writes them; an error where one cannot be read."""
    texts = decode.texts(found.select(F.col("target").alias("path"), "content"))
    rows = S.flatten(texts.where("error IS NULL"))
    bad = texts.where("error IS NOT NULL").select("path", "error").unionByName(rows.where("error IS NOT NULL").select("path", "error")).first()
    if bad:
        raise Refused(f"{bad['path']}: {bad['error']}")
    style = documents.styles(rows, ["path"])
    return documents.placed(rows.join(style, "path").select(F.col("path").alias("target"), "key", F.struct("ord").alias("place"), "value", "vtype", "flat"), ["target"])
