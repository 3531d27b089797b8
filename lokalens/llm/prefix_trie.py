"""The trie of conversations: which of them start with the same turns, and what sharing them saves.

Turns get dense names, then pairs of blocks of 1, 2, 4 ... turns do, in as many joins as the longest
conversation has binary digits. A prefix of d turns is the list of the blocks that the binary digits of d
name, and prefixes of equal lists are one node. A node is known by its smallest member and its depth: the
nodes of one smallest member are a chain, and chains hang from nodes of others. So sums over subtrees are sums
over chains, which pointer doubling adds up in a logarithmic number of joins, and running sums along chains.

No step gathers a node's members or a conversation's turns in one task: rows are counted along
stretches of bounded length, and lists of members are hashed from chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

#: A conversation starts with turns of the one whose id is divisible by GROUP, fewer than HEADS.
GROUP, HEADS = 100, 6
#: Turns or depths that are counted in one task, as a power of two; ids of members in a chunk.
STRETCH_BITS, CHUNK = 10, 4096


def head_turns(conv_id: Column) -> Column:
    """How many turns of the group's first conversation a conversation starts with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _running(rows: DataFrame, by: str, along: str, values: dict[str, Column], ties: tuple[str, ...] = (), falling: bool = False) -> DataFrame:
    """rows with the sums of values over the rows of `by` up to each, by `along` (null first, or last if falling) and ties: a key is cut into stretches of `along`, whose sums are added up first."""
    stretch = F.coalesce(F.shiftright(along, STRETCH_BITS), F.lit(-(1 << 62)))
    cut = rows.select("*", stretch.alias("_stretch"), *(v.alias(f"_of_{k}") for k, v in values.items()))
    order = [F.desc(along) if falling else F.asc(along), *ties]
    whole = cut.groupBy(by, "_stretch").agg(*(F.sum(f"_of_{k}").alias(f"_before_{k}") for k in values))
    ahead = Window.partitionBy(by).orderBy(F.desc("_stretch") if falling else F.asc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(by, "_stretch", F.lag("_stretch").over(Window.partitionBy(by).orderBy(F.desc("_stretch") if falling else F.asc("_stretch"))).alias("_last"), *(F.sum(f"_before_{k}").over(ahead).alias(f"_before_{k}") for k in values)).where("_last IS NOT NULL")
    up_to = Window.partitionBy(by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = cut.select(*rows.columns, "_stretch", *(F.sum(f"_of_{k}").over(up_to).alias(k) for k in values)).join(before, [by, "_stretch"], "left")
    return here.select(*rows.columns, *((F.col(k) + F.coalesce(f"_before_{k}", F.lit(0))).alias(k) for k in values))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, chars): turns from position 0, by turn (null first), of equals by the digest of role and text.

    turn_key is the SHA-256 of role and text, chars the text's code points; null role or text is empty. Turns of null conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("turn_key"), F.length(text).cast("long").alias("chars"))
    placed = _running(rows, "conv_id", "turn", {"pos": F.lit(1)}, ("turn_key",))
    return placed.select("conv_id", (F.col("pos") - 1).cast("long").alias("pos"), "turn_key", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, turns, turn_key, chars) of every conversation rebuilt, of `turns` turns, and (conv_id, turns), a row for each, turnless ones too."""
    counts = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "lengths")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    taken = F.least(F.coalesce("of_base", F.lit(0)), F.col("h"))
    convs = counts.select("conv_id", "own", base.alias("base"), head_turns(F.col("conv_id")).alias("h")).join(heads, "base", "left")
    convs = materialize(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "rebuilt")
    first = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    start = convs.join(first, "base").where("pos < h").select("conv_id", "pos", "turns", "turn_key", "chars")
    rest = turns.where(F.col("pos") >= head_turns(F.col("conv_id"))).join(convs, "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turns", "turn_key", "chars")
    return start.unionByName(rest), convs.select("conv_id", "turns")


def named(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """rows with `name` in place of the columns `by`: a dense number, 0 and up, of their distinct values. Both are written: numbers are given once."""
    one = materialize(rows.select(*by).distinct().withColumn("at", F.monotonically_increasing_id()), f"{label}-names")
    part = F.shiftright("at", 33)
    sizes = {r["part"]: r["n"] for r in one.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, pairs = 0, []
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.create_map(*pairs)[part] if pairs else F.lit(0)
    names = one.select(*by, (start + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("name"))
    return materialize(rows.join(names, by).drop(*by), label)


def block_names(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two up to the longest conversation (conv_id, idx, turns, name): its whole blocks, equal names for equal turns."""
    levels = [named(turns.select("conv_id", F.col("pos").alias("idx"), "turns", "turn_key"), ["turn_key"], "turns")]
    while 2 << (len(levels) - 1) <= longest:
        half = F.col("idx") % 2
        side = lambda k: F.max(F.when(half == k, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("idx", 1).alias("pair")).agg(F.max("turns").alias("turns"), side(0).alias("left"), side(1).alias("right")).where("right IS NOT NULL")
        levels.append(named(pairs.withColumnRenamed("pair", "idx"), ["left", "right"], f"blocks-{2 << (len(levels) - 1)}"))
    return levels


def prefixes(levels: list[DataFrame], turns: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, names): every prefix of every conversation with the names of its blocks, longest first, and its last turn's length.

    The block of 2^j turns at idx (even) is in the prefixes that reach beyond its start by 2^j to 2^(j+1) - 1 turns."""
    rows = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars", F.lit(None).cast("struct<level:int,name:long>").alias("block"))
    for j, level in enumerate(levels):
        start = F.col("idx") * (1 << j)
        depth = F.explode(F.sequence(start + (1 << j), F.least(start + (2 << j) - 1, F.col("turns"))))
        rows = rows.unionByName(level.where("idx % 2 = 0").select("conv_id", depth.alias("depth"), F.lit(None).cast("long").alias("chars"), F.struct(F.lit(-j).alias("level"), "name").alias("block")))
    whole = rows.groupBy("conv_id", "depth").agg(F.max("chars").alias("chars"), F.array_sort(F.collect_list("block")).alias("blocks"))
    return whole.select("conv_id", "depth", "chars", F.transform("blocks", lambda b: b["name"]).alias("names"))


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): ids go to ranges of any one node, are joined to chunks there, and the chunks of a node are hashed one after the other."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for b in batches:
            out = []
            for *key, member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (node != key or len(ids) == CHUNK):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(member)
            if out:
                yield _rows(out, ["conv_id", "depth", "first", "ids"])
        if ids:
            yield _rows([(*node, ids[0], ",".join(map(str, ids)))], ["conv_id", "depth", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield _rows(out, ["conv_id", "depth", "ends_sha256"])
        if node:
            yield _rows([(*node, state.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    sorted_ids = members.select("conv_id", "depth", "member").repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    joined = map_arrow(sorted_ids, chunks, "conv_id long, depth long, first long, ids string")
    return map_arrow(joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first"), hashes, "conv_id long, depth long, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _totals(chains: DataFrame) -> DataFrame:
    """(chain, saved, leaves) of (chain, parent, saved, leaves): sums over the chains below each and itself, by pointers that double their reach."""
    now, k = chains, 0
    while not now.where("parent IS NOT NULL").isEmpty():
        up = now.where("parent IS NOT NULL").groupBy("parent").agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        far = now.select(F.col("chain").alias("parent"), F.col("parent").alias("beyond"))
        moved = now.join(far, "parent", "left").join(up.withColumnRenamed("parent", "chain"), "chain", "left")
        now = materialize(moved.select("chain", F.col("beyond").alias("parent"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")), f"chains-{k}")
        k += 1
    return now.select("chain", "saved", "leaves")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct sequence of first turns of the rebuilt conversations.

    Turns of one number go by the digest of role and text, so repeated rows are turns of their own; turns of null
    conv_id belong to no conversation. Without conversations there is no root either. Texts count whole, however
    long; other columns are ignored, whatever their names."""
    ordered = materialize(turns_in_order(conversations), "ordered")
    turns, convs = rebuilt(ordered)
    turns = materialize(turns, "rebuilt-turns")
    found = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"), F.max("turns").alias("longest")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not found["n"]:
        return convs.sparkSession.createDataFrame([], schema)
    root = found["root"]
    starts = materialize(prefixes(block_names(turns, found["longest"]), turns), "prefixes")
    nodes = materialize(starts.groupBy("depth", "names").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "nodes")

    # chains: the nodes of a smallest member, from the depth `top`; the node above belongs to another member, as does the end of who has no chain
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    asked = convs.join(tops, "conv_id", "left").select("conv_id", "turns", F.when(F.col("conv_id") == root, F.lit(0)).otherwise(F.col("top")).alias("top"))
    asked = materialize(asked.withColumn("depth", F.coalesce(F.col("top") - 1, "turns")), "asked")
    above = starts.select("conv_id", "depth", "names").join(asked.where("depth > 0"), ["conv_id", "depth"]).select("depth", "names", F.col("conv_id").alias("member"), "top", "turns")
    above = above.join(nodes.select("depth", "names", "conv_id"), ["depth", "names"]).select("conv_id", "depth", "member", "top", "turns")
    at_root = asked.where("depth <= 0").select(F.when(F.col("depth") == 0, F.lit(root)).alias("conv_id"), "depth", F.col("conv_id").alias("member"), "top", "turns")
    links = materialize(above.unionByName(at_root), "links")

    own = nodes.select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = own.unionByName(convs.where(F.col("conv_id") == root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(found["n"]).alias("n_convs"), F.lit(0).cast("long").alias("saved")))
    hung = links.where("top IS NOT NULL AND conv_id IS NOT NULL")
    last = links.where("top IS NOT NULL").select(F.col("member").alias("conv_id"), "top", "turns", F.col("conv_id").alias("above"))
    shape = own.join(last, "conv_id").join(hung.groupBy("conv_id", "depth").agg(F.count("*").alias("hanging")), ["conv_id", "depth"], "left")
    children = F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("turns")).cast("long")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above"))
    shape = materialize(shape.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", children.alias("n_children"), "saved"), "shape")
    chains = shape.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    chains = chains.join(hung.select(F.col("member").alias("conv_id"), F.col("conv_id").alias("parent")), "conv_id", "left")
    totals = _totals(materialize(chains.withColumnRenamed("conv_id", "chain"), "chains"))

    below = hung.select("conv_id", "depth", F.col("member").alias("chain")).join(totals, "chain").groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    weighed = materialize(shape.join(below, ["conv_id", "depth"], "left").select("*", (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("w"), ((F.col("n_children") == 0).cast("long") + F.coalesce("leaves_below", F.lit(0))).alias("l")), "weighed")
    summed = _running(weighed, "conv_id", "depth", {"saved_tokens": F.col("w"), "n_leaves": F.col("l")}, falling=True)

    done = links.select(F.when(F.col("top").isNotNull(), F.col("member")).otherwise(F.col("conv_id")).alias("conv_id"), F.col("turns").alias("depth"), "member")
    ends = _ends(done)
    nothing = hashlib.sha256(b"").hexdigest()
    return summed.join(ends, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
