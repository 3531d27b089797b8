"""The trie of conversations against a brute-force version."""

import hashlib
import math
import random
import zlib

import pytest

from lokalens.llm import prefix_trie as P
from lokalens.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append(((t is not None, t or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    new, members, children = {}, {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:])
        for d in range(len(new[c]) + 1):
            members.setdefault(new[c][:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below, of = children.get(node, []), members[node]
        saved[node] = (len(of) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in below)
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        ends = ",".join(map(str, sorted(c for c in of if len(new[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 420), 90):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a", "a", "bé", "", None, "日本"])))
    rows += rows[:7]  # repeated rows
    rows += [(7, None, "user", "x"), (7, None, "user", "x"), (7, 1, "user", "tie"), (7, 1, "user", "ties"), (None, 1, "user", "nobody's")]
    got = rows_of(P.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert got == brute(rows)


def test_copies_of_a_conversation_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    monkeypatch.setattr(P, "STRETCH_BITS", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(9)]
    rows += [(300, t, "user", f"turn {t % 5}") for t in range(150)] + [(301, t, "user", f"turn {t % 5}") for t in range(149)]
    rows += [(c, t, "user", "x" * (t % 3)) for c in range(401, 405) for t in range(c - 400)]  # their group's first conversation is absent, some end turnless
    got = rows_of(P.prefix_trie(spark.createDataFrame([(*r, "y", 1) for r in rows], SCHEMA + ", names string, depth int")))
    assert got == brute(rows)


def test_no_conversations(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_query_over_its_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, sf)) == brute(rows)
