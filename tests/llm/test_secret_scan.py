"""Secret scan: base spans against Python's own patterns, the battery's p-values, planted random strings."""

import hashlib
import random
import re

import numpy as np

from lokalens.llm import secret_scan as S

KINDS = ("assign", "access", "hex")


def brute(text):
    text, found = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def shown(found):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


ODD = [
    None, "", "token", "token=", "token=abcde", "token=abcdef", 'Password" : "Zürich-123456', "PASSWD:  'a.b=c/d+e_f-g'", "secret: token=abc123", "api_key=é12345 apikey=123456", "ſecret=abcdef",
    "AKIA" + "A" * 15, "éé AKIA" + "Z9" * 8 + "é", "AKIAAKIA" + "0" * 13, "f" * 23, "f" * 24 + "F" * 24, "日本 " + "0123456789abcdef" * 3, "token=" + "a" * 24, "x" * 300_000 + " token=hunter22", "\0token=abcdef\0",
]


def test_base_spans_equal_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, ODD[6], "x"), (3, ODD[6], "x")], "doc_id long, text string, base string")
    got = {(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in S.secrets(docs).collect()}
    want = set()
    for i, t in [*enumerate(ODD), (None, ODD[6]), (3, ODD[6])]:
        found = brute(t)
        want.add((i, hashlib.sha256(shown(found).encode()).hexdigest(), *(sum(k == x for _, k, _ in found) for x in range(3))))
    assert got == want
    assert S.secrets(docs.limit(0)).count() == 0


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("eeeettttaaaooinnsshhrrdlucmfwypvbg") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, planted = [], {}
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)] + ["2024", "v2", "7b", "x86", "utf8"] + ["".join(rng.choice(words) for _ in range(5))]
        if i % 10 == 0:
            planted[i] = "".join(rng.choice(S.ALPHABETS["alnum"]) for _ in range(40))
            text.insert(rng.randrange(60), planted[i])
        docs.append((i, " ".join(["é", *text])))
    rows = S.secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts, right, wrong = dict(docs), 0, 0
    for r in rows:
        for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s):
            if kind == "random":
                hit = texts[r["doc_id"]][int(a) : int(b)] == planted.get(r["doc_id"])
                right, wrong = right + hit, wrong + (not hit)
    assert right >= 38 and wrong <= 2


def test_tests_hold_their_level_and_tell_patterns():
    rng = np.random.default_rng(3)
    for size in (16, 62, 64):
        for n in (16, 40, 200):
            for test in (lambda v, k=size: S.uniformity_p(v, k), lambda v, k=size: S.runs_p(v, k), S.serial_p):
                p = np.array([test(rng.integers(0, size, n)) for _ in range(1500)])
                assert (p < 0.01).mean() < 0.03
    assert S.uniformity_p(np.zeros(40, np.int64), 16) < 1e-9
    assert S.runs_p(np.arange(64), 64) < 1e-9 and S.runs_p(np.tile([0, 63], 32), 64) < 1e-9
    assert S.serial_p(np.arange(64)) < 1e-6 and S.serial_p(np.full(30, 4)) == 0.0
    # as even as words, or more even: the p-value of words is not small more often than it says
    shares = np.array([8, 1, 3, 4, 12, 2, 2, 6, 7, 1, 1, 4, 2, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1], float)
    shares /= shares.sum()
    for n in (16, 32, 100):
        p = np.array([S.ordinary_p(rng.choice(26, n, p=shares), shares) for _ in range(3000)])
        assert (p < 0.01).mean() < 0.02
        assert np.median([S.ordinary_p(rng.integers(0, 26, n), shares) for _ in range(500)]) < 0.2


def test_false_discoveries_are_cut_by_class(spark):
    steps = [("a/8", 20)] * 5 + [("a/8", 1)] * 95 + [("b/9", 4)] * 3 + [("b/9", 0)] * 97 + [("c/9", 9)]
    found = spark.createDataFrame([([(0, 20, c, s)],) for c, s in steps], "drawn array<struct<start:long,end:long,class:string,step:int>>")
    got = {r["class"]: r["step"] for r in S.cuts(found).collect()}
    want = {}
    for name in {c for c, _ in steps}:
        own = [s for c, s in steps if c == name]
        fits = [s for s in set(own) if 10 ** (-s / S.STEPS) * len(own) <= S.FALSE_SHARE * sum(x >= s for x in own)]
        if fits:
            want[name] = min(fits)
    assert got == want == {"a/8": 20, "c/9": 9}


def test_runs_inside_spans_are_not_spans_of_their_own():
    runs = [(0, 5), (2, 9), (12, 20), (21, 30)]
    assert S.outside(runs, [(0, 0, 9), (11, 1, 19), (21, 2, 30)]) == [(12, 20)]
