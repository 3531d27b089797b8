"""ICU messages: the one part of the checks that nests, and so the one part read by a Python UDF.

A message is read once into a tree of texts and blocks; what the detectors ask is then derived from
the tree. Rows without an ICU head go to the UDF as null and are handled by expressions alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

#: Levels that are read; deeper blocks are text.
MAX_DEPTH = 40
PARSED = "struct<names:array<string>,most:map<string,int>,fewest:map<string,int>,blocks:array<struct<type:string,keywords:array<string>,exacts:array<string>>>,visible:string>"
_python = lambda p: re.compile(p.replace("(?U)", ""))
_PLACEHOLDER, _HEAD = _python(T.PLACEHOLDER), _python(T.ICU_HEAD)
_LABEL = re.compile(r"(=?)(\w+)\s*\Z")


@dataclass
class Block:
    """{argument, type, label {message} ...}"""

    argument: str
    type: str
    arms: list[tuple[str | None, Message]] = field(default_factory=list)


@dataclass
class Message:
    """Texts and blocks in turn; raw is the message as written, deep whether its blocks were left unread."""

    raw: str
    parts: list[str | Block]


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost balanced braces, by a stack of the open ones."""
    out, open_ = [], []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            begin = open_.pop()
            if not open_:
                out.append((begin, m.end()))
    return out


def _label(before: str) -> str | None:
    m = _LABEL.search(before[-200:])
    if m is None:
        return None
    return "=" + m[2] if m[1] and m[2].isdecimal() else m[2]


def read(text: str, depth: int = 0) -> Message:
    """The tree of a message. At MAX_DEPTH levels a block keeps its argument but its arms are not read."""
    parts: list[str | Block] = []
    done = 0
    for begin, end in spans(text):
        head = _HEAD.match(text, begin, end)
        if head is None:
            continue
        parts.append(text[done:begin])
        done = end
        block = Block(head[1], head[2])
        body, at = text[head.end() : end - 1], 0
        for a, z in spans(body):
            inner = body[a + 1 : z - 1]
            block.arms.append((_label(body[at:a]), read(inner, depth + 1) if depth < MAX_DEPTH else Message(inner, None)))
            at = z
        parts.append(block)
    parts.append(text[done:])
    return Message(text, parts)


def _flat(m: Message) -> list[str]:
    return _PLACEHOLDER.findall(" ".join(p for p in m.parts if isinstance(p, str)))


def names(m: Message) -> list[str]:
    """Placeholders: a block gives its argument and those of its arms."""
    if m.parts is None:
        return []
    out = []
    for p in m.parts:
        if isinstance(p, Block):
            out.append("{" + p.argument + "}")
            for _, arm in p.arms:
                out += names(arm)
    return out + _flat(m)


def rendered(m: Message) -> tuple[Counter, Counter]:
    """How often each placeholder is shown at most and at least: one arm of a block is shown."""
    if m.parts is None:
        return Counter(), Counter()
    most, fewest = Counter(), Counter()
    outside = []
    for p in m.parts:
        if isinstance(p, str):
            outside.append(p)
            continue
        outside.append("{" + p.argument + "}")
        arms = [rendered(arm) for _, arm in p.arms if arm.parts is not None]
        for name in {n for hi, _ in arms for n in hi}:
            most[name] += max(hi[name] for hi, _ in arms)
            fewest[name] += min(lo[name] for _, lo in arms)
    flat = Counter(_PLACEHOLDER.findall(" ".join(outside)))
    return flat + most, flat + fewest


def visible(m: Message, depth: int = 0) -> str:
    """What is shown: of each block its longest arm, the first of equals."""
    if m.parts is None or depth >= MAX_DEPTH:
        return m.raw
    out = []
    for p in m.parts:
        out.append(p if isinstance(p, str) else max((visible(arm, depth + 1) for _, arm in p.arms), key=len, default=""))
    return "".join(out)


def parsed(text: str | None) -> dict | None:
    if text is None:
        return None
    m = read(text)
    most, fewest = rendered(m)
    blocks = []
    for p in m.parts:
        if isinstance(p, Block):
            labels = {label for label, _ in p.arms if label}
            blocks.append({"type": p.type, "keywords": sorted(x for x in labels if x[0] != "="), "exacts": sorted(x for x in labels if x[0] == "=")})
    return {"names": names(m), "most": dict(most), "fewest": dict(fewest), "blocks": blocks, "visible": visible(m)}


def _arrow_type() -> pa.DataType:
    texts, counts = pa.list_(pa.string()), pa.map_(pa.string(), pa.int32())
    blocks = pa.list_(pa.struct([("type", pa.string()), ("keywords", texts), ("exacts", texts)]))
    return pa.struct([("names", texts), ("most", counts), ("fewest", counts), ("blocks", blocks), ("visible", pa.string())])


def _parsed_udf():
    @F.arrow_udf(PARSED)
    def parse(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):  # most batches hold no message at all
            return pa.nulls(len(texts), _arrow_type())
        rows = [parsed(t) for t in texts.to_pylist()]
        return pa.array([r and r | {k: list(r[k].items()) for k in ("most", "fewest")} for r in rows], _arrow_type())

    return parse


def has_icu(text: Column) -> Column:
    return F.coalesce(text.rlike(T.ICU_HEAD), F.lit(False))


def parse_column(text: Column) -> Column:
    """The parsed message where there is an ICU head; its fields are null elsewhere."""
    return _parsed_udf()(F.when(has_icu(text), text))
