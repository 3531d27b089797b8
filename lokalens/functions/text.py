"""Small string and array Columns the detectors share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"[\s\x1c-\x1f]+"
#: The characters that _WHITE stands for in all of Unicode.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def base_language(lang: Column) -> Column:
    """The first subtag, in lower case; '' for null."""
    return F.lower(F.split(F.replace(F.coalesce(lang, F.lit("")), F.lit("_"), F.lit("-")), "-")[0])


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(_BLANKS))


def normalized(x: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return strip(F.regexp_replace(F.lower(x), f"(?U){_WHITE}", " "))


def all_matches(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def holds_any(x: Column, *parts: str) -> Column:
    """Whether a text holds one of the parts: tells cheaply that a pattern cannot match."""
    return reduce(or_, (x.contains(p) for p in parts))


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def quoted(term: str) -> str:
    """A pattern for the term itself in any case."""
    return "(?iu)" + "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def let(body: Callable[..., Column], **values: Column) -> Column:
    """body(**values) with each value computed once a row: a lambda's outer expressions would be computed for each element."""
    names = list(values)
    bound = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return F.transform(bound, lambda v: body(**{n: v[n] for n in names}))[0]


def ones(a: Column) -> Column:
    """The elements of an array, each once, as tally() takes them."""
    return F.transform(a, lambda x: F.struct(x.alias("value"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("label")))


def tally(*parts: Column) -> Column:
    """array<struct<value, n0, label0, n1, label1, ...>>: for each value of the parts, arrays of struct<value, n, label>, its sum of n in each of them and its first label there, sorted by value. All are sorted once and equal neighbours are summed, so cost grows as that of sorting."""

    def tagged(part: Column, k: int) -> Column:
        return F.transform(part, lambda x, i: F.struct(x["value"].alias("value"), F.lit(k).alias("tag"), i.alias("at"), x["n"].alias("n"), x["label"].alias("label")))

    def tag(k: int) -> Callable[[Column], Column]:
        return lambda x: x["tag"] == k

    def runs(c: Column) -> Column:
        every = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(every, lambda i: ~F.get(c, i)["value"].eqNullSafe(F.get(c, i - 1)["value"]))
        return let(summed, c=c, first=first)

    def summed(c: Column, first: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            run = F.slice(c, start + 1, F.coalesce(F.get(first, i + 1), F.size(c)) - start)
            fields = []
            for k in range(len(parts)):
                own = F.filter(run, tag(k))
                fields += [F.aggregate(own, F.lit(0), lambda total, x: total + x["n"]).alias(f"n{k}"), F.get(own, F.lit(0))["label"].alias(f"label{k}")]
            return F.struct(F.get(c, start)["value"].alias("value"), *fields)

        return F.transform(first, one)

    return let(runs, c=F.sort_array(F.concat(*(tagged(p, k) for k, p in enumerate(parts)))))


def more_in(a: Column, b: Column) -> Column:
    """Sorted distinct elements that a holds more often than b."""
    return F.when(a == b, no_text()).otherwise(F.transform(F.filter(tally(ones(a), ones(b)), lambda x: x["n0"] > x["n1"]), lambda x: x["value"]))


def multiset_minus(a: Column, b: Column) -> Column:
    """Sorted elements of a, each as many times as it is in a beyond b."""
    left = F.transform(F.filter(tally(ones(a), ones(b)), lambda x: x["n0"] > x["n1"]), lambda x: F.array_repeat(x["value"], x["n0"] - x["n1"]))
    return F.when(a == b, no_text()).otherwise(F.flatten(left))


def messages(a: Column, say: Callable[[Column], Column]) -> Column:
    return F.transform(a, say)


def no_text() -> Column:
    return F.array().cast("array<string>")


def one_if(condition: Column, message: Column) -> Column:
    """An array of the message where the condition holds, else empty."""
    return F.when(condition, F.array(message)).otherwise(no_text())
