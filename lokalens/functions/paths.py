"""Paths and addresses as Columns: what is the same path, what lies where relative to a folder, what may be called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# A scheme with its host, or a drive; then the slash that makes a path absolute.
_HEAD = r"^((?:[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?|[A-Za-z]:)?)(/?)"


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def head(path: Column) -> Column:
    """The scheme and host of a path, or its drive, in the form Hadoop gives them; '' for none."""
    return F.regexp_replace(F.regexp_extract(_slashed(path), _HEAD, 1), "://$", ":")


def is_absolute(path: Column) -> Column:
    return F.regexp_extract(_slashed(path), _HEAD, 2) == "/"


def segments(path: Column) -> Column:
    """The names along a path, . and empty ones left out, .. taken back where there is a name to take; above an absolute path's top there is nothing."""
    absolute = is_absolute(path)
    names = F.filter(F.split(F.regexp_replace(_slashed(path), _HEAD, ""), "/"), lambda x: ~x.isin("", "."))

    def step(kept: Column, name: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = F.when(F.coalesce(last != "..", F.lit(False)), F.slice(kept, 1, F.size(kept) - 1)).when(absolute, kept).otherwise(F.concat(kept, F.array(name)))
        return F.when(name == "..", back).otherwise(F.concat(kept, F.array(name)))

    plain = ~F.array_contains(names, "..")
    return F.when(plain, names).otherwise(F.aggregate(names, F.array().cast("array<string>"), step))


def normal(path: Column) -> Column:
    """The shortest spelling of a path, with forward slashes; '.' for the place itself."""
    whole = F.concat(head(path), F.when(is_absolute(path), F.lit("/")).otherwise(F.lit("")), F.array_join(segments(path), "/"))
    return F.when(whole == "", F.lit(".")).otherwise(whole)


def within(folder: Column, path: Column) -> Column:
    """A path as seen from the working folder: absolute ones and those with a scheme or drive stay."""
    own = is_absolute(path) | (head(path) != "")
    return normal(F.when(own, path).otherwise(F.concat(folder, F.lit("/"), path)))


def relative(path: Column, root: Column) -> Column:
    """The way from a folder to a path, both given alike; the path itself if they share neither scheme nor drive."""

    def way(a: Column, b: Column) -> Column:
        pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
        first = F.array_position(F.transform(pairs, lambda x: ~x["a"].eqNullSafe(x["b"])), True)
        shared = F.when(first == 0, F.size(pairs)).otherwise(first - 1).cast("int")
        up = F.array_repeat(F.lit(".."), F.size(b) - shared)
        down = F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0)))
        return F.array_join(F.concat(up, down), "/")

    found = let(way, a=segments(path), b=segments(root))
    apart = (head(path) != head(root)) | (is_absolute(path) != is_absolute(root))
    return F.when(apart, normal(path)).when(found == "", F.lit(".")).otherwise(found)


# --- addresses ------------------------------------------------------------------------------------


def service_url(url: Column) -> Column:
    """struct<url, refused>: the address to call, with https if it names no scheme. Only https is called; http just on the machine itself (localhost, ::1, numbers that start with 127), whatever its user info or port say."""
    raw = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")
    whole = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.regexp_extract(whole, r"^[^:]*://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))
    here = host.isin("localhost", "::1") | host.rlike(r"^127(\.[0-9]+)+$")
    refused = (
        F.when(raw == "", F.lit("the address is empty"))
        .when((scheme == "https") | ((scheme == "http") & here), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("not called: "), raw, F.lit(" is not https, so keys and texts would be readable on the way")))
    )
    return F.struct(F.when(refused.isNull(), whole).alias("url"), refused.alias("refused"))


def header_value(key: Column) -> Column:
    """struct<value, refused>: a key as an HTTP header can carry it, trimmed; null if there is none. The key is never part of what is said."""
    cleaned = F.regexp_replace(F.regexp_replace(key, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")
    fits = cleaned.rlike("^[ -~]*$")
    return F.struct(F.when(fits & (cleaned != ""), cleaned).alias("value"), F.when(~fits, F.lit("the key holds characters that no HTTP header can carry")).alias("refused"))
