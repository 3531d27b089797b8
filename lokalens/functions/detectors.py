"""The string checks as Columns: each takes the source and the translation and gives an array of messages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import tables as T

from .text import all_matches, base_language, holds_any, let, matches, messages, more_in, multiset_minus, no_text, one_if, ones, quoted, strip, tally


# --- placeholders ---------------------------------------------------------------------------------


def placeholder_names(text: Column, icu: Column) -> Column:
    """With repetition; icu: the parsed message, null fields for a text without ICU."""
    marked = holds_any(text, "{", "%", ":")  # every form has one of these
    return F.coalesce(icu["names"], F.when(marked, all_matches(text, T.PLACEHOLDER)).when(text.isNotNull(), no_text()))


def lost_placeholders(src: Column, tgt: Column) -> Column:
    """Names (placeholder_names of both sides) that the translation lacks, sorted."""
    return F.array_sort(F.array_except(src, tgt))


def _shown(names: Column, counts: Column) -> Column:
    """How often each placeholder is shown, as tally() takes it: by the parsed message, else by its repetition."""
    return F.when(counts.isNotNull(), F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].alias("value"), e["value"].alias("n"), F.lit(None).cast("string").alias("label")))).otherwise(ones(names))


def placeholder_counts(src: Column, tgt: Column, src_icu: Column, tgt_icu: Column) -> Column:
    """Messages on invented, doubled and partly dropped placeholders; src and tgt are placeholder_names."""
    return let(_placeholder_counts, src=src, tgt=tgt, src_icu=src_icu, tgt_icu=tgt_icu)


def _placeholder_counts(src: Column, tgt: Column, src_icu: Column, tgt_icu: Column) -> Column:
    plain = src_icu["most"].isNull() & tgt_icu["most"].isNull()
    same = plain & (src == tgt)
    counts = tally(_shown(src, src_icu["most"]), _shown(src, src_icu["fewest"]), _shown(tgt, tgt_icu["most"]), _shown(tgt, tgt_icu["fewest"]))
    return F.when(same, no_text()).otherwise(F.filter(F.transform(counts, _placeholder_count), lambda x: x.isNotNull()))


def _placeholder_count(c: Column) -> Column:
    p, s_hi, s_lo, t_hi, t_lo = (c[x] for x in ("value", "n0", "n1", "n2", "n3"))
    return (
        F.when(p == "%%", F.lit(None).cast("string"))
        .when((t_hi > s_hi) & (s_hi == 0), F.concat(F.lit("invented placeholder "), p, F.lit(" (not in source)")))
        .when(t_hi > s_hi, F.concat(F.lit("placeholder "), p, F.lit(" appears "), t_hi.cast("string"), F.lit("× vs "), s_hi.cast("string"), F.lit("× in source (duplicated)")))
        .when((s_lo > t_lo) & (t_hi != 0) & ((t_hi != t_lo) | (s_hi != s_lo)), F.concat(F.lit("placeholder "), p, F.lit(" is missing from some plural/select arms ("), t_lo.cast("string"), F.lit("× in the thinnest arm vs "), s_lo.cast("string"), F.lit("× in the source)")))
        .when((s_lo > t_lo) & (t_hi != 0), F.concat(F.lit("placeholder "), p, F.lit(" appears "), s_lo.cast("string"), F.lit("× in source but "), t_lo.cast("string"), F.lit("× in translation")))
    )


_FLAT = r"\{\{[^{}]*\}\}|\{[^{}]*\}"


def _identities(text: str) -> list[str]:
    """Placeholders of a text in which braces nest: the name before the first comma of each outermost span, and percent forms outside."""
    found, chars = set(), list(text)
    for a, z in _balanced(text):
        found.add(_identity(text[a:z]))
        chars[a:z] = " " * (z - a)
    return sorted(found | set(re.findall(T.PERCENT.replace("(?U)", ""), "".join(chars))))


def _balanced(text: str) -> list[tuple[int, int]]:
    """Outermost balanced spans in one pass, where unmatched opening braces do not count."""
    close, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.end()
    out, at = [], 0
    for a in sorted(close):
        if a >= at:
            out.append((a, close[a]))
            at = close[a]
    return out


def _identity(span: str) -> str:
    return "{" + span.strip("{}").split(",")[0].strip() + "}"


@F.arrow_udf(ArrayType(StringType()))
def _nested_identities(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.string())
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), kind)
    return pa.array([None if t is None else _identities(t) for t in texts.to_pylist()], kind)


def placeholder_set(text: Column) -> Column:
    """The set of placeholders by the grammar of the key check, sorted; null text has none."""
    text = F.coalesce(text, F.lit(""))
    marked = holds_any(text, "{", "%")  # every form has one of these
    dollars = all_matches(text, T.DOLLAR)
    masked = F.regexp_replace(text, T.DOLLAR, " ")
    flat = F.transform(all_matches(masked, _FLAT), lambda s: F.concat(F.lit("{"), strip(F.split(F.regexp_replace(s, r"^\{+|\}+$", ""), ",")[0]), F.lit("}")))
    rest = F.regexp_replace(masked, _FLAT, " ")
    deep = marked & matches(rest, r"\{[^{}]*\}")
    plain = F.concat(flat, all_matches(rest, T.PERCENT))
    found = F.array_sort(F.array_distinct(F.concat(dollars, F.when(deep, _nested_identities(F.when(deep, masked))).otherwise(plain))))
    return F.when(marked, found).otherwise(no_text())


# --- numbers and money ----------------------------------------------------------------------------


def number_key(run: Column) -> Column:
    """The value of a run of digits and separators: grouping dropped, a decimal part kept unless it is three digits long."""
    t = F.translate(run, T.FOREIGN_DIGITS, T.ASCII_DIGITS)
    split = r"(?s)^(.*)[,.'](.*)$"
    head, tail = (F.regexp_replace(F.regexp_extract(t, split, g), "[^0-9]", "") for g in (1, 2))
    return F.when((head != "") & (tail != "") & (F.length(tail) != 3), F.concat(head, F.lit("."), tail)).otherwise(F.regexp_replace(t, "[^0-9]", ""))


def numbers(text: Column) -> Column:
    """array<struct<key, run>> in order of appearance, placeholders left out."""
    edge = "[ ,.'  ]+"
    runs = all_matches(F.regexp_replace(text, T.PLACEHOLDER, " "), T.NUMBER_RUN)
    clean = F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, f"^{edge}", ""), f"{edge}$", ""))
    return F.filter(F.transform(clean, lambda r: F.struct(number_key(r).alias("key"), r.alias("run"))), lambda x: x["key"] != "")


def spelled_numbers(text: Column) -> Column:
    words = all_matches(F.regexp_replace(text, T.ARM_LABEL, "$1$3"), r"(?iuU)\b(" + "|".join(T.NUMBER_WORDS) + r")\b", 1)
    values = T.literal_map({k: str(v) for k, v in T.NUMBER_WORDS.items()})
    return F.transform(words, lambda w: F.element_at(values, F.lower(w)))


def number_drift(src: Column, tgt: Column, lang: Column) -> Column:
    article = base_language(lang).isin(T.COUNTER_LANGUAGES) & matches(src, T.ARTICLE)
    spelled = F.concat(spelled_numbers(src), F.when(article, F.array(F.lit("1"))).otherwise(no_text()))

    def drift(a: Column, b: Column) -> Column:
        runs = lambda x: F.transform(x, lambda y: F.struct(y["key"].alias("value"), F.lit(1).alias("n"), y["run"].alias("label")))
        keys = lambda x: F.transform(x, lambda y: y["key"])
        return F.when(keys(a) == keys(b), no_text()).otherwise(let(lambda c, words: said(c, words, F.size(b) > 0), c=tally(runs(a), runs(b)), words=spelled))

    def said(c: Column, words: Column, any_left: Column) -> Column:
        invented = messages(F.filter(c, lambda x: (x["n1"] > x["n0"]) & ~F.array_contains(words, x["value"])), lambda x: F.concat(F.lit("number "), x["label1"], F.lit(" appears in the translation but not the source")))
        missing = messages(F.filter(c, lambda x: x["n0"] > x["n1"]), lambda x: F.concat(F.lit("number "), x["label0"], F.lit(" from the source is missing or changed in the translation")))
        return F.concat(invented, F.when(any_left, missing).otherwise(no_text()))

    return F.when(matches(src, f"[{T.DIGITS}]") | matches(tgt, f"[{T.DIGITS}]"), let(drift, a=numbers(src), b=numbers(tgt))).otherwise(no_text())


_GAP = "[ \u00a0\u202f]"
_TOKENS = "(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t, _ in sorted(T.CURRENCY, key=lambda x: -len(x[0]))) + ")"
_PRICE = rf"(?U)(?:(?<=\d)|(?<=\d{_GAP})){_TOKENS}(?![A-Za-z])|(?<![A-Za-z0-9]){_TOKENS}{_GAP}?(?=\d)"


def currencies(text: Column) -> Column:
    """Sorted currencies that the text quotes next to a number, longer tokens before those they hold."""
    meant = T.literal_map(dict(T.CURRENCY))
    found = F.transform(all_matches(text, _PRICE), lambda t: F.element_at(meant, F.regexp_replace(t, f"{_GAP}$", "")))
    return F.when(matches(text, r"(?U)\d"), F.array_sort(F.array_distinct(found))).otherwise(no_text())


def currency_change(src: Column, tgt: Column) -> Column:
    show = lambda x: F.array_join(x, ", ")

    def said(a: Column, b: Column) -> Column:
        return (
            F.when(a == b, no_text())
            .when(F.size(b) == 0, F.array(F.concat(F.lit("currency dropped — the source priced this in "), show(a), F.lit(", the translation has no currency"))))
            .when(F.size(a) == 0, F.array(F.concat(F.lit("currency invented — the translation quotes "), show(b), F.lit(", the source quoted none"))))
            .otherwise(F.array(F.concat(F.lit("currency changed: "), show(a), F.lit(" → "), show(b), F.lit(" — this is a different price, not a translation"))))
        )

    return let(said, a=currencies(src), b=currencies(tgt))


# --- markup ---------------------------------------------------------------------------------------


def entity_faults(src: Column, tgt: Column) -> Column:
    new = F.when(tgt.contains("&amp;"), let(more_in, a=all_matches(tgt, T.DOUBLE_ENCODED), b=all_matches(src, T.DOUBLE_ENCODED))).otherwise(no_text())
    said = messages(new, lambda e: F.concat(F.lit("double-encoded entity "), e, F.lit(" — the & was re-escaped (renders literally)")))
    broken = matches(tgt, T.BROKEN_ESCAPE) & ~matches(src, T.BROKEN_ESCAPE)
    return F.concat(said, one_if(broken, F.lit("broken \\u escape — a unicode escape was mangled to non-hex")))


def tags(text: Column) -> Column:
    """Shapes of the tags, attributes left out."""
    name = lambda t: F.regexp_extract(t, T.TAG_NAME, 1)
    return F.transform(all_matches(text, T.TAG), lambda t: F.when(t.startswith("</"), F.concat(F.lit("</"), name(t), F.lit(">"))).when(t.endswith("/>"), F.concat(F.lit("<"), name(t), F.lit("/>"))).otherwise(F.concat(F.lit("<"), name(t), F.lit(">"))))


def lost_tags(src: Column, tgt: Column) -> Column:
    return F.when(src.contains("<"), let(multiset_minus, a=tags(src), b=tags(tgt))).otherwise(no_text())


# --- ICU ------------------------------------------------------------------------------------------


def icu_faults(src_icu: Column, tgt_icu: Column, lang: Column) -> Column:
    empty = F.array().cast("array<struct<type:string,keywords:array<string>,exacts:array<string>>>")
    return let(_icu_faults, a=F.coalesce(src_icu["blocks"], empty), b=F.coalesce(tgt_icu["blocks"], empty), base=base_language(lang))


def _icu_faults(a: Column, b: Column, base: Column) -> Column:
    required = F.coalesce(T.literal_map(T.CLDR_REQUIRED)[base], no_text())
    fewer = one_if(F.size(a) > F.size(b), F.concat(F.lit("ICU plural/select construct dropped or broken ("), F.size(a).cast("string"), F.lit(" in source, "), F.size(b).cast("string"), F.lit(" in translation)")))

    def of(block: Column) -> Column:
        missing = F.array_sort(F.array_except(required, block["keywords"]))
        other = one_if(~F.array_contains(block["keywords"], "other"), F.concat(F.lit("ICU "), block["type"], F.lit(" is missing the required 'other' branch")))
        forms = one_if((block["type"] == "plural") & (F.size(missing) > 0), F.concat(F.lit("ICU plural is missing the "), F.array_join(missing, "/"), F.lit(" form(s) "), base, F.lit(" requires")))
        return F.concat(other, forms)

    exacts = lambda x: F.flatten(F.transform(x, lambda y: y["exacts"]))
    gone = messages(F.array_sort(F.array_except(exacts(a), exacts(b))), lambda e: F.concat(F.lit("ICU exact-match branch "), e, F.lit(" {…} was dropped in the translation")))
    return F.concat(fewer, F.flatten(F.transform(b, of)), gone)


# --- glossary -------------------------------------------------------------------------------------


def _terms(glossary: list[str] | None) -> list[str]:
    return [t.strip() for t in glossary or [] if t and t.strip()]


def lost_terms(src: Column, tgt: Column, glossary: list[str] | None) -> Column:
    terms = _terms(glossary)
    if not terms:
        return no_text()
    a, b = F.lower(src), F.lower(tgt)
    return F.array_sort(F.array_distinct(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(a, F.lower(t)) & ~F.contains(b, F.lower(t)))))


def collapsed_to_term(src: Column, tgt: Column, glossary: list[str] | None) -> Column:
    terms = _terms(glossary)
    if not terms:
        return no_text()
    rest = tgt
    for t in terms:
        rest = F.regexp_replace(rest, quoted(t), " ")
    rest = F.regexp_replace(F.regexp_replace(rest, T.PLACEHOLDER, " "), T.TAG, " ")
    kept = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(tgt), F.lower(t)))
    gone = (F.size(all_matches(src, T.LETTERS + "{2,}")) >= 3) & ~matches(rest, T.LETTERS) & (F.size(kept) > 0)
    return one_if(gone, F.concat(F.lit('translation collapsed to the glossary term "'), kept[0], F.lit('" — the sentence is gone')))


def recased_terms(src: Column, tgt: Column, glossary: list[str] | None) -> Column:
    said = []
    for t in _terms(glossary):
        said.append(let(lambda forms, seen: _recased(tgt, forms, seen), forms=F.array_sort(F.array_distinct(all_matches(src, quoted(t)))), seen=all_matches(tgt, quoted(t))))
    return F.array_sort(F.array_distinct(F.filter(F.array(*said), lambda x: x.isNotNull()))) if said else no_text()


def _recased(tgt: Column, forms: Column, seen: Column) -> Column:
    first = lambda f, change: F.concat(change(F.substring(f, 1, 1)), F.substring(f, 2, 1 << 30))
    fits = F.exists(forms, lambda f: F.contains(tgt, f) | F.contains(tgt, first(f, F.upper)) | F.contains(tgt, first(f, F.lower)))
    return F.when((F.size(forms) > 0) & (F.size(seen) > 0) & ~fits, F.concat(forms[0], F.lit(' appears as "'), seen[0], F.lit('" — a kept term keeps its exact case')))


# --- leftovers ------------------------------------------------------------------------------------


def answered(src: Column, tgt: Column) -> Column:
    """Whether the translation is an answer: a short source, and a text no expansion explains."""
    a, b = F.length(strip(src)), F.length(strip(tgt))
    long = F.length(tgt) >= 120  # most texts are told by this alone
    return F.when(long, F.coalesce((a > 0) & (b > 0) & (a <= 80) & (b >= F.greatest(4 * a, F.lit(120))), F.lit(False))).otherwise(False)


def untranslated(src: Column, tgt: Column, lang: Column, glossary: list[str] | None = None) -> Column:
    base = base_language(lang)
    key = F.when(lang.isin(list(T.SCRIPT)), lang).otherwise(base)
    scripted = key.isin(list(T.SCRIPT))
    by_pattern: dict[str, list[str]] = {}
    for k, p in T.SCRIPT.items():
        by_pattern.setdefault(p, []).append(k)
    written = F.lit(False)
    for p, langs in by_pattern.items():
        written = F.when(key.isin(langs), matches(tgt, p)).otherwise(written)
    same = strip(tgt) == strip(src)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(tgt, T.PLACEHOLDER, " "), T.TAG, " "), T.URL, " "), r"(?U)\d+", " ")
    for t in glossary or []:
        if t:
            s = F.regexp_replace(s, quoted(t), " ")
    absent = scripted & ~written

    def said(s: Column) -> Column:
        sentence = let(lambda words: (F.size(words) >= 3) & F.exists(words, lambda w: w.rlike(r"(?U)^\p{Lower}")), words=all_matches(s, T.LETTERS + "+"))
        reads = matches(s, T.LOWERCASE_WORD) | (absent & sentence)
        return (
            F.when(absent & reads, F.array(F.lit("may be untranslated — no target-language script, still reads as source text")))
            .when(same & reads & (F.size(all_matches(s, T.LETTERS + "{2,}")) >= 3), F.array(F.lit("may be untranslated — identical to the source text")))
            .otherwise(no_text())
        )

    return F.when((base != "en") & (same | absent), let(said, s=s)).otherwise(no_text())
