"""Patterns, word lists and lookup tables that results depend on, and Columns made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Patterns are Java ones; (?U) makes \w, \d, \s and \b cover all of Unicode.
PLACEHOLDER = (
    r"(?U)\{\{\s*[\w\d_.]+\s*\}\}"
    r"|%\{[\w\d_]+\}"
    r"|%\([\w\d_]+\)[-+0#]{0,6}\d{0,8}(?:\.\d{1,8})?[a-zA-Z]"
    r"|\{[\w\d_]+(?:,-?\d+)?(?::[^}]*)?\}"
    r"|%\d+\$[-+0# ]{0,6}\d{0,8}(?:\.\d{1,8})?[@a-zA-Z]"
    r"|%@"
    r"|%[-+0#]{0,6}\d{0,8}(?:\.\d{1,8})?(?:hh|ll|[hlLzjt])?[sSdiouxXeEfFgGaAcCpn%]"
    r"|\$\{[\w\d_]+\}"
    r"|:[A-Za-z]\w*:"
)
PERCENT = r"(?U)%\d+\$[@a-zA-Z]|%@|%[sdifxocegpnXOCEGP%]"
DOLLAR = r"(?U)\$\{[\w\d]+\}"
ICU_HEAD = r"(?U)\{\s*([\w\d_]+)\s*,\s*(plural|selectordinal|select)\s*,"
PRINTF = r"%(?:\d+\$)?[-+ #0]*[\d.*]*(?:hh|h|ll|l|q|L|z|t|j)?[@dioupxXeEfgGcsSaAn%]"
DIGITS = "0-9٠-٩۰-۹०-९০-৯๐-๙"
NUMBER_RUN = "[" + DIGITS + "][" + DIGITS + ".,'   ]*"
FOREIGN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९০১২৩৪৫৬৭৮৯๐๑๒๓๔๕๖๗๘๙", "0123456789" * 5
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "first": 1, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
ARM_LABEL = r"(?U)(?<=[,}])(\s*)(=\d+|\w+)(\s*)(?=\{)"
COUNTER_LANGUAGES = ["ja", "zh", "ko", "yue", "wuu"]
ARTICLE = r"(?iuU)\b(a|an)\b"
DOUBLE_ENCODED = r"(?U)&amp;(?:amp|lt|gt|quot|apos|nbsp|#\d{1,7}|#x[0-9a-fA-F]{1,6});"
BROKEN_ESCAPE = r"\\u(?![0-9a-fA-F]{4})"
TAG = r"(?U)</?[a-zA-Z0-9][\w:-]*(?:\s[^<>]*?)?/?>"
TAG_NAME = r"(?U)</?\s*([a-zA-Z0-9][\w:-]*)"
CLDR_REQUIRED = {
    "ru": ["few", "many", "one"], "uk": ["few", "many", "one"], "pl": ["few", "many", "one"],
    "cs": ["few", "one"], "sk": ["few", "one"], "hr": ["few", "one"], "sr": ["few", "one"],
    "lt": ["few", "one"], "ro": ["few", "one"], "ar": ["few", "many", "one", "two", "zero"],
    "lv": ["one", "zero"], "sl": ["few", "one", "two"], "he": ["one", "two"],
}
REGISTER = {  # informal, formal
    "de": (r"(?iuU)\b(?:du|dich|dir|dein\w*)\b", r"(?U)\bSie\b|\bIhnen\b"),
    "fr": (r"(?iuU)\b(?:tu|toi|ton|tes)\b", r"(?iuU)\bvous\b|\bvotre\b|\bvos\b"),
    "ru": (r"(?iuU)\b(?:ты|тебя|тебе|тобой|твой|тво[яеёи]\w*)\b", r"(?iuU)\b(?:вы|вас|вам|вами|ваш\w*)\b"),
    "es": (r"(?iuU)\b(?:tú|ti|tus)\b", r"(?iuU)\b(?:usted|ustedes)\b"),
    "it": (r"(?iuU)\b(?:tu|tuo|tua|tuoi|tue)\b", r"(?U)\bLei\b|\bLei,"),
}
EXPANSION = {
    "de": 1.35, "nl": 1.35, "fi": 1.5, "sv": 1.3, "da": 1.3, "no": 1.3, "hu": 1.35, "fr": 1.25, "es": 1.25,
    "pt": 1.25, "it": 1.2, "ro": 1.3, "el": 1.3, "tr": 1.25, "pl": 1.3, "cs": 1.3, "sk": 1.3, "ru": 1.2,
    "uk": 1.2, "vi": 1.3, "id": 1.2, "zh": 0.4, "ja": 0.55, "ko": 0.7, "th": 0.9,
}
DEFAULT_EXPANSION = 1.2
SCRIPT = {
    "ru": "[Ѐ-ӿ]", "uk": "[Ѐ-ӿ]", "bg": "[Ѐ-ӿ]", "el": "[Ͱ-Ͽ]", "ar": "[؀-ۿݐ-ݿ]", "fa": "[؀-ۿݐ-ݿ]",
    "he": "[֐-׿]", "zh": "[㐀-鿿]", "zh-Hant": "[㐀-鿿]", "ja": "[぀-ヿ㐀-鿿]", "ko": "[가-힣]",
    "th": "[฀-๿]", "hi": "[ऀ-ॿ]", "bn": "[ঀ-৿]",
}
URL = r"(?U)https?://\S+|www\.\S+"
LOWERCASE_WORD = r"(?U)\b[a-zß-öø-ÿ][A-Za-zÀ-ÿ]{3,}\b"
LETTERS = r"(?U)[^\W\d_]"
CURRENCY = [
    ("R$", "BRL"), ("US$", "USD"), ("CA$", "CAD"), ("NZ$", "NZD"), ("HK$", "HKD"), ("A$", "AUD"), ("S$", "SGD"),
    ("zł", "PLN"), ("Kč", "CZK"), ("kr", "KR"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "CJY"),
    ("₽", "RUB"), ("₴", "UAH"), ("₹", "INR"), ("₩", "KRW"), ("₺", "TRY"), ("₫", "VND"), ("₪", "ILS"),
    ("USD", "USD"), ("EUR", "EUR"), ("GBP", "GBP"), ("RUB", "RUB"), ("UAH", "UAH"), ("BRL", "BRL"),
    ("JPY", "CJY"), ("CNY", "CJY"), ("PLN", "PLN"), ("CZK", "CZK"), ("SEK", "KR"), ("NOK", "KR"), ("DKK", "KR"),
    ("CHF", "CHF"), ("INR", "INR"), ("KRW", "KRW"), ("TRY", "TRY"), ("CAD", "CAD"), ("AUD", "AUD"),
]
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: (id, title, explanation) of what a report can hold. The ids are fixed values; the texts are this library's.
SARIF_RULES = [
    ("missing-key", "Not translated", "The language has no value under a key that its source file defines."),
    ("placeholder", "Different placeholders", "Source and translation do not name the same placeholders, so filling them in will fail or show them raw."),
    ("translation-fault", "Broken translation", "The value contradicts its source in a way that can be proven: other numbers or currencies, lost tags or terms, plural forms that the language needs, damaged escapes or messages."),
    ("translation-warning", "Doubtful translation", "The value may be right but should be read by a person: it looks untranslated, is much longer than usual, mixes forms of address, or differs from how the same text is translated elsewhere."),
    ("extra-key", "Unknown key", "The translation defines a key that its source file does not have."),
]


def literal_map(table: dict) -> Column:
    """A table as a map literal, which Catalyst folds."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])
