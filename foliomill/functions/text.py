"""Predicates, scores and types of text items, as native Column expressions.

Lengths are in UTF-8 bytes where a rule counts bytes and in code points where
it counts characters.  Ratios are single precision, so thresholds fall as they
do there.  Nulls give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_TEXT_BYTES = 2
MIN_TRANSLATION_BYTES = 3
CHINESE_SHARE = 0.5
SPECIAL_SHARE = 0.33
FUNCTIONAL_WORDS = ["ok", "yes", "no", "on", "off", "go", "up", "x", ">", "▶", "▲", "▼", "◀", "•"]
CJK = r"[\x{4e00}-\x{9fff}]"
KANA = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"
HANGUL = r"[\x{ac00}-\x{d7af}]"
CYRILLIC = r"[\x{0400}-\x{04ff}]"
SPECIAL = r"[{}\[\]();=<>/\\]"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
CSS_NAME = r"^[.#]?[a-zA-Z][a-zA-Z0-9_-]*(::[a-zA-Z][a-zA-Z0-9_-]*)?\z"
SYMBOLS = r"(?U)^[\p{N}\s!-/:-@\[-`{-~]*\z"


def _float(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def count(text: Column, pattern: str) -> Column:
    """Occurrences of a one-character pattern."""
    return F.regexp_count(text, F.lit(pattern))


def share(text: Column, pattern: str) -> Column:
    """Occurrences over characters, in single precision; 0 for the empty text."""
    length = F.char_length(text)
    return F.when(length == 0, _float(0.0)).otherwise((_float(count(text, pattern)) / _float(length)).cast("float"))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_url(text: Column) -> Column:
    return text.rlike("^(https?|ftp)://")


def is_email(text: Column) -> Column:
    return (F.octet_length(text) <= 100) & text.contains("@") & text.contains(".") & text.rlike(EMAIL)


def is_code_like(text: Column) -> Column:
    return _float(count(text, SPECIAL)) > _float(F.octet_length(text)) * _float(SPECIAL_SHARE)


def is_css_selector(text: Column) -> Column:
    return text.startswith(".") | text.startswith("#") | text.contains("::") | text.rlike(CSS_NAME)


def is_symbols(text: Column) -> Column:
    return text.rlike(SYMBOLS)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{IsAlphabetic}")


def is_chinese(text: Column) -> Column:
    return share(text, CJK) > _float(CHINESE_SHARE)


def is_functional(text: Column) -> Column:
    return F.lower(text).isin(FUNCTIONAL_WORDS)


def should_translate(text: Column) -> Column:
    """Long enough, no address, code, selector or number, with a letter, and not Chinese already."""
    t = trimmed(text)
    size = F.octet_length(t)
    rejected = is_url(t) | is_email(t) | is_code_like(t) | is_css_selector(t) | is_symbols(t) | ~has_letter(t) | is_chinese(t)
    return (size >= MIN_TEXT_BYTES) & ~rejected & ~((size < MIN_TRANSLATION_BYTES) & is_functional(t))


def filter_reason(text: Column) -> Column:
    """Why a text is left out, by the first rule that says so; null if none does."""
    t = trimmed(text)
    rules = [
        (F.octet_length(t) < MIN_TEXT_BYTES, "TooShort"),
        (is_chinese(t), "AlreadyChinese"),
        (~has_letter(t), "NoAlphabetic"),
        (is_url(t), "IsUrl"),
        (is_email(t), "IsEmail"),
        (is_code_like(t), "IsCodeLike"),
        (is_functional(t), "IsFunctional"),
        (is_css_selector(t), "IsCssSelector"),
        (is_symbols(t), "PureSymbols"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for rule, name in rules[1:]:
        out = out.when(rule, name)
    return out


def translatability(text: Column) -> Column:
    """A score from 0 to 1 in single precision."""
    t = trimmed(text)
    size = F.octet_length(t)
    score = F.when(size < MIN_TEXT_BYTES, _float(0.1)).when(size < MIN_TRANSLATION_BYTES, _float(0.5)).otherwise(_float(1.0))
    score = score * share(t, r"\p{IsAlphabetic}")
    score = score * F.greatest(_float(1.0) - share(t, CJK), _float(0.1))
    score = score * F.when(share(t, SPECIAL) > _float(SPECIAL_SHARE), _float(0.2)).otherwise(_float(1.0))
    score = score * F.when(is_functional(t), _float(0.1)).otherwise(_float(1.0))
    zero = (t == "") | is_url(t) | is_email(t)
    return F.when(zero, _float(0.0)).otherwise(F.greatest(_float(0.0), F.least(_float(1.0), score))).cast("float")


def language_hint(text: Column) -> Column:
    """A guess by scripts: the first whose share is large enough."""
    return (
        F.when(text == "", "Unknown")
        .when(share(text, CJK) > _float(0.3), "Chinese")
        .when(share(text, KANA) > _float(0.1), "Japanese")
        .when(share(text, HANGUL) > _float(0.3), "Korean")
        .when(share(text, "[A-Za-z]") > _float(0.5), "Latin")
        .when(text.isNotNull(), "Mixed")
    )


def analysis(text: Column) -> Column:
    """All of the above for one text, as a struct."""
    t = trimmed(text)
    return F.struct(
        text.alias("original_text"),
        t.alias("trimmed_text"),
        should_translate(text).alias("should_translate"),
        translatability(text).alias("score"),
        F.char_length(t).alias("char_count"),
        F.octet_length(t).alias("byte_count"),
        is_chinese(t).alias("is_chinese"),
        is_url(t).alias("is_url"),
        is_email(t).alias("is_email"),
        is_code_like(t).alias("is_code_like"),
        is_functional(t).alias("is_functional"),
        language_hint(t).alias("language_hint"),
    )


def priority(kind: Column, text: Column) -> Column:
    """0 (low) to 3 (critical) by the type of an item and, for content, its bytes."""
    size = F.octet_length(text)
    return (
        F.when(kind == "Title", 3)
        .when(kind.isin("Button", "Link", "FormLabel", "Tooltip"), 2)
        .when(kind == "ImageAlt", 1)
        .when(kind.startswith("Attribute"), 0)
        .when(size > 100, 2)
        .when(size > 20, 1)
        .otherwise(0)
    )


def complexity(text: Column, kind: Column, depth: Column, parent: Column) -> Column:
    """How hard an item is to translate: 0.5 to 3, 0 for an empty text; single precision, added up in order."""
    n = F.char_length(text)
    bonus = lambda when, value: F.when(when, _float(value)).otherwise(_float(0.0))
    by_kind = {"Title": 0.2, "Link": -0.1, "Button": -0.2, "FormLabel": -0.1, "ImageAlt": 0.1, "Tooltip": 0.1}
    typed = F.when(kind.startswith("Attribute"), _float(-0.2))
    for name, value in by_kind.items():
        typed = typed.when(kind == name, _float(value))
    tags = F.when(parent.isin("code", "pre"), _float(0.5)).when(parent.isin("script", "style"), _float(1.0)).when(parent.isin("table", "td", "th"), _float(0.2))
    tags = tags.when(parent.rlike("^h[1-6]\\z"), _float(0.1))
    parts = [
        F.when(n > 200, _float(0.5)).when(n < 10, _float(-0.2)).otherwise(_float(0.0)),
        bonus(share(text, ASCII_PUNCTUATION) > _float(0.15), 0.3),
        bonus(share(text, "[0-9]") > _float(0.1), 0.2),
        bonus(share(text, r"\p{IsUppercase}") > _float(0.2), 0.3),
        typed.otherwise(_float(0.0)),
        bonus(depth > 10, 0.1),
        tags.otherwise(_float(0.0)),
        bonus(text.contains("&") & (text.contains(";") | text.contains("#")), 0.3),
        bonus(text.contains("http") | text.contains("www.") | text.contains("@"), 0.2),
    ]
    total = _float(1.0)
    for p in parts:
        total = (total + p).cast("float")
    return F.when(n == 0, _float(0.0)).otherwise(F.least(F.greatest(total, _float(0.5)), _float(3.0)))


def effective_size(text: Column, kind: Column, depth: Column, parent: Column) -> Column:
    return (_float(F.char_length(text)) * complexity(text, kind, depth, parent)).cast("float")


def content_language(text: Column, default: str = "en") -> Column:
    """The language of shown content: the default under 10 UTF-16 units, else by the first script found."""
    units = F.char_length(text) + count(text, r"[\x{10000}-\x{10ffff}]")
    return (
        F.when(text.isNull() | (units < 10), default)
        .when(text.rlike(CJK), "zh")
        .when(text.rlike(KANA), "ja")
        .when(text.rlike(HANGUL), "ko")
        .when(text.rlike(CYRILLIC), "ru")
        .otherwise("en")
    )


def target_language(source: Column, browser: str = "en", default: str = "zh") -> Column:
    return F.when(source == "zh", "en" if browser == "zh" else browser).otherwise(default)


def translation_quality(original: Column, translated: Column) -> Column:
    """By the ratio of lengths: empty, incomplete, suspicious or pass."""
    a, b = F.coalesce(F.char_length(original), F.lit(0)), F.coalesce(F.char_length(translated), F.lit(0))
    ratio = F.try_divide(b, a)
    return F.when(b == 0, "empty").when(ratio < 0.3, "incomplete").when(ratio.isNull() | (ratio > 3.0), "suspicious").otherwise("pass")
