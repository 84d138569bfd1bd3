"""Text normalization (P1-P4, P11, P26, P30, P31) as JVM-side expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``\s`` sees it, in Java's regular expressions.
_SPACE = r"\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@lru_cache(1)
def _accent_table() -> tuple[str, str]:
    """BMP characters whose decomposition without marks is one BMP character, by rule."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1 and ord(base) < 0x10000:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    """Letters without their marks. Hangul syllables stay composed."""
    return F.regexp_replace(F.translate(text, *_accent_table()), r"\p{Mn}+", "")


def normalize(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower case, no accents, no punctuation, no token with a digit, single spaces. Null and empty give empty.

    ``stopwords`` (off by default) are dropped after that.
    """
    out = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{_SPACE}]", "")
    out = F.regexp_replace(out, rf"[{_SPACE}]+", " ")
    # tried once per token, at its start; possessive, so a token without digit is read once
    out = F.regexp_replace(out, r"(?<![^ ])[^ \p{Nd}]*+\p{Nd}[^ ]*+", "")
    out = F.trim(F.regexp_replace(out, " {2,}", " "))
    if stopwords:
        drop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
        out = F.array_join(F.filter(F.split(out, " "), lambda w: ~F.array_contains(drop, w)), " ")
    return out


def normalize_all(texts: Column) -> Column:
    """Each text of an array normalized."""
    return F.transform(texts, lambda t: normalize(t))


def slug(category: Column) -> Column:
    """Breadcrumb or free category as a slug of ``a-z0-9/-``; null stays null."""
    out = strip_accents(F.lower(category))
    out = F.regexp_replace(F.replace(out, F.lit(" > "), F.lit("/")), rf"[{_SPACE}_]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9/-]", ""), "-+", "-")
    return F.btrim(F.btrim(out, F.lit("-")), F.lit("/"))


def category_key(category: Column) -> Column:
    return F.replace(normalize(category), F.lit(" "), F.lit(""))


def strip_accents_deep(column: Column, kind: T.DataType) -> Column:
    """Accents removed from every string inside arrays, structs and map values; field names and keys stay."""
    if isinstance(kind, T.StringType):
        return strip_accents(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: strip_accents_deep(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = [strip_accents_deep(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: strip_accents_deep(v, kind.valueType))
    return column


def encoder_prefix(text: Column, role: str) -> Column:
    """``query: `` or ``passage: `` before a text, as two-sided encoders expect."""
    return F.concat(F.lit(f"{role}: "), text)


#: Short Spanish function words; single letters are added by rule. Off unless passed to ``normalize``.
STOPWORDS_ES = "a al algo como con de del desde donde el ella en entre era es esa ese esta este la las lo los mas muy no o para pero por que se sin sobre su sus tambien un una uno unos y ya".split()


def stopwords(extra: list[str] | None = None) -> list[str]:
    return sorted({*STOPWORDS_ES, *(w.lower() for w in extra or []), *(chr(c) for c in range(97, 123))})
