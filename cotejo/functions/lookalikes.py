"""Characters that look the same, by rule where Unicode has one and as a plain list where it has none."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic, Greek, Armenian, Cherokee and other letters drawn as the Latin letter under them.
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХԜԚѴаеѕіјорсухһԁԛԝӏѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοιανρυγϲϳՕօսհցզᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃıɡɑ"
LOOKALIKE_INTO = "ABESIJKMHOPCTYXWQVaesijopcyxhdqwlvABEZHIKMNOPTYXCJoiavpuycjOouhgqABCDEGHJKLMPRSTVWZiga"

#: Characters that draw nothing in Latin text.
INVISIBLE_RANGES = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x180B, 0x180E), (0x200B, 0x200F),
                    (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))


@lru_cache(1)
def invisible() -> str:
    return "".join(chr(c) for a, b in INVISIBLE_RANGES for c in range(a, b + 1))


@lru_cache(1)
def one_to_one() -> dict[str, str]:
    """Single characters that become another single character."""
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {chr(c): " " for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"}
    pairs |= dict(zip(LOOKALIKE_FROM, LOOKALIKE_INTO, strict=True))
    pairs |= {c: n for c in map(chr, range(0xFFE0, 0xFFE7)) if len(n := unicodedata.normalize("NFKC", c)) == 1}
    return pairs


@lru_cache(1)
def expansions() -> dict[str, str]:
    """Single characters that become several: the Latin ligatures."""
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}


@lru_cache(1)
def styled() -> dict[str, str]:
    """Letters and digits of another style (mathematical bold, script, double-struck and so on) and Roman numerals, by
    Unicode's own compatibility, with look-alikes of what they stand for."""
    single, out = one_to_one(), {}
    for code in (*range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0x2160, 0x2180)):
        char, kind = chr(code), unicodedata.decomposition(chr(code))
        if kind.startswith("<font>") or (code >= 0x2160 and kind.startswith("<compat>")):
            out[char] = "".join(single.get(c, c) for c in unicodedata.normalize("NFKC", char))
    return out


@lru_cache(1 << 16)
def script(letter: str) -> str:
    """The script that a letter's Unicode name begins with."""
    return unicodedata.name(letter, "").split(" ")[0]


@lru_cache(1)
def into_script() -> dict[str, dict[str, str]]:
    """For each script the Latin letters that it has look-alikes of."""
    out: dict[str, dict[str, str]] = {}
    for own, latin in zip(LOOKALIKE_FROM, LOOKALIKE_INTO, strict=True):
        if script(own) != "LATIN":
            out.setdefault(script(own), {}).setdefault(latin, own)
    return out


@lru_cache(1)
def _combining() -> dict[str, str]:
    """Letter and one of the marks of western European writing, in two code points, to its composed form."""
    letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    both = {b + m: unicodedata.normalize("NFC", b + m) for b in letters for m in "̧̀́̂̃̈̊"}
    return {k: v for k, v in both.items() if len(v) == 1}


def fold_sql(text: Column) -> Column:
    """JVM-side folding for parsers: widths, spaces, invisible characters, look-alike letters, ligatures; accents
    stay, as combining marks are composed for western European letters. Null gives null, empty gives empty."""
    pairs = one_to_one()
    out = F.translate(text, "".join(pairs) + invisible(), "".join(pairs.values()))
    for one, several in expansions().items():
        out = F.replace(out, F.lit(one), F.lit(several))
    marked = out
    for two, one in _combining().items():
        if one in "áéíóúñüçàèòïÁÉÍÓÚÑÜÇÀÈÒÏ":
            marked = F.replace(marked, F.lit(two), F.lit(one))
    folded = F.when(out.rlike(r"\p{Mn}"), marked).otherwise(out)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)  # ASCII has nothing to fold
