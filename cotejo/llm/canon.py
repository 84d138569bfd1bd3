"""Visually identical text in one consistent form (problem 5): a compiled longest-match transducer over grapheme clusters.

The mapping is precomputed: every letter that has look-alikes, with every mark of western European writing, maps to the
one composed form; wide forms, spaces, styled letters, ligatures and invisible characters map by the rules of
``lookalikes``. It is checked for conflicts (one input, two outputs) and for stability (an output that would be mapped
again). The compiled automaton reads a text once, taking the longest entry at each place; a text with marks or invisible
characters is read cluster by cluster instead, each as a whole. Texts without any entry aren't touched.

Script context: a word that only look-alike letters make up is Latin. A word with a letter that its script alone has
(``П`` in ``Привет``) and none that Latin alone has is of that script, and its Latin look-alikes become that script's
letters. A word with letters of both kinds takes the Latin form where there is one. The decision rests on letters that look
like no other, so all spellings of one look decide alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.lookalikes import expansions, into_script, invisible, one_to_one, script, styled
from cotejo.operators.skew import fragment_replicate_join
from cotejo.session import cut

#: Marks that compose with letters, by code point; clusters of one letter with one or two of them are in the table.
MARKS = [chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn" and chr(c) not in invisible()]
_COMMON = "̧̨̀́̂̃̄̆̈̊̌"


def build_mapping() -> dict[str, str]:
    """Clusters to their one form; raises ValueError on a conflict or an unstable output."""
    mapping: dict[str, str] = {}

    def add(key: str, value: str) -> None:
        if mapping.setdefault(key, value) != value:
            raise ValueError(f"two forms for {key!r}")

    single = one_to_one() | expansions() | styled()
    for char, form in single.items():
        add(char, form)
    letters = {c: c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()}
    letters |= {c: f for c, f in single.items() if len(f) == 1 and f.isalpha()}
    for char, base in letters.items():
        for mark in MARKS:
            add(char + mark, unicodedata.normalize("NFC", base + mark))
            if mark in _COMMON:
                for second in _COMMON:
                    add(char + mark + second, unicodedata.normalize("NFC", base + mark + second))
    for code in range(0xC0, 0x250):  # composed letters with a further mark
        if unicodedata.decomposition(chr(code)):
            for mark in _COMMON:
                add(chr(code) + mark, unicodedata.normalize("NFC", chr(code) + mark))
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):  # composed Greek and Cyrillic letters on look-alike bases
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in letters:
            add(chr(code), unicodedata.normalize("NFC", letters[parts[0]] + parts[1:]))
    for char in invisible():
        add(char, "")
    unstable = [k for k, v in mapping.items() if v != k and any(c in single for c in v)]
    if unstable:
        raise ValueError(f"forms that would change again: {unstable[:5]}")
    return mapping


class Transducer:
    """The compiled mapping. Invisible characters inside a cluster are skipped; a cluster that isn't in the table keeps its
    marks in canonical order on its mapped letter."""

    def __init__(self, mapping: dict[str, str] | None = None) -> None:
        self.mapping = build_mapping() if mapping is None else mapping
        self.automaton = ahocorasick.Automaton()
        for key, value in self.mapping.items():
            if key != value:
                self.automaton.add_word(key, (len(key), value))
        self.automaton.make_automaton()
        marks, hidden = "".join(MARKS), "".join(regex.escape(c) for c in invisible())
        firsts = "".join(sorted({regex.escape(k) for k in self.mapping if len(k) == 1 and self.mapping[k] != k}))
        self.hidden = frozenset(invisible())
        self.touched = regex.compile(rf"[{firsts}{marks}{hidden}]|\p{{M}}|[\u1100-\u11ff]")
        self.clustered = regex.compile(rf"[{hidden}\u1100-\u11ff]|\p{{M}}")
        # a base with all marks and invisible characters after it; conjoining Korean letters
        self.clusters = regex.compile(rf"[\u1100-\u11ff\uac00-\ud7a3][\u1100-\u11ff\p{{M}}{hidden}]*|\P{{M}}[\p{{M}}{hidden}]*|[\p{{M}}{hidden}]+")
        self.foreign = regex.compile(r"[^\p{Latin}\p{Common}\p{Inherited}]")
        self.word = regex.compile(r"[\p{L}\p{M}]+")
        self.cluster = lru_cache(1 << 16)(self._cluster)

    def _cluster(self, cluster: str) -> str:
        shown = "".join(c for c in cluster if c not in self.hidden)
        form = self.mapping.get(shown)
        if form is None and shown:
            form = unicodedata.normalize("NFC", self.mapping.get(shown[0], shown[0]) + shown[1:])
            form = form if len(shown) == 1 else "".join(self.mapping.get(c, c) for c in form)
        return form or ""

    @staticmethod
    def _in_script(match: regex.Match) -> str:
        """A Latin-mapped word in the script that only some of its letters belong to, if its other letters allow it."""
        word = match[0]
        parts = unicodedata.normalize("NFD", word)
        scripts = {script(c) for c in parts if c.isalpha()} - {"LATIN"}
        if len(scripts) != 1:
            return word
        back = into_script().get(scripts.pop())
        if back is None or any(script(c) == "LATIN" and c not in back for c in parts if c.isalpha()):
            return word
        return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in parts))

    def __call__(self, text: str | None) -> str | None:
        """The one form of a text; null stays null, empty stays empty. Ordinary spaces, case, accents and punctuation
        stay as they are."""
        if text is None or text.isascii():
            return text
        done = text
        if self.clustered.search(text):
            done = "".join(map(self.cluster, self.clusters.findall(text)))
        elif self.touched.search(text):
            out, last = [], 0
            for end, (length, value) in self.automaton.iter_long(text):
                start = end - length + 1
                if start > last:
                    out.append(text[last:start])
                out.append(value)
                last = end + 1
            out.append(text[last:])
            done = "".join(out)
        return self.word.sub(self._in_script, done) if self.foreign.search(done) else done


@lru_cache(1)
def transducer() -> Transducer:
    """Compiled once per Python worker."""
    return Transducer()


def canonical(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        change = transducer()
        for batch in batches:
            yield batch.map(lambda t: change(t) if isinstance(t, str) else None)

    return run(text)


def canonical_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their one form; all other columns as they are."""
    return df.withColumns({c: canonical(F.col(c)) for c in columns})


def lookalike_pairs(df: DataFrame, row: str, key: str, columns: list[str]) -> DataFrame:
    """``<row>_a, <row>_b, field_name``: rows of one key whose values of a column differ but have one form.

    Null keys, and values that are null or blank in their form, take no part; equal values give no pair. Forms are made
    once for each distinct value that has a second spelling under its key, spellings are paired as values, and only then
    do rows join them, so repeated equal rows never meet. The pairs asked for are the only ones made; a key of very many
    rows is spread by its load.
    """
    pieces = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns])).alias("x")
    rows = df.where(F.col(key).isNotNull()).select(F.col(row).alias("row"), F.col(key).alias("key"), pieces).select("row", "key", "x.*")
    rows = rows.where(F.col("value").rlike(r"\S"))
    group = ["key", "field_name"]
    several = rows.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*group)
    # rows and spellings of the groups that have more than one, written once
    rows = cut(rows.join(several, group, "left_semi"))
    forms = cut(rows.select(*group, "value").distinct().withColumn("form", canonical(F.col("value"))).where(F.col("form").rlike(r"\S")))
    a, b = (forms.select(*group, "form", F.col("value").alias(v)) for v in ("one", "other"))
    spellings = a.join(b, [*group, "form"]).where("one <> other").select(*group, F.col("one").alias("value"), "other")
    # every row of a spelling with the other spellings, then with their rows; each pair comes from both of its sides
    at = lambda value: F.concat_ws("\x01", "key", "field_name", value)
    seen = rows.join(spellings.select(*group, "value").distinct(), [*group, "value"], "left_semi")
    first = fragment_replicate_join(seen.select(F.col("row").alias("one_row"), "field_name", at("value").alias("at")), spellings.select(at("value").alias("at"), at("other").alias("to")), "at", F.col("one_row"))
    second = seen.select(at("value").alias("to"), F.col("row").alias("other_row"))
    pairs = fragment_replicate_join(first.select("one_row", "field_name", "to"), second, "to", F.col("one_row")).where("one_row < other_row")
    return pairs.select(F.col("one_row").alias(f"{row}_a"), F.col("other_row").alias(f"{row}_b"), "field_name")
