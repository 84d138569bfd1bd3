"""Listings of one product (problem 4): identifiers and attributes read and normalized, reliable keys, guarded components.

Standard article numbers are taken from the text where their check digit holds, part numbers where letters and digits make
one code. A listing is reduced to kind of goods, maker, range name, variety and net content. Kinds and varieties come from a
vocabulary, which is a parameter; everything else is learned from the corpus: words that many makers of a kind use are
common words and no range names, misspelt words and makers go to the frequent spelling within two edits, and attributes
that a listing leaves out are filled if the other listings of its range allow one value; a content may follow from price
and unit price. Goods that the vocabulary doesn't know are told apart by all of their words. Rows are then joined on their
keys (article number, maker and part number, seller's listing id, full attribute key) and components are formed over keys;
components that hold different goods are cut at their weakest links. All steps are joins and aggregates on keys, with hot
keys spread by load; nothing is collected but what the vocabulary bounds."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.bktree import SHORT_FORMS, brand_key, damerau
from cotejo.llm.canon import transducer
from cotejo.operators.skew import fragment_replicate_join
from cotejo.operators.units import UNITS, with_unit_prices
from cotejo.session import cut, release

#: The vocabulary used if none is given: Spanish groceries.
VOCABULARY = os.path.join(os.path.dirname(__file__), "groceries_es.json")
_AD = re.compile(r"2 ?[ªa] unidad al 50 ?%|promocion 3 ?x ?2|[¡!]")
_HINT = re.compile(r"[\[(]?(?:- ?)?(?:precio ?(?:referido a|por|/)|p\. ?v\. ?p\. ?(?:por|/)|€ ?(?:por|/)) ?(?:\d+ ?/ ?\d+ ?|½ ?|medio |cuarto de |\d+ ?)?[a-z]+\.?[\])]?")
_UNIT = {alias: (base, factor) for alias, base, factor, _ in UNITS}
_MEASURES = "|".join(sorted((a for a, (b, _) in _UNIT.items() if b != "ud"), key=len, reverse=True))
_PIECES = r"(?:unidades|unidad|unds?|uds?|u)\.?"
_CONTENT = re.compile(rf"(?:(?:pack|lote|caja|estuche)(?: de)? )?(?:(\d+) ?(?:x ?|(?:{_PIECES} ?)?(?:- ?|de )|{_PIECES} ))?(\d+ ?/ ?\d+|½|medio|cuarto de|\d+(?:[.,]\d+)?) ?({_MEASURES})\b\.?")
_COUNT = re.compile(rf"(\d+) ?(docenas?|dz|{_PIECES})(?!\w)|(media) docena|(?:pack|lote|caja|estuche)(?: de)? (\d+)(?: ?{_PIECES})?|(?<!\w)x ?(\d+)(?!\d)")
_FRACTIONS = {"½": 0.5, "medio": 0.5, "cuarto de": 0.25}
_WORD = re.compile(r"[^\W\d_]+")
_INNER_SIGN = re.compile(r"(?<=[^\W\d_]{2})[-.·'](?=[^\W\d_]{2})")
_DOUBLED = re.compile(r"(.)\1+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: A part number: letters, then at least two digits, in one code of at least five signs that - . / may divide.
_PART = re.compile(r"(?<![\w./-])[a-z]{1,6}[-./]?\d{2,}(?:[-./]?[a-z0-9]+)*(?![\w])")
PART_SIGNS = 5
#: Letters of a word that each edit needs, and how many times more frequent the spelling must be that it goes to.
LETTERS_PER_EDIT, DOMINANCE = 4, 4
#: Up to so many letters, words within two edits are found by the words that deletions leave; longer ones by their fifths.
DELETION_LETTERS = 40
#: A word is common, and names no range, if this share of its kind's makers use it, and at least so many.
COMMON_SHARE, COMMON_MAKERS = 0.05, 3
#: A word is advertising if it stands with this share of the kinds (where there are so many of them) and in this share of all rows.
SPREAD_SHARE, SPREAD_KINDS, SPREAD_ROWS = 0.5, 4, 0.001
#: Common words that each hold more than this part of all words are left out before words travel.
MANY_TOKENS = 20_000
#: Least relative error allowed to a content that follows from price and unit price.
TOLERANCE = 0.025
_LOG_STEP = 0.05


@dataclass(frozen=True)
class Vocabulary:
    """``ranks``: whole words and word beginnings by kind, the first rank that occurs counts; ``varieties``: name and
    pattern; ``kind_of_variety``: varieties that are a kind if nothing else is."""

    ranks: tuple[tuple[dict, tuple[tuple[str, str], ...]], ...]
    varieties: tuple[tuple[str, str], ...]
    kind_of_variety: tuple[str, ...]

    @staticmethod
    def of(document: dict) -> Vocabulary:
        ranks = []
        for kinds in document["kinds"]:
            words = [(w, k) for k, ws in kinds.items() for w in ws]
            ranks.append(({w: k for w, k in words if w[-1] != "-"}, tuple((w[:-1], k) for w, k in words if w[-1] == "-")))
        return Vocabulary(tuple(ranks), tuple(document["varieties"].items()), tuple(document["kind_of_variety"]))


def read_vocabulary(path: str = VOCABULARY) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def fold(text: str) -> str:
    """One visual form, lower case, no accents, single spaces."""
    text = transducer()(text).lower()
    if not text.isascii():
        flat = unicodedata.normalize("NFKD", text.replace("½", "\0"))
        text = "".join(c for c in flat if not unicodedata.combining(c)).replace("\0", "½")
    return " ".join(text.split())


def gtins(text: str) -> list[str]:
    """The article numbers (GTIN-8, 12, 13 or 14) whose check digit holds, as 14 digits; all-zero numbers don't."""
    found = []
    for digits in re.findall(r"(?<![\d.,])\d(?:[ -]?\d){7,13}(?![\d.,])", text):
        code = re.sub(r"\D", "", digits)
        if len(code) in (8, 12, 13, 14) and int(code):
            code = code.zfill(14)
            if sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(code)) % 10 == 0 and code not in found:
                found.append(code)
    return found


def part_numbers(text: str) -> list[str]:
    """Codes of letters and digits, without their signs: ``hp-457-d`` and ``hp457d`` are one."""
    codes = (re.sub(r"[-./]", "", m[0]) for m in _PART.finditer(text))
    return list(dict.fromkeys(c for c in codes if len(c) >= PART_SIGNS))


def read_content(text: str) -> tuple[str | None, str]:
    """(content, text without it): ``base:pieces:thousandths``, such as ``l:6:330``; pieces of goods as ``ud:1:12``."""
    if m := _CONTENT.search(text):
        amount = m[2].replace(" ", "")
        if "/" in amount:
            over, under = amount.split("/")
            value = int(over) / int(under) if int(under) else 0
        else:
            value = _FRACTIONS.get(m[2]) or float(amount.replace(",", "."))
        base, factor = _UNIT[m[3]]
        if value:
            return f"{base}:{int(m[1] or 1)}:{round(value * factor)}", text[: m.start()] + " " + text[m.end() :]
    if m := _COUNT.search(text):
        n = 6 if m[3] else int(m[1] or m[4] or m[5]) * (12 if m[2] and m[2].startswith("d") else 1)
        return f"ud:1:{n}", text[: m.start()] + " " + text[m.end() :]
    return None, text


class Reader:
    """Takes listings apart by one vocabulary; compiled once per worker."""

    def __init__(self, vocabulary: Vocabulary, sellers: tuple[str, ...]) -> None:
        self.vocabulary = vocabulary
        self.sellers = {brand_key(s) for s in sellers}
        self.names = [name for name, _ in vocabulary.varieties]
        # one pass over the text: at each place the first variety of the vocabulary's order
        self.varieties = re.compile(r"(?<![\w/])(?:" + ("|".join(f"(?P<v{i}>(?:{p})(?!\\w))" for i, (_, p) in enumerate(vocabulary.varieties)) or "(?!)") + ")")
        self.kind_of = lru_cache(1 << 16)(self._kind_of)
        self.maker_of = lru_cache(1 << 14)(self._maker_of)

    def _kind_of(self, word: str) -> tuple[int, str] | None:
        """(rank, kind) of a word."""
        for rank, (exact, starts) in enumerate(self.vocabulary.ranks):
            kind = exact.get(word) or next((k for w, k in starts if word.startswith(w)), None)
            if kind:
                return rank, kind
        return None

    def _maker_of(self, brand: str) -> tuple[str, tuple[str, ...]]:
        """(key, words) of a brand field; a seller's name is no maker."""
        key = brand_key(brand)
        return "" if key in self.sellers else key, tuple(w for w in (SHORT_FORMS.get(w, w) for w in _WORD.findall(fold(brand))) if len(w) > 2)

    @staticmethod
    def owned(word: str, maker: str, own: tuple[str, ...]) -> bool:
        """Whether a word of the text is one of the brand field's, misspelt as it may be."""
        for x in own:
            if word == x:
                return True
            if len(word) >= 5 and len(x) >= 5 and abs(len(word) - len(x)) <= 2 and len(set(word) ^ set(x)) <= 4 and within_edits(word, x, 1 if len(x) < 6 else 2):
                return True
        return len(word) >= 5 and word in maker

    def read(self, description: str | None, brand: str | None) -> tuple:
        """(gtins, parts, kind, variety, content, maker key, candidate words, neighbours joined, brand's words, numbers)."""
        text = fold(description or "")
        codes = gtins(text) if len(text) > 7 else []
        text = _HINT.sub(" ", _AD.sub(" ", text))
        content, text = read_content(text)
        parts = part_numbers(text)
        found: dict[str, None] = {}
        text = self.varieties.sub(lambda m: found.setdefault(self.names[int(m.lastgroup[1:])]) or " ", text)
        names = list(found)
        words = _WORD.findall(_INNER_SIGN.sub("", text))
        means = [self.kind_of(w) for w in words]
        kind = min(((m[0], i, m[1]) for i, m in enumerate(means) if m), default=(0, 0, ""))[2]
        if not kind:
            kind = next((n for n in names if n in self.vocabulary.kind_of_variety), "")
            names = [n for n in names if n != kind]
        maker, own = self.maker_of(brand) if brand else ("", ())
        free = [m is None and not self.owned(w, maker, own) for w, m in zip(words, means)]
        # a name may be broken in two: neighbours of which neither means a kind are also tried together
        joined = [a + b for i, (a, b) in enumerate(zip(words, words[1:])) if means[i] is None and means[i + 1] is None and (free[i] or free[i + 1]) and not self.owned(a + b, maker, own)]
        single = lambda ws: list(dict.fromkeys(_DOUBLED.sub(r"\1", w) for w in ws))  # noqa: E731 - doubled letters are a common slip
        numbers = sorted(set(_NUMBER.findall(text))) if not kind else []
        return codes, parts, kind, "+".join(sorted(names)), content, maker, single(w for w, f in zip(words, free) if f), single(joined), single(own), numbers


_LISTING = "struct<gtins:array<string>,parts:array<string>,kind:string,variety:string,content:string,maker:string,words:array<string>,joins:array<string>,own:array<string>,numbers:array<string>>"


@lru_cache(4)
def _reader(vocabulary: str, sellers: tuple[str, ...]) -> Reader:
    return Reader(Vocabulary.of(json.loads(vocabulary)), sellers)


def deletions(word: str, edits: int) -> list[str]:
    """The word and all it becomes by leaving out up to ``edits`` letters; two words within that many edits share one."""
    return list({"".join(c for i, c in enumerate(word) if i not in gone) for n in range(edits + 1) for gone in combinations(range(len(word)), n)})


def signatures(word: str) -> list[str]:
    """Texts of which two words within their edits share at least one. Of the fifths of a long word two edits, also swaps
    across a border, touch four at most; the one that stays is two places aside at most."""
    if len(word) <= DELETION_LETTERS - 2:
        return deletions(word, min(2, len(word) // LETTERS_PER_EDIT))
    out = set()
    for length in range(len(word) - 2, len(word) + 3):
        for i in range(5):
            start, end = length * i // 5, length * (i + 1) // 5
            out |= {f"{length}/{i}/{word[max(0, start + shift) : end + shift]}" for shift in range(-2, 3)}
    return list(out | (set(deletions(word, 2)) if len(word) <= DELETION_LETTERS + 2 else set()))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether insertions, deletions, replacements and swaps of neighbours, ``most`` at most, make one of the other. Equal
    ends are left aside; of the rest only the diagonals that so few edits reach are looked at."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= most:
        return True
    if max(len(a), len(b)) <= 24:
        return damerau(a, b) <= most
    rows = [{k: k for k in range(most + 1)}]
    for x in range(1, len(a) + 1):
        row = {}
        for y in range(max(0, x - most), min(len(b), x + most) + 1):
            best = min(rows[-1].get(y, most + 1), row.get(y - 1, most + 1)) + 1
            if y:
                best = min(best, rows[-1].get(y - 1, most + 1) + (a[x - 1] != b[y - 1]))
                if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                    best = min(best, rows[-2].get(y - 2, most + 1) + 1)
            row[y] = best
        if min(row.values()) > most:
            return False
        rows = [rows[-1], row]
    return rows[-1][len(b)] <= most


def merge_spellings(words: DataFrame, dominance: int = DOMINANCE, nearest: bool = True) -> DataFrame:
    """``block, word, target`` for the words of ``block, word, n`` that are a rare spelling of a frequent one: within
    one edit per four letters, two at most, and at least ``dominance`` times rarer (of equally frequent words the smaller
    is the target). Of several targets the ``nearest`` or else the most frequent, then the smaller word. Words of any
    length take part; only words frequent enough to be a target are looked up as one."""

    @F.pandas_udf("array<string>")
    def near(batch: pd.Series) -> pd.Series:
        return batch.map(signatures)

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        edits = lambda x, y: 1 if within_edits(x, y, 1) else 2 if within_edits(x, y, 2) else 3
        return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    parts = words.where(F.length("word") >= LETTERS_PER_EDIT).select("block", "word", "n", F.explode(near(F.col("word"))).alias("part"))
    left = parts.select("block", "part", "word", "n")
    right = parts.where(F.col("n") >= dominance).select("block", "part", F.col("word").alias("target"), F.col("n").alias("m"))
    pairs = left.join(right, ["block", "part"]).where((F.col("m") >= dominance * F.col("n")) & ((F.col("m") > F.col("n")) | (F.col("target") < F.col("word")))).select("block", "word", "target", "m").distinct()
    pairs = pairs.withColumn("edits", distance(F.col("word"), F.col("target"))).where(F.col("edits") <= F.least(F.lit(2), F.floor(F.length("word") / LETTERS_PER_EDIT)))
    less = (-F.col("m")).alias("m")
    best = pairs.groupBy("block", "word").agg(F.min(F.struct(*(["edits", less] if nearest else [less, "edits"]), "target")).alias("b"))
    return best.select("block", "word", F.col("b.target").alias("target"))


def _key(*columns: str) -> Column:
    """One text of several columns that aren't null, in which none of them can run into another."""
    return F.concat_ws("\x01", *columns)


def _told(column: str) -> list[Column]:
    """Least and greatest value that isn't missing."""
    some = F.nullif(F.col(column), F.lit(""))
    return [F.min(some).alias(f"{column}_lo"), F.max(some).alias(f"{column}_hi")]


def _fill(column: str) -> Column:
    """The column, or the one value that its group allows."""
    return F.coalesce(F.nullif(column, F.lit("")), F.when(F.col(f"{column}_lo") == F.col(f"{column}_hi"), F.col(f"{column}_lo")), F.lit(""))


def read_listings(df: DataFrame, row: str, vocabulary: str, sellers: tuple[str, ...]) -> DataFrame:
    """``row, listing``, what ``Reader.read`` finds, ``base, price_cents, unit_cents``."""

    @F.pandas_udf(_LISTING)
    def read(description: pd.Series, brand: pd.Series) -> pd.DataFrame:
        reader = _reader(vocabulary, sellers)
        rows = [reader.read(d, b) for d, b in zip(description, brand, strict=True)]
        return pd.DataFrame(rows, columns=["gtins", "parts", "kind", "variety", "content", "maker", "words", "joins", "own", "numbers"])

    rows = df.select(F.col(row).alias("row"), F.nullif(F.btrim("id"), F.lit("")).alias("listing"), "description", "brand", "price", "unit_price")
    priced = with_unit_prices(rows, "unit_price", "price", ["description"])
    sure = (F.col("price_cents") > 0) & (F.col("unit_cents") > 0)
    prices = [F.when(sure, F.col(c)).alias(c) for c in ("price_cents", "unit_cents")]
    return priced.withColumn("x", read("description", "brand")).select("row", "listing", "x.*", F.col("base_unit").alias("base"), *prices)


def _range_names(rows: DataFrame) -> DataFrame:
    """``row, range_name, text_maker, all_words``: of the words that are neither the maker's nor common in the kind, the one
    that fewest makers use; the maker whose words stand in the text of a row without brand; and, for goods that the
    vocabulary doesn't know, all words and numbers but advertising."""
    # the makers' own words: those of the brand fields of their rows
    own = rows.where("maker <> ''").select("maker", F.explode("own").alias("word")).groupBy("maker", "word").agg(F.count("*").alias("n"))
    own = own.groupBy("word").agg(F.sum("n").alias("n_own"), F.max("n").alias("most"), F.max_by("maker", F.struct("n", "maker")).alias("word_maker"))
    own = own.withColumn("word_maker", F.when(F.col("most") >= F.col("n_own") / 2, F.col("word_maker"))).drop("most")  # a word of many makers names none
    use = rows.select("kind", "maker", F.explode("words").alias("word")).groupBy("kind", "word", "maker").agg(F.count("*").alias("n"))
    use = use.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.count_if(F.col("maker") != "").alias("makers"))
    kinds = F.broadcast(rows.where("maker <> ''").groupBy("kind").agg(F.count_distinct("maker").alias("of_kind")))  # the vocabulary's kinds
    all_kinds = F.broadcast(rows.where("kind <> ''").agg(F.count_distinct("kind").alias("all_kinds"), F.count("*").alias("all_rows")))  # one row
    wide = use.where("kind <> ''").groupBy("word").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n")).crossJoin(all_kinds)
    wide = wide.where((F.col("all_kinds") >= SPREAD_KINDS) & (F.col("kinds") >= SPREAD_SHARE * F.col("all_kinds")) & (F.col("all_n") >= SPREAD_ROWS * F.col("all_rows"))).select("word", F.lit(True).alias("wide"))
    use = use.join(kinds, "kind", "left").join(wide, "word", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    by_many = F.col("makers") >= F.greatest(F.lit(COMMON_MAKERS), COMMON_SHARE * F.coalesce("of_kind", F.lit(0)))
    use = cut(use.withColumn("common", by_many | F.col("wide")).drop("of_kind"))
    target = merge_spellings(use.where("not common").select(F.col("kind").alias("block"), "word", "n")).select(F.col("block").alias("kind"), "word", "target")
    goes = use.select("kind", F.col("word").alias("target"), F.col("n").alias("n_target"), F.col("makers").alias("makers_target"))
    words = use.join(target.join(goes, ["kind", "target"]), ["kind", "word"], "left").join(own, "word", "left")
    foreign = F.coalesce((F.col("n_own") >= 2) & (F.col("n_own") >= F.col("n") / 2), F.lit(False))
    words = words.select(
        "kind", "word", "n", F.coalesce("target", "word").alias("name"), F.coalesce("n_target", "n").alias("names"), F.coalesce("makers_target", "makers").alias("by"),
        "common", foreign.alias("foreign"), "n_own", "word_maker",
    )
    words = cut(words)
    # the common words that hold many tokens never travel: at most MANY_TOKENS pairs, as each holds that part of all
    total = F.broadcast(words.agg(F.sum("n").alias("all")))  # one row
    many = words.crossJoin(total).where("common and not foreign").where(F.col("n") * MANY_TOKENS >= F.col("all")).select("kind", "word")
    both = F.concat(F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(False).alias("joined"))), F.transform("joins", lambda w: F.struct(w.alias("word"), F.lit(True).alias("joined"))))
    tokens = rows.select("row", "kind", (F.col("maker") == "").alias("open"), F.explode(both).alias("t")).select("row", "kind", "open", "t.*")
    tokens = tokens.join(F.broadcast(many), ["kind", "word"], "left_anti").select("row", _key("kind", "word").alias("key"), "open", "joined")
    useful = words.where("not common or foreign").select(_key("kind", "word").alias("key"), "name", "names", "by", "common", "foreign", "n_own", "word_maker")
    found = fragment_replicate_join(tokens, useful, "key", F.col("row"))
    foreign = F.col("open") & F.col("foreign")
    rank = F.struct((F.length("name") > 2).alias("long"), "joined", (F.col("names") > 1).alias("again"), (-F.col("by")).alias("few"), "names", "name")
    picked = found.groupBy("row").agg(F.max(F.when(~foreign & ~F.col("common"), rank)).alias("r"), F.max(F.when(foreign & F.col("word_maker").isNotNull(), F.struct("n_own", "word_maker"))).alias("f"))
    names = cut(picked.select("row", F.col("r.name").alias("range_name"), F.col("f.word_maker").alias("text_maker")))
    spread = use.where("wide").select("word").distinct()
    other = rows.where("kind = ''").select("row", F.explode(F.array_union("words", "numbers")).alias("word")).join(spread, "word", "left_anti")
    other = other.groupBy("row").agg(F.sort_array(F.collect_set("word")).alias("all_words"))  # the words of one listing
    out = cut(names.join(other, "row", "full_outer"), before=names)
    release(use, words)
    return out


def attributes(df: DataFrame, row: str, vocabulary: dict | None = None, sellers: tuple[str, ...] = ()) -> DataFrame:
    """``row, listing, gtins, parts, kind, maker, range_name, variety, content, words, unclear`` of the listings, filled as
    far as certain; what is missing is empty. ``words`` are all words and numbers of goods that the vocabulary doesn't
    know."""
    read = cut(read_listings(df, row, json.dumps(read_vocabulary() if vocabulary is None else vocabulary), tuple(sellers)))
    counts = read.where("maker <> ''").groupBy(F.lit("").alias("block"), F.col("maker").alias("word")).agg(F.count("*").alias("n"))
    spelt = merge_spellings(counts, nearest=False).select(F.col("word").alias("maker"), "target")
    rows = cut(fragment_replicate_join(read, spelt, "maker", F.col("row"), "left").withColumn("maker", F.coalesce("target", "maker")).drop("target"), before=read)
    rows_named = rows.join(_range_names(rows), "row", "left").withColumns({"range_name": F.coalesce("range_name", F.lit("")), "maker": F.coalesce(F.nullif("maker", F.lit("")), "text_maker", F.lit(""))})
    columns = ["row", "listing", "gtins", "parts", "kind", "maker", "range_name", "variety", F.coalesce("content", F.lit("")).alias("content"), "base", "price_cents", "unit_cents"]
    rows = cut(rows_named.select(*columns, F.col("all_words").alias("words")), before=rows)
    # rows of one listing share what any of them tells
    shared = ["kind", "range_name", "maker", "variety", "content"]
    tells = rows.where("listing is not null").groupBy("listing").agg(F.count("*").alias("n"), *[x for c in shared for x in _told(c)]).where("n > 1").drop("n")
    filled = fragment_replicate_join(rows, tells, "listing", F.col("row"), "left")
    rows = cut(filled.withColumns({c: _fill(c) for c in shared}).select(*rows.columns), before=rows)
    rows = cut(_with_makers(rows), before=rows)
    rows = cut(_with_contents(rows), before=rows)
    # varieties that the range's other rows of one content allow; what stays open although others tell it can't be told
    known = ["kind", "range_name", "maker"]
    each = rows.where("range_name <> ''").groupBy(*known, "content").agg(*_told("variety"))
    whole = each.groupBy(*known).agg(F.max("variety_hi").alias("any_variety"))
    varied = each.join(whole, known).select(_key(*known, "content").alias("__k"), "variety_lo", "variety_hi", "any_variety")
    rows = fragment_replicate_join(rows.withColumn("__k", _key(*known, "content")), varied, "__k", F.col("row"), "left").withColumn("variety", _fill("variety"))
    unclear = ((F.col("maker") == "") & F.col("told").isNotNull()) | ((F.col("variety") == "") & F.col("any_variety").isNotNull())
    return rows.select("row", "listing", "gtins", "parts", *known, "variety", "content", "words", F.coalesce(unclear, F.lit(False)).alias("unclear"))


def _with_makers(rows: DataFrame) -> DataFrame:
    """Rows with kind and maker filled by their range: a kind that its maker's range has alone, makers of one range two
    edits apart as one, a maker that the range has alone; ``told`` is any maker of the range. All on distinct values."""
    named = rows.where("range_name <> ''").groupBy("kind", "range_name", "maker").agg(F.count("*").alias("n"))
    own = named.where("maker <> '' and kind <> ''").groupBy("range_name", "maker").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    named = named.join(own, ["range_name", "maker"], "left").withColumn("as_kind", F.when((F.col("kind") == "") & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("kind")))
    block = _key("as_kind", "range_name").alias("block")
    counts = named.where("maker <> ''").groupBy(block, F.col("maker").alias("word")).agg(F.sum("n").alias("n"))
    several = counts.groupBy("block").agg(F.count("*").alias("of")).where("of > 1").select("block")  # one maker has no other spelling
    counts = counts.join(several, "block", "left_semi")
    spelt = merge_spellings(counts, 1, nearest=False)
    named = named.withColumn("block", block).join(spelt.withColumnRenamed("word", "maker"), ["block", "maker"], "left").withColumn("as_maker", F.coalesce("target", "maker"))
    tells = named.groupBy("block").agg(F.min(F.nullif("as_maker", F.lit(""))).alias("lo_maker"), F.max(F.nullif("as_maker", F.lit(""))).alias("told"))
    named = named.join(tells, "block").withColumn("as_maker", F.when((F.col("as_maker") == "") & (F.col("lo_maker") == F.col("told")), F.col("told")).otherwise(F.col("as_maker")))
    change = named.select(_key("kind", "range_name", "maker").alias("__k"), "as_kind", "as_maker", "told")
    out = fragment_replicate_join(rows.withColumn("__k", _key("kind", "range_name", "maker")), change, "__k", F.col("row"), "left")
    return out.withColumns({"kind": F.coalesce("as_kind", "kind"), "maker": F.coalesce("as_maker", "maker")}).drop("__k", "as_kind", "as_maker")


def _with_contents(rows: DataFrame) -> DataFrame:
    """Contents of rows that don't name one: a content whose total is what price and unit price imply, first one of the
    same range and maker, else one of the same kind; of several the nearest in whole hundredths, then the most frequent.
    Worked out once for each distinct price; totals meet in narrow bands of their logarithms, not all with all."""
    total = lambda c: F.split_part(c, F.lit(":"), F.lit(2)).cast("double") * F.split_part(c, F.lit(":"), F.lit(3)).cast("double")
    known = ["kind", "range_name", "maker"]
    counts = rows.where("content <> ''").groupBy(*known, F.col("content").alias("c")).agg(F.count("*").alias("n"))
    counts = counts.withColumns({"total": F.when(F.col("c").startswith("ud"), total(F.col("c"))).otherwise(total(F.col("c")) / 1000), "base": F.split_part("c", F.lit(":"), F.lit(1))}).where("total > 0")
    counts = counts.withColumn("band", F.floor(F.log("total") / _LOG_STEP))
    lacking = F.col("content") == ""
    priced = rows.where(lacking & F.col("price_cents").isNotNull()).select(*known, "base", "price_cents", "unit_cents").distinct()
    implied = F.col("price_cents") / F.col("unit_cents")
    # both are rounded to whole cents
    slack = F.greatest(F.lit(TOLERANCE), 0.6 / F.col("price_cents") + 0.6 / F.col("unit_cents"))
    priced = priced.withColumns({"implied": implied, "slack": slack})
    edge = lambda by: F.floor(F.log(F.greatest(F.col("implied") * by, F.lit(1e-9))) / _LOG_STEP)
    bands = F.explode(F.sequence(edge(1 - F.least("slack", F.lit(0.99))), edge(1 + F.col("slack"))))
    tries = priced.withColumn("band", bands)
    error = F.abs(F.col("total") / F.col("implied") - 1)
    asked = [*known, "base", "price_cents", "unit_cents"]
    best = []
    for level, keys in enumerate((known, ["kind"])):
        offers = counts.groupBy(*keys, "base", "band", "c", "total").agg(F.sum("n").alias("n"))
        fits = tries.join(offers, [*keys, "base", "band"]).where(error <= F.col("slack"))
        best.append(fits.select(*asked, F.struct(F.lit(level).alias("level"), F.round(error, 2).alias("e"), (-F.col("n")).alias("n"), "c").alias("b")))
    # no listing of the kind names it: the total itself, to a fiftieth
    own = F.concat(F.col("base"), F.lit(":~:"), F.round(F.col("implied") * 50, 0).cast("long").cast("string"))
    none = F.struct(F.lit(2).alias("level"), F.lit(0.0).alias("e"), F.lit(0).cast("long").alias("n"), own.alias("c"))
    found = best[0].unionAll(best[1]).unionAll(priced.where("base is not null").select(*asked, none.alias("b"))).groupBy(*asked).agg(F.min("b").alias("b"))
    parts = [*known, "base", F.col("price_cents").cast("string"), F.col("unit_cents").cast("string")]
    found = found.select(_key(*parts).alias("__k"), F.col("b.c").alias("found"))
    open_ = fragment_replicate_join(rows.where(lacking).withColumn("__k", _key(*parts)), found, "__k", F.col("row"), "left")
    done = open_.withColumn("content", F.coalesce("found", F.lit(""))).drop("__k", "found")
    return rows.where(~lacking).select(*rows.columns).unionByName(done).drop("base", "price_cents", "unit_cents")


#: Links from the weakest to the strongest, as components of different goods are cut.
LINKS = ("listing", "part", "gtin")


def products(df: DataFrame, row: str, vocabulary: dict | None = None, sellers: tuple[str, ...] = ()) -> DataFrame:
    """``row, product`` for every listing: the component it belongs to. A listing that lacks kind, range name or content
    and has no reliable key shared with another is a product of its own; goods that the vocabulary doesn't know are one
    product if maker and all words and numbers agree. Null and empty texts, and ties, give no error; repeated rows of one
    listing id are one product.

    Keys are the full attribute key, article numbers, maker with part number, and the listing id. A key of the last
    three is no link if its rows have full attribute keys of different goods; a component in which different goods meet
    over several keys loses its listing links, then its part numbers, then its article numbers, until none do.
    """
    rows = attributes(df, row, vocabulary, sellers)
    known = (F.col("kind") != "") & (F.col("range_name") != "") & (F.col("content") != "") & ~F.col("unclear")
    other = (F.col("maker") != "") & (F.size("words") >= 2)
    full = F.when(known, F.concat(F.lit("a\x01"), _key("kind", "range_name", "maker", "variety", "content"))).when(other, F.concat(F.lit("b\x01"), _key("maker", "content", "variety", F.array_join("words", " "))))
    goods = F.when(known, _key("kind", "variety", "content"))
    parts = F.when(F.col("maker") != "", F.transform("parts", lambda p: F.concat(F.lit("part\x01"), p, F.lit("\x01"), F.col("maker"))))
    keys = F.concat(F.transform("gtins", lambda g: F.concat(F.lit("gtin\x01"), g)), F.coalesce(parts, F.array().cast("array<string>")), F.when(F.col("listing").isNotNull(), F.array(F.concat(F.lit("listing\x01"), F.col("listing")))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("row", full.alias("a"), goods.alias("goods"), F.when(known, F.nullif("maker", F.lit(""))).alias("maker"), keys.alias("keys"))
    node = F.coalesce("a", F.nullif(F.get(F.reverse("keys"), F.lit(0)), F.lit("")), F.concat(F.lit("row\x01"), F.col("row").cast("string")))
    rows = cut(rows.withColumn("node", node))
    # what is told about a node's goods, and its links: distinct values from here on
    nodes = rows.groupBy("node").agg(*_told("goods"), *_told("maker"))
    links = rows.select("node", F.explode("keys").alias("key")).distinct()
    sides = [F.min("goods_lo").alias("goods_lo"), F.max("goods_hi").alias("goods_hi"), F.min("maker_lo").alias("maker_lo"), F.max("maker_hi").alias("maker_hi")]
    differ = F.coalesce(F.col("goods_lo") != F.col("goods_hi"), F.lit(False)) | F.coalesce(F.col("maker_lo") != F.col("maker_hi"), F.lit(False))
    told = links.join(nodes, "node")
    joining = told.groupBy("key").agg(F.count("*").alias("n"), *sides).where(F.col("n") > 1).where(~differ).select("key")
    links = cut(told.join(joining, "key", "left_semi"))
    labels = components(links.select(F.col("key").alias("u"), F.col("node").alias("v")))
    for weak in LINKS:
        mixed = links.join(labels.withColumnRenamed("v", "node"), "node").groupBy("label").agg(*sides).where(differ).select("label")
        bad = cut(labels.join(mixed, "label", "left_semi").select(F.col("v").alias("node")))
        if bad.isEmpty():
            release(bad)
            break
        # only the components in which different goods meet are cut and labelled again
        dropped = links.join(bad, "node", "left_semi").where(F.col("key").startswith(f"{weak}\x01")).select("key", "node")
        links = cut(links.join(dropped, ["key", "node"], "left_anti"), before=links)
        again = components(links.join(bad, "node", "left_semi").select(F.col("key").alias("u"), F.col("node").alias("v")))
        kept = labels.join(bad.withColumnRenamed("node", "v"), "v", "left_anti")
        labels = cut(kept.unionByName(again), before=labels)
        release(bad, again)
    out = fragment_replicate_join(rows, labels.withColumnRenamed("v", "node"), "node", F.col("row"), "left")
    return out.select("row", F.coalesce("label", "node").alias("product"))


def components(links: DataFrame) -> DataFrame:
    """``v, label``: the smallest node reachable, for the nodes of bipartite links ``u, v``. The sides are apart: a key and a
    node may have one name. Each round takes the least label over every key, hands it to the node and to the node that was
    its label, and then goes on from label to label, so chains shorten by a factor and rounds grow with the logarithm of
    their length; a round is cut through storage and replaces the one before, until nothing changes."""
    links = cut(links.distinct())
    state = cut(links.select("v").distinct().withColumn("label", F.col("v")))
    if links.isEmpty():
        return state
    while True:
        over = links.join(state, "v").groupBy("u").agg(F.min("label").alias("new"))
        reached = links.join(over, "u").groupBy("v").agg(F.min("new").alias("new")).join(state, "v")
        hooks = reached.where(F.col("new") < F.col("label")).select(F.explode(F.array("v", "label")).alias("v"), "new").groupBy("v").agg(F.min("new").alias("new"))
        hooked = state.join(hooks, "v", "left").select("v", F.least("label", "new").alias("next"), F.col("new").isNotNull().alias("moved"))
        hooked = cut(hooked.select("v", "next", "moved"))
        if hooked.where("moved").isEmpty():
            release(hooked, links)
            return state
        jump = hooked.select(F.col("v").alias("next"), F.col("next").alias("further"))
        state = cut(hooked.join(jump, "next", "left").select("v", F.least("next", "further").alias("label")), before=state)
        release(hooked)


def same_product_pairs(df: DataFrame, row: str, vocabulary: dict | None = None, sellers: tuple[str, ...] = ()) -> DataFrame:
    """``<row>_a, <row>_b`` of every two rows of one product, the smaller first, as the task's result wants them. A product
    of very many rows is spread over tasks by its load."""
    of = products(df, row, vocabulary, sellers)
    size = of.groupBy("product").agg(F.count("*").alias("n")).where("n > 1").select("product")
    of = cut(of.join(size, "product", "left_semi"))
    a, b = of.select("product", F.col("row").alias(f"{row}_a")), of.select("product", F.col("row").alias(f"{row}_b"))
    pairs = fragment_replicate_join(a, b, "product", F.col(f"{row}_a"))
    return pairs.where(F.col(f"{row}_a") < F.col(f"{row}_b")).select(f"{row}_a", f"{row}_b")
