"""Per-document text statistics and text types (problem 10).

All statistics are JVM-side expressions over whole texts. Thresholds on them are noisy labelling functions that vote for
a type or abstain; expectation-maximization on their agreements learns how far each can be trusted, without any label,
and gives each document the posterior of prose, list, table and junk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.session import cut

KINDS = ("prose", "list", "table", "junk")
#: Words of page menus.
MENU_WORDS = "inicio menú menu ayuda volver aceptar entrar ofertas tiendas carrito cuenta mi ver más buscar cerrar salir cookies siguiente anterior registro home login search back accept help next cart".split()
#: Letters of which no three make a word.
_UNSAYABLE = "[bcdfghjklmnñpqrstvwxz]"
_END = r"[.!?…](?:[\"'»”)\]]*)"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0))


def _holds(text: Column, *signs: str) -> Column:
    """Whether any of the signs stands in the text: a plain search, much cheaper than a pattern."""
    out = F.lit(False)
    for sign in signs:
        out = out | F.contains(text, F.lit(sign))
    return out


def _if(condition: Column, count: Column) -> Column:
    return F.when(condition, count).otherwise(F.lit(0))


def _lines(lines: Column, pattern: str) -> Column:
    """Number of lines that match."""
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def statistics(df: DataFrame, row: str, text: str, common: list[str]) -> DataFrame:
    """One row per document: counts and shares. Null and blank texts have zeros throughout (``n_words`` 0).

    ``common`` are the frequent words of all languages, a fixed list, matched as whole words.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    clean = F.when(F.contains(given, F.lit("\r")), F.regexp_replace(given, r"\r\n?", "\n")).otherwise(given)
    rows = df.select(F.col(row), clean.alias("t"), F.coalesce(F.col(text).rlike(r"[^\s\p{Z}\p{C}]"), F.lit(False)).alias("readable"))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"\S")))
    rows = rows.withColumn("words", F.expr(r"regexp_extract_all(lower(t), '[\\p{L}\\p{M}]+', 0)"))
    # texts without any sign of a pattern aren't searched for it
    fields = F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\s*\||;|\t+|(?<=\S) {2,}(?=\S)")))
    fields = F.when(_holds(F.col("t"), "|", ";", "\t", "  "), fields).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumns({"fields": F.filter(fields, lambda n: n > 1), "n_distinct": F.size(F.array_distinct("words"))})
    frequent = sorted({w.lower() for w in common if w})
    t = F.col("t")
    # what several shares use is made once
    rows = rows.withColumns(
        {
            "parts": F.split(t, r"\s+"),
            # begun at the first letter of a word only, and never taken back
            "sentences": F.regexp_count(t, F.lit(r"(?<!\p{L})\p{L}[\p{L}\p{N}%€)»\"']*+\s*+[.!?…][\"'»”)\]]*+(?=\s|$)")),
            "odd": t.rlike(r"[\x{80}-\x{9f}¢-©¬-¶¸¹»-¿ÂÃ€�]"),
        }
    )
    n_lines, n_words, n_chars, sentence = F.size("lines"), F.size("words"), F.length("t"), F.col("sentences")
    tokens = F.size(F.array_remove("parts", ""))
    with_fields = F.size("fields")
    separators = F.regexp_count(t, F.lit(r"(?<=\S), |; | [/·|] "))
    return rows.select(
        row, "readable",
        n_chars.alias("n_chars"), n_lines.alias("n_lines"), n_words.alias("n_words"), tokens.alias("n_tokens"),
        F.coalesce(F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w)) / F.when(n_words > 0, n_words), F.lit(0.0)).alias("mean_word"),
        _share(n_chars - F.length(F.regexp_replace(t, r"\p{L}+", "")), n_chars).alias("letter_share"),
        _share(n_chars - F.length(F.regexp_replace(t, r"\p{Nd}+", "")), n_chars).alias("digit_share"),
        _share(n_chars - F.length(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\s]+", "")), n_chars).alias("symbol_share"),
        _share(F.size(F.filter("words", lambda w: w.isin(frequent))), n_words).alias("common_share"),
        _share(_lines(F.col("lines"), rf"{_END}\s*$"), n_lines).alias("ended_share"),
        sentence.alias("n_sentences"), _share(sentence, n_words).alias("sentence_rate"),
        _share(_lines(F.col("lines"), r"^\s*(?:[-*•·–—▪◦>+]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S"), n_lines).alias("bullet_share"),
        _share(with_fields, n_lines).alias("field_share"),
        _share(F.size(F.array_distinct("fields")), with_fields).alias("field_variety"),
        _share(_lines(F.col("lines"), r"^[^:=\t.]{2,40}?\s*(?:[:=\t]|\.{3,})\s*\S{1,12}(?:\s?[^\s]{0,5}){0,2}\s*$"), n_lines).alias("pair_share"),
        _share(separators, n_words).alias("separator_rate"),
        _share(F.col("n_distinct"), n_words).alias("distinct_words"),
        F.col("n_distinct").alias("n_distinct_words"),
        _share(F.size(F.array_distinct("lines")), n_lines).alias("distinct_lines"),
        _share(F.size(F.filter("words", lambda w: w.isin(MENU_WORDS))), n_words).alias("menu_share"),
        _share(_lines(F.col("lines"), r"^\s*\p{Ll}"), n_lines).alias("lower_start_share"),
        F.coalesce(F.array_max(F.transform("parts", F.length)), F.lit(0)).alias("longest_token"),
        _share(_if(F.col("odd"), F.regexp_count(t, F.lit(r"[\x{80}-\x{9f}¢-©¬®¯±-¶¸¹¼-¾ÂÃ�]"))), n_chars).alias("damaged_share"),
        _share(_if(F.col("odd"), F.regexp_count(t, F.lit(r"(?<=\p{L})[\x{80}-\x{9f}¢-©¬®-¶¸¹»-¿€�](?=\p{L})|�|[ÂÃ](?=[^\p{L}]|$)"))), n_words).alias("broken_rate"),
        _share(_if(_holds(t, "<", "&", "undefined", "NaN", "null;", "{{", "[object", "function(", "%20", "\\x"), F.regexp_count(t, F.lit(r"</?\w+/?>|&\w+;|undefined|NaN|null;|\{\{|\[object|function\(|%20|\\x\d\d"))), tokens).alias("markup_rate"),
        _share(_if(t.rlike(rf"(?i){_UNSAYABLE}{{5}}|(?<![\p{{L}}\p{{M}}]){_UNSAYABLE}{{3,}}(?![\p{{L}}\p{{M}}])"), F.size(F.filter("words", lambda w: w.rlike(rf"(?i)^{_UNSAYABLE}{{3,}}$|{_UNSAYABLE}{{5,}}")))), n_words).alias("unsayable_share"),
        _share(_if(t.rlike(r"\d{6}"), F.regexp_count(t, F.lit(r"(?<!\S)\d{6,}(?!\S)"))), tokens).alias("code_share"),
        _share(F.regexp_count(t, F.lit(r"(.)\1{5,}")), n_lines).alias("run_rate"),
        _share(F.regexp_count(t, F.lit(r" \| ")), n_lines).alias("bar_rate"),
        _share(_lines(F.col("lines"), r"\d"), n_lines).alias("number_line_share"),
        _share(n_words, n_lines).alias("words_per_line"),
        _share(n_words, sentence).alias("words_per_sentence"),
        _share(F.regexp_count(t, F.lit(r"[\t>/;|]| > ")), tokens).alias("path_rate"),
    )


def labelling_functions() -> dict[str, tuple[str, Column]]:
    """Name to (type voted for, condition); a function whose condition doesn't hold abstains."""
    c = F.col
    few = lambda x, n: c(x) < n
    many = lambda x, n: c(x) >= n
    return {
        "prose_common": ("prose", many("common_share", 0.28) & many("n_distinct_words", 16) & few("broken_rate", 0.05)),
        "prose_light": ("prose", many("common_share", 0.22) & many("n_distinct_words", 8) & many("distinct_words", 0.3) & few("separator_rate", 0.25) & few("bullet_share", 0.5) & few("broken_rate", 0.05) & (many("words_per_line", 9) | many("n_sentences", 1))),
        "prose_sentences": ("prose", many("n_sentences", 1) & c("words_per_sentence").between(4, 45) & many("n_distinct_words", 9) & few("bullet_share", 0.5)),
        "prose_ended": ("prose", many("ended_share", 0.5) & many("n_words", 5) & many("letter_share", 0.6)),
        "prose_flow": ("prose", many("common_share", 0.3) & few("separator_rate", 0.13) & many("words_per_line", 6.5) & few("bullet_share", 0.5) & many("n_distinct_words", 13)),
        "prose_wide": ("prose", many("words_per_line", 9) & c("mean_word").between(3.2, 5.3) & few("symbol_share", 0.07) & few("digit_share", 0.06) & few("separator_rate", 0.14)),
        "list_bullets": ("list", many("bullet_share", 0.6) & many("n_lines", 2)),
        "list_items": ("list", many("bullet_share", 0.6) & many("n_lines", 3) & few("words_per_line", 9)),
        "list_separated": ("list", many("separator_rate", 0.14) & few("n_lines", 3) & few("n_sentences", 2) & many("letter_share", 0.5) & few("menu_share", 0.4) & few("common_share", 0.36)),
        "list_short_lines": ("list", many("n_lines", 3) & few("words_per_line", 9) & few("ended_share", 0.2) & few("digit_share", 0.14) & few("field_share", 0.5) & few("pair_share", 0.5) & many("letter_share", 0.5) & few("sentence_rate", 0.02) & many("distinct_lines", 0.5)),
        "list_names": ("list", few("sentence_rate", 0.02) & many("mean_word", 4) & many("letter_share", 0.6) & ((many("separator_rate", 0.14) & few("common_share", 0.36)) | few("words_per_line", 6.5)) & many("distinct_words", 0.3) & few("digit_share", 0.13) & few("unsayable_share", 0.1) & few("ended_share", 0.3) & few("menu_share", 0.4)),
        "table_fields": ("table", many("field_share", 0.7) & many("n_lines", 3) & (c("field_variety") <= 0.4) & many("letter_share", 0.15) & many("digit_share", 0.05)),
        "table_pairs": ("table", many("pair_share", 0.6) & many("n_lines", 2) & many("letter_share", 0.15)),
        "table_numbers": ("table", many("number_line_share", 0.65) & many("n_lines", 3) & c("digit_share").between(0.06, 0.4) & few("words_per_line", 9) & few("bullet_share", 0.5)),
        "junk_symbols": ("junk", few("letter_share", 0.25) & few("number_line_share", 0.6)),
        "junk_token": ("junk", many("longest_token", 60) & few("common_share", 0.2)),
        "junk_repeat": ("junk", many("n_words", 12) & few("distinct_words", 0.2) & few("n_distinct_words", 21)),
        "junk_lines": ("junk", many("n_lines", 4) & few("distinct_lines", 0.4)),
        "junk_broken": ("junk", many("broken_rate", 0.06)),
        "junk_damaged": ("junk", many("damaged_share", 0.04)),
        "junk_markup": ("junk", many("markup_rate", 0.3)),
        "junk_noise": ("junk", many("unsayable_share", 0.2) & few("digit_share", 0.05)),
        "junk_codes": ("junk", many("code_share", 0.5)),
        "junk_runs": ("junk", many("run_rate", 0.8) & few("letter_share", 0.15)),
        "junk_menu": ("junk", many("menu_share", 0.5)),
        "junk_bars": ("junk", many("bar_rate", 5) & few("digit_share", 0.05) & few("n_lines", 3) & few("distinct_words", 0.75)),
    }


#: How often a function fires on its own type and on others before anything is learned (types with many special
#: functions fire each of them seldom), the share of each type, and the weight of these beliefs in every step.
START_OWN, START_OTHER = {"prose": 0.6, "list": 0.4, "table": 0.4, "junk": 0.12}, 0.02
START_SHARES, BELIEF = (0.7, 0.12, 0.1, 0.08), 0.05
ROUNDS = 30
#: Vote patterns up to which a step runs on the driver; beyond it every step is a pass over the distributed patterns.
LOCAL_PATTERNS = 100_000


def _posterior(votes: np.ndarray, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
    log = np.log(shares) + votes @ np.log(rates) + (1 - votes) @ np.log(1 - rates)
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _bits(patterns: np.ndarray, n: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(n) & 1).astype(float)


def learn(patterns: DataFrame, own: list[str], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(firing rates by function and type, shares of types) by expectation-maximization over ``votes, n``.

    Sums of posteriors by type and function are all that a step needs; an empty table returns the start."""
    first = np.full((len(own), len(KINDS)), START_OTHER)
    for j, kind in enumerate(own):
        first[j, KINDS.index(kind)] = START_OWN[kind]
    rates, shares = first.copy(), np.array(START_SHARES)

    def sums(votes: np.ndarray, n: np.ndarray, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
        p = _posterior(_bits(votes, len(own)), rates, shares) * n[:, None]
        return np.vstack([p.sum(0), _bits(votes, len(own)).T @ p])

    small = patterns.limit(LOCAL_PATTERNS + 1).count() <= LOCAL_PATTERNS
    local = patterns.toPandas() if small else None

    def step(rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
        if small:
            return sums(local["votes"].to_numpy(np.int64), local["n"].to_numpy(float), rates, shares)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(own) + 1, len(KINDS)))
            for b in batches:
                total += sums(b["votes"].to_numpy(np.int64), b["n"].to_numpy(float), rates, shares)
            yield pd.DataFrame({"s": [total.ravel().tolist()]})

        return sum(np.array(r["s"]).reshape(len(own) + 1, len(KINDS)) for r in patterns.mapInPandas(part, "s array<double>").collect())  # one row a partition

    for _ in range(rounds):
        total = step(rates, shares)
        weight = total[0]
        if weight.sum() == 0:
            break
        shares = np.clip(weight / weight.sum(), 1e-6, 1)
        rates = np.clip((total[1:] + BELIEF * weight * first) / np.maximum(weight * (1 + BELIEF), 1e-9), 1e-3, 1 - 1e-3)
    return rates, shares


def text_types(df: DataFrame, row: str, text: str, common: list[str]) -> DataFrame:
    """``<row>, doc_kind, posterior`` and all statistics of every document. Null, empty and blank texts have a null type
    and posterior and don't take part in learning; a readable text on which no function fires gets the type of that
    pattern. Repeated texts count as often as they occur."""
    functions = labelling_functions()
    votes = F.lit(0).cast("long")
    for j, (_, condition) in enumerate(functions.values()):
        votes = votes + F.when(condition, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
    # statistics are the costly part: made once, then read for learning and for the result
    rows = cut(statistics(df, row, text, common).withColumn("votes", votes))
    patterns = rows.where("readable").groupBy("votes").agg(F.count("*").alias("n"))
    own = [kind for kind, _ in functions.values()]
    rates, shares = learn(patterns, own)

    @F.pandas_udf("array<double>")
    def posterior(batch: pd.Series) -> pd.Series:
        kinds, where = np.unique(batch.to_numpy(np.int64), return_inverse=True)
        return pd.Series(list(_posterior(_bits(kinds, len(own)), rates, shares)[where]))

    p = F.col("posterior")
    best = F.array(*[F.lit(k) for k in KINDS])
    out = rows.withColumn("posterior", F.when(F.col("readable"), posterior(F.col("votes"))))
    return out.withColumn("doc_kind", F.when(p.isNotNull(), F.element_at(best, F.array_position(p, F.array_max(p)).cast("int"))))
