"""Free-entered values mapped to the closest entry of a reference list (problem 6): BK-trees under the Levenshtein metric.

A value and an entry are compared by their keys: one visual form, lower case, no accents, no wrapping (``Marca X``,
``X S.A.``, quotes), short forms written out, ``X, La`` turned round, letters and digits only. Each shard of the
reference is a BK-tree; the triangle inequality prunes it and every entry within the search radius is returned. The final
distance counts a swap of neighbours as one edit (unrestricted Damerau-Levenshtein, itself a metric); as such a distance
of d is at most 2d under Levenshtein, the search radius of twice the threshold loses no entry."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.canon import transducer
from cotejo.operators.skew import fragment_replicate_join
from cotejo.session import cut, shuffle_width

#: Edits up to which a value may mean an entry, and letters of the key that each of them needs.
MAX_EDITS, LETTERS_PER_EDIT = 2, 3
#: Entries of one shard's tree, and keys that one task looks up in it.
SHARD_ENTRIES, BLOCK_KEYS = 20_000, 20_000


@dataclass(frozen=True)
class Wording:
    """How names are written in one language: short forms of words in firm names, words that stand for the lack of a name,
    and patterns of what is put before and after a name without being part of it."""

    short: tuple[tuple[str, str], ...] = ()
    fillers: tuple[str, ...] = ()
    before: str = "(?!)"
    after: str = "(?!)"


#: The wording of Spanish firm names.
SPANISH = Wording(
    short=(("l.", "la"), ("hnos.", "hermanos"), ("hno.", "hermano"), ("alim.", "alimentos"), ("hta.", "huerta"), ("gja.", "granja"), ("fca.", "finca"), ("c.", "casa"), ("m.", "molino"), ("mol.", "molino"), ("mno.", "molino")),
    fillers=("varios", "varias", "marca blanca", "sin marca", "no brand", "n/a", "s/m", "desconocida", "desconocido", "generico", "generica", "ninguna", "ninguno", "otros", "otras", "-", "--", "none", "null"),
    before=r"marca\s*:\s*|marca\s+|by\s+|de\s+|\*\s*",
    after=r"s\.?\s?a\.?|s\.?\s?l\.?(?:\s?u\.?)?|bio|premium|espana|\(marca\)?",
)
SHORT_FORMS = dict(SPANISH.short)
_TURNED = re.compile(r"([^,]+),\s*([^\s,]+)")
_QUOTES = " \"'«»“”‘’*()[]"


@lru_cache(16)
def _compiled(wording: Wording) -> tuple[dict, frozenset, re.Pattern, re.Pattern]:
    return dict(wording.short), frozenset(wording.fillers), re.compile(rf"^(?:{wording.before})+(?=\S)"), re.compile(rf"(?<=\S)(?:\s+(?:{wording.after}))+$")


def brand_key(value: str, wording: Wording = SPANISH) -> str:
    """The comparison key; empty if nothing is left."""
    short, fillers, before, after = _compiled(wording)
    text = unicodedata.normalize("NFKD", transducer()(value).lower().replace("™", "").replace("®", "").replace("_", " "))
    text = " ".join("".join(c for c in text if not unicodedata.combining(c)).split()).strip(_QUOTES)
    if text in fillers:
        return ""
    text = after.sub("", before.sub("", text)).strip(_QUOTES)
    if turned := _TURNED.fullmatch(text):
        text = f"{turned[2]} {turned[1]}"
    return "".join(c for c in " ".join(short.get(w, w) for w in text.split()) if c.isalnum())


def levenshtein_to(a: str) -> Callable[[str], int]:
    """The distance of ``a`` to any text, bit-parallel: one step per letter of the text on integers of ``len(a)`` bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, length, get = (1 << len(a)) - 1, len(a), masks.get
    top = 1 << length - 1 if length else 0

    def distance(b: str) -> int:
        if not length:
            return len(b)
        up, down, score = full, 0, length
        for c in b:
            eq = get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(diagonal | up) & full, up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 | 1, minus << 1
            up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal & full
        return score

    return distance


def levenshtein(a: str, b: str) -> int:
    return levenshtein_to(a)(b)


def damerau(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, also around other edits."""
    rows, seen = [[len(a) + len(b)] * (len(b) + 2)], {}
    rows.append([rows[0][0], *range(len(b) + 1)])
    for i, x in enumerate(a, 1):
        row, match = [rows[0][0], i], 0
        for j, y in enumerate(b, 1):
            k, m, same = seen.get(y, 0), match, x == y
            if same:
                match = j
            row.append(min(rows[i][j] + (not same), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


class BKTree:
    """Keys by their distance to their parent; equal keys share a node."""

    def __init__(self, entries: list[tuple[str, int]]) -> None:
        self.root: tuple[str, list[int], dict] | None = None
        self.exact: dict[str, list[int]] = {}
        for key, number in entries:
            self.exact.setdefault(key, []).append(number)
        for key, numbers in self.exact.items():
            self._add(key, numbers)

    def _add(self, key: str, numbers: list[int]) -> None:
        if self.root is None:
            self.root = (key, numbers, {})
            return
        node = self.root
        while True:
            d = levenshtein(key, node[0])
            if d not in node[2]:
                node[2][d] = (key, numbers, {})
                return
            node = node[2][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str, list[int]]]:
        """Every (distance, key, entries) within the radius."""
        found, open_, distance = [], [self.root] if self.root else [], levenshtein_to(key)
        while open_:
            name, numbers, children = open_.pop()
            apart = abs(len(key) - len(name)) - radius
            if apart > 0 and (not children or max(children) < apart):
                continue  # the lengths alone keep it and all below it out
            d = distance(name)
            if d <= radius:
                found.append((d, name, numbers))
            low, high = d - radius, d + radius
            open_ += [child for edge, child in children.items() if low <= edge <= high]
        return found

    def best(self, key: str, max_edits: int = MAX_EDITS) -> tuple[int, int] | None:
        """(edits, entry) of the closest entry within the threshold; ties by the smaller entry number. An entry of d edits
        lies within 2d of the metric, so the search begins with the smallest circle and ends at the first that holds one."""
        if key in self.exact:
            return 0, min(self.exact[key])
        for edits in range(1, min(max_edits, len(key) // LETTERS_PER_EDIT) + 1):
            near = [(e, min(numbers)) for _, name, numbers in self.within(key, 2 * edits) if abs(len(key) - len(name)) <= edits and (e := damerau(key, name)) <= edits]
            if near:
                return min(near)
        return None


@lru_cache(4)
def _tree(entries: tuple[tuple[str, int], ...]) -> BKTree:
    return BKTree(list(entries))


def map_values(values: DataFrame, value: str, reference: DataFrame, entry_id: str, entry: str, max_edits: int = MAX_EDITS, shard_entries: int = SHARD_ENTRIES, wording: Wording = SPANISH, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``<value>, key, entry_id, edits`` of every distinct value that is neither null nor blank; ``entry_id`` is null
    for a value that means no entry. An entry that is null or whose key is empty is never meant. Of several closest
    entries the smallest id is given. A reference of up to ``shard_entries`` is one broadcast tree; a larger one is cut
    into shards and the counted keys into blocks, each pair of which is a task that builds its shard's tree once."""

    @F.pandas_udf("string")
    def keyed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: brand_key(v, wording))

    distinct = cut(values.where(F.col(value).rlike(r"\S")).select(value).distinct().withColumn("key", keyed(F.col(value))))
    keys = distinct.select("key").where("key <> ''").distinct()
    entries = reference.where(F.col(entry).isNotNull()).select(keyed(F.col(entry)).alias("k"), F.col(entry_id).cast("long").alias("n")).where("k <> ''")
    total = reference.count()
    shards = max(1, -(-total // shard_entries))
    schema = "key string, entry_id long, edits int"
    if shards == 1:
        tree_rows = tuple(sorted((r["k"], r["n"]) for r in entries.collect()))  # at most shard_entries rows

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = _tree(tree_rows)
            for batch in batches:
                hits = [(key, *(tree.best(key, max_edits) or (None, None))) for key in batch["key"]]
                yield pd.DataFrame({"key": [h[0] for h in hits], "entry_id": pd.array([h[2] for h in hits], "Int64"), "edits": pd.array([h[1] for h in hits], "Int32")})

        # few rows but much work: spread by a stated number, as sizes in bytes say nothing about the work
        found = keys.repartition(4 * shuffle_width(keys.sparkSession)).mapInPandas(search, schema)
    else:
        blocks = max(1, -(-keys.count() // block_keys))
        sharded = entries.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        spread = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

        def search_shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            tree = BKTree(sorted(zip(right["k"], right["n"], strict=True)))
            hits = [(key, hit) for key in left["key"] if (hit := tree.best(key, max_edits))]
            return pd.DataFrame({"key": pd.Series([k for k, _ in hits], dtype=object), "entry_id": [int(h[1]) for _, h in hits], "edits": [int(h[0]) for _, h in hits]})

        part = spread.groupBy("shard", "block").cogroup(sharded.groupBy("shard", "block")).applyInPandas(search_shard, schema)
        found = part.groupBy("key").agg(F.min(F.struct("edits", "entry_id")).alias("m")).select("key", "m.entry_id", "m.edits")
    return distinct.join(found, "key", "left").select(value, "key", "entry_id", "edits")


def map_rows(df: DataFrame, row: str, value: str, reference: DataFrame, entry_id: str, entry: str, wording: Wording = SPANISH) -> DataFrame:
    """``<row>, <entry_id>`` of every row whose value is neither null nor blank nor exactly an entry; 0 if it means none.

    Exact entries are left out and the search runs on distinct values; results come back to the rows by the load-balanced
    join, as one value may be that of a third of all rows.
    """
    rows = df.select(row, value).where(F.col(value).rlike(r"\S"))
    names = reference.select(F.col(entry).alias(value)).where(F.col(value).isNotNull())
    free = rows.select(value).distinct().join(names, value, "left_anti")
    mapped = map_values(free, value, reference, entry_id, entry, wording=wording).select(value, F.coalesce("entry_id", F.lit(0)).alias(entry_id))
    return fragment_replicate_join(rows, mapped, value, F.col(row)).select(row, entry_id)
