"""Quantities recorded in different units, brought to common ones (problem 1).

All of it is column expressions: ``regexp_extract`` takes number and unit from the unit field or, if the field has
none, from the text; aliases are joined to a table of units; factor and offset of the unit give the base amount."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions.lookalikes import fold_sql

#: Alias, base unit, thousandths of the base unit in one unit, offset in thousandths.
UNITS = [
    ("kg", "kg", 1000, 0), ("kgs", "kg", 1000, 0), ("kgm", "kg", 1000, 0), ("kilo", "kg", 1000, 0), ("kilos", "kg", 1000, 0),
    ("kilogramo", "kg", 1000, 0), ("kilogramos", "kg", 1000, 0), ("g", "kg", 1, 0), ("gr", "kg", 1, 0), ("grs", "kg", 1, 0),
    ("gramo", "kg", 1, 0), ("gramos", "kg", 1, 0), ("hg", "kg", 100, 0), ("t", "kg", 1_000_000, 0), ("tm", "kg", 1_000_000, 0),
    ("tonelada", "kg", 1_000_000, 0), ("toneladas", "kg", 1_000_000, 0), ("l", "l", 1000, 0), ("lt", "l", 1000, 0),
    ("lts", "l", 1000, 0), ("ltr", "l", 1000, 0), ("litro", "l", 1000, 0), ("litros", "l", 1000, 0), ("ml", "l", 1, 0),
    ("mililitro", "l", 1, 0), ("mililitros", "l", 1, 0), ("cl", "l", 10, 0), ("centilitro", "l", 10, 0), ("centilitros", "l", 10, 0),
    ("dl", "l", 100, 0), ("decilitro", "l", 100, 0), ("decilitros", "l", 100, 0), ("hl", "l", 100_000, 0),
    ("hectolitro", "l", 100_000, 0), ("hectolitros", "l", 100_000, 0), ("ud", "ud", 1000, 0), ("uds", "ud", 1000, 0),
    ("u", "ud", 1000, 0), ("un", "ud", 1000, 0), ("und", "ud", 1000, 0), ("unds", "ud", 1000, 0), ("uni", "ud", 1000, 0),
    ("unidad", "ud", 1000, 0), ("unidades", "ud", 1000, 0), ("pieza", "ud", 1000, 0), ("piezas", "ud", 1000, 0),
    ("pza", "ud", 1000, 0), ("par", "ud", 2000, 0), ("pares", "ud", 2000, 0), ("dz", "ud", 12_000, 0),
    ("docena", "ud", 12_000, 0), ("docenas", "ud", 12_000, 0), ("ciento", "ud", 100_000, 0), ("millar", "ud", 1_000_000, 0),
]

#: How the unit of a bare price is announced in a text, and what only looks like a quantity there.
HINT = r"(?:precio\s*(?:referido\s+a|por|/)|p\.?\s?v\.?\s?p\.?\s*(?:por|/)|€\s*(?:por|/))"
PROMO = r"\d+\s*x\s*\d+(?!\s*[.,]?\d*\s*(?:g|k|m|c|l|u|d)\w*)|\d+ª\s*unidad(?:\s+al\s+\d+\s*%)?"
_NUMBER = r"\d+(?:[.,]\d+)*"
_CURRENCY = r"€|eur(?:os?)?\b|c€|cts?\b\.?|c[eé]nt(?:imos?|s?\b)?\.?"
_MONEY = rf"({_NUMBER}(?:€\d+)?)\s*({_CURRENCY})?"
_AMOUNT = r"(\d+\s*/\s*\d+|\d*\s*[½¼¾]|\d+(?:[.,]\d+)*|medi[oa]|(?:un\s+)?cuarto(?:\s+de)?|tres\s+cuartos(?:\s+de)?)?"


_PIECE = r"(?:unidades|unidad|unds?|uds?|uni|u)\.?"


@lru_cache(16)
def _patterns(units: tuple) -> tuple[str, str, str]:
    """Patterns of an amount with its unit, of a content and of a count of pieces, for these units."""
    words = lambda *bases: "|".join(sorted((re.escape(a) for a, b, _, _ in units if b in bases), key=lambda a: (-len(a), a))) or "(?!)"
    spec = rf"{_AMOUNT}\s*({words('kg', 'l', 'ud')})\.?"
    content = rf"(?:(\d+)\s*(?:x\s*|(?:{_PIECE}\s*)?(?:-\s*|de\s+)|{_PIECE}\s+))?(\d+\s*/\s*\d+|\d*\s*[½¼¾]|medi[oa]|cuarto\s+de|{_NUMBER})\s*({words('kg', 'l')})\b"
    count = rf"(?:(?<![\w.,])({_NUMBER})\s*({words('ud')})(?![\w])|(?:(?:pack|lote|caja|estuche)(?:\s+de)?\s+|(?<!\w)x\s*)(\d+)(?!\s*[.,]?\d))"
    return spec, content, count


#: What every content and count holds.
_NUMERIC = r"[\d½¼¾]|medi[oa]|cuarto"
_EXACT = T.DecimalType(30, 8)
#: Base units in one item of goods when its text names none: kilograms or litres, pieces.
USUAL_CONTENT = {"kg": (0.02, 40.0), "l": (0.02, 40.0), "ud": (0.99, 150.0)}


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that takes the whole text, in one search: empty where the text or the group doesn't
    match, null for a null text."""
    parts = F.split(F.regexp_replace(text, pattern, "\x01".join(f"${k}" for k in range(1, n + 1))), "\x01")
    return F.when(F.size(parts) == n, parts).when(text.isNotNull(), F.array(*[F.lit("")] * n))


def units_table(spark: SparkSession, units: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(UNITS if units is None else units, "alias string, base_unit string, factor long, offset long")


def parse_number(text: Column) -> Column:
    """Decimal of ``1.234,5``, ``1,234.5``, ``12,5``, ``12.5`` and ``1€50``: the last sign is the decimal sign and
    any sign before it groups thousands. Null if nothing fits."""
    last_only = F.regexp_replace(text, r"[.,](?=[\d.,€]*[.,€])", "")
    signs = F.length(F.translate(text, "0123456789", ""))
    return F.when(signs > 1, F.translate(last_only, ",€", "..")).otherwise(F.translate(text, ",€", "..")).try_cast(_EXACT)


def parse_amount(text: Column) -> Column:
    """Decimal of an amount before a unit: a number, a fraction (``1/2``, ``½``, ``1½``) or a word; missing means one."""
    plain = text
    for word, digits in ((r"\s+", ""), (r"(\d)½", "$1,5"), (r"(\d)¼", "$1,25"), (r"(\d)¾", "$1,75"), ("½|medi[oa]", "1/2"), ("¾|trescuartos(?:de)?", "3/4"), ("¼|(?:un)?cuarto(?:de)?", "1/4")):
        text = F.regexp_replace(text, word, digits)
    over, under = (F.regexp_extract(text, r"^([\d.,]*)(?:/(\d+))?$", k) for k in (1, 2))
    spelt = F.try_divide(F.coalesce(parse_number(over), F.lit(1)), F.coalesce(under.try_cast(_EXACT), F.lit(1))).cast(_EXACT)
    # most amounts are missing or whole numbers, which need no search
    return F.when(plain == "", F.lit(1).cast(_EXACT)).when(F.translate(plain, "0123456789", "") == "", plain.try_cast(_EXACT)).otherwise(spelt)


def with_unit_prices(
    df: DataFrame, unit_price: str, price: str, texts: list[str], source: str | None = None, defaults: dict[str, str] | None = None, units: list[tuple] | None = None
) -> DataFrame:
    """Adds base_unit, unit_cents, price_cents, content (base units, of the text), unit_from and confirmed.

    ``unit_from`` is ``field``, ``text`` or ``default``, the last by ``defaults`` (source value to alias). A unit
    price without number or unit gives nulls, as do null, empty and filler fields. The item's price may be in euros
    or in cents: content times unit price decides; without a content, the content that the price implies must be
    one that goods are sold in, and euros win if both or neither are. Existing columns of the input keep their
    values; input columns named like a result are replaced. ``units`` are rows of alias, base unit, factor and offset in
    thousandths. Repeated rows stay; no shuffle is made.
    """
    spark = df.sparkSession
    spec, content, count = _patterns(tuple(map(tuple, UNITS if units is None else units)))
    kept = [c for c in df.columns if c not in ("base_unit", "unit_cents", "price_cents", "content", "unit_from", "confirmed")]
    u = F.trim(F.lower(fold_sql(F.col(unit_price))))
    text = F.lower(fold_sql(F.concat_ws(" ", *[F.col(c) for c in texts])))
    front, said = rf"^(?:a\s+)?{_MONEY}\s*(?:(?:/|x|por)\s*(.*))?$", rf"{HINT}\s*{spec}(?![\w½])"
    default = F.lit("")
    for name, alias in (defaults or {}).items():
        default = F.when(F.col(source) == name, F.lit(alias)).otherwise(default)
    # amounts first: "1 kg = 2 €" and "(kg: 2 €)" become "2 €/1 kg"
    turned = F.regexp_replace(u, rf"^\(?\s*(.*?)\s*[=:]\s*{_MONEY}\s*\)?$", "$2$3/$1")
    out = df.select(*kept, turned.alias("__u"), text.alias("__t"), default.alias("__default"))
    # long texts are searched once for each pattern; the short pieces found are taken apart after that
    out = out.withColumn("__front", _groups(F.col("__u"), front, 3))
    out = out.withColumns({f"__{k}": F.get("__front", F.lit(g)) for k, g in (("n", 0), ("c", 1), ("s", 2))} | {"__h": F.when(F.col("__t").rlike("precio|p\\.?\\s?v|€"), F.regexp_extract("__t", said, 0)).otherwise("")})
    goods = F.when(F.col("__h") != "", F.replace("__t", F.col("__h"), F.lit(" "))).otherwise(F.col("__t"))  # no announced unit
    out = out.withColumn("__goods", F.regexp_replace(goods, PROMO, " "))  # no promotion
    found = {"__content": F.regexp_extract("__goods", content, 0), "__pieces": F.regexp_extract("__goods", count, 0)}
    out = out.withColumns({c: F.when(F.col("__goods").rlike(_NUMERIC), x).otherwise("") for c, x in found.items()})
    out = out.withColumns({"__f": _groups(F.col("__s"), rf"^{spec}\s*$", 2), "__hg": _groups(F.col("__h"), rf"^{said}$", 2), "__g": _groups(F.col("__content"), rf"^{content}$", 3), "__k": _groups(F.col("__pieces"), rf"^(?:{count})$", 3)})
    out = out.withColumns({f"__{c}{n}": F.get(f"__{a}", F.lit(i)) for a, parts in {"f": ("fq", "fu"), "hg": ("hq", "hu"), "g": ("g1", "g2", "g3"), "k": ("k1", "k2", "k3")}.items() for i, (c, n) in enumerate((x[0], x[1:]) for x in parts)})
    bare = F.col("__s") == ""
    out = out.withColumns(
        {
            "unit_from": F.when(F.col("__fu") != "", F.lit("field")).when(bare & (F.col("__hu") != ""), F.lit("text")).when(bare & (F.col("__default") != ""), F.lit("default")),
            "__money": (parse_number(F.col("__n")) * F.when(F.col("__c").startswith("c"), F.lit(1)).otherwise(F.lit(100))).cast(_EXACT),
        }
    )
    pick = lambda f, t, d: F.when(F.col("unit_from") == "field", f).when(F.col("unit_from") == "text", t).when(F.col("unit_from") == "default", d)
    out = out.withColumns({"__unit": pick(F.col("__fu"), F.col("__hu"), F.col("__default")), "__qtext": pick(F.col("__fq"), F.col("__hq"), F.lit(""))})
    out = out.withColumns(
        {
            "__q": parse_amount(F.col("__qtext")), "__mult": F.coalesce(F.col("__g1").try_cast(_EXACT), F.lit(1).cast(_EXACT)),
            "__amount": F.when(F.col("__g3") != "", parse_amount(F.col("__g2"))), "__cunit": F.col("__g3"), "__packed": F.col("__g1") != "",
            "__count": F.coalesce(parse_number(F.col("__k1")), F.col("__k3").try_cast(_EXACT)), "__nunit": F.when(F.col("__k3") != "", F.lit("ud")).otherwise(F.col("__k2")),
        }
    )
    aliases = F.broadcast(units_table(spark, units))  # the list of units
    for name in ("__unit", "__cunit", "__nunit"):
        out = out.join(aliases.toDF(name, f"{name}_base", f"{name}_factor", f"{name}_offset"), name, "left")
    thousandths = (F.col("__q") * F.col("__unit_factor") + F.col("__unit_offset")).cast(_EXACT)
    unit_cents = F.when(thousandths > 0, F.round(F.col("__money") * 1000 / thousandths, 0)).cast("long")
    sold = (F.col("__mult") * (F.col("__amount") * F.col("__cunit_factor") + F.col("__cunit_offset")) / 1000).cast("double")
    pieces = F.when(F.col("__packed"), F.col("__mult").cast("double")).otherwise((F.col("__count") * F.col("__nunit_factor") / 1000).cast("double"))
    out = out.withColumns(
        {
            "base_unit": F.when(unit_cents.isNotNull(), F.col("__unit_base")),
            "unit_cents": unit_cents,
            "content": F.when(F.col("__unit_base") == "ud", pieces).when(F.col("__unit_base") == F.col("__cunit_base"), sold),
        }
    )
    euros, cents = F.round(F.col(price) * 100, 0), F.round(F.col(price), 0)
    whole = F.col(price) == F.floor(F.col(price))
    expected = F.col("unit_cents") * F.col("content")
    off = lambda c: F.abs(F.log((c + 0.5) / (expected + 0.5)))
    usual = [F.when(F.col("base_unit") == "ud", F.lit(USUAL_CONTENT["ud"][k])).otherwise(F.lit(USUAL_CONTENT["kg"][k])) for k in (0, 1)]
    implied = lambda c: (c / F.col("unit_cents")).between(*usual)
    in_cents = F.when(~whole, False).when(expected > 0, off(cents) < off(euros)).when(F.col("unit_cents") > 0, implied(cents) & ~implied(euros)).otherwise(False)
    out = out.withColumn("price_cents", F.when(F.col(price).isNull() | F.isnan(price), None).when(in_cents, cents).otherwise(euros).cast("long"))
    right = F.when(expected > 0, F.abs(F.col("price_cents") - expected) <= F.greatest(F.lit(2.0), 0.02 * expected))
    # one value a row, taken apart again: a caller's filter on the results would otherwise be moved below the searches, which
    # then run twice and outgrow what can be compiled
    results = F.struct("base_unit", "unit_cents", "price_cents", "content", "unit_from", right.alias("confirmed"))
    return out.select(*kept, F.inline(F.array(results)))
