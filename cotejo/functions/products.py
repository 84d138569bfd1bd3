"""Product expressions: brand flags, texts, legacy texts, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import normalize

NO_BRAND = "NO BRAND"
#: Supermarket name part to its text column; the last that fits wins, case-sensitively.
TEXT_COLUMNS = {"EROSKI": "description", "Makro": "denomination"}


def is_white_label(brand: Column, patterns: list[str]) -> Column:
    """Empty, or a case-insensitive part of any pattern (not the reverse); null counts as the text ``None``.
    The pattern list is configuration of a fixed size, held as a literal."""
    brand = F.lower(F.coalesce(brand, F.lit("None")))
    inside = F.lit(False)
    for pattern in sorted({p.lower() for p in patterns}):
        inside = inside | F.contains(F.lit(pattern), brand)
    return (brand == "") | inside


def final_brand(brand: Column, patterns: list[str]) -> Column:
    return F.when(is_white_label(brand, patterns), F.lit(NO_BRAND)).otherwise(F.coalesce(brand, F.lit(NO_BRAND)))


def brand_type(brand: Column) -> Column:
    return F.when(brand == NO_BRAND, F.lit("no_brand")).otherwise(F.lit("brand"))


def base_text(supermarket: Column, columns: dict[str, str] = TEXT_COLUMNS, strict: bool = False) -> Column:
    """The text column of the product's supermarket. Without one: null, or an error if ``strict``."""
    out = F.lit(None).cast("string")
    for part, column in columns.items():
        out = F.when(F.contains(supermarket, F.lit(part)), F.col(column)).otherwise(out)
    if strict:
        return F.when(F.coalesce(out, F.lit("")) != "", out).otherwise(F.raise_error(F.concat(F.lit("no text for "), F.coalesce(supermarket, F.lit("null")))))
    return out


#: Nutrition members and their words in a product text.
NUTRITION_WORDS = {"calories": "calories", "fat": "fat", "protein": "protein", "carbohydrates": "carbs"}


def nutrition_text(info: Column) -> Column:
    """Words and values of the nutrition struct; a null value reads ``None``, as does a null member; a null struct
    gives null. Numbers are lost again when the text is normalized."""
    parts = [F.concat(F.lit(f"{word} "), F.coalesce(info[name]["value"], F.lit("None"))) for name, word in NUTRITION_WORDS.items()]
    return F.when(info.isNotNull(), F.concat_ws(" ", *parts))


def product_text(text: Column, brand: Column, ingredients: Column | None = None, nutrition: Column | None = None) -> Column:
    """Normalized text of text, brand (unless NO BRAND), ingredients and nutrition words."""
    some = lambda c: F.when(c != "", c)
    parts = [some(text), F.when(brand != NO_BRAND, brand)]
    if ingredients is not None:
        parts.append(some(ingredients))
    if nutrition is not None:
        parts.append(nutrition_text(nutrition))
    return normalize(F.concat_ws(" ", *parts))


def legacy_product_text(name: Column, brand: Column, price: Column, value: Column, form: Column, unit: Column) -> Column:
    """The earlier text form with the price per measure. A missing or blank measure gives the price itself; one that
    is no number, or zero, gives null instead of an error."""
    number = F.try_divide(price, value.try_cast("double"))
    per = F.when(F.coalesce(value, F.lit("")) == "", price).otherwise(number)
    return F.when(per.isNotNull(), F.concat(F.coalesce(name, F.lit("")), F.lit(", BRAND: "), F.coalesce(brand, F.lit("")), F.lit(", UNIT PRICE: "), per.cast("string"), F.lit(", FORMAT: "), F.coalesce(form, F.lit("")), F.lit(", AMOUNT: "), F.coalesce(value, F.lit("")), F.lit(" "), F.coalesce(unit, F.lit(""))))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def per_supermarket(column: str, supermarket: str) -> str:
    """The column's dynamic name, such as ``category_EROSKI``."""
    return f"{column}_{supermarket}"
