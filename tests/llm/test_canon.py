import unicodedata
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cotejo.functions.lookalikes import LOOKALIKE_FROM, LOOKALIKE_INTO
from cotejo.llm import canon

ALPHABET = "aeinos AB1.́̃​­﻿  аеоѕСΝΟﬁａＢ１．é½ª™"


def test_mapping_is_stable_and_checked():
    change = canon.Transducer()
    assert all(change(v) == v for v in list(change.mapping.values())[::7])
    assert all(change(a) == b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_INTO, strict=True))


@pytest.mark.parametrize(("a", "b"), [
    ("Cаballa en ﬁletes c/toma​te", "Caballa en filetes c/tomate"), ("ＬＡ­ ‍ＦＥＳ", "LA FES"), ("Garćía", "Garćía"), ("e​́", "é"), ("а́", "á"), ("ño x", "ño x"), ("", ""), (" ", " "), (" ", " "),
])
def test_same_look(a, b):
    assert canon.transducer()(a) == b


@pytest.mark.parametrize("text", ["La Posdusirbel", "½ kg ª ™", "a  b", "ñandú", "Ünïcode!", "中文", "Привет мир", "και όχι", "中文 Привет мир ñandú", "\uac01 한국어", "сегодня ещё"])
def test_plain_text_stays(text):
    assert canon.transducer()(text) == text


@given(st.text(ALPHABET, max_size=30))
def test_one_pass_is_final_and_composed(text):
    once = canon.transducer()(text)
    assert canon.transducer()(once) == once == unicodedata.normalize("NFC", once)


def test_pairs_are_brute_force(spark):
    rows = [(1, "a", "Leche", "X"), (2, "a", "Lеche", "X"), (3, "a", "Leche", "x"), (4, "a", None, ""), (5, "b", "Lеche", " "), (6, "b", "Leche ", " "), (7, None, "Leche", "q"), (8, None, "Lеche", "q"), (9, "a", "Ｌeche", "​X"), (10, "a", "LECHE", "X " * 50_000)]
    df = spark.createDataFrame(rows, "pos long, id string, description string, brand string").repartition(3)
    change, want = canon.transducer(), set()
    for (p, i, *v), (q, j, *w) in combinations(rows, 2):
        for name, x, y in zip(("description", "brand"), v, w, strict=True):
            if i is not None and i == j and x and y and x.strip() and y.strip() and x != y and change(x) == change(y) and change(x).strip():
                want.add((p, q, name))
    got = [tuple(r) for r in canon.lookalike_pairs(df, "pos", "id", ["description", "brand"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert canon.lookalike_pairs(df.limit(0), "pos", "id", ["brand"]).count() == 0


def test_every_product_row_in_its_one_form(spark, tmp_path):
    from cotejo.llm.queries import QUERIES

    rows = [(1, "a", "Lеche", None, "Ｘ"), (2, None, "Leche", "toma\u200bte", ""), (3, "b", None, "ﬁletes", "Garćía")]
    spark.createDataFrame(rows, "pos long, id string, description string, denomination string, brand string").write.parquet(str(tmp_path / "products.parquet"))
    got = sorted(tuple(r) for r in QUERIES["p5_products"](spark, str(tmp_path)).select("pos", "id", "description", "denomination", "brand").collect())
    assert got == [(1, "a", "Leche", None, "X"), (2, None, "Leche", "tomate", ""), (3, "b", None, "filetes", "Garćía")]


@pytest.mark.parametrize(("a", "b"), [
    ("Пpивeт", "Привет"), ("\u0475i\u043d\u043e", "\u0475\u0456\u043d\u043e"), ("\u0475in\u043e t\u0456nto", "vino tinto"), ("\u0421\u041e\u0421\u0410", "COCA"), ("\U0001d400ceite \u216b \u2115", "Aceite XII N"),
    ("\u13aagua \u03b1zul", "Agua azul"), ("\u041fz p\u043e", "\u041fz po"), ("e\u0302\u0301\u0323x", unicodedata.normalize("NFC", "e\u0302\u0301\u0323x")), ("e\u0323\u200b\u0302x", "\u1ec7x"),
    ("\u1100\u1161\u11a8", "\uac01"), ("\u0432\u0438\u0306", "\u0432\u0439"), ("\ufb01\u0301n", unicodedata.normalize("NFC", "fi\u0301n")),
])
def test_scripts_clusters_and_styles(a, b):
    assert canon.transducer()(a) == b == canon.transducer()(b)


def test_equal_rows_meet_no_row(spark):
    rows = [(i, "hot", "Leche") for i in range(300)] + [(300 + i, "hot", "L\u0435che") for i in range(4)] + [(400, "hot", "Otra")]
    df = spark.createDataFrame(rows, "pos long, id string, brand string")
    assert {tuple(r) for r in canon.lookalike_pairs(df, "pos", "id", ["brand"]).collect()} == {(i, 300 + j, "brand") for i in range(300) for j in range(4)}
