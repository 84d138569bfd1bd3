from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm import identity
from cotejo.llm.bktree import damerau


@pytest.mark.parametrize(("text", "code"), [("EAN 8410010255610", None), ("ean 4006381333931 x", "04006381333931"), ("96385074", "00000096385074"), ("4006381333932", None), ("0000000000000", None), ("precio 12,5 kg", None), ("4-006381-333931", "04006381333931")])
def test_check_digits(text, code):
    assert identity.gtins(text) == ([code] if code else [])


def test_every_valid_number_and_part_number_is_read():
    assert identity.gtins("a 4006381333931 b 8410010255612 c 96385074 d 4006381333931") == ["04006381333931", "00000096385074"]
    for text, parts in (("taladro makita hp457d", ["hp457d"]), ("hp-457-d 18 v", ["hp457d"]), ("dhp453.rfe, x-12", ["dhp453rfe"]), ("pack 12 de 33cl x6 b12", []), ("abc/1234 zz99-8", ["abc1234", "zz998"])):
        assert identity.part_numbers(text) == parts


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=9), st.text("ab", max_size=9), st.integers(1, 2))
def test_within_edits_is_the_distance(a, b, most):
    assert identity.within_edits(a, b, most) == (damerau(a, b) <= most)


@given(st.integers(8, 120), st.lists(st.tuples(st.sampled_from("idrs"), st.floats(0, 0.999)), max_size=2), st.randoms(use_true_random=False))
def test_signatures_of_near_words_meet(n, edits, random):
    word = "".join(random.choice("abcdefgh") for _ in range(n))
    other = word
    for kind, at in edits:
        i = int(at * (len(other) - 1))
        other = {"i": other[:i] + "z" + other[i:], "d": other[:i] + other[i + 1 :], "r": other[:i] + "y" + other[i + 1 :], "s": other[:i] + other[i + 1] + other[i] + other[i + 2 :]}[kind]
    assert set(identity.signatures(word)) & set(identity.signatures(other))
    assert identity.within_edits(word, other, 2)


def test_listing_parts():
    reader = identity.Reader(identity.Vocabulary.of(identity.read_vocabulary()), ("EROSKI",))
    read = reader.read("2ª unidad al 50% Leche Sikojol pack 3 uds de 200 ml lactose free Pídanbra Hermanos [€ por 100 ml]", "Pídanbra Hnos.")
    assert read[2:6] == ("leche", "sin lactosa", "l:3:200", "pidanbrahermanos") and read[6] == ["sikojol"]
    assert reader.read("1/2 kg Lent. cocida c/ajo Vanelar", "Eroski")[2:6] == ("lenteja", "ajo", "kg:1:500", "")
    assert reader.read(None, None)[:6] == ([], [], "", "", None, "")
    assert reader.read("Taladro Siko jol 18V", "Makita")[6:] == (["taladro", "siko", "jol", "v"], ["taladrosiko", "sikojol", "jolv"], ["makita"], ["18"])
    for text, content in (("Zumo 6x33cl", "l:6:330"), ("Huevos 1 docena", "ud:1:12"), ("Pan medio kilo", "kg:1:500"), ("Leche 0,2 L", "l:1:200"), ("Miel", None)):
        assert identity.read_content(identity.fold(text))[0] == content
    assert set(identity.deletions("abc", 1)) == {"abc", "bc", "ac", "ab"}


GROUPS = [
    [("1", "Leche Sikojol sin lactosa 1,5 L Gonnulzes", "Gonnulzes", 1.5, "1 €/l"), ("2", "SIKOJOL - Leche 1500 ml (lactose free)", "Gonnulzes", 1.6, None), ("3", "Gonnulzes Sikkojol Leche UHT s/lactosa, 1.5 lt", None, 1.5, "1 €/l"), ("4", "Leche s/lactosa Siko jol Gonnulzes", "MARCA: Gonnulzes", 1.5, "0,10 €/100 ml"), ("1", "Leche Sikojol sin lactosa 1,5 L Gonnulzes", "Gonnulzes", 1.5, "1 €/l")],
    [("5", "Leche Sikojol sin lactosa 6 x 250 ml Gonnulzes", "Gonnulzes", 1.5, "1 €/l"), ("6", "Leche Sikojol lactose free pack 6 uds de 25 cl", "Gonnulzes", 1.5, "1 €/l")],
    [("7", "Leche Sikojol semidesnatada 1,5 L", "Gonnulzes", 1.5, "1 €/l")],
    [("8", "Atún claro Sikojol con tomate 100 g", "Pagrennis", 1.5, None), ("9", "ATUN CL. EN TOMATE SIKOJOL 0,1 kg", "Pagrennis", 1.4, None)],
    [("10", "Atún claro Sikojol con tomate 100 g", "Zubosfir", 1.5, None)],
    [("11", "", None, None, None)], [("12", None, None, None, None)], [("13", "x" * 50_000, "y" * 50_000, 1.0, "1 €/l")], [("14", "palabra " * 20_000, None, None, None)],
]


def test_pairs(spark):
    rows, want, n = [], set(), 0
    for group in GROUPS:
        ids = range(n, n + len(group))
        rows += [(i, *row) for i, row in zip(ids, group, strict=True)]
        want |= set(combinations(ids, 2))
        n += len(group)
    df = spark.createDataFrame(rows, "rep_id long, id string, description string, brand string, price double, unit_price string").repartition(3)
    assert {tuple(r) for r in identity.same_product_pairs(df, "rep_id").collect()} == want
    assert identity.products(df, "rep_id").count() == n
    assert identity.same_product_pairs(df.limit(0), "rep_id").count() == 0


def test_guard_cuts_a_key_of_different_goods(spark):
    rows = [(1, "same", "Leche Sikojol semi 1 L", "G", 1.0, None), (2, "same", "Leche Sikojol semi 2 L", "G", 2.0, None), (3, "x", "Leche Sikojol semi 1 L 4006381333931", "G", 1.0, None), (4, "y", "Otra cosa 4006381333931", "G", 1.0, None)]
    df = spark.createDataFrame(rows, "rep_id long, id string, description string, brand string, price double, unit_price string")
    assert {tuple(r) for r in identity.same_product_pairs(df, "rep_id").collect()} == {(1, 3), (1, 4), (3, 4)}


SCHEMA = "rep_id long, id string, description string, brand string, price double, unit_price string"


def test_goods_outside_the_vocabulary(spark):
    rows = [
        (1, "a", "Taladro Makita HP457D 18V percutor", "Makita", None, None), (2, "b", "Makita HP-457-D taladro percutor 18 V", "MAKITA", None, None), (3, "c", "Makita HP-458-D taladro percutor 18 V", "Makita", None, None),
        (4, "d", "Zapatilla Runner Nike azul talla 42", "Nike", 59.0, None), (5, "e", "NIKE - zapatilla azul «Runner» (talla 42)", "nike", 60.0, None), (6, "f", "Zapatilla Runner Nike roja talla 42", "Nike", 59.0, None), (7, "g", "Zapatilla Runner Nike azul talla 43", "Nike", 59.0, None),
        (8, "h", "Taladro HP457D 18V percutor", "Bosch", None, None), (9, "i", "", "Nike", None, None), (10, "j", "", "Nike", None, None),
    ]
    got = {tuple(r) for r in identity.same_product_pairs(spark.createDataFrame(rows, SCHEMA), "rep_id").collect()}
    assert got == {(1, 2), (4, 5)}


def test_another_vocabulary(spark):
    words = {"kinds": [{"calzado": ["zapatilla", "depor-"]}], "varieties": {"azul": "azul(?:es)?|blue", "rojo": "roj[oa]"}, "kind_of_variety": []}
    rows = [(i, str(i), t, "Nike", 50.0, "50 €/par") for i, t in enumerate(["Zapatilla Runner azul, 1 ud", "Deportiva Runner blue 1 unidad", "Zapatilla Walker azul 1 ud", "Zapatilla Runner roja 1 ud"])]
    assert {tuple(r) for r in identity.same_product_pairs(spark.createDataFrame(rows, SCHEMA), "rep_id", words).collect()} == {(0, 1)}


def test_guard_cuts_a_component_of_different_goods(spark):
    rows = [
        (1, "p", "Leche Sikojol semi 1 L 4006381333931", "G", 1.0, None), (2, "q", "Otra cosa 4006381333931", None, None, None), (3, "q", "Otra cosa mas 8412345678905", None, None, None),
        (4, "r", "Leche Sikojol semi 2 L 8412345678905", "G", 2.0, None), (5, "s", "Leche Sikojol semi 1 L", "G", 1.0, None),
    ]
    got = {r["row"]: r["product"] for r in identity.products(spark.createDataFrame(rows, SCHEMA), "rep_id").collect()}
    assert got[1] == got[5] and got[1] != got[4] and set(got) == {1, 2, 3, 4, 5}


def test_long_words_are_respelled(spark):
    long = "abcdefghij" * 6
    words = [("", long, 9), ("", long[:20] + "x" + long[20:], 1), ("", long[:-2], 1), ("", "q" * 60, 1), ("", long[1:] + "zz", 1)]
    got = {(r["word"], r["target"]) for r in identity.merge_spellings(spark.createDataFrame(words, "block string, word string, n long")).collect()}
    assert got == {(words[1][1], long), (words[2][1], long)}


def test_long_chains_and_stars(spark):
    chain = [(f"k{i}", f"n{(i + j) * 37 % 401:03}") for i in range(400) for j in (0, 1)]
    star = [("hub", f"s{i:03}") for i in range(300)]
    got = {r["v"]: r["label"] for r in identity.components(spark.createDataFrame(chain + star, "u string, v string")).collect()}
    assert {got[v] for _, v in chain} == {"n000"} and {got[v] for _, v in star} == {"s000"}


def test_components(spark):
    edges = [("u1", "a"), ("u1", "b"), ("u2", "b"), ("u2", "c"), ("u3", "d"), ("u3", "e"), ("u4", "c"), ("u4", "z")]
    got = {r["v"]: r["label"] for r in identity.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "z": "a", "d": "d", "e": "d"}


def test_incomplete_rows_join_by_a_reliable_key(spark):
    rows = [
        (1, "X", "Leche Sikojol semi 1 L", "G", 1.0, None), (2, "X", "Leche Sikojol semi", "G", None, None),
        (3, None, "Leche Sikojol semi 3 L 4006381333931", "G", 3.0, None), (4, None, "Otra cosa 4006381333931", "G", None, None),
        (5, "Y", "Leche Sikojol semi 1000 ml", "G", 1.0, None), (6, "Y", "Otra cosa", None, None, None), (7, "Z", "Otra cosa", None, None, None),
    ]
    df = spark.createDataFrame(rows, "rep_id long, id string, description string, brand string, price double, unit_price string")
    got = {tuple(r) for r in identity.same_product_pairs(df, "rep_id").collect()}
    assert got == {*combinations((1, 2, 5, 6), 2), (3, 4)}
