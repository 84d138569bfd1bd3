import random

from hypothesis import given
from hypothesis import strategies as st

from cotejo.llm import bktree

WORDS = st.text("abcd", max_size=7)


def _plain(a, b, swaps):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(WORDS, WORDS, WORDS)
def test_distances_are_metrics(a, b, c):
    assert bktree.levenshtein(a, b) == _plain(a, b, False)
    for d in (bktree.levenshtein, bktree.damerau):
        assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)
    assert bktree.damerau(a, b) <= _plain(a, b, True) <= bktree.levenshtein(a, b) <= 2 * bktree.damerau(a, b)


@given(st.lists(WORDS, max_size=25), WORDS)
def test_tree_finds_all_within(words, key):
    tree = bktree.BKTree([(w, i) for i, w in enumerate(words)])
    for radius in (0, 1, 3):
        assert {(d, w) for d, w, _ in tree.within(key, radius)} == {(bktree.levenshtein(key, w), w) for w in words if bktree.levenshtein(key, w) <= radius}


def test_keys():
    same = ["La Gonnulzes", "MARCA: La Gonnulzes", "la gonnulzes S.L.", "Gonnulzes, La", "L. Gonnulzes", "by La Gonnulzes", "(La Gonnulzes)", "La Gonnulzes (marca)", "La Gonnulzes®", "Lа Ｇｏｎｎｕｌｚｅｓ", "la_gonnulzes", '"La Gonnulzes"', "* La Gonnulzes", "La Gonnulzes."]
    assert {bktree.brand_key(v) for v in same} == {"lagonnulzes"}
    assert [bktree.brand_key(v) for v in ("-", "N/A", "sin marca", "", "  ", "™")] == [""] * 6


REFERENCE = [(1, "La Gonnulzes"), (2, "Pagrennis"), (3, "Zubosfir Hermanos"), (4, None), (5, "--")]
VALUES = ["Pagrenins", "PAGRENIS", "Zubosfir Hnos.", "Zubosfir Hermanos", "la gonitlzes", "otra cosa", "N/A", "", None, " ", "Pagrennis", "x" * 100_000, "ab"]


def test_rows(spark):
    df = spark.createDataFrame(list(enumerate(VALUES * 3)), "pos long, brand string").withColumn("brand_id", bktree.F.lit("clash"))
    ref = spark.createDataFrame(REFERENCE, "brand_id long, brand_name string")
    got = {(r["pos"] % len(VALUES), r["brand_id"]) for r in bktree.map_rows(df, "pos", "brand", ref, "brand_id", "brand_name").collect()}
    assert got == {(0, 2), (1, 2), (2, 3), (4, 1), (5, 0), (6, 0), (11, 0), (12, 0)}
    assert bktree.map_rows(df.limit(0), "pos", "brand", ref, "brand_id", "brand_name").count() == 0
    assert {r["brand_id"] for r in bktree.map_rows(df, "pos", "brand", ref.limit(0), "brand_id", "brand_name").collect()} == {0}


def test_shards_give_the_same(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcde") for _ in range(7))
    ref = spark.createDataFrame([(i, word()) for i in range(60)], "brand_id long, brand_name string")
    df = spark.createDataFrame([(word(),) for _ in range(150)], "brand string")
    one, many = (sorted(map(tuple, bktree.map_values(df, "brand", ref, "brand_id", "brand_name", shard_entries=n, block_keys=40).collect())) for n in (1000, 7))
    assert one == many and any(r[2] is not None for r in one)


@given(st.lists(WORDS, max_size=25), st.text("abcd", max_size=10))
def test_best_is_the_closest_of_all(words, key):
    edits = min(2, len(key) // 3)
    near = min(((d, i) for i, w in enumerate(words) if (d := bktree.damerau(key, w)) <= edits), default=None)
    assert bktree.BKTree([(w, i) for i, w in enumerate(words)]).best(key) == near


def test_wording_is_a_parameter(spark):
    german = bktree.Wording(short=(("gebr.", "gebrüder"),), fillers=("ohne marke",), after="gmbh|ag")
    assert [bktree.brand_key(v, german) for v in ("Gebr. Meier GmbH", "ohne Marke", "Müller AG")] == ["gebrüdermeier", "", "muller"]
    df = spark.createDataFrame([(1, "Meyer GmbH"), (2, "ohne Marke")], "pos long, brand string")
    ref = spark.createDataFrame([(7, "Meier AG")], "brand_id long, brand_name string")
    assert {tuple(r) for r in bktree.map_rows(df, "pos", "brand", ref, "brand_id", "brand_name", german).collect()} == {(1, 7), (2, 0)}
