import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm import mixing


def _plain(weights, seats, caps):
    out = {k: 0 for k in weights}
    for _ in range(seats):
        open_ = [k for k in weights if out[k] < caps.get(k, seats)]
        if not open_:
            break
        out[max(open_, key=lambda k: (weights[k] / (2 * out[k] + 1), -ord(k)))] += 1
    return out


@given(st.dictionaries(st.sampled_from("abcde"), st.integers(1, 50), min_size=1), st.integers(0, 60))
def test_quotas_by_highest_quotients(weights, seats):
    assert mixing.sainte_lague(weights, seats) == _plain(weights, seats, {})


def _by_quotients(weights, seats, caps):
    quotients = sorted((-w / (2 * i + 1), str(k), i, k) for k, w in weights.items() for i in range(min(seats, caps.get(k, seats))))
    out = dict.fromkeys(weights, 0)
    for *_, k in quotients[:seats]:
        out[k] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=500), st.integers(0, 20_000), st.integers(0, 400), st.booleans())
def test_one_dominant_among_hundreds(small, large, seats, capped):
    weights = {f"p{i:03}": w for i, w in enumerate(small)} | {"large": large + 1}
    caps = {"large": seats // 3, "p000": 1} if capped else {}
    assert mixing.sainte_lague(weights, seats, caps) == _by_quotients(weights, seats, caps)


def test_no_party_is_certain_of_its_share():
    small = {f"s{i}": 0.0069 for i in range(8)}
    assert mixing.sainte_lague({"big": 0.9448} | small, 80)["big"] == 72
    equal = {i: 1 for i in range(4000)}
    assert mixing.sainte_lague(equal | {"x": 3000}, 4200) == _by_quotients(equal | {"x": 3000}, 4200, {})


def test_caps_hold_and_seats_go_on():
    out = mixing.sainte_lague({"a": 90, "b": 10, "c": 1}, 20, {"a": 5, "c": 2})
    assert out["a"] == 5 and out["c"] <= 2 and sum(out.values()) == 20
    assert mixing.sainte_lague({}, 5) == {} and mixing.sainte_lague({"a": 1}, 9, {"a": 4}) == {"a": 4}


def test_shares_repeats_and_edges(spark):
    random.seed(4)
    sources = [("big", 600), ("mid", 200), ("small", 40)]
    rows = [(i, s, "palabra de casa " * random.randint(3, 40)) for i, s in enumerate(s for s, n in sources for _ in range(n))]
    rows += [(9001, "big", None), (9002, "big", ""), (9003, None, "sin fuente"), (9004, "other", "no target")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, "doc_id", "text", "source", targets)
    got = {r["source"]: r for r in report.collect()}
    assert not got["none"]["filled"] and got["none"]["actual_share"] == 0 and set(got) == {"big", "mid", "small", "none"}
    for s, w in (("big", 0.4), ("mid", 0.3), ("small", 0.2)):
        assert abs(got[s]["actual_share"] - w / 0.9) < 0.01 and got[s]["most_repeats"] <= got[s]["max_repeats"]
    assert got["small"]["tokens"] > 0.97 * got["small"]["allowed_tokens"]
    ids = [r["doc_id"] for r in chosen.collect()]
    assert len(ids) == len(set(ids)) and max(ids) < 9000
    again = mixing.mix(df.repartition(3), "doc_id", "text", "source", targets)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in chosen.collect()}
    empty = mixing.mix(df.limit(0), "doc_id", "text", "source", targets)
    assert empty[0].count() == 0 and {r["filled"] for r in empty[1].collect()} == {False}


def test_no_repeats_given_is_once_and_none_allowed_leaves_the_others(spark):
    rows = [(i, "abc"[i % 3], "palabra de casa " * (5 + i % 30)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, None), ("c", 0.2, 0)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, "doc_id", "text", "source", targets)
    got = {r["source"]: r for r in report.collect()}
    assert not got["c"]["filled"] and abs(got["a"]["actual_share"] - 0.5) < 0.01 and abs(got["b"]["actual_share"] - 0.5) < 0.01
    assert got["b"]["most_repeats"] == got["b"]["max_repeats"] == 1 and {r["source"] for r in chosen.collect()} == {"a", "b"}
