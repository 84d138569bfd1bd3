import numpy as np

from cotejo.llm import quality

COMMON = "de la el en y a que con para los un una no se por su the and of to is it for".split()
PROSE = "La leche de la casa es muy buena y no se corta con el café. Me gusta tomarla por la mañana, aunque el envase se queda corto para los niños. Volveré a comprarla en la tienda de al lado."
LIST = "- Leche entera\n- Arroz redondo\n- Galletas de avena\n- Atún claro\n- Miel"
SEPARATED = "azúcar, harina de trigo, huevo líquido, sal, aroma natural, tomate, vinagre, aceite, ajo, pimentón"
TABLE = "producto;formato;pvp;stock\nLeche;1 l;1,20;40\nArroz;1 kg;2,35;17\nMiel;500 g;4,10;8\nCafé;250 g;3,90;22"
PAIRS = "Grasas: 12.0 g\nSal: 1.4 g\nFibra ..... 3.1 g\nProteínas\t9.2 g\nHierro = 7 mg"
JUNK = ["!#+?*$+!#!)>%(/ &^(?<%^<&?~&=~%^=>()+)^/%+>*)>", "0586892036644 0384188373776 0419464306476 0459071570290", "XTnnv5rPbB1rFFY2XsDukYU7RJmv9gwpNp17QW8KSIzovWDFJk5O3IcfT7UfoESFu7PfRRoWTTT", "oferta " * 60, "Inicio | Ayuda | Menú | Volver | Inicio | Ayuda | Entrar | Menú | Aceptar", "cgtxb ckzvdqs wsfjwflngdq hqq kxxglqxj nlqkw lck fdhlvvz kjklv gvzwjqghr"]


def _corpus():
    rows = [(f"prose{i}", PROSE + f" Son {i} euros en total.") for i in range(40)] + [(f"list{i}", LIST + f"\n- Pan {'abcdef'[i]}") for i in range(6)]
    rows += [(f"list_s{i}", SEPARATED) for i in range(4)] + [(f"table{i}", TABLE) for i in range(5)] + [(f"table_p{i}", PAIRS) for i in range(3)]
    return rows + [(f"junk{i}", t) for i, t in enumerate(JUNK)] + [("blank", " \n\t"), ("empty", ""), ("null", None), ("nbsp", "  "), ("prose_long", PROSE * 400)]


def test_types_and_edges(spark):
    df = spark.createDataFrame(_corpus(), "doc_id string, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality.text_types(df, "doc_id", "text", COMMON).collect()}
    for name, row in got.items():
        want = next((k for k in quality.KINDS if name.startswith(k)), None)
        assert row["doc_kind"] == want, name
        assert (row["posterior"] is None) == (want is None) and (want is None or abs(sum(row["posterior"]) - 1) < 1e-9)
    assert got["null"]["n_words"] == 0 and got["prose0"]["n_lines"] == 1 and got["prose_long"]["n_words"] > 15_000
    assert quality.text_types(df.limit(0), "doc_id", "text", COMMON).count() == 0


def test_statistics_are_plain_counts(spark):
    row = quality.statistics(spark.createDataFrame([("x", "Uno dos, tres.\r\ncuatro 55!\n\nsin punto")], "i string, t string"), "i", "t", ["dos", "sin"]).first()
    assert (row["n_lines"], row["n_words"], row["n_tokens"], row["n_distinct_words"]) == (3, 6, 7, 6)
    assert abs(row["common_share"] - 2 / 6) < 1e-9 and abs(row["ended_share"] - 2 / 3) < 1e-9 and row["longest_token"] == 6


def test_steps_agree_whether_local_or_distributed(spark, monkeypatch):
    own = [k for k, _ in quality.labelling_functions().values()]
    rng = np.random.default_rng(0)
    patterns = spark.createDataFrame([(int(rng.integers(1 << 20)), int(rng.integers(1, 9))) for _ in range(200)], "votes long, n long").repartition(3)
    a = quality.learn(patterns, own, 4)
    monkeypatch.setattr(quality, "LOCAL_PATTERNS", 10)
    b = quality.learn(patterns, own, 4)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])
