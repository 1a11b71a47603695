import math

import pytest
from pyspark.sql import functions as F

from skeinrank.functions import analysis, stemmer, stemmers
from skeinrank.functions.analysis import language_terms
from skeinrank.functions.fieldnorm import quantize, quantize_int
from skeinrank.functions.scoring import idf_value, weight_value
from skeinrank.types import Bm25Query, Bm25Vector, IndexSpec


def test_quantize_column_equals_numbers(spark):
    values = [*range(0, 3000), 65535, 65536, 10**6, 10**9, 2013265944]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", quantize("n").alias("q")).collect()
    for r in got:
        assert r["q"] == quantize_int(r["n"])
        assert r["q"] <= r["n"] and quantize_int(r["q"]) == r["q"]
    assert [quantize_int(n) for n in (39, 40, 41, 42, 55, 56, 59, 60)] == [39, 40, 40, 42, 54, 56, 56, 60]


# (tf, dl, avgdl, df, n, qf) and the score: known values
KNOWN = [
    ((1, 2, 2.5, 1, 2, 1), 0.754913), ((1, 3, 2.5, 1, 2, 1), 0.640724), ((255, 255, 122.6, 4, 5, 1), 0.627681), ((100, 100, 122.6, 4, 5, 1), 0.626605),
    ((1, 256, 122.6, 4, 5, 1), 0.202817), ((200, 200, 72.2, 5, 5, 1), 0.188789), ((1, 2, 2, 2, 3, 1), 0.470004), ((3, 3, 8 / 3, 2, 3, 2), 1.438620), ((1, 2, 2, 1, 1, 1), 0.287682),
]


@pytest.mark.parametrize(("case", "want"), KNOWN)
def test_known_scores(case, want):
    tf, dl, avgdl, df, n, qf = case
    assert weight_value(tf, quantize_int(dl), avgdl, df, n, qf=qf) == pytest.approx(want, abs=1e-6)


def test_idf_is_positive():
    assert all(idf_value(df, n) > 0 for n in range(1, 40) for df in range(1, n + 1))
    assert idf_value(1, 2) == pytest.approx(math.log(2))


@pytest.mark.parametrize(("word", "stem"), [("databases", "databas"), ("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"),
                                            ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("happy", "happi"), ("sky", "sky"), ("national", "nation"),
                                            ("knightly", "knight"), ("consistency", "consist"), ("adjustment", "adjust"), ("probate", "probat"), ("controlling", "control")])
def test_english_stems(word, stem):
    assert stemmer.english(word) == stem


def test_english_terms_drop_stop_words_and_split_hyphens():
    assert language_terms("english", "The quick brown fox jumps over the lazy dog", {}) == ["quick", "brown", "fox", "jump", "lazi", "dog"]
    assert language_terms("english", "a well-known fact", {}) == ["well-known", "well", "known", "fact"]


def test_specification_limits():
    for bad in ({"k1": 0.05}, {"k1": 10.5}, {"b": -0.1}, {"b": 1.1}, {"column": "lower(text)"}, {"name": ""}):
        with pytest.raises(ValueError):
            IndexSpec(**({"name": "i", "column": "c"} | bad))


def test_query_and_vector_text_forms():
    q = Bm25Query.parse("idx:search terms:french", known={"idx"})
    assert (q.index, q.text, q.language) == ("idx", "search terms", "french") and str(q) == "idx:search terms:french"
    assert Bm25Query.parse("search terms") == Bm25Query("search terms")
    assert Bm25Query("a", "i", language="x") == Bm25Query("a", "i", tenant_id=4)
    with pytest.raises(ValueError, match="does not exist"):
        Bm25Query.parse("nowhere:x", known={"idx"})
    v = Bm25Vector.parse("idx:{world:1,hello:2}")
    assert v == Bm25Vector.parse("idx:{hello:2,world:1}") and str(v) == "idx:{hello:2,world:1}" and v != Bm25Vector.parse("other:{hello:2,world:1}")
    assert str(Bm25Vector.parse("idx:{}")) == "idx:{}"
    for bad in (":{a:1}", "idx", "idx:{a}"):
        with pytest.raises(ValueError):
            Bm25Vector.parse(bad)


@pytest.mark.parametrize(("language", "pairs"), [
    ("french", "chevaux cheval majestueusement majestu continuation continu continuellement continuel mangeons mangeon rapide rapid saute saut chien chien renard renard"),
    ("german", "aufeinanderfolge aufeinanderfolg häuser haus kategorien kategori schönheit schonheit bücher buch"),
    ("spanish", "chicas chic torneado torn torneos torne toreros torer canciones cancion rápidamente rapid"),
])
def test_other_stems(language, pairs):
    words = pairs.split()
    assert [getattr(stemmers, language)(w) for w in words[::2]] == words[1::2]


def test_french_compounds():
    terms = language_terms("french", "Le renard brun rapide saute par-dessus le chien", {})
    assert terms == ["renard", "brun", "rapid", "saut", "par-dessus", "dessus", "chien"]


def test_stop_words_are_looked_up_in_a_set(spark):
    """Not by comparing each word with the whole list."""
    df = spark.createDataFrame([(1, "The cat and THE hat, of a king"), (2, None), (3, "the the")], "doc_id long, text string").select("doc_id", analysis.analyzer("english_stop")(F.col("text")).alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() and "array_contains" not in plan
    assert {r["doc_id"]: r["t"] for r in df.collect()} == {1: ["cat", "hat", "king"], 2: None, 3: []}
