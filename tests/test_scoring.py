import math

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scoring, trigrams, vectors


def test_trigram_sim(column):
    # The first value is the example of the trigram module's documentation.
    cases = [("two words", "word", 4 / 11), ("word", "word", 1.0), ("abc", "xyz", 0.0),
             ("", "x", 0.0), ("x", "", 0.0), ("src/Doc_12.PY", "doc_12.py", 10 / 14),
             ("a", "a", 1.0), ("aaaa", "aa", 3 / 4)]
    got = column([c[:2] for c in cases], "a string, b string",
                 trigrams.trigram_sim(F.col("a"), F.col("b")))
    assert got == pytest.approx([c[2] for c in cases])
    for left, right, expected in cases:
        assert column([(left,)], "a string", trigrams.trigram_sim_to(F.col("a"), right)) == \
            pytest.approx([expected])


def test_trigrams_of_odd_texts(column):
    token = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(120))
    rows = [(token,), (token[:60] + "/x",), ("zz",), ("",), (None,), ("//--",), ("été/ÑAN_a 1",),
            ("😀a𝒳b",), ("a" * 500,)]
    for other in (token, "a", "nan_1", "aaa"):
        fast = column(rows, "p string", trigrams.trigram_sim_to(F.col("p"), other))
        slow = column(rows, "p string", trigrams.trigram_sim(F.col("p"), F.lit(other)))
        assert fast == slow
    assert column(rows, "p string", trigrams.trigram_sim_to(F.col("p"), "--")) == [0.0] * len(rows)


VECTORS = [([1.0, 0.0],), ([0.0, 2.0],), ([-1.0, 0.0],), ([3.0, 4.0],), ([0.0, 0.0],), (None,)]


def test_cosine_sim(column):
    expected = [1.0, 0.0, 0.0, 0.6, 1.0, 0.0]  # opposite is 0, zero vector is 1, none is 0
    assert column(VECTORS, "v array<float>", vectors.cosine_sim(F.col("v"), [2.0, 0.0])) == expected
    query = F.array(F.lit(2.0), F.lit(0.0))
    assert column(VECTORS, "v array<float>", vectors.cosine_sim_sql(F.col("v"), query)) == expected


def test_cosine_sim_edges(column, spark):
    assert column(VECTORS, "v array<float>", vectors.cosine_sim(F.col("v"), None)) == [0.0] * 6
    zero = column(VECTORS, "v array<float>", vectors.cosine_sim(F.col("v"), [0.0, 0.0]))
    assert zero == [1.0] * 5 + [0.0]
    with pytest.raises(Exception, match="different vector dimensions"):
        column(VECTORS, "v array<float>", vectors.cosine_sim(F.col("v"), [1.0, 0.0, 0.0]))


def test_lexical_rank(column):
    rows = [("alpha beta",), ("alpha alpha beta gamma",), ("alphabet",), (None,), ("ALPHA-beta",),
            ("alpha_x",)]
    for stemmed in (True, False):
        got = column(rows, "s string", scoring.lexical_rank(F.col("s"), ["alpha", "beta"], stemmed))
        assert got == pytest.approx([0.8, 1.0, 0.0, 0.0, 0.8, 0.4])
    assert column(rows[:1], "s string", scoring.lexical_rank(F.col("s"), [])) == [0.0]
    got = column([("scripts running",)], "s string",
                 scoring.lexical_rank(F.col("s"), ["run", "script"]))
    assert got == pytest.approx([0.8])


def test_asked_for_script(column):
    cases = {"find client": True, "decode": True, "Python": True, "readme": False, "": False}
    got = column([(q,) for q in cases], "q string", scoring.asked_for_script(F.col("q")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_script_bias(column):
    languages = ["shell", "bash", "go", "yaml", "tf", "json", "markdown", None, "Go"]
    got = column([(v,) for v in languages], "l string", scoring.script_bias(F.col("l"), True))
    assert got == [1, 1, 1, -1, -1, -1, 0, 0, 0]
    got = column([(v,) for v in languages], "l string", scoring.script_bias(F.col("l"), False))
    assert got == [0] * 9


def test_noise_penalty(column):
    cases = {"a/test/x.go": 1, "test/x": 1, "a/test": 1, "TEST/x": 1, "a/tests/x": 0, "a/test.go": 0,
             "a/mytest/x": 0, "a/test\\x": 1, "a/tmp/b": 1, "sandbox": 1, "a/temp\n": 0, "src/x": 0}
    got = column([(p,) for p in cases], "p string", scoring.noise_penalty(F.col("p")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_hybrid_score(column):
    rows = [(1.0, 0.4, 0.5, 1, 0, 1.0, 0.8, 0.5), (0.5, 0.0, 0.0, -1, 1, 0.5, 0.0, 0.0),
            (0.0, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0)]
    names = ["sem", "lex", "tri", "bias", "noise", "ms", "ml", "mt"]
    schema = ", ".join(f"{n} {'int' if n in ('bias', 'noise') else 'double'}" for n in names)
    got = column(rows, schema, scoring.hybrid_score(*map(F.col, names)))
    assert got == pytest.approx([0.80 + 0.075 + 0.05 + 0.10, 0.80 - 0.10 - 0.07, 0.0])


def test_sanitize_score(column):
    rows = [(math.nan,), (math.inf,), (-math.inf,), (None,), (0.25,), (-0.1,)]
    assert column(rows, "s double", scoring.sanitize_score(F.col("s"))) == [0, 0, 0, 0, 0.25, -0.1]
