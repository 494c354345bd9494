import pytest
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.functions.stemmer import stem

# Word and stem pairs as published with the algorithm.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign",
    "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "console": "consol",
    "consolidate": "consolid", "consolidating": "consolid", "conspiracy": "conspiraci",
    "conspirators": "conspir", "constable": "constabl", "constancy": "constanc",
    "knack": "knack", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish",
    "kneaded": "knead", "knees": "knee", "knell": "knell", "knelt": "knelt",
    "knightly": "knight", "knitting": "knit", "knocked": "knock", "knots": "knot",
    "generate": "generat", "generates": "generat", "generations": "generat",
    "general": "general", "generally": "general", "communism": "communism",
    "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "proceeds": "proceed",
    "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this",
    "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "hoped": "hope",
    "luxuriated": "luxuri", "cry": "cri", "by": "by", "say": "say", "happily": "happili",
    "relational": "relat", "sensibly": "sensibl", "apology": "apolog", "apologies": "apolog",
    "hopefulness": "hope", "boyish": "boyish", "youth": "youth", "feed": "feed",
    "agreed": "agre", "bed": "bed", "shred": "shred", "controlling": "control", "12": "12",
}


def test_published_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stem_column_keeps_nulls_and_empty(column):
    rows = [(["running", "dogs"],), (None,), ([],), (["skies"],)]
    got = column(rows, "w array<string>", text.stems(F.col("w")))
    assert got == [["run", "dog"], None, [], ["sky"]]


def test_analyze_text(column):
    rows = [("The Quick foxes, and the_fox 42!",), ("Ñandú—ÉTÉ",), ("",), ("of the",)]
    assert column(rows, "t string", text.analyze_text(F.col("t"), stemmed=False)) == [
        ["quick", "foxes", "fox", "42"], ["ñandú", "été"], [], []]
    assert column(rows[:1], "t string", text.analyze_text(F.col("t"))) == [
        ["quick", "fox", "fox", "42"]]


def test_path_tokens(column):
    got = column([("src/réf/my_file.test.py",)], "p string",
                 text.path_tokens(F.col("p"), stemmed=False))
    assert got == [["src", "r", "f", "file", "test", "py"]]


QUERIES = ["find the bash scripts", "", "--- ...", "generalizations of ands", "Deploy k8s-cluster.yaml",
           "ÑANDÚ été running", "a bb a-b ccc ddd", "whereas doing"]


@pytest.mark.parametrize("stemmed", [True, False])
def test_query_terms_agree_on_driver_and_columns(column, stemmed):
    got = column([(q,) for q in QUERIES], "q string", text.query_terms(F.col("q"), stemmed))
    assert got == [text.local_terms(q, stemmed) for q in QUERIES]


def test_query_terms_are_normalised_twice():
    assert text.local_terms("ands") == []  # the stem is a stop word


def test_longest_token(column):
    expected = ["scripts", "", "---", "generalizations", "k8s-cluster.yaml", "running", "a-b",
                "whereas"]
    got = column([(q,) for q in QUERIES], "q string", text.longest_token(F.col("q")))
    assert got == expected
    assert [text.local_longest_token(q) for q in QUERIES] == expected
