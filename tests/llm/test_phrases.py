import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery.llm import phrases
from tests.llm.conftest import ODD


def _plain(rows, least=30, first=2000):
    """The contract over Python lists; rows are (lang, text)."""
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        ranked = []
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * inside[p] < 80 * a:
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:first]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def _found(frame):
    return sorted(map(tuple, phrases.op13_phrases(frame).collect()))


def test_query(spark, small):
    rows = duckdb.sql(f"SELECT lang, text FROM '{small}/documents.parquet'").fetchall()
    frame = spark.read.parquet(f"{small}/documents.parquet")
    found = _found(frame)
    assert found and found == _plain(rows)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert found == sorted(connection.execute(phrases.OP13_SQL).fetchall())


LINES = (
    "New York is big, new york city IS big! Great\tnew  york\n" * 9
    + "a b c d e. a b c d; b c d: x y?x y\x0bnew york " * 13
)


def test_small_tables(documents):
    rows = [
        (1, LINES, "s0"), (2, LINES, "s0"), (2, LINES, "s0"), (3, "ä b " * 40, "s0"),
        (4, "Ä b " * 40, "s0"), (5, "r r r r " * 20, "s0"), (None, "r r " * 31, "s0"),
    ]
    lang = F.when(F.col("doc_id") == 3, "fr").when(F.col("doc_id") == 4, "und")
    lang = lang.when(F.col("doc_id") < 3, "en")
    frame = documents(*rows).withColumn("lang", lang)
    pairs = [(r.lang, r.text) for r in frame.collect()]
    found = _found(frame)
    assert {r[0] for r in found} == {"en", "fr", "und"}
    assert found == _plain(pairs)


def test_awkward_rows(odd):
    extra = odd.withColumns({c: F.lit("extra") for c in ("phrase", "prefix", "words", "rank")})
    many = extra
    for _ in range(4):  # enough repeats for candidates
        many = many.unionAll(many)
    assert _found(many) == _plain([("en", t) for _, t in ODD] * 16)


def test_empty_tables(documents):
    assert _found(documents()) == []
    assert _found(documents((1, None), (2, ""), (3, " .,; \t"))) == []


def test_spills_change_nothing(documents, small_texts):
    frame = documents(*small_texts)
    most = [r for r in phrases.count_phrases(frame)]
    few = [r for r in phrases.count_phrases(frame, most=50)]
    for a, b in zip(most, few, strict=True):
        assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)


def test_a_full_filter_changes_nothing(documents, small_texts, monkeypatch):
    frame = documents(*small_texts)
    before = sorted(map(tuple, phrases.op13_phrases(frame).collect()))
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    assert before == sorted(map(tuple, phrases.op13_phrases(frame).collect()))


@pytest.mark.parametrize("first", [1, 3, 100])
def test_first_of_each_lang(spark, first):
    rows = [(lang, f"p{i}", i % 7, i % 3) for lang in ("a", "b") for i in range(60)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, score bigint, a bigint")
    found = phrases.first_of_each(frame, first).collect()
    for lang in ("a", "b"):
        wanted = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[2], -r[3], r[1]))
        own = sorted((r for r in found if r.lang == lang), key=lambda r: r["rank"])
        assert [r.phrase for r in own] == [r[1] for r in wanted[:first]]


def test_scores_beyond_64_bits_are_exact(spark):
    big = 2**62 + 12345
    rows = [("x", "a", 1, big), ("x", "b", 1, big + 7), ("x", "a b", 2, big - 5)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, n bigint")
    row = phrases.score_cuts(counted).first()
    assert row.score == 2_000_000 * (big - 5) // (2 * big + 7)


def test_trie_bursts_and_spills_whole_subtrees():
    trie = phrases.HatTrie(3, burst=4)
    counts = Counter()
    for i in range(300):
        phrase = (i % 3, i % 5, i % 7, *([i % 2] if i % 2 else []))
        trie.add(phrase, i)
        counts[phrase] += i
    assert type(trie.root) is phrases._Branch
    spilled = trie.spill(keep=trie.entries // 2)
    firsts = {p[0] for p, _ in spilled}
    rest = trie.spill()
    assert firsts.isdisjoint({p[0] for p, _ in rest})
    assert trie.entries == 0
    assert dict(spilled + rest) == counts
