import hashlib
import itertools
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import bpe_transducer as bpe
from tests.llm.conftest import ODD

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.parse_ranks(bpe.read_ranks(bpe.default_ranks())))


@pytest.fixture(scope="module")
def encoder(merges):
    return bpe.Encoder(merges, PATTERN)


@pytest.fixture(scope="module")
def library(merges):
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=merges.ranks, special_tokens={}
    )


def _ids(encoder, text):
    return np.frombuffer(next(encoder.texts([text])), "<u4").tolist()


def _expected(rows, library):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        decoded = (text or "").encode()
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(), len(text or "")))
    return sorted(out, key=repr)


def test_query(spark, small, small_texts, library):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    found = sorted(map(tuple, bpe.op12_bpe_transducer(frame).collect()), key=repr)
    assert found == _expected(small_texts, library)


def test_awkward_rows(odd, library):
    found = sorted(map(tuple, bpe.op12_bpe_transducer(odd).collect()), key=repr)
    assert found == _expected(ODD, library)


def test_empty_table(documents):
    assert bpe.op12_bpe_transducer(documents()).collect() == []
    assert bpe.encode(documents()).collect() == []


TEXTS = [
    "", " ", "\n\n  a", "don't we'LL x's", "日本語 テキスト", "été 12,3", "🙂🙃 x", "a\x85b\xa0c　d",
    "՘꟎\U0003134b 1\U00011de0", "x" * 5000, "ab" * 3000, " " * 700, "\x00\x1c\x7f",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_like_the_library(encoder, library, text):
    assert _ids(encoder, text) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(encoder, library, text):
    assert _ids(encoder, text) == library.encode_ordinary(text)


def test_joined_tokens_like_the_library(encoder, merges, library):
    draw = random.Random(5)
    tokens = [t.decode() for t in merges.ranks if t.isascii() and b" " not in t]
    for _ in range(1500):
        text = "".join(draw.choices(tokens, k=draw.randint(1, 12)))
        assert _ids(encoder, text) == library.encode_ordinary(text)


def test_every_character_class_like_the_library(encoder, library):
    """One text with all characters, each between letters."""
    codes = [c for c in range(0x20, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)}" for c in codes)
    assert _ids(encoder, text) == library.encode_ordinary(text)


@pytest.mark.parametrize(
    "more", [["ab"], ["aa"], ["ab", "bc", "abc"], ["ab", "ba", "aba", "bab"], ["aa", "aaa", "aaaa"]]
)
def test_small_vocabularies_against_plain_merging(more):
    """All words of a small alphabet; tokens that no merge gives stand for themselves."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(more)}
    ranks[b"cab"] = 999  # nothing merges to it
    machine = bpe.Transducer(bpe.Merges(ranks), most_states=9)

    def plain(word):
        if word in ranks:
            return [ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [ranks.get(a + b, 10**9) for a, b in itertools.pairwise(parts)]
            if min(pairs, default=10**9) == 10**9:
                return [ranks[p] for p in parts]
            at = pairs.index(min(pairs))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    for length in range(7):
        for word in itertools.product(b"abc", repeat=length):
            assert machine.piece(bytes(word)) == plain(bytes(word))


def test_tokens_come_after_bounded_lookahead(merges):
    machine = bpe.Transducer(merges)
    longest = max(map(len, merges.ranks))
    state, ids, seen = 0, [], 0
    for byte in b"theinternationalisationof" * 40:
        state = machine.feed(bytes([byte]), state, ids)
        seen += 1
        done = sum(len(merges.bytes[i]) for i in ids)
        assert seen - done < 2 * longest


def test_forgetting_states_changes_nothing(merges, encoder):
    small = bpe.Transducer(merges, most_states=20)
    for piece in (b" international", b"\xe6\x97\xa5\xe6\x9c\xac", b"x" * 300, b" don"):
        assert small.piece(piece) == encoder.transducer.piece(piece)
        assert len(small.moves) <= 21


def test_bytes_must_be_tokens():
    with pytest.raises(ValueError, match="no token for bytes"):
        bpe.Merges({b"a": 0})


def _decoder(*tokens):
    return bpe.Decoder(dict(enumerate(tokens)))


def _stream(decoder, *parts):
    pairs = list(decoder.stream(np.array(p, np.uint32) for p in parts))
    return b"".join(d for d, _ in pairs), [t for _, t in pairs]


def test_text_waits_for_whole_characters():
    raw = "a🙂é".encode()
    decoder = _decoder(*[raw[i : i + 1] for i in range(len(raw))])
    data, texts = _stream(decoder, [0, 1], [2], [3, 4], [5], [6])
    assert data == raw
    assert texts == ["a", "", "🙂", "", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5), max_size=12), st.integers(1, 4))
def test_any_bytes_decode_as_a_whole(tokens, step):
    decoder = bpe.Decoder(dict(enumerate([b"x", *tokens])))
    ids = list(range(1, len(tokens) + 1))
    parts = [ids[i : i + step] for i in range(0, len(ids), step)]
    data, texts = _stream(decoder, *parts)
    assert data == b"".join(tokens)
    assert "".join(texts) == data.decode("utf-8", errors="replace")


def test_encode_and_decode_tables(odd, library):
    encoded = bpe.encode(odd.withColumnRenamed("slot", "IDS"))
    assert "shard" in encoded.columns and "IDS" not in encoded.columns
    rows = bpe.decode(encoded.withColumnRenamed("text", "before")).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert row.text == (row.before or "")
        assert row.ids == library.encode_ordinary(row.before or "")
        assert row.shard == "extra"
