import struct
import zlib

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gleanery.llm import token_output
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_output.default_tokenizer())


def _expected(rows, tokenizer):
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_query(spark, small, small_texts, tokenizer):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    found = sorted(map(tuple, token_output.op6_token_output(frame).collect()))
    assert found == _expected(sorted(small_texts), tokenizer)


def test_awkward_rows(odd, tokenizer):
    found = [tuple(r) for r in token_output.op6_token_output(odd).collect()]
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    plain = {(r[0], r[2], r[3]) for r in _expected(ODD, tokenizer)}
    assert {(r[0], r[2], r[3]) for r in found} == plain
    assert [r[1] for r in found] == [sum(r[2] for r in found[:i]) for i in range(len(found))]


def test_empty_table(documents):
    assert token_output.op6_token_output(documents()).collect() == []


TEXTS = [
    "", "a", " a", "a ", "  a", "a  b", "a\n b", "a \n b", "\n", " ", "a<|endoftext|>b c",
    "don't we'll x", "été's  über 12,3 4.5", "日本語 テキスト です", "x'y 'z '' 's",
    "a\x1cb \x1d c", "\x85 b", "word1 2word w-o-r-d!!! ***", "ǅ ǆ ß ﬀ é", "q" * 99 + " " + "z" * 99,
    "a b  c", "tab\tand  two", "x _y_ (z) [w]...", "🙂 🙃🙂 end",
]


def test_words_alone_give_the_ids_of_whole_texts(tokenizer):
    with open(token_output.default_tokenizer(), encoding="utf-8") as file:
        encoder = token_output.WordEncoder(file.read())
    for _ in range(2):  # the second time from memory
        for text, ids in zip(TEXTS, encoder.texts(TEXTS), strict=True):
            whole = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(whole)}I", *whole), text


def test_access_to_single_documents(spark, documents, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "PACK_DOCUMENTS", 7)
    rows = [(i, f"document number {i} of the table") for i in range(60)]
    path = str(tmp_path / "table")
    token_output.write_tokens(documents(*rows), path, token_output.default_tokenizer(), 5)
    found = token_output.read_tokens(spark, path, ids=True, only=[3, 41, 999]).collect()
    assert {r.doc_id: r.ids for r in found} == {
        i: [*tokenizer.encode(rows[i][1], add_special_tokens=False).ids, 5] for i in (3, 41)
    }
    packs = spark.read.parquet(f"{path}/packs")
    name = spark.read.parquet(f"{path}/dictionary").first().hash
    assert {r.dictionary for r in packs.collect()} == {name}


def test_dictionary_does_not_depend_on_the_order_of_rows(documents, monkeypatch):
    monkeypatch.setattr(token_output, "SAMPLES", 40)
    with open(token_output.default_tokenizer(), encoding="utf-8") as file:
        definition = file.read()
    rows = [(i, " ".join(f"word{(i * k) % 97}" for k in range(120))) for i in range(90)]
    raws = {
        token_output.train_dictionary(documents(*order), definition, 0)[0]
        for order in (rows, rows[::-1], rows[45:] + rows[:45])
    }
    assert len(raws) == 1 and raws != {b""}


def test_many_batches(tokenizer, monkeypatch):
    """The memory of words is emptied in between, long words are not kept."""
    monkeypatch.setattr(token_output, "CACHED_WORDS", 30)
    with open(token_output.default_tokenizer(), encoding="utf-8") as file:
        encoder = token_output.WordEncoder(file.read())
    for turn in range(6):
        texts = [f"t{turn} " + " ".join(f"w{turn * k}x{k}," for k in range(20)), "y" * 60 + " " + "z" * 60]
        for text, ids in zip(texts, encoder.texts(texts), strict=True):
            whole = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(whole)}I", *whole)


def test_words_of_several_batches_are_remembered(tokenizer, monkeypatch):
    """A full memory keeps what several batches used, so it is not encoded again."""
    monkeypatch.setattr(token_output, "CACHED_WORDS", 60)
    monkeypatch.setattr(token_output, "AT_ONCE", 7)
    with open(token_output.default_tokenizer(), encoding="utf-8") as file:
        encoder = token_output.WordEncoder(file.read())
    encoded = []
    plain = encoder._after_space
    encoder._after_space = lambda words: encoded.extend(words.to_pylist()) or plain(words)
    usual = " ".join(f"usual{i}" for i in range(20))
    for turn in range(12):
        texts = [f"t{turn} {usual} " + " ".join(f"w{turn}x{i}" for i in range(25))]
        for text, ids in zip(texts, encoder.texts(texts), strict=True):
            whole = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(whole)}I", *whole)
    assert len(encoder.words) <= 60 + 45
    assert encoded.count("usual3") == 1
    assert isinstance(encoder.words, pa.Array)  # no object per word
