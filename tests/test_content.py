import hashlib

from pyspark.sql import functions as F

from gleanery.functions import content
from gleanery.sources.providers import StubProvider

STUB_CASES = [
    ("etl.rs", "// Reads the daily feed\nuse std::io;\nfn main() {}", "// Reads the daily feed"),
    ("notes.txt", "intro\n## Second heading\nrest", "## Second heading"),
    ("tiny.c", "// tiny\nint main;", "Code file: tiny.c"),
    ("plain.sql", "select 1;\nselect 2;", "Code file: plain.sql"),
    ("blank", "\n\n", "Code file: blank"),
    ("two.toml", "# first remark here\n# second remark here", "# first remark here"),
    ("pad.rb", "\n \n   # indented remark\nputs 1", "# indented remark"),
    ("late.py", "a\nb\nc\nd\ne\n# A comment beyond the first lines", "Code file: late.py"),
    ("bytes.py", "# ñandúññ", "# ñandúññ"),  # nine characters, but more than ten bytes
]


def test_summary_stub(column):
    got = column([c[:2] for c in STUB_CASES], "p string, c string",
                 content.summary_stub(F.col("p"), F.col("c")))
    assert got == [c[2] for c in STUB_CASES]


def test_stub_provider_agrees_with_column():
    provider = StubProvider(4)
    got = provider.summarize_batch([(path, "", text) for path, text, _ in STUB_CASES])
    assert got == [c[2] for c in STUB_CASES]
    for dim in (512, 256, 768, 384, 128):
        assert StubProvider(dim).embed_batch(["", "Hello 世界 🌍"]) == [[0.0] * dim] * 2


def test_one_line(column):
    cases = [
        ("plain", "plain"),
        ("up\nand\n\ndown", "up and  down"),
        ("\n\t  inner   gap \n", "inner   gap"),
        ("one\ttab\nthen\rreturn", "one\ttab then\rreturn"),
        ("", ""),
        ("\n", ""),
        (" 　x\x85", "x"),
    ]
    got = column([c[:1] for c in cases], "t string", content.one_line(F.col("t")))
    assert got == [c[1] for c in cases]


def test_summary_heuristic(column):
    cases = [("short content", "short content"), ("x" * 300, "x" * 240),
             ("  content with spaces  ", "content with spaces"), ("é" * 300, "é" * 240)]
    got = column([c[:1] for c in cases], "t string", content.summary_heuristic(F.col("t")))
    assert got == [c[1] for c in cases]


def test_line_count(column):
    cases = [("line1\nline2\nline3", 3), ("", 1), ("a\n", 2), ("\n\n", 3)]
    got = column([c[:1] for c in cases], "t string", content.line_count(F.col("t")))
    assert got == [c[1] for c in cases]


def test_hashes(column):
    texts = ["", "Hello 世界", "line\n"]
    got = column([(t,) for t in texts], "t string", content.content_hash(F.col("t")))
    assert got == [hashlib.sha1(t.encode()).hexdigest() for t in texts]
    got = column([("path/file.go", 1, 10), ("path/file.go", 1, 11)], "p string, a int, b int",
                 content.chunk_id(F.col("p"), F.col("a"), F.col("b")))
    assert got == [hashlib.sha1(f"path/file.go#1:{n}".encode()).hexdigest() for n in (10, 11)]


def test_prompt_text(column):
    got = column([("a.py", "python", "x" * 9000)], "p string, l string, c string",
                 content.prompt_text(F.col("p"), F.col("l"), F.col("c")))
    assert got == ["Path: a.py\nLanguage: python\n---\n" + "x" * 8000]


def test_storable_text(column):
    cases = [(b"plain", "plain"), ("é".encode(), "é"), (b"\xff\xfe", None), (b"a\x00b", None),
             (b"", "")]
    got = column([(bytearray(c[0]),) for c in cases], "b binary", content.storable_text(F.col("b")))
    assert got == [c[1] for c in cases]


def test_zero_vector(column):
    assert column([(1,)], "x int", content.zero_vector(3)) == [[0.0, 0.0, 0.0]]
