"""Rules on file content: span, hashes, summaries and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as trimmed from file content and model output.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

HEURISTIC_LENGTH = 240
PROMPT_INPUT = 8_000
STUB_LINES = 5
STUB_MIN_BYTES = 10


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def storable_text(content: Column) -> Column:
    """Binary content as text; null where a text column cannot hold it.

    Text must be valid UTF-8 and free of NUL characters.
    """
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text) & (F.instr(text, "\0") == 0), text)


def line_count(content: Column) -> Column:
    """Newlines plus one: an empty file has one line."""
    without = F.translate(content, "\n", "")
    return (F.length(content) - F.length(without) + 1).cast("int")


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.sha1(
        F.concat(path, F.lit("#"), start.cast("string"), F.lit(":"), end.cast("string"))
    )


def summary_heuristic(content: Column) -> Column:
    """Summary without a model: the trimmed start of the content."""
    return F.substring(trim_space(content), 1, HEURISTIC_LENGTH)


def summary_stub(path: Column, content: Column) -> Column:
    """The first telling comment among the first lines, or the file's name."""
    lines = F.slice(F.split(content, "\n", STUB_LINES + 1), 1, STUB_LINES)
    comments = F.filter(
        F.transform(lines, trim_space),
        lambda line: (line.startswith("#") | line.startswith("//"))
        & (F.octet_length(line) > STUB_MIN_BYTES),
    )
    return F.coalesce(F.try_element_at(comments, F.lit(1)), F.concat(F.lit("Code file: "), path))


def prompt_text(path: Column, language: Column, content: Column) -> Column:
    """User prompt of the hosted summarisers."""
    return F.concat(
        F.lit("Path: "), path,
        F.lit("\nLanguage: "), language,
        F.lit("\n---\n"), F.substring(content, 1, PROMPT_INPUT),
    )


def one_line(text: Column) -> Column:
    """Model output on one line; tabs and carriage returns stay."""
    return F.translate(trim_space(text), "\n", " ")


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
