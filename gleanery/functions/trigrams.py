"""Trigram similarity of a path and a query token."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import tokens

_BLANK = ord(" ")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks and one."""
    per_word = F.transform(
        tokens(text),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def local_trigrams(token: str) -> list[str]:
    """Trigrams of a query token, which is ASCII."""
    found = set()
    for word in re.findall(r"[a-z0-9]+", token.lower()):
        padded = f"  {word} "
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return sorted(found)


def _jaccard(shared: Column, left: Column, right: Column) -> Column:
    return F.when(shared > 0, shared.cast("double") / (left + right - shared)).otherwise(0.0)


def trigram_sim(left: Column, right: Column) -> Column:
    """Shared over all trigrams of two texts; 0 if they share none."""
    a, b = trigrams(left), trigrams(right)
    return F.coalesce(_jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)), F.lit(0.0))


def padded_words(text: Column) -> Column:
    """Lower-case words with the blanks their trigrams need around them."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   ")
    return F.concat(F.lit("  "), words, F.lit(" "))


def trigram_codes(padded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct trigrams of each row, from ``padded_words``."""
    texts = padded.fill_null("").to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first, second, third = points[:-2], points[1:-1], points[2:]
    # Three characters in a row that lie in one text and in one padded word.
    in_word = (second != _BLANK) | ((first == _BLANK) & (third != _BLANK))
    kept = in_word & (rows[:-2] == rows[2:])
    rows = rows[:-2][kept]
    codes = ((first << 42) | (second << 21) | third)[kept]
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (np.diff(rows) != 0) | (np.diff(codes) != 0)
    return rows[new], codes[new]


def code_of(trigram: str) -> int:
    first, second, third = map(ord, trigram)
    return (first << 42) | (second << 21) | third


def trigram_sim_to(path: Column, token: str) -> Column:
    """``trigram_sim`` against one known token, computed by blocks of rows."""
    wanted = np.array([code_of(t) for t in local_trigrams(token)], dtype=np.int64)
    if not len(wanted):
        return F.lit(0.0)

    @F.arrow_udf(T.DoubleType())
    def similarity(padded: pa.Array) -> pa.Array:
        rows, codes = trigram_codes(padded)
        sizes = np.bincount(rows, minlength=len(padded))
        shared = np.bincount(rows[np.isin(codes, wanted)], minlength=len(padded))
        return pa.array(shared / (sizes + len(wanted) - shared))

    return similarity(padded_words(path))
