"""Text analysis: tokens, stop words, stems and query terms."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.stemmer import stem

TOKEN = r"[\p{L}\p{N}]+"
QUERY_TOKEN = r"[A-Za-z0-9._-]+"
_LOCAL_TOKEN = re.compile(r"[^\W_]+")

# The English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him "
    "his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens_starting(text: Column, initials: str) -> Column:
    """The tokens that start with one of some letters or digits."""
    word = TOKEN[:-1]
    pattern = f"(?<!{word})[{initials}]{word}*"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def initials_of(terms: list[str]) -> str:
    """First letters of terms. A stem keeps the first letter of its word, so no
    word with another one can match."""
    return "".join(sorted({term[0] for term in terms}))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_batch(batch: pa.Array) -> pa.Array:
    encoded = batch.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    stemmed = pa.array([stem(w) for w in words], pa.string()).take(encoded.indices)
    lengths = pc.fill_null(pc.list_value_length(batch), 0).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths)])
    return pa.ListArray.from_arrays(offsets, stemmed, mask=batch.is_null())


def stems(words: Column) -> Column:
    """Stem every word of an array of lower-case words."""
    return _stem_batch(words)


def analyze_text(text: Column, stemmed: bool = True) -> Column:
    """Index terms of a text: tokens without stop words, repeats kept."""
    kept = F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))
    return stems(kept) if stemmed else kept


def path_tokens(path: Column, stemmed: bool = True) -> Column:
    """Index terms of a path; only ASCII letters and digits count."""
    return analyze_text(F.regexp_replace(path, "[^A-Za-z0-9]+", " "), stemmed)


def query_terms(text: Column, stemmed: bool = True) -> Column:
    """Distinct query terms in order.

    The stemmed terms pass the analyser a second time, as search engines that
    parse an already normalised query do; a stem that is itself a stop word or
    has a shorter stem changes there.
    """
    terms = analyze_text(text, stemmed)
    if stemmed:
        terms = analyze_text(F.array_join(terms, " "), stemmed)
    return F.array_sort(F.array_distinct(terms))


def longest_token(text: Column) -> Column:
    """Longest token of the lower-cased query; the first one wins ties."""
    found = F.regexp_extract_all(F.lower(text), F.lit(QUERY_TOKEN), F.lit(0))
    return F.aggregate(
        found,
        F.lit(""),
        lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best),
    )


# The same rules for the text of one query, which the driver holds anyway.


def local_terms(text: str, stemmed: bool = True) -> list[str]:
    def analyze(value: str) -> list[str]:
        kept = [t for t in _LOCAL_TOKEN.findall(value.lower()) if t not in STOP_WORDS]
        return [stem(t) for t in kept] if stemmed else kept

    terms = analyze(text)
    if stemmed:
        terms = analyze(" ".join(terms))
    return sorted(set(terms))


def local_longest_token(text: str) -> str:
    return max(re.findall(QUERY_TOKEN, text.lower()), key=len, default="")
