"""Score terms of hybrid search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import TOKEN, initials_of, stems, tokens_starting

# Weights and word lists of the ranking.
SEMANTIC_WEIGHT = 0.80
LEXICAL_WEIGHT = 0.15
TRIGRAM_WEIGHT = 0.05
BIAS_WEIGHT = 0.10
NOISE_WEIGHT = 0.07
TERM_WEIGHT = 0.4
SCRIPT_WORDS = [
    "script", "scripts", "bash", "shell", "code", "program", "programs", "python", "cli",
]
SCRIPT_LANGUAGES = ["shell", "bash", "sh", "python", "py", "go"]
CONFIG_LANGUAGES = ["yaml", "terraform", "tf", "json"]
# The third ending is a backslash and any character: the rule as deployed does
# not see a dot there, so that test.go and tests/ carry no penalty.
NOISE_PATTERN = (
    r"(?s)(?:^|/)(?:sample|example|test|mock|fixture|tmp|temp|sandbox)(?:/|\\.|\z)"
)


def asked_for_script(query: Column) -> Column:
    """Whether the query holds one of the script words, also inside a word."""
    return F.lower(query).rlike("|".join(SCRIPT_WORDS))


def script_bias(language: Column, asked: Column | bool) -> Column:
    asked = asked if isinstance(asked, Column) else F.lit(asked)
    return (
        F.when(asked & language.isin(SCRIPT_LANGUAGES), 1)
        .when(asked & language.isin(CONFIG_LANGUAGES), -1)
        .otherwise(0)
    )


def noise_penalty(path: Column) -> Column:
    return F.when(F.lower(path).rlike(NOISE_PATTERN), 1).otherwise(0)


def rank_of_hits(hits: Column) -> Column:
    """Lexical rank from the number of matching positions."""
    return F.least(F.lit(1.0), F.coalesce(hits, F.lit(0)) * F.lit(TERM_WEIGHT))


def lexical_rank(summary: Column, terms: list[str], stemmed: bool = True) -> Column:
    """Rank of a summary against the known terms of one query.

    Unstemmed terms are counted by one regular expression, without building
    the token array.
    """
    if not terms:
        return F.lit(0.0)
    if stemmed:
        likely = tokens_starting(summary, initials_of(terms))
        found = F.filter(stems(likely), lambda t: t.isin(terms))
        return rank_of_hits(F.when(summary.isNotNull(), F.size(found)))
    word = TOKEN[:-1]
    pattern = f"(?<!{word})(?:{'|'.join(terms)})(?!{word})"
    return rank_of_hits(F.regexp_count(F.lower(summary), F.lit(pattern)))


def _share(value: Column, maximum: Column) -> Column:
    return F.coalesce(F.try_divide(value, F.nullif(maximum, F.lit(0.0))), F.lit(0.0))


def hybrid_score(
    sem: Column, lex: Column, tri: Column, bias: Column, noise: Column,
    max_sem: Column, max_lex: Column, max_tri: Column,
) -> Column:
    """Weighted score relative to the best candidate of each term."""
    return (
        F.lit(SEMANTIC_WEIGHT) * _share(sem, max_sem)
        + F.lit(LEXICAL_WEIGHT) * _share(lex, max_lex)
        + F.lit(TRIGRAM_WEIGHT) * _share(tri, max_tri)
        + F.lit(BIAS_WEIGHT) * bias
        - F.lit(NOISE_WEIGHT) * noise
    )


def sanitize_score(score: Column) -> Column:
    """NaN and infinities become 0; a missing score too."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, 0.0).otherwise(score)
