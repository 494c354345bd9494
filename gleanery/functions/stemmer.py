"""English stemming after the published Porter2 rules (M. Porter, 2001)."""

from __future__ import annotations

import re
from functools import lru_cache

# Words with their own stem, and words left as they are.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
# Words final once their plural is gone.
FINAL_SINGULARS = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
# Derivational endings and their replacements, rounds two and three.
ROUND_TWO = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ROUND_THREE = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
# Endings dropped in round four.
ROUND_FOUR = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
]

_V = "[aeiouy]"
_C = "[^aeiouy]"
_REGION = re.compile(f"{_V}{_C}")
_HAS_VOWEL = re.compile(_V)
_SHORT_END = re.compile(f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$")
_DOUBLE_END = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_LI_ENDING = re.compile(r"[cdeghkmnrt]li$")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _region_starts(word: str) -> tuple[int, int]:
    """Where the regions R1 and R2 of the published rules begin."""
    prefix = re.match("gener|commun|arsen", word)
    found = prefix or _REGION.search(word)
    r1 = found.end() if found else len(word)
    found = _REGION.search(word, r1)
    return r1, found.end() if found else len(word)


def _strip_plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _HAS_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _strip_verb_ending(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not ending or not _HAS_VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE_END.search(base):
        return base[:-1]
    is_short_word = r1 >= len(base) and _SHORT_END.search(base)
    return base + "e" if is_short_word else base


def _derivation(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, ROUND_TWO)
    if ending and len(word) - len(ending) >= r1:
        allowed = (
            word.endswith("logi") if ending == "ogi"
            else bool(_LI_ENDING.search(word)) if ending == "li"
            else True
        )
        if allowed:
            word = word[: len(word) - len(ending)] + ROUND_TWO[ending]
    ending = _longest(word, ROUND_THREE)
    start = len(word) - len(ending)
    if ending and start >= (r2 if ending == "ative" else r1):
        word = word[:start] + ROUND_THREE[ending]
    ending = _longest(word, ROUND_FOUR)
    start = len(word) - len(ending)
    if ending and start >= r2 and (ending != "ion" or word[:start].endswith(("s", "t"))):
        word = word[:start]
    return word


def _final_letter(word: str, r1: int, r2: int) -> str:
    start = len(word) - 1
    if word.endswith("e"):
        if start >= r2 or (start >= r1 and not _SHORT_END.search(word[:start])):
            return word[:start]
    elif word.endswith("ll") and start >= r2:
        return word[:start]
    return word


# About 0.3 KB a word, in every worker.
@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that acts as a consonant is written Y until the end.
    word = re.sub(r"([aeiouy])y", r"\1Y", re.sub(r"^y", "Y", word))
    r1, r2 = _region_starts(word)
    word = _strip_plural(word)
    if word in FINAL_SINGULARS:
        return word
    word = _strip_verb_ending(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derivation(word, r1, r2)
    return _final_letter(word, r1, r2).replace("Y", "y")
