"""A suffix stripper for English words after Porter's rules, with two deliberate differences from the published ones: within a step
only the first listed ending that a word has is tried, and "ation" is an ending of the fourth step."""

from __future__ import annotations

import re
from functools import lru_cache

_SECOND = "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble"
_THIRD = "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"
_FOURTH = "ement ation ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou"
_RULES = [[tuple(rule.split(">")) for rule in step.split()] for step in (_SECOND, _THIRD)]
_ENDINGS = _FOURTH.split()


def pattern(word: str) -> str:
    """A letter for each of the word: v for a vowel, c for a consonant; y is a consonant at the start and behind a vowel."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", pattern(word)))


def has_vowel(word: str) -> bool:
    return "v" in pattern(word)


def ends_cvc(word: str) -> bool:
    return len(word) > 2 and pattern(word)[-3:] == "cvc" and word[-1] not in "wxy"


def ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and pattern(word)[-1] == "c"


def _plural(w: str) -> str:
    for ending, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if w.endswith(ending):
            return w[: len(w) - cut]
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for ending in ("ed", "ing"):
        if w.endswith(ending):
            base = w[: -len(ending)]
            if not has_vowel(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if ends_double(base):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if measure(base) == 1 and ends_cvc(base) else base
    return w


def _replaced(w: str, rules: list[tuple[str, str]]) -> str:
    for ending, other in rules:
        if w.endswith(ending):
            base = w[: -len(ending)]
            return base + other if measure(base) > 0 else w
    return w


def _dropped(w: str) -> str:
    for ending in _ENDINGS:
        if w.endswith(ending):
            base = w[: -len(ending)]
            return base if measure(base) > 1 else w
    if w.endswith(("sion", "tion")) and measure(w[:-3]) > 1:
        return w[:-3]
    return w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in _RULES:
        w = _replaced(w, rules)
    w = _dropped(w)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not ends_cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("l") and ends_double(w) and measure(w) > 1 else w
