"""The suffix-stripping stemmer of Porter (1980), for the stemmed index."""

from __future__ import annotations

import pandas as pd

from .udf import arrow_udf

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffix rules of steps 2, 3 and 4, as published.
_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(" ")) for x in text.split(",")), key=lambda x: -len(x[0]))


TWO, THREE, FOUR = _table(_STEP2), _table(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def stem(w: str) -> str:
    """Lower-case ASCII words of three letters or more; all others come back unchanged."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _double(cut) and cut[-1] not in "lsz":
                w = cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (TWO, THREE):
        for old, new in rules:
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in FOUR:
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@arrow_udf("string")
def stem_words(words: pd.Series) -> pd.Series:
    """Over distinct words it pays to stem a vocabulary once and join it; see operators.index."""
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


@arrow_udf("array<string>")
def stem_phrases(terms: pd.Series) -> pd.Series:
    """Of each array the distinct phrases of stems, in order: the parts of a term at `_`, each stemmed, with blanks between."""
    phrase = lambda term: " ".join(stem(part) for part in term.split("_") if part)
    return terms.map(lambda own: [] if own is None else list(dict.fromkeys(filter(None, map(phrase, own)))))
