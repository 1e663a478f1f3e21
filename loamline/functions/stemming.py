"""The English stemmer that full-text search takes: the second Porter algorithm, as its published description has it.

A word is lower-cased by the caller. ``r1`` is what follows the first consonant after a vowel, ``r2`` the same of ``r1``; most endings go only
where they lie in one of the two. A ``y`` at the start or after a vowel counts as a consonant and is written ``Y`` meanwhile.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that are not indexed; positions still count them.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

#: Fixed values of the algorithm: words with stems of their own, words that end the work after plurals, starts that r1 follows, and endings with what takes their place.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STARTS = ("gener", "commun", "arsen")
IN_R1_FIRST = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
IN_R1_NEXT = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
IN_R2 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_LI_AFTER = "cdeghkmnrt"
_STARTS, _ENDINGS = tuple(STARTS), {id(x): tuple(x) for x in (IN_R1_FIRST, IN_R1_NEXT, IN_R2)}


def _regions(w: str) -> tuple[int, int]:
    """Where r1 and r2 start."""
    start = next((len(s) for s in STARTS if w.startswith(s)), None) if w.startswith(_STARTS) else None
    if start is None:
        m = _REGION.search(w)
        start = m.end() if m else len(w)
    m = _REGION.search(w, start)
    return start, m.end() if m else len(w)


def _longest(w: str, endings: dict[str, str]) -> str | None:
    if not w.endswith(_ENDINGS[id(endings)]):  # most words have none
        return None
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _has_vowel(w: str) -> bool:
    return re.search("[aeiouy]", w) is not None


def _singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _present(w: str, r1: int) -> str:
    """Without -ed and -ing, mended so that hoping and hopping part."""
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if not m:
        return w
    if m[0].startswith("ee"):
        return w[: m.start()] + "ee" if m.start() >= r1 else w
    rest = w[: m.start()]
    if not _has_vowel(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _SHORT.search(rest) else rest


def _derived(w: str, r1: int, r2: int) -> str:
    """Without the endings that make nouns, adjectives and adverbs, one of each of three lists."""
    end = _longest(w, IN_R1_FIRST)
    before = w[: -len(end)] if end else w
    if end and len(before) >= r1 and (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in _LI_AFTER):
        w = before + IN_R1_FIRST[end]
    end = _longest(w, IN_R1_NEXT)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + IN_R1_NEXT[end]
    end = _longest(w, IN_R2)
    before = w[: -len(end)] if end else w
    if end and len(before) >= r2 and (end != "ion" or before.endswith(("s", "t"))):
        w = before
    return w


def _final(w: str, r1: int, r2: int) -> str:
    if w.endswith("e"):
        keep = len(w) - 1 < r1 or len(w) - 1 < r2 and _SHORT.search(w[:-1])
        return w if keep else w[:-1]
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= r2 else w


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of up to two letters and words that hold other signs than a to z and ' stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"'s?'?$", "", word.removeprefix("'"))
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = _singular(w)
    if w in AFTER_PLURAL:
        return w
    w = _present(w, r1)
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    return _final(_derived(w, r1, r2), r1, r2).lower()
