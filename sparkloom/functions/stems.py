"""English lexemes: words without stop words, reduced to their stems by suffix rules (the published Snowball English algorithm)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words that a text index doesn't hold.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now""".split()
)
_WORD = re.compile(r"[a-z0-9]+")
_VOWEL = "[aeiouy]"
_HAS_VOWEL = re.compile(_VOWEL)
_CONSONANT_Y = re.compile(r"(?:(?<=^)|(?<=[aeiouy]))y")
_REGION = re.compile(rf"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
#: Fixed values of the algorithm: words with stems of their own, words that stay, beginnings that set the first region, doubled ends, and suffixes by step.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STAY_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_BEGINNINGS = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP_2 = {
    "ational": "ate", "tional": "tion", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive",
    "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _endings(*suffixes: str) -> dict[str, list[tuple[int, frozenset[str]]]]:
    """Suffixes by last letter and length, the longest first."""
    by_letter = {c: [s for s in suffixes if s[-1] == c] for c in {s[-1] for s in suffixes}}
    return {c: [(n, frozenset(s for s in of if len(s) == n)) for n in sorted({len(s) for s in of}, reverse=True)] for c, of in by_letter.items()}


_ENDS_2, _ENDS_3, _ENDS_4 = _endings(*_STEP_2, "ogi", "li"), _endings(*_STEP_3, "ative"), _endings(*_STEP_4, "ion")


#: A word with none of these ends is its own stem: no step acts on it.
_CHANGING = ("s", "ed", "ing", "y", "e", "ll", "li", "ogi", *_STEP_2, *_STEP_3, *_STEP_4, "ion")


def _ending(word: str, endings: dict[str, list[tuple[int, frozenset[str]]]]) -> str | None:
    """The longest of the suffixes that the word ends with."""
    for n, of in endings.get(word[-1:], ()):
        if word[-n:] in of:
            return word[-n:]
    return None


def _region(word: str, start: int = 0) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters and digits."""
    if len(word) < 3 or not word.endswith(_CHANGING) or word in _STAY:
        return word
    if word in _OWN:
        return _OWN[word]
    # a consonant y is marked, so that it's none of the vowels
    w = _CONSONANT_Y.sub("Y", word) if "y" in word else word
    r1 = next(len(b) for b in _BEGINNINGS if w.startswith(b)) if w.startswith(_BEGINNINGS) else _region(w)
    r2 = _region(w, r1)
    has_vowel = lambda x: _HAS_VOWEL.search(x) is not None
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in _STAY_AFTER_PLURAL:
        return w
    # past and progressive
    if w.endswith(("eedly", "eed")):
        ending = "eed" if w.endswith("eed") else "eedly"
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif w.endswith(("ingly", "edly", "ing", "ed")):
        ending = next(s for s in ("ingly", "edly", "ing", "ed") if w.endswith(s))
        if has_vowel(w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _SHORT_END.search(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derived words, to a shorter derivation, then to none
    ending = _ending(w, _ENDS_2)
    if ending and len(w) - len(ending) >= r1:
        before = w[: -len(ending)]
        if ending == "ogi":
            w = before + "og" if before.endswith("l") else w
        elif ending == "li":
            w = before if before[-1:] and before[-1] in "cdeghkmnrt" else w
        else:
            w = before + _STEP_2[ending]
    ending = _ending(w, _ENDS_3)
    if ending and len(w) - len(ending) >= r1:
        if ending != "ative":
            w = w[: -len(ending)] + _STEP_3[ending]
        elif len(w) - len(ending) >= r2:
            w = w[: -len(ending)]
    ending = _ending(w, _ENDS_4)
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[: -len(ending)].endswith(("s", "t"))):
        w = w[: -len(ending)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts in reading order and the number of each word's text, cut from the bytes of all texts at once."""
    whole = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    letters = _LETTERS[whole]
    edges = np.flatnonzero(np.diff(letters, prepend=False))  # the last byte is no letter
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole[letters])])
    return words, np.searchsorted(begins, starts, "right") - 1


def hits(texts: list[str | None], stemmed: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """What lexemes() finds in many texts: the distinct lexemes, and of each hit the lexeme's number, the text's number and the position, in reading order.
    A word is stemmed once however often it stands there."""
    words, text = cut([(t or "").lower().encode() for t in texts])
    words = words.dictionary_encode()
    position = np.arange(1, len(text) + 1) - np.searchsorted(text, np.arange(len(texts)))[text]
    terms: dict[str, int] = {}
    number = [-1 if w in STOP_WORDS else terms.setdefault(stem(w) if stemmed else w, len(terms)) for w in words.dictionary.to_pylist()]
    term = np.array(number, np.int64)[words.indices.to_numpy()]
    kept = term >= 0
    return list(terms), term[kept], text[kept], position[kept].astype(np.int32)


def lexemes(text: str | None, stemmed: bool = True) -> dict[str, list[int]]:
    """Positions (from 1, stop words counted) of the text's lexemes. Null has none."""
    words: dict[str, list[int]] = {}
    for i, word in enumerate(_WORD.findall((text or "").lower()), 1):
        words.setdefault(word, []).append(i)
    out: dict[str, list[int]] = {}
    for word, at in words.items():
        if word not in STOP_WORDS:
            # forms of one word share a lexeme
            term = stem(word) if stemmed else word
            out[term] = sorted(out[term] + at) if term in out else at
    return out
