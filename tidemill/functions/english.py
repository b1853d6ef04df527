"""English analysis of text for keyword search: words, stop words out, and the stems of the rest.

The stemmer is the published Snowball English ("Porter2") algorithm. Analysis runs in Arrow
batches, and a worker stems each distinct word once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no search terms, and the algorithm's word and suffix lists.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_TOKEN = re.compile(r"[^\W_]+")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant behind a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_syllable(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if not _has_vowel(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(DOUBLES):
                return stem[:-1]
            return stem + "e" if len(stem) <= r1 and _short_syllable(stem) else stem
    return w


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def _step_2(w: str, r1: int) -> str:
    s = _longest(w, (*STEP_2, "ogi", "li"))
    if s is None or len(w) - len(s) < r1:
        return w
    if s == "ogi":
        return w[:-1] if w.endswith("logi") else w
    if s == "li":
        return w[:-2] if w[-3:-2] and w[-3] in LI_ENDINGS else w
    return w[: -len(s)] + STEP_2[s]


def _step_3(w: str, r1: int, r2: int) -> str:
    s = _longest(w, (*STEP_3, "ative"))
    if s is None or len(w) - len(s) < r1:
        return w
    if s == "ative":
        return w[:-5] if len(w) - 5 >= r2 else w
    return w[: -len(s)] + STEP_3[s]


def _step_4(w: str, r2: int) -> str:
    s = _longest(w, (*STEP_4, "ion"))
    if s is None or len(w) - len(s) < r2 or s == "ion" and w[-4:-3] not in ("s", "t"):
        return w
    return w[: -len(s)]


def _step_5(w: str, r1: int, r2: int) -> str:
    if w.endswith("e"):
        return w[:-1] if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= r2 else w


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a word in small letters."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub(rf"(^|[{VOWELS}])y", r"\1Y", word)
    prefix = next((p for p in LONG_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = _plural(w)
    if w in KEPT_AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _step_5(_step_4(_step_3(_step_2(w, r1), r1, r2), r2), r1, r2)
    return w.replace("Y", "y")


def analysed(text: str | None) -> list[str]:
    """Stems of the words that are no stop words, in order."""
    return [stem(t) for t in _TOKEN.findall((text or "").lower()) if t not in STOP_WORDS]


@F.arrow_udf(T.ArrayType(T.StringType()))
def terms(text: pa.Array) -> pa.Array:
    """analysed() of each text; a word is stemmed once a batch."""
    words = [_TOKEN.findall((t or "").lower()) for t in text.to_pylist()]
    coded = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
    stems = pa.array([None if w in STOP_WORDS else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    every = stems.take(coded.indices)
    kept = np.concatenate([[0], np.cumsum(pc.is_valid(every).to_numpy(zero_copy_only=False))])
    ends = np.cumsum([0, *map(len, words)])
    return pa.ListArray.from_arrays(pa.array(kept[ends], pa.int32()), every.drop_null())
