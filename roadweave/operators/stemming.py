"""Porter's suffix stripping (1980), with the usual later departures, over arrays of words.

Words of up to two letters and the irregular forms stand as they are; a short ``ies`` or ``ied`` keeps
its e. Scores that stem at all do it to words of more than three letters, ``LEAST`` here.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 4
#: Forms that the rules would spoil.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what they become, in the order in which they are tried; the first that fits decides.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
REPAIRS = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
DOUBLE_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v or c for each letter: y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def _ends_short(word: str) -> bool:
    """Consonant, vowel, consonant (not w, x or y) at the end; or a word of a vowel and a consonant."""
    s = shape(word)
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or s == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    return next((word[: len(word) - len(a)] + b for a, b in PLURALS if word.endswith(a)), word)


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[: -len(e)])), None)
    if cut is None:
        return word
    for a, b in REPAIRS:
        if cut.endswith(a):
            return cut[: -len(a)] + b
    if len(cut) > 1 and cut[-1] == cut[-2] and shape(cut)[-1] == "c":
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if measure(cut) == 1 and _ends_short(cut) else cut


def _ending_y(word: str) -> str:
    return word[:-1] + "i" if len(word) > 2 and word[-1] == "y" and shape(word)[-2] == "c" else word


def _replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The first suffix that fits is replaced if what is before it has a measure (before its last letter for logi)."""
    for a, b in rules:
        if word.endswith(a):
            before = word[: -len(a)]
            return before + b if measure(before + a[0] if a == "logi" else before) > 0 else word
    return word


def _without_ending(word: str) -> str:
    for a in ENDINGS:
        if word.endswith(a):
            before = word[: -len(a)]
            return before if measure(before) > 1 and (a != "ion" or before[-1] in "st") else word
    return word


def _last_letters(word: str) -> str:
    if word[-1] == "e" and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _ending_y(_past(_plural(word)))
    if word.endswith("alli") and measure(word[:-4]) > 0:
        word = word[:-2]
    word = _replaced(_replaced(word, DOUBLE_SUFFIXES), SUFFIXES)
    return _last_letters(_without_ending(word))


def stems(words: Column, least: int = LEAST) -> Column:
    """An array of lower-case words with those of ``least`` letters and more stemmed, in Arrow batches.

    Each distinct word of a batch is stemmed once; the others take its stem by their place in the
    batch's dictionary. A null array stays null.
    """

    @F.arrow_udf("array<string>")
    def stemmed(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        known = pa.array([stem(w) if w is not None and len(w) >= least else w for w in flat.dictionary.to_pylist()], pa.string())
        lengths = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, known.take(flat.indices), mask=lists.is_null())

    return stemmed(words)
