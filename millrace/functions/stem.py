"""English word stems by Porter's suffix rules, kept as tables.

A word's *shape* has ``c`` for each consonant and ``v`` for each vowel (``y`` is a
vowel after a consonant), so a stem's measure, the number of vowel-consonant
groups, is a question to a short text.  Each step takes the first rule whose
suffix the word ends with, and applies it if the rule's condition holds for what
is before the suffix.  The words of an Arrow batch are made distinct first and
each is stemmed once per task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import slices

LETTERS = "aeioubcdfghjklmnpqrstvwxyz0123456789"
SHAPES = "v" * 5 + "c" * 31

# The published rules (suffix, replacement), in the order in which they are tried,
# with the extensions that common implementations have (words of four letters in -ies and -ied,
# -bli, -fulli, -logi, and words that are stems by a list).
LISTED = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
PAST = ("ed", "ing")
RESTORED = [("at", "ate"), ("bl", "ble"), ("iz", "ize")]
DOUBLED_STAY = "lsz"
DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
ENDINGS = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
DROPPED = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


_SHAPE = str.maketrans(LETTERS, SHAPES)
_AFTER_CONSONANT = re.compile("(?<=[^aeiouy])y")
_TWO_GROUPS = re.compile("vc+v+c")


def shape(word: str) -> str:
    """``c`` and ``v`` per letter."""
    # a run of y alternates: after a consonant it starts with a vowel, else with a consonant
    if "y" in word:
        word = _AFTER_CONSONANT.sub("i", word).replace("yy", "yi")
    return word.translate(_SHAPE)


def _some(before: str) -> bool:
    """Measure above 0."""
    return "vc" in shape(before)


def _above_one(before: str) -> bool:
    return _TWO_GROUPS.search(shape(before)) is not None


def _short_end(before: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; also a whole word of vowel and consonant."""
    s = shape(before)
    return s == "vc" or (s.endswith("cvc") and before[-1] not in "wxy")


def _first_rule(word: str, rules: list[tuple[str, str]], condition: Callable[[str], bool]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            before = word[: len(word) - len(suffix)]
            return before + new if condition(before) else word
    return word


def _restored(word: str) -> str:
    """What a word gets back after -ed or -ing has gone."""
    for suffix, new in RESTORED:
        if word.endswith(suffix):
            return word[: -len(suffix)] + new
    if len(word) > 1 and word[-1] == word[-2] and shape(word).endswith("c"):
        return word if word[-1] in DOUBLED_STAY else word[:-1]
    return word + "e" if _some(word) and not _above_one(word) and _short_end(word) else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _some(word[:-3]) else word
    for suffix in PAST:
        if word.endswith(suffix) and "v" in shape(word[: -len(suffix)]):
            return _restored(word[: -len(suffix)])
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters and digits; words of one or two letters are their own."""
    if len(word) <= 2 or word in LISTED:
        return LISTED.get(word, word)
    word = word[:-1] if len(word) == 4 and word.endswith("ies") else _first_rule(word, PLURALS, lambda before: True)
    word = _past(word)
    if word.endswith("y") and len(word) > 2 and shape(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    if word.endswith("alli") and _some(word[:-4]):
        word = word[:-2]
    if word.endswith("logi") and _some(word[:-3]):  # the l counts as part of the stem
        word = word[:-1]
    else:
        word = _first_rule(word, DERIVED, _some)
    word = _first_rule(word, ENDINGS, _some)
    word = _first_rule(word, [(suffix, "") for suffix in DROPPED], lambda before: _above_one(before) and (word[-3:] != "ion" or before[-1] in "st"))
    if word.endswith("e") and (_above_one(word[:-1]) or (_some(word[:-1]) and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _above_one(word[:-1]) else word


def stemmed_lists(lists: pa.ListArray, above: int = 3) -> pa.ListArray:
    """Lists of words with those of more than ``above`` letters stemmed, without nulls."""
    offsets = np.asarray(lists.offsets)
    found = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    new = pa.array([stem(w) if len(w) > above else w for w in found.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), new.take(found.indices))


def stems(words: Column | str, above: int = 3) -> Column:
    """An array of words with those of more than ``above`` letters stemmed; null has none."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in slices(batches):
            yield stemmed_lists(lists, above)

    words = F.col(words) if isinstance(words, str) else words
    return stemmed(F.coalesce(words, F.array().cast("array<string>")))


def nested_stemmed_lists(outer: pa.ListArray, above: int = 3) -> pa.ListArray:
    """As :func:`stemmed_lists` for lists of lists of words."""
    offsets = np.asarray(outer.offsets)
    inner = stemmed_lists(outer.values.slice(offsets[0], offsets[-1] - offsets[0]), above)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), inner)


def nested_stems(sentences: Column | str, above: int = 3) -> Column:
    """As :func:`stems` for an array of arrays of words."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for outer in slices(batches):
            yield nested_stemmed_lists(outer, above)

    sentences = F.col(sentences) if isinstance(sentences, str) else sentences
    return stemmed(F.coalesce(sentences, F.array().cast("array<array<string>>")))


# The same tables as checking SQL: CTEs from (word) to (word, stem).
def _sql_shape(w: str) -> str:
    return f"translate(replace(regexp_replace({w}, '([^aeiouy])y', '\\1i', 'g'), 'yy', 'yi'), '{LETTERS}', '{SHAPES}')"


def _sql_before(w: str, suffix: str) -> str:
    return f"substr({w}, 1, length({w}) - {len(suffix)})"


def _sql_rules(rules: list[tuple[str, str, str]]) -> str:
    whens = " ".join(f"WHEN ends_with(w, '{x}') THEN CASE WHEN {c} THEN {_sql_before('w', x)} || '{n}' ELSE w END" for x, n, c in rules)
    return f"CASE {whens} ELSE w END"


def _sql_short(stem_: str, s: str) -> str:
    return f"((ends_with({s}, 'cvc') AND right({stem_}, 1) NOT IN ('w', 'x', 'y')) OR {s} = 'vc')"


def sql_stems(source: str, result: str = "stemmed") -> str:
    """CTEs that end in ``result`` (word, stem) for the words of table ``source`` (word)."""

    def m0(x: str) -> str:
        return f"contains({_sql_before('s', x)}, 'vc')"

    def m1(x: str) -> str:
        return f"regexp_matches({_sql_before('s', x)}, 'vc+v+c')"

    plain = _sql_rules([(x, n, "true") for x, n in PLURALS])
    steps = [f"CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {_sql_before('w', 's')} ELSE {plain} END"]
    past = " ".join(f"WHEN ends_with(w, '{x}') AND contains({_sql_before('s', x)}, 'v') THEN {_sql_before('w', x)} || '*'" for x in PAST)
    steps.append(
        f"CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_sql_before('w', 'd')} ELSE {_sql_before('w', 'ed')} END "
        f"WHEN ends_with(w, 'eed') THEN CASE WHEN {m0('eed')} THEN {_sql_before('w', 'd')} ELSE w END {past} ELSE w END"
    )
    # a star marks what has lost its ending and may get one back
    t, ts = _sql_before("w", "*"), _sql_before("s", "*")
    restored = " ".join(f"WHEN ends_with({t}, '{x}') THEN {_sql_before(t, x)} || '{n}'" for x, n in RESTORED)
    steps.append(
        f"CASE WHEN NOT ends_with(w, '*') THEN w {restored} "
        f"WHEN length({t}) > 1 AND right({t}, 1) = substr({t}, length({t}) - 1, 1) AND ends_with({ts}, 'c') "
        f"THEN CASE WHEN right({t}, 1) IN ('l', 's', 'z') THEN {t} ELSE {_sql_before(t, 'x')} END "
        f"WHEN contains({ts}, 'vc') AND NOT regexp_matches({ts}, 'vc+v+c') AND {_sql_short(t, ts)} THEN {t} || 'e' ELSE {t} END"
    )
    steps.append(f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with({_sql_before('s', 'y')}, 'c') THEN {_sql_before('w', 'y')} || 'i' ELSE w END")
    steps.append(f"CASE WHEN ends_with(w, 'alli') AND {m0('alli')} THEN {_sql_before('w', 'li')} ELSE w END")
    derived = _sql_rules([(x, n, m0(x)) for x, n in DERIVED])
    steps.append(f"CASE WHEN ends_with(w, 'logi') AND {m0('ogi')} THEN {_sql_before('w', 'i')} ELSE {derived} END")
    steps.append(_sql_rules([(x, n, m0(x)) for x, n in ENDINGS]))
    ion = f" AND right({_sql_before('w', 'ion')}, 1) IN ('s', 't')"
    steps.append(_sql_rules([(x, "", m1(x) + (ion if x == "ion" else "")) for x in DROPPED]))
    e, es = _sql_before("w", "e"), _sql_before("s", "e")
    steps.append(f"CASE WHEN ends_with(w, 'e') AND ({m1('e')} OR ({m0('e')} AND NOT {_sql_short(e, es)})) THEN {e} ELSE w END")
    steps.append(f"CASE WHEN ends_with(w, 'll') AND {m1('l')} THEN {_sql_before('w', 'l')} ELSE w END")
    out = [f"stem0 AS (SELECT DISTINCT word, word AS w FROM {source})"]
    for n, step in enumerate(steps):
        out.append(f"stem{n + 1} AS (SELECT word, {step} AS w FROM (SELECT word, w, {_sql_shape('w')} AS s FROM stem{n}))")
    listed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LISTED.items())
    out.append(f"{result} AS (SELECT word, CASE word {listed} ELSE CASE WHEN length(word) <= 2 THEN word ELSE w END END AS stem FROM stem{len(steps)})")
    return ", ".join(out)
