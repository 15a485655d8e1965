"""Phrase sets matched in one pass over a text.

Matching ignores case, folds curly quotes, takes runs of white space as one
blank, and is word-bounded at ends that are letters or digits.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.catalogs import LEXICONS
from larkspur.functions.per_text import per_text

_FOLD = str.maketrans({"‘": "'", "’": "'", "ʼ": "'", "“": '"', "”": '"'})


@lru_cache(maxsize=1)
def automaton():
    """All phrases of all sets in one automaton; one for each worker."""
    import ahocorasick

    made = ahocorasick.Automaton()
    found: dict[str, list[str]] = {}
    for name, phrases in LEXICONS.items():
        for p in phrases:
            found.setdefault(re.sub(r"\s+", " ", p.lower().translate(_FOLD)), []).append(name)
    for phrase, names in found.items():
        made.add_word(phrase, (phrase, names))
    made.make_automaton()
    return made


def scan(text: str, most: int = 4) -> dict[str, list[str]]:
    """Distinct phrases found, by set, in the order in which they end; at most ``most`` of a set."""
    lower = re.sub(r"\s+", " ", text.translate(_FOLD).lower())
    out: dict[str, list[str]] = {}
    for end, (phrase, names) in automaton().iter(lower):
        start = end + 1 - len(phrase)
        if phrase[0].isalnum() and start and lower[start - 1].isalnum():
            continue
        if phrase[-1].isalnum() and end + 1 < len(lower) and lower[end + 1].isalnum():
            continue
        for name in names:
            got = out.setdefault(name, [])
            if len(got) < most and phrase not in got:
                got.append(phrase)
    return out


_matches = per_text(lambda t: list(scan(t).items()), T.MapType(T.StringType(), T.ArrayType(T.StringType())))


def matches(text: Column) -> Column:
    """A map from each set's name to its phrases in the text (see ``scan``); sets without a match have no entry."""
    return _matches(text)


def found(hits: Column, name: str, most: int = 4) -> Column:
    """The phrases of one set, an empty array for none."""
    return F.slice(F.coalesce(F.try_element_at(hits, F.lit(name)), F.array().cast("array<string>")), 1, most)
