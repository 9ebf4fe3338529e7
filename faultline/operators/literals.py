"""Which of many regexes a text may match, found in one pass over it.

Of each regex the words are taken one of which every match holds; an automaton
finds the words of all rules at once, so that only the rules that it names are
run.  A plan doesn't grow with the rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

# what another engine may read differently, so that words can't be told
UNSURE = re.compile(r"\[[^\]]*\[|&&|\\[Qv]|\(\?[a-zA-Z]*x")


def words_of(regex: str) -> frozenset[str] | None:
    """Lower-case words one of which is in any text that the regex matches, or
    None where there are no such words."""
    if UNSURE.search(regex):
        return None
    try:
        parsed = re._parser.parse(regex)
    except (re.error, OverflowError, RecursionError):
        return None
    return _needed(parsed)


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    worth = lambda s: (min(map(len, s)), -len(s))
    return a or b if not a or not b else max(a, b, key=worth)


def _needed(items) -> frozenset[str] | None:
    best, run = None, ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if name == "AT":
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(value[3])
        elif name == "ATOMIC_GROUP":
            inner = _needed(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _needed(value[2])
        elif name == "BRANCH":
            each = [_needed(branch) for branch in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        best = _better(best, inner)
    return _better(best, frozenset([run])) if run else best


def finder(regexes: list[str]) -> Callable[[str | None], list[int]]:
    """A function from a text to the places, in order, of the regexes that may
    match it: no regex that does is left out.  Case doesn't count."""
    import ahocorasick

    always, places = [], {}
    for k, regex in enumerate(regexes):
        words = words_of(regex)
        if not words:
            always.append(k)
        for word in words or ():
            places.setdefault(word, []).append(k)
    automaton = ahocorasick.Automaton()
    for word, of in places.items():
        automaton.add_word(word, of)
    if places:
        automaton.make_automaton()

    def find(text: str | None) -> list[int]:
        if text is None:
            return []
        found = set(always)
        if places:
            for _, of in automaton.iter(text.lower()):
                found.update(of)
        return sorted(found)

    return find


def candidates(regexes: list[str], records: Callable[[list[int]], list[dict]], schema: str):
    """A column function: of a text, the records of the regexes that it may
    match.  ``records`` makes them from the places of these; ``schema`` is the
    type of their array."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = finder(regexes)
        for texts in batches:
            yield pa.array([records(find(text)) for text in texts.to_pylist()], kind)

    return arrow_udf(run, schema)
