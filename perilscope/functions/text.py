"""Text predicates. ``(?U)`` gives word and space classes their Unicode meaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilscope.config import PatternRule


def eligible(text: Column) -> Column:
    """Not null and not blank."""
    return text.isNotNull() & text.rlike(r"(?U)\S")


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


#: Lists up to this length are searched term by term, longer ones by shared prefixes.
SEARCHED_EACH = 12
#: Bytes of one pattern; Java's class files hold no longer constant than 65,535.
PATTERN_BYTES = 60_000


def _branches(node: dict[str, dict]) -> list[str]:
    """A pattern for every first letter that the terms below a node go on with."""
    found = []
    for letter, below in sorted(node.items()):
        if not letter:  # a term ends here
            continue
        run = letter
        while len(below) == 1 and "" not in below:
            letter, below = next(iter(below.items()))
            run += letter
        rest = _branches(below)
        tail = f"(?:{'|'.join(rest)})" + ("?" if "" in below else "") if rest else ""
        found.append(_quoted(run) + tail)
    return found


def prefix_patterns(terms: Sequence[str], most: int = PATTERN_BYTES) -> list[str]:
    """Patterns that together match what any of the terms matches, for lists of any length.

    Terms share their prefixes, so a place in the text is compared with the few
    letters that can stand there, however many terms go on from them. Sorted
    terms are cut into as many patterns as keep each below ``most`` bytes; only
    a single term may be longer.
    """
    tree: dict[str, dict] = {}
    for term in terms:
        node = tree
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = {}
    pattern = "(?:" + "|".join(_branches(tree)) + ")" + ("?" if "" in tree else "")
    kinds = sorted(set(terms))
    if len(pattern.encode()) <= most or len(kinds) == 1:
        return [pattern]
    half = len(kinds) // 2
    return prefix_patterns(kinds[:half], most) + prefix_patterns(kinds[half:], most)


def _any_prefixed(text: Column, terms: Sequence[str], shape: str) -> Column:
    """``shape`` holds ``{}`` where the terms' pattern goes."""
    found = F.lit(False)
    for pattern in prefix_patterns(terms):
        found = found | text.rlike(shape.replace("{}", pattern))
    return found


def _any_of_many(text: Column, terms: Sequence[str], edge: str) -> Column:
    """Any of a long list, between ``edge`` patterns, in any letter case.

    ASCII terms are searched in the lower-cased text, with the letters that only
    fold to ASCII replaced; other terms need patterns that ignore case.
    """
    plain = sorted({t.lower() for t in terms if t.isascii()})
    other = sorted({t for t in terms if not t.isascii()})
    found = F.lit(False)
    if plain:
        folded = F.lower(F.translate(text, "".join(_FOLDS_TO_ASCII), "sii"))
        found = found | _any_prefixed(folded, plain, "(?U)" * bool(edge) + edge + "{}" + edge)
    if other:
        found = found | _any_prefixed(text, other, "(?iU)" + edge + "{}" + edge)
    return found


# Letters outside ASCII that match an ASCII letter when case is ignored, and that
# lower-casing does not turn into it: long s, dotless i, dotted capital I.
_FOLDS_TO_ASCII = ("\u017f", "\u0131", "\u0130")


def _any_contained(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def lowered(text: Column) -> Column:
    """The text in lower case, for byte searches: several times faster than patterns."""
    return F.lower(text)


def folds_to_ascii(text: Column) -> Column:
    """The text holds a letter that a search of the lower-cased text would miss."""
    return _any_contained(text, _FOLDS_TO_ASCII)


def contains_word(
    text: Column, words: Sequence[str], low: Column | None = None, odd: Column | None = None
) -> Column:
    """Any of the words as a whole word, in any letter case.

    ``low`` and ``odd`` are ``lowered`` and ``folds_to_ascii`` of the text where
    they are columns already. Lists of more than ``SEARCHED_EACH`` words go by
    shared prefixes, at about the same cost however long they are.
    """
    if len(set(words)) > SEARCHED_EACH:
        return _any_of_many(text, words, r"\b")
    found = text.rlike(r"(?iU)\b(?:" + "|".join(_quoted(w) for w in words) + r")\b")
    if not all(w.isascii() for w in words):
        return found
    low = lowered(text) if low is None else low
    odd = folds_to_ascii(text) if odd is None else odd
    hit = odd & found
    # The pattern starts with the word's own letters, which are found by a plain
    # search, and looks back for the boundary only where they occur.
    for word in sorted({w.lower() for w in words}):
        literal = _quoted(word)
        hit = hit | (low.contains(word) & low.rlike(rf"(?U){literal}\b(?<=\b{literal})"))
    return hit


def contains_term(
    text: Column, terms: Sequence[str], low: Column | None = None, odd: Column | None = None
) -> Column:
    """Any of the terms anywhere in the text, in any letter case; long lists as for words."""
    if len(set(terms)) > SEARCHED_EACH:
        return _any_of_many(text, terms, "")
    found = text.rlike("(?iu)" + "|".join(_quoted(t) for t in terms))
    if not all(t.isascii() for t in terms):
        return found
    low = lowered(text) if low is None else low
    odd = folds_to_ascii(text) if odd is None else odd
    return _any_contained(low, sorted({t.lower() for t in terms})) | (odd & found)


def matches_rule(text: Column, rule: PatternRule) -> Column:
    found = text.rlike("(?U)" + rule.pattern)
    if rule.must_contain:
        return text.contains(rule.must_contain) & found
    return found


def heads_reach(heads: Sequence[str], threshold: float) -> Column:
    """The highest head is at or above the threshold; a NaN head makes the row not toxic."""
    columns = [F.col(h).cast("double") for h in heads]
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return F.coalesce((top >= F.lit(threshold)) & ~F.isnan(top), F.lit(False))
