"""Patterns that Java and RE2 read alike.

``\\w`` and ``\\s`` are Unicode classes here, written out, and ``(?d)`` makes
Java take the line feed as the only line end.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

W = "[\\p{L}\\p{N}_]"
S = "[\\t-\\r \\x1c-\\x1f\\x85\\p{Z}]"


def wide(pattern: str) -> str:
    """Write the shorthands <w> and <s> out."""
    return pattern.replace("<w>", W).replace("<s>", S)


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(f"(?d{flags}){wide(pattern)}")


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(f"(?d{flags}){wide(pattern)}"))


def swap(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, f"(?d{flags}){wide(pattern)}", by)


def strip(text: Column) -> Column:
    return swap(text, "\\A<s>+|<s>+\\z", "")


def holds(text: Column, *parts: str) -> Column:
    """Whether the text contains any of the parts."""
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def one(condition: Column, value: float = 1.0) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running folds of an array with an associative ``op``: each pass folds in what stands twice as far back."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda own, s: F.transform(own, lambda x, i: F.when(i >= s, op(F.get(own, i - s), x)).otherwise(x)))


def running_sum(numbers: Column) -> Column:
    return running(numbers, add)


def running_max(numbers: Column) -> Column:
    return running(numbers, F.greatest)


#: Two characters that no text holds (Unicode reserves them for a program's own use) mark matches and their parts.
MATCH, PART = "\uFDD0", "\uFDD1"


def cut(text: Column, pattern: str, flags: str = "", groups: int = 0) -> Column:
    """A text cut by one pass of a pattern: [what precedes], then [match, its groups.., what follows] for each match.

    The two marks, should a text hold them, count as U+FFFD.
    """
    marked = MATCH + "$0" + PART + "".join(f"${k}{PART}" for k in range(1, groups + 1))
    own = F.when(holds(text, MATCH, PART), F.translate(text, MATCH + PART, "\uFFFD\uFFFD")).otherwise(text)
    return F.transform(F.split(swap(own, pattern, marked, flags), MATCH), lambda x: F.split(x, PART))


def places(pieces: Column) -> Column:
    """Begin of each match of a cut text: running lengths of the matches and of what stands between them."""
    return running_sum(F.transform(pieces, lambda x, i: F.when(i > 0, F.length(x[0])).otherwise(0) + F.length(F.element_at(x, -1))))


def match_places(text: Column, pattern: str, flags: str = "") -> Column:
    """(begin, end, match) of each match, in order."""
    found = lambda p, at: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: F.struct(F.get(at, i).alias("begin"), (F.get(at, i) + F.length(x[0])).alias("end"), x[0].alias("match")))
    return let(cut(text, pattern, flags), lambda p: let(places(p), lambda at: found(p, at)))


def letter_runs(lines: Column, letter: Callable[[Column], Column], pattern: str) -> Column:
    """Pieces (start, size, letter) of an array: a word of a letter for each element is cut by a pattern.

    The pattern matches everywhere, so the pieces cover the array; ``letter``
    of a piece is that of its first element.
    """
    word = F.array_join(F.transform(lines, letter), "")
    piece = lambda x, end: F.struct((end - F.length(x)).alias("start"), F.length(x).alias("size"), F.left(x, F.lit(1)).alias("letter"))
    placed = lambda p: let(running_sum(F.transform(p, F.length)), lambda e: F.transform(p, lambda x, i: piece(x, F.get(e, i))))
    return let(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), placed)
