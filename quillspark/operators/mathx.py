"""Mathematical spans: places, types, LaTeX, and splicing.

A text is scanned by a helper in Arrow batches: nine patterns take one pass
each, and only where their signs occur, so the work grows with the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (type, pattern, confidence, whether a span inside $...$ is skipped), in order of discovery.
SPANS = [
    ("inline", "\\$([^$]+)\\$", 0.95, False),
    ("display", "\\$\\$([^$]+)\\$\\$", 0.95, False),
    ("inline", "\\\\\\((.*?)\\\\\\)", 0.90, False),
    ("display", "\\\\\\[([^\\\\]+)\\\\\\]", 0.90, False),
    ("fraction", "(<w>+)<s>*/<s>*(<w>+)", 0.80, True),
    ("superscript", "(<w>+)\\^(\\{?<w>+\\}?)", 0.75, True),
    ("subscript", "(<w>+)_(\\{?<w>+\\}?)", 0.75, True),
    ("integral", "∫|\\\\int", 0.70, True),
    ("equation", "<w>+<s>*[=≠≤≥]<s>*(?:<w>|[()+\\-*/^])+", 0.65, True),
]
#: A text without any of these holds no span of the rule.
SIGNS = [("$",), ("$$",), ("\\)",), ("\\]",), ("/",), ("^",), ("_",), ("∫", "\\int"), tuple("=≠≤≥")]

#: Spans of a text.
SPAN_LIST = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("rule", T.IntegerType()), ("begin", T.IntegerType()), ("end", T.IntegerType()), ("match", T.StringType()), ("math_type", T.StringType()), ("confidence", T.DoubleType()), ("latex", T.StringType()))]))


class Span(NamedTuple):
    begin: int
    rule: int
    end: int
    match: str
    latex: str


def compiled(pattern: str) -> re.Pattern:
    """A word that a match begins with is taken from its start: a match from its middle would be one from there, too."""
    own = pattern.replace("<w>", "\\w").replace("<s>", "\\s")
    return re.compile("(?<!\\w)" + own if "<w>" in pattern else own)


PATTERNS = [compiled(p) for _, p, _, _ in SPANS]


def latex(kind: str, found: re.Match) -> str:
    match kind:
        case "fraction":
            return f"\\frac{{{found[1]}}}{{{found[2]}}}"
        case "superscript" | "subscript":
            return f"{found[1]}{'^' if kind == 'superscript' else '_'}{{{found[2].strip('{}')}}}"
        case "integral":
            return found[0].replace("∫", "\\int")
    return found[0]


def scan(text: str) -> Iterator[Span]:
    """All spans, rule by rule; those that skip formulas have an even number of dollar signs before them, or none after."""
    dollars = [m.start() for m in re.finditer("\\$", text)]
    for rule, ((kind, _, _, outside), pattern, signs) in enumerate(zip(SPANS, PATTERNS, SIGNS, strict=True)):
        if any(s in text for s in signs):
            for found in pattern.finditer(text):
                before = bisect_left(dollars, found.start())
                if not (outside and before % 2 and before < len(dollars)):
                    yield Span(found.start(), rule, found.end(), found[0], latex(kind, found))


def kept(spans: list[Span]) -> list[Span]:
    """By place, those not contained in one that begins earlier (or is found earlier at the same place)."""
    ordered = sorted(spans)
    reach = accumulate((s.end for s in ordered), max, initial=-1)
    return [s for s, far in zip(ordered, reach, strict=False) if far < s.end]


def spliced(text: str, spans: list[Span]) -> str:
    """A text with each span replaced by its LaTeX, from right to left; one that reaches into the next cuts what that became."""
    pieces: list[str] = []  # of the rewritten text from ``start`` on, last first
    start = len(text)
    for s in reversed(spans):
        if s.end <= start:
            pieces.append(text[s.end : start])
        else:
            pieces = ["".join(reversed(pieces))[s.end - start :]]
        pieces.append(s.latex)
        start = s.begin
    return text[:start] + "".join(reversed(pieces))


def span_lists(found: list[list[Span] | None]) -> pa.Array:
    """The Arrow form of SPAN_LIST."""
    flat = [s for spans in found for s in spans or ()]
    rules = [s.rule for s in flat]
    kinds, sure = [SPANS[r][0] for r in rules], [SPANS[r][2] for r in rules]
    columns = {"rule": pa.array(rules, pa.int32()), "begin": pa.array([s.begin for s in flat], pa.int32()), "end": pa.array([s.end for s in flat], pa.int32()), "match": pa.array([s.match for s in flat], pa.string()), "math_type": pa.array(kinds, pa.string()), "confidence": pa.array(sure, pa.float64()), "latex": pa.array([s.latex for s in flat], pa.string())}
    ends = list(accumulate((len(spans or ()) for spans in found), initial=0))
    offsets = pa.array([None if s is None else e for s, e in zip([*found, ()], ends, strict=True)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns.values(), list(columns)))


@F.arrow_udf(SPAN_LIST)
def span_array(texts: pa.Array) -> pa.Array:
    """All spans of a text, the rules one after another; null for a null text."""
    return span_lists([None if t is None else list(scan(t)) for t in texts.to_pylist()])


@F.arrow_udf(SPAN_LIST)
def outermost_array(texts: pa.Array) -> pa.Array:
    """The outermost spans of a text by place; null for a null text."""
    return span_lists([None if t is None else kept(list(scan(t))) for t in texts.to_pylist()])


@F.arrow_udf(T.StringType())
def with_latex(texts: pa.Array) -> pa.Array:
    """A text with its outermost spans replaced; null for a null text."""
    return pa.array([None if t is None else spliced(t, kept(list(scan(t)))) for t in texts.to_pylist()], pa.string())


def has_signs(text: Column) -> Column:
    """Whether any rule's sign occurs; other texts need not leave the JVM."""
    return text.rlike("[$/^_∫=≠≤≥]|\\\\[)\\]]|\\\\int")


def math_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, rule, begin, end, match, math_type, confidence, latex."""
    return docs.where(has_signs(F.col("text"))).select("doc_id", F.inline(span_array("text")))


def recognised(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> its outermost spans, from one scan without a shuffle."""
    return docs.where(has_signs(F.col("text"))).select("doc_id", F.inline(outermost_array("text")))


def outermost(spans: DataFrame) -> DataFrame:
    """The outermost of spans(doc_id, begin, rule, end, ..) that stand in a table."""
    before = Window.partitionBy("doc_id").orderBy("begin", "rule", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR reach < end").drop("reach")


def format_math(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with its mathematics as LaTeX, from one scan without a shuffle."""
    return docs.select("doc_id", with_latex("text").alias("text"))
