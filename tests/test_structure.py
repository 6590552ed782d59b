"""Tables and mathematics inside one row: plans, brute force and long texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import mathx, tables
from quillspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


def executed(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("t15_format_elements", 1, 1), ("t16_format_tables", 1, 1), ("t01_table_cells", 1, 1), ("t09_valid_tables", 1, 1), ("t12_table_matrix", 1, 1), ("m05_math_spans", 1, 0), ("m07_splice", 1, 0)])
def test_plans(spark, name, scans, exchanges):
    """One scan, and at most the exchange that makes blocks of the lines."""
    plan = executed(plans.QUERIES[name](spark, SF))
    assert plan.count("FileScan parquet") == scans and len(re.findall(r"\bExchange\b", plan)) <= exchanges and "Window" not in plan


# tables -----------------------------------------------------------------


def markdown_of(piece: list[str]) -> str | None:
    """The table of a piece of pipe lines by hand."""
    pipes = [x for x in piece if "|" in x]
    if len(pipes) < 3:
        return None
    rows = [[c.strip() for c in re.sub(r"\|\Z", "", re.sub(r"\A\|", "", x.strip())).split("|")] for x in pipes if not re.fullmatch(r"[\s|-]+", x)]
    if not rows:
        return None
    n = max(map(len, rows))
    rows = [r + [""] * (n - len(r)) for r in rows]
    width = [max(10, min(50, max(len(r[k]) for r in rows))) for k in range(n)]
    short = lambda t, w: t if len(t) <= w else t[: w - 3] + "..."

    def body(t: str, w: int) -> str:
        t = short(t, w).strip()
        if re.fullmatch(r"\d+\.?\d*|\.\d+", t):
            return t.rjust(w)
        return t.center(w) if len(t) < w // 2 and " " not in t else t.ljust(w)

    line = lambda cells: "|" + "|".join(cells) + "|"
    out = [line(f" {short(c, w).center(w)} " for c, w in zip(rows[0], width, strict=True)), line("-" * (w + 2) for w in width)]
    return "\n".join(out + [line(f" {body(c, w)} " for c, w in zip(r, width, strict=True)) for r in rows[1:]])


def formatted(text: str) -> str:
    """Runs of marked lines in pieces of 20, the first of 19 where a line precedes."""
    lines, out, at = text.split("\n"), [], 0
    marked = lambda x: "|" in x or x.count(",") >= 2 or x.count("\t") >= 2
    while at < len(lines):
        end = at
        limit = 20 if at == 0 or marked(lines[at - 1]) else 19
        while end < len(lines) and end - at < limit and marked(lines[end]):
            end += 1
        piece = lines[at:end] if end - at >= 3 else []
        made = markdown_of(piece) if piece else None
        end = max(end, at + 1)
        out += [made] if made else lines[at:end]
        at = end
    return "\n".join(out)


def test_format_tables_mixed(spark):
    """Comma, tab, pipe and mixed runs of all lengths, at the start and end of texts, and rules of dashes."""
    draw = random.Random(6)
    make = [lambda k: f"a{k},b {k},{k}", lambda k: f"x\t{k}\ty{k}", lambda k: f"| a{k} | {k}.5 | {'long words ' * draw.randint(0, 6)}|", lambda k: "|---|---|", lambda k: f"{k} | only one", lambda k: "plain words", lambda k: ""]
    texts = ["\n".join(draw.choice(make[: draw.randint(1, 7)])(k) for k in range(draw.randint(0, 9))) for _ in range(60)]
    texts += ["\n".join([*["intro"] * lead, *[make[2](k) for k in range(size)], *["end"] * tail]) for lead in (0, 1) for tail in (0, 1) for size in (2, 3, 19, 20, 21, 22, 23, 45)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in tables.format_tables(frame).collect()}
    for k, t in enumerate(texts):
        assert got[k] == formatted(t), t


def test_long_text(spark):
    """A text of 20,000 rows of a pipe table is rendered piece by piece in seconds."""
    frame = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.concat(F.lit("| a | "), k.cast("string"), F.lit(" |"))), "\n").alias("text"))
    began = time.time()
    out = tables.format_tables(frame).first().text
    assert out.count("\n|---") == 1000 and time.time() - began < 30


def test_last_cell_wins(spark):
    """Cells that cover places of others: the later one shows, what reaches beyond the table is cut."""
    rows = [(1, 0, 0, 0, 2, 2, "a"), (1, 1, 1, 1, 1, 9, "b"), (1, 2, 5, 0, 1, 1, "out")]
    cells = spark.createDataFrame(rows, "block_id int, cell_no int, row int, col int, rowspan int, colspan int, text string").withColumns({"n_rows": F.lit(2), "n_cols": F.lit(3)})
    got = {(r.row, r.col): r.text for r in tables.matrix_rows(tables.overlaid(cells)).collect()}
    assert got == {(0, 0): "a", (0, 1): "a", (0, 2): "", (1, 0): "a", (1, 1): "b", (1, 2): "b"}


# mathematics ------------------------------------------------------------


def slow_spans(text: str) -> list[tuple]:
    """All rules by their plain patterns, containment and dollar context by definition."""
    found = []
    for rule, (_, pattern, _, outside) in enumerate(mathx.SPANS):
        for m in re.finditer(pattern.replace("<w>", r"\w").replace("<s>", r"\s"), text):
            if not (outside and text[: m.start()].count("$") % 2 and "$" in text[m.start() :]):
                found.append((m.start(), rule, m.end()))
    found.sort()
    return [s for k, s in enumerate(found) if not any(e >= s[2] for _, _, e in found[:k])]


SCRAPS = st.lists(st.sampled_from(["a", "é", "_", "^", "/", " ", "=", "{", "}", "$", "$$", "\\(", "\\)", "\\[", "\\]", "∫", "\\int", "12", "≤", "+", "\n"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(SCRAPS)
def test_scan(text):
    spans = mathx.kept(list(mathx.scan(text)))
    assert [(s.begin, s.rule, s.end) for s in spans] == slow_spans(text)
    want = text
    for s in reversed(spans):
        want = want[: s.begin] + s.latex + want[s.end :]
    assert mathx.spliced(text, spans) == want


def test_scan_is_linear():
    """A megabyte of formulas, one of a single word, one of fractions in dollars."""
    for text in ("ratio a/b and x^{2} with a_5 is $q/2$ so y = 7*2 " * 20_000, "w" * 1_000_000, "$ a/b " * 170_000, "_" * 1_000_000):
        began = time.time()
        mathx.spliced(text, mathx.kept(list(mathx.scan(text))))
        assert time.time() - began < 10, text[:20]


def test_null_texts(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "no signs"), (4, "a/b")], "doc_id long, text string")
    assert [(r.doc_id, r.latex) for r in mathx.recognised(frame).collect()] == [(4, "\\frac{a}{b}")]
    assert {r.doc_id: r.text for r in mathx.format_math(frame).collect()} == {1: None, 2: "", 3: "no signs", 4: "\\frac{a}{b}"}
