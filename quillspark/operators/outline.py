"""Structured lines: domains, tasks, bullets, contents, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import count, has, strip, wide

# Line patterns in the order in which they are tried, with their levels.
LINE_RULES = [
    ("domain", 1, "(?i)\\A(DOMAIN<s>+([IVXLCDM]+)<s>+|Project<s>+Management<s>+Professional.*DOMAIN<s>+([IVXLCDM]+)<s>+)([^—]+?)<s>*—<s>*(\\d+%)"),
    ("task", 2, "(?i)\\A(Task<s>+(\\d+)|Task<s>+statement<s>*:)<s>*(.+)?\\z"),
    ("bullet", 3, "\\A[•\\-*]<s>*(.+)\\z"),
    ("table_of_contents", 1, "(?i)\\A([A-Z][^.]{10,50})<s>*\\.+<s>*(\\d+)\\z"),
    ("percentage_breakdown", 2, "\\A([^:]+?)<s>*[:\\-]?<s>*(\\d+%)\\z"),
]
#: Groups of each rule's pattern that hold its keys.
KEYS = {"domain": (2, 4, 5), "task": (2, 3, None), "bullet": (1, None, None), "table_of_contents": (1, 2, None), "percentage_breakdown": (1, 2, None)}


def part(line: Column, kind: str, pattern: str, slot: int) -> Column:
    group = KEYS[kind][slot]
    if group is None:
        return F.lit("")
    found = F.regexp_extract(line, "(?d)" + wide(pattern), group)
    if kind == "domain" and slot == 0:
        other = F.regexp_extract(line, "(?d)" + wide(pattern), 3)
        found = F.when(found == "", other).otherwise(found)
    return strip(found)


def structured_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line) -> + content_type, level, k1, k2, k3; the first rule that fits wins."""
    own = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    fit = {k: has(F.col("line"), p) for k, _, p in LINE_RULES}
    choose = lambda values: F.coalesce(*[F.when(fit[k], v) for k, v in values])
    out = own.withColumn("content_type", choose([(k, F.lit(k)) for k, *_ in LINE_RULES])).withColumn("level", choose([(k, F.lit(n)) for k, n, _ in LINE_RULES]))
    for slot in range(3):
        out = out.withColumn(f"k{slot + 1}", choose([(k, part(F.col("line"), k, p, slot)) for k, _, p in LINE_RULES]))
    return out.where("content_type IS NOT NULL")


def rendered(kind: Column, line: Column, k1: Column, k2: Column, k3: Column) -> Column:
    task = F.when((k1 != "") & (k2 != ""), F.concat(F.lit("### Task "), k1, F.lit(": "), k2)).when(k2 != "", F.concat(F.lit("### "), k2)).otherwise(F.concat(F.lit("### "), line))
    return (
        F.when(kind == "domain", F.concat(F.lit("## Domain "), k1, F.lit(": "), k2, F.lit(" ("), k3, F.lit(")")))
        .when(kind == "task", task)
        .when(kind == "bullet", F.concat(F.lit("- "), k1))
        .when(kind == "table_of_contents", F.concat(F.lit("- **"), k1, F.lit("** ... Page "), k2))
        .otherwise(F.concat(F.lit("- **"), k1, F.lit("**: "), k2))
    )


def render_lines(lines: DataFrame) -> DataFrame:
    """Lines with the structured ones rewritten."""
    found = structured_lines(lines).select("doc_id", "line_no", rendered(*map(F.col, ("content_type", "line", "k1", "k2", "k3"))).alias("new"))
    return lines.join(found, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("new", "line").alias("line"))


# What makes a line one of the census, and lines in columns.
DOTS = "." * 32
COLUMNS = ["\\A[A-Za-z\\t-\\r \\x1c-\\x1f\\x85\\p{Z}]+<s>+\\d+<s>+\\d+", "\\A[A-Za-z\\t-\\r \\x1c-\\x1f\\x85\\p{Z}]+<s>+\\$?\\d+", "\\A<w>+<s>+<w>+<s>+\\d+"]


def census_tests(line: Column) -> dict[str, Column]:
    """Layout patterns of a stripped line."""
    pipes = count(line, "\\|") >= 3
    plain = ~(line.startswith("##") | line.startswith("```") | line.startswith("•") | line.startswith("Task") | line.contains("DOMAIN"))
    return {
        "dots": line.contains(DOTS), "pipes": pipes, "tabs": line.contains("\t"), "spaces": has(line, " {3,}"), "tasks": line.startswith("Task"),
        "domains": line.contains("DOMAIN") & line.contains("%"), "bullets": line.startswith("•"), "percents": has(line, "\\d+%"),
        "table_rows": pipes & plain, "in_columns": has(line, COLUMNS[0]) | has(line, COLUMNS[1]) | has(line, COLUMNS[2]),
    }


def line_census(lines: DataFrame) -> DataFrame:
    """How many lines show each layout pattern."""
    own = lines.select(strip(F.col("line")).alias("line")).where("line <> ''")
    return own.agg(*[F.count_if(c).alias(n) for n, c in census_tests(F.col("line")).items()])


def line_samples(lines: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` lines of each document that show each pattern."""
    own = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    kinds = F.array_compact(F.array(*[F.when(c, k) for k, c in census_tests(F.col("line")).items()]))
    marked = own.select("doc_id", "line_no", "line", F.explode(kinds).alias("pattern"))
    place = F.row_number().over(Window.partitionBy("doc_id", "pattern").orderBy("line_no"))
    return marked.withColumn("place", place).where(F.col("place") <= n)


def page_sections(text: Column) -> Column:
    """How many parts a text falls into at its page headings, less the one before the first."""
    return F.size(F.split(text, "## Page")) - 1
