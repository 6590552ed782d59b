"""Tables in text: detection, cells, widths and rendering.

A block is an array of lines, and a detector an expression over it: it gives a
table(n_rows, n_cols, confidence, rows), with null for a place without a cell,
or null if the block is none.  Detection, cells, widths and rendering thus
happen inside one row; ``gather`` makes blocks of a table of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import centre, cut_cell, padded
from ..functions.patterns import has, let, letter_runs, match_places, strip, wide

# Delimiters in order of preference; limits of a valid table; how sure each detector is; patterns of table-like text.
DELIMITERS = [",", "\t", ";", "|"]
MIN_CELLS, MAX_ROWS, MAX_COLS, MIN_CONFIDENCE = 4, 50, 20, 0.6
HEADER_WORDS = ["NAME", "TYPE", "SIZE", "DATE", "ID", "STATUS"]
DELIMITED, SPACED, GRID, MARKDOWN = 0.75, 0.7, 0.8, 0.9
TABLE_TEXT = [("\\|<s>*[^|]+<s>*\\|.*?\\|", 0), ("(<s>+<w>+<s>+){3,}", 1)]
TABLE_LINES = 20

Detector = Callable[[Column], Column]


def gather(lines: DataFrame) -> DataFrame:
    """lines(block_id, line_no, line) -> block_id, lines: an array in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("block_id").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def filled(lines: Column) -> Column:
    """Lines with something on them, stripped."""
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def widest(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(1)))


def as_table(rows: Column, n_cols: Column, confidence: float) -> Column:
    return F.struct(F.size(rows).alias("n_rows"), n_cols.cast("int").alias("n_cols"), F.lit(confidence).alias("confidence"), rows.alias("rows"))


# detectors --------------------------------------------------------------


def delimiter_of(lines: Column, share: float = 0.7) -> Column:
    """(delimiter, per_line): the first whose usual count fits 70 % of the lines; a count that more than half have is the median."""

    def usual(delimiter: str) -> Column:
        counts = F.sort_array(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit("")))))
        fits = lambda c, v: (v > 0) & (F.size(F.filter(c, lambda x: x == v)) >= share * F.size(c))
        return let(counts, lambda c: let(F.get(c, F.floor(F.size(c) / 2).cast("int")), lambda v: F.when(fits(c, v), F.struct(F.lit(delimiter).alias("delimiter"), v.alias("per_line")))))

    return F.when(F.size(lines) >= 2, F.coalesce(*map(usual, DELIMITERS)))


def delimited(lines: Column) -> Column:
    """The table of a delimited block, its lines padded or cut to the usual width."""
    own = filled(lines)
    cells = lambda x, d: let(F.split(x, F.concat(F.lit("["), d["delimiter"], F.lit("]"))), lambda p: F.transform(F.sequence(F.lit(0), d["per_line"]), lambda i: strip(F.coalesce(F.get(p, i), F.lit("")))))
    return let(own, lambda o: let(delimiter_of(o), lambda d: F.when(d.isNotNull(), as_table(F.transform(o, lambda x: cells(x, d)), d["per_line"] + 1, DELIMITED))))


def column_starts(lines: Column, gap: int = 10) -> Column:
    """Column starts of a space-aligned block: word starts cut into clusters at gaps of ``gap``."""
    begins = F.transform(lines, lambda x: F.transform(match_places(strip(x), "[^\\t-\\r \\x1c-\\x1f\\x85\\p{Z}]+"), lambda m: m["begin"]))
    starts = F.array_sort(F.array_distinct(F.flatten(begins)))
    return let(starts, lambda s: F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) >= gap)))


def spaced(gap: int = 10) -> Detector:
    """Of a space-aligned block: each line cut at the block's column starts, blank pieces left out."""
    piece = lambda x, c, i: strip(F.substring(x, F.get(c, i) + 1, F.coalesce(F.get(c, i + 1), F.length(x)) - F.get(c, i)))
    cut = lambda o, c: F.transform(o, lambda x: F.transform(c, lambda _, i: F.nullif(piece(x, c, i), F.lit(""))))
    return lambda lines: let(filled(lines), lambda o: let(column_starts(o, gap), lambda c: F.when(F.size(c) >= 2, as_table(cut(o, c), F.size(c), SPACED))))


def grid(lines: Column) -> Column:
    """Of a grid: two rules or more, the other lines cut at ``+``, empty pieces left out."""
    is_rule = lambda x: has(x, "\\A[+\\-|]+\\z")
    pieces = lambda x: F.filter(F.transform(F.split(x, "\\+"), strip), lambda p: p != "")
    rows = lambda o: let(F.transform(F.filter(o, lambda x: ~is_rule(x)), pieces), lambda r: F.when(F.exists(r, lambda x: F.size(x) > 0), as_table(r, widest(r), GRID)))
    return let(filled(lines), lambda o: F.when(F.size(F.filter(o, is_rule)) >= 2, rows(o)))


def pipe_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.contains("|"))


def markdown(lines: Column) -> Column:
    """Of a pipe table: three pipe lines or more, separator lines left out, an empty piece at either end dropped."""
    kept = lambda o: F.filter(o, lambda x: ~has(x, "\\A[\\t-\\r \\x1c-\\x1f\\x85\\p{Z}|\\-]+\\z"))
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(strip(x), "\\A\\|", ""), "\\|\\z", "")
    pieces = lambda x: F.transform(F.split(trimmed(x), "\\|"), strip)
    rows = lambda o: let(F.transform(kept(o), pieces), lambda r: F.when(F.size(r) > 0, as_table(r, widest(r), MARKDOWN)))
    return let(pipe_lines(lines), lambda o: F.when(F.size(o) >= 3, rows(o)))


def vision(lines: Column) -> Column:
    """Of a model's answer: a pipe table, else the delimited pieces of three matches or more of a table-like pattern."""
    found = lambda t, pattern, group: let(F.regexp_extract_all(t, F.lit("(?d)" + wide(pattern)), F.lit(group)), lambda m: F.when(F.size(m) >= 3, m))
    pieces = lambda t: F.coalesce(*[found(t, *p) for p in TABLE_TEXT])
    other = let(F.array_join(lines, "\n"), lambda t: let(pieces(t), lambda p: F.when(p.isNotNull(), delimited(p))))
    return F.when(F.size(pipe_lines(lines)) >= 3, markdown(lines)).otherwise(other)


def n_cells(found: Column) -> Column:
    return F.aggregate(found["rows"], F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda x: x.isNotNull())))


def is_valid(found: Column) -> Column:
    """Within the limits of size and confidence."""
    fits = (found["n_rows"] >= 2) & (found["n_cols"] >= 2) & (found["n_rows"] <= MAX_ROWS) & (found["n_cols"] <= MAX_COLS)
    return fits & (found["confidence"] >= MIN_CONFIDENCE) & (n_cells(found) >= MIN_CELLS)


def detected(gap: int = 10) -> Detector:
    """Delimited, else space-aligned, else a grid; the first that fits decides, also if its table is not valid."""
    return lambda lines: let(F.coalesce(delimited(lines), spaced(gap)(lines), grid(lines)), lambda t: F.when(is_valid(t), t))


# what a table gives -----------------------------------------------------


def matrix(found: Column) -> Column:
    """All rows at full width, blank where there is no cell."""
    return F.transform(found["rows"], lambda r: F.transform(F.sequence(F.lit(0), found["n_cols"] - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))


def widths(rows: Column, least: int = 10, most: int = 50) -> Column:
    """Width of each column of a matrix."""
    return F.transform(rows[0], lambda _, i: F.greatest(F.lit(least), F.least(F.lit(most), F.array_max(F.transform(rows, lambda r: F.length(F.get(r, i)))))))


def rendered(found: Column, least: int = 10, most: int = 50) -> Column:
    """Markdown of a table: each column at its width, the first row centred above a rule, the others by their content."""
    piped = lambda cells: F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))
    blank = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    head = lambda r, w: F.transform(r, lambda x, i: blank(centre(cut_cell(x, F.get(w, i)), F.get(w, i))))
    body = lambda r, w: F.transform(r, lambda x, i: blank(let(strip(cut_cell(x, F.get(w, i))), lambda t: padded(t, F.get(w, i)))))
    rule = lambda w: F.transform(w, lambda x: F.repeat(F.lit("-"), x + 2))
    drawn = lambda m, w: F.concat(F.array(piped(head(m[0], w)), piped(rule(w))), F.transform(F.slice(m, F.lit(2), F.size(m)), lambda r: piped(body(r, w))))
    text = lambda t: let(matrix(t), lambda m: let(widths(m, least, most), lambda w: F.array_join(drawn(m, w), "\n")))
    return let(found, lambda t: F.when(t.isNotNull(), text(t)))


# over tables of lines ---------------------------------------------------


def tables_of(lines: DataFrame, detector: Detector) -> DataFrame:
    """lines(block_id, line_no, line) -> block_id, table of the blocks that are one."""
    return gather(lines).select("block_id", detector(F.col("lines")).alias("table")).where("table IS NOT NULL")


def cells_of(tables: DataFrame) -> DataFrame:
    """block_id, table -> block_id, row, col, text, is_header, n_rows, n_cols, confidence."""
    rows = tables.select("block_id", "table.n_rows", "table.n_cols", "table.confidence", F.posexplode("table.rows").alias("row", "cells"))
    cells = rows.select("block_id", "row", F.posexplode("cells").alias("col", "text"), (F.col("row") == 0).alias("is_header"), "n_rows", "n_cols", "confidence")
    return cells.where("text IS NOT NULL")


def detect_delimiter(lines: DataFrame, share: float = 0.7) -> DataFrame:
    """lines(block_id, line_no, line) -> block_id, delimiter, per_line; see ``delimiter_of``."""
    found = gather(lines).select("block_id", delimiter_of(filled(F.col("lines")), share).alias("found"))
    return found.where("found IS NOT NULL").select("block_id", "found.*")


def delimited_cells(lines: DataFrame) -> DataFrame:
    return cells_of(tables_of(lines, delimited))


def word_columns(lines: DataFrame, gap: int = 10) -> DataFrame:
    """block_id, cluster, start: see ``column_starts``."""
    return gather(lines).select("block_id", F.posexplode(column_starts(F.col("lines"), gap)).alias("cluster", "start"))


def spaced_cells(lines: DataFrame, gap: int = 10) -> DataFrame:
    return cells_of(tables_of(lines, spaced(gap)))


def grid_cells(lines: DataFrame) -> DataFrame:
    return cells_of(tables_of(lines, grid))


def markdown_cells(lines: DataFrame) -> DataFrame:
    return cells_of(tables_of(lines, markdown))


def vision_cells(lines: DataFrame) -> DataFrame:
    return cells_of(tables_of(lines, vision))


def table_cells(lines: DataFrame, gap: int = 10) -> DataFrame:
    """Cells of the valid table in each block of text."""
    return cells_of(tables_of(lines, detected(gap)))


def valid_tables(cells: DataFrame) -> DataFrame:
    """Tables of cells within the limits of size and confidence."""
    sizes = cells.groupBy("block_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.count("*").alias("n_cells"), F.max("confidence").alias("confidence"))
    fits = (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2) & (F.col("n_cells") >= MIN_CELLS) & (F.col("n_rows") <= MAX_ROWS) & (F.col("n_cols") <= MAX_COLS)
    return sizes.where(fits & (F.col("confidence") >= MIN_CONFIDENCE)).select("block_id", "n_rows", "n_cols", "n_cells")


def cell_at(cells: DataFrame, places: DataFrame) -> DataFrame:
    """cells(block_id, cell_no, row, col, rowspan, colspan, text), places(block_id, at_row, at_col) -> places, text of the first cell over each."""
    over = F.col("at_row").between(F.col("row"), F.col("row") + F.col("rowspan") - 1) & F.col("at_col").between(F.col("col"), F.col("col") + F.col("colspan") - 1)
    c = cells.withColumnRenamed("block_id", "cell_block")
    joined = places.join(c, (F.col("block_id") == F.col("cell_block")) & over, "left")
    return joined.groupBy("block_id", "at_row", "at_col").agg(F.min_by("text", "cell_no").alias("text"))


def header_score(cells: DataFrame) -> DataFrame:
    """Whether the first row is marked as a header or reads like one."""
    word = F.lit(False)
    for w in HEADER_WORDS:
        word = word | F.upper("text").contains(w)
    score = F.when(word, 1.0).otherwise(0.0) + F.when(F.length("text") < 50, 0.5).otherwise(0.0)
    return cells.where("row = 0").groupBy("block_id").agg((F.bool_or("is_header") | (F.sum(score) / F.count("*") > 0.5)).alias("is_header"))


def overlaid(cells: DataFrame) -> DataFrame:
    """cells, with spans if they have any -> block_id, table: cells cover their spans, and the last one of a place wins."""
    spans = [F.col(c) if c in cells.columns else F.lit(1) for c in ("rowspan", "colspan")]
    order = F.col("cell_no") if "cell_no" in cells.columns else F.struct("row", "col")
    down = F.when(F.col("row") < F.col("n_rows"), F.sequence("row", F.least(F.col("row") + spans[0], F.col("n_rows")) - 1))
    across = F.when(F.col("col") < F.col("n_cols"), F.sequence("col", F.least(F.col("col") + spans[1], F.col("n_cols")) - 1))
    laid = cells.select("block_id", order.alias("order"), "text", "n_rows", "n_cols", F.explode_outer(down).alias("row"), across.alias("across")).select("block_id", "order", "text", "n_rows", "n_cols", "row", F.explode_outer("across").alias("col"))
    top = laid.groupBy("block_id", "row", "col").agg(F.max_by("text", "order").alias("text"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
    places = F.map_from_entries(F.collect_list(F.when(F.col("row").isNotNull() & F.col("col").isNotNull(), F.struct(F.struct("row", "col"), "text"))))
    found = top.groupBy("block_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), places.alias("places"))
    at = lambda r, c: F.element_at("places", F.struct(r.alias("row"), c.alias("col")))
    rows = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: at(r, c)))
    return found.select("block_id", as_table(rows, F.col("n_cols"), 1.0).alias("table"))


def matrix_rows(tables: DataFrame) -> DataFrame:
    """block_id, table -> block_id, row, col, text: a row for every place."""
    return tables.select("block_id", F.posexplode(matrix(F.col("table"))).alias("row", "cells")).select("block_id", "row", F.posexplode("cells").alias("col", "text"))


def column_widths(tables: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    return tables.select("block_id", F.posexplode(let(matrix(F.col("table")), lambda m: widths(m, least, most))).alias("col", "width"))


def render_tables(tables: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    """block_id, table -> block_id, markdown."""
    return tables.select("block_id", rendered(F.col("table"), least, most).alias("markdown"))


# over texts -------------------------------------------------------------


def format_elements(docs: DataFrame, gap: int = 10) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text: the table that each text is, or the text between line ends; one scan, no shuffle."""
    made = rendered(detected(gap)(text_lines(F.col("text"))))
    return docs.select("doc_id", F.coalesce(made, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))).alias("text"))


def table_runs(lines: Column) -> Column:
    """Pieces (start, size, letter) of a text's lines, in order.

    Lines with a pipe, two commas or two tabs have the letter m.  Runs of them
    are taken in pieces of 20, the first of 19 where a line precedes.
    """
    marks = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    letter = lambda x: F.when(x.contains("|") | (marks(x, ",") >= 2) | (marks(x, "\t") >= 2), "m").otherwise("-")
    return letter_runs(lines, letter, f"(?<=-)m{{1,{TABLE_LINES - 1}}}|m{{1,{TABLE_LINES}}}|-+")


def format_tables(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with the tables among its lines rendered; one scan, no shuffle.

    Pieces of three marked lines or more that hold a table are replaced by it,
    all other lines stay.
    """

    def replaced(lines: Column) -> Column:
        def made(piece: Column) -> Column:
            own = F.slice(lines, piece["start"] + 1, piece["size"])
            return let(own, lambda x: F.coalesce(F.when((piece["letter"] == "m") & (piece["size"] >= 3), rendered(vision(x))), F.array_join(x, "\n")))

        return F.array_join(F.transform(table_runs(lines), made), "\n")

    return docs.select("doc_id", let(text_lines(F.col("text")), replaced).alias("text"))
