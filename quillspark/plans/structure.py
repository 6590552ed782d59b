"""Queries of tables, code and mathematics in text, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, mathx, tables
from ..sources import corpus
from . import sql as D
from .queries import ORACLES, QUERIES

# tables -----------------------------------------------------------------


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of twenty parts: delimited in two ways, in columns, as a grid, as a pipe table, and prose."""
    p = corpus.table(spark, sf_dir, "part")
    block, at = F.floor(F.col("p_partkey") / 20), F.col("p_partkey") % 20
    key, kind, size = F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_size").cast("string")
    spaced = F.concat(F.rpad(key, 40, " "), F.rpad(F.translate(kind, " ", "_"), 40, " "), size)
    grid = F.when(at.isin(0, 19), "+---+---+---+").otherwise(F.concat(F.lit("+ "), F.concat_ws(" + ", key, kind, size), F.lit(" +")))
    pipe = F.when(at == 1, "|---|---|---|").otherwise(F.concat(F.lit("| "), F.concat_ws(" | ", key, kind, size), F.lit(" |")))
    shapes = [F.concat_ws(",", key, kind, size), F.concat_ws(";", key, kind, F.when(at % 5 != 0, size)), spaced, grid, pipe]
    line = F.concat(F.lit("some words and "), size)
    for k, shape in enumerate(shapes):
        line = F.when(block % 6 == k, shape).otherwise(line)
    return p.select(block.alias("block_id"), at.cast("int").alias("line_no"), line.alias("line"))


DELIMITED_SQL = """counts_{0} AS (SELECT block_id, k, d, length(line) - length(replace(line, d, '')) AS c FROM own_{0}, (VALUES (0, ','), (1, chr(9)), (2, ';'), (3, '|')) v(k, d)),
modes_{0} AS (SELECT block_id, k, d, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY block_id, k) AS total FROM counts_{0} GROUP BY block_id, k, d, c),
chosen_{0} AS (SELECT block_id, arg_min(d, k) AS delimiter, arg_min(c, k) AS per_line FROM modes_{0} WHERE c > 0 AND n >= 0.7 * total AND total >= 2 GROUP BY block_id),
delimited_{0} AS (SELECT block_id, row, CAST(i AS INTEGER) AS col, trim(split_part(line, delimiter, CAST(i AS INTEGER) + 1)) AS text, row = 0 AS is_header, n_rows, CAST(per_line + 1 AS INTEGER) AS n_cols FROM own_{0} JOIN chosen_{0} USING (block_id), range(0, per_line + 1) t(i))"""


def own_sql(name: str, source: str) -> str:
    return f"own_{name} AS (SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY line_no) - 1 AS INTEGER) AS row, CAST(count(*) OVER (PARTITION BY block_id) AS INTEGER) AS n_rows, trim(line) AS line FROM {source} WHERE trim(line) <> ''),\n" + DELIMITED_SQL.format(name)


PART_LINES = """WITH parts AS (SELECT p_partkey // 20 AS block_id, CAST(p_partkey % 20 AS INTEGER) AS line_no, CAST(p_partkey AS VARCHAR) AS key, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part),
lines AS (SELECT block_id, line_no, CASE block_id % 6 WHEN 0 THEN key || ',' || kind || ',' || size WHEN 1 THEN key || ';' || kind || CASE WHEN line_no % 5 <> 0 THEN ';' || size ELSE '' END
    WHEN 2 THEN rpad(key, 40, ' ') || rpad(replace(kind, ' ', '_'), 40, ' ') || size WHEN 3 THEN CASE WHEN line_no IN (0, 19) THEN '+---+---+---+' ELSE '+ ' || key || ' + ' || kind || ' + ' || size || ' +' END
    WHEN 4 THEN CASE WHEN line_no = 1 THEN '|---|---|---|' ELSE '| ' || key || ' | ' || kind || ' | ' || size || ' |' END ELSE 'some words and ' || size END AS line FROM parts),
"""
PIECES_SQL = """pieces_{0} AS (SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY line_no) - 1 AS INTEGER) AS row, CAST(count(*) OVER (PARTITION BY block_id) AS INTEGER) AS n_rows, CAST(max(len(p)) OVER (PARTITION BY block_id) AS INTEGER) AS n_cols, p FROM {1}),
{0}_cells AS (SELECT block_id, row, CAST(i - 1 AS INTEGER) AS col, p[i] AS text, row = 0 AS is_header, n_rows, n_cols FROM pieces_{0}, unnest(range(1, len(p) + 1)) t(i))"""
DETECT = (
    PART_LINES
    + own_sql("t", "lines")
    + """,
starts AS (SELECT DISTINCT block_id, CAST(i - 1 AS INTEGER) AS start FROM own_t, unnest(range(1, length(line) + 1)) t(i) WHERE substr(line, i, 1) <> ' ' AND (i = 1 OR substr(line, i - 1, 1) = ' ')),
gaps AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY block_id ORDER BY start) >= 10 THEN 1 ELSE 0 END AS g FROM starts),
clusters AS (SELECT *, sum(g) OVER (PARTITION BY block_id ORDER BY start) AS cluster FROM gaps),
columns_ AS (SELECT block_id, CAST(cluster AS BIGINT) AS cluster, min(start) AS start FROM clusters GROUP BY block_id, cluster),
cuts AS (SELECT *, CAST(row_number() OVER (PARTITION BY block_id ORDER BY start) - 1 AS INTEGER) AS col, lead(start) OVER (PARTITION BY block_id ORDER BY start) AS stop, CAST(count(*) OVER (PARTITION BY block_id) AS INTEGER) AS n_cols FROM columns_),
spaced AS (SELECT block_id, row, col, trim(substr(line, start + 1, coalesce(stop, length(line)) - start)) AS text, row = 0 AS is_header, n_rows, n_cols FROM own_t JOIN cuts USING (block_id) WHERE n_cols >= 2),
rules AS (SELECT *, count(*) FILTER (regexp_matches(trim(line), '^[+|-]+$')) OVER (PARTITION BY block_id) AS n_rules FROM lines),
grid_rows AS (SELECT block_id, line_no, list_filter([trim(x) FOR x IN string_split(trim(line), '+')], lambda x: x <> '') AS p FROM rules WHERE n_rules >= 2 AND NOT regexp_matches(trim(line), '^[+|-]+$')),
"""
    + PIECES_SQL.format("grid", "grid_rows")
    + """,
pipes AS (SELECT *, count(*) FILTER (contains(line, '|')) OVER (PARTITION BY block_id) AS n_pipes FROM lines),
pipe_rows AS (SELECT block_id, line_no, [trim(x) FOR x IN string_split(regexp_replace(regexp_replace(trim(line), '^[|]', ''), '[|]$', ''), '|')] AS p FROM pipes WHERE n_pipes >= 3 AND contains(line, '|') AND NOT regexp_matches(line, '^[ |-]+$')),
"""
    + PIECES_SQL.format("pipe", "pipe_rows")
    + """,
all_cells AS (SELECT 0 AS o, * FROM delimited_t UNION ALL SELECT 1, * FROM (SELECT * FROM spaced WHERE text <> '') UNION ALL SELECT 2, * FROM grid_cells),
first_cells AS (SELECT * FROM (SELECT *, min(o) OVER (PARTITION BY block_id) AS f FROM all_cells) WHERE o = f AND n_rows >= 2),
valid AS (SELECT block_id, max(n_rows) AS n_rows, max(n_cols) AS n_cols, count(*) AS n_cells FROM first_cells GROUP BY block_id HAVING max(n_rows) >= 2 AND max(n_cols) >= 2 AND count(*) >= 4 AND max(n_rows) <= 50 AND max(n_cols) <= 20),
table_cells AS (SELECT block_id, row, col, text, is_header, n_rows, n_cols FROM first_cells WHERE block_id IN (SELECT block_id FROM valid)),
"""
)


def matrix_sql(cells: str, name: str) -> str:
    """Matrix, widths and rendering of a CTE of cells."""
    return f"""places_{name} AS (SELECT block_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT block_id, max(n_rows) AS nr, max(n_cols) AS nc FROM {cells} GROUP BY block_id), range(0, nr) a(r), range(0, nc) b(c)),
matrix_{name} AS (SELECT p.block_id, p.row, p.col, coalesce(x.text, '') AS text FROM places_{name} p LEFT JOIN {cells} x ON p.block_id = x.block_id AND p.row = x.row AND p.col = x.col),
widths_{name} AS (SELECT block_id, col, CAST(greatest(10, least(50, max(length(text)))) AS INTEGER) AS width FROM matrix_{name} GROUP BY block_id, col),
cut_{name} AS (SELECT block_id, row, col, w, CASE WHEN length(text) > w THEN left(text, w - 3) || '...' ELSE text END AS t FROM (SELECT block_id, row, col, text, width AS w FROM matrix_{name} JOIN widths_{name} USING (block_id, col))),
gap_{name} AS (SELECT *, w - length(t) AS g, (w - length(t)) // 2 + ((w - length(t)) & w & 1) AS l FROM cut_{name}),
drawn_{name} AS (SELECT block_id, row, col, w, ' ' || CASE WHEN row = 0 THEN repeat(' ', l) || t || repeat(' ', g - l) WHEN regexp_matches(t, '^[0-9]+[.]?[0-9]*$|^[.][0-9]+$') THEN repeat(' ', g) || t
  WHEN length(t) < w // 2 AND NOT contains(t, ' ') THEN repeat(' ', l) || t || repeat(' ', g - l) ELSE t || repeat(' ', g) END || ' ' AS cell FROM gap_{name}),
joined_{name} AS (SELECT block_id, row, '|' || string_agg(cell, '|' ORDER BY col) || '|' || CASE WHEN row = 0 THEN chr(10) || '|' || string_agg(repeat('-', w + 2), '|' ORDER BY col) || '|' ELSE '' END AS line FROM drawn_{name} GROUP BY block_id, row),
rendered_{name} AS (SELECT block_id, string_agg(line, chr(10) ORDER BY row) AS markdown FROM joined_{name} GROUP BY block_id)
"""


def over_tables(name: str, build, oracle: str, rendered: str | None = None) -> None:
    """A query over the lines of all parts; ``rendered`` names the cells whose matrix the oracle needs."""
    QUERIES[name] = lambda spark, sf_dir: build(table_lines(spark, sf_dir))
    ORACLES[name] = DETECT + (matrix_sql(rendered, "m") if rendered else "done AS (SELECT 1)\n") + oracle


CELLS = ("block_id", "row", "col", "text", "is_header", "n_rows", "n_cols")
TEXTS = "texts AS (SELECT block_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY block_id)"


def as_texts(lines: DataFrame) -> DataFrame:
    return corpus.join_lines(lines, "block_id").withColumnRenamed("block_id", "doc_id")


over_tables("t01_table_cells", lambda x: tables.table_cells(x).select(*CELLS), "SELECT * FROM table_cells")
over_tables("t02_delimiter", lambda x: tables.detect_delimiter(x).select("block_id", "delimiter", F.col("per_line").cast("long")), "SELECT * FROM chosen_t")
over_tables("t03_delimited_cells", lambda x: tables.delimited_cells(x).select(*CELLS), "SELECT * FROM delimited_t")
over_tables("t04_word_columns", lambda x: tables.word_columns(x).select("block_id", "start"), "SELECT block_id, start FROM columns_")
over_tables("t05_spaced_cells", lambda x: tables.spaced_cells(x).select(*CELLS), "SELECT * FROM spaced WHERE text <> ''")
over_tables("t06_grid_cells", lambda x: tables.grid_cells(x).select(*CELLS), "SELECT * FROM grid_cells")
over_tables("t07_markdown_cells", lambda x: tables.markdown_cells(x).select(*CELLS), "SELECT * FROM pipe_cells")
over_tables("t08_vision_cells", lambda x: tables.vision_cells(x).select(*CELLS), "SELECT * FROM pipe_cells")
over_tables("t09_valid_tables", lambda x: tables.valid_tables(tables.table_cells(x)), "SELECT * FROM valid")
over_tables("t11_header_score", lambda x: tables.header_score(tables.markdown_cells(x).withColumn("is_header", F.lit(False))), "SELECT block_id, sum(CASE WHEN " + " OR ".join(f"contains(upper(text), '{w}')" for w in tables.HEADER_WORDS) + " THEN 1 ELSE 0 END + CASE WHEN length(text) < 50 THEN 0.5 ELSE 0 END) / count(*) > 0.5 AS is_header FROM pipe_cells WHERE row = 0 GROUP BY block_id")
over_tables("t12_table_matrix", lambda x: tables.matrix_rows(tables.tables_of(x, tables.detected())), "SELECT * FROM matrix_m", "table_cells")
over_tables("t13_column_widths", lambda x: tables.column_widths(tables.tables_of(x, tables.detected())), "SELECT * FROM widths_m", "table_cells")
over_tables("t14_render_tables", lambda x: tables.render_tables(tables.tables_of(x, tables.markdown)), "SELECT * FROM rendered_m", "pipe_cells")
over_tables("t15_format_elements", lambda x: tables.format_elements(as_texts(x)), f", {TEXTS} SELECT block_id AS doc_id, coalesce(markdown, chr(10) || text || chr(10)) AS text FROM texts LEFT JOIN rendered_m USING (block_id)", "table_cells")


def framed(lines: DataFrame) -> DataFrame:
    """Each block between a line before it and one after."""
    t = as_texts(lines)
    return t.select("doc_id", F.concat(F.lit("before it\n"), "text", F.lit("\nafter it")).alias("text"))


over_tables("t16_format_tables", lambda x: tables.format_tables(framed(x)), """, last_lines AS (SELECT block_id, line FROM lines WHERE line_no = 19),
texts AS (SELECT block_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY block_id)
SELECT block_id AS doc_id, 'before it' || chr(10) || coalesce(markdown || coalesce(chr(10) || last_lines.line, ''), text) || chr(10) || 'after it' AS text FROM texts LEFT JOIN rendered_m USING (block_id) LEFT JOIN last_lines USING (block_id)""", "first_pipes")  # fmt: skip
ORACLES["t16_format_tables"] = ORACLES["t16_format_tables"].replace("places_m AS", """first_rows AS (SELECT * FROM pipe_rows WHERE line_no < 19),
pieces_first AS (SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY line_no) - 1 AS INTEGER) AS row, CAST(count(*) OVER (PARTITION BY block_id) AS INTEGER) AS n_rows, CAST(max(len(p)) OVER (PARTITION BY block_id) AS INTEGER) AS n_cols, p FROM first_rows WHERE block_id IN (SELECT block_id FROM lines WHERE contains(line, '|') AND line_no < 19 GROUP BY 1 HAVING count(*) >= 3)),
first_pipes AS (SELECT block_id, row, CAST(i - 1 AS INTEGER) AS col, p[i] AS text, row = 0 AS is_header, n_rows, n_cols FROM pieces_first, unnest(range(1, len(p) + 1)) t(i)),
places_m AS""")


def spanned(lines: DataFrame) -> DataFrame:
    """Cells of comma blocks that reach two rows down and two columns across in turn."""
    c = tables.delimited_cells(lines)
    return c.withColumns({"cell_no": F.col("row") * 3 + F.col("col"), "rowspan": 1 + F.col("row") % 2, "colspan": 1 + F.col("col") % 2})


SPANNED = "spanned AS (SELECT *, row * 3 + col AS cell_no, 1 + row % 2 AS rowspan, 1 + col % 2 AS colspan FROM delimited_t)"
over_tables("t10_cell_at", lambda x: tables.cell_at(spanned(x), x.select("block_id", F.col("line_no").alias("at_row")).withColumn("at_col", F.col("at_row") % 3)), f", {SPANNED}, asked AS (SELECT block_id, line_no AS at_row, line_no % 3 AS at_col FROM lines) SELECT a.block_id, at_row, at_col, arg_min(s.text, cell_no) AS text FROM asked a LEFT JOIN spanned s ON a.block_id = s.block_id AND at_row BETWEEN row AND row + rowspan - 1 AND at_col BETWEEN col AND col + colspan - 1 GROUP BY a.block_id, at_row, at_col")
over_tables("j03_span_matrix", lambda x: tables.matrix_rows(tables.overlaid(spanned(x))), f", {SPANNED} SELECT p.block_id, p.row, p.col, coalesce(arg_max(s.text, cell_no), '') AS text FROM places_m p LEFT JOIN spanned s ON p.block_id = s.block_id AND p.row BETWEEN s.row AND s.row + rowspan - 1 AND p.col BETWEEN s.col AND s.col + colspan - 1 GROUP BY p.block_id, p.row, p.col", "delimited_t")

# code -------------------------------------------------------------------

SNIPPETS = [
    ["def f{k}(x):", "    import math", "    print(len(x))  # {k}"],
    ["const f{k} = (x) => {", "  console.log(x); // out", "  return x;", "}; // done"],
    ["public class A{k} {", "  @Override", "  public void run{k}(int x) throws Ex {", "    String s;", "  }", "}"],
    ["#include <stdio.h>", "int main(void) {", "  char *p{k};", "  run(p{k});", "}"],
    ["namespace N{k} {", "  using System;", "  internal string P{k} { get; set; }", "  var q = from x in y where x select x;", "}"],
    ["<?php", "$a{k} = array(1, 2);", "foreach ($a{k} as $v) { $b = $v; }", "?>"],
    ["module M{k}", "def m(x);", "  begin; x = :sym{k}; y = :b; rescue; end;", "end;", "puts(\"#{x}\");"],
    ["package main;", "func f{k}(a int) error {", "  defer close(a);", "  var m map[string]bool;", "}"],
    ["pub fn f{k}(x: &'a str) -> Option {", "  let mut y = Some(x);", "  println!(\"{}\", y);", "  match y { None => Err(1) }", "}"],
    ["SELECT a, SUM(b),", "FROM t{k},", "WHERE a > 1 AND b LIKE c GROUP BY a;"],
    ["#!/bin/bash", "if [ -f x ]; then", "echo $v{k} | grep a > b;", "fi;"],
    ["{\"a{k}\": [1, 2],", "\"b\": {\"c\": \"d\"},", "\"e\": [\"f\", \"g\"]}"],
    ["name: v{k}", "list: \"a\"", "- one", "- two # end"],
    ["quiet words stay here", "and more words", "to the number {k}"],
]


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet for each order between lines of prose; its language turns with the key."""
    k = F.col("o_orderkey")
    body = F.lit(None).cast("array<string>")
    for turn, snippet in enumerate(SNIPPETS):
        filled = F.array(*[F.replace(F.lit(x), F.lit("{k}"), k.cast("string")) for x in snippet])
        body = F.when(k % len(SNIPPETS) == turn, filled).otherwise(body)
    lines = F.concat(F.array(F.lit("A plain text of words"), F.lit("")), body, F.array(F.lit(""), F.lit("The last words")))
    return corpus.table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))


IS_CODE = f"({D.strip('line')} <> '' AND ({' OR '.join(D.has('line', p) for p in code.LINE_PATTERNS)} OR {D.has('line', '[(){}\\[\\]<>]')} OR {D.holds('line', *code.OPERATORS)} OR {D.has(D.strip('line'), '[;,]\\z')}))"
CODE_LINES = f"""WITH lines AS (
  SELECT o_orderkey AS doc_id, CAST(unnest(range(0, len(body) + 4)) AS INTEGER) AS line_no, unnest(list_concat(['A plain text of words', ''], body, ['', 'The last words'])) AS line
  FROM (SELECT o_orderkey, [replace(x, '{{k}}', CAST(o_orderkey AS VARCHAR)) FOR x IN CASE o_orderkey % {len(SNIPPETS)} {' '.join(f"WHEN {k} THEN [{', '.join(D.q(x) for x in s)}]" for k, s in enumerate(SNIPPETS))} END] AS body FROM orders)),
"""
REGIONS = f"""marked AS (SELECT *, {IS_CODE} AS is_code, {D.strip('line')} <> '' AS filled FROM lines),
islands AS (SELECT *, sum(CASE WHEN filled AND NOT is_code THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM marked),
ends AS (SELECT *, min(CASE WHEN is_code THEN line_no END) OVER (PARTITION BY doc_id, island) AS start_line, max(CASE WHEN is_code THEN line_no END) OVER (PARTITION BY doc_id, island) AS end_line FROM islands WHERE is_code OR NOT filled),
regions AS (SELECT doc_id, start_line, end_line, string_agg(line, chr(10) ORDER BY line_no) AS code FROM ends WHERE line_no BETWEEN start_line AND end_line AND end_line - start_line + 1 >= 3 GROUP BY doc_id, start_line, end_line),
"""


def _score(rules: list[tuple[str, float]]) -> str:
    hits = " + ".join(f"{D.count('code', p)} * {w}::DOUBLE" for p, w in rules)
    return f"round(({hits}) / greatest(len(list_filter(regexp_split_to_array(code, '\\s+'), lambda w: w <> '')), 1), 6)"


_CASES = " ".join(f"WHEN top = {_score(rules)} THEN '{name}'" for name, rules in code.LANGUAGES.items())
BLOCKS = REGIONS + f"""tops AS (SELECT *, greatest({', '.join(_score(r) for r in code.LANGUAGES.values())}) AS top FROM regions),
blocks AS (SELECT doc_id, start_line, end_line, code, CASE WHEN top < 0.6 THEN 'unknown' {_CASES} END AS language, CASE WHEN top < 0.6 THEN 0 ELSE top END AS confidence FROM tops)
"""


def _fence(numbered: bool, limit: int) -> str:
    shown = "[lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || ' | ' || string_split(code, chr(10))[i] FOR i IN range(1, len(string_split(code, chr(10))) + 1)]" if numbered else "string_split(code, chr(10))"
    body = f"array_to_string({shown}, chr(10))"
    cut = f"CASE WHEN length({body}) > {limit} THEN array_to_string(list_append({shown}[1:50], '... (truncated)'), chr(10)) ELSE {body} END"
    return f"CASE WHEN confidence < 0.6 THEN array_to_string([chr(96) || x || chr(96) FOR x IN string_split(code, chr(10))], chr(10)) ELSE repeat(chr(96), 3) || language || chr(10) || {cut} || chr(10) || repeat(chr(96), 3) END"


def _rewritten(numbered: bool = False, limit: int = 1000) -> str:
    return BLOCKS + f", fences AS (SELECT doc_id, start_line, end_line, {_fence(numbered, limit)} AS block FROM blocks) SELECT l.doc_id, string_agg(coalesce(block, line), chr(10) ORDER BY line_no) AS text FROM lines l LEFT JOIN fences f ON l.doc_id = f.doc_id AND line_no BETWEEN start_line AND end_line WHERE start_line IS NULL OR line_no = start_line GROUP BY l.doc_id"


QUERIES["c01_code_regions"] = lambda spark, sf_dir: code.code_regions(code_lines(spark, sf_dir))
ORACLES["c01_code_regions"] = CODE_LINES + REGIONS + "done AS (SELECT 1) SELECT * FROM regions"
QUERIES["c04_code_languages"] = lambda spark, sf_dir: code.code_blocks(code_lines(spark, sf_dir)).select("doc_id", "start_line", "language", "confidence")
ORACLES["c04_code_languages"] = CODE_LINES + BLOCKS + "SELECT doc_id, start_line, language, CAST(confidence AS DOUBLE) AS confidence FROM blocks"
QUERIES["c05_numbered_code"] = lambda spark, sf_dir: corpus.join_lines(code.rewrite_code(code_lines(spark, sf_dir), numbered=True))
ORACLES["c05_numbered_code"] = CODE_LINES + _rewritten(True)
QUERIES["c06_rewrite_code"] = lambda spark, sf_dir: corpus.join_lines(code.rewrite_code(code_lines(spark, sf_dir)))
ORACLES["c06_rewrite_code"] = CODE_LINES + _rewritten()
QUERIES["c07_format_code"] = lambda spark, sf_dir: code.format_code(corpus.table(spark, sf_dir, "documents"))
ORACLES["c07_format_code"] = "WITH lines AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),\n" + _rewritten()

# mathematics ------------------------------------------------------------


def math_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence with a fraction, a power, an index, an inline formula and an equation for each order."""
    c = lambda n: F.col(n).cast("string")
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" is $q/2$ so y = "), c("o_custkey"), F.lit("*2"))).otherwise(F.concat(F.lit(" is \\(q_1\\) ≤ ∫ z/w so y = "), c("o_custkey")))
    text = F.concat(F.lit("ratio "), c("o_orderkey"), F.lit("/"), c("o_custkey"), F.lit(" and x^{"), c("o_orderkey"), F.lit("} with a_"), c("o_custkey"), mixed)
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def _spans_sql(source: str) -> str:
    """All spans of source(doc_id, text), each rule by its pattern: marks cut the text, and what stands before a match gives its place."""
    rules = []
    for k, (kind, pattern, _, outside) in enumerate(mathx.SPANS):
        group = lambda n, p=pattern: f"regexp_extract(match, {D.rx(p)}, {n})"
        bare = f"trim({group(2)}, '{{}}')"
        tex = {"fraction": f"'\\frac{{' || {group(1)} || '}}{{' || {group(2)} || '}}'", "superscript": f"{group(1)} || '^{{' || {bare} || '}}'", "subscript": f"{group(1)} || '_{{' || {bare} || '}}'", "integral": "replace(match, '∫', '\\int')"}.get(kind, "match")
        inside = "dollars(lead) % 2 = 1 AND dollars(lead) < dollars(text)" if outside else "false"
        rules.append(
            f"SELECT doc_id, {k} AS rule, length(lead) AS begin, length(lead) + length(match) AS \"end\", match, '{kind}' AS math_type, {tex} AS latex\n"
            f"FROM (SELECT doc_id, text, replace(array_to_string(p[1:i - 1], ''), chr(2), '') AS lead, split_part(p[i], chr(2), 1) AS match FROM (SELECT doc_id, text, string_split(regexp_replace(text, {D.rx('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM {source}), unnest(range(2, len(p) + 1)) t(i)) WHERE NOT ({inside})"
        )
    found = " UNION ALL ".join(rules).replace("dollars(lead)", "(length(lead) - length(replace(lead, '$', '')))").replace("dollars(text)", "(length(text) - length(replace(text, '$', '')))")
    return f"""found AS ({found}),
reached AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY begin, rule, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
spans AS (SELECT doc_id, CAST(begin AS INTEGER) AS begin, CAST("end" AS INTEGER) AS "end", match, math_type, latex FROM reached WHERE reach IS NULL OR reach < "end")
"""


MATH_TEXT = """WITH source AS (SELECT o_orderkey AS doc_id, 'ratio ' || o_orderkey || '/' || o_custkey || ' and x^{' || o_orderkey || '} with a_' || o_custkey ||
  CASE WHEN o_orderkey % 3 = 0 THEN ' is $q/2$ so y = ' || o_custkey || '*2' ELSE ' is \\(q_1\\) ≤ ∫ z/w so y = ' || o_custkey END AS text FROM orders),
"""
DOCUMENT_TEXT = "WITH source AS (SELECT doc_id, text FROM documents),\n"
SPLICED = """SELECT doc_id, list_reduce(list_prepend({'t': text, 'b': 0, 'e': 0, 'l': ''}, cuts), lambda s, x: {'t': left(s.t, x.b) || x.l || substr(s.t, x.e + 1), 'b': 0, 'e': 0, 'l': ''}).t AS text
FROM (SELECT s.doc_id, any_value(s.text) AS text, coalesce(list({'t': '', 'b': begin, 'e': "end", 'l': latex} ORDER BY begin DESC, "end" DESC, latex DESC) FILTER (match IS NOT NULL), []) AS cuts FROM source s LEFT JOIN spans USING (doc_id) GROUP BY s.doc_id)"""
SPAN_COLUMNS = ("doc_id", "begin", "end", "match", "math_type", "latex")
QUERIES["m05_math_spans"] = lambda spark, sf_dir: mathx.recognised(math_text(spark, sf_dir)).select(*SPAN_COLUMNS)
ORACLES["m05_math_spans"] = MATH_TEXT + _spans_sql("source") + "SELECT * FROM spans"
QUERIES["m05b_document_spans"] = lambda spark, sf_dir: mathx.recognised(corpus.table(spark, sf_dir, "documents")).select(*SPAN_COLUMNS)
ORACLES["m05b_document_spans"] = DOCUMENT_TEXT + _spans_sql("source") + "SELECT * FROM spans"
QUERIES["m04_outermost"] = lambda spark, sf_dir: mathx.outermost(mathx.math_spans(math_text(spark, sf_dir))).select(*SPAN_COLUMNS)
ORACLES["m04_outermost"] = ORACLES["m05_math_spans"]
QUERIES["m07_splice"] = lambda spark, sf_dir: mathx.format_math(math_text(spark, sf_dir))
ORACLES["m07_splice"] = MATH_TEXT + _spans_sql("source") + SPLICED
QUERIES["m07b_format_documents"] = lambda spark, sf_dir: mathx.format_math(corpus.table(spark, sf_dir, "documents"))
ORACLES["m07b_format_documents"] = DOCUMENT_TEXT + _spans_sql("source") + SPLICED
