"""One query for each operator, and its oracle in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.patterns import strip as col_strip
from ..operators import elements, inference, metrics, outline
from ..sources import corpus
from ..streaming import jobs as job_stream
from . import sql as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def per_document(name: str, column: str, build: Callable, expression: str) -> None:
    """A column over the text of every document."""
    QUERIES[name] = lambda spark, sf_dir: corpus.table(spark, sf_dir, "documents").select("doc_id", build(F.col("text")).alias(column))
    ORACLES[name] = f"SELECT doc_id, {expression} AS {column} FROM documents"


T = "text"
WORDS = f"len(list_filter(regexp_split_to_array({D.strip(T)}, '[ \\t\\n]+'), lambda w: w <> ''))"
HEADING = f"(length(text) < 100 AND ({D.has(T, '\\A#{1,6}<s>+')} OR ({WORDS} < 10 AND {D.upper(T)}) OR {D.has(T, '\\A[A-Z][a-z\\t-\\r \\p{Z}]+:\\z')}))"
ITEM = D.has(T, "\\A<s>*([-*+•]|\\d+[.)])<s>+")
PIPES = "length(text) - length(replace(text, '|', '')) >= 3"
CLASS = f"CASE WHEN {HEADING} OR {ITEM} THEN 'TEXT' WHEN {PIPES} THEN 'TABLE' ELSE 'TEXT' END"
CONFIDENCE = f"CASE WHEN {D.strip(T)} = '' THEN 0::DOUBLE ELSE round({D.clamp(f'0.8::DOUBLE - {D.one(f'{D.upper(T)} AND length(text) > 50', 0.1)} - {D.one('length(text) < 10', 0.2)} - {D.one(D.has(T, '[l1iI]'), 0.1)} - {D.one(D.has(T, '[0oO]'), 0.1)} - {D.one(D.has(T, '[rn]'), 0.1)}')}, 4) END"
MATHS = " + ".join(D.count(T, p, "ms") for p in C.MATH_PATTERNS)
CODES = " + ".join([*[f"{D.has(T, p, 'mi')}::INT" for p in C.CODE_PATTERNS], f"{D.has(T, '^<s>*[}>\\])]<s>*$', 'm')}::INT", f"{D.holds(T, 'for (', 'while (', 'if (')}::INT"])
ELEMENT = f"CASE WHEN ({CLASS}) = 'TEXT' AND ({MATHS}) > 2 THEN 'MATHEMATICAL' WHEN ({CLASS}) = 'TEXT' AND ({CODES}) >= 2 THEN 'CODE' ELSE ({CLASS}) END"


def _response(endings: bool) -> str:
    parts = [D.one(D.holds(T, "##"), 0.1), D.one(D.holds(T, "|"), 0.15), D.one(D.holds(T, "```"), 0.1), D.one(f"{D.count(T, '\\$')} >= 2", 0.1), D.one("length(text) > 100", 0.1)]
    total = "0.5::DOUBLE + " + " + ".join(parts) + f" - {D.one('length(text) < 20', 0.2)}" + (f" + {D.one(D.has(T, '[.!?]\\z'), 0.05)}" if endings else "")
    return f"CASE WHEN {D.strip(T)} = '' THEN 0::DOUBLE ELSE round({D.clamp(total)}, 4) END"


def _clean() -> str:
    x = D.strip(D.swap(T, "<s>+", " "))
    for old, new in C.OCR_FIXES:
        x = f"replace({x}, {D.q(old)}, {D.q(new)})"
    return x


def _ocr_class(engine: bool) -> str:
    cells = D.has(T, "(\\t|<s>{3,}|,)<s>*<w>+")
    many = f"{D.count(T, ' ')} > 3" if engine else f"{D.count(T, '\\n')} > 1"
    maths = " OR ".join(D.has(T, p) for p in C.OCR_MATH)
    return f"CASE WHEN {cells} AND {many} THEN 'table' WHEN {D.holds(T, *C.OCR_CODE, *(['while '] if engine else []))} THEN 'code' WHEN {maths} THEN 'math' ELSE 'text' END"


def _tidy() -> str:
    x = D.swap(T, "\\n{3,}", "\n\n")
    x = D.swap(x, "\\n(#+)<s>+", "\n\\1 ")
    x = D.swap(x, "[\\t\\x0b\\x0c\\r \\x1c-\\x1f\\x85\\p{Z}]+$", "", "m")
    x = D.strip(x)
    return f"(SELECT CASE WHEN starts_with(t, '#') THEN t ELSE {D.q('# Document' + chr(10) + chr(10))} || t END || chr(10) FROM (SELECT {x} AS t))"


def _latex_problems() -> str:
    pairs = [("braces", "\\{", "\\}"), ("brackets", "\\\\\\[", "\\\\\\]"), ("parens", "\\\\\\(", "\\\\\\)")]
    parts = [f"CASE WHEN {D.count(T, a)} <> {D.count(T, b)} THEN '{n}' END" for n, a, b in pairs]
    parts += [f"CASE WHEN {D.count(T, '\\$')} % 2 = 1 THEN 'dollars' END", f"CASE WHEN {D.has(T, '\\\\\\\\\\z')} THEN 'line break' END"]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _symbols() -> str:
    x = T
    for symbol, name in C.SYMBOLS:
        x = f"replace({x}, {D.q(symbol)}, {D.q(name)})"
    return f"(SELECT CASE WHEN starts_with(t, '$') OR starts_with(t, {D.q('\\')}) THEN t ELSE '$' || t || '$' END FROM (SELECT {x} AS t))"


def _elements(lists: bool) -> str:
    tests = [("headings", D.holds(T, "##")), ("tables", D.holds(T, "\n|")), ("code", D.holds(T, "```")), ("math", f"{D.count(T, '\\$')} >= 2"), ("formatting", D.holds(T, "*"))]
    tests += [("lists", D.holds(T, "\n-"))] if lists else []
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in tests) + "], lambda x: x IS NOT NULL)"


per_document("p01_text_class", "content_type", C.text_class, CLASS)
per_document("p02_text_confidence", "confidence", C.text_confidence, CONFIDENCE)
per_document("p04_math_count", "n_math", lambda t: C.math_count(t).cast("long"), f"CAST({MATHS} AS BIGINT)")
per_document("p05_code_score", "score", C.code_score, f"CAST({CODES} AS INTEGER)")
per_document("p05b_element_class", "content_type", C.element_class, ELEMENT)
per_document("p09_response_confidence", "confidence", C.response_confidence, _response(True))
per_document("p10_backend_confidence", "confidence", lambda t: C.response_confidence(t, False), _response(False))
per_document("p11_response_elements", "found", lambda t: F.array_join(C.response_elements(t), ","), f"array_to_string({_elements(True)}, ',')")
per_document("p17_ocr_clean", "cleaned", C.ocr_clean, _clean())
per_document("p18_ocr_class", "content_type", C.ocr_class, _ocr_class(False))
per_document("p19_engine_class", "content_type", lambda t: C.ocr_class(t, True), _ocr_class(True))
per_document("p24_markdown_tidy", "markdown", C.markdown_tidy, _tidy())
per_document("p25_output_problem", "problem", C.output_problem, f"CASE WHEN length({D.strip(T)}) = 0 THEN 'empty' WHEN length({D.strip(T)}) < 10 THEN 'short' WHEN length({D.strip(T)}) > 100000 THEN 'long' END")
per_document("p26_has_markdown", "structured", C.has_markdown, D.holds(T, *C.MARKDOWN))
per_document("p30_latex_problems", "problems", lambda t: F.array_join(C.latex_problems(t), ","), f"array_to_string({_latex_problems()}, ',')")
per_document("p08_extraction_quality", "quality", lambda t: C.extraction_quality(t, col_strip(t)), f"(SELECT round({D.clamp(f'(least(length(greatest(a, b)) / 1000.0::DOUBLE, 1) + CASE WHEN length(a) > 0 AND length(b) > 0 THEN 1 - abs(length(a) - length(b)) / greatest(length(a), length(b))::DOUBLE ELSE 0.5::DOUBLE END - {D.count('a || b', '[\\x00\\x0c\\x14]')} / 100.0::DOUBLE) / 2')}, 6) FROM (SELECT text AS a, {D.strip(T)} AS b))")


# elements ---------------------------------------------------------------

E = """WITH elements AS (
  SELECT l_orderkey AS doc_id, CAST(l_suppkey % 5 AS INTEGER) AS page_number, l_linenumber AS elem_no,
         CASE WHEN l_returnflag = 'A' THEN 'TABLE' WHEN l_returnflag = 'N' THEN 'TEXT' WHEN l_linestatus = 'F' THEN 'CODE' ELSE 'MATHEMATICAL' END AS content_type,
         round(greatest(0::DOUBLE, least(1::DOUBLE, 1 - l_discount * 5)), 4) AS confidence, 8 + l_quantity / 5 AS font_size,
         CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_partkey % 50 AS DOUBLE) END AS x0, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_suppkey % 40 AS DOUBLE) END AS y0
  FROM lineitem)
"""
KINDS = ", ".join(f"count(*) FILTER (content_type = '{k}') AS n_{k.lower()}" for k in ("TEXT", "TABLE", "MATHEMATICAL", "CODE"))


TYPE = f"CASE WHEN n_mathematical > n_elements * 0.1::DOUBLE THEN '{elements.TYPES[0]}' WHEN n_code > n_elements * 0.1::DOUBLE THEN '{elements.TYPES[1]}' WHEN n_table > n_elements * 0.2::DOUBLE THEN '{elements.TYPES[2]}' ELSE '{elements.TYPES[3]}' END"


def over_elements(name: str, build: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus.elements(spark, sf_dir))
    ORACLES[name] = E + oracle


over_elements("a02_type_counts", lambda e: elements.type_counts(e, "doc_id"), f"SELECT doc_id, count(*) AS n_elements, {KINDS} FROM elements GROUP BY doc_id")
over_elements("a02b_type_rollup", lambda e: e.rollup("page_number", "content_type").agg(F.count("*").alias("n")), "SELECT page_number, content_type, count(*) AS n FROM elements GROUP BY ROLLUP (page_number, content_type)")
over_elements("a04_complex_layout", elements.complex_layout, f"SELECT doc_id, count(*) > 5 OR max(n_elements) > 10 OR sum(n_table) > 0 OR sum(n_mathematical) > 0 AS is_complex FROM (SELECT doc_id, page_number, count(*) AS n_elements, {KINDS} FROM elements GROUP BY ALL) GROUP BY doc_id")
over_elements("a06_font_statistics", lambda e: e.groupBy("doc_id").agg(F.round(F.avg("font_size"), 6).alias("avg_font"), F.max("font_size").alias("max_font"), F.min("font_size").alias("min_font"), F.count("*").alias("n")), "SELECT doc_id, round(avg(font_size), 6) AS avg_font, max(font_size) AS max_font, min(font_size) AS min_font, count(*) AS n FROM elements GROUP BY doc_id")
WEIGHT = "CASE content_type WHEN 'TEXT' THEN 0.3::DOUBLE WHEN 'TABLE' THEN 0.25::DOUBLE WHEN 'MATHEMATICAL' THEN 0.2::DOUBLE WHEN 'CODE' THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END"
over_elements("a08_page_confidence", elements.page_confidence, f"SELECT doc_id, page_number, round(sum(confidence * {WEIGHT}) / sum({WEIGHT}), 6) AS confidence FROM elements GROUP BY doc_id, page_number")
over_elements("p21_font_headings", lambda e: e.select("doc_id", "elem_no", elements.heading(F.col("content_type"), F.col("font_size")).alias("line")), "SELECT doc_id, elem_no, CASE WHEN font_size > 16 THEN '### ' WHEN font_size > 14 THEN '#### ' ELSE '' END || content_type AS line FROM elements")
over_elements("o01_reading_order", elements.reading_order, "SELECT doc_id, page_number, string_agg(CAST(elem_no AS VARCHAR), ',' ORDER BY x0 IS NULL, y0, x0, elem_no) AS reading_order FROM elements GROUP BY doc_id, page_number")
over_elements("j02_reconcile", lambda e: elements.reconcile(e, e.where("confidence > 0.7")), """, a AS (SELECT doc_id, count(DISTINCT page_number) AS old_pages, count(*) AS old_elements FROM elements GROUP BY doc_id),
b AS (SELECT doc_id, count(DISTINCT page_number) AS new_pages, count(*) AS new_elements FROM elements WHERE confidence > 0.7 GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(old_pages, 0) AS old_pages, coalesce(old_elements, 0) AS old_elements, coalesce(new_pages, 0) AS new_pages, coalesce(new_elements, 0) AS new_elements FROM a FULL JOIN b USING (doc_id))
SELECT *, CASE WHEN old_pages <> new_pages THEN 'pages' ELSE 'elements' END AS problem FROM c WHERE old_pages <> new_pages OR new_elements < 0.5 * old_elements""")
over_elements("j02b_empty_pages", lambda e: e.select("doc_id", "page_number").distinct().join(e.where("confidence > 0.7").select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti"), "SELECT DISTINCT doc_id, page_number FROM elements e WHERE NOT EXISTS (SELECT 1 FROM elements x WHERE x.doc_id = e.doc_id AND x.page_number = e.page_number AND x.confidence > 0.7)")
over_elements("p38_size_classes", lambda e: e.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", C.complexity(F.col("n") * 10).alias("complexity"), C.length_class(F.col("n") * 5).alias("length_class"), C.render_seconds(F.col("n")).alias("seconds"), C.batch_size(F.col("n") * 10).cast("long").alias("batch")), "SELECT doc_id, CASE WHEN n * 10 > 100 THEN 'high' WHEN n * 10 > 20 THEN 'medium' ELSE 'low' END AS complexity, CASE WHEN n * 5 <= 5 THEN 'short' WHEN n * 5 <= 20 THEN 'medium' ELSE 'long' END AS length_class, n * 0.5::DOUBLE AS seconds, CASE WHEN n * 10 <= 10 THEN n * 10 ELSE greatest(1, least(n * 10 // 4, 20)) END AS batch FROM (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id)")

# recognised words -------------------------------------------------------

O = """WITH words AS (
  SELECT l_orderkey AS image_id, l_linenumber AS word_no, p_name AS text, CASE WHEN l_quantity > 45 THEN -1::DOUBLE ELSE l_quantity * 2 END AS conf,
         CAST(l_partkey % 500 AS INTEGER) AS "left", CAST(l_suppkey % 300 AS INTEGER) AS top, 10 + l_linenumber * 5 AS width, 15 AS height, l_linenumber // 4 AS line_num
  FROM lineitem JOIN part ON l_partkey = p_partkey),
kept AS (SELECT * FROM words WHERE conf > 0 AND trim(text) <> '')
"""


@query("a10_words_text", O + """SELECT image_id, string_agg(text, ' ' ORDER BY word_no, text, "left", top) AS text, round(avg(conf) / 100, 6) AS confidence, count(*) AS n_words,
string_agg("left" || ',' || top || ',' || ("left" + width) || ',' || (top + height), ';' ORDER BY word_no, text, "left", top) AS boxes FROM kept GROUP BY image_id""")
def words_text(spark, sf_dir):
    found = elements.words_text(corpus.ocr_words(spark, sf_dir))
    return found.withColumn("boxes", F.array_join(F.transform("boxes", lambda b: F.array_join(b.cast("array<string>"), ",")), ";"))


@query("a11_word_lines", O + """SELECT image_id, line_num, string_agg(text, ' ' ORDER BY "left", word_no, text) AS text, min("left") AS x0, min(top) AS y0, max("left" + width) AS x1, max(top + height) AS y1, round(avg(conf) / 100, 6) AS confidence, count(*) AS n_words FROM kept GROUP BY image_id, line_num""")
def word_lines(spark, sf_dir):
    return elements.word_lines(corpus.ocr_words(spark, sf_dir))


@query("a12_polygon_boxes", "SELECT vec_id, least(e[1], e[3], e[5], e[7]) AS x0, least(e[2], e[4], e[6], e[8]) AS y0, greatest(e[1], e[3], e[5], e[7]) AS x1, greatest(e[2], e[4], e[6], e[8]) AS y1 FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def polygon_boxes(spark, sf_dir):
    return corpus.table(spark, sf_dir, "embeddings").select("vec_id", *elements.polygon_box(F.slice("embedding", 1, 8)))


# operations, jobs, caches -----------------------------------------------

V = """WITH ops AS (SELECT event_type AS op, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, value AS duration, event_id % 7 <> 0 AS success, ts FROM events),
metrics AS (
  SELECT op, calls, total_time, min_time, max_time, errors, round((calls - errors) / calls::DOUBLE, 6) AS success_rate, round(total_time / last_ok, 6) AS avg_time
  FROM (SELECT op, count(*) AS calls, round(coalesce(sum(duration) FILTER (success), 0), 6) AS total_time, min(duration) FILTER (success) AS min_time, max(duration) FILTER (success) AS max_time,
               count(*) FILTER (NOT success) AS errors, max(seq) FILTER (success) AS last_ok FROM ops GROUP BY op))
"""


def over_events(name: str, build: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus.op_events(spark, sf_dir))
    ORACLES[name] = V + oracle


over_events("a15_operation_metrics", metrics.operation_metrics, "SELECT * FROM metrics")
over_events("w04_recent_average", metrics.recent_average, "SELECT op, round(avg(duration), 6) AS recent_avg FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY seq DESC) AS r FROM ops WHERE success) WHERE r <= 10 GROUP BY op")
over_events("x06_sampling_windows", job_stream.windowed, "SELECT time_bucket(INTERVAL '1 hour', ts) AS begin, op, count(*) AS n, round(max(duration), 6) AS peak FROM ops GROUP BY 1, 2")

J = """WITH jobs AS (
  SELECT o_orderkey AS job_id, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'processing' END WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'cancelled' END AS status,
         (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS shipped
  FROM orders)
"""


def over_jobs(name: str, build: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus.jobs(spark, sf_dir))
    ORACLES[name] = J + oracle


over_jobs("a13_status_counts", metrics.status_counts, "SELECT s.status, count(j.job_id) AS n FROM (VALUES " + ", ".join(f"('{s}')" for s in metrics.STATUSES) + ") s(status) LEFT JOIN jobs j USING (status) GROUP BY 1")
over_jobs("a14_job_statistics", metrics.job_statistics, "SELECT count(*) AS total, round(100 * count(*) FILTER (status = 'completed') / count(*)::DOUBLE, 2) AS success_percent, round(avg(epoch(shipped) - epoch(created_at)) FILTER (status = 'completed'), 2) AS mean_seconds, count(*) FILTER (status IN ('processing', 'pending')) AS active FROM jobs")
over_jobs("o03_job_page", lambda j: metrics.job_page(j, "failed", 2, 20), "SELECT job_id, created_at, (SELECT count(*) FROM jobs WHERE status = 'failed') AS total, (SELECT count(*) FROM jobs WHERE status = 'failed') > 40 AS has_next, true AS has_prev FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 20")
over_jobs("o07_retained_jobs", lambda j: j.where(F.col("created_at") >= F.lit("1997-01-01").cast("timestamp")).select("job_id", "status"), "SELECT job_id, status FROM jobs WHERE created_at >= TIMESTAMP '1997-01-01'")

Q = """WITH entries AS (SELECT p_partkey AS entry_id, p_brand AS cache, CAST(p_size * 1000 AS BIGINT) AS size_bytes, p_partkey % 17 AS access_count, CAST(p_partkey * 7919 % 100003 AS DOUBLE) AS last_access,
  sha256(concat_ws('|', p_name, CAST(p_partkey AS VARCHAR))) AS key FROM part)
"""


def over_cache(name: str, build: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus.cache_entries(spark, sf_dir))
    ORACLES[name] = Q + oracle


over_cache("a22_cache_statistics", lambda c: metrics.cache_statistics(c, 5_000_000), "SELECT cache, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(sum(size_bytes) / 1048576.0::DOUBLE, 4) AS megabytes, round(100 * sum(size_bytes) / 5000000.0::DOUBLE, 4) AS percent_used, CAST(sum(access_count) AS BIGINT) AS accesses FROM entries GROUP BY cache")
over_cache("w07_evictions", lambda c: metrics.evictions(c, 200_000, 50_000, bucket=10_000), "SELECT cache, entry_id, size_bytes FROM (SELECT *, sum(size_bytes) OVER (PARTITION BY cache) AS used, coalesce(sum(size_bytes) OVER (PARTITION BY cache ORDER BY last_access, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM entries) WHERE used - freed + 50000 > 200000")
over_cache("w09_oldest_entry", lambda c: c.groupBy("cache").agg(F.min_by("entry_id", F.struct("last_access", "entry_id")).alias("entry_id")), "SELECT cache, arg_min(entry_id, (last_access, entry_id)) AS entry_id FROM entries GROUP BY cache")
over_cache("p43_expired", lambda c: c.where(100_003 - F.col("last_access") > 50_000).select("key"), "SELECT key FROM entries WHERE 100003 - last_access > 50000")
over_cache("j04_store_lookup", lambda c: metrics.lookup(c.select("key"), c.where("entry_id % 3 = 0").select("key", F.col("entry_id").alias("value")), c.where("entry_id % 2 = 0").select("key", F.col("entry_id").alias("value"))), "SELECT key, CASE WHEN entry_id % 3 = 0 OR entry_id % 2 = 0 THEN entry_id END AS value, CASE WHEN entry_id % 3 = 0 THEN 'memory' WHEN entry_id % 2 = 0 THEN 'store' ELSE 'miss' END AS tier FROM entries")

# structured text made of the relational tables ---------------------------

OUTLINE_PARTS = ["DOMAIN I ", " —", "%", "Task ", " Prepare ", "• ", " of ", " ..... ", ": ", "plain "]


def outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's outline."""
    n = corpus.table(spark, sf_dir, "nation").join(corpus.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    k = F.col("n_nationkey").cast("string")
    lines = F.array(
        F.concat(F.lit("DOMAIN I "), "r_name", F.lit(" —"), k, F.lit("%")), F.concat(F.lit("Task "), k, F.lit(" Prepare "), "n_name"), F.concat(F.lit("• "), "n_name", F.lit(" of "), "r_name"),
        F.concat(F.lit("Section about "), "n_name", F.lit(" ..... "), k), F.concat("n_name", F.lit(": "), k, F.lit("%")), F.concat(F.lit("plain "), "n_name"), F.lit(""),
    )
    return n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))


def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' outlines, and the lines of all documents."""
    docs = corpus.explode_lines(corpus.table(spark, sf_dir, "documents"))
    return outline_text(spark, sf_dir).withColumn("doc_id", -1 - F.col("doc_id")).unionByName(docs)


RULES = {k: D.rx(p) for k, _, p in outline.LINE_RULES}


def _key(kind: str, slot: int) -> str:
    group = outline.KEYS[kind][slot]
    if group is None:
        return "''"
    found = f"regexp_extract(s, {RULES[kind]}, {group})"
    return D.strip(f"coalesce(nullif({found}, ''), regexp_extract(s, {RULES[kind]}, 3))" if (kind, slot) == ("domain", 0) else found)


_SLOTS = ", ".join(f"CASE content_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {_key(k, n)}' for k in RULES)} END AS k{n + 1}" for n in range(3))
L = f"""WITH nations AS (
  SELECT -1 - CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i - 1 AS INTEGER) AS line_no,
    ['DOMAIN I ' || r_name || ' —' || n_nationkey || '%', 'Task ' || n_nationkey || ' Prepare ' || n_name, '• ' || n_name || ' of ' || r_name, 'Section about ' || n_name || ' ..... ' || n_nationkey, n_name || ': ' || n_nationkey || '%', 'plain ' || n_name, ''][i] AS line
  FROM nation JOIN region ON n_regionkey = r_regionkey, range(1, 8) t(i)),
raw AS (SELECT * FROM nations UNION ALL SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER), unnest(string_split(text, chr(10))) FROM documents),
kinds AS (SELECT *, CASE {' '.join(f"WHEN s <> '' AND regexp_matches(s, {x}) THEN '{k}'" for k, x in RULES.items())} END AS content_type FROM (SELECT *, {D.strip('line')} AS s FROM raw)),
lines AS (SELECT *, CASE content_type {' '.join(f"WHEN '{k}' THEN {n}" for k, n, _ in outline.LINE_RULES)} END AS level, {_SLOTS} FROM kinds),
shown AS (SELECT *, CASE content_type WHEN 'domain' THEN '## Domain ' || k1 || ': ' || k2 || ' (' || k3 || ')'
  WHEN 'task' THEN CASE WHEN k1 <> '' AND k2 <> '' THEN '### Task ' || k1 || ': ' || k2 WHEN k2 <> '' THEN '### ' || k2 ELSE '### ' || s END
  WHEN 'bullet' THEN '- ' || k1 WHEN 'table_of_contents' THEN '- **' || k1 || '** ... Page ' || k2 WHEN 'percentage_breakdown' THEN '- **' || k1 || '**: ' || k2 ELSE line END AS new FROM lines)
"""
QUERIES["h01_structured_lines"] = lambda spark, sf_dir: outline.structured_lines(outline_lines(spark, sf_dir))
ORACLES["h01_structured_lines"] = L + "SELECT doc_id, line_no, s AS line, content_type, level, k1, k2, k3 FROM lines WHERE content_type IS NOT NULL"
QUERIES["h03_render_outline"] = lambda spark, sf_dir: corpus.join_lines(outline.render_lines(outline_lines(spark, sf_dir)))
ORACLES["h03_render_outline"] = L + "SELECT doc_id, string_agg(new, chr(10) ORDER BY line_no) AS text FROM shown GROUP BY doc_id"
QUERIES["h04_outline_counts"] = lambda spark, sf_dir: outline.structured_lines(outline_lines(spark, sf_dir)).groupBy("content_type").count().withColumnRenamed("count", "n")
ORACLES["h04_outline_counts"] = L + "SELECT content_type, count(*) AS n FROM lines WHERE content_type IS NOT NULL GROUP BY 1"
QUERIES["a01_line_round_trip"] = lambda spark, sf_dir: corpus.join_lines(corpus.explode_lines(corpus.table(spark, sf_dir, "documents")))
ORACLES["a01_line_round_trip"] = "SELECT doc_id, text FROM documents"


QUERIES["x01_job_fold"] = lambda spark, sf_dir: job_stream.fold_jobs(job_stream.job_events(corpus.jobs(spark, sf_dir)))
ORACLES["x01_job_fold"] = J + "SELECT job_id, status, created_at, CASE WHEN status <> 'pending' THEN created_at + INTERVAL 1 MINUTE END AS started_at, CASE WHEN status = 'completed' THEN 1::DOUBLE WHEN status = 'pending' THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS progress FROM jobs"

# requests and replies of page models ---------------------------------------


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each page, its text standing for the image."""
    prompt, image = F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.md5(F.col("html"))
    return corpus.table(spark, sf_dir, "pages").select("page_id", *[inference.request_body(prompt, image, "m", s).alias(s) for s in ("generate", "chat", "plain")])


QUERIES["e02_request_bodies"] = page_requests
ORACLES["e02_request_bodies"] = """WITH p AS (SELECT page_id, 'Page ' || page_id AS prompt, md5(html) AS image FROM pages)
SELECT page_id, '{"model":"m","prompt":"' || prompt || '","images":["' || image || '"],"stream":false}' AS generate,
  '{"model":"m","max_tokens":4096,"messages":[{"role":"user","content":[{"type":"text","text":"' || prompt || '"},{"type":"image_url","image_url":{"url":"data:image/png;base64,' || image || '"}}]}]}' AS chat,
  '{"model":"m","prompt":"' || prompt || '","image":"' || image || '","max_tokens":4096}' AS plain FROM p"""


def echo_client() -> inference.Client:
    """A client without a network that answers with the length of a request."""
    return lambda body: f'{{"response": "{len(body)}", "total_duration": 2000000000}}'


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inference.call_model(page_requests(spark, sf_dir).select("page_id", F.col("plain").alias("body")), echo_client)
    return found.select("page_id", inference.reply_text(F.col("reply")).alias("text"), inference.reply_seconds(F.col("reply")).alias("seconds"), "error", "attempts")


QUERIES["e01_model_replies"] = model_replies
ORACLES["e01_model_replies"] = """SELECT page_id, CAST(length('{"model":"m","prompt":"Page ' || page_id || '","image":"' || coalesce(md5(html), '') || '","max_tokens":4096}') AS VARCHAR) AS text, 2::DOUBLE AS seconds, CAST(NULL AS VARCHAR) AS error, 1 AS attempts FROM pages"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines, each line classified and scored, and the document's character from its lines."""
    lines = corpus.explode_lines(corpus.table(spark, sf_dir, "documents")).where("trim(line) <> ''")
    t = F.col("line")
    found = lines.select("doc_id", C.element_class(t).alias("content_type"), C.text_confidence(t).alias("confidence"))
    return elements.characteristics(found, F.round(F.avg("confidence"), 6).alias("confidence"))


QUERIES["flagship_characteristics"] = flagship
ORACLES["flagship_characteristics"] = f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
elements AS (SELECT doc_id, {ELEMENT} AS content_type, {CONFIDENCE} AS confidence FROM lines WHERE trim(text) <> '')
SELECT *, {TYPE} AS document_type
FROM (SELECT doc_id, count(*) AS n_elements, {KINDS}, round(avg(confidence), 6) AS confidence FROM elements GROUP BY doc_id)"""
