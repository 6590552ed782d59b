"""Queries of sources, sinks and rules of documents, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import errors, rules
from ..functions.patterns import strip
from ..operators import elements, mathx, outline, pages
from ..sinks import named, writers
from ..sources import corpus
from ..streaming import jobs
from . import sql as D
from .queries import CLASS, CONFIDENCE, KINDS, ORACLES, QUERIES, TYPE, WEIGHT, E, O, T, per_document, query

NL = "chr(10)"
col = F.col


def over(table: str, name: str, build, oracle: str) -> None:
    """Columns of a table's rows."""
    QUERIES[name] = lambda spark, sf_dir: corpus.table(spark, sf_dir, table).select(*build())
    ORACLES[name] = oracle


# sources and sinks -------------------------------------------------------

PROBLEM = "CASE WHEN NOT ends_with(lower(url), '.html') THEN 'suffix' WHEN strlen(html) > 20000 THEN 'too large' WHEN strlen(html) = 0 THEN 'empty' WHEN left(html, 4) <> '<htm' THEN 'header' END"


def problem():
    return rules.file_problem(col("url"), F.octet_length("html"), col("html").cast("binary"), 20_000, ".html", "<htm")


over("pages", "s01_validate_inputs", lambda: ["page_id", problem().alias("error")], f"SELECT page_id, {PROBLEM} AS error FROM pages")

ENDING = "coalesce(nullif(lower(regexp_extract(url, '(\\.[^./]*)$', 1)), ''), '')"
over("pages", "s02_input_errors", lambda: ["page_id", rules.input_error(col("url"), F.when(col("page_id") % 7 > 0, F.octet_length("html")), (".html", ".pdf"), "text/html", 20_000).alias("e")], f"""WITH f AS (SELECT *, {ENDING} AS ending, CASE WHEN page_id % 7 > 0 THEN strlen(html) END AS size FROM pages),
m AS (SELECT *, CASE WHEN url IS NULL OR size IS NULL THEN 'File not found: ' || coalesce(url, '') WHEN ending NOT IN ('.html', '.pdf') THEN 'Unsupported file format: ' || regexp_extract(url, '(\\.[^./]*)$', 1) || '. Supported formats: .html, .pdf' WHEN ending = '.pdf' THEN 'File does not appear to be a PDF: application/pdf'
  WHEN size > 20000 THEN 'File too large: ' || format('{{:,}}', size) || ' bytes (max: 20,000 bytes)' WHEN size = 0 THEN 'File is empty' END AS message FROM f)
SELECT page_id, CASE WHEN message IS NOT NULL THEN 'VALIDATION_ERROR' END AS code, message FROM m""")
TYPED = QUERIES["s02_input_errors"]
QUERIES["s02_input_errors"] = lambda spark, sf_dir: TYPED(spark, sf_dir).select("page_id", "e.code", "e.message")


def page_folder(spark: SparkSession, sf_dir: str) -> str:
    """Pages as files in nested folders, under two endings; one in three begins as a PDF does."""
    folder = writers.new_folder(spark, "inputs")
    p = corpus.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), col("page_id").cast("string")).alias("name"), F.concat(F.when(col("page_id") % 3 == 0, "%PDF-1.4\n").otherwise("text\n"), F.coalesce("html", F.lit(""))).alias("text"), (col("page_id") % 5 == 0).alias("other"))
    for other, ending in ((False, ".pdf"), (True, ".txt")):
        named.write_named(p.where(col("other") == other).select("name", "text"), folder, ending, sharded=True, mode="append")
    return folder


FILES = "SELECT 'p' || page_id || '.pdf' AS name, strlen(coalesce(html, '')) + CASE WHEN page_id % 3 = 0 THEN 9 ELSE 5 END AS length, CASE WHEN strlen(coalesce(html, '')) + CASE WHEN page_id % 3 = 0 THEN 9 ELSE 5 END > 20000 THEN 'too large' WHEN page_id % 3 <> 0 THEN 'header' END AS error FROM pages WHERE page_id % 5 <> 0"


@query("s18_input_files", FILES)
def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by pattern below a folder, with what is wrong with them."""
    return corpus.files(spark, page_folder(spark, sf_dir), max_bytes=20_000).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "error")


@query("x05_upload_stream", f"SELECT name, length, CASE WHEN error = 'too large' AND name IN (SELECT 'p' || page_id || '.pdf' FROM pages WHERE page_id % 3 = 0) THEN NULL WHEN error = 'too large' THEN 'header' ELSE error END AS error FROM ({FILES})")
def upload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as uploads: a stream takes a few at a time, checks and converts them."""
    out = writers.new_folder(spark, "converted")
    convert = lambda rows: rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.octet_length("content").cast("long").alias("length"), "error")
    jobs.convert_uploads(spark, page_folder(spark, sf_dir) + "/*", convert, out, writers.new_folder(spark, "uploaded"), max_files=150).awaitTermination()
    return spark.read.parquet(out).select("name", "length", "error")


SPANS = """WITH spans AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 5 AS INTEGER) AS page_number, CAST(l_linenumber // 4 AS INTEGER) AS block_no, (l_linenumber % 4) // 2 AS line_no, l_linenumber AS n, l_partkey AS p,
  CASE WHEN l_quantity <= 45 THEN l_returnflag || 'x ' || l_partkey WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END AS text, CASE WHEN l_discount > 0.02 THEN l_quantity ELSE 0 END AS size FROM lineitem),
ls AS (SELECT doc_id, page_number, block_no, line_no, string_agg(text, '' ORDER BY n, p) AS line, sum(CASE WHEN size <> 0 THEN size END) AS s, count(CASE WHEN size <> 0 THEN size END) AS n FROM spans GROUP BY ALL)
"""
BLOCKS = f"""SELECT doc_id, page_number, block_no, text, lines_count, round(font_size, 6) AS font_size, {CLASS} AS content_type, {CONFIDENCE} AS confidence FROM (SELECT doc_id, page_number, block_no, string_agg(line, {NL} ORDER BY line_no) FILTER (trim(line) <> '') AS text, count(*) FILTER (trim(line) <> '') AS lines_count, coalesce(sum(s) / sum(n), 12) AS font_size FROM ls GROUP BY ALL) WHERE text <> ''"""


@query("s07_block_elements", SPANS + BLOCKS)
def block_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.block_elements(corpus.spans(spark, sf_dir))
    return found.select("doc_id", "page_number", "block_no", "text", "lines_count", F.round("font_size", 6).alias("font_size"), "content_type", "confidence")


@query("s09_layout_elements", SPANS + f"SELECT doc_id, page_number, block_no, text, round(font_size, 6) AS font_size, 0.9::DOUBLE AS confidence FROM (SELECT doc_id, page_number, block_no, {D.strip(f'string_agg(line, {NL} ORDER BY line_no)')} AS text, coalesce(sum(s) / sum(n), 12) AS font_size FROM ls GROUP BY ALL) WHERE text <> ''")
def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.layout_elements(corpus.spans(spark, sf_dir)).withColumn("font_size", F.round("font_size", 6))


per_document("s08_better_text", "text", lambda t: rules.better_text(F.replace(t, F.lit("\n"), F.lit("")), F.when(F.length(t) % 3 != 0, strip(t))), f"(SELECT CASE WHEN length(b) > length(a) THEN b ELSE a END FROM (SELECT replace(text, {NL}, '') AS a, CASE WHEN length(text) % 3 <> 0 THEN {D.strip(T)} ELSE '' END AS b))")


@query("s14_confident_text", O + f"SELECT image_id, string_agg(text, {NL} ORDER BY word_no, text) AS text FROM words WHERE conf > 50 GROUP BY image_id")
def confident_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.confident_text(corpus.ocr_words(spark, sf_dir).withColumnRenamed("conf", "confidence"), 50)


PAGES = """WITH pages_ AS (SELECT o_orderkey AS doc_id, CAST(i AS INTEGER) AS page_index, CAST(CASE WHEN o_custkey % 11 = 0 THEN i - 1 ELSE i END AS INTEGER) AS page_number, CAST(o_custkey % 13 * 50 AS DOUBLE) AS width, 792::DOUBLE AS height,
  CASE WHEN o_custkey % 17 = 0 THEN 0 ELSE 300 END AS dpi, CASE o_custkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'ocr_fallback' WHEN 2 THEN 'vlm' END AS processing_method, CASE WHEN i > 0 THEN o_orderpriority END AS raw_text FROM orders, range(0, 3) t(i))
"""


def over_pages(name: str, build, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus.document_pages(spark, sf_dir))
    ORACLES[name] = PAGES + oracle


def asked(p: DataFrame) -> DataFrame:
    return p.select("doc_id", (col("page_index") + 1).alias("page_number"))


over_pages("s16_page_range", lambda p: p.where(rules.clamped_range(col("page_index"), -2, 7, F.when(col("doc_id") % 2 == 0, 2).otherwise(3))).select("doc_id", "page_index"), "SELECT doc_id, page_index FROM pages_ WHERE page_index BETWEEN 0 AND CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END")
over_pages("s17_page_dimensions", lambda p: pages.page_dimensions(asked(p), p.withColumn("page_number", col("page_index"))), "SELECT doc_id, page_index + 1 AS page_number, CASE WHEN page_index < 2 THEN width END AS width, CASE WHEN page_index < 2 THEN height END AS height, CASE WHEN page_index = 2 THEN 'invalid page number' END AS problem FROM pages_")


def nation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "nation").select(col("n_nationkey").alias("doc_id"), F.concat(F.lit("# "), "n_name", F.lit("\n\nline é\n")).alias("markdown"))


@query("k01_markdown_files", f"SELECT n_nationkey AS doc_id, '# ' || n_name || {NL} || {NL} || 'line é' || {NL} AS markdown FROM nation")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = writers.new_folder(spark, "markdown")
    writers.write_markdown(nation_docs(spark, sf_dir), folder)
    return writers.read_markdown(spark, folder)


def shelved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as converted files of several folders; many share a stem, and some failed."""
    file = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/doc é "), (col("doc_id") % 300).cast("string"), F.when(col("doc_id") % 2 == 0, ".v1.pdf").otherwise(".pdf"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", file.alias("file"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), col("doc_id").cast("string")).alias("markdown"), F.when(col("doc_id") % 11 == 0, "no text").alias("error"))


SHELVED = f"""WITH s AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/doc é ' || (doc_id % 300) || CASE WHEN doc_id % 2 = 0 THEN '.v1.pdf' ELSE '.pdf' END AS file, 'doc é ' || (doc_id % 300) || CASE WHEN doc_id % 2 = 0 THEN '.v1' ELSE '' END AS stem,
  coalesce(text, '') || {NL} || doc_id AS markdown, doc_id % 11 = 0 AS failed FROM documents),
named AS (SELECT *, stem || CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY file, md5(markdown)) > 1 THEN '-' || left(md5(file || {NL} || md5(markdown)), 12) ELSE '' END AS name FROM s)
"""


@query("k01b_named_files", SHELVED + "SELECT name, markdown FROM named WHERE NOT failed")
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a batch writes, read back."""
    folder = writers.new_folder(spark, "named")
    named.write_batch(shelved(spark, sf_dir), folder)
    return named.read_named(spark, folder)


@query("k02b_written_batch", SHELVED + "SELECT file, NOT failed AS success, CASE WHEN NOT failed THEN name || '.md' END AS output, CASE WHEN failed THEN 'no text' END AS error FROM named")
def written_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch says about each of its files."""
    folder = writers.new_folder(spark, "batch")
    found = named.write_batch(shelved(spark, sf_dir), folder, sharded=True)
    return found.withColumn("output", F.substring("output", F.lit(len(folder) + 2), F.length("output")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("in/p"), col("page_id").cast("string"), F.lit(".x.html")).alias("file"), F.md5("html").alias("markdown"), F.when(col("page_id") % 10 == 7, problem()).alias("error"))


BATCH = f"SELECT page_id, 'in/p' || page_id || '.x.html' AS file, md5(html) AS markdown, CASE WHEN page_id % 10 = 7 THEN {PROBLEM} END AS error FROM pages"
RESULT = "SELECT file, error IS NULL AS success, CASE WHEN error IS NULL THEN 'out/p' || page_id || '.x.md' END AS output, error, CASE WHEN error IS NULL THEN markdown END AS markdown FROM b"
QUERIES["k02_batch_results"] = lambda spark, sf_dir: writers.batch_results(page_files(spark, sf_dir), "out")
ORACLES["k02_batch_results"] = f"WITH b AS ({BATCH}) {RESULT}"
QUERIES["k03_batch_stops"] = lambda spark, sf_dir: writers.batch_results(page_files(spark, sf_dir), "out", stop_on_error=True, order="page_id")
ORACLES["k03_batch_stops"] = f"WITH b AS ({BATCH}) {RESULT} WHERE page_id <= coalesce((SELECT min(page_id) FROM b WHERE error IS NOT NULL), page_id)"


@query("k06_result_store", "SELECT sha256(text) AS key, 'new ' || doc_id AS value, CAST(strlen('new ' || doc_id) AS BIGINT) AS size_bytes, TIMESTAMP '2024-01-02 00:00:00' AS stored_at FROM (SELECT text, max(CAST(doc_id AS VARCHAR)) AS doc_id FROM documents GROUP BY text)")
def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of results for each text; the newest is read."""
    folder = writers.new_folder(spark, "results")
    docs = corpus.table(spark, sf_dir, "documents").groupBy("text").agg(F.max(col("doc_id").cast("string")).alias("doc_id"))
    for word, day in (("old ", "2024-01-01"), ("new ", "2024-01-02")):
        rows = docs.select(rules.cache_key(col("text")).alias("key"), F.concat(F.lit(word), "doc_id").alias("value"), F.lit(day).cast("timestamp").alias("stored_at"))
        writers.write_results(rows, folder)
    return writers.read_results(spark, folder)


over("documents", "k07_base64", lambda: ["doc_id", F.md5(rules.encode_image(col("text").cast("binary"))).alias("encoded"), rules.decode_image(F.concat(F.lit("data:image/png;base64,"), rules.encode_image(col("text").cast("binary")))).cast("string").alias("decoded")], "SELECT doc_id, md5(to_base64(encode(text))) AS encoded, text AS decoded FROM documents")

# text rules --------------------------------------------------------------

per_document("p04_math_expressions", "found", lambda t: F.array_join(F.transform(C.math_expressions(t), lambda x: x["text"]), "|"), "array_to_string(list_concat(" + ", ".join(f"regexp_extract_all({T}, {D.rx(p, 'ms')})" for p in C.MATH_PATTERNS) + "), '|')")
over("part", "p06_table_to_text", lambda: ["p_partkey", rules.table_to_text(F.array(F.array(col("p_name"), F.when(col("p_size") % 5 != 0, col("p_type"))), F.array().cast("array<string>"), F.lit(None).cast("array<string>"), F.array("p_brand"))).alias("text")], f"SELECT p_partkey, p_name || ' | ' || CASE WHEN p_size % 5 <> 0 THEN p_type ELSE '' END || {NL} || p_brand AS text FROM part")


@query("p07_table_elements", PAGES + f"SELECT doc_id, page_number, 'a | b' || {NL} || doc_id || ' | ' AS text, 0.7::DOUBLE AS confidence, 2 AS n_rows, 2 AS n_cols, 50::DOUBLE AS x0, width - 50 AS x1, 742::DOUBLE AS y1 FROM pages_ WHERE page_index = 0")
def table_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.document_pages(spark, sf_dir).where("page_index < 2")
    two = F.array(F.array(F.lit("a"), F.lit("b")), F.array(col("doc_id").cast("string"), F.lit(None).cast("string")))
    found = p.select("doc_id", "page_number", F.lit(0).alias("table_no"), F.when(col("page_index") == 0, two).otherwise(F.array(F.array(F.lit("only")))).alias("rows"))
    made = pages.table_elements(found, p)
    return made.select("doc_id", "page_number", "text", "confidence", "n_rows", "n_cols", "bbox.x0", "bbox.x1", "bbox.y1")


over("documents", "p12_fallback_content", lambda: ["doc_id", rules.fallback_content(F.when(col("doc_id") % 3 != 0, F.concat(F.lit("p"), col("doc_id").cast("string"))), F.when(col("doc_id") % 2 == 0, col("text"))).alias("content")], f"SELECT doc_id, '# Page ' || CASE WHEN doc_id % 3 <> 0 THEN 'p' || doc_id ELSE 'Unknown' END || {NL} || {NL} || CASE WHEN doc_id % 2 = 0 AND text <> '' THEN '## Extracted Text' || {NL} || {NL} || text ELSE {D.q(rules.UNABLE)} END AS content FROM documents")
TOGGLES = " || ".join(f"CASE WHEN {c} THEN {D.q(rules.PROMPT_TOGGLES[k])} ELSE '' END" for k, c in (("tables", "contains(text, '|')"), ("math", "contains(text, '$')"), ("code", "contains(text, '{')")))
per_document("p13_page_prompt", "prompt", lambda t: rules.page_prompt(t.contains("|"), t.contains("$"), t.contains("{")), f"{D.q(rules.PAGE_PROMPT)} || {TOGGLES}")


def doc_mode():
    return F.when(col("doc_id") % 3 == 0, "vision_only").when(col("doc_id") % 3 == 1, "hybrid").otherwise("text")


over("documents", "p13_default_prompt", lambda: ["doc_id", rules.default_prompt(doc_mode(), col("text")).alias("prompt")], f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {D.q(rules.PAGE_PROMPT)} WHEN 1 THEN {D.q(rules.HYBRID_PROMPT[0])} || text || {D.q(rules.HYBRID_PROMPT[1])} ELSE {D.q(rules.TEXT_PROMPT)} END AS prompt FROM documents")
over("documents", "p13_enhanced_prompt", lambda: ["doc_id", rules.enhanced_prompt(F.lit("Convert."), col("text"), doc_mode()).alias("prompt")], f"SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND text <> '' THEN 'Extracted text: ' || text || {NL} || {NL} ELSE '' END || 'Convert.' || {D.q(rules.INSTRUCTIONS)} AS prompt FROM documents")
MODELS = ["LLaVA:13b", "mistral:7b", "Qwen2-VL-7B", "minicpm-v", "phi3", "moondream2", "qwen2.5-vl:3b"]
over("part", "p14_vision_models", lambda: ["p_partkey", rules.supports_vision(F.array(*map(F.lit, MODELS))[(col("p_partkey") % len(MODELS)).cast("int")]).alias("sees")], "SELECT p_partkey, p_partkey % 7 IN (0, 2, 3, 5, 6) AS sees FROM part")
over("lineitem", "p16_ocr_valid", lambda: ["l_orderkey", "l_linenumber", rules.ocr_valid(col("l_discount") * 10, F.when(col("l_tax") > 0.02, col("l_returnflag")).otherwise(" \t")).alias("valid")], "SELECT l_orderkey, l_linenumber, l_discount * 10 >= 0.5::DOUBLE AND l_tax > 0.02::DOUBLE AS valid FROM lineitem")
CODES = ["eng", "chi_sim", "jpn", "xxx", "de"]
SUPPORTED = ["en", "ja", "de", "zh_sim"]


def codes():
    pick = lambda n: F.array(*map(F.lit, CODES))[(F.floor(col("p_partkey") / n) % len(CODES)).cast("int")]
    return pick(1), pick(5)


over("part", "p20_languages", lambda: ["p_partkey", F.array_join(rules.list_languages(F.array(*codes()), SUPPORTED), ",").alias("several"), rules.one_language(codes()[0]).alias("one")], "WITH c AS (SELECT p_partkey, ['en', 'zh_sim', 'ja', NULL, 'de'][p_partkey % 5 + 1] AS a, ['en', 'zh_sim', 'ja', NULL, 'de'][p_partkey // 5 % 5 + 1] AS b FROM part) SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'en' ELSE concat_ws(',', a, b) END AS several, ['en', 'ch', 'japan', 'en', 'en'][p_partkey % 5 + 1] AS one FROM c")
over("orders", "p22_document_header", lambda: ["o_orderkey", rules.document_header(F.when(col("o_orderkey") % 3 != 0, col("o_orderpriority")), F.concat(F.lit("f"), col("o_orderkey").cast("string")), F.when(col("o_custkey") % 2 == 0, col("o_orderstatus")), F.when(col("o_custkey") % 5 == 0, "2024"), col("o_custkey") % 4).alias("header")], f"SELECT o_orderkey, concat_ws({NL} || {NL}, '# ' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'f' || o_orderkey END, CASE WHEN o_custkey % 2 = 0 OR o_custkey % 5 = 0 THEN '## Document Information' END, CASE WHEN o_custkey % 2 = 0 THEN '**Author:** ' || o_orderstatus END, CASE WHEN o_custkey % 5 = 0 THEN '**Created:** 2024' END, CASE WHEN (o_custkey % 2 = 0 OR o_custkey % 5 = 0) AND o_custkey % 4 > 0 THEN '**Pages:** ' || (o_custkey % 4) END) AS header FROM orders")
over("documents", "p23_raw_fallback", lambda: ["doc_id", rules.raw_fallback(col("doc_id") % 5, F.when(col("doc_id") % 4 > 0, col("text"))).alias("markdown")], f"SELECT doc_id, '# Page ' || (doc_id % 5 + 1) || {NL} || {NL} || CASE WHEN doc_id % 4 > 0 AND text <> '' THEN text ELSE '*Content extraction failed*' END AS markdown FROM documents")
PAIRS = " AND ".join(f"{D.count(T, a)} = {D.count(T, b)}" for a, b in (("\\\\\\(", "\\\\\\)"), ("\\\\\\[", "\\\\\\]"), ("\\{", "\\}")))
per_document("p30_latex_ok", "ok", rules.latex_ok, f"length(text) > 0 AND {PAIRS} AND NOT {D.has(T, '[^\\\\]\\$', 's')} AND NOT {D.has(T, '\\\\\\\\\\n?\\z')}")
per_document("p30_latex_dollars", "ok", lambda t: rules.latex_ok(t, False), f"length(text) > 0 AND {PAIRS} AND {D.count(T, '\\$')} % 2 = 0 AND NOT {D.has(T, '\\\\\\\\\\n?\\z')}")


@query("p31_to_latex", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '\\frac{' || o_orderkey || '}{' || o_custkey || '}' ELSE '$x plus \\beta times ' || o_custkey || '$' END AS latex FROM orders")
def to_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = (col(n).cast("string") for n in ("o_orderkey", "o_custkey"))
    t = F.when(col("o_orderkey") % 2 == 0, F.concat(F.lit("so "), k, F.lit(" / "), c, F.lit(" and x^2"))).otherwise(F.concat(F.lit("x plus β times "), c))
    docs = corpus.table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text"))
    return docs.select("o_orderkey", rules.to_latex(col("text"), mathx.outermost_array("text")).alias("latex"))


over("orders", "p32_equation_to_latex", lambda: ["o_orderkey", rules.equation_to_latex(F.concat(F.lit("2x ≤ "), col("o_custkey").cast("string"), F.lit("y / z √"))).alias("latex")], "SELECT o_orderkey, '2 \\cdot x \\leq \\frac{' || o_custkey || ' \\cdot y}{z} \\sqrt{}' AS latex FROM orders")
over("part", "p35_cut_cell", lambda: ["p_partkey", C.cut_cell(col("p_name"), F.lit(12)).alias("cell")], "SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS cell FROM part")
over("orders", "p42_cache_key", lambda: ["o_orderkey", rules.cache_key({"priority": col("o_orderpriority"), "customer": col("o_custkey"), "open": col("o_orderstatus") == "O"}).alias("key"), rules.short_key(col("o_orderpriority")).alias("short")], """SELECT o_orderkey, sha256('{"customer": ' || o_custkey || ', "open": ' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || ', "priority": "' || o_orderpriority || '"}') AS key, left(sha256(o_orderpriority), 16) AS short FROM orders""")
over("pages", "p44_image_key", lambda: ["page_id", rules.image_key(F.concat(F.lit("p"), col("page_id").cast("string")), col("page_id") * 2, {"dpi": F.lit(300)}).alias("key")], """SELECT page_id, left(md5('{"mtime": ' || (page_id * 2) || ', "params.dpi": 300, "path": "p' || page_id || '"}'), 16) AS key FROM pages""")
FORMATS = ["png", "JPEG", "webp", "BMP", "tiff", "gif"]


def formats():
    pick = lambda n: F.array(*map(F.lit, FORMATS))[(F.floor(col("p_partkey") / n) % len(FORMATS)).cast("int")]
    return pick(1), pick(6)


over("part", "p45_conversions", lambda: ["p_partkey", rules.can_convert(*formats()).alias("possible")], "SELECT p_partkey, a = b OR (b IN (0, 1, 2) AND a < 5) AS possible FROM (SELECT p_partkey, p_partkey % 6 AS a, p_partkey // 6 % 6 AS b FROM part)")


@query("p46_uploads", f"SELECT page_id, len(e) = 0 AS is_valid, array_to_string(e, ',') AS errors, array_to_string(w, ',') AS warnings, round(size / 1048576.0::DOUBLE, 2) AS size_mb FROM (SELECT page_id, size, list_filter([CASE WHEN page_id % 3 = 0 THEN 'not a pdf' END, CASE WHEN size > {rules.MAX_UPLOAD} THEN 'too large' END, CASE WHEN page_id % 5 = 0 THEN 'backend not available' END], lambda x: x IS NOT NULL) AS e, list_filter([CASE WHEN page_id % 5 = 1 THEN 'backend not verified' END, CASE WHEN page_id % 2 = 0 THEN 'vision may not be supported' END], lambda x: x IS NOT NULL) AS w FROM (SELECT page_id, strlen(html) * 10000 AS size FROM pages))")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("page_id")
    name, size = F.when(k % 3 == 0, "a.txt").otherwise("b.PDF"), F.octet_length("html").cast("long") * 10_000
    report = rules.upload_report(name, size, F.when(k % 5 == 0, False).when(k % 5 != 1, True), k % 2 == 0)
    return corpus.table(spark, sf_dir, "pages").select("page_id", report.alias("r")).select("page_id", "r.is_valid", F.array_join("r.errors", ",").alias("errors"), F.array_join("r.warnings", ",").alias("warnings"), "r.size_mb")


over("documents", "a23_conversion_result", lambda: ["doc_id", F.regexp_count("text", F.lit("\\n## Page")).cast("long").alias("pages"), F.octet_length("text").cast("long").alias("bytes"), outline.page_sections(col("text")).cast("long").alias("sections")], f"SELECT doc_id, (length(text) - length(replace(text, {NL} || '## Page', ''))) // 8 AS pages, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(string_split(text, '## Page')) - 1 AS BIGINT) AS sections FROM documents")

# elements, pages, documents -----------------------------------------------


def over_elements(name: str, build, oracle: str, ctes: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: build(corpus.elements(spark, sf_dir), corpus.document_pages(spark, sf_dir))
    ORACLES[name] = E + ctes + oracle


P_CTE = ", " + PAGES.removeprefix("WITH ")
over_elements("a05_characteristics", lambda e, p: elements.characteristics(e, C.length_class(F.countDistinct("page_number") * 4).alias("length_class")), f"SELECT *, {TYPE} AS document_type FROM (SELECT doc_id, count(*) AS n_elements, {KINDS}, CASE WHEN count(DISTINCT page_number) * 4 <= 5 THEN 'short' WHEN count(DISTINCT page_number) * 4 <= 20 THEN 'medium' ELSE 'long' END AS length_class FROM elements GROUP BY doc_id)")
over_elements("a07_page_summary", lambda e, p: elements.page_summary(e, p.select("doc_id", col("page_index").alias("page_number"), "raw_text")), f"""SELECT p.doc_id, page_index + 1 AS page_number, page_index > 0 AS has_raw_text, coalesce(n_elements, 0) AS n_elements, coalesce(n_text, 0) AS n_text, coalesce(n_table, 0) AS n_table, coalesce(n_mathematical, 0) AS n_mathematical, coalesce(n_code, 0) AS n_code, coalesce(confidence, 0) AS confidence
FROM pages_ p LEFT JOIN (SELECT doc_id, page_number, count(*) AS n_elements, {KINDS}, round(sum(confidence * {WEIGHT}) / sum({WEIGHT}), 6) AS confidence FROM elements GROUP BY ALL) x ON p.doc_id = x.doc_id AND page_index = x.page_number""", P_CTE)
over_elements("p15_needs_recognition", lambda e, p: pages.needs_recognition(p.withColumn("page_number", col("page_index")), e), """SELECT p.doc_id, page_index AS page_number, CASE WHEN processing_method = 'failed' THEN true WHEN processing_method = 'ocr_fallback' THEN false ELSE coalesce(m < 0.5::DOUBLE, false) OR (m IS NULL AND raw_text IS NULL) END AS needs_ocr
FROM pages_ p LEFT JOIN (SELECT doc_id, page_number, avg(confidence) AS m FROM elements GROUP BY ALL) x ON p.doc_id = x.doc_id AND page_index = x.page_number""", P_CTE)


def odd_elements(e: DataFrame) -> DataFrame:
    """Elements some of which are blank, too sure, or have boxes inside out."""
    box = F.when(col("bbox").isNotNull(), F.struct(col("bbox.x0").alias("x0"), col("bbox.y0").alias("y0"), (col("font_size") + 10).alias("x1"), F.lit(30.0).alias("y1")))
    return e.withColumns({"text": F.when(col("elem_no") % 5 == 0, " \t").otherwise("x"), "confidence": F.when(col("elem_no") % 6 == 0, col("confidence") + 0.9).otherwise(col("confidence")), "page_number": F.when(col("elem_no") == 7, -1).otherwise(col("page_number")), "bbox": box})


over_elements("p27_element_violations", lambda e, p: pages.element_violations(odd_elements(e)), """, odd AS (SELECT doc_id, elem_no, CASE WHEN elem_no = 7 THEN -1 ELSE page_number END AS page_number, CASE WHEN elem_no % 6 = 0 THEN confidence + 0.9::DOUBLE ELSE confidence END AS c, x0 >= font_size + 10 OR y0 >= 30 AS inside_out FROM elements)
SELECT doc_id, page_number, elem_no, unnest(list_filter([CASE WHEN elem_no % 5 = 0 THEN 'empty text' END, CASE WHEN NOT c BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN inside_out THEN 'bounding box' END, CASE WHEN page_number < 0 THEN 'page number' END], lambda x: x IS NOT NULL)) AS problem FROM odd""")
over_pages("p27_page_violations", pages.page_violations, "SELECT doc_id, page_index, unnest(list_filter([CASE WHEN page_number <> page_index THEN 'page number' END, CASE WHEN page_number < 0 THEN 'negative page' END, CASE WHEN width <= 0 THEN 'dimensions' END, CASE WHEN dpi <= 0 THEN 'dpi' END], lambda x: x IS NOT NULL)) AS problem FROM pages_")
QUERIES["p27_document_violations"] = lambda spark, sf_dir: pages.document_violations(corpus.table(spark, sf_dir, "orders").select(col("o_orderkey").alias("doc_id"), F.when(col("o_custkey") % 2 == 0, 3).otherwise(4).alias("page_count")), corpus.document_pages(spark, sf_dir).where("doc_id % 10 > 0"))
ORACLES["p27_document_violations"] = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN 'no pages' ELSE 'page count' END AS problem FROM orders WHERE o_orderkey % 10 = 0 OR o_custkey % 2 = 1"
over_elements("o04_by_confidence", lambda e, p: elements.by_confidence(e).select("doc_id", "page_number", "elem_no", "rank"), "SELECT doc_id, page_number, elem_no, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY confidence DESC, elem_no) AS INTEGER) AS rank FROM elements")


def containment(e: DataFrame, p: DataFrame) -> DataFrame:
    own = p.select("doc_id", col("page_index").alias("page_number"))
    found = elements.contained(own.select("doc_id").distinct(), own, e)
    shown = F.transform("pages", lambda x: F.concat(x["page_number"].cast("string"), F.lit(":"), F.array_join(F.transform(x["elements"], lambda y: F.concat(y["elem_no"].cast("string"), y["content_type"])), ",")))
    return found.select("doc_id", F.array_join(shown, ";").alias("pages"))


over_elements("j01_containment", containment, """, own AS (SELECT p.doc_id, page_index, coalesce(string_agg(elem_no || content_type, ',' ORDER BY elem_no, content_type), '') AS es FROM pages_ p LEFT JOIN elements e ON p.doc_id = e.doc_id AND page_index = e.page_number GROUP BY p.doc_id, page_index)
SELECT doc_id, string_agg(page_index || ':' || es, ';' ORDER BY page_index) AS pages FROM own GROUP BY doc_id""", P_CTE)


def after_recognition(e: DataFrame, p: DataFrame) -> DataFrame:
    """Failed pages get what an engine found: the sure half of their elements."""
    p = p.withColumn("page_number", col("page_index"))
    failed = p.where("processing_method = 'failed'").select("doc_id", "page_number")
    seen = e.join(failed, ["doc_id", "page_number"]).where("confidence > 0.7").select("doc_id", "page_number", (col("elem_no") + 100).alias("elem_no"), "content_type", "confidence")
    done, every = pages.recognised_pages(p, e, seen, ["second", "third"], "first")
    counts = every.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
    return done.join(counts, ["doc_id", "page_number"], "left").select("doc_id", "page_number", "processing_method", "ocr_engine", F.round("ocr_confidence", 6).alias("ocr_confidence"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


over_elements("e10_recognised_pages", after_recognition, """, seen AS (SELECT e.doc_id, e.page_number, avg(confidence) AS c, count(*) AS m FROM elements e JOIN pages_ p ON e.doc_id = p.doc_id AND e.page_number = page_index WHERE processing_method = 'failed' AND confidence > 0.7::DOUBLE GROUP BY ALL),
own AS (SELECT doc_id, page_number, count(*) AS n FROM elements GROUP BY ALL)
SELECT p.doc_id, page_index AS page_number, CASE WHEN c IS NOT NULL THEN 'ocr_fallback' ELSE processing_method END AS processing_method, CASE WHEN c IS NOT NULL THEN 'second' END AS ocr_engine, round(c, 6) AS ocr_confidence, coalesce(n, 0) + coalesce(m, 0) AS n
FROM pages_ p LEFT JOIN seen s ON p.doc_id = s.doc_id AND page_index = s.page_number LEFT JOIN own o ON p.doc_id = o.doc_id AND page_index = o.page_number""", P_CTE)

# errors and lines -----------------------------------------------------------

ERROR_CODES = [*errors.SEVERITY, "OTHER"]
SEVERITY_CASES = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in errors.SEVERITY.items())
FINAL = ", ".join(f"'{c}'" for c in errors.RETRIABLE)


@query("p29_errors", f"SELECT event_id, code, CASE code {SEVERITY_CASES} ELSE 'low' END AS severity, code IN ({FINAL}) AS retriable FROM (SELECT event_id, {ERROR_CODES}[event_id % 19 + 1] AS code FROM events)")
def described_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.array(*map(F.lit, ERROR_CODES))[(col("event_id") % 19).cast("int")]
    return errors.described(corpus.table(spark, sf_dir, "events").select("event_id", code.alias("code")))


PIPES = f"{D.count('line', '\\|')} >= 3"
ROWS = f"{PIPES} AND NOT (starts_with(line, '##') OR starts_with(line, repeat(chr(96), 3)) OR starts_with(line, '•') OR starts_with(line, 'Task') OR contains(line, 'DOMAIN'))"
CENSUS = {
    "dots": f"contains(line, '{outline.DOTS}')", "pipes": PIPES, "tabs": "contains(line, chr(9))", "spaces": D.has("line", " {3,}"), "tasks": "starts_with(line, 'Task')", "domains": "contains(line, 'DOMAIN') AND contains(line, '%')",
    "bullets": "starts_with(line, '•')", "percents": D.has("line", "\\d+%"), "table_rows": ROWS, "in_columns": " OR ".join(D.has("line", p) for p in outline.COLUMNS),
}
LINES = f"WITH raw AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, {NL})))) AS INTEGER) AS line_no, unnest(string_split(text, {NL})) AS raw FROM documents), l AS (SELECT * FROM (SELECT doc_id, line_no, {D.strip('raw')} AS line FROM raw) WHERE line <> '')"
QUERIES["h05_line_census"] = lambda spark, sf_dir: outline.line_census(corpus.explode_lines(corpus.table(spark, sf_dir, "documents")))
ORACLES["h05_line_census"] = LINES + " SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in CENSUS.items()) + " FROM l"
QUERIES["h05_line_samples"] = lambda spark, sf_dir: outline.line_samples(corpus.explode_lines(corpus.table(spark, sf_dir, "documents")))
ORACLES["h05_line_samples"] = LINES + ", m AS (SELECT doc_id, line_no, line, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CENSUS.items()) + "], lambda x: x IS NOT NULL)) AS pattern FROM l), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, pattern ORDER BY line_no) AS INTEGER) AS place FROM m) SELECT * FROM p WHERE place <= 5"
