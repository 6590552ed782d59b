"""Spans, blocks, pages and documents: text assembly, checks, recognition by other engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.patterns import strip
from ..functions.rules import table_to_text

# Defaults of the extractors.
FONT_SIZE, LAYOUT_CONFIDENCE, TABLE_CONFIDENCE, INSET = 12.0, 0.9, 0.7, 50


def in_order(order: str, value: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)


def block_elements(spans: DataFrame) -> DataFrame:
    """spans(doc_id, page_number, block_no, line_no, span_no, text, size) -> an element for each block of text.

    Spans are put together to lines, lines with something on them to the
    block; its kind and confidence come from its text, its font size is the
    mean of sizes that are not zero.  Blocks without text are left out.
    """
    block = ["doc_id", "page_number", "block_no"]
    sizes = F.when(F.col("size") != 0, F.col("size"))
    lines = spans.groupBy(*block, "line_no").agg(in_order("span_no", "text", "").alias("line"), F.sum(sizes).alias("sum"), F.count(sizes).alias("n"))
    shown = F.when(strip(F.col("line")) != "", F.struct("line_no", "line"))
    body = F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["line"])
    found = lines.groupBy(*block).agg(F.array_join(body, "\n").alias("text"), F.count(shown).alias("lines_count"), F.coalesce(F.sum("sum") / F.sum("n"), F.lit(FONT_SIZE)).alias("font_size")).where("text <> ''")
    return found.withColumns({"content_type": C.text_class(F.col("text")), "confidence": C.text_confidence(F.col("text"))})


def layout_elements(spans: DataFrame) -> DataFrame:
    """spans -> blocks as one stripped text each, all of one confidence."""
    block = ["doc_id", "page_number", "block_no"]
    sizes = F.when(F.col("size") != 0, F.col("size"))
    lines = spans.groupBy(*block, "line_no").agg(in_order("span_no", "text", "").alias("line"), F.sum(sizes).alias("sum"), F.count(sizes).alias("n"))
    found = lines.groupBy(*block).agg(strip(in_order("line_no", "line", "\n")).alias("text"), F.coalesce(F.sum("sum") / F.sum("n"), F.lit(FONT_SIZE)).alias("font_size"))
    return found.where("text <> ''").withColumn("confidence", F.lit(LAYOUT_CONFIDENCE))


def confident_text(words: DataFrame, threshold: float = 0.5) -> DataFrame:
    """words(image_id, word_no, text, confidence) -> image_id, text: words above the threshold, a line each."""
    return words.where(F.col("confidence") > threshold).groupBy("image_id").agg(in_order("word_no", "text", "\n").alias("text"))


def page_dimensions(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked(doc_id, page_number) -> width, height and problem (of a page that is not there)."""
    found = asked.join(pages.select("doc_id", "page_number", "width", "height"), ["doc_id", "page_number"], "left")
    return found.withColumn("problem", F.when(F.col("width").isNull(), "invalid page number"))


def table_elements(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """tables(doc_id, page_number, table_no, rows) -> elements of tables of two rows or more, inside the page's margin."""
    placed = tables.where(F.size("rows") > 1).join(pages.select("doc_id", "page_number", "width", "height"), ["doc_id", "page_number"])
    box = F.struct(F.lit(float(INSET)).alias("x0"), F.lit(float(INSET)).alias("y0"), (F.col("width") - INSET).alias("x1"), (F.col("height") - INSET).alias("y1")).alias("bbox")
    return placed.select("doc_id", "page_number", "table_no", table_to_text(F.col("rows")).alias("text"), F.lit(TABLE_CONFIDENCE).alias("confidence"), F.size("rows").alias("n_rows"), F.size(F.col("rows")[0]).alias("n_cols"), box)


def needs_recognition(pages: DataFrame, elements: DataFrame, threshold: float = 0.5) -> DataFrame:
    """pages(doc_id, page_number, processing_method, raw_text) -> whether a page goes to recognition.

    Pages that failed do; pages that were there do not; others do if the mean
    confidence of their elements is low, or they have neither elements nor text.
    """
    means = elements.groupBy("doc_id", "page_number").agg(F.avg("confidence").alias("mean"))
    method = F.coalesce("processing_method", F.lit(""))
    bare = F.col("mean").isNull() & (F.coalesce("raw_text", F.lit("")) == "")
    needed = F.when(method == "failed", True).when(method == "ocr_fallback", False).otherwise(F.coalesce(F.col("mean") < threshold, F.lit(False)) | bare)
    return pages.join(means, ["doc_id", "page_number"], "left").select("doc_id", "page_number", needed.alias("needs_ocr"))


def recognised_pages(pages: DataFrame, elements: DataFrame, recognised: DataFrame, engines: list[str], preferred: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and elements after recognition: found elements are added, pages note engine and mean confidence.

    recognised(doc_id, page_number, elem_no, content_type, confidence) are the
    elements that the engine found; the preferred engine is taken if it is
    available, else the first; without any engine nothing changes.
    """
    if not engines:
        return pages, elements
    engine = preferred if preferred in engines else engines[0]
    means = recognised.groupBy("doc_id", "page_number").agg(F.avg("confidence").alias("ocr_confidence"))
    done = pages.join(means, ["doc_id", "page_number"], "left")
    method = F.when(F.col("ocr_confidence").isNotNull(), "ocr_fallback").otherwise(F.col("processing_method"))
    done = done.withColumns({"processing_method": method, "ocr_engine": F.when(F.col("ocr_confidence").isNotNull(), engine), "ocr_confidence": F.col("ocr_confidence")})
    return done, elements.unionByName(recognised, allowMissingColumns=True)


def broken(rules: dict[str, Column]) -> Column:
    """One row for each rule that holds."""
    return F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("problem")


def element_violations(elements: DataFrame) -> DataFrame:
    """elements(.., text, confidence, bbox) -> a row for each broken rule."""
    box = F.col("bbox")
    rules = {"empty text": strip(F.coalesce("text", F.lit(""))) == "", "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bounding box": (box["x0"] >= box["x1"]) | (box["y0"] >= box["y1"]), "page number": F.col("page_number") < 0}
    return elements.select("doc_id", "page_number", "elem_no", broken(rules))


def page_violations(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, page_index, width, height, dpi) -> a row for each broken rule."""
    rules = {"page number": F.col("page_number") != F.col("page_index"), "negative page": F.col("page_number") < 0, "dimensions": (F.col("width") <= 0) | (F.col("height") <= 0), "dpi": F.col("dpi") <= 0}
    return pages.select("doc_id", "page_index", broken(rules))


def document_violations(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents(doc_id, page_count) that have no pages, or others than they say."""
    found = documents.join(pages.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return found.select("doc_id", broken({"no pages": F.col("n").isNull(), "page count": F.coalesce(F.col("n") != F.col("page_count"), F.lit(False))}))
