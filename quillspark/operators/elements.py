"""Aggregates and checks over layout elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weight of each content type in a page's confidence.
WEIGHTS = {"TEXT": 0.3, "TABLE": 0.25, "MATHEMATICAL": 0.2, "CODE": 0.15, "IMAGE": 0.1}
OTHER_WEIGHT = 0.1
# What a document is by its shares of mathematics, code and tables.
TYPES = ["academic/technical", "programming/documentation", "data/business", "general"]


def of_type(kind: str) -> Column:
    return F.count_if(F.col("content_type") == kind)


def type_counts(elements: DataFrame, *keys: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    kinds = [of_type(k).alias(f"n_{k.lower()}") for k in ("TEXT", "TABLE", "MATHEMATICAL", "CODE")]
    return elements.groupBy(*keys).agg(F.count("*").alias("n_elements"), *kinds, *extra)


def weighted_confidence() -> Column:
    """Mean confidence of a group of elements, weighted by their kind; none: 0."""
    weight = F.lit(OTHER_WEIGHT)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("content_type") == kind, w).otherwise(weight)
    return F.round(F.coalesce(F.sum(F.col("confidence") * weight) / F.sum(weight), F.lit(0.0)), 6).alias("confidence")


def page_summary(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number from 0, raw_text) -> a page's number from 1, its elements by kind, whether it has text, its confidence."""
    found = type_counts(elements, "doc_id", "page_number", extra=(weighted_confidence(),))
    joined = pages.select("doc_id", "page_number", (F.coalesce("raw_text", F.lit("")) != "").alias("has_raw_text")).join(found, ["doc_id", "page_number"], "left")
    return joined.na.fill(0).withColumn("page_number", F.col("page_number") + 1)


def complex_layout(elements: DataFrame) -> DataFrame:
    """More than five pages, a page of over ten elements, or any table or mathematics."""
    pages = type_counts(elements, "doc_id", "page_number")
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("n_elements").alias("most"), F.sum("n_table").alias("tables"), F.sum("n_mathematical").alias("maths"))
    return docs.select("doc_id", ((F.col("pages") > 5) | (F.col("most") > 10) | (F.col("tables") > 0) | (F.col("maths") > 0)).alias("is_complex"))


def characteristics(elements: DataFrame, *extra: Column) -> DataFrame:
    """Document type by shares of mathematics, code and tables, in that order; ``extra`` are further aggregates."""
    c = type_counts(elements, "doc_id", extra=extra)
    over = lambda k, share: F.col(f"n_{k}") > F.col("n_elements") * share
    kind = F.when(over("mathematical", 0.1), TYPES[0]).when(over("code", 0.1), TYPES[1]).when(over("table", 0.2), TYPES[2]).otherwise(TYPES[3])
    return c.withColumn("document_type", kind)


def page_confidence(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id", "page_number").agg(weighted_confidence())


def reading_order(elements: DataFrame) -> DataFrame:
    """Element numbers of each page from top to bottom, unplaced ones last, ties in list order."""
    row = F.struct(F.col("bbox").isNull().alias("u"), F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"), F.col("elem_no").alias("e"))
    return elements.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["e"].cast("string")), ",").alias("reading_order"))


def heading(text: Column, font_size: Column) -> Column:
    return F.when(font_size > 16, F.concat(F.lit("### "), text)).when(font_size > 14, F.concat(F.lit("#### "), text)).otherwise(text)


def reconcile(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose processed form lost pages or more than half of the elements."""
    count = lambda d, p: d.groupBy("doc_id").agg(F.countDistinct("page_number").alias(f"{p}_pages"), F.count("*").alias(f"{p}_elements"))
    both = count(original, "old").join(count(processed, "new"), "doc_id", "full").na.fill(0, ["old_pages", "new_pages", "old_elements", "new_elements"])
    problem = F.when(F.col("old_pages") != F.col("new_pages"), "pages").when(F.col("new_elements") < 0.5 * F.col("old_elements"), "elements")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def words_text(words: DataFrame) -> DataFrame:
    """Recognised text of each image: confident words in order, their mean confidence, and their boxes."""
    kept = words.where((F.col("conf") > 0) & (F.trim("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text", "left", "top", "width", "height")))
    boxes = F.transform(ordered, lambda w: F.array(w["left"], w["top"], w["left"] + w["width"], w["top"] + w["height"]))
    return kept.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.round(F.avg("conf") / 100, 6).alias("confidence"), F.count("*").alias("n_words"), boxes.alias("boxes"))


def by_confidence(detections: DataFrame) -> DataFrame:
    """Detections of each page, the surest first: rank from 1, ties in the order of their number."""
    w = Window.partitionBy("doc_id", "page_number").orderBy(F.desc("confidence"), "elem_no")
    return detections.withColumn("rank", F.row_number().over(w))


def word_lines(words: DataFrame) -> DataFrame:
    """Lines of each image: words by their left edge, the box around them, the mean confidence."""
    kept = words.where((F.col("conf") > 0) & (F.trim("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("left", "word_no", "text")))
    return kept.groupBy("image_id", "line_num").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
        F.round(F.avg("conf") / 100, 6).alias("confidence"), F.count("*").alias("n_words"),
    )


def polygon_box(points: Column) -> list[Column]:
    """Bounds of a polygon whose array holds x and y in turn."""
    part = lambda k: F.filter(points, lambda _, i: i % 2 == k)
    return [F.array_min(part(0)).alias("x0"), F.array_min(part(1)).alias("y0"), F.array_max(part(0)).alias("x1"), F.array_max(part(1)).alias("y1")]


def contained(documents: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """documents(doc_id), their pages and the pages' elements -> doc_id, pages (page_number, elements in order)."""
    own = elements.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("elem_no", "content_type"))).alias("elements"))
    filled = pages.select("doc_id", "page_number").join(own, ["doc_id", "page_number"], "left")
    page = F.struct("page_number", F.coalesce("elements", F.array().cast("array<struct<elem_no:int,content_type:string>>")).alias("elements"))
    listed = filled.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return documents.select("doc_id").join(listed, "doc_id", "left")
