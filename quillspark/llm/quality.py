"""Quality rules: document measures and cross-document line frequency.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialise

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Low bits of a packed window that hold its place in the document; longer documents are sorted by their words.
PLACE_BITS = 26

#: A line of a host goes if more than this many of its documents have it ...
LINE_DOCS = 10
#: ... and more than this share of them.
LINE_SHARE = 0.02
#: Documents that lose more than this share of their line characters are depleted.
DEPLETED = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def word_array(text: Column) -> Column:
    """Words of a text; none for a blank one."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def covered(places: Column) -> Column:
    """How many words three-word windows at these places (ascending) cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def twins(rows: Column, links: Column, place: Callable[[Column], Column]) -> Column:
    """Places, ascending, of the sorted rows that equal a neighbour; link k is 1 if row k equals the one before."""
    equal = lambda _, k: (F.get(links, k) == 1) | (F.coalesce(F.get(links, k + 1), F.lit(0)) == 1)
    return F.sort_array(F.transform(F.filter(rows, equal), place))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the array.

    Windows are hashed into the upper bits of a number that holds their place
    in the lower ones.  Sorted, equal windows are neighbours, and neighbours
    of equal hash are compared word by word.  Should two of them differ, the
    windows of that document are sorted by their words instead.
    """
    low = (1 << PLACE_BITS) - 1

    def measure(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - 3)
        window = lambda i: [F.get(w, i + k) for k in range(3)]
        packed = F.transform(every, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

        def same(a: Column, b: Column) -> Column:
            i, j = (x.bitwiseAND(F.lit(low)).cast("int") for x in (a, b))
            equal = F.get(w, i) == F.get(w, j)
            for k in (1, 2):
                equal = equal & (F.get(w, i + k) == F.get(w, j + k))
            return F.when(F.shiftright(a, PLACE_BITS) != F.shiftright(b, PLACE_BITS), 0).when(equal, 1).otherwise(2)

        def hashed(s: Column) -> Column:
            links = F.transform(s, lambda x, k: F.when(k == 0, 0).otherwise(same(x, F.get(s, k - 1))))
            place = lambda x: x.bitwiseAND(F.lit(low))
            return let(links, lambda n: F.struct(F.array_contains(n, 2).alias("clash"), covered(twins(s, n, place)).alias("n")))

        def by_words(s: Column) -> Column:
            alike = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
            links = F.transform(s, lambda x, k: F.when((k > 0) & alike(x, F.get(s, k - 1)), 1).otherwise(0))
            return let(links, lambda n: covered(twins(s, n, lambda x: x["i"].cast("long"))))

        exact = let(F.sort_array(F.transform(every, lambda i: F.struct(*[x.alias(n) for x, n in zip(window(i), "abc", strict=True)], i.alias("i")))), by_words)
        fast = let(F.sort_array(packed), hashed)
        either = let(fast, lambda f: F.when(f["clash"], exact).otherwise(f["n"]))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).when(F.size(w) > low, exact).otherwise(either)

    return let(words, measure)


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text; a null one counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    both = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    return {
        "counted": both,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    }


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def plain_line(line: Column) -> Column:
    """A line as it is compared: lower case, digits as 0, blanks around it cut."""
    return F.trim(F.translate(F.lower(line), "123456789\t\x0b\x0c\r", "0" * 9 + " " * 4))


def line_rows(text: Column) -> Column:
    """(hash, characters) of each line with a word."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), plain_line), lambda x: F.length(x) > 0)
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("chars")))


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED, carry: bool = False) -> DataFrame:
    """docs(doc_id, text, source) -> measures, base_failed, removed, removed_chars, line_chars, kept.

    A document's host is its source.  Lines are hashed, and the documents of
    a host that have a line are counted (each document once); lines above
    both limits are removed (``removed``: their hashes), and documents that
    lose over ``depleted`` of their line characters are rejected, as are
    those that fail the base rules.  Null sources are one host; a null text
    has no words and fails; repeated rows are separate documents; an empty
    table gives an empty result; other columns are not read, unless ``carry``
    asks for them: then rows that fail the base rules are left out, and
    ``kept_row`` holds all columns of the others.
    """
    source = [F.struct(*docs.columns).alias("kept_row")] if carry else []
    own = docs.select(F.col("doc_id"), F.col("source"), *source, line_rows(F.col("text")).alias("lines"), *[c.alias(n) for n, c in measures(F.col("text")).items()])
    own = own.withColumns({"row": F.monotonically_increasing_id(), "n_words": F.col("counted.n"), "n_repeat_words": F.col("counted.repeat")}).drop("counted")
    own = own.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))
    if carry:  # texts of documents that fail are not written, but their lines count
        own = own.withColumn("kept_row", F.when(~F.col("base_failed"), F.col("kept_row")))
    own = materialise(own, "measures")
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("host")
    sizes = own.groupBy(host).agg(F.count("*").alias("docs"))
    counts = own.select(host, F.explode(F.array_distinct("lines.hash")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") > line_docs).join(sizes, "host").where(F.col("n") > line_share * F.col("docs"))
    frequent = materialise(frequent.select("host", "hash"), "frequent")
    rows = (own.where("NOT base_failed") if carry else own).select("row", host, F.inline("lines"))
    removed = rows.join(frequent, ["host", "hash"]).groupBy("row").agg(F.sum("chars").alias("removed_chars"), F.collect_set("hash").alias("removed"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    judged = (own.where("NOT base_failed") if carry else own).join(removed, "row", "left")
    judged = judged.withColumns({"removed_chars": F.coalesce("removed_chars", F.lit(0).cast("long")), "line_chars": total})
    kept = ~F.col("base_failed") & (F.col("removed_chars") <= depleted * F.col("line_chars"))
    return judged.withColumn("kept", kept).drop("row", "lines")


def op7_quality(docs: DataFrame) -> DataFrame:
    """The contract's result, one row for each document."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, clean: bool = True) -> DataFrame:
    """The documents that pass, with all their columns; nulls, ties and repeated rows as in ``judge``.

    With ``clean``, the lines that are too frequent at the document's host
    are cut out of its text; everything else in it stays as it is.
    """
    passed = judge(docs, carry=True).where("kept")
    text = F.col("kept_row.text")
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(plain_line(x))))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n"))
    return passed.select(*[cleaned.alias(c) if c == "text" and clean else F.col("kept_row")[c].alias(c) for c in docs.columns])
