"""Secret scans: known shapes, and a randomness test battery for the rest.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, prefix_sums

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Candidates of the battery: runs of at least 20 encoding characters.
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: (least length, share of false rejections): the shorter, the weaker the
#: tests are, so uniformity is rejected more readily.
LENGTH_CLASSES = ((20, 0.2), (32, 0.1), (64, 0.05))
#: Symbols that a cell of the chi-squared test is expected to hold at least.
CELL = 5
#: Steps of -ln p; p-values are rounded up to them.
GRID, TOP = 20, 2000
ALPHABETS = (
    ("hex", "^[0-9a-fA-F]+$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Code-point spans (begin, end, match) of all matches, left to right.

    The pieces between matches and the matches themselves give the places as
    running sums of lengths.  With ``group``, only matches whose group has
    ``least`` characters stay.
    """

    def placed(found: Column) -> Column:
        between = F.split(text, pattern)
        sums = lambda m: let(prefix_sums(F.transform(between, lambda s: F.length(s).cast("long"))), lambda gaps: let(prefix_sums(F.transform(m, lambda x: F.length(x).cast("long"))), lambda ends: F.transform(m, lambda x, k: F.struct((F.get(gaps, k) + F.get(ends, k) - F.length(x)).alias("begin"), (F.get(gaps, k) + F.get(ends, k)).alias("end"), x.alias("match")))))
        rows = sums(found)
        if group is not None:
            parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            rows = let(rows, lambda r: let(parts, lambda p: F.filter(r, lambda x, k: F.length(F.get(p, k)) >= least)))
        return rows

    none = F.array().cast("array<struct<begin:bigint,end:bigint,match:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by a rational approximation (error below 1e-7)."""
    x = z / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * series * F.exp(-x * x)


def battery(token: Column) -> Column:
    """p-value of "the token is uniformly random in its encoding".

    The encoding is the smallest alphabet that holds the token.  Three tests
    are combined by Bonferroni: chi-squared over the alphabet, the number of
    runs above and below its middle, and the correlation of neighbours.  The
    chi-squared test puts neighbouring symbols together into a power of two
    of cells, so that each may expect CELL symbols or more (two cells at least).

    Symbols are counted by what is left of the token without them, and runs by
    a pattern over a word of two letters, so the work grows with the token.
    """
    chosen = None
    bare = F.regexp_replace(token, "=+$", "")
    for name, shape, alphabet in ALPHABETS:
        body = F.lower(bare) if name == "hex" else F.translate(bare, "-_", "+/") if name == "base64" else bare
        halves = "L" * (len(alphabet) // 2) + "H" * (len(alphabet) // 2)
        found = F.struct(body.alias("body"), F.lit(alphabet).alias("alphabet"), F.translate(body, alphabet, halves).alias("halves"))
        chosen = F.when(token.rlike(shape), found) if chosen is None else chosen.when(token.rlike(shape), found) if shape else chosen.otherwise(found)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)

    def tests(c: Column) -> Column:
        n, k = F.length(c["body"]).cast("double"), F.length(c["alphabet"])
        seen = F.transform(F.split(c["alphabet"], ""), lambda y: (n - F.length(F.replace(c["body"], y, F.lit("")))).cast("double"))
        values = F.transform(F.split(c["body"], ""), lambda y: (F.instr(c["alphabet"], y) - 1).cast("double"))
        runs = F.regexp_count(c["halves"], F.lit("L+|H+")).cast("double")
        return let(F.struct(n.alias("n"), k.alias("k"), seen.alias("seen"), values.alias("x"), runs.alias("runs")), combined)

    def combined(v: Column) -> Column:
        n, k, x = v["n"], v["k"], v["x"]
        cells = F.greatest(F.lit(2.0), F.least(k.cast("double"), F.pow(F.lit(2.0), F.floor(F.log2(n / CELL)))))
        moments = F.struct(
            cells.alias("cells"),
            total(F.slice(v["seen"], (k / 2).cast("int") + 1, k)).alias("high"),
            (total(x) / n).alias("mean"),
            total(F.transform(v["seen"], lambda m, y: m * y * y)).alias("squares"),
            total(F.transform(x, lambda y, i: y * F.coalesce(F.get(x, i - 1), F.lit(0.0)))).alias("products"),
            (F.get(x, F.lit(0)) + F.element_at(x, -1)).alias("ends"),
        )
        return let(moments, lambda m: F.least(F.lit(1.0), 3 * F.least(p_uniform(v, m["cells"]), p_runs(v, m["high"]), p_serial(v, m))))

    def p_uniform(v: Column, cells: Column) -> Column:
        width = (v["k"] / cells).cast("int")
        counts = F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), lambda s: total(F.slice(v["seen"], s * width + 1, width)))
        df = cells - 1
        # cube-root normal form of the chi-squared statistic
        z = lambda squares: (F.pow(F.greatest((cells * squares / v["n"] - v["n"]) / df, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        return let(z(total(F.transform(counts, lambda c: c * c))), lambda z: F.when(z > 0, normal_tail(z)).otherwise(1.0))

    def p_runs(v: Column, high: Column) -> Column:
        expected = 2 * high * (v["n"] - high) / v["n"] + 1
        variance = lambda e: (e - 1) * (e - 2) / (v["n"] - 1)
        return let(expected, lambda e: F.when(variance(e) > 0, 2 * normal_tail(F.abs(v["runs"] - e) / F.sqrt(variance(e)))).otherwise(0.0))

    def p_serial(v: Column, m: Column) -> Column:
        n, mean = v["n"], m["mean"]
        spread = m["squares"] - n * mean * mean
        joint = m["products"] - mean * (2 * n * mean - m["ends"]) + (n - 1) * mean * mean
        return F.when(spread > 1e-9 * n, 2 * normal_tail(F.abs(joint / spread) * F.sqrt(n))).otherwise(0.0)

    return let(chosen, tests)


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base, candidates; one pass without a shuffle.

    Places in candidates are in code points; each has its length class and
    the grid step of its p-value.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [spans(text, ASSIGN, 2, 6), spans(text, ACCESS), spans(text, HEX)]
    of_kind = lambda k: lambda x: F.struct(x["begin"].alias("begin"), F.lit(k).alias("kind"), x["end"].alias("end"))
    named = [F.transform(s, of_kind(k)) for k, s in enumerate(kinds)]
    base = F.array_sort(F.concat(*named))
    mixed = F.filter(spans(text, CANDIDATE), lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]"))
    length_class = lambda x: F.when(F.length(x["match"]) >= LENGTH_CLASSES[2][0], 2).when(F.length(x["match"]) >= LENGTH_CLASSES[1][0], 1).otherwise(0)
    step = lambda x: F.least(F.lit(TOP), F.floor(-F.log(F.greatest(battery(x["match"]), F.lit(1e-300))) * GRID)).cast("int")
    tested = F.transform(mixed, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), length_class(x).alias("class"), step(x).alias("step")))
    return docs.select("doc_id", base.alias("base"), tested.alias("tested"))


def rejected_from(scanned: DataFrame) -> dict[int, int]:
    """Grid step from which uniformity is rejected, for each length class.

    False-discovery control (step-up) within each class: the least step whose
    p-value is at most the class's share times the tokens rejected at it over
    all tokens.  The driver gets one row for each class.
    """
    steps = scanned.select(F.inline("tested")).groupBy("class", "step").agg(F.count("*").alias("n"))
    order = Window.partitionBy("class").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("at_or_below", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("class")))
    share = F.element_at(F.array(*[F.lit(q) for _, q in LENGTH_CLASSES]), F.col("class") + 1)
    passed = ranked.where(F.exp(-F.col("step") / GRID) <= share * F.col("at_or_below") / F.col("all"))
    return {r["class"]: r.step for r in passed.groupBy("class").agg(F.min("step").alias("step")).collect()}


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base, spans: arrays of (begin, kind, end).

    ``kind`` numbers KINDS.  ``spans`` adds to the base spans the candidates,
    with both letters and digits and outside base spans, whose randomness is
    not rejected.  A null text is empty; repeated rows stay; an empty table
    gives an empty result; other columns are not read.
    """
    scanned = materialise(scan(docs), "scanned")
    limits = rejected_from(scanned)
    steps = F.array(*[F.lit(limits.get(k, TOP + 1)) for k in range(len(LENGTH_CLASSES))])
    limit = lambda c: F.element_at(steps, c + 1)
    random = F.filter("tested", lambda x: (x["step"] < limit(x["class"])) & ~F.exists("base", lambda b: (b["begin"] < x["end"]) & (x["begin"] < b["end"])))
    added = F.transform(random, lambda x: F.struct(x["begin"].alias("begin"), F.lit(3).alias("kind"), x["end"].alias("end")))  # 3: random
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(docs: DataFrame) -> DataFrame:
    """The contract's result, one row for each document."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
