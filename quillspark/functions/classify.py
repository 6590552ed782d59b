"""Row-wise classifiers, scores and clean-ups."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import clamp, count, has, holds, is_upper, match_places, one, strip, swap

# The detectors' patterns and weights.
MATH_PATTERNS = ["\\$[^$]+\\$", "\\\\\\[.*?\\\\\\]", "\\\\\\(.*?\\\\\\)", "<w>+<s>*[=≠≤≥<>]<s>*[\\p{L}\\p{N}_()+\\-*/^]+", "∫.*?dx", "∑.*?=.*", "∂f/∂[a-zA-Z]"]
CODE_PATTERNS = ["def<s>+<w>+<s>*\\(", "function<s>+<w>+<s>*\\(", "class<s>+<w>+", "import<s>+<w>+", "#!/", "<\\?php", "<script", "\\{<s>*\\n.*?\\n<s>*\\}"]
OCR_MATH = ["\\$[^$]+\\$", "\\\\[a-zA-Z]+", "[α-ωΑ-Ω]", "[∑∫∏∂∇]"]
OCR_CODE = ["def ", "function", "var ", "let ", "const ", "import ", "if ", "for "]
OCR_FIXES = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("O", "0"), ("l", "1")]
MARKDOWN = ["# ", "## ", "### ", "#### ", "*", "**", "```", "[", "]", "|", "$", "\n- ", "\n1. "]
SYMBOLS = [("≤", "\\leq"), ("≥", "\\geq"), ("≠", "\\neq"), ("≈", "\\approx"), ("∞", "\\infty"), ("π", "\\pi"), ("α", "\\alpha"), ("β", "\\beta"), ("γ", "\\gamma"), ("δ", "\\delta"), ("θ", "\\theta"), ("λ", "\\lambda"), ("μ", "\\mu"), ("σ", "\\sigma"), ("φ", "\\phi"), ("ω", "\\omega"), ("Δ", "\\Delta"), ("Σ", "\\Sigma"), ("Π", "\\Pi"), ("Ω", "\\Omega"), ("∫", "\\int"), ("∑", "\\sum"), ("∏", "\\prod"), ("∂", "\\partial"), ("∇", "\\nabla")]


def is_table(text: Column) -> Column:
    """Three pipes or more outside headings and list items; the rest is looked at only in texts with pipes."""
    words = F.size(F.filter(F.split(strip(text), "[ \\t\\n]+"), lambda w: w != ""))
    heading = (F.length(text) < 100) & (has(text, "\\A#{1,6}<s>+") | (words < 10) & is_upper(text) | has(text, "\\A[A-Z][a-z\\t-\\r \\p{Z}]+:\\z"))
    item = has(text, "\\A<s>*([-*+•]|\\d+[.)])<s>+")
    return (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 3) & ~(heading | item)


def text_class(text: Column) -> Column:
    """TABLE or TEXT."""
    return F.when(is_table(text), "TABLE").otherwise("TEXT")


def text_confidence(text: Column) -> Column:
    score = F.lit(0.8) - one(is_upper(text) & (F.length(text) > 50), 0.1) - one(F.length(text) < 10, 0.2)
    for letters in ("[l1iI]", "[0oO]", "[rn]"):
        score = score - one(has(text, letters), 0.1)
    return F.when(strip(text) == "", 0.0).otherwise(F.round(clamp(score), 4))


def math_count(text: Column) -> Column:
    """Matches of the patterns of mathematics; texts without any of their signs are not searched."""
    return F.when(text.rlike("[$=≠≤≥<>∫∑∂]|\\\\[\\[(]"), reduce(add, [count(text, p, "ms") for p in MATH_PATTERNS])).when(text.isNotNull(), 0)


def code_score(text: Column) -> Column:
    """Code indicators found, one each; texts without any of their words and signs are not searched."""
    hits = [has(text, p, "mi").cast("int") for p in CODE_PATTERNS]
    hits += [has(text, "^<s>*[}>\\])]<s>*$", "m").cast("int"), holds(text, "for (", "while (", "if (").cast("int")]
    return F.when(text.rlike("(?i)def|function|class|import|#!/|<\\?php|<script|[{}>\\])]|(for|while|if) \\("), reduce(add, hits)).when(text.isNotNull(), 0)


def math_expressions(text: Column) -> Column:
    """(text, start, end) of each mathematical expression, pattern by pattern."""
    found = [F.transform(match_places(text, p, "ms"), lambda x: F.struct(x["match"].alias("text"), x["begin"].alias("start"), x["end"].alias("end"))) for p in MATH_PATTERNS]
    return F.concat(*found)


def element_class(text: Column) -> Column:
    """Tables first, then mathematics, then code among the text that is left."""
    return F.when(is_table(text), "TABLE").when(math_count(text) > 2, "MATHEMATICAL").when(code_score(text) >= 2, "CODE").otherwise("TEXT")


def extraction_quality(a: Column, b: Column) -> Column:
    """Length, agreement and artefacts of two extractions; the later one in string order sets the length."""
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    agreement = F.when((la > 0) & (lb > 0), 1 - F.abs(la - lb) / longest).otherwise(0.5)
    artefacts = count(F.concat(a, b), "[\\x00\\x0c\\x14]")
    return F.round(clamp((F.least(F.length(F.greatest(a, b)) / 1000, F.lit(1.0)) + agreement - artefacts / 100) / 2), 6)


def response_confidence(text: Column, endings: bool = True) -> Column:
    score = F.lit(0.5) + one(holds(text, "##"), 0.1) + one(holds(text, "|"), 0.15) + one(holds(text, "```"), 0.1)
    score = score + one(count(text, "\\$") >= 2, 0.1) + one(F.length(text) > 100, 0.1) - one(F.length(text) < 20, 0.2)
    if endings:
        score = score + one(has(text, "[.!?]\\z"), 0.05)
    return F.when(strip(text) == "", 0.0).otherwise(F.round(clamp(score), 4))


def response_elements(text: Column, lists: bool = True) -> Column:
    tests = [("headings", holds(text, "##")), ("tables", holds(text, "\n|")), ("code", holds(text, "```")), ("math", count(text, "\\$") >= 2), ("formatting", holds(text, "*"))]
    tests += [("lists", holds(text, "\n-"))] if lists else []
    return F.array_compact(F.array(*[F.when(c, n) for n, c in tests]))


def ocr_clean(text: Column) -> Column:
    cleaned = strip(swap(text, "<s>+", " "))
    for old, new in OCR_FIXES:
        cleaned = F.replace(cleaned, F.lit(old), F.lit(new))
    return cleaned


def ocr_class(text: Column, engine: bool = False) -> Column:
    """Content type of recognised text: after clean-up by lines, or as engines do by spaces."""
    cells = has(text, "(\\t|<s>{3,}|,)<s>*<w>+")
    table = cells & (count(text, " ") > 3) if engine else cells & (count(text, "\\n") > 1)
    return F.when(table, "table").when(holds(text, *OCR_CODE, *(["while "] if engine else [])), "code").when(reduce(lambda x, y: x | y, [has(text, p) for p in OCR_MATH]), "math").otherwise("text")


def markdown_tidy(text: Column) -> Column:
    tidy = swap(text, "\\n{3,}", "\n\n")
    tidy = swap(tidy, "\\n(#+)<s>+", "\n$1 ")
    tidy = swap(tidy, "[\\t\\x0b\\x0c\\r \\x1c-\\x1f\\x85\\p{Z}]+$", "", "m")
    tidy = strip(tidy)
    tidy = F.when(tidy.startswith("#"), tidy).otherwise(F.concat(F.lit("# Document\n\n"), tidy))
    return F.concat(tidy, F.lit("\n"))


def output_problem(text: Column) -> Column:
    size = F.length(strip(text))
    return F.when(size == 0, "empty").when(size < 10, "short").when(size > 100_000, "long")


def has_markdown(text: Column) -> Column:
    return holds(text, *MARKDOWN)


def latex_problems(text: Column) -> Column:
    """Unbalanced pairs; a dollar sign needs a partner."""
    pairs = [("braces", "\\{", "\\}"), ("brackets", "\\\\\\[", "\\\\\\]"), ("parens", "\\\\\\(", "\\\\\\)")]
    found = [F.when(count(text, a) != count(text, b), n) for n, a, b in pairs]
    return F.array_compact(F.array(*found, F.when(count(text, "\\$") % 2 == 1, "dollars"), F.when(has(text, "\\\\\\\\\\z"), "line break")))


def symbols_to_latex(text: Column) -> Column:
    out = text
    for symbol, name in SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(name))
    return F.when(out.startswith("$") | out.startswith("\\"), out).otherwise(F.concat(F.lit("$"), out, F.lit("$")))


def complexity(pages: Column) -> Column:
    return F.when(pages > 100, "high").when(pages > 20, "medium").otherwise("low")


def length_class(pages: Column) -> Column:
    return F.when(pages <= 5, "short").when(pages <= 20, "medium").otherwise("long")


def render_seconds(pages: Column, dpi: int = 300) -> Column:
    return pages * 0.5 * dpi / 300


def batch_size(items: Column, workers: int = 4, batch: int = 10) -> Column:
    return F.when(items <= batch, items).otherwise(F.greatest(F.lit(1), F.least(F.floor(items / workers), F.lit(2 * batch))))


def centre(text: Column, width: Column) -> Column:
    """Blanks on both sides; the odd one goes left if the width is odd."""
    gap = width - F.length(text)
    left = F.floor(gap / 2).cast("int") + gap.bitwiseAND(width).bitwiseAND(F.lit(1))
    return F.when(gap > 0, F.concat(F.repeat(F.lit(" "), left), text, F.repeat(F.lit(" "), gap - left))).otherwise(text)


def cut_cell(text: Column, width: Column) -> Column:
    """A cell longer than its column, ended by dots."""
    return F.when(F.length(text) > width, F.concat(F.left(text, width - 3), F.lit("..."))).otherwise(text)


def cell_pad(text: Column, width: Column | int) -> Column:
    """A cell at its width, cut and stripped."""
    width = F.lit(width) if isinstance(width, int) else width
    return padded(strip(cut_cell(text, width)), width)


def padded(t: Column, width: Column) -> Column:
    """Numbers to the right, short single words centred, the rest to the left."""
    left = F.concat(t, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(t))))
    right = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(t))), t)
    return F.when(has(t, "\\A\\d+\\.?\\d*\\z|\\A\\.\\d+\\z"), right).when((F.length(t) < F.floor(width / 2)) & ~t.contains(" "), centre(t, width)).otherwise(left)
