"""Prompts, headers, keys, checks and conversions, a column for each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import symbols_to_latex
from .patterns import count, has, strip, swap

# Prompts by mode, what is added to them, and what a failed page says.
PAGE_PROMPT = "Convert this PDF page to well-formatted markdown. Preserve the layout, tables, mathematical formulas, and code blocks. Use proper markdown formatting for headings, lists, and other elements."
PROMPT_TOGGLES = {"tables": " Pay special attention to preserving table structures.", "math": " Convert mathematical expressions to LaTeX format.", "code": " Identify and format code blocks with appropriate syntax highlighting."}
HYBRID_PROMPT = (
    "I have extracted the following text from this PDF page: ",
    "\n\nPlease analyze the page image and convert it to well-formatted markdown. Use the extracted text as reference but preserve the exact visual layout. Format tables properly, convert mathematical formulas to LaTeX, and identify code blocks with appropriate syntax highlighting.",
)
TEXT_PROMPT = "Format the provided text into well-structured markdown."
INSTRUCTIONS = "\n\nAdditional instructions:\n- Use proper markdown formatting (# for headings, * for emphasis)\n- Preserve table structures using markdown table syntax\n- Convert mathematical expressions to LaTeX format ($...$)\n- Identify and format code blocks with ```language ...```\n- Maintain the original document structure and hierarchy"
UNABLE = "*Unable to process this page. The content could not be extracted or analyzed.*"
# Names of models that see, language codes of two engines, image formats that turn into others, symbols of equations.
VISION_MODELS = ["llava", "llava-llama3", "llava-phi3", "minicpm-v", "moondream", "cogvlm", "qwen2-vl", "qwen2.5-vl"]
LIST_LANGUAGES = {"eng": "en", "spa": "es", "fra": "fr", "deu": "de", "ita": "it", "por": "pt", "rus": "ru", "jpn": "ja", "kor": "ko", "chi_sim": "zh_sim", "chi_tra": "zh_tra", "ara": "ar", "hin": "hi", "tha": "th"}
ONE_LANGUAGE = {"eng": "en", "chi_sim": "ch", "chi_tra": "chinese_cht", "jpn": "japan", "kor": "korean", "spa": "en", "fra": "en", "deu": "en", "ita": "en", "por": "en"}
CONVERSIONS = {"PNG": ["JPEG", "WEBP"], "JPEG": ["PNG", "WEBP"], "WEBP": ["PNG", "JPEG"], "BMP": ["PNG", "JPEG", "WEBP"], "TIFF": ["PNG", "JPEG", "WEBP"]}
EQUATION_SYMBOLS = [("≤", "\\leq"), ("≥", "\\geq"), ("≠", "\\neq"), ("≈", "\\approx"), ("∞", "\\infty"), ("π", "\\pi"), ("√", "\\sqrt{}")]
MAX_UPLOAD = 50 * 1024 * 1024


def page_prompt(tables: Column, math: Column, code: Column) -> Column:
    """What a page model is asked, with a sentence for each kind of content to keep."""
    parts = [F.when(c, F.lit(PROMPT_TOGGLES[k])).otherwise("") for k, c in (("tables", tables), ("math", math), ("code", code))]
    return F.concat(F.lit(PAGE_PROMPT), *parts)


def default_prompt(mode: Column, text: Column) -> Column:
    """The prompt of a processing mode: vision_only, hybrid, or text."""
    hybrid = F.concat(F.lit(HYBRID_PROMPT[0]), F.coalesce(text, F.lit("")), F.lit(HYBRID_PROMPT[1]))
    return F.when(mode == "vision_only", PAGE_PROMPT).when(mode == "hybrid", hybrid).otherwise(TEXT_PROMPT)


def enhanced_prompt(prompt: Column, text: Column, mode: Column) -> Column:
    """A prompt behind the extracted text (in hybrid mode) and before the instructions."""
    known = (mode == "hybrid") & (F.coalesce(text, F.lit("")) != "")
    return F.concat(F.when(known, F.concat(F.lit("Extracted text: "), text, F.lit("\n\n"))).otherwise(""), prompt, F.lit(INSTRUCTIONS))


def fallback_content(name: Column, text: Column) -> Column:
    """What stands for a page whose model gave nothing: its own text, or that there is none."""
    body = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("## Extracted Text\n\n"), text)).otherwise(UNABLE)
    return F.concat(F.lit("# Page "), F.coalesce(name, F.lit("Unknown")), F.lit("\n\n"), body)


def raw_fallback(page_number: Column, text: Column) -> Column:
    """A page (numbered from 0) as its raw text under a heading."""
    return F.concat(F.lit("# Page "), (page_number + 1).cast("string"), F.lit("\n\n"), F.coalesce(F.nullif(text, F.lit("")), F.lit("*Content extraction failed*")))


def supports_vision(name: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.lower(name).contains(m) for m in VISION_MODELS])


def ocr_valid(confidence: Column, text: Column, threshold: float = 0.5) -> Column:
    return (confidence >= threshold) & (strip(F.coalesce(text, F.lit(""))) != "")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def list_languages(codes: Column, supported: list[str]) -> Column:
    """The codes of an engine that takes several: unsupported ones are dropped; none left: English."""
    known = _map(LIST_LANGUAGES)
    mapped = F.filter(F.transform(codes, lambda c: F.coalesce(F.try_element_at(known, c), c)), lambda c: c.isin(*supported))
    return F.when(F.size(mapped) > 0, mapped).otherwise(F.array(F.lit("en")))


def one_language(code: Column) -> Column:
    """The code of an engine that takes one; others are English."""
    return F.coalesce(F.try_element_at(_map(ONE_LANGUAGE), code), F.lit("en"))


def document_header(title: Column, stem: Column, author: Column, created: Column, pages: Column) -> Column:
    """The title (else the file's name), and what is known of the document if it has an author or a date."""
    named = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), x))
    known = (F.coalesce(author, F.lit("")) != "") | (F.coalesce(created, F.lit("")) != "")
    parts = [F.lit("## Document Information"), named("Author", author), named("Created", created), F.when(pages > 0, F.concat(F.lit("**Pages:** "), pages.cast("string")))]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce(F.nullif(title, F.lit("")), stem)), *[F.when(known, p) for p in parts])


def table_to_text(rows: Column) -> Column:
    """Rows of cells as lines with pipes between cells; empty rows are dropped, missing cells are empty."""
    filled = F.filter(rows, lambda r: F.coalesce(F.size(r), F.lit(0)) > 0)
    return F.array_join(F.transform(filled, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def latex_ok(text: Column, escaped_dollars: bool = True) -> Column:
    """Whether LaTeX looks right: something there, pairs balanced, no dollar sign after anything but a backslash, no double backslash at the end.

    That rule refuses every ``$x$``; without ``escaped_dollars`` a dollar sign
    only needs a partner.
    """
    pairs = [("\\\\\\(", "\\\\\\)"), ("\\\\\\[", "\\\\\\]"), ("\\{", "\\}")]
    balanced = reduce(lambda x, y: x & y, [count(text, a) == count(text, b) for a, b in pairs])
    dollars = ~has(text, "[^\\\\]\\$", "s") if escaped_dollars else count(text, "\\$") % 2 == 0
    return (F.length(text) > 0) & balanced & dollars & ~has(text, "\\\\\\\\\\n?\\z")


def to_latex(text: Column, spans: Column) -> Column:
    """The LaTeX of the first recognised expression, else the text with its symbols replaced."""
    return F.coalesce(F.get(spans, F.lit(0))["latex"], symbols_to_latex(text))


def equation_to_latex(text: Column) -> Column:
    """Symbols, fractions and implied products of an equation."""
    out = text
    for symbol, name in EQUATION_SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(name))
    out = swap(out, "(<w>+)<s>*/<s>*(<w>+)", "\\\\frac{$1}{$2}")
    return swap(out, "(\\d)([a-zA-Z])", "$1 \\\\cdot $2")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of named values, names in order, a blank after each colon and comma."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")
    parts = [F.concat(F.lit(f'"{name}": '), value(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def cache_key(value: Column | dict[str, Column]) -> Column:
    """SHA-256 of a text, or of the canonical JSON of named values."""
    return F.sha2(canonical_json(value) if isinstance(value, dict) else value, 256)


def short_key(value: Column | dict[str, Column]) -> Column:
    return F.left(cache_key(value), F.lit(16))


def image_key(path: Column, modified: Column, params: dict[str, Column]) -> Column:
    """Half an MD5 of an image's place, age and parameters."""
    return F.left(F.md5(canonical_json({"path": path, "mtime": modified} | {f"params.{k}": v for k, v in params.items()})), F.lit(16))


def can_convert(source: Column, target: Column) -> Column:
    """Whether an image format turns into another."""
    table = F.create_map(*[x for k, v in CONVERSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    reachable = F.coalesce(F.array_contains(F.try_element_at(table, F.upper(source)), F.upper(target)), F.lit(False))
    return (F.upper(source) == F.upper(target)) | reachable


def upload_report(name: Column, size: Column, available: Column, vision_custom: Column, max_bytes: int = MAX_UPLOAD) -> Column:
    """Struct of is_valid, errors, warnings and size in MB; ``available`` is null if nobody could tell."""
    errors = F.array_compact(F.array(F.when(~F.lower(name).endswith(".pdf"), "not a pdf"), F.when(size > max_bytes, "too large"), F.when(~available, "backend not available")))
    warnings = F.array_compact(F.array(F.when(available.isNull(), "backend not verified"), F.when(vision_custom, "vision may not be supported")))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"), F.round(size / (1024 * 1024), 2).alias("size_mb"))


def encode_image(content: Column) -> Column:
    return F.translate(F.base64(content), "\r\n", "")


def decode_image(encoded: Column) -> Column:
    """The bytes of an encoded image, with or without a data URL's head."""
    return F.unbase64(F.regexp_replace(encoded, "^data:[^,]*,", ""))


def clamped_range(page: Column, first: int, last: int, pages: Column) -> Column:
    """Whether a page (from 0) lies in first..last, cut to the pages that there are."""
    return page.between(F.greatest(F.lit(0), F.lit(first)), F.least(pages - 1, F.lit(last)))


def better_text(a: Column, b: Column) -> Column:
    """The longer of two extractions, the first on ties; what failed is empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def file_problem(path: Column, size: Column, head: Column, max_bytes: int = 52_428_800, suffix: str = ".pdf", magic: str = "%PDF") -> Column:
    """Why a file is not taken (null: it is): suffix, kind of content by the suffix, emptiness, size, first bytes."""
    return (
        F.when(~F.lower(path).endswith(suffix), "suffix").when(size > max_bytes, "too large").when(size == 0, "empty")
        .when(F.substring(head, 1, len(magic)) != F.encode(F.lit(magic), "UTF-8"), "header")
    )


# Kinds of content by a file's ending.
MIME = {".pdf": "application/pdf", ".html": "text/html", ".htm": "text/html", ".txt": "text/plain", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".json": "application/json", ".xml": "text/xml", ".csv": "text/csv", ".zip": "application/zip"}


def guessed_mime(path: Column) -> Column:
    """The kind of content that a path's ending stands for; null if it is not known."""
    kinds = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.element_at(kinds, F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1)))


def input_error(path: Column, size: Column, formats: tuple[str, ...] = (".pdf",), mime: str = "application/pdf", max_bytes: int = 52_428_800) -> Column:
    """Null for a file that is taken, else its error: code, message and context (JSON), by ending, kind of content, size and emptiness.

    A null path, or a null size, is a file that is not there.
    """
    ending = F.regexp_extract(path, "(\\.[^./]*)$", 1)
    kind = guessed_mime(path)
    message = (
        F.when(path.isNull() | size.isNull(), F.concat(F.lit("File not found: "), F.coalesce(path, F.lit(""))))
        .when(~F.lower(ending).isin(*formats), F.concat(F.lit("Unsupported file format: "), ending, F.lit(f". Supported formats: {', '.join(formats)}")))
        .when(kind != mime, F.concat(F.lit("File does not appear to be a PDF: "), kind))
        .when(size > max_bytes, F.concat(F.lit("File too large: "), F.format_number(size, 0), F.lit(f" bytes (max: {max_bytes:,} bytes)")))
        .when(size == 0, F.lit("File is empty"))
    )
    context = F.to_json(F.struct(path.alias("path"), size.alias("size")))
    return F.when(message.isNotNull(), F.struct(F.lit("VALIDATION_ERROR").alias("code"), message.alias("message"), context.alias("context")))
