"""Code regions, their language, and their rendering."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import count, has, holds, letter_runs, strip
from ..sources.corpus import join_lines

# Language patterns with weights, in the order that settles ties.
LANGUAGES = {
    "python": [("\\b(def|class|import|from|if __name__|elif|try|except|finally|with|yield|lambda|async|await)\\b", 3.0), ("\\b(print|len|range|list|dict|str|int|float|bool|set|tuple|open|input|type|isinstance|super)\\b", 2.0), ("#.*\\z", 1.0), ("\\A\\s+", 1.0), ("\\w+\\s*\\([^)]*\\)\\s*:", 2.5)],
    "javascript": [("\\b(function|var|let|const|if|else|for|while|do|switch|case|break|continue|return|try|catch|finally|throw|new|this|typeof|instanceof)\\b", 3.0), ("\\b(console|document|window|Array|Object|String|Number|Boolean|Date|RegExp|Math|JSON)\\b", 2.0), ("//.*\\z|/\\*[\\s\\S]*?\\*/", 1.0), ("\\s*=>\\s*", 2.0)],
    "java": [("\\b(public|private|protected|static|final|abstract|class|interface|extends|implements|import|package|void|int|String|boolean)\\b", 3.0), ("@\\w+", 2.0), ("\\b(public|private|protected)\\s+\\w+\\s+\\w+\\s*\\([^)]*\\)\\s*(throws\\s+\\w+\\s*)?\\{", 1.0)],
    "c": [("\\b(include|stdio|stdlib|string|math|int|char|float|double|void|if|else|for|while|do|switch|case|break|continue|return|struct|typedef|enum)\\b", 3.0), ("#include\\s*[<\"][^>\"]+[>\"]", 3.0), ("\\*\\w+|\\w+\\*", 1.5), ("\\w+\\s*\\([^)]*\\)\\s*;", 2.5)],
    "csharp": [("\\b(public|private|protected|internal|static|readonly|const|virtual|override|abstract|sealed|class|interface|namespace|using|var|void|int|string|bool|double)\\b", 3.0), ("\\w+\\s*\\{\\s*get;\\s*set;\\s*\\}", 2.0), ("\\b(from|where|select|orderby|group|join)\\b", 2.0)],
    "php": [("<\\?php|\\?>", 4.0), ("\\b(function|class|if|else|elseif|for|foreach|while|do|switch|case|break|continue|return|try|catch|finally|throw|new|this)\\b", 3.0), ("\\$\\w+", 2.0), ("array\\s*\\(|\\[.*?\\]", 1.5)],
    "ruby": [("\\b(def|class|module|if|unless|else|elsif|case|when|while|until|for|do|break|next|return|yield|begin|rescue|ensure|end|require|include)\\b", 3.0), (":\\w+", 2.0), ("\\{.*?\\}|do\\s+.*?\\s+end", 1.5), ("#\\{.*?\\}", 1.5)],
    "go": [("\\b(func|package|import|type|struct|interface|var|const|if|else|for|switch|case|default|break|continue|return|go|select|defer|chan)\\b", 3.0), ("\\b(int|string|bool|float64|error|map|slice)\\b", 2.0), ("func\\s+\\w+\\s*\\([^)]*\\)", 2.5)],
    "rust": [("\\b(fn|let|mut|const|static|if|else|match|for|while|loop|break|continue|return|struct|enum|impl|trait|mod|use|pub|crate|super)\\b", 3.0), ("'\\w+", 2.0), ("Some\\(|None|Ok\\(|Err\\(|Result<", 2.5), ("\\w+\\s*!", 2.0)],
    "sql": [("(?i)\\b(SELECT|FROM|WHERE|INSERT|UPDATE|DELETE|CREATE|TABLE|ALTER|DROP|INDEX|JOIN|INNER|LEFT|RIGHT|OUTER|GROUP|BY|ORDER|HAVING|UNION|DISTINCT|COUNT|SUM|AVG|MAX|MIN)\\b", 3.0), ("(?i)\\b(COUNT|SUM|AVG|MAX|MIN|UPPER|LOWER|SUBSTRING|CONCAT|COALESCE|CAST)\\b", 2.5), ("(?i)\\b(AND|OR|NOT|IN|EXISTS|BETWEEN|LIKE|IS NULL|IS NOT NULL)\\b", 2.0)],
    "bash": [("\\A#!\\s*/bin/bash|\\A#!\\s*/bin/sh", 4.0), ("\\b(if|then|else|elif|fi|for|while|do|done|case|esac|function|return|exit|echo|read|cd|ls|grep|sed|awk)\\b", 3.0), ("\\$\\{?\\w+\\}?", 2.0), ("\\|", 1.0), ("[<>]{1,2}", 1.0)],
    "json": [("\\{.*\\}|\\[.*\\]", 1.0), ("\"[^\"]*\"", 0.5), (":\\s*", 0.5), (",\\s*", 0.5)],
    "yaml": [("\\A\\s*\\w+\\s*:", 2.0), ("\\A\\s*-\\s+", 1.5), ("#.*\\z", 1.0), ("\"[^\"]*\"|'[^']*'", 0.5)],
}
LINE_PATTERNS = [
    "\\A<s>*(def|function|class|public|private|protected|if|for|while|do|switch|case)<s>*<w>", "\\A<s>*(import|include|using|from)<s>+", "\\A<s>*(var|let|const)<s>+<w>+<s>*=", "\\A<s>*<w>+<s>*\\([^)]*\\)<s>*(\\{|:)",
    "\\A<s>*#<s>*include<s>*[<\"]", "\\A<s>*<\\?php", "\\A<s>*#!<s>*/bin/(bash|sh)", "\\A<s>*package<s>+<w>+", "\\A<s>*func<s>+<w>+<s>*\\(", "\\A<s>*<w>+<s>*:<s>*<w>+", "\\A<s>*-<s>+<w>+", "\\A<s>*['\"\\[]<w>+['\"]<s>*:",
]
OPERATORS = ["==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "&&", "||", "->", "=>", "::", "..."]


#: All of them begin at the line's first sign, so they are tried as one.
LINE_START = "\\A<s>*"
LINE_PATTERN = f"{LINE_START}(?:{'|'.join(p.removeprefix(LINE_START) for p in LINE_PATTERNS)})"


def is_code_line(line: Column) -> Column:
    signs = has(line, "[(){}\\[\\]<>]|[;,]<s>*\\z") | holds(line, *OPERATORS)
    return has(line, "\\A<s>*[^\\t-\\r \\x1c-\\x1f\\x85\\p{Z}]") & (signs | has(line, LINE_PATTERN))


def gather(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line) -> doc_id, lines: an array of (line_no, line) in order."""
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))


def code_pieces(blocks: DataFrame, min_lines: int = 3) -> DataFrame:
    """doc_id, lines -> doc_id, piece (a part of the lines), code: null but for regions.

    A region is a run of code lines; a blank line neither ends a run nor
    begins one, any other line ends it.  Runs that span ``min_lines`` or more
    are regions.  The pieces cover all lines.
    """
    letter = lambda x: F.when(is_code_line(x["line"]), "c").when(strip(x["line"]) == "", "b").otherwise("o")
    runs = blocks.select("doc_id", "lines", F.explode(letter_runs(F.col("lines"), letter, "c(?:[cb]*c)?|[^c]+")).alias("run"))
    cut = runs.select("doc_id", F.slice("lines", F.col("run.start") + 1, F.col("run.size")).alias("piece"), (F.col("run.letter") == "c").alias("is_code"))
    span = F.element_at("piece", -1)["line_no"] - F.col("piece")[0]["line_no"] + 1
    return cut.select("doc_id", "piece", F.when(F.col("is_code") & (span >= min_lines), F.array_join(F.transform("piece", lambda x: x["line"]), "\n")).alias("code"))


def code_regions(lines: DataFrame, min_lines: int = 3) -> DataFrame:
    """lines(doc_id, line_no, line) -> doc_id, start_line, end_line, code."""
    found = code_pieces(gather(lines), min_lines).where("code IS NOT NULL")
    return found.select("doc_id", F.col("piece")[0]["line_no"].alias("start_line"), F.element_at("piece", -1)["line_no"].alias("end_line"), "code")


#: A pattern that is nothing but a list of words, some in any case.
WORDS = re.compile(r"(\(\?i\))?\\b\(([\w |]+)\)\\b")


def matches(code: Column, tokens: Column, pattern: str) -> Column:
    """Matches of a pattern; the words of a list are looked up among the tokens, phrases searched for."""
    found = WORDS.fullmatch(pattern)
    if not found:
        return count(code, pattern)
    words = found[2].split("|")
    single = {w for w in words if " " not in w}
    own = F.size(F.filter(tokens, lambda t: (F.upper(t) if found[1] else t).isin(*({w.upper() for w in single} if found[1] else single))))
    return reduce(add, [count(code, f"{found[1] or ''}\\b{w}\\b") for w in words if " " in w], own)


def code_tokens(code: Column) -> Column:
    """The words of a block, as a pattern's word ends see them."""
    return F.split(code, "[^\\p{L}\\p{N}_]+")


def language_score(code: Column, tokens: Column, rules: list[tuple[str, float]]) -> Column:
    """Weighted matches of a language's patterns for each word of the code."""
    pieces = F.size(F.filter(F.split(code, "\\s+"), lambda w: w != ""))
    return F.round(reduce(add, [matches(code, tokens, p) * w for p, w in rules]) / F.greatest(pieces, F.lit(1)), 6)


def best_language(code: Column, tokens: Column) -> Column:
    """(score, order, name): the highest score, the first declared on ties."""
    return F.greatest(*[F.struct(language_score(code, tokens, rules).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, rules) in enumerate(LANGUAGES.items())])


def with_language(regions: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Regions with language and confidence of their code; below the threshold unknown and 0."""
    tokens = regions.withColumn("tokens", code_tokens(F.col("code")))
    found = tokens.withColumn("best", best_language(F.col("code"), F.col("tokens")))
    sure = (F.col("best.score") >= threshold) & (strip(F.col("code")) != "")
    return found.select(*regions.columns, F.when(sure, F.col("best.name")).otherwise("unknown").alias("language"), F.when(sure, F.col("best.score")).otherwise(0.0).alias("confidence"))


def code_blocks(lines: DataFrame, threshold: float = 0.6, min_lines: int = 3) -> DataFrame:
    """Code regions with their language and confidence."""
    return with_language(code_regions(lines, min_lines), threshold)


def fenced(code: Column, language: Column, confidence: Column, numbered: bool = False, max_chars: int = 1000, keep_lines: int = 50, threshold: float = 0.6) -> Column:
    """A fence for sure blocks, else each line in backticks.

    Lines may be numbered; blocks of over ``max_chars`` end after
    ``keep_lines`` lines with a mark.
    """
    lines = F.split(code, "\n")
    if numbered:
        lines = F.transform(lines, lambda x, i: F.concat(F.when(i < 999, F.lpad((i + 1).cast("string"), 3, " ")).otherwise((i + 1).cast("string")), F.lit(" | "), x))
    body = F.array_join(lines, "\n")
    short = F.array_join(F.concat(F.slice(lines, 1, keep_lines), F.array(F.lit("... (truncated)"))), "\n")
    inline = F.array_join(F.transform(F.split(code, "\n"), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), "\n")
    name = F.when(language == "unknown", "").otherwise(language)
    fence = F.concat(F.lit("```"), name, F.lit("\n"), F.when(F.length(body) > max_chars, short).otherwise(body), F.lit("\n```"))
    return F.when(confidence < threshold, inline).otherwise(fence)


def rewritten(blocks: DataFrame, numbered: bool, max_chars: int) -> DataFrame:
    """doc_id, lines -> doc_id, line_no, line with each code region replaced by its rendering, at its first line."""
    found = with_language(code_pieces(blocks))
    block = F.when(F.col("code").isNotNull(), fenced(F.col("code"), F.col("language"), F.col("confidence"), numbered, max_chars))
    shown = found.select("doc_id", "piece", block.alias("block"))
    first = F.array(F.struct(F.col("piece")[0]["line_no"].alias("line_no"), F.col("block").alias("line")))
    return shown.select("doc_id", F.inline(F.when(F.col("block").isNotNull(), first).otherwise(F.col("piece"))))


def rewrite_code(lines: DataFrame, numbered: bool = False, max_chars: int = 1000) -> DataFrame:
    """lines(doc_id, line_no, line) with each code region replaced by its rendering, at its first line."""
    return rewritten(gather(lines), numbered, max_chars)


def format_code(docs: DataFrame, numbered: bool = False, max_chars: int = 1000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text with its code regions rendered; doc_id tells documents apart."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    return join_lines(rewritten(docs.select("doc_id", lines.alias("lines")), numbered, max_chars))
