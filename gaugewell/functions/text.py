"""Text and HTML expressions: cleaning, feature counts, ordered rules and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits that results depend on.
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
TAG = r"<[^>]+>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
QUESTION = r"""(?is)class=["']question["'][^>]*>(.*?)</div>"""
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
TITLE = r"(?is)<title>(.*?)</title>"
NUMBER = r"[0-9]+\.?[0-9]*"
MATH_SYMBOL = r"[+\-*/=<>≤≥^√∑∫πθαβγΔ×÷]|\\frac|\\sqrt"
EQUATION = r"(?:=|\\frac|\\sqrt|\$[^$]+\$)"
SENTENCE_END = r"[.!?。！？]"
FIGURE_REFERENCE = r"(如图|图中|下图|上图|见图)"
IMAGE_PLACEHOLDER = r"question_[0-9]+-image_[0-9]+"
TEMPLATE = r"(\{\{|\[\[\[|[A-Z]_COEFF)"
OPTION_MARK = r"A[\.、．]"
LATEX = r"\\[a-zA-Z]+|\$"
DYNAMIC = r"<var\s+id="
IMAGE = r"(?i)<img\s"
CHOICES = r"""(?i)class=["']choices["']|multiple_choice"""
MATH_CHARACTERS = r"[0-9+\-*/=^\\()∫∑]"
MATH_TERMS = ("方程", "函数", "三角", "圆", "角", "分数", "小数", "代数", "几何", "微积", "概率", "统计", "乘", "除", "相似", "抛物线", "多项式")
CJK = r"[\x{4e00}-\x{9fff}]"
SHORTEST, TRUNCATED, LONGEST = 8, 15, 1200
SCORE = r"(?:0?\.[0-9]+|1\.0*|0|1)"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, the common entities decoded, blanks squeezed."""
    for pattern in (SCRIPT, STYLE, TAG):
        html = F.regexp_replace(html, pattern, " ")
    for name, character in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(character))
    return squeezed(html)


def matches(text: Column, pattern: str) -> Column:
    """Number of matches of a pattern; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def first_rule(rules: tuple[tuple[str, Column], ...], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    name, condition = rules[0]
    chain = F.when(condition, name)
    for name, condition in rules[1:]:
        chain = chain.when(condition, name)
    return chain.otherwise(otherwise)


def all_flags(flags: tuple[tuple[str, Column], ...]) -> Column:
    """The names of all flags that hold, joined by a pipe."""
    return F.array_join(F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in flags])), "|")


def parse_score(text: Column) -> Column:
    """The first number like 0.42, .5, 1.0, 0 or 1 in a text, clamped to [0, 1]; null without any."""
    score = F.regexp_extract(text, SCORE, 0).try_cast("double")
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def int_list(column: Column | str, before: str | None = None) -> Column:
    """Whole numbers of a comma list, null for each token that is none; with ``before``, of what stands before that in a token.

    A null text gives null. Blanks around a token do not count.
    """
    token = (lambda x: F.substring_index(x, before, 1)) if before else (lambda x: x)
    return F.transform(F.split(column, ","), lambda x: F.trim(token(x)).try_cast("long"))


def zero_failures(numbers: Column) -> Column:
    """The list with 0 for each null."""
    return F.transform(numbers, lambda x: F.coalesce(x, F.lit(0)))
