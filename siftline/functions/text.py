"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EMAIL_PATTERN = (
    r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
)
#: The same addresses for Java's matcher, in linear time and without recursion: a run of local characters is tried
#: from its start alone (what follows it is the same from every place in it), and labels are never given back.
_JAVA_EMAIL = r"(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~-])" + EMAIL_PATTERN.replace("~-]+@", "~-]++@")[: -len(")+")] + ")++"
NUMBER_PATTERN = r"(?U)[-+]?\d+(?:[,.]\d+)?"
TRUE_WORDS = ("true", "yes", "in stock", "available", "1")
FALSE_WORDS = ("false", "no", "out of stock", "unavailable", "0")
FORMULA_START = r"(?U)^\s*[=+\-@]"
SAFE_NAME_PATTERN = r"^[a-z][a-z0-9_]{0,63}$"
FORBIDDEN_PATTERN = r"(?i)(selector|xpath|javascript:|<script|\b(shell|sql|python)\b|system prompt|ignore.*instruction)"
#: The same for Java's matcher in linear time: of the instructions to ignore only the first "ignore" of a line is tried.
_JAVA_FORBIDDEN = FORBIDDEN_PATTERN.replace("ignore.*instruction", "(?m:^(?:(?!ignore).)*+ignore.*instruction)")
INJECTION_PATTERN = (
    r"(?i)(?:ignore|disregard|override)\s+(?:all\s+|previous\s+|prior\s+)?instructions?|"
    r"reveal\s+(?:the\s+)?(?:system\s+)?prompt|"
    r"(?:api|access)[ _-]?key|"
    r"bypass\s+(?:a\s+|the\s+)?(?:policy|guardrail|restriction)|"
    r"(?:run|execute)\s+(?:a\s+)?(?:shell|sql|python|javascript)\s+(?:command|code)"
)
FORMAT_ALIASES = {"xlsx": "excel", "md": "markdown"}
NULL_TEXT = "—"


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) as one space, ends trimmed; null as the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def first_email(text: Column) -> Column:
    return F.lower(F.regexp_substr(text, F.lit(_JAVA_EMAIL)))


def number_token(text: Column) -> Column:
    """The first number in the text once thousands commas are gone, as text; null if there is none."""
    return F.regexp_substr(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER_PATTERN))


def boolean_word(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def spreadsheet_safe(text: Column) -> Column:
    """A leading apostrophe before what a spreadsheet would read as a formula."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def html_escape(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def shown(text: Column, null_text: str = NULL_TEXT) -> Column:
    """Text for a document: no NUL characters, a dash for null."""
    return F.coalesce(F.replace(text, F.lit("\x00"), F.lit("")), F.lit(null_text))


def displayed(text: Column) -> Column:
    """Text for a screen: a dash for null and for the empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NULL_TEXT))


def has_injection(text: Column) -> Column:
    return collapse(text).rlike(INJECTION_PATTERN)


def has_forbidden(text: Column) -> Column:
    return text.rlike(_JAVA_FORBIDDEN)


def is_safe_name(text: Column) -> Column:
    return text.rlike(SAFE_NAME_PATTERN)


def output_format(text: Column) -> Column:
    """Lower case, leading dots gone, aliases resolved."""
    plain = F.regexp_replace(F.lower(text), r"^\.+", "")
    out = plain
    for alias, name in FORMAT_ALIASES.items():
        out = F.when(plain == alias, F.lit(name)).otherwise(out)
    return out


def key_tokens(text: str) -> list[str]:
    """Distinct tokens of three or more ASCII letters or digits of a plan text, sorted."""
    import re

    return sorted(set(re.findall(r"[a-z0-9]{3,}", text.lower())))


def matched_tokens(corpus: Column, tokens: list[str]) -> Column:
    """Those of the (sorted) tokens that occur anywhere in the corpus."""
    if not tokens:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(corpus, t))


def relevance(matched: Column) -> Column:
    n = F.size(matched)
    return F.when(n > 0, F.least(F.lit(1.0), F.lit(0.25) + F.lit(0.15) * n)).otherwise(F.lit(0.1))


def is_pagination(text: Column, rel: Column, href: Column) -> Column:
    """A link that says next, or page with a number; href alone never decides."""
    said = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(rel, F.lit(""))))
    return F.contains(said, F.lit("next")) | said.rlike(r"(?U)\bpage\s*\d+\b")


def filename(run_id: Column, extension: Column) -> Column:
    return F.concat(F.lit("validated-export-"), F.left(run_id, F.lit(8)), F.lit("."), extension)
