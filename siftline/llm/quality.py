"""Quality rules, native: line-first cleaning in DataFrame functions.

Punctuation, navigation, symbol, shouting and boilerplate rules are evaluated per line,
failing lines are removed, and a document that loses too much of its text is rejected. Base
figures (duplicate lines, words in repeated windows) decide before that. Everything is a
projection over the row: array functions inside the JVM, no Python and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A document stays if its surviving lines hold at least this percentage of its characters.
LEAST_KEPT_PERCENT = 50

# Patterns of the line rules, in syntax that Java and RE2 read alike.
SYMBOL = r"[#*$%&|<>]"
ENDS_WELL = r"[.!?:;…\"”»)\]][\x20\x09-\x0D]*\z"
NAVIGATION = "|»›•·>"
#: A line with this many separators is navigation, with this many pairs of exclamation marks shouting.
MOST_SEPARATORS, MOST_SHOUTS = 2, 2
#: What a text has in lower case if any line of it matches BOILERPLATE.
BOILERPLATE_PARTS = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "lorem ipsum", "click here", "share this", "sign up for our newsletter", "powered by wordpress",
)
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|accept cookies|privacy policy|terms of (use|service)|enable javascript"
    r"|lorem ipsum|click here|share this|sign up for our newsletter|powered by wordpress)"
)
SPACES = " \t\n\u000b\u000c\r"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words that occurs twice or more, from the array of word hashes.

    Most texts repeat no window, which a hash set shows; only the others sort their windows.
    """
    n = F.size(hashes)
    starts = F.sequence(F.lit(0), n - window)
    # Element by element: slice() would copy the whole array for each window.
    key = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])
    keys = F.transform(starts, key)
    placed = F.sort_array(F.transform(starts, lambda i: F.struct(key(i).alias("k"), i.alias("p"))))

    def spread(s: Column) -> Column:
        """Sorted windows to the number of words they cover where a neighbour has the same key."""
        same = F.filter(
            s,
            lambda x, i: (F.get(s, i - 1)["k"] == x["k"]).eqNullSafe(F.lit(True)) | (F.get(s, i + 1)["k"] == x["k"]).eqNullSafe(F.lit(True)),
        )
        at = F.sort_array(F.transform(same, lambda x: x["p"]))
        return let(at, covered)

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1), p + window) - p))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)

    found = let(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k))
    return F.when(n < window, F.lit(0).cast("long")).when(found, let(placed, spread)).otherwise(F.lit(0).cast("long"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def may_have_boilerplate(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for part in BOILERPLATE_PARTS:
        out = out | F.contains(low, F.lit(part))
    return out


def line_passes(line: Column, boilerplate: Column | None = None) -> Column:
    """Whether a line passes all rules; `boilerplate` says if its text may have any, which saves the search where not.

    Separators and shouts are counted by what their removal leaves, not matched as repeated
    groups: Java's matcher recurses for each repetition of a group, and a line may have millions.
    """
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    worn = line.rlike(BOILERPLATE) if boilerplate is None else boilerplate & line.rlike(BOILERPLATE)
    without = lambda marks: F.length(line) - F.length(F.translate(line, marks, ""))
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))
    return (
        line.rlike(ENDS_WELL)
        & (without(NAVIGATION) <= MOST_SEPARATORS)
        & (without("#*$%&|<>") * 10 <= F.length(line))
        # Over half of 20 letters are more than 10 capitals, so most lines end with the first test.
        & ~((capitals > 10) & (letters >= 20) & (capitals * 2 > letters))
        & (shouts <= 2 * MOST_SHOUTS)
        & ~worn
    )


def word_figures(text: Column) -> Column:
    """struct of n_words and n_repeat_words. The arrays are bound by let(), so that a filter
    that the optimiser pushes down never computes them anew for each element."""

    def of(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), let(hashes, lambda h: repeated_words(h)).alias("n_repeat_words"))

    return let(split_words(text), of)


def line_figures(text: Column) -> Column:
    """struct of n_dup_lines, clean_chars (lines that pass) and line_chars, over the lines with a word."""
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    def of(lines: Column) -> Column:
        passing = let(may_have_boilerplate(text), lambda worn: F.filter(lines, lambda x: line_passes(x, worn)))
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            total(passing).alias("clean_chars"),
            total(lines).alias("line_chars"),
        )

    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_chars, line_chars.

    Input: doc_id, text (other columns are ignored). A null or empty text has no words and
    fails the base rules. clean_chars and line_chars are the characters of the lines that
    pass and of all lines with a word. Null doc_ids and repeated rows keep their rows; an
    empty table gives no rows.
    """
    rows = shared.pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    figures = rows.select("doc_id", text, word_figures(text).alias("w"), line_figures(text).alias("l")).select(
        "doc_id",
        "w.n_words",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        "l.n_dup_lines",
        "w.n_repeat_words",
        "l.clean_chars",
        "l.line_chars",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    verdict = F.col("clean_chars") * 100 >= F.col("line_chars") * LEAST_KEPT_PERCENT
    figures = figures.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars", "line_chars"
    )


def clean_text(text: Column) -> Column:
    """The lines that pass, in order; lines without a word stay as they are."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x))
    return F.array_join(lines, "\n")


def clean_documents(docs: DataFrame) -> DataFrame:
    """doc_id and cleaned text of the documents that quality_report keeps, row by row."""
    report = quality_report(docs.withColumn("doc_id", F.struct("doc_id", "text"))).where("kept")
    return report.select("doc_id.doc_id", clean_text(F.col("doc_id.text")).alias("text"))


#: The same in DuckDB SQL.
SQL = rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text FROM documents
    ), w AS (
      SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d
    ), n AS (
      SELECT *, len(words) AS n_words FROM w
    ), pos AS (
      SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k
      FROM (SELECT doc_id, words, unnest(generate_series(1, n_words - 7)) AS i FROM n WHERE n_words >= 8)
    ), rep AS (
      SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM pos) WHERE c > 1
    ), cov AS (
      SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
    ), f AS (
      SELECT n.doc_id, n.n_words::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(list_sum(list_transform(list_filter(lines, lambda x:
          regexp_matches(x, '{ENDS_WELL}')
          AND length(x) - length(regexp_replace(x, '[{NAVIGATION}]', '', 'g')) <= {MOST_SEPARATORS}
          AND (length(x) - length(regexp_replace(x, '{SYMBOL}', '', 'g'))) * 10 <= length(x)
          AND NOT (length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= 20
            AND length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) * 2 > length(regexp_replace(x, '[^\p{{L}}]', '', 'g')))
          AND length(x) - length(replace(x, '!!', '')) <= {2 * MOST_SHOUTS}
          AND NOT regexp_matches(x, '{BOILERPLATE}')), lambda x: length(x))), 0)::BIGINT AS clean_chars,
        coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS line_chars
      FROM n LEFT JOIN cov ON n.doc_id = cov.doc_id
    ), v AS (
      SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED_PERCENT} AS base_failed FROM f
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND clean_chars * 100 >= line_chars * {LEAST_KEPT_PERCENT} AS kept, clean_chars, line_chars
    FROM v
"""
