"""Text expressions: tokens, keyword terms, hashes, context budgets.

Everything here is a built-in Column expression and stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and separator classes that define token identity,
# and the Unicode ranges whose runs are cut into bigrams.
SPACE = r"(?U)[\s\x1c-\x1f]"
TOKEN_SEPARATOR = r"(?U)[\s\x1c-\x1f]+|[,，。；;：:、]+"
CJK_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]+"

EMPTY_STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def tokenize(text: Column) -> Column:
    """Lower-case tokens of ``text``, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), TOKEN_SEPARATOR), lambda t: t != "")


def _bigrams(token: Column) -> Column:
    runs = F.regexp_extract_all(token, F.lit(f"({CJK_RUN})"), F.lit(1))
    return F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) < 2, empty_strings()).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
                    lambda i: F.substring(run, i, F.lit(2)),
                )
            ),
        )
    )


def cjk_bigrams(text: Column) -> Column:
    """Distinct bigrams of the CJK runs of all tokens."""
    cut = F.array_distinct(F.flatten(F.transform(tokenize(text), _bigrams)))
    return F.when(text.rlike(CJK_RUN), cut).otherwise(empty_strings())


def keyword_terms(text: Column) -> Column:
    """Distinct tokens plus the bigrams of CJK runs, in order of first occurrence."""
    tokens = tokenize(text)
    with_bigrams = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), _bigrams(t))))
    return F.array_distinct(F.when(text.rlike(CJK_RUN), with_bigrams).otherwise(tokens))


def normalize_query(text: Column) -> Column:
    """Query rewrite: distinct tokens joined by one blank."""
    return F.array_join(F.array_distinct(tokenize(F.coalesce(text, F.lit("")))), " ")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 that does not depend on the newline convention."""
    return F.sha2(unify_newlines(text), 256)


def size_label(text: Column) -> Column:
    return F.format_string("%.1fKB", F.bround(F.octet_length(text) / F.lit(1024.0), 1))


def substring_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``term``.

    Byte lengths give the same count as character lengths and need no scan of the text;
    the test for containment is cheap and spares most of the replacements.
    """
    removed = F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))
    count = F.floor(removed / F.octet_length(term)).cast("int")
    return F.when(F.contains(text, term), count).otherwise(F.lit(0))


def heading_text(heading: Column) -> Column:
    """Heading line without marks and without a trailing bracketed remark."""
    title = F.regexp_extract(heading, rf"^#{{1,6}}{SPACE}+(.+)$", 1)
    bare = F.regexp_replace(strip(title), rf"{SPACE}*[（(][^）)]*[）)]{SPACE}*$", "")
    matches = heading.rlike(rf"^#{{1,6}}{SPACE}+.+$") & ~heading.contains("\n")
    return F.when(matches, strip(bare)).otherwise(heading)


def continuation_note(heading: Column, part: Column, total: Column) -> Column:
    return F.concat(
        F.lit("> "), heading_text(heading), F.lit("（"), part.cast("string"),
        F.lit("/"), total.cast("string"), F.lit("）\n\n"),
    )


def sliding_windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of an over-long text; the tail is kept."""
    step = max(1, size - max(0, overlap))
    count = F.greatest(F.ceil((F.length(text) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count),
        lambda i: F.substring(
            text, i * step + 1, F.when(i == count, F.length(text)).otherwise(F.lit(size))
        ),
    )


def bound_context(before: Column, after: Column, budget: Column) -> tuple[Column, Column]:
    """Share a character budget between the text before a hit and the text after it.

    Each side is entitled to half; what one side leaves unused goes to the other.
    """
    zero = F.lit(0)
    budget = F.greatest(budget, zero)
    half = F.floor(budget / 2).cast("int")
    len_before, len_after = F.length(before), F.length(after)
    keep_after = F.least(len_after, budget - F.least(len_before, half))
    keep_before = F.least(len_before, budget - keep_after)
    return (
        F.when(keep_before <= 0, F.lit("")).otherwise(F.right(before, keep_before)),
        F.when(keep_after <= 0, F.lit("")).otherwise(F.left(after, keep_after)),
    )


# Fixed value: a text line (no bullet, heading, quote or link start) right above a list item.
TEXT_LINE_ABOVE_LIST = r"(?md)^(?![ \t]*[-*+]\s)([^#\n>\[].*)\n(?=\d+\.\s+|[-*+]\s+)"


def list_spacing(text: Column) -> Column:
    """Insert a blank line where a list directly follows a text line."""
    return F.regexp_replace(text, TEXT_LINE_ABOVE_LIST, "$1\n\n")
