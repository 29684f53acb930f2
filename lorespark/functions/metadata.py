"""Tag and entity values: cleaning, identity keys, header extraction, merging.

Identity needs NFKC and case folding, which Spark does not offer as built-ins, so these
few expressions are Arrow functions. They only ever receive short values: finding the
header lines in a document text is done with built-ins before anything reaches Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lorespark.functions.text import SPACE, empty_strings, unify_newlines

# Limits, separators, and the labels that declare tags or entities.
MAX_HEADER_LINES = 40
MAX_VALUES = 32
MAX_VALUE_CHARS = 120
VALUE_SEPARATOR = r"[，,、;；|]+"
TAG_LABELS = frozenset(["标签", "標籤", "tag", "tags"])
ENTITY_LABELS = frozenset([
    "核心实体", "核心實體", "实体", "實體",
    "core entity", "core entities", "entity", "entities",
])
VALUE_EDGE = " \t`*_\"'“”‘’"

STRINGS = ArrayType(StringType())
HEADER = StructType([StructField("tags", STRINGS), StructField("entities", STRINGS)])


def value_key(value: str) -> str:
    """Identity of a value: case, width, blanks, hyphens and underscores do not count."""
    return re.sub(r"[\s_-]+", "", unicodedata.normalize("NFKC", value).casefold())


def clean_value(value: str) -> str:
    bare = unicodedata.normalize("NFKC", value).strip(VALUE_EDGE)
    bare = " ".join(re.sub(r"^#+\s*", "", bare).split())
    usable = len(bare) <= MAX_VALUE_CHARS and any(map(str.isalnum, bare))
    return bare if usable else ""


def distinct_values(values: Iterable[str], limit: int | None = MAX_VALUES) -> list[str]:
    """Clean values with distinct keys, at most ``limit``; the first display form of a key is kept."""
    by_key: dict[str, str] = {}
    for text in values:
        for part in re.split(VALUE_SEPARATOR, text or ""):
            clean = clean_value(part)
            key = value_key(clean)
            if key:
                by_key.setdefault(key, clean)
    return list(by_key.values())[:limit]


@F.pandas_udf(STRINGS)
def _distinct_values(values: pd.Series) -> pd.Series:
    return values.map(distinct_values, na_action="ignore")


@F.pandas_udf(STRINGS)
def _all_distinct_values(values: pd.Series) -> pd.Series:
    return values.map(lambda vs: distinct_values(vs, limit=None), na_action="ignore")


@F.pandas_udf(STRINGS)
def value_keys(values: pd.Series) -> pd.Series:
    return values.map(lambda vs: [value_key(v or "") for v in vs], na_action="ignore")


@F.pandas_udf(StringType())
def _value_key(value: pd.Series) -> pd.Series:
    return value.map(value_key, na_action="ignore")


@F.pandas_udf(HEADER)
def _header_values(labels: pd.Series, values: pd.Series) -> pd.DataFrame:
    def label_of(raw: str) -> str:
        plain = re.sub(r"[`*_]+", "", unicodedata.normalize("NFKC", raw))
        return " ".join(plain.split()).casefold()

    rows = []
    for names, texts in zip(labels, values, strict=True):
        pairs = [] if names is None else list(zip(map(label_of, names), texts, strict=True))
        rows.append({
            "tags": distinct_values(t for n, t in pairs if n in TAG_LABELS),
            "entities": distinct_values(t for n, t in pairs if n in ENTITY_LABELS),
        })
    return pd.DataFrame(rows, columns=["tags", "entities"])


def normalize_values(values: Column) -> Column:
    """Split, clean and deduplicate an array of values."""
    return _distinct_values(F.coalesce(values, empty_strings()))


def all_values(values: Column) -> Column:
    """Like :func:`normalize_values`, however many there are."""
    return _all_distinct_values(F.coalesce(values, empty_strings()))


def merge_values(*values: Column) -> Column:
    return normalize_values(F.concat(*[F.coalesce(v, empty_strings()) for v in values]))


def metadata_key(value: Column) -> Column:
    return _value_key(F.coalesce(value, F.lit("")))


def entity_id_of_key(key: Column) -> Column:
    return F.concat(F.lit("entity:"), F.substring(F.sha2(key, 256), 1, 20))


def entity_id(value: Column) -> Column:
    return entity_id_of_key(metadata_key(value))


@F.pandas_udf(STRINGS)
def minus_by_key(values: pd.Series, removed: pd.Series) -> pd.Series:
    """Values whose key is not among the keys of ``removed``."""
    def keep(own, gone):
        keys = {value_key(v) for v in gone}
        return [v for v in own if value_key(v) not in keys]

    return pd.Series([keep(v, r) for v, r in zip(values, removed, strict=True)], dtype=object)


def override_flag(value: Column) -> Column:
    """Truthiness of a stored override marker given as text."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("1", "true", "yes", "on")


_FIELD = rf"^([^:：]{{1,48}}){SPACE}*[:：]{SPACE}*(.+?){SPACE}*$"


def _bare_line(line: Column) -> Column:
    quoted = F.regexp_replace(line, rf"^(>{SPACE}*)+", "")
    return F.regexp_replace(quoted, rf"^#{{1,6}}{SPACE}+", "")


def header_lines(content: Column) -> Column:
    """``label: value`` lines of the short header, marks removed.

    The header is the first 40 lines up to a code fence or a second-level heading;
    list items never count.
    """
    head = F.slice(F.split(unify_newlines(F.coalesce(content, F.lit(""))), "\n"), 1, MAX_HEADER_LINES)
    lines = F.transform(head, lambda l: F.regexp_replace(l, rf"^{SPACE}+|{SPACE}+$", ""))
    # One-element transform: binds the lines once instead of repeating the expression.
    kept = F.transform(
        F.array(lines),
        lambda ls: F.slice(
            ls,
            F.lit(1),
            F.coalesce(
                F.array_min(
                    F.transform(
                        ls, lambda l, i: F.when(l.rlike(rf"^(```|~~~|##+{SPACE})"), i)
                    )
                ),
                F.size(ls),
            ),
        ),
    )[0]
    bare = F.transform(kept, _bare_line)
    return F.filter(bare, lambda l: l.rlike(_FIELD) & ~l.rlike(rf"^[-*+]{SPACE}"))


def header_metadata(lines: Column) -> Column:
    """Struct(tags, entities) declared by the lines of :func:`header_lines`."""
    found = F.when(F.size(lines) > 0, lines)
    return _header_values(
        F.transform(found, lambda l: F.regexp_extract(l, _FIELD, 1)),
        F.transform(found, lambda l: F.regexp_extract(l, _FIELD, 2)),
    )


def with_header(df, content: str = "content"):
    """Add ``header_tags`` and ``header_entities`` to a table of documents."""
    return (
        df.withColumn("_lines", header_lines(F.col(content)))
        .withColumn("_header", header_metadata(F.col("_lines")))
        .withColumn("header_tags", F.col("_header.tags"))
        .withColumn("header_entities", F.col("_header.entities"))
        .drop("_lines", "_header")
    )
