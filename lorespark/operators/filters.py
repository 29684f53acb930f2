"""Row filters, verdict columns and projections over catalog, audit and grant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.paths import access_path
from lorespark.functions.text import is_blank

# Request limits.
MAX_TITLE, MAX_PATH, MAX_CONTENT = 500, 500, 10 * 1024 * 1024


def in_directory(catalog: DataFrame, path: str) -> DataFrame:
    """Documents directly in a directory; no directory accepts all."""
    return catalog.filter(F.col("path") == path) if path else catalog


def in_subtrees(catalog: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Documents in or below any directory of ``prefixes`` (column ``prefix``).

    Every document offers its own ancestors, which turns the prefix test into an
    equality join.
    """
    own = catalog.select("path").distinct().select("path", F.explode(_ancestors()).alias("prefix"))
    wanted = own.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("path")
    return catalog.join(wanted.distinct(), "path", "left_semi")


def _ancestors() -> Column:
    """The path and every shorter prefix that ends before a slash."""
    parts = F.split("path", "/")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def with_any_tag(catalog: DataFrame, tags: list[str]) -> DataFrame:
    return catalog.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else catalog


def with_text(catalog: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring of title, path or any tag."""
    wanted = q.strip().lower()
    hit = (
        F.lower("title").contains(wanted) | F.lower("path").contains(wanted)
        | F.exists("tags", lambda t: F.lower(t).contains(wanted))
    )
    return catalog.filter(hit) if wanted else catalog


def visible(catalog: DataFrame) -> DataFrame:
    """Rows that are not being rewritten."""
    return catalog.filter(~F.col("write_status").eqNullSafe("updating"))


def readable(catalog: DataFrame, grants: DataFrame) -> DataFrame:
    """(principal, document) pairs every grant gives access to.

    ``grants``: principal, path_mode, allowed_paths. Restricted grants are matched on the
    ancestors of distinct directories; the root grants everything, no path nothing.
    """
    mode = F.lower(F.trim(F.coalesce("path_mode", F.lit("all"))))
    rules = grants.select(
        "principal",
        F.when(mode != "restricted", F.array(F.lit("")))
        .otherwise(F.transform("allowed_paths", access_path)).alias("paths"),
    ).select("principal", F.explode(F.array_distinct("paths")).alias("prefix"))
    places = catalog.select("path").distinct().withColumn("place", access_path(F.col("path")))
    parts = F.split("place", "/")
    prefixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    offered = places.select(
        "path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), prefixes))).alias("prefix")
    )
    allowed = offered.join(rules, "prefix").select("principal", "path").distinct()
    return catalog.join(allowed, "path")


def audit_matches(
    audit: DataFrame, action: str = "", actor: str = "", target_type: str = "",
    success: bool | None = None,
) -> DataFrame:
    tests = []
    if action:
        tests.append(F.col("action") == action)
    if actor:
        tests.append(F.contains(F.coalesce("actor", F.lit("")), F.lit(actor)))
    if target_type:
        tests.append(F.col("target_type") == target_type)
    if success is not None:
        tests.append(F.coalesce("success", F.lit(False)) == success)
    for test in tests:
        audit = audit.filter(test)
    return audit


def request_verdict(max_top_k: int = 50) -> Column:
    """Names of the violated limits of a request row; empty when it is valid."""
    problems = {
        "title": ~F.length(F.coalesce("title", F.lit(""))).between(1, MAX_TITLE),
        "content": ~F.length(F.coalesce("content", F.lit(""))).between(1, MAX_CONTENT),
        "path": F.length(F.coalesce("path", F.lit(""))) > MAX_PATH,
        "top_k": ~F.col("top_k").between(1, max_top_k),
        "match_strategy": ~F.col("match_strategy").isin("title_path", "hash", "semantic"),
        "on_conflict": ~F.col("on_conflict").isin("update", "skip", "create_new"),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in problems.items()]))


def reject_reason() -> Column:
    """Why a document cannot be ingested; null for a good one. Needs ``chunk_texts``."""
    return (
        F.when(is_blank(F.col("title")), "blank_title")
        .when(is_blank(F.col("content")), "blank_content")
        .when(F.size("chunk_texts") == 0, "no_chunks")
    )


def upload_verdict(filename: Column, supported: Column) -> Column:
    return F.struct(
        F.when(supported, F.lit("accepted")).otherwise(F.lit("skipped")).alias("status"),
        F.when(~supported, F.lit("unsupported file type")).otherwise(F.lit("")).alias("reason"),
        filename.alias("filename"),
    )


def redact(df: DataFrame, *fields: str) -> DataFrame:
    """Replace text fields by a marker and keep their length."""
    for name in fields:
        df = df.withColumn(f"{name}_length", F.length(F.coalesce(name, F.lit(""))))
        df = df.withColumn(name, F.lit("[redacted]"))
    return df


def effective_status(as_of: Column) -> Column:
    """Stored status, with active grants past their expiry shown as expired."""
    return F.when(
        (F.col("status") == "active") & (F.col("expires_at") < as_of), F.lit("expired")
    ).otherwise(F.col("status"))


def expiry(created_at: Column, duration: Column) -> Column:
    """permanent -> no expiry; Nd -> N days; anything else -> 7 days."""
    days = F.coalesce(F.regexp_extract(duration, r"^(\d+)d$", 1).try_cast("int"), F.lit(7))
    return F.when(duration != "permanent", created_at + F.make_dt_interval(days))

