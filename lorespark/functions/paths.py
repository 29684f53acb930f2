"""Directory paths, file names and list-valued parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import empty_strings, strip


def _strip_slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+|/+$", "")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_normalize(path: Column) -> Column:
    """Catalog form of a directory: forward slashes, no empty or ``..`` segment."""
    clean = F.replace(_strip_slashes(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.array_join(F.filter(F.split(clean, "/"), lambda s: (s != "") & (s != "..")), "/")


def access_path(path: Column) -> Column:
    """Form used by access rules: trimmed, but ``..`` segments are kept."""
    clean = _strip_slashes(strip(F.coalesce(path, F.lit(""))))
    return F.replace(clean, F.lit("\\"), F.lit("/"))


def breadcrumbs(path: Column) -> Column:
    """Array of (name, path), one entry per ancestor including the path itself."""
    parts = path_segments(path)
    return F.transform(
        parts,
        lambda name, i: F.struct(
            name.alias("name"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("path")
        ),
    )


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def under(path: Column, prefix: Column) -> Column:
    """``path`` is the directory ``prefix`` or lies below it."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def source_path(doc_id: Column, path: Column) -> Column:
    """Where the source text of a document is stored."""
    clean = F.replace(_strip_slashes(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.concat_ws(
        "/", F.lit("documents"), F.when(clean != "", clean), doc_id, F.lit("source.md")
    )


def file_extension(filename: Column) -> Column:
    """Lower-case extension with its dot; '' for none (a leading dot is no extension)."""
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def is_supported_upload(filename: Column) -> Column:
    return file_extension(F.coalesce(filename, F.lit(""))).isin(".md", ".csv")


def filename_title(filename: Column, default: str = "未命名文档") -> Column:
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"^(\.*[^.].*?)\.[^.]*$", "$1")
    return F.when(stem == "", F.lit(default)).otherwise(stem)


def merge_upload_path(base: Column, relative: Column) -> Column:
    return F.concat_ws(
        "/", F.when(base != "", base), F.when(relative != "", relative)
    )


def export_filename(title: Column) -> Column:
    """Title made safe as a file name."""
    safe = F.regexp_replace(title, r'[<>:"/\\|?*]', "_")
    safe = F.regexp_replace(safe, r"^[ ._]+|[ ._]+$", "")
    return F.when(safe == "", F.lit("untitled")).otherwise(safe)


def _json_list(raw: Column) -> Column:
    return F.when(
        raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    )


def parse_allowed_paths(raw: Column) -> Column:
    """JSON list (blank items kept: '' is the root) or comma string (blank items dropped)."""
    listed = F.transform(_json_list(raw), access_path)
    split = F.filter(F.transform(F.split(raw, ","), access_path), lambda p: p != "")
    return F.when(F.coalesce(raw, F.lit("")) == "", empty_strings()).otherwise(
        F.coalesce(listed, split)
    )


def parse_scope(raw: Column) -> Column:
    """JSON list, JSON string or bare word; nothing means read."""
    quoted = F.when(raw.rlike(r'^\s*".*"\s*$'), F.array(F.regexp_extract(raw, r'^\s*"(.*)"\s*$', 1)))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array(F.lit("read"))).otherwise(
        F.coalesce(_json_list(raw), quoted, F.array(raw))
    )


def parse_tag_param(raw: Column) -> Column:
    """Comma string, full-width comma accepted."""
    parts = F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("，"), F.lit(",")), ",")
    return F.filter(F.transform(parts, strip), lambda t: t != "")
