"""Scalar functions on literal cases: mixed scripts, widths, newlines, odd paths."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from lorespark.functions import chunking, metadata, paths, scoring, text
from lorespark.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_keyword_terms_cut_ideograph_runs_into_bigrams(spark):
    terms = value(spark, text.keyword_terms(F.lit("知识库检索 Foo,foo；BAR")))
    assert terms == ["知识库检索", "知识", "识库", "库检", "检索", "foo", "bar"]


def test_tokenize_accepts_unicode_space_and_full_width_separators(spark):
    assert value(spark, text.tokenize(F.lit(" A　b，C。d；e：f、g:h "))) == list("abcdefgh")
    assert value(spark, text.normalize_query(F.lit("b  a B"))) == "b a"
    assert value(spark, text.normalize_query(F.lit(None).cast("string"))) == ""


def test_content_hash_ignores_newline_convention(spark):
    row = spark.createDataFrame([("a\r\nb\rc", "a\nb\nc")], "x string, y string").select(
        text.content_hash(F.col("x")).alias("x"), text.content_hash(F.col("y")).alias("y")).first()
    assert row.x == row.y
    assert value(spark, text.size_label(F.lit("é" * 640))) == "1.2KB"


@pytest.mark.parametrize("before, after, budget, expected", [
    ("0123456789", "abcdefghij", 6, ("789", "abc")),
    ("01", "abcdefghij", 6, ("01", "abcd")),
    ("0123456789", "a", 7, ("456789", "a")),
    ("0123", "abc", 0, ("", "")),
    ("", "", 5, ("", "")),
])
def test_bound_context(spark, before, after, budget, expected):
    first, second = text.bound_context(F.lit(before), F.lit(after), F.lit(budget))
    assert (value(spark, first), value(spark, second)) == expected


def test_heading_text_and_note(spark):
    assert value(spark, text.heading_text(F.lit("### 3.1 Generals（launch）"))) == "3.1 Generals"
    assert value(spark, text.heading_text(F.lit("plain"))) == "plain"
    assert value(spark, text.heading_text(F.lit("# a\nb"))) == "# a\nb"
    assert value(spark, text.continuation_note(F.lit("## A (x)"), F.lit(1), F.lit(3))) == "> A（1/3）\n\n"


def test_list_spacing(spark):
    assert value(spark, text.list_spacing(F.lit("intro\n- x\n- y\nmore\n1. z"))) == "intro\n\n- x\n- y\nmore\n\n1. z"
    assert value(spark, text.list_spacing(F.lit("# head\n- x"))) == "# head\n- x"


def test_sliding_windows_keep_the_tail(spark):
    parts = value(spark, text.sliding_windows(F.lit("a" * 1501), 512, 50))
    assert [len(p) for p in parts] == [512, 512, 512, 1501 - 3 * 462]
    assert value(spark, text.sliding_windows(F.lit("abc"), 512, 50)) == ["abc"]


def test_scores(spark):
    def structure(query, entities):
        return value(spark, scoring.structure_score(
            F.lit(query), F.lit("doc-1"), F.lit("alpha manual"), F.lit("guides"),
            F.array(*map(F.lit, entities)).cast("array<string>")))

    assert structure("data portal deployment", ["data portal"]) == 6.0
    assert structure("doc-1", []) == 10.0
    assert structure("alpha manual", []) == 8.0
    assert structure("alpha", ["alpha"]) == 5.0  # the title shadows the entity
    assert structure("redis", ["redis"]) == 8.5
    assert structure("edi", ["redis"]) == 4.0
    assert structure("", []) == 1.0
    assert structure("zzz", ["redis"]) == 0.0
    keyword = scoring.keyword_score(
        F.array(F.lit("aa")), F.lit("aa"), F.lit("xaa"), F.lit(""), F.lit("aaaaa " * 9))
    assert value(spark, keyword) == 3.0 + 1.5 + 5
    assert value(spark, scoring.normalize_score(F.lit("vector"), F.lit(-0.5))) == -0.5
    assert value(spark, scoring.normalize_score(F.lit("vector+neighbor"), F.lit(0.5))) == 0.05
    assert value(spark, scoring.normalize_score(F.lit("graph"), F.lit(-1.0))) == 0.0


def test_metadata_values_are_identified_by_key(spark):
    raw = F.array(F.lit("Data Portal, data-portal"), F.lit("ＤＡＴＡ_ＰＯＲＴＡＬ；Ｒｅｄｉｓ"), F.lit("###"), F.lit("**x**"))
    assert value(spark, metadata.normalize_values(raw)) == ["Data Portal", "Redis", "x"]
    many = F.array(*[F.lit(f"v{i}") for i in range(50)])
    assert len(value(spark, metadata.normalize_values(many))) == 32
    assert value(spark, metadata.normalize_values(F.array(F.lit("y" * 121)))) == []
    assert value(spark, metadata.metadata_key(F.lit("Straße -_ Ｘ"))) == "strassex"
    assert value(spark, metadata.minus_by_key(F.array(F.lit("A b"), F.lit("c")), F.array(F.lit("a-B")))) == ["c"]


def test_header_metadata(spark):
    doc = (
        "# Guide\r\n> **标签**：部署、内部服务， API；运维\r\n> Core Entities: Data Portal, Lucene、Redis|Kafka\n"
        "- Tags: ignored\nTAGS ： api\n## Section\nTags: late")
    df = spark.createDataFrame([(doc,), ("```\nTags: a\n",), ("",)], "content string")
    got = [(r.header_tags, r.header_entities) for r in metadata.with_header(df).collect()]
    assert got[0] == (["部署", "内部服务", "API", "运维"], ["Data Portal", "Lucene", "Redis", "Kafka"])
    assert got[1:] == [([], []), ([], [])]


def test_header_scan_stops_after_forty_lines(spark):
    far = "\n".join(["x"] * 40 + ["Tags: a"])
    df = spark.createDataFrame([(far,)], "content string")
    assert metadata.with_header(df).first()["header_tags"] == []


@pytest.mark.parametrize("raw, expected", [
    ("true", True), (" YES ", True), ("1", True), ("on", True), ("false", False), ("0", False), ("", False), (None, False)])
def test_override_flag(spark, raw, expected):
    assert value(spark, metadata.override_flag(F.lit(raw).cast("string"))) is expected


def test_paths(spark):
    assert value(spark, paths.path_normalize(F.lit("/a\\b/../c//"))) == "a/b/c"
    assert value(spark, paths.access_path(F.lit(" /a\\../b/ "))) == "a/../b"
    assert value(spark, paths.source_path(F.lit("d1"), F.lit("/a\\b/"))) == "documents/a/b/d1/source.md"
    assert value(spark, paths.source_path(F.lit("d1"), F.lit(""))) == "documents/d1/source.md"
    assert [tuple(b) for b in value(spark, paths.breadcrumbs(F.lit("a/b")))] == [("a", "a"), ("b", "a/b")]
    assert value(spark, paths.parse_allowed_paths(F.lit('["/x/", ""]'))) == ["x", ""]
    assert value(spark, paths.parse_allowed_paths(F.lit("x, ,/y"))) == ["x", "y"]
    assert value(spark, paths.parse_allowed_paths(F.lit(None).cast("string"))) == []
    assert value(spark, paths.parse_scope(F.lit('"write"'))) == ["write"]
    assert value(spark, paths.parse_scope(F.lit("admin"))) == ["admin"]
    assert value(spark, paths.export_filename(F.lit(' a:b?. '))) == "a_b"
    assert value(spark, paths.export_filename(F.lit("??"))) == "untitled"


@pytest.mark.parametrize("name, ext, title", [
    ("x/Note.MD", ".md", "Note"), ("a.tar.csv", ".csv", "a.tar"), (".md", "", ".md"), ("noext", "", "noext"),
    ("dir\\f.md", ".md", "f"), ("x/", "", "未命名文档")])
def test_file_names(spark, name, ext, title):
    assert value(spark, paths.file_extension(F.lit(name))) == ext
    assert value(spark, paths.filename_title(F.lit(name))) == title


# ----------------------------------------------------------------------------- chunking


def chunks_of(spark, content, size=512, overlap=50):
    df = spark.createDataFrame([("d", content)], "doc_id string, content string")
    rows = chunking.chunk_rows(chunking.with_chunks(df, "content", size, overlap)).orderBy("chunk_index").collect()
    assert all(r.total_chunks == len(rows) for r in rows)
    return [r.content for r in rows]


TABLE = "### 3.1 Heroes\n\n> basics\n\n| ID | Name | Rank |\n|:--:|------|:----:|\n| 11 | Lü Bu | top |\n| 7 | Da Qiao | top |\n| 71 | Sima Yi | top |\n"


def test_blank_documents_have_no_chunks(spark):
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, " \n\t ") == []


def test_small_document_is_one_chunk_whatever_its_newlines(spark):
    whole = chunks_of(spark, TABLE, size=2048)
    assert len(whole) == 1 and "Lü Bu" in whole[0]
    assert chunks_of(spark, TABLE.replace("\n", "\r\n"), size=2048) == whole


def test_parts_after_the_first_repeat_the_heading(spark):
    parts = chunks_of(spark, TABLE, size=80)
    assert len(parts) > 1
    assert parts[0].startswith("### 3.1 Heroes")
    assert all(p.startswith("> 3.1 Heroes（") for p in parts[1:])


def test_sections_do_not_mix(spark):
    parts = chunks_of(spark, "before\n\n## A\n\na\n\n\n\n### B\n\nb")
    assert parts == ["before", "## A\n\na", "### B\n\nb"]


def test_unbroken_text_keeps_every_character(spark):
    body = "".join(chr(97 + i % 26) for i in range(1501))
    parts = chunks_of(spark, body)
    assert parts[0] == body[:512] and parts[-1] == body[3 * 462:]
    assert parts[0] + "".join(p[50:] for p in parts[1:]) == body


def test_sentences_are_packed(spark):
    sentence = "Word " * 19 + "end."
    parts = chunks_of(spark, " ".join([sentence] * 12), size=250)
    assert all(len(p) <= 250 for p in parts)
    assert " ".join(parts) == " ".join([sentence] * 12)


# ---------------------------------------------------------------------------------- CSV


def to_markdown(spark, content, title="Sheet"):
    df = spark.createDataFrame([(title, content)], "title string, content string")
    row = files.csv_to_records(df).first()
    return row.markdown, row.error


def sniffed(sample):
    try:
        dialect = csv.Sniffer().sniff(sample, delimiters=files.DELIMITERS)
    except csv.Error:
        return {}
    return {k: getattr(dialect, k) for k in ("delimiter", "quotechar", "doublequote", "skipinitialspace")}


def test_csv_styles_are_those_of_the_library():
    rng, found = random.Random(5), 0
    for number in range(6000):
        cells = rng.choice([["a", "b;c", "1|2", "x y", ""], ['"p, q"', "'r'", "", "it's", '"say ""so"""'], ["7", "é", "\u3000"], ['"', "'", "z"]])
        between = rng.sample([",", ", ", ";", "; ", "\t", "|", "\n", ":"], rng.choice([1, 1, 2]))
        sample = "\n".join(rng.choice(between).join(rng.choices(cells, k=rng.choice([3, 3, 4, 1])))
                           for _ in range(rng.randrange(0, 45 if number % 10 == 0 else 6)))
        want = sniffed(sample)
        assert files.sniff_csv(sample) == want, sample
        found += bool(want)
    assert found > 2000


def test_csv_rows_are_squeezed_like_other_texts(spark):
    blanks = "".join(chr(c) for c in range(1, 0x3001) if chr(c).isspace() and chr(c) not in "\r\n\t") + "\u200b\u180e"
    raw = [[f" {c}x{c}{c} y{c}" for c in blanks], ["", " \u3000", "\x1c"], ["a"]]
    text = "\n".join(",".join(row) for row in raw) + "\n"
    df = spark.createDataFrame([(text, raw), (None, None), (" , \n", [[" ", " "]])], "text string, raw array<array<string>>")
    for row in df.select(files.csv_rows("text").alias("got"), files.clean_rows(F.col("raw")).alias("want")).collect():
        assert row.got == row.want


def test_csv_styles_make_no_dialects(spark, monkeypatch):
    """No class and no table of all characters for a file."""
    monkeypatch.setattr(csv, "Sniffer", None)
    assert files.sniff_csv('a;b\n1;2\n')["delimiter"] == ";"
    assert files.sniff_csv('a,"b, c"\n')["delimiter"] == ","


def test_csv_with_header(spark):
    markdown, error = to_markdown(spark, "Name,Age,Age\nAda,36,\n , ,\n\"Bob, Jr\",x,1\n")
    assert error is None
    assert markdown == (
        "# Sheet\n\n## CSV 数据记录\n\n- 行号: 1\n  - Name: Ada\n  - Age: 36\n\n"
        "- 行号: 2\n  - Name: Bob, Jr\n  - Age: x\n  - Age（2）: 1\n")


def test_csv_without_header_numbers_its_columns(spark):
    markdown, _ = to_markdown(spark, "1;x\n2;y\n")
    assert "  - 列1: 1\n  - 列2: x" in markdown


def test_csv_header_only_is_rejected(spark):
    assert to_markdown(spark, "Name,Age\n") == (None, "no data rows")
    assert to_markdown(spark, "\n") == (None, "no data rows")


def test_numbers_are_what_float_accepts(spark):
    cases = ["1", "-1.5", "1,234.5", "1e5", ".5", "5.", "inf", "-Infinity", "nan", "1_000", "", "x", "1-2", "_1", "e5", "."]

    def accepted(raw):
        try:
            float(raw.replace(",", ""))
        except ValueError:
            return False
        return True

    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.n for r in df.select("c", files.is_number(F.col("c")).alias("n")).collect()}
    assert got == {c: accepted(c) for c in cases}


def test_uploads_are_decoded_and_converted(spark):
    rows = [
        ("a.md", "# 标题\n".encode("gb18030")), ("b.md", "# t".encode("utf-16")), ("c.csv", "名称;值\n甲;1\n".encode("gb18030")),
        ("d.txt", b"x"), ("e.md", b""), ("f.md", b" \n"), ("g.md", b"a\x00b"), ("h.MD", b"\xef\xbb\xbfok")]
    df = spark.createDataFrame(rows, "filename string, content binary")
    got = {r.filename: (r.markdown, r.error) for r in files.convert_uploads(df).collect()}
    assert got["a.md"] == ("# 标题\n", None)
    assert got["b.md"] == ("# t", None)
    assert "  - 名称: 甲\n  - 值: 1" in got["c.csv"][0]
    assert got["d.txt"] == (None, "unsupported file type")
    assert got["e.md"] == got["g.md"] == (None, "undecodable or empty")
    assert got["f.md"] == (None, "empty document")
    assert got["h.MD"] == ("ok", None)


def test_packing_holds_few_documents_as_strings():
    import tracemalloc

    import pyarrow as pa

    paragraph = " ".join(["word"] * 400)
    doc = [["# Title", *[paragraph] * 10]]
    batch = pa.array([doc if i % 3 else None for i in range(600)], pa.list_(pa.list_(pa.string())))
    tracemalloc.start()
    packed = chunking.pack_documents(batch, 512, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert packed.null_count == 200 and len(packed) == 600
    assert packed[1].as_py() == chunking.pack_section(doc[0], 512, 50) == packed[599].as_py()
    assert len(chunking.pack_documents(batch[:0], 512, 50)) == 0
    # The batch holds 8 MB of text.
    assert peak < 2_000_000
