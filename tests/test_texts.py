from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.plans import texts as jobs
from tallyline.sources.csv_files import line_fields
from tallyline.sources.scripts import decode_text, encode_text, read_scripts


@pytest.mark.parametrize(
    ("expression", "text", "expected"),
    [
        (T.trim_blanks, "\t a\r\n\x00", "a"),
        (T.strip_trailing_spaces, "Line 1   \nLine 2  \r\nLine 3 ", "Line 1\nLine 2\nLine 3"),
        (lambda c: T.tabs_to_spaces(c, 2), "\ta\t", "  a  "),
        (lambda c: T.strip_comments(c, "std"), "a /* x\n */ b -- c\nd --e", "a   b  d  "),
        (lambda c: T.strip_comments(c, "scan"), "a /* x */ b -- c", "a   b -- c"),
        (lambda c: T.strip_comments(c, "simple"), "b -- c\r\nd", "b  \r\nd"),
        (lambda c: T.strip_comments(c, "linecount"), "a /* -- x */\nb */ c", "a  c"),
        (T.strip_comment_backticks, "a `x` -- c `y`\n'-- `k`' /* `z` */ `w` \"/* `v`\"", "a `x` -- c y\n'-- `k`' /* z */ `w` \"/* `v`\""),
        (T.strip_comment_backticks, "/* open `x`", "/* open x"),
        (T.lines_of, "a\r\nb\rc\n\n", ["a", "b", "c", ""]),
        (T.lines_of, "", []),
        (T.lines_of, "a", ["a"]),
        (T.csv_field, 'a "q", b', '"a ""q"", b"'),
        (T.excel_text, "0000", '="0000"'),
        (T.excel_text, "", ""),
        (T.file_extension, "a.b.SQL", "sql"),
        (T.file_extension, ".sql", "noext"),
        (T.file_extension, "a.", "noext"),
        (lambda c: T.output_name(c, "_x.txt"), "q/a.sql", "q/a_x.txt"),
        (lambda c: T.base_output_name(c, ".t"), "q.d/a.b.sql", "q.d/a.b.t"),
        (lambda c: T.base_output_name(c, ".t"), "q.d/.sql", "q.d/.sql.t"),
        (lambda c: T.shorten(c, 6), "abcdefg", "abc..."),
        (line_fields, 'a, "b,c" x,""d"" ,,', ["a", "b,c x", "d", "", ""]),
    ],
)
def test_text_expressions(one, expression, text, expected):
    assert one(text, expression) == expected


def test_long_quoted_line_does_not_overflow(one):
    assert one('"a,b",' * 20000 + "z", lambda c: F.size(line_fields(c))) == 20001


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a`'\"-/*\n ;", max_size=30), min_size=1, max_size=20))
def test_backtick_removal_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    once = T.strip_comment_backticks(F.col("s"))
    for row in df.select("s", once.alias("x"), T.strip_comment_backticks(once).alias("y")).collect():
        assert row["x"] == row["y"] and row["x"].replace("`", "") == row["s"].replace("`", "")


def test_charsets(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xb0\xa1\xff\xff")), (2, bytearray("가나".encode("euc-kr")))], "id int, content binary")
    assert [r["t"] for r in decode_text(spark, df, "content", "MS949", "t").orderBy("id").collect()] == ["가��", "가나"]
    assert [r["t"] for r in decode_text(spark, df, "content", "EUC-KR", "t", strict=True).collect()] == ["가나"]
    texts = spark.createDataFrame([("가é",), ("가",)], "t string")
    assert sorted(bytes(r["b"]) for r in encode_text(spark, texts, "t", "EUC-KR", "b").collect()) == [b"\xb0\xa1", b"\xb0\xa1?"]
    assert [bytes(r["b"]) for r in encode_text(spark, texts, "t", "EUC-KR", "b", strict=True).collect()] == [b"\xb0\xa1"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_rewrite_jobs(spark, tmp_path):
    root = tmp_path / "in"
    (root / "d e").mkdir(parents=True)
    (root / "a.sql").write_bytes("가 `x` -- `가`\t \n".encode("euc-kr"))
    (root / "d e" / "b.sql").write_bytes(b"\xff\xff")
    (root / "c.txt").write_bytes(b"x")
    assert jobs.euc_kr_to_utf8(spark, str(root), str(tmp_path / "utf8"))[0] == 1
    assert (tmp_path / "utf8" / "a.sql").read_text(encoding="utf-8") == "가 `x` -- `가`\t \n"
    assert jobs.remove_comment_backticks(spark, str(root), str(tmp_path / "ticks"))[0] == 2
    assert (tmp_path / "ticks" / "a.sql").read_bytes() == "가 `x` -- 가\t \n".encode("euc-kr")
    assert jobs.utf8_to_euc_kr(spark, str(tmp_path / "utf8"), str(tmp_path / "back"))[0] == 1
    assert (tmp_path / "back" / "a.sql").read_bytes() == (root / "a.sql").read_bytes()
    jobs.expand_tabs(spark, str(tmp_path / "utf8"), str(tmp_path / "tabs"), 2)
    assert (tmp_path / "tabs" / "a.sql").read_text(encoding="utf-8") == "가 `x` -- `가`   \n"
    jobs.remove_trailing_spaces(spark, str(tmp_path / "utf8"), str(tmp_path / "trail"))
    assert (tmp_path / "trail" / "a.sql").read_text(encoding="utf-8") == "가 `x` -- `가`\n"


def test_script_scan(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.sql").write_text("가")
    (tmp_path / "s" / "b.SQL").write_text("b")
    (tmp_path / "s" / "c.bq").write_text("0123456789")
    scan = lambda **kw: sorted((r["path"], r["name"], r["length"], r["raw"]) for r in read_scripts(spark, str(tmp_path), **kw).collect())
    assert scan() == [("a.sql", "a.sql", 3, "가")]
    assert [r[0] for r in scan(glob="*.[sS][qQ][lL]")] == ["a.sql", "s/b.SQL"]
    assert [r[0] for r in scan(glob="*.{sql,bq}")] == ["a.sql", "s/c.bq"]
    assert [r[0] for r in scan(glob="*", max_bytes=5)] == ["a.sql", "s/b.SQL"]
    one = read_scripts(spark, str(tmp_path / "s" / "c.bq"), glob="*").first()
    assert (one["path"], one["name"]) == ("c.bq", "c.bq")
