from __future__ import annotations

import random

import pytest

from tallyline.operators import joins
from tallyline.sources import csv_files as C


def records(text):
    """The records of a CSV text, character by character."""
    rows, fields, field, quoted, at, touched = [], [], "", False, 0, False
    while at < len(text):
        c, touched = text[at], True
        if c == '"':
            if quoted and text[at + 1 : at + 2] == '"':
                field, at = field + '"', at + 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            fields, field = [*fields, field], ""
        elif c in "\r\n" and not quoted:
            at += c == "\r" and text[at + 1 : at + 2] == "\n"
            rows, fields, field, touched = [*rows, [*fields, field]], [], "", False
        else:
            field += c
        at += 1
    return [*rows, [*fields, field]] if touched else rows


def table(seed, line_end, n=120):
    rng = random.Random(seed)

    def field():
        kind = rng.random()
        if kind < 0.3:
            return str(rng.randrange(1000))
        if kind < 0.6:
            return '"' + "".join(rng.choice(["a", "b", '""', "\n", "\r\n", ",", "é", "\r"]) for _ in range(rng.randrange(60))) + '"'
        return 'x"y,\n"z' if kind < 0.7 else "w" * rng.randrange(20)

    return 'id,"a\nb",c' + line_end + "".join(",".join(field() for _ in range(rng.randrange(5))) + line_end for _ in range(n))


@pytest.fixture
def block_size(spark):
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, before)


def folder(tmp_path, texts, charset="utf-8"):
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.csv").write_bytes(text.encode(charset))
    return str(tmp_path)


def padded(texts):
    return sorted(tuple((r + ["", "", ""])[:3]) for t in texts for r in records(t.removeprefix("﻿"))[1:])


def test_small_blocks_give_the_records_of_whole_files(spark, tmp_path, block_size, monkeypatch):
    texts = ["﻿" + table(1, "\n"), table(2, "\r\n"), table(3, "\r")]
    path = folder(tmp_path, texts)
    for size in (400, 1 << 27):
        block_size(size)
        found = C.read_csv(spark, path, multi_line=True)
        assert found.columns == ["id", "a\nb", "c"]
        assert sorted(map(tuple, found.collect())) == padded(texts)
    # Too many blocks to send their list: both cases are tried in each.
    monkeypatch.setattr(joins.fits_broadcast, "__defaults__", (0, 0))
    block_size(700)
    assert sorted(map(tuple, C.read_csv(spark, path, multi_line=True).collect())) == padded(texts)


def test_one_file_is_read_by_many_tasks_in_its_order(spark, tmp_path, block_size):
    text = table(4, "\n", 300)
    path = folder(tmp_path, [text])
    block_size(500)
    rows = C.read_csv(spark, path, multi_line=True, row_order=True).orderBy(C.ROW_ORDER).collect()
    assert [tuple(r[:3]) for r in rows] == [tuple((r + ["", "", ""])[:3]) for r in records(text)[1:]]
    assert len({r[C.ROW_ORDER]["block"] for r in rows}) > 20
    assert C.file_lines(spark, path).rdd.getNumPartitions() > 20


def test_a_value_over_many_blocks(spark, tmp_path, block_size):
    long = "\n".join(f"line {i}, with a comma" for i in range(400))
    path = folder(tmp_path, [f'id,note\n1,"{long}"\n2,short\n3,"{long}""{long}"\n'])
    block_size(300)
    assert sorted(map(tuple, C.read_csv(spark, path, multi_line=True).collect())) == [("1", long), ("2", "short"), ("3", f'{long}"{long}')]


def test_edges_of_a_file(spark, tmp_path, block_size):
    block_size(300)
    texts = ['a,b\n1,"open at the end\nof its file', 'a,b\n2,""', "a,b\n\n3,x", "a,b\n", 'a,b\n4,"']
    rows = C.read_csv(spark, folder(tmp_path, texts), multi_line=True).collect()
    assert sorted(map(tuple, rows)) == [("", ""), ("1", "open at the end\nof its file"), ("2", ""), ("3", "x"), ("4", "")]


def test_other_charsets(spark, tmp_path, block_size):
    block_size(300)
    for charset in ("EUC-KR", "UTF-16LE"):
        own = tmp_path / charset
        own.mkdir()
        body = "".join(f'{i},"가나\n다"\r\n' for i in range(60))
        rows = C.read_csv(spark, folder(own, ["키,값\r\n" + body], charset), multi_line=True, charset=charset)
        assert rows.columns == ["키", "값"] and sorted(map(tuple, rows.collect())) == sorted((str(i), "가나\n다") for i in range(60))


def test_different_headers_and_none(spark, tmp_path):
    with pytest.raises(ValueError, match="different headers"):
        C.read_csv(spark, folder(tmp_path, ["a,b\n1,2\n", "a,c\n1,2\n"]), multi_line=True)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        C.read_csv(spark, str(tmp_path / "none"), multi_line=True)
