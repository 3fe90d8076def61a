from __future__ import annotations

import base64
import os

import numpy as np
import pytest

from tallyline.llm import token_scan as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_counts_match_the_encoder(spark, block):
    texts = ["hello world", "", None, "x" * 50, "é ü <|endoftext|>", " ".join(str(k) for k in range(300)), "", "last"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(0, texts[0], "f"), (None, "a b", "f")], "doc_id long, text string, file string").repartition(3)
    got = sorted(map(repr, T.token_counts(docs, block_tokens=block).collect()))
    rows = [(i, len(T.encode(t))) for i, t in enumerate(texts)] + [(0, len(T.encode(texts[0]))), (None, len(T.encode("a b")))]
    assert got == sorted(f"Row(doc_id={i}, n_tokens={n})" for i, n in rows)
    assert T.token_counts(docs.limit(0)).count() == 0


def test_boundaries_across_blocks_and_unended_documents(spark, tmp_path):
    end = 9
    files = {"a": [1, 2, 9, 9, 3, 4, 5, 6, 7], "b": [9], "c": [1] * 40 + [9, 2, 9], "d": [5, 5]}
    for name, ids in files.items():
        (tmp_path / f"{name}.tokens").write_bytes(np.array(ids, dtype="<u2").tobytes())
    (tmp_path / "e.tokens").write_bytes(b"")
    expected = []
    for name, ids in files.items():
        first, place = 0, 0
        for at, value in enumerate(ids + [None]):
            if value == end or (value is None and at > first):
                expected.append((f"{name}.tokens", place, first, at - first, value == end))
                first, place = at + 1, place + 1
    for block in (1, 2, 7, 100):
        got = T.document_tokens(T.scan_blocks(spark, str(tmp_path), end=end, block_tokens=block)).collect()
        assert sorted(map(tuple, got)) == sorted(expected)
    (tmp_path / "f.tokens").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        T.scan_blocks(spark, str(tmp_path / "f.tokens"))


def test_ids_that_would_be_the_end_or_wrap_are_an_error(spark, tmp_path):
    large = tmp_path / "large.tiktoken"
    large.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {70_000 if b == ord('z') else b}\n" for b in range(256)))
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert T.write_token_files(docs, str(tmp_path / "plain"), vocabulary=str(large)).count() == 2
    with pytest.raises(Exception, match="ids from 50256"):
        T.write_token_files(docs.union(spark.createDataFrame([(3, "z")], docs.schema)), str(tmp_path / "wide"), vocabulary=str(large))
