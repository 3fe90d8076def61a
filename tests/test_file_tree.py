from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tallyline.plans import texts as jobs
from tallyline.plans.scripts import check_job, scan_job
from tallyline.sinks import file_tree as T
from tallyline.sources import scripts as S


def files(spark, rows):
    return spark.createDataFrame(rows, "p string, c string")


def tree(folder):
    return {str(f.relative_to(folder)): f.read_text() for f in folder.rglob("*") if f.is_file() and T.MANIFEST not in str(f) and not f.name.startswith(".")}


def beside(folder):
    return sorted(f.name for f in folder.parent.iterdir())


NEW = [("a.txt", "1"), ("d/b c.txt", "zwei é"), ("d/e/c.txt", "")]


def write(spark, root, rows):
    return T.write_tree(files(spark, rows), str(root), F.col("p"), F.col("c"))


def test_a_tree_replaces_the_old_one_whole(spark, tmp_path):
    root = tmp_path / "out"
    assert write(spark, root, [("old.txt", "x"), ("a.txt", "y")]) == (2, 2)
    for _ in range(2):
        assert write(spark, root, NEW) == (3, 8)
        assert tree(root) == dict(NEW) and beside(root) == ["out"]
    listed = {r["path"]: (r["bytes"], r["sha256"]) for r in T.read_manifest(spark, str(root)).collect()}
    assert listed == {p: (len(c.encode()), hashlib.sha256(c.encode()).hexdigest()) for p, c in NEW}
    assert T.tree_faults(spark, str(root)).count() == 0
    assert write(spark, root, []) == (0, 0) and tree(root) == {} and T.read_manifest(spark, str(root)).count() == 0


def test_a_job_that_fails_half_way_leaves_the_old_tree(spark, tmp_path):
    root = tmp_path / "out"
    write(spark, root, NEW)
    rows = spark.range(0, 200, 1, 4).select(F.concat(F.lit("n/"), "id").alias("p"), F.when(F.col("id") == 199, F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).alias("c"))
    with pytest.raises(Exception, match="stop"):
        T.write_tree(rows, str(root), F.col("p"), F.col("c"))
    assert tree(root) == dict(NEW) and beside(root) == ["out"]
    assert T.tree_faults(spark, str(root)).count() == 0


def test_a_driver_that_ends_between_the_renames_loses_nothing(spark, tmp_path, monkeypatch):
    root, rename = tmp_path / "out", T._Folder.rename

    def killed(self, suffix, to):
        if suffix.startswith(T._STAGED):
            raise KeyboardInterrupt
        rename(self, suffix, to)

    write(spark, root, NEW)
    monkeypatch.setattr(T._Folder, "rename", killed)
    with pytest.raises(KeyboardInterrupt):
        write(spark, root, [("other.txt", "z")])
    monkeypatch.undo()
    assert not root.exists()
    assert T.read_manifest(spark, str(root)).count() == 3 and tree(root) == dict(NEW)
    assert write(spark, root, [("other.txt", "z")]) == (1, 1) and tree(root) == {"other.txt": "z"}


def test_faults_and_refused_paths(spark, tmp_path):
    root = tmp_path / "out"
    write(spark, root, NEW)
    (root / "a.txt").write_text("2")
    (root / ".a.txt.crc").unlink(missing_ok=True)
    (root / "d" / "b c.txt").unlink()
    (root / "more.txt").write_text("x")
    assert {tuple(r) for r in T.tree_faults(spark, str(root)).collect()} == {("a.txt", "changed"), ("d/b c.txt", "missing"), ("more.txt", "unlisted")}
    for rows in ([("a", "1"), ("a", "2")], [("_manifest/x", "1")]):
        with pytest.raises(ValueError):
            write(spark, root, rows)


@pytest.fixture
def broken(tmp_path):
    """A folder with a script that does not fit its checksum, one with bad bytes, a long one, and a good one."""
    root = tmp_path / "in"
    (root / "d").mkdir(parents=True)
    (root / "good.sql").write_text("select 1")
    (root / "d" / "bad.sql").write_bytes(b"select \xff")
    (root / "long.sql").write_text("x" * 500)
    (root / "d" / "broken.sql").write_text("select 2")
    (root / "d" / ".broken.sql.crc").write_bytes(b"crc\0" + struct.pack(">II", 512, 12345))
    return str(root)


def test_every_file_is_accepted_or_listed(spark, broken):
    for strict in (False, True):
        want = {("d/broken.sql", "unreadable")} | ({("d/bad.sql", "not UTF-8")} if strict else set())
        for limit in (None, 100):
            lost = want | ({("long.sql", "too large")} if limit else set())
            options = {"strict": strict, "max_bytes": limit}
            scanned = S.scan_scripts(spark, broken, **options)
            assert {(r["path"], r["reason"]) for r in S.rejected(scanned).collect()} == lost
            assert {(r["path"], r["reason"]) for r in S.skipped_scripts(spark, broken, **options).collect()} == lost
            read = sorted(map(tuple, S.read_scripts(spark, broken, **options).collect()))
            assert sorted(map(tuple, S.accepted(scanned).collect())) == read and len(read) + len(lost) == 4
    assert S.skipped_scripts(spark, broken).select("path").count() == 1 and S.skipped_scripts(spark, broken, strict=True).count() == 2


def test_one_reading_serves_the_written_and_the_left_out(spark, broken, tmp_path):
    tagged = jobs.scan_rewrites(spark, broken, to_charset="EUC-KR", transform=F.upper)
    assert jobs.write_rewrites(tagged, str(tmp_path / "out"))[0] == 2
    assert (tmp_path / "out" / "good.sql").read_text() == "SELECT 1"
    assert {(r["path"], r["reason"]) for r in tagged.where("bytes is null").collect()} == {("d/broken.sql", "unreadable"), ("d/bad.sql", "not UTF-8")}
    assert {(r["path"], r["reason"]) for r in jobs.skipped_rewrites(spark, broken).collect()} == {("d/broken.sql", "unreadable"), ("d/bad.sql", "not UTF-8")}


def test_jobs_replace_their_target_whole(spark, broken, tmp_path):
    out = tmp_path / "out"
    write(spark, out, [("stale.sql", "x")])
    assert jobs.rewrite_job(spark, broken, str(out), whole=True)[0] == 2
    assert sorted(tree(out)) == ["good.sql", "long.sql"] and T.tree_faults(spark, str(out)).count() == 0
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.sql").write_text("INSERT INTO dw.t SELECT * FROM dw.s")
    for whole in (False, True):
        assert check_job(spark, str(tmp_path / "q"), str(tmp_path / "checks"), whole=whole)[0] == 2
        assert sorted(f.name for f in (tmp_path / "checks").glob("*.sql")) == ["a_bq.sql", "a_oracle.sql"]
    assert scan_job(spark, str(tmp_path / "q"), str(tmp_path / "scans"), whole=True)[0] == 1
