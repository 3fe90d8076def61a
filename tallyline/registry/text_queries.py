"""Queries for charsets, comments, whitespace and whole-text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators.lineage import extract_stats
from tallyline.operators.line_stats import extension_counts
from tallyline.registry import inputs as I
from tallyline.session import charset_support, scratch_path
from tallyline.sinks.file_tree import read_manifest, tree_contents, tree_faults, write_files, write_tree
from tallyline.sources.scripts import decode_text, encode_text, read_scripts, scan_scripts, skipped_scripts

# Every turn of a conversation is a file; one in five has another extension.
FILES_SQL = """SELECT concat('c', CAST(conv_id % 10 AS STRING), '/', CAST(conv_id AS STRING), '_', CAST(turn AS STRING),
  CASE WHEN (conv_id + turn) % 5 = 0 THEN '.txt' WHEN (conv_id + turn) % 5 = 1 THEN '.SQL' ELSE '.sql' END) AS path, text
  FROM conversations"""


def _write_turns(spark, sf):
    root = scratch_path(spark, "corpus")
    turns = I.run_sql(spark, sf, FILES_SQL, conversations="conversations")
    write_files(turns, root, F.col("path"), F.col("text"))
    return root


def corpus_scan(spark, sf):
    return read_scripts(spark, _write_turns(spark, sf))


def corpus_scan_any_case(spark, sf):
    return read_scripts(spark, _write_turns(spark, sf), glob="*.[sS][qQ][lL]", max_bytes=400)


def corpus_skipped(spark, sf):
    """What a strict scan with a size limit leaves out, and why."""
    root = scratch_path(spark, "corpus")
    turns = I.run_sql(spark, sf, FILES_SQL, conversations="conversations")
    content = F.when(F.col("text").contains("a"), F.encode("text", "UTF-8")).otherwise(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    write_files(turns, root, F.col("path"), content)
    return skipped_scripts(spark, root, strict=True, max_bytes=400)


# Scripts of which some are no UTF-8 and some do not fit their checksum file; most checksum files are not there at all.
_BROKEN_SQL = f"""SELECT path, length(text) % 3 = 0 AS broken, CASE WHEN contains(text, 'a') THEN encode(text, 'UTF-8')
  ELSE concat(encode(text, 'UTF-8'), X'FF') END AS content FROM ({FILES_SQL})"""


def corpus_scan_tagged(spark, sf):
    """Every script once, with its text or the reason why there is none: broken, too large, not UTF-8."""
    root = scratch_path(spark, "corpus")
    files = I.run_sql(spark, sf, _BROKEN_SQL, conversations="conversations")
    # A checksum file in the local file system's form, with sums of zero.
    sums = F.concat(F.unhex(F.lit("6372630000000200")), F.unhex(F.repeat(F.lit("00000000"), (F.octet_length("content") / 512 + 1).cast("int"))))
    beside = F.concat(F.substring_index("path", "/", 1), F.lit("/."), F.substring_index("path", "/", -1), F.lit(".crc"))
    both = files.select(F.explode(F.array(F.struct("path", "content"), F.struct(F.when(F.col("broken"), beside).alias("path"), sums.alias("content")))).alias("f")).select("f.*")
    write_files(both.where("path is not null"), root, F.col("path"), F.col("content"))
    return scan_scripts(spark, root, strict=True, max_bytes=400)


def file_tree(spark, sf):
    """A tree of files written twice over another one, with its manifest, read back."""
    root = f"{scratch_path(spark, 'tree')}/files"
    turns = I.run_sql(spark, sf, FILES_SQL, conversations="conversations")
    write_tree(turns.select(F.concat(F.lit("old/"), "path").alias("path"), F.upper("text").alias("text")), root, F.col("path"), F.col("text"))
    for _ in range(2):
        write_tree(turns, root, F.col("path"), F.col("text"))
    found = tree_contents(spark, root).select("path", F.col("sha256").alias("found"), F.decode("content", "UTF-8").alias("text"))
    return read_manifest(spark, root).join(found, "path", "full_outer")


def file_tree_faults(spark, sf):
    """Files of a tree that were changed and added behind its manifest."""
    root = f"{scratch_path(spark, 'tree')}/files"
    turns = I.run_sql(spark, sf, FILES_SQL, conversations="conversations")
    write_tree(turns, root, F.col("path"), F.col("text"))
    changed = turns.select(F.when(F.col("path").endswith(".txt"), F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.concat("text", F.lit("!")).alias("text"))
    write_files(changed.where(~F.col("path").endswith(".SQL")), root, F.col("path"), F.col("text"))
    return tree_faults(spark, root)


def decode_replaced(spark, sf):
    """Every text as bytes with a bad byte at the end."""
    docs = I.documents(spark, sf, "doc_id, concat(encode(text, 'UTF-8'), X'FF') AS content")
    return decode_text(spark, docs, "content", "UTF-8", "text").select("doc_id", "text")


def decode_strict(spark, sf):
    """Every third text has a bad byte; those rows are skipped."""
    docs = I.documents(
        spark, sf, "doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(encode(text, 'UTF-8'), X'FF') ELSE encode(text, 'UTF-8') END AS content"
    )
    return decode_text(spark, docs, "content", "UTF-8", "text", strict=True).select("doc_id", "text")


def text_transcode(spark, sf):
    """To Latin-1 and back: what it cannot express becomes a question mark."""
    latin = encode_text(spark, I.documents(spark, sf), "text", "ISO-8859-1", "bytes")
    with charset_support(spark):
        return latin.select("doc_id", F.decode("bytes", "ISO-8859-1").alias("text"))


def sql_strip_comments(spark, sf):
    scripts = I.scripts(spark, sf).select("path", "raw")
    styles = ("std", "scan", "simple", "linecount")
    return scripts.select("path", *[T.strip_comments(F.col("raw"), s).alias(s) for s in styles])


def strip_comment_backticks(spark, sf):
    return I.scripts(spark, sf).select("path", T.strip_comment_backticks(F.col("raw")).alias("raw"))


TRAILING_SQL = "doc_id, replace(text, '. ', concat('.  ', chr(9), chr(13), chr(10))) AS text"
TABBED_SQL = "doc_id, replace(text, 'e ', concat('e', chr(9))) AS text"


def text_trailing_spaces(spark, sf):
    return I.documents(spark, sf, TRAILING_SQL).withColumn("text", T.strip_trailing_spaces(F.col("text")))


def text_tabs_to_spaces(spark, sf):
    docs = I.documents(spark, sf, TABBED_SQL)
    return docs.select("doc_id", *[T.tabs_to_spaces(F.col("text"), n).alias(f"text{n}") for n in (2, 4)])


def sql_statistics(spark, sf):
    """Table statistics of the corpus of scripts."""
    stats = extract_stats(I.scripts(spark, sf).select("path", "raw"))
    return stats.withColumn("tables", F.array_join(F.array_sort("tables"), "; "))


def sql_statistics_documents(spark, sf):
    """The same over plain prose, where the words FROM and JOIN are followed by anything."""
    stats = extract_stats(I.documents(spark, sf), "text")
    return stats.withColumn("tables", F.array_join(F.array_sort("tables"), "; "))


NAMES_SQL = """SELECT concat('f_', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 6 = 0 THEN ''
  WHEN o_orderkey % 6 = 1 THEN '.' WHEN o_orderkey % 6 = 2 THEN '.tar.GZ' WHEN o_orderkey % 6 = 3 THEN '.Sql'
  ELSE '.sql' END) AS name FROM orders"""


def ext_counts(spark, sf):
    return extension_counts(I.run_sql(spark, sf, NAMES_SQL, orders="orders"))


QUERIES = {
    q.__name__: q
    for q in (
        corpus_scan, corpus_scan_any_case, corpus_skipped, corpus_scan_tagged, file_tree, file_tree_faults, decode_replaced, decode_strict, text_transcode, sql_strip_comments,
        strip_comment_backticks, text_trailing_spaces, text_tabs_to_spaces, sql_statistics,
        sql_statistics_documents, ext_counts,
    )
}

BLOCKS_OUT = r"regexp_replace({0}, '(?s)/\*.*?\*/', '{1}', 'g')"


def stats_oracle(key: str, source: str) -> str:
    return rf"""SELECT s.{key}, coalesce(t.tables, '') AS tables, s.uses_select_all FROM
      (SELECT {key}, regexp_matches(raw, '(?i)SELECT\s+\*') AS uses_select_all FROM ({source})) s LEFT JOIN
      (SELECT {key}, string_agg(t, '; ' ORDER BY t) AS tables FROM
        (SELECT DISTINCT {key}, unnest(regexp_extract_all(raw, '(?i)(FROM|JOIN)\s+`?([\w.-]+)`?', 2)) AS t FROM ({source}))
       GROUP BY {key}) t ON s.{key} = t.{key}"""


ORACLES = {
    "corpus_scan": f"""SELECT path, split_part(path, '/', 2) AS name, strlen(text) AS length, text AS raw
      FROM ({FILES_SQL}) WHERE path LIKE '%.sql'""",
    "corpus_scan_any_case": f"""SELECT path, split_part(path, '/', 2) AS name, strlen(text) AS length, text AS raw
      FROM ({FILES_SQL}) WHERE lower(path) LIKE '%.sql' AND strlen(text) <= 400""",
    "corpus_skipped": f"""SELECT path, length, CASE WHEN length > 400 THEN 'too large' ELSE 'not UTF-8' END AS reason FROM (
      SELECT path, strlen(text) + CASE WHEN contains(text, 'a') THEN 0 ELSE 1 END AS length, NOT contains(text, 'a') AS bad FROM ({FILES_SQL}) WHERE path LIKE '%.sql')
      WHERE length > 400 OR bad""",
    "corpus_scan_tagged": f"""SELECT path, split_part(path, '/', 2) AS name, length,
      CASE WHEN length <= 400 AND NOT broken AND NOT bad THEN text END AS raw,
      CASE WHEN length > 400 THEN 'too large' WHEN broken THEN 'unreadable' WHEN bad THEN 'not UTF-8' END AS reason
      FROM (SELECT path, text, length(text) % 3 = 0 AS broken, NOT contains(text, 'a') AS bad,
        strlen(text) + CASE WHEN contains(text, 'a') THEN 0 ELSE 1 END AS length FROM ({FILES_SQL}))
      WHERE path LIKE '%.sql'""",
    "file_tree": f"SELECT path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, sha256(text) AS found, text FROM ({FILES_SQL})",
    "file_tree_faults": f"""SELECT path, CASE WHEN path LIKE '%.new' THEN 'unlisted' ELSE 'changed' END AS fault
      FROM (SELECT CASE WHEN path LIKE '%.txt' THEN concat(path, '.new') ELSE path END AS path FROM ({FILES_SQL})) WHERE path NOT LIKE '%.SQL'""",
    "decode_replaced": "SELECT doc_id, concat(text, chr(65533)) AS text FROM documents",
    "decode_strict": "SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0",
    "text_transcode": r"SELECT doc_id, regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') AS text FROM documents",
    "sql_strip_comments": rf"""SELECT path,
      regexp_replace({BLOCKS_OUT.format('raw', ' ')}, '--.*?(\r?\n|$)', ' ', 'g') AS std,
      {BLOCKS_OUT.format('raw', ' ')} AS scan,
      regexp_replace({BLOCKS_OUT.format('raw', ' ')}, '--[^\r\n]*', ' ', 'g') AS simple,
      {BLOCKS_OUT.format(r"regexp_replace(raw, '(?m)--.*$', '', 'g')", '')} AS linecount
      FROM ({I.SCRIPTS_SQL})""",
    "strip_comment_backticks": f"SELECT path, raw FROM (SELECT {I.script_columns(tick='')} FROM orders)",
    "text_trailing_spaces": rf"""SELECT doc_id, regexp_replace(text, '(?m)[ \t\x0B\f\r]+$', '', 'g') AS text
      FROM (SELECT {TRAILING_SQL} FROM documents)""",
    "text_tabs_to_spaces": f"""SELECT doc_id, replace(text, chr(9), '  ') AS text2, replace(text, chr(9), '    ') AS text4
      FROM (SELECT {TABBED_SQL} FROM documents)""",
    "sql_statistics": stats_oracle("path", I.SCRIPTS_SQL),
    "sql_statistics_documents": stats_oracle("doc_id", "SELECT doc_id, text AS raw FROM documents"),
    "ext_counts": f"""SELECT CASE WHEN name NOT LIKE '%_._%' OR name LIKE '%.' THEN 'noext'
      ELSE lower(split_part(name, '.', -1)) END AS ext, count(*) AS files FROM ({NAMES_SQL}) GROUP BY 1""",
}
