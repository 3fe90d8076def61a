"""STEP … BEGIN … END blocks of scripts and the facts found in them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallyline.functions.arrays import empty_strings, keep_last_values, let, posexplode_items, zip_last_values
from tallyline.functions.text import BLANKS, trim_blanks

# Block patterns.
FLAT_BLOCK = r"(?is)(STEP\d{3})\s*BEGIN(.*?)END"
# STEP\d{3}\s*BEGIN, or BEGIN or END as a word: a place is left at its first letter where it is none of theirs.
BLOCK_TOKEN = r"(?i)[SBE](?:TEP\d{3}(?<=STEP\d{3})\s*BEGIN|EGIN(?<=\bBEGIN)\b|ND(?<=\bEND)\b)"

# Fact patterns per version of the analysis. A word boundary is looked for only before the letters that
# a keyword begins with, and a name that no blank follows is not tried again from each of its letters.
TABLES = {
    1: r"(?i)(?=[FJIUM])\b(FROM|JOIN|INTO|UPDATE|MERGE INTO)\s+([`\w\.]+)",
    2: r"(?i)(?=[FJIUMR])\b(FROM|JOIN|INTO|UPDATE|MERGE INTO|RENAME TO)\s+([`\w\.]+)",
    3: r"(?i)(?=[FJIUMR])\b(FROM|JOIN|INTO|UPDATE|MERGE INTO|RENAME TO)\s+([`\w\.]+)",
    4: r"(?i)(?=[FJIUMR])\b(FROM|JOIN|INTO|UPDATE|MERGE\s+INTO|RENAME\s+TO)\s+([`\w\.]+)",
}
SELECT_LIST = r"(?is)SELECT\s+(.*?)\s+FROM"
SET_LIST = r"(?is)SET\s+(.*?)\s*(WHERE|;|\n)"
# The text after WHERE or ON, which ends before the first of these; only at G, O and W is one looked for, and no letter is read twice.
CONDITION = (
    r"(?is)[WO](?:HERE(?<=\bWHERE)|N(?<=\bON))\b\s+"
    r"([^;\nGOW]*+(?:(?!\b(?:GROUP BY|ORDER BY|WHEN)\b)[GOW][^;\nGOW]*+)*+)(?:[;\n]|GROUP BY|ORDER BY|WHEN)"
)
QUERY_WORD = r"(?i)[SIM](?:ELECT(?<=SELECT)|NSERT(?<=INSERT)|ERGE(?<=MERGE))"
ALIAS_AS = r"(?i)(?<!\w)(\w++(?:\.\w++)*+)\s++AS\s++(\w++)"
ALIAS_ANY = r"(?i)(?<!\w)(\w++(?:\.\w++)*+)\s++(?:AS\s++)?(\w++)"

# Defect messages.
NO_QUERY = "쿼리 본문에 SELECT/INSERT/MERGE 없음"
UNBALANCED = "BEGIN-END 블록 수 불일치"
NO_SEMICOLON = "END 구문 뒤에 세미콜론 없음"

_QUOTES = "`\"'"


def split_flat_blocks(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """Blocks that end at the first END; a repeated step keeps its first place and last content."""
    keep = [c for c in scripts.columns if c != text]
    names = F.regexp_extract_all(text, F.lit(FLAT_BLOCK), F.lit(1))
    contents = F.regexp_extract_all(text, F.lit(FLAT_BLOCK), F.lit(2))
    pairs = F.zip_with(names, contents, lambda n, c: F.struct(n.alias("name"), trim_blanks(c).alias("value")))
    rows = posexplode_items(keep_last_values(scripts.select(*keep, pairs.alias("_blocks")), "_blocks"), "_blocks", "_pos", "_block")
    return rows.select(
        *keep,
        (F.col("_pos") + 1).alias("block_ord"),
        F.col("_block.name").alias("step"),
        F.col("_block.value").alias("content"),
        (F.col("_block.value") != "").alias("valid"),
    )


@F.arrow_udf(ArrayType(IntegerType()))
def _block_lengths(weights: pa.Array, starts: pa.Array) -> pa.Array:
    """Per keyword the number of keywords up to the one that ends its block; 0 where none starts or ends.

    Array functions of Spark have no running state, and a sum per keyword would
    be quadratic, so this one step is a loop over an array of small numbers.
    """
    found = []
    for own, opens in zip(weights, starts):
        lengths, depth, waiting = [0] * len(own), 0, {}
        for at, (weight, is_start) in enumerate(zip(own.as_py(), opens.as_py())):
            depth += weight
            for start in waiting.pop(depth, ()):
                lengths[start] = at - start
            if is_start:
                waiting.setdefault(depth - 1, []).append(at)
        found.append(lengths)
    return pa.array(found, pa.list_(pa.int32()))


def split_nested_blocks(scripts: DataFrame, text: str = "raw") -> DataFrame:
    """Blocks whose BEGIN and END are matched by depth.

    The content runs up to and including the matching END; a block that never
    ends is left out; a block inside another one is also a block of its own.

    The script is cut into its keywords and the text before each, and a block
    ends at the first keyword after it where the depth falls below the depth it
    started from. One pass over the keywords finds all ends, so the time grows
    with the keywords and with the contents that come out.
    """
    keep = [c for c in scripts.columns if c != text]
    tokens, gaps = F.col("_tokens"), F.col("_gaps")
    cut = scripts.select(
        *keep,
        F.regexp_extract_all(text, F.lit(BLOCK_TOKEN), F.lit(0)).alias("_tokens"),
        F.split(text, BLOCK_TOKEN, -1).alias("_gaps"),
    )

    def starts_step(token: Column) -> Column:
        return F.length(token) > len("BEGIN")

    def weight(token: Column, i: Column) -> Column:
        whole_word = F.concat(F.lit("BEGIN"), F.get(gaps, i + 1)).rlike(r"^BEGIN\b") & token.rlike(r"(?i)\s+BEGIN$")
        return (
            F.when(starts_step(token), F.when(whole_word, 1).otherwise(0))
            .when(F.upper(token) == "BEGIN", 1)
            .otherwise(-1)
        )

    weighed = cut.withColumn("_weights", F.transform(tokens, weight)).withColumn(
        "_segments", F.zip_with(F.slice(gaps, 1, F.size(tokens)), tokens, lambda g, t: F.concat(g, t))
    )
    named = F.transform(tokens, lambda t: F.when(starts_step(t), F.regexp_extract(t, r"(?i)^(STEP\d{3})", 1)))
    deep = weighed.withColumn("_names", named).withColumn("_lengths", _block_lengths("_weights", F.transform("_names", lambda n: n.isNotNull())))
    starts = F.filter(
        F.transform(
            "_lengths", lambda n, i: F.struct(i.alias("at"), F.get("_names", i).alias("step"), n.alias("ends_after"))
        ),
        lambda s: s["ends_after"] > 0,
    )
    blocks = F.transform(
        starts,
        lambda s: F.struct(
            s["step"].alias("step"),
            trim_blanks(F.array_join(F.slice("_segments", s["at"] + 2, s["ends_after"]), "")).alias("content"),
        ),
    )
    rows = posexplode_items(deep.select(*keep, blocks.alias("_blocks")), "_blocks", "_pos", "_block")
    return rows.select(*keep, (F.col("_pos") + 1).alias("block_ord"), F.col("_block.step").alias("step"), F.col("_block.content").alias("content"))


def _unquoted(items: Column) -> Column:
    def bare(x: Column) -> Column:
        for quote in _QUOTES:
            x = F.replace(x, F.lit(quote), F.lit(""))
        return x

    return F.transform(items, bare)


def _parts(listed: Column) -> Column:
    """Comma-separated parts; empty ones at the end are dropped, a wholly empty list is one part."""
    cut = F.split(F.regexp_replace(listed, r",+\z", ""), ",", -1)
    ended = F.when(listed.rlike(r"\A,+\z"), empty_strings()).otherwise(cut)
    return F.when(listed.endswith(","), ended).otherwise(F.split(listed, ",", -1))


def _hits(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def _where_any(found: Column, use: Callable[[Column], Column]) -> Column:
    """``use(found)``; an empty list stays as it is."""
    return F.when(F.size(found) > 0, use(found)).otherwise(found)


def _tables(found: Column) -> Column:
    """Names hold no quote but the backtick, and no comma."""
    bare = F.split(F.replace(F.array_join(found, ","), F.lit("`"), F.lit("")), ",", -1)
    return F.array_distinct(F.when(F.size(found) > 0, bare).otherwise(found))


def _columns(selects: Column, sets: Column, version: int) -> Column:
    if version < 4:
        selects, sets = F.slice(selects, 1, 1), F.slice(sets, 1, 1)

    def selected(lists: Column) -> Column:
        trimmed = F.transform(F.flatten(F.transform(lists, _parts)), trim_blanks)
        return _unquoted(F.array_remove(trimmed, "") if version >= 4 else trimmed)

    def assigned(lists: Column) -> Column:
        return F.transform(
            F.filter(F.flatten(F.transform(lists, _parts)), lambda c: ~c.rlike(r"\A=+\z")),
            lambda c: trim_blanks(F.substring_index(c, "=", 1)),
        )

    return F.array_distinct(F.concat(_where_any(selects, selected), _where_any(sets, assigned)))


def _conditions(found: Column) -> Column:
    # A condition ends before a line break, so tabs are all there is to replace.
    flat = lambda c: F.when(F.contains(c, F.lit("\t")), F.regexp_replace(c, r"\t+", " ")).otherwise(c)
    return F.array_distinct(F.transform(found, lambda c: trim_blanks(flat(c))))


def block_tables(content: Column, version: int = 4) -> Column:
    """Distinct tables after FROM, JOIN, INTO, UPDATE (and RENAME TO from version 2)."""
    return let(_hits(content, TABLES[version], 2), _tables)


def block_columns(content: Column, version: int = 4) -> Column:
    """Distinct columns of SELECT lists, then of SET lists; before version 4 of the first of each only."""
    lists = F.array(_hits(content, SELECT_LIST), _hits(content, SET_LIST))
    return let(lists, lambda both: _columns(F.get(both, F.lit(0)), F.get(both, F.lit(1)), version))


def block_conditions(content: Column) -> Column:
    """Distinct conditions after WHERE or ON, on one line each."""
    return _conditions(_hits(content, CONDITION))


def block_alias_pairs(content: Column, version: int = 4) -> Column:
    """(name, value) = (alias, original) as found, repeated aliases included."""
    pattern = ALIAS_ANY if version >= 4 else ALIAS_AS
    return F.zip_with(
        _hits(content, pattern, 2), _hits(content, pattern, 1), lambda alias, original: F.struct(alias.alias("name"), original.alias("value"))
    )


def begin_end_counts(content: Column) -> tuple[Column, Column]:
    """Whole-word BEGIN and END keywords in a block."""
    return (
        F.regexp_count(content, F.lit(r"(?i)BEGIN(?<=\bBEGIN)\b")),
        F.regexp_count(content, F.lit(r"(?i)END(?<=\bEND)\b")),
    )


def block_errors(content: Column, version: int = 4, counts: tuple[Column, Column] | None = None) -> Column:
    """Defect messages of a block; ``counts`` are its BEGIN and END keywords where known already."""
    no_query = ~content.rlike(QUERY_WORD)
    if version >= 4:
        begins, ends = counts or begin_end_counts(content)
        unbalanced = F.concat(
            F.lit(f"{UNBALANCED}("), begins.cast("string"), F.lit("/"), ends.cast("string"), F.lit(")")
        )
    else:
        begins, ends = F.regexp_count(content, F.lit("BEGIN")), F.regexp_count(content, F.lit("END"))
        unbalanced = F.lit(UNBALANCED)
    return F.array_compact(
        F.array(
            F.when(no_query, F.lit(NO_QUERY)),
            F.when(begins != ends, unbalanced),
            F.when(~F.rtrim(content, F.lit(BLANKS)).endswith(";"), F.lit(NO_SEMICOLON)),
        )
    )


def block_facts(blocks: DataFrame, version: int = 4) -> DataFrame:
    """Replace the content of each block by its tables, columns, conditions, aliases and errors.

    What the patterns find is a projection of its own, so each pattern is tried once however often its hits are read.
    """
    content = F.col("content")
    keep = [c for c in blocks.columns if c != "content"]
    begins, ends = begin_end_counts(content)
    alias = ALIAS_ANY if version >= 4 else ALIAS_AS
    hits = {
        "begin_count": begins, "end_count": ends,
        "_tables": _hits(content, TABLES[version], 2), "_conditions": _hits(content, CONDITION),
        "_selects": _hits(content, SELECT_LIST), "_sets": _hits(content, SET_LIST),
        "_names": _hits(content, alias, 2), "_originals": _hits(content, alias, 1),
    }
    counts = (F.col("begin_count"), F.col("end_count"))
    facts = blocks.withColumns(hits).select(
        *keep,
        _tables(F.col("_tables")).alias("tables"),
        _columns(F.col("_selects"), F.col("_sets"), version).alias("columns"),
        _conditions(F.col("_conditions")).alias("conditions"),
        "_names",
        "_originals",
        block_errors(content, version, counts).alias("errors"),
        *counts,
    )
    ready = zip_last_values(facts, "_names", "_originals", "aliases")
    return ready.select(*keep, "tables", "columns", "conditions", "aliases", "errors", *counts)
