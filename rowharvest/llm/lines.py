"""Operator 8, line dedup: drop lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowharvest.llm.common import stored

#: White space stripped from both ends of a line before it is compared.
BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, one byte a character.

    Reading the UTF-8 bytes as Latin-1 makes ``lower`` (a fast built-in) change A-Z and, beyond ASCII, only
    lead bytes of two-byte characters, which their single continuation byte still tells apart from
    three- and four-byte ones. So two keys are equal exactly when the lines are equal up to A-Z.
    """
    folded = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
    return F.transform(F.split(folded, "\n"), lambda line: F.btrim(line, F.lit(BLANK)))


def long_enough(key: Column, min_chars: int) -> Column:
    if min_chars <= 1:
        return key != "" if min_chars == 1 else F.lit(True)
    return F.length(F.regexp_replace(key, "[\\x{80}-\\x{BF}]", "")) >= min_chars


def _cut(docs: DataFrame, min_documents: int, min_chars: int, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """(row, n_lines, n_dropped, kept): row holds the named columns of a document, kept its text without common lines."""
    row = docs.select(F.struct(*columns).alias("row"))
    ident, text = F.col("row").getField(id_col), F.coalesce(F.col("row").getField(text_col), F.lit(""))
    keyed = lambda key: (F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))  # noqa: E731  two independent hashes
    distinct = row.select(F.explode(F.array_distinct(line_keys(text))).alias("key")).where(long_enough(F.col("key"), min_chars))
    frequent = stored(distinct.select(*keyed(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_documents).select("h1", "h2"), "frequent-lines")
    lines = row.select(ident.alias("ident"), F.xxhash64(text).alias("tag"), F.posexplode(line_keys(text)).alias("pos", "key")).where(
        long_enough(F.col("key"), min_chars)).select("ident", "tag", "pos", *keyed(F.col("key")))
    dropped = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("ident", "tag").agg(F.collect_set("pos").alias("dropped"))
    joined = row.select("row", ident.alias("ident"), F.xxhash64(text).alias("tag")).alias("d").join(
        dropped.alias("x"), F.col("d.ident").eqNullSafe(F.col("x.ident")) & (F.col("d.tag") == F.col("x.tag")), "left")
    whole = joined.select("row", F.split(text, "\n").alias("lines"), F.coalesce(F.col("x.dropped"), F.array().cast("array<int>")).alias("dropped"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.size("dropped") == 0, text).otherwise(F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n"))
    return whole.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, *, min_documents: int = 10, min_chars: int = 1, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each document without the lines found in ``min_documents`` or more.

    A line's key is the line without white space at both ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points are never dropped. All lines with a dropped key go, in every document; the
    others stay in order, joined by a line feed. kept is '' when all lines go.

    Counts need one row per document and distinct key, pre-aggregated before the shuffle. Marking joins
    lines (hashes only, no text) with the frequent keys, which are written first: a very common line then is
    a skewed join of two plain tables, which adaptive execution splits. The dropped positions of a document meet its text in one join, and the
    text is taken apart and put together inside its row, in time proportional to its lines.

    A null text is one empty line. Every row is a document: rows that repeat an id are counted, cut and
    returned each on their own, also where the id is null. Other columns are ignored. An empty table gives an empty result.
    """
    found = _cut(docs, min_documents, min_chars, id_col, text_col, [id_col, text_col])
    return found.select(F.col("row").getField(id_col).alias("doc_id"), "n_lines", "n_dropped", "kept")


def drop_common_lines(docs: DataFrame, *, min_documents: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its common lines taken out of the text, see ``line_dedup``; all other columns stay as they are."""
    found = _cut(docs, min_documents, min_chars, id_col, text_col, docs.columns)
    return found.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
