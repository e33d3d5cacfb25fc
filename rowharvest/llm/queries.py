"""Registered queries of this subpackage, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowharvest.llm import (chat, chunked_bpe, decontaminate, divergence, language, lines, personal_data, runs, suffixes, token_files, trie_lm,
                            vectors, weighted_minhash)
from rowharvest.llm.common import remainder, table_reader
from rowharvest.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.embedding_links(table_reader(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query()
def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeats: the text holds 250 bytes (fifty words of five bytes with their spaces) that also start elsewhere; what is removed takes 400."""
    found = suffixes.remove_recurring(table_reader(spark, sf_dir, "documents"), passage=250)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "repeats")


@query()
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything returned is read back from the formatted text and its mask."""
    planted = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    table = table_reader(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    formatted = chat.format_conversations(chat.turn_messages(table.unionAll(spark.createDataFrame(planted, table.schema))))

    def digests(batches):
        hexed = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            out = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask"))):
                turns, loss = chat.read_turns(text), chat.read_mask(text, [(s["start"], s["end"]) for s in mask])
                out.append((conv, len(turns), hexed("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), hexed(loss), len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query()
def op4_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_lm.score_texts(table_reader(spark, sf_dir, "documents"), held=remainder("doc_id", 7) == 2)


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode(table_reader(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query()
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table_reader(spark, sf_dir, "documents"))


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_reader(spark, sf_dir, "documents")
    model = language.train(language.training_part(docs), tokenizer("piece_bpe_32k.model"))
    return language.predict_language(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
     k AS (SELECT rid, doc_id, line, pos, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
     j AS (SELECT rid, doc_id, line, pos, key IN (SELECT key FROM f) AS gone FROM k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid""")
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table_reader(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table_reader(spark, sf_dir, "documents"), table_reader(spark, sf_dir, "benchmark"))


@query()
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table_reader(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder and read back from the files."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table_reader(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))

    def digests(keys: pa.Array, places: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        wide, at = ids.astype("<u4"), places - places[0]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(places[:-1]), pa.array(np.diff(places)), pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:])], pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return token_files.map_documents(spark, path, digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query()
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = runs.find_runs(table_reader(spark, sf_dir, "documents"), seed=seed)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                         F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
                        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query(r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
     v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
     g AS (SELECT DISTINCT lang, source FROM d),
     s AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
     p AS (SELECT lang, s.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v)::HUGEINT AS p,
                  1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
           FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
     b AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
           FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 10""")
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table_reader(spark, sf_dir, "documents"))
