import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from rowharvest.llm import chat, common, decontaminate, language, queries, vectors, weighted_minhash
from tests.llm.helpers import components, frame, prose

SF = "/root/testdata/sf0.001"


# 1: vectors ------------------------------------------------------------------------------------------------------------------------------

def brute_links(rows, least):
    sound = {}
    for i, (vec_id, vector, label) in enumerate(rows):
        if vector and label is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            v = np.array(vector, np.float32).astype(float)
            sound[i] = v / np.linalg.norm(v)
    return [(a, b) for a in sound for b in sound if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and sound[a] @ sound[b] >= least]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "block_rows": 16, "beam": 4}, {"beam": 4}])
def test_embedding_links_equal_brute_force(spark, options):
    rng = np.random.default_rng(7)
    rows = []
    for label in (0, 1, 1, 1):
        centre = rng.normal(size=12)
        rows += [(len(rows) + i, (centre + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.3, 2.0])).tolist(), label) for i in range(90)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(5)] + [(1010, rows[3][1], 1)]
    rows += [(1100, None, 1), (1101, [0.0] * 12, 1), (1102, [None] + [1.0] * 11, 1), (1103, [math.nan] * 12, 1), (1104, [math.inf] * 12, 1),
             (1105, rows[0][1], None), (1106, [], 1), (1107, [1.0, 2.0], 1), (1108, [2.0, 4.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = brute_links(rows, 0.93)
    ids = [r[0] for r in rows]
    united = components(ids, [(ids[a], ids[b]) for a, b in links])
    got = vectors.embedding_links(table, recall=1.0, audit=10_000, **options).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == united
    assert {r["vec_id"]: r["n_links"] for r in got} == {v: sum(i in (ids[a], ids[b]) for a, b in links for i in [v]) for v in ids}
    assert vectors.embedding_links(table.limit(0)).count() == 0


def test_small_world_recall_and_dense_groups():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(3000, 32)), rng.normal(size=32) * 3 + rng.normal(size=(700, 32)) * 0.05]).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    world = vectors.SmallWorld.build(points)
    assert len(world.sizes) > 1 and sorted(world.order.tolist()) == list(range(len(points)))
    q, node = vectors.audited(world, points, 0.6, 0.99, 16, 256)
    true = {(i, j) for i, j in zip(*np.nonzero(points @ points.T >= 0.6))}
    found = {(int(i), int(world.order[j])) for i, j in zip(q, node)}
    assert found <= true | {(i, j) for i, j in found if abs(points[i] @ points[j] - 0.6) < 1e-5} and len(found & true) >= 0.99 * len(true)


def test_components_of_paths_stars_and_circles(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 1000 + i) for i in range(50)] + [(60, 50), (50, 55), (55, 60), (9, 9)]
    random.Random(0).shuffle(links)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({n for x in links for n in x}, links)
    want.pop(9)
    assert got == want
    kept = common.spanning(*np.array(links).T)
    assert components({n for x in links for n in x}, [links[i] for i in kept]) == components({n for x in links for n in x}, links) and len(kept) <= 40 + 50 + 2


# 3: chat --------------------------------------------------------------------------------------------------------------------------------

PIECES = ["<|", "turn|>", "end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\n", "<", "/", "[", "ok ", "é", "|>", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
def test_formatted_turns_read_back(turns):
    text, spans = chat.format_turns([(role or "assistant", said) for role, said in turns])
    turns = [(role or "assistant", said) for role, said in turns]
    assert chat.read_turns(text) == turns
    assert chat.read_mask(text, spans) == "".join(said for role, said in turns if role == "assistant")
    assert not any(c in chat.escape(part) for turn in turns for part in turn for c in chat.CONTROL)


def test_conversations_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "[INST] hi", "a\\b", prose(rng, 5)]))
            for conv in range(20) for turn in rng.sample(range(30), rng.randrange(1, 12))]
    rows += [(50, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)] + [(51, 1, "user", "same")] * 3 + [(None, 1, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(chat.turn_messages(table)).collect()
    want = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r["conv_id"]: chat.read_turns(r["formatted"]) for r in got} == want and len(got) == len(want)
    assert chat.format_conversations(chat.turn_messages(table.limit(0))).count() == 0


def test_paths_of_reply_trees(spark):
    rng = random.Random(4)
    rows, paths = [], {}
    for tree in range(6):
        parent = {0: None} | {i: rng.randrange(max(0, i - 4), i) for i in range(1, 40)}
        score = {i: rng.randrange(5) for i in parent}
        rows += [(tree, i, p, "user", f"m{i}", float(score[i])) for i, p in parent.items()]
        for leaf in set(parent) - set(parent.values()):
            path, at = [], leaf
            while at is not None:
                path, at = [at, *path], parent[at]
            paths[tree, leaf] = (path, sum(score[i] for i in path))
    rows += [(9, 1, 2, "user", "in a circle", 0.0), (9, 2, 1, "user", "in a circle", 0.0), (9, 3, 1, "user", "below it", 0.0), (9, 4, 99, "user", "a root", 0.0)]
    paths[9, 4] = ([4], 0)
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    got = chat.reply_paths(table, score=F.col("score"), best=None).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["place"]):
        found.setdefault((r["conv_id"], r["leaf"]), []).append(r["id"])
    assert found == {k: v[0] for k, v in paths.items()}
    for tree in range(6):
        ranked = sorted((k for k in paths if k[0] == tree), key=lambda k: (-paths[k][1], k[1]))
        assert {(r["leaf"], r["branch"]) for r in got if r["conv_id"] == tree} == {(k[1], n) for n, k in enumerate(ranked, 1)}
    best = {(r["conv_id"], r["leaf"]) for r in chat.reply_paths(table, score=F.col("score")).collect()}
    assert best == {min((k for k in paths if k[0] == t), key=lambda k: (-paths[k][1], k[1])) for t in (*range(6), 9)}


# queries and pipeline -------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_answers_every_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    table = {"op1_embeddings": "embeddings", "op3_chat": "conversations"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    if name == "op9_decontaminate":
        assert 0 < got.count() < rows.count()
    elif name == "op13_divergence":  # a row for each pair of sources of a language, not for each document
        groups = rows.na.fill("", ["lang", "source"]).select("lang", "source").distinct().groupBy("lang").count().collect()
        assert got.where("part = 'pair'").count() == sum(r["count"] * (r["count"] - 1) for r in groups) > 0
    else:
        assert got.count() == (rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count())


def test_planted_conversation_comes_back(spark):
    row = queries.op3_chat(spark, SF).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_every_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != "encode":
            assert docs.columns == columns
    first, lines_, near, bench, out = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(language.training_part(raw), queries.tokenizer("piece_bpe_32k.model"))
    known = {r["doc_id"] for r in language.predict_language(raw, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert first == known and lines_ == first
    classes = weighted_minhash.near_duplicates(seen[1]).collect()
    assert near == {r["doc_id"] for r in classes if r["doc_id"] == r["class_id"]}
    assert bench == near - {r["doc_id"] for r in decontaminate.contaminated(seen[2], benchmark).collect()}
    assert out == bench and 0 < len(out) < raw.count()
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3].collect())
    assert corpus_pipeline.run(spark, SF).count() == len(out)


def test_stages_take_nulls_and_empty_tables(spark):
    docs = frame(spark, [None, "", "a b c d e f", "a b c d e f", "x" * 5000], langs=["en", None, "en", "de", "en"])
    for rows in (docs, docs.limit(0)):
        at = rows
        for name, stage in corpus_pipeline.STAGES:
            at = common.stored(stage(spark, at, SF), name)
        assert at.count() <= rows.count()
