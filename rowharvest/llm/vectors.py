"""Operator 1, embedding near-dedup: one navigable small-world index per shard, every shard queried, links verified and united."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowharvest.llm import kernel as K
from rowharvest.llm.common import connected_components, spanning, stored

DEGREE = 16
#: Candidates of close-by similarity are followed too, so that a group is not left at its rim.
SLACK = 0.02


def _top(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``width`` most similar of each row, in order, and where they were."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), order


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` neighbours of each row, from candidates in falling similarity: first those that are
    more similar to the row's vector than to any neighbour taken, then the best of the rest. -1 fills up."""
    n, width = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = np.einsum("nad,nbd->nab", own, own)
    taken, closest = np.zeros((n, width), bool), np.full((n, width), -2.0, np.float32)
    for j in range(width):
        take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (taken.sum(axis=1) < degree)
        taken[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(ids < 0, 3.0, np.where(taken, 0.0, 1.0)) + np.arange(width) / (2 * width)
    order = np.argsort(rank, axis=1)[:, :degree]
    out = np.full((n, degree), -1, np.int32)
    out[:, :order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


@dataclass
class SmallWorld:
    """Hierarchical navigable small-world graph over unit vectors.

    ``order`` lists the nodes by falling level, so layer k holds the first ``sizes[k]`` of them;
    ``graphs[k]`` has the neighbours of each (all as places in ``order``).
    """

    order: np.ndarray
    vectors: np.ndarray  # in that order
    sizes: list[int]
    graphs: list[np.ndarray]

    @classmethod
    def build(cls, vectors: np.ndarray, *, degree: int = DEGREE, beam: int = 48) -> SmallWorld:
        """Layers from the top down. A node's level is drawn from its position's hash: a layer keeps about one in
        ``degree`` of the layer below. The nodes of the layer above are linked first, the others join in batches, each
        linked to what a beam search finds in the graph so far and to its own batch."""
        n = len(vectors)
        draw = (K.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2**53
        level = np.floor(-np.log(draw + 1e-18) / np.log(degree)).astype(int)
        order = np.argsort(-level, kind="stable")
        sizes = [int((level >= k).sum()) for k in range(level.max() + 1)] if n else []
        while len(sizes) > 1 and sizes[-1] < 2:
            sizes.pop()
        world = cls(order, np.ascontiguousarray(vectors[order], np.float32), sizes, [])
        graphs: list[np.ndarray] = []
        for k in range(len(sizes) - 1, -1, -1):
            world.graphs = graphs
            graphs.insert(0, world._layer(sizes[k], sizes[k + 1] if k + 1 < len(sizes) else 0, 2 * degree if k == 0 else degree, beam))
        world.graphs = graphs
        return world

    def _layer(self, size: int, above: int, degree: int, beam: int) -> np.ndarray:
        graph = np.full((size, degree), -1, np.int32)
        base = min(size, max(above, 256))
        for at in range(0, base, 512):
            own = np.arange(at, min(base, at + 512))
            sims = self.vectors[own] @ self.vectors[:base].T
            sims[np.arange(len(own)), own] = -2
            ids, sims, _ = _top(np.broadcast_to(np.arange(base), sims.shape), sims, min(beam, base - 1))
            if ids.shape[1]:
                graph[own] = _diverse(self.vectors, ids, sims, degree)
        at = base
        while at < size:
            own = np.arange(at, min(size, at + min(at, 1024)))
            queries = self.vectors[own]
            ids, sims = self._beam(graph, queries, self._descend(queries), beam, at)
            inside = queries @ queries.T
            np.fill_diagonal(inside, -2)
            near, near_sims, _ = _top(np.broadcast_to(own, inside.shape), inside, min(degree, len(own) - 1))
            ids, sims, _ = _top(np.concatenate([ids, near], 1), np.concatenate([sims, near_sims], 1), beam)
            graph[own] = _diverse(self.vectors, ids, sims, degree)
            self._link_back(graph, own, degree)
            at += len(own)
        return graph

    def _link_back(self, graph: np.ndarray, own: np.ndarray, degree: int) -> None:
        """Every new link also the other way round; a node with too many keeps a diverse choice."""
        far, near = graph[own].reshape(-1), np.repeat(own, degree)
        far, near = far[far >= 0], near[far >= 0]
        hit = np.unique(far)
        old = graph[hit]
        source = np.concatenate([np.repeat(hit, degree)[old.reshape(-1) >= 0], far])
        target = np.concatenate([old.reshape(-1)[old.reshape(-1) >= 0], near])
        pairs = np.unique(source.astype(np.int64) << 32 | target)
        source, target = pairs >> 32, pairs & 0xFFFFFFFF
        sims = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        by = np.lexsort((-sims, source))
        source, target, sims = source[by], target[by], sims[by]
        first = np.searchsorted(source, hit)
        place = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source))))
        keep = place < 3 * degree
        ids = np.full((len(hit), 3 * degree), -1, np.int64)
        values = np.full((len(hit), 3 * degree), -2, np.float32)
        row = np.searchsorted(hit, source[keep])
        ids[row, place[keep]], values[row, place[keep]] = target[keep], sims[keep]
        for at in range(0, len(hit), 1024):
            graph[hit[at:at + 1024]] = _diverse(self.vectors, ids[at:at + 1024], values[at:at + 1024], degree)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Entry points of the next layer down: the best nodes found in the layers there are."""
        entries = np.zeros((len(queries), 1), np.int64)
        for graph in reversed(self.graphs):
            ids, _ = self._beam(graph, queries, entries, 8, len(graph))
            entries = ids[:, :4]
        return entries

    def _beam(self, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, size: int, seen: np.ndarray | None = None,
              step: int = 4, floor: float = 9.0, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most similar nodes met from ``entries``, expanding the best open ones first. All nodes met with a
        similarity of ``floor`` or more go to ``met``, also those that a full beam has no place for."""
        n = len(queries)
        seen = np.zeros((n, size), bool) if seen is None else seen
        ids = np.full((n, width), -1, np.int64)
        sims, open_ = np.full((n, width), -2, np.float32), np.zeros((n, width), bool)
        rows = np.arange(n)
        entries = entries[:, :width]
        for j in range(entries.shape[1]):
            new = (entries[:, j] >= 0) & ~seen[rows, entries[:, j]]
            ids[new, j] = entries[new, j]
            sims[new, j] = np.einsum("nd,nd->n", queries[new], self.vectors[entries[new, j]])
            open_[new, j] = True
            seen[rows[new], entries[new, j]] = True
        active = rows
        while len(active):
            best = np.argsort(np.where(open_[active], -sims[active], 9), axis=1, kind="stable")[:, :step]
            live = np.take_along_axis(open_[active], best, 1)
            nodes = np.where(live, np.take_along_axis(ids[active], best, 1), -1)
            open_[active[:, None], best] = False
            near = np.where((nodes >= 0)[:, :, None], graph[np.maximum(nodes, 0)], -1).reshape(len(active), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[active[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            seen[active[r], near[r, c]] = True
            values = np.full(near.shape, -2, np.float32)
            values[r, c] = np.einsum("nd,nd->n", queries[active[r]], self.vectors[near[r, c]])
            if met is not None:
                r, c = np.nonzero(values >= floor)
                met.append((active[r], near[r, c], values[r, c]))
            all_ids, all_sims = np.concatenate([ids[active], near], 1), np.concatenate([sims[active], values], 1)
            all_open = np.concatenate([open_[active], near >= 0], 1)
            new_ids, new_sims, order = _top(all_ids, all_sims, width)
            ids[active], sims[active] = new_ids, new_sims
            open_[active] = np.take_along_axis(all_open, order, 1) & (new_ids >= 0)
            active = active[open_[active].any(axis=1)]
        return ids, sims

    def within(self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of nodes found with a similarity of ``least`` or more: a beam search, then every node that is
        (nearly) similar enough is expanded too, so the beam is as wide as a query's group. Queries that are nodes
        themselves (at ``own``) also begin at their own place, where their neighbours are."""
        size = self.sizes[0]
        seen = np.zeros((len(queries), size), bool)
        entries = self._descend(queries)
        if own is not None:
            entries = np.concatenate([own[:, None], np.where(entries == own[:, None], -1, entries)], axis=1)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids, sims = self._beam(self.graphs[0], queries, entries, beam, size, seen, floor=least - SLACK, met=met)
        at, c = np.nonzero((sims >= least - SLACK) & (ids >= 0) & (ids[:, :, None] == entries[:, None, :]).any(axis=2))
        met.append((at, ids[at, c], sims[at, c]))  # entry points that stayed
        q, node, value = (np.concatenate(x) for x in zip(*met))
        found_q, found_n, found_v = [q], [node], [value]
        while len(q):
            near = self.graphs[0][node].astype(np.int64)
            pairs = np.repeat(q, near.shape[1]) * size + near.reshape(-1)
            pairs = np.unique(pairs[near.reshape(-1) >= 0])
            q, node = pairs // size, pairs % size
            new = ~seen[q, node]
            q, node = q[new], node[new]
            seen[q, node] = True
            value = np.empty(len(q), np.float32)
            for at in range(0, len(q), 65_536):
                value[at:at + 65_536] = np.einsum("nd,nd->n", queries[q[at:at + 65_536]], self.vectors[node[at:at + 65_536]])
            near_enough = value >= least - SLACK
            q, node, value = q[near_enough], node[near_enough], value[near_enough]
            found_q.append(q)
            found_n.append(node)
            found_v.append(value)
        q, node, value = np.concatenate(found_q), np.concatenate(found_n), np.concatenate(found_v)
        keep = value >= least
        pairs = np.unique(q[keep] * size + node[keep])
        return pairs // size, pairs % size


def audited(world: SmallWorld, queries: np.ndarray, least: float, recall: float, beam: int, audit: int,
            own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``SmallWorld.within`` with a beam that is widened until, on evenly spaced queries compared with all vectors of the
    shard, at least ``recall`` of the true neighbours are found. A beam of more than a sixteenth of the shard would cost
    more than looking at all of it, so from there on the shard is scanned."""
    sample = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    true = np.zeros((len(sample), len(world.vectors)), bool)
    for at in range(0, len(sample), 64):
        true[at:at + 64] = queries[sample[at:at + 64]] @ world.vectors.T >= least
    while beam <= max(256, len(world.vectors) // 16):
        parts = [world.within(queries[at:at + 512], least, beam, None if own is None else own[at:at + 512]) for at in range(0, len(queries), 512)]
        q = np.concatenate([part[0] + 512 * i for i, part in enumerate(parts)])
        node = np.concatenate([part[1] for part in parts])
        got = np.zeros_like(true)
        row = np.searchsorted(sample, q)
        mine = (row < len(sample)) & (sample[np.minimum(row, len(sample) - 1)] == q)
        got[row[mine], node[mine]] = True
        if (got & true).sum() >= recall * true.sum():
            return q, node
        beam *= 4
    parts = [np.nonzero(queries[at:at + 512] @ world.vectors.T >= least) for at in range(0, len(queries), 512)]
    return np.concatenate([part[0] + 512 * i for i, part in enumerate(parts)]), np.concatenate([part[1] for part in parts])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def embedding_links(vectors: DataFrame, *, least: float = 0.93, recall: float = 0.99, shard_rows: int = 16_384, shard_bytes: int = 64 << 20,
                    block_rows: int = 2_048, beam: int = 32, audit: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id): links of cosine ``least`` or more between vectors of one label, one row per vector.

    Equal vectors of a label are one class, compared once and counted with their number. The classes of a label are dealt
    by hash into shards of at most ``shard_rows`` (fewer for long vectors), whatever the label's share of all rows; each shard gets
    its index, and every block of queries is put to its own and all later shards of the label, so each pair of shards is searched once.
    Found links are verified by cosine in double precision. A task sends counts and a spanning set of its links
    (at most one per vector), so a large group of near copies never leaves as all its pairs.

    Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing;
    so do vectors of different lengths. Rows with a null id are left out; rows that repeat an id are vectors of their own.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"),
                          F.col(label_col).alias("label")).where("vec_id is not null")
    # a double beyond the range of floats is infinite here and counts as not finite
    sound = (F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = stored(rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")).withColumn(
        "dim", F.size("vector")), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.least(F.lit(shard_rows), F.greatest(
        F.lit(256), F.floor(F.lit(shard_bytes) / (4 * F.col("dim")))))).alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("class", "vector"), "shards"))
    schema = "dim int, shard long, ids binary, copies binary, vectors binary, sizes array<long>, graphs array<binary>"

    def index(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        table = table.sort_by("class").combine_chunks()
        raw = _matrix(table.column("vector").chunk(0), dim)
        world = SmallWorld.build(_unit(raw))
        ids, copies = table.column("class").to_numpy()[world.order], table.column("n").to_numpy()[world.order]
        return pa.Table.from_pydict({
            "label": table.column("label").slice(0, 1), "dim": [dim], "shard": [shard], "ids": [ids.astype(np.int64).tobytes()],
            "copies": [copies.astype(np.int64).tobytes()], "vectors": [raw[world.order].tobytes()],
            "sizes": [world.sizes], "graphs": [[g.tobytes() for g in world.graphs]]},
            schema=pa.schema([("label", table.schema.field("label").type), ("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()),
                              ("copies", pa.binary()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int64())),
                              ("graphs", pa.list_(pa.binary()))]))

    label_kind = dict(classes.dtypes)["label"]
    indexes = stored(dealt.groupBy("label", "dim", "shard").applyInArrow(index, f"label {label_kind}, {schema}"), "vector-indexes")
    width = F.lit(block_rows)
    queries = indexes.select("label", "dim", F.col("shard").alias("from"), F.explode(F.sequence(
        F.lit(0), F.floor((F.length("ids") / 8 - 1) / width))).alias("block"), "ids", "copies", "vectors")
    part = lambda c, size: F.expr(f"substring({c}, cast(block * {block_rows} * {size} + 1 as int), cast({block_rows} * {size} as int))")
    queries = queries.select("label", "dim", "from", part("ids", "8").alias("q_ids"), part("copies", "8").alias("q_copies"),
                             part("vectors", "4 * dim").alias("q_vectors"))
    tasks = queries.join(indexes, ["label", "dim"]).where("`from` <= shard").repartition(F.xxhash64("label", "dim", "from", "shard", F.xxhash64("q_ids")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                floats = lambda raw: np.frombuffer(raw, np.float32).reshape(-1, dim)
                longs = lambda raw: np.frombuffer(raw, np.int64)
                raw, asked = floats(row["vectors"]), floats(row["q_vectors"])
                world = SmallWorld(np.arange(len(raw)), _unit(raw), row["sizes"],
                                   [np.frombuffer(g, np.int32).reshape(size, -1) for g, size in zip(row["graphs"], row["sizes"])])
                own = None
                if row["from"] == row["shard"]:
                    order = np.argsort(longs(row["ids"]), kind="stable")
                    own = order[np.searchsorted(longs(row["ids"])[order], longs(row["q_ids"]))]
                q, node = audited(world, _unit(asked), least - 1e-4, recall, beam, audit, own)
                a, b = longs(row["q_ids"])[q], longs(row["ids"])[node]
                keep = np.zeros(len(q), bool)
                for at in range(0, len(q), 65_536):
                    x, y = asked[q[at:at + 65_536]].astype(np.float64), raw[node[at:at + 65_536]].astype(np.float64)
                    cosine = np.einsum("nd,nd->n", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    keep[at:at + 65_536] = cosine >= least
                keep &= (row["from"] != row["shard"]) | (a != b)
                q, node, a, b = q[keep], node[keep], a[keep], b[keep]
                nodes, links = [longs(row["q_ids"])], [np.bincount(q, weights=longs(row["copies"])[node], minlength=len(asked)).astype(np.int64)]
                if row["from"] != row["shard"]:
                    nodes.append(longs(row["ids"]))
                    links.append(np.bincount(node, weights=longs(row["q_copies"])[q], minlength=len(raw)).astype(np.int64))
                nodes, links = np.concatenate(nodes), np.concatenate(links)
                some, tree = np.flatnonzero(links), spanning(a, b)
                yield pa.RecordBatch.from_pydict({"a": np.concatenate([nodes[some], a[tree]]), "b": np.concatenate([np.full(len(some), -1), b[tree]]),
                                                  "links": np.concatenate([links[some], np.zeros(len(tree), np.int64)])})

    found = stored(tasks.mapInArrow(search, "a long, b long, links long"), "vector-links")
    counts = found.where("links > 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("links = 0").select("a", "b"))
    classes = classes.join(counts, "class", "left").join(components, F.col("class") == components.node, "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    return rows.withColumn("label", F.when(F.col("sound"), F.col("label"))).join(classes, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
