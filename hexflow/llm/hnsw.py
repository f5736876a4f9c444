"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards by a hash of their id.  A shard's graph has layers of geometrically
fewer nodes; each layer is built by inserting batches of nodes next to their nearest ones, with
neighbours chosen for diversity, and entered through the layer above.  Every vector queries every
shard.  Beams widen until an audit against brute force, of a fixed number of the queries of a task,
reaches the wanted recall, and for any query whose beam holds nothing but links.  Cosines are
verified in double precision.  A task returns link counts and a spanning forest of its links, so a
dense group costs as many rows as it has members, not as it has pairs.

A shard's graph has at most ``shard_bytes``; it meets its queries at the head of a sorted partition
and these stream past it, so a task holds one graph and a piece of its queries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.components import components
from hexflow.llm.scratch import Scratch
from hexflow.llm.text import mix


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    neighbours: int = 12
    build_beam: int = 48
    beam: int = 32
    #: Queries of a task that are also answered by brute force.
    audits: int = 128
    recall: float = 0.99
    #: Shards at least; more are made where a shard would hold more vectors or bytes than these.
    shards: int = 6
    shard_vectors: int = 200_000
    shard_bytes: int = 96 << 20
    #: Queries of one task at most, and of a piece of them.
    query_vectors: int = 1_000_000
    piece: int = 8_192
    batch: int = 256

    def shard_size(self, dim: int) -> int:
        """Vectors of a shard: each has its coordinates in both precisions, the upper layers a tenth more, and its links."""
        return max(1, min(self.shard_vectors, self.shard_bytes // (14 * dim + 12 * self.neighbours + 100)))


class Layer:
    """A navigable graph over ``nodes`` (rows of x, in insertion order); ``links`` hold layer positions, -1 for none."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, width: int):
        self.nodes, self.width = nodes, width
        self.x = x[nodes]
        self.links = np.full((len(nodes), width), -1, dtype=np.int32)
        self.filled = 0

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the ``beam`` best nodes met from ``entry`` (a position or several per query)."""
        n_q, rows = len(q), np.arange(len(q))
        entry = entry.reshape(n_q, -1)
        beam = max(beam, entry.shape[1])
        seen = np.zeros((n_q, self.filled + 1), dtype=bool)  # the last column stands for "none"
        seen[:, -1] = True
        ids = np.full((n_q, beam), -1, dtype=np.int64)
        sims = np.full((n_q, beam), -np.inf, dtype=np.float32)
        done = np.ones((n_q, beam), dtype=bool)
        for k in range(entry.shape[1]):
            new = ~seen[rows, entry[:, k]]
            seen[rows, entry[:, k]] = True
            ids[new, k] = entry[new, k]
            sims[new, k] = np.einsum("qd,qd->q", q[new], self.x[entry[new, k]])
            done[new, k] = False
        live = rows
        while len(live):
            waiting = np.where(done[live], -np.inf, sims[live])
            k = min(at_once, beam)
            top = np.argpartition(-waiting, k - 1, axis=1)[:, :k] if beam > k else np.tile(np.arange(beam), (len(live), 1))
            value = np.take_along_axis(waiting, top, axis=1)
            go = value.max(axis=1) > -np.inf
            live, top, value = live[go], top[go], value[go]
            if not len(live):
                break
            chosen = np.where(value > -np.inf, ids[live[:, None], top], -1)
            done[live[:, None], top] = True
            near = np.where(chosen[:, :, None] >= 0, self.links[chosen], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            good = near >= 0
            if not good.any():
                continue
            order = np.argsort(~good, axis=1, kind="stable")[:, : int(good.sum(axis=1).max())]
            near, good = np.take_along_axis(near, order, axis=1), np.take_along_axis(good, order, axis=1)
            got = np.where(good, np.einsum("qd,qkd->qk", q[live], self.x[np.maximum(near, 0)]), -np.inf).astype(np.float32)
            all_sims = np.concatenate((sims[live], got), axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, keep, axis=1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), axis=1), keep, axis=1)
            done[live] = np.take_along_axis(np.concatenate((done[live], ~good), axis=1), keep, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _choose(self, base: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Up to ``width`` of each row's candidates, nearest first, none nearer to a chosen one than to the base; then the nearest of the rest."""
        safe = np.maximum(cand, 0)
        sims = np.where(cand >= 0, np.einsum("bd,bcd->bc", self.x[base], self.x[safe]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
        v = self.x[np.maximum(cand, 0)]
        mutual = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(cand.shape, dtype=bool)
        for c in range(cand.shape[1]):
            clash = (chosen[:, :c] & (mutual[:, c, :c] > sims[:, c : c + 1])).any(axis=1)
            chosen[:, c] = (cand[:, c] >= 0) & ~clash & (chosen.sum(axis=1) < self.width)
        rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        best = np.argsort(rank, axis=1, kind="stable")[:, : self.width]
        out = np.take_along_axis(cand, best, axis=1)
        return np.pad(out, ((0, 0), (0, self.width - out.shape[1])), constant_values=-1)

    def insert(self, n: int, entry: np.ndarray, beam: int) -> None:
        """Adds the next ``n`` nodes, found from ``entry`` (positions) by a search of ``beam``."""
        start = self.filled
        new = np.arange(start, start + n)
        q = self.x[new]
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        k = min(n - 1, self.width)
        peers = np.argpartition(-inside, k - 1, axis=1)[:, :k] + start if k else np.empty((n, 0), dtype=np.int64)
        found = self.search(q, entry, beam)[0] if start else np.empty((n, 0), dtype=np.int64)
        chosen = self._choose(new, np.concatenate((found, peers), axis=1)) if start or k else np.full((n, self.width), -1)
        self.filled += n
        self.links[new] = chosen
        to, of = chosen.reshape(-1), np.repeat(new, self.width)
        to, of = to[chosen.reshape(-1) >= 0], of[chosen.reshape(-1) >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        if not len(to):
            return
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(target), int(count.max())), -1, dtype=np.int64)
        wide[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = of
        both = np.concatenate((self.links[target].astype(np.int64), wide), axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for a in range(0, len(target), 256):
            self.links[target[a : a + 256]] = self._choose(target[a : a + 256], both[a : a + 256])

    def join_up(self, extra: int = 8) -> None:
        """Gives nodes that no path from the first node reaches a link from their nearest reached ones, in further columns."""
        n = len(self.nodes)
        self.links = np.concatenate((self.links, np.full((n, extra), -1, dtype=np.int32)), axis=1)
        reached, edge = np.zeros(n, dtype=bool), np.zeros(1, dtype=np.int64)
        while True:
            while len(edge):
                reached[edge] = True
                near = np.unique(self.links[edge])
                near = near[near >= 0]
                edge = near[~reached[near]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            v = lost[0]
            open_ = np.flatnonzero(reached & (self.links[:, -extra:] < 0).any(axis=1))
            to = open_[np.argmax(self.x[open_] @ self.x[v])] if len(open_) else 0
            slot = np.flatnonzero(self.links[to, -extra:] < 0)
            self.links[to, self.links.shape[1] - extra + (slot[0] if len(slot) else 0)] = v
            edge = np.array([v])


class Graph:
    """The hierarchy over unit vectors ``x``: layers from the top to all nodes."""

    def __init__(self, x: np.ndarray, s: Settings):
        self.s = s
        n = len(x)
        draw = mix(np.arange(n, dtype=np.uint64) + np.uint64(12345)).astype(np.float64) / 2.0**64
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(s.neighbours)).astype(np.int64), 6)
        order = np.argsort(-level, kind="stable")
        self.layers: list[Layer] = []
        x = x.astype(np.float32)
        for depth in range(int(level.max()) if n else 0, -1, -1):
            nodes = order[level[order] >= depth]
            layer = Layer(x, nodes, s.neighbours * (2 if depth == 0 else 1))
            above = len(self.layers[-1].nodes) if self.layers else 0
            size = 1
            while layer.filled < len(nodes):
                a = layer.filled
                size = min(s.batch, max(1, 2 * size), max(1, a // 2 + 1), len(nodes) - a)
                entry = self._enter(layer.x[a : a + size], len(self.layers)) if self.layers and a >= above else np.zeros((size, 1), dtype=np.int64)
                layer.insert(size, entry, s.build_beam)
            layer.join_up()
            self.layers.append(layer)

    def _enter(self, q: np.ndarray, layers: int, width: int = 4) -> np.ndarray:
        """Positions in the next layer, reached through the first ``layers`` ones (upper nodes keep their order below)."""
        entry = np.zeros((len(q), 1), dtype=np.int64)
        for layer in self.layers[:layers]:
            ids = layer.search(q, entry, width)[0]
            entry = np.where(ids >= 0, ids, ids[:, :1])
        return entry

    def near(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the best ``beam`` met for every query."""
        base = self.layers[-1]
        ids, sims = base.search(q, self._enter(q, len(self.layers) - 1), beam)
        return np.where(ids >= 0, base.nodes[ids], -1), sims


def linked(graph: Graph, x: np.ndarray, q: np.ndarray, s: Settings, counter: dict | None = None) -> list[np.ndarray]:
    """For every query (unit, double) the rows of ``x`` with a cosine of ``s.cosine`` or more, found by the graph.

    ``counter`` takes the beam that passed the audit and its figures; one that has a beam is not audited again.
    """
    n, out = len(x), [np.empty(0, np.int64)] * len(q)
    loose = s.cosine - 1e-4
    q32 = q.astype(np.float32)

    def exact(rows: np.ndarray) -> None:
        for a in range(0, len(rows), 512):
            hits = q[rows[a : a + 512]] @ x.T >= s.cosine
            for k, row in enumerate(rows[a : a + 512].tolist()):
                out[row] = np.flatnonzero(hits[k])

    def beams(rows: np.ndarray, beam: int) -> None:
        while len(rows):
            if 2 * beam >= n:
                return exact(rows)
            full = []
            for a in range(0, len(rows), s.batch):
                some = rows[a : a + s.batch]
                ids, sims = graph.near(q32[some], beam)
                for k, row in enumerate(some.tolist()):
                    mine = ids[k][sims[k] >= loose]
                    if len(mine) >= beam:
                        full.append(row)
                    elif len(mine):
                        out[row] = mine[x[mine] @ q[row] >= s.cosine]
            rows, beam = np.array(full, dtype=np.int64), 2 * beam

    every = np.arange(len(q))
    if counter and "beam" in counter:
        beams(every, counter["beam"])
        return out
    audit = np.sort(np.argsort(mix(every.astype(np.uint64) + np.uint64(77)), kind="stable")[: s.audits])
    truth = [np.empty(0, np.int64)] * len(q)
    exact(audit)
    for row in audit.tolist():
        truth[row] = out[row]
    beam = s.beam
    while True:
        beams(audit, beam)
        total = sum(len(truth[r]) for r in audit.tolist())
        found = sum(len(np.intersect1d(truth[r], out[r])) for r in audit.tolist())
        if found >= s.recall * total or 2 * beam >= n:
            break
        beam *= 2
    beams(np.setdiff1d(every, audit), beam)
    for row in audit.tolist():
        out[row] = truth[row]
    if counter is not None:
        counter |= {"beam": beam, "audited": total, "found": found}
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision as bytes, with two hashes of them; null where a vector can't link."""
    for batch in batches:
        units, prints = [], []
        for values in batch.column("embedding"):
            unit = None
            if values.is_valid and len(values) and values.values.null_count == 0:
                v = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    unit = (v / np.sqrt(v @ v) + 0.0).tobytes()
            units.append(unit)
            prints.append((None, None) if unit is None else tuple(int.from_bytes(xxhash.xxh3_64_digest(unit, k), "little", signed=True) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(units, pa.binary()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())], ["vec_id", "unit", "fp1", "fp2"]
        )


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    units = table.column("unit").to_pylist()
    if len(set(map(len, units))) > 1:
        raise ValueError("the vectors differ in length")
    return np.frombuffer(b"".join(units), np.float64).reshape(table.num_rows, -1)


def _build(s: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        x = _matrix(table)
        packed = pickle.dumps((table.column("rep").to_numpy(), table.column("copies").to_numpy(), x, Graph(x, s)))
        return pa.table({"shard": table.column("shard").slice(0, 1), "graph": pa.array([packed], pa.binary())})

    return run


_FOUND = "rep long, links long, a long, b long"


def _query(s: Settings):
    """Answers of a partition sorted by (shard, part, kind): a graph row, then the queries put to it."""

    def answers(graph: tuple, state: dict, reps: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        ids, copies, x, hierarchy = graph
        parent: dict[int, int] = state["parent"]

        def root(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = parent.get(up, up)
                v = up
            return v

        found, links, edges_a, edges_b = [], [], [], []
        for rep, rows in zip(reps.tolist(), linked(hierarchy, x, q, s, state["counter"]), strict=True):
            rows = rows[ids[rows] != rep]
            if not len(rows):
                continue
            found.append(rep)
            links.append(int(copies[rows].sum()))
            for to in ids[rows].tolist():
                u, v = root(rep), root(to)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    edges_a.append(rep)
                    edges_b.append(to)
        n, m = len(found), len(edges_a)
        return pa.RecordBatch.from_arrays(
            [pa.array(found + [None] * m, pa.int64()), pa.array(links + [None] * m, pa.int64()), pa.array([None] * n + edges_a, pa.int64()), pa.array([None] * n + edges_b, pa.int64())], ["rep", "links", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, state, key = None, {}, None
        for batch in batches:
            shards, parts = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
            heads = np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            for start, end in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
                if start >= 0:
                    graph, state, key = pickle.loads(batch.column("graph")[start].as_py()), {"parent": {}, "counter": {}}, (shards[start], parts[start])
                if key is not None:  # queries behind those of this graph ask a shard that no vector fell into
                    end = start + 1 + int(((shards[start + 1 : end] == key[0]) & (parts[start + 1 : end] == key[1])).sum())
                    for a in range(start + 1, end, s.piece):
                        some = batch.slice(a, min(s.piece, end - a))
                        yield answers(graph, state, some.column("rep").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(some))

    return run


def _alone(rows: DataFrame) -> DataFrame:
    """The result where no vector can link."""
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors link when their cosine is ``s.cosine`` or more.  Vectors that are null, empty or zero, or hold
    null or non-finite components, link with nothing and are their own component.  Vectors of equal
    direction bits are one class; each counts the others as links.  Vectors of different lengths are
    an error.  Rows without a vec_id link with nothing, have no component and are kept; rows that share
    one are vectors of their own with one component.  Extra columns are ignored; an empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hnsw")
    rows = scratch.save(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_units, "vec_id long, unit binary, fp1 long, fp2 long"), "units")
    classes = rows.filter("unit is not null and vec_id is not null").groupBy("fp1", "fp2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = classes.join(rows.select(F.col("vec_id").alias("rep"), "fp1", "fp2", "unit"), ["rep", "fp1", "fp2"]).dropDuplicates(["fp1", "fp2"])
    reps = scratch.save(reps, "classes")
    n = reps.count()
    if not n:
        return _alone(rows)
    dim = reps.select(F.max(F.octet_length("unit")).alias("bytes")).first()["bytes"] // 8
    n_shards = max(s.shards, -(-n // s.shard_size(dim)))
    n_parts = max(1, -(-n // s.query_vectors), -(-2 * spark.sparkContext.defaultParallelism // n_shards))
    placed = reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(n_shards)))
    graphs = scratch.save(placed.select("shard", "rep", "copies", "unit").groupBy("shard").applyInArrow(_build(s), "shard long, graph binary"), "graphs")

    none = lambda kind: F.lit(None).cast(kind)
    asked = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(0).alias("kind"), "graph", none("long").alias("rep"), none("binary").alias("unit"))
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(n_parts)).cast("int").alias("part")
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard")
    queries = reps.select(shard, part, F.lit(1).alias("kind"), none("binary").alias("graph"), "rep", "unit")
    met = asked.unionByName(queries).repartition(n_shards * n_parts, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = scratch.save(met.mapInArrow(_query(s), _FOUND), "found")
    scratch.drop("graphs")

    of = components(scratch, found.filter("a is not null").select("a", "b"), "components")
    counts = found.filter("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.join(counts, "rep", "left").join(of.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "fp1", "fp2").join(by_class, ["fp1", "fp2"], "left")
    named = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("component_id", "vec_id")).alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop("units", "classes", "found")
    return out
