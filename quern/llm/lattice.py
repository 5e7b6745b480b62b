"""Embedding near-dedup by E8 lattice hashing (operator 8).

Unit vectors are projected to blocks of eight random orthonormal directions;
each block is scaled and decoded to its nearest E8 lattice point, and a table's
key is the points of its blocks. Several tables; in each, a vector also probes
the neighbouring cells that its own decoding came closest to. Vectors of a label
that meet in a cell are compared by cosine in double precision.

Equal vectors are one node with a count. Cells are compared in blocks of rows
inside tasks (never as rows of a join), each pair counted once: in the first
table and cell that both share. A cell of any size is dealt to pairs of blocks.
Links aren't rows: of a pair of blocks each node gets one, with its count of
links found there and the least node that these connect it with.

Cases: a null label, a null or zero vector, one with null or non-finite
components: no links. Vectors of unequal length don't meet. Repeated vec_ids are
rows of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import GOLD, mix, parts, read, table, temporary
from quern.llm.neardup import components

COSINE, TABLES, BLOCKS, PROBES, SCALE, SEED, BLOCK_ROWS = 0.93, 12, 2, 3, 0.28, 8, 512


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (all integers or all halves, of even sum), doubled to integers."""

    def d8(v):
        r = np.rint(v)
        odd = (r.sum(axis=-1).astype(np.int64) & 1).astype(bool)
        gap = v - r
        worst = np.abs(gap).argmax(axis=-1)[..., None]
        step = np.where(np.take_along_axis(gap, worst, -1) >= 0, 1.0, -1.0)
        fixed = r.copy()
        np.put_along_axis(fixed, worst, np.take_along_axis(r, worst, -1) + step, -1)
        return np.where(odd[..., None], fixed, r)

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.rint(2 * np.where(near[..., None], a, b)).astype(np.int64)


def cells(x: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Keys (rows, TABLES, 1 + probes): the own cell first, then neighbours.

    A neighbour is found by decoding the point pushed away from its own cell's
    centre, block by block, in growing steps.
    """
    d = x.shape[1]
    rng = np.random.default_rng(SEED)
    out = np.zeros((len(x), TABLES, 1 + probes), np.uint64)
    for t in range(TABLES):
        basis = np.linalg.qr(rng.standard_normal((max(d, 8 * BLOCKS), 8 * BLOCKS)))[0][:d]
        shift = rng.random((BLOCKS, 8))
        y = (x @ basis).reshape(len(x), BLOCKS, 8) * np.sqrt(d / 64) / SCALE + shift
        own = decode_e8(y)
        out[:, t, 0] = _key(own, t)
        away = y - own / 2
        away /= np.maximum(np.linalg.norm(away, axis=-1, keepdims=True), 1e-12)
        for p in range(probes):
            moved = own.copy()
            block = p % (BLOCKS + 1)
            pick = slice(None) if block == BLOCKS else slice(block, block + 1)
            moved[:, pick] = decode_e8(y[:, pick] + away[:, pick] * 0.5)
            out[:, t, 1 + p] = _key(moved, t)
    return out


def _key(points: np.ndarray, t: int) -> np.ndarray:
    h = np.full(len(points), t + 1, np.uint64)
    for i in range(points.shape[1]):
        for j in range(8):
            h = mix(h * GOLD + points[:, i, j].astype(np.uint64))
    return h


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vid (128-bit hash of label and vector, null if it can't link), unit (binary doubles)."""

    def run(batches):
        for b in batches:
            vid, unit = [], []
            for v, label in zip(b.column("embedding"), b.column("label"), strict=True):
                v = v.as_py()
                ok = label.is_valid and v and all(c is not None for c in v)
                x = np.asarray(v, np.float64) if ok else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                if not (0 < top < np.inf):  # false for NaN too
                    vid.append(None)
                    unit.append(None)
                    continue
                x = x / top  # no overflow or underflow in the norm
                x = (x / np.sqrt((x * x).sum())).tobytes()
                vid.append(xxhash.xxh3_128_digest(len(v).to_bytes(8, "little") + np.asarray(v, np.float64).tobytes() + str(label.as_py()).encode()))
                unit.append(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(vid, pa.binary()), pa.array(unit, pa.binary())], ["vec_id", "label", "vid", "unit"])

    cols = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return cols.mapInArrow(run, "vec_id long, label string, vid binary, unit binary")


def with_cells(nodes: DataFrame) -> DataFrame:
    """cid, weight (n), unit, keys (binary, all cells of a node); no cell holds two labels or dimensions."""

    def run(batches):
        for b in batches:
            data = b.column("unit").to_pylist()
            label = np.array([xxhash.xxh3_64_intdigest(str(x)) for x in b.column("label").to_pylist()], np.uint64)
            size = np.array([len(x) for x in data], np.int64)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                for i in range(0, len(rows), 2048):
                    at = rows[i : i + 2048]
                    keys = cells(np.frombuffer(b"".join(data[k] for k in at), np.float64).reshape(len(at), -1))
                    keys = mix(keys ^ mix(label[at] + np.uint64(n))[:, None, None]).view(np.int64).reshape(len(at), -1)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column("cid").take(take), b.column("n").take(take), b.column("unit").take(take), pa.array([k.tobytes() for k in keys], pa.binary())], ["cid", "weight", "unit", "keys"])

    return nodes.select("cid", "n", "label", "unit").mapInArrow(run, "cid long, weight long, unit binary, keys binary")


def cell_rows(celled: DataFrame) -> DataFrame:
    """cell, cid: a row per node and distinct cell."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64).reshape(b.num_rows, -1)
                keys = np.sort(keys, axis=1)
                new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                cid = np.broadcast_to(b.column("cid").to_numpy()[:, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(cid[new])], ["cell", "cid"])

    return celled.select("cid", "keys").mapInArrow(run, "cell long, cid long")


def links(nodes: DataFrame) -> DataFrame:
    """cid, to, w: nodes with links in a pair of blocks, a node that these connect it with (or itself), and how many vectors they lead to."""
    celled = table(with_cells(nodes), "celled")
    rows = cell_rows(celled)
    shared = rows.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    hits = table(rows.join(shared, "cell"), "cells")
    # Blocks of a cell: each row goes to the pairs of blocks that hold it.
    nb = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    blocked = hits.withColumn("nb", nb).withColumn("mine", F.expr("cast(pmod(xxhash64(cid, cell), nb) as int)"))
    dealt = blocked.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = dealt.select("cell", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "cid")
    with_units = dealt.join(celled, "cid")
    sorted_ = with_units.repartition(parts(nodes.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return sorted_.mapInArrow(_compare, "cid long, to long, w long")


def _groups(batches):
    """Runs of rows with one (cell, i, j), whole, as (i, j, mine, cid, unit)."""
    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("cell", "i", "j")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(keys[:, s])
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield last, held


def _compare(batches):
    each = 1 + PROBES
    for (cell, i, j), held in _groups(batches):
        t = pa.Table.from_batches(held)
        cid, mine = t.column("cid").to_numpy(), t.column("mine").to_numpy()
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(cid), -1)
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(len(cid), -1)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        if not len(left) or not len(right):
            continue
        near = x[left] @ x[right].T >= COSINE
        if i == j:
            near &= cid[left][:, None] < cid[right][None, :]
        p, q = (at[k] for at, k in zip((left, right), np.nonzero(near), strict=True))
        # A pair counts in the first table, and there in the least cell, that both share.
        here = int((keys[0] == cell).argmax()) // each
        for n in range(here + 1):
            k = slice(n * each, (n + 1) * each)
            u, v = keys[p, k], keys[q, k]
            same = u[:, :, None] == v[:, None, :]
            if n == here:
                same &= (u < cell)[:, :, None]
            first = ~same.any(axis=(1, 2))
            p, q = p[first], q[first]
        if not len(p):
            continue
        weight = t.column("weight").to_numpy()
        w = np.zeros(len(cid), np.int64)
        np.add.at(w, p, weight[q])
        np.add.at(w, q, weight[p])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[_least(len(cid), p, q)[at]]), pa.array(w[at])], ["cid", "to", "w"])


def _least(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that the links p-q connect it with."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[p], least[q])
        new = least.copy()
        np.minimum.at(new, p, m)
        np.minimum.at(new, q, m)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    with temporary() as keep:
        u = keep(table(units(vectors), "units"))
        nodes = u.filter("vid is not null").groupBy("vid").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
        nodes = table(nodes.withColumn("cid", F.monotonically_increasing_id()), "nodes")
        found = table(links(nodes), "links")
        degree = found.groupBy("cid").agg(F.sum("w").alias("others"))
        root = components(found.filter("cid <> to").select(F.col("cid").alias("a"), F.col("to").alias("b")))
        known = nodes.join(root, "cid", "left").select("cid", "vid", "n", "least", F.coalesce("root", "cid").alias("root"))
        known = known.join(degree, "cid", "left").select("vid", "root", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        known = keep(table(known, "roots"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("vid", "n_links", "component_id")
    out = u.select("vec_id", "vid").join(named, "vid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_lattice(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
g AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM g GROUP BY a)
SELECT c.a AS vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.a = c.component_id AS kept FROM c LEFT JOIN k ON c.a = k.a
"""
