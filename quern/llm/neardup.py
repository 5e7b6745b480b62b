"""Sets of word shingles, sketches of them, and components of similar sets.

Used by the n-gram Jaccard join (operator 5) and by substring dedup (7), which
differ in how signatures are made from a sketch. No step makes all pairs of a
group: equal sets are one node; each group of a signature is first linked to
its best-connected member; only members of groups that still hold several
components are compared across components, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import GOLD, bitmap, forget, freeing, mix, table, word_hashes

WORDS, COORDS, PERCENT = 5, 80, 75
#: At similarity 0.75, 60 of 80 coordinates agree on average (deviation 3.9);
#: under 33 has a chance of under 1e-10.
MIN_AGREE = 33
_MULTIPLY = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of the five-word shingles of words with the hashes h, in order; fewer words are one shingle."""
    if not len(h):
        return h
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * GOLD + h[i : len(h) - n + 1 + i]
    return mix(out)


def lowered(text: str) -> bytes:
    """A text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(word_hashes(lowered(text))[0]))


def sketch(grams: np.ndarray) -> bytes:
    """The least of each of COORDS hashes, 16 bits each."""
    least = None
    for i in range(0, len(grams), 2048):
        m = (grams[i : i + 2048, None] * _MULTIPLY).min(axis=0)
        least = m if least is None else np.minimum(least, m)
    # The low bits of a least value are as good as random; its high bits are mostly zero.
    return (mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def sketches(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``sketch`` of many sets, one a row: their grams one after the other (none empty), and where each starts."""
    out = np.empty((COORDS, len(starts)), np.uint64)
    for row, by in zip(out, _MULTIPLY, strict=True):
        np.minimum.reduceat(grams * by, starts, out=row)
    return (mix(out.T) >> np.uint64(48)).astype("<u2")


def distinct_sets(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets sorted and without repeats, as ``sketches`` takes them."""
    which = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(grams))))
    # One key, of the set's number and the high bits of the gram, sorts faster than two.
    bits = np.uint64(max(1, len(starts).bit_length()))
    key = which << np.uint64(64 - bits) | grams >> bits
    order = np.argsort(key)
    if np.any((key[order][1:] == key[order][:-1]) & (grams[order][1:] != grams[order][:-1])):  # only low bits differ
        order = np.lexsort((grams, which))
    g, w = grams[order], which[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    return g[new], np.searchsorted(w[new], np.arange(len(starts), dtype=np.uint64))


def part_enum(s: np.ndarray, groups: int = 10, parts: int = 4, differ: int = 2) -> np.ndarray:
    """PartEnum signatures of sketches (one a row).

    The coordinates are dealt to ``groups`` first-level partitions of ``parts``
    second-level ones. For each first-level partition, every subset of
    parts - differ second-level ones gives one signature: two sketches that
    differ in at most ``differ`` parts of some partition share one.
    """
    from itertools import combinations

    width = s.shape[1] // (groups * parts)
    cut = s[:, : groups * parts * width].reshape(len(s), groups, parts, width).astype(np.uint64)
    part = np.zeros(cut.shape[:3], np.uint64)
    for i in range(width):
        part = part << np.uint64(16) | cut[..., i]
    part = mix(part + mix(np.arange(groups * parts, dtype=np.uint64)).reshape(1, groups, parts))
    out = []
    for k, subset in enumerate(combinations(range(parts), parts - differ)):
        h = np.full(part.shape[:2], k, np.uint64)
        for i in subset:
            h = mix(h * GOLD + part[:, :, i])
        out.append(h)
    return np.concatenate(out, axis=1)


def tune_bands(recall: float, similarity: float = PERCENT / 100, coords: int = COORDS, most_rows: int = 5) -> tuple[int, int]:
    """(bands, rows): most rows a band, then fewest bands, that reach the recall at the similarity."""
    for rows in range(most_rows, 0, -1):
        for bands in range(1, coords // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no bands reach this recall")


def band(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash banding: one hash per band of rows coordinates."""
    cut = s[:, : bands * rows].reshape(len(s), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * GOLD + cut[..., i])
    return h


def signature_rows(nodes: DataFrame, signatures: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """sig, cid: one row per node and signature."""

    @freeing
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                rows = b.slice(i, 2000)
                s = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u2").reshape(-1, COORDS)
                sigs = signatures(s)
                cid = np.repeat(rows.column("cid").to_numpy(), sigs.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(sigs.reshape(-1).view(np.int64)), pa.array(cid)], ["sig", "cid"])

    return nodes.select("cid", "sketch").mapInArrow(run, "sig long, cid long")


@freeing
def _agreeing(batches):
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, COORDS) for c in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= MIN_AGREE)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


@freeing
def _linked(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])


def _with_both(pairs: DataFrame, values: DataFrame, col: str) -> DataFrame:
    x = values.select(F.col("cid").alias("a"), F.col(col).alias("x"))
    y = values.select(F.col("cid").alias("b"), F.col(col).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def verify(pairs: DataFrame, grams_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table of those pairs (a, b) whose sets have the similarity, exactly."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    grams = table(grams_of(ids), "grams")
    out = linked(pairs, grams)
    forget(grams)
    return out


def linked(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """``verify`` where a table of grams (cid, grams) has all of the sets."""
    return table(_with_both(pairs, grams, "grams").mapInArrow(_linked, "a long, b long"), "links")


def _stars(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v), different ones, has a single v and is no v itself."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("n")).select("n.*")
    both = ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least")).filter("n > 1 or n = 1 and least = 0")
    return both.count() == 0


def components(edges: DataFrame) -> DataFrame:
    """cid, root of every node with an edge; root is the least id reachable.

    Alternating large-star and small-star steps: each joins edges with a least
    neighbour per node, so no neighbourhood is collected, and the number of
    rounds grows with the logarithm of the nodes. It ends when all edges are stars.
    """
    e = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        s = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = s.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = s.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct()
        old, e = e, table(small, "edges")
        forget(old)
    return e.select(F.col("u").alias("cid"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def similar(nodes: DataFrame, signatures: Callable[[np.ndarray], np.ndarray], grams_of: Callable[[DataFrame], DataFrame], exact: bool = False) -> DataFrame:
    """cid, root for nodes (cid, sketch) that have a similar one.

    Pairs whose sketches agree too little to be similar, but for a stated chance, are dropped before
    their sets are compared; with ``exact`` the sets of all pairs that share a signature are.
    """
    sigs = signature_rows(nodes, signatures)
    shared = sigs.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    hits = table(sigs.join(shared, "sig"), "hits")
    degree = hits.groupBy("cid").agg(F.sum(F.col("n") - 1).alias("degree"))
    led = hits.join(degree, "cid")
    lead = led.groupBy("sig").agg(F.max_by("cid", F.struct("degree", "cid")).alias("lead"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = table(hits.join(lead, "sig").filter("cid <> lead").select(*pair("cid", "lead")).distinct(), "tried")
    close = tried
    if not exact:
        close = table(_with_both(tried, nodes, "sketch").mapInArrow(_agreeing, "a long, b long"), "close")
    edges = verify(close, grams_of)
    root = components(edges)
    # Groups that one component doesn't hold: across their components, all that hasn't been tried.
    lab = hits.join(root, "cid", "left").select("sig", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = lab.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi and n > 2").select("sig", "n")
    rest = table(lab.join(mixed, "sig"), "mixed")
    forget(hits)
    # A table between the two, so that a task has one Python worker.
    grams = table(grams_of(rest.select("cid").distinct()), "grams")
    fine = table(fine_bits(grams), "fine")
    own = rest.groupBy("cid").agg(F.collect_set("sig").alias("sigs"))  # as many as a node has signatures at most
    cross = _across(rest.join(fine, "cid").join(own, "cid"), FINE if exact else MOST_DIFFER).join(tried, ["a", "b"], "left_anti")
    cross = table(cross, "cross")
    forget(rest, fine)
    more = linked(cross, grams)
    forget(grams)
    return components(edges.union(more))


#: One-bit min-hashes of 2,048 coordinates: 1,792 agree on average at similarity 0.75
#: (deviation 15.0). Under 1,717 has a chance of under 1e-6.
FINE, MOST_DIFFER, BLOCK = 2048, 331, 2048
_FINE_MULTIPLY = mix(np.arange(10_001, 10_001 + FINE, dtype=np.uint64)) | np.uint64(1)
_BITS = [f"q{i}" for i in range(FINE // 64)]


def fine_bits(grams: DataFrame) -> DataFrame:
    """cid, size, q0 to q31 of (cid, grams): set size and one-bit min-hashes, for comparing in a join's condition."""

    @freeing
    def run(batches):
        for b in batches:
            size, out = [], np.zeros((b.num_rows, len(_BITS)), np.int64)
            for k, g in enumerate(b.column("grams")):
                g = np.frombuffer(g.as_buffer(), np.uint64)
                size.append(len(g))
                least = np.full(FINE, ~np.uint64(0))
                for i in range(0, len(g), 32):
                    np.minimum(least, (g[i : i + 32, None] * _FINE_MULTIPLY).min(axis=0), out=least)
                out[k] = np.packbits((mix(least) >> np.uint64(63)).astype(bool)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(size, pa.int64()), *(pa.array(out[:, i]) for i in range(len(_BITS)))], ["cid", "size", *_BITS])

    return grams.mapInArrow(run, "cid long, size long, " + ", ".join(f"{q} long" for q in _BITS))


def _across(rows: DataFrame, most_differ: int = MOST_DIFFER) -> DataFrame:
    """Pairs (a, b) of one signature and different roots that can be similar; others are never rows.

    rows: sig, n (rows of sig), cid, root, sigs (all of cid), size and bits. Sizes must allow the
    similarity and bits agree enough; a pair is made at the least signature it shares, so once.
    Large groups are compared in blocks of BLOCK rows against all.
    """
    # Columns that can't be null keep the compiled condition short enough for the JVM to optimise.
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("cid", "root", "size", *_BITS)})
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    other = right.select("sig", "block", *(F.col(c).alias(f"{c}_") for c in ("cid", "root", "size", "sigs", *_BITS)))
    differ = " + ".join(f"bit_count({q} ^ {q}_)" for q in _BITS)
    on = F.expr(
        f"l.sig = r.sig and l.block = r.block and root < root_ and 100 * least(size, size_) >= {PERCENT} * greatest(size, size_) "
        f"and {differ} <= {most_differ} and array_min(array_intersect(sigs, sigs_)) = l.sig")
    return left.alias("l").join(other.alias("r"), on).select(F.least("cid", "cid_").alias("a"), F.greatest("cid", "cid_").alias("b"))


def held_in(df: DataFrame, col: str, words: np.ndarray, how: str = "left_semi") -> DataFrame:
    """The rows of df whose long column has its bit set (left_anti: those whose hasn't): a semi-join with the bitmap, one row of a fixed size."""
    one = df.sparkSession.createDataFrame(pa.table({"__words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))}))
    h = f"({col} & {64 * len(words) - 1}L)"
    bit = F.expr(f"(shiftright(__words[cast(shiftright({h}, 6) as int)], cast({h} & 63 as int)) & 1) = 1")
    return df.join(F.broadcast(one), bit, how)


def texts_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, th, ...) with the text of each; docs has doc_id, th, text."""
    held = held_in(docs, "th", bitmap(places, "th"))
    p = places.withColumnsRenamed({"doc_id": "at_doc", "th": "at_th"})
    return held.join(p, held["doc_id"].eqNullSafe(p["at_doc"]) & (held["th"] == p["at_th"])).select(*places.columns, "text")
