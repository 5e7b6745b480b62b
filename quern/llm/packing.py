"""Best-fit packing (operator 6): token pieces into sequences of fixed capacity.

Only lengths matter for packing, and there are at most ``capacity`` of them,
so the plan is made from the histogram of lengths (that many numbers, whatever
the input). Items above a third of the capacity go at most two to a bin: from
the longest down, each takes the longest partner that fits. Smaller items, from
the longest down, go where the least gap that holds them is. The plan says for
each length which ranks go to which sequences; ranks come from a count per
(length, salt), so that a hot length is not ranked in one task; there are as many
salts as keep a task's share of a length that all items have at about ROWS_A_SALT rows.

Cases: a null or empty text is its end token alone; repeated rows are packed
each for itself; texts longer than the capacity are cut into full pieces and a
rest; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import begin, freeing, keyed, read, table
from quern.llm.pieces import in_turns, word_ids

CAPACITY, END = 4096, 1
ROWS_A_SALT = 10_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, tokens: bool = False) -> DataFrame:
    """doc_id, th, piece, start, length, ids_crc32 and, if asked for, ids: one row per piece."""

    @freeing
    def run(batches):
        begin("packing")
        known = word_ids(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in in_turns(texts):
                rows: list[list] = [[] for _ in range(6)]
                for k, ids in enumerate(known.texts(texts[i:j]), i):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for to, x in zip(rows, (k, n, at // 4, len(part) // 4, zlib.crc32(part), part if tokens else None), strict=True):
                            to.append(x)
                at = pa.array(rows[0], pa.int64())
                out = [b.column("doc_id").take(at), b.column("th").take(at), *(pa.array(x, pa.int64()) for x in rows[1:5])]
                yield pa.RecordBatch.from_arrays(out + [pa.array(rows[5], pa.binary())] * tokens, names)

    names = ["doc_id", "th", "piece", "start", "length", "ids_crc32"] + ["ids"] * tokens
    return keyed(docs).mapInArrow(run, "doc_id long, th long, piece long, start long, length long, ids_crc32 long" + ", ids binary" * tokens)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """(slots, number of bins) groups; a slot is (length, how many of it). counts: items by length."""
    left = Counter({n: c for n, c in counts.items() if c})
    done = []
    open_: dict[int, list] = defaultdict(list)  # gap: [[slots, bins]]

    def put(slots: list, bins: int) -> None:
        gap = capacity - sum(n * k for n, k in slots)
        if gap and bins:
            if not open_[gap]:
                bisect.insort(gaps, gap)
            open_[gap].append((slots, bins))
        elif bins:
            done.append((slots, bins))

    gaps: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    for x in reversed(large):
        while left[x]:
            at = bisect.bisect_right(large, min(x, capacity - x)) - 1
            while at >= 0 and left[large[at]] <= (large[at] == x and 1) - (large[at] == x and left[x] > 1):
                at -= 1
            if at < 0:
                put([(x, 1)], left[x])
                left[x] = 0
            elif large[at] == x:
                put([(x, 2)], left[x] // 2)
                left[x] %= 2
            else:
                y = large[at]
                t = min(left[x], left[y])
                put([(x, 1), (y, 1)], t)
                left[x] -= t
                left[y] -= t
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            gap = gaps[at] if at < len(gaps) else capacity
            slots, bins = open_[gap].pop() if at < len(gaps) else ([], left[s])
            if at < len(gaps) and not open_[gap]:
                del gaps[at]
            k = gap // s
            full = min(bins, left[s] // k)
            left[s] -= full * k
            put([*slots, (s, k)], full)
            bins -= full
            if bins and left[s]:  # fewer than one bin takes
                put([*slots, (s, left[s])], 1)
                left[s], bins = 0, bins - 1
            if slots:
                put(slots, bins)
    return done + [g for gap in gaps for g in open_[gap]]


def lookup(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Arrays by (length, first rank): how many to a bin, first sequence, offset."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for slots, bins in groups:
        offset = 0
        for n, k in slots:
            rows.append((n, used[n], k, sequence, offset))
            used[n] += bins * k
            offset += n * k
        sequence += bins
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), cols, strict=True))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, th, piece and length (1 to capacity)."""
    salts = 1 + items.count() // ROWS_A_SALT
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "piece"), F.lit(salts)).cast("int"))
    held = table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    look = lookup(plan(counts, capacity))
    below = Window.partitionBy("length").orderBy("salt")
    base = held.select("length", "salt", (F.sum("n").over(below) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "th", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(base, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        key = (look["length"] << 48) + look["rank"]
        at = np.searchsorted(key, (n << 48) + r, side="right") - 1
        d = r - look["rank"][at]
        each = look["each"][at]
        return pd.DataFrame({"sequence_id": look["sequence"][at] + d // each, "offset": look["offset"][at] + d % each * n})

    placed = ranked.withColumn("p", place("length", F.col("base") + F.col("rank") - 1))
    return placed.select(*items.columns, "p.sequence_id", "p.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed tokens (binary, little-endian 32-bit), from rows of ``pack`` with ids."""
    g = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return g.select("sequence_id", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    out = pack(table(pieces(docs, path), "pieces"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("piece", F.col("piece").cast("int"))
