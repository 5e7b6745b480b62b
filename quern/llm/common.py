"""What the operators share: scratch tables, document keys, fixed-size bitmaps.

A document row is known by ``(doc_id, th)``: its id and a 64-bit hash of its
text. Rows that repeat both are the same document and get the same result;
rows that repeat only the id are told apart by their text. Null ids are a
value like any other (joins on keys are null-safe).
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local master (tests on one machine) gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'quern-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str = "t", scratch: bool = True) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it back.

    Cuts lineage durably: a lost executor costs a re-read, not a re-run.
    Scratch tables go with ``temporary``, ``forget`` or ``drop``, others stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch:
        _scratch.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _scratch:
        _scratch.remove(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that nothing still to be computed reads."""
    for t in tables:
        _delete(t.sparkSession, t._path)


class temporary:  # noqa: N801
    """Tables made inside a with block go at its end, but for those that it is called with.

    with temporary() as keep:
        t = keep(table(...))
    """

    def __enter__(self) -> temporary:
        self.before, self.kept = set(_scratch), set()
        return self

    def __call__(self, t: DataFrame) -> DataFrame:
        self.kept.add(t._path)
        return t

    def __exit__(self, *_) -> None:
        drop([p for p in _scratch if p not in self.before and p not in self.kept])


def made() -> list[str]:
    """The scratch tables that are still there."""
    return list(_scratch)


def drop(paths: list[str]) -> None:
    """Delete scratch tables; call it only when no result that reads them is still to be computed."""
    spark = SparkSession.active() if paths else None
    for p in paths:
        if p in _scratch:
            _delete(spark, p)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text of every row; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def same_key(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns, for joins."""
    on = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        on = on & a[n].eqNullSafe(b[n])
    return on


def whole(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of docs as one struct, ``row``, beside the named ones: no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def of_row(docs: DataFrame) -> list[Column]:
    """The columns of docs out of ``row``."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# ---------------------------------------------------------------- words

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 17  # bytes of a text hashed at once
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of GOLD and of its inverse, modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (int(GOLD), pow(int(GOLD), -1, 2**64))]
    return _powers


def _pieces(data: bytes):
    """Ranges of a text that end after a blank, or at its end."""
    at, size = 0, PIECE
    while at < len(data):
        end = at + size
        if end < len(data):
            part = data[at:end]
            end = at + 1 + max(part.rfind(c) for c in b"\t\n\v\f\r ")
            if end == at:  # no blank in it
                size *= 2
                continue
        yield at, min(end, len(data))
        at, size = end, PIECE


def word_hashes(data: bytes, marks: bytes = b"", but_after: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash (64 bits), start and stop (bytes) of each word of a text; ASCII blanks part words.

    A word's hash is a polynomial of its bytes, from differences of running sums: no object per word.
    Where marks are given, those at the end of a word, after an ASCII letter or digit, are a word of
    their own, but in words that hold a byte of ``but_after``.
    """
    out = []
    for at, end in _pieces(data):
        x = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[x], [True]])))
        start, stop = edge[::2], edge[1::2]
        if marks and len(start):
            start, stop = _parted(x, start, stop, marks, but_after)
        power, inverse = powers(len(x) + 1)
        sums = np.concatenate([[_U(0)], np.cumsum((x.astype(np.uint64) + _U(1)) * power[: len(x)])])
        h = (sums[stop] - sums[start]) * inverse[start]
        out.append((mix(h + mix(stop - start)), start + at, stop + at))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _parted(x: np.ndarray, start: np.ndarray, stop: np.ndarray, marks: bytes, but_after: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words with the marks at their ends as spans of their own."""
    is_mark, is_plain, is_other = np.zeros((3, 256), bool)
    is_mark[list(marks)] = True
    is_plain[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
    is_other[list(but_after)] = True
    ends = np.flatnonzero(is_mark[x[stop - 1]])
    if not len(ends):
        return start, stop
    head = np.maximum.accumulate(np.where(is_mark[x], -1, np.arange(len(x))))[stop[ends] - 1]  # the last byte that isn't a mark
    others = np.append(0, np.cumsum(is_other[x]))
    ok = (head >= start[ends]) & is_plain[x[np.maximum(head, 0)]] & (others[stop[ends]] == others[start[ends]])
    cut = np.sort(head[ok] + 1)
    return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))


# ---------------------------------------------------------------- caches

_holders: dict[str, Callable[[], None]] = {}


def holder(stage: str, clear: Callable[[], None]) -> None:
    """Names what frees the cache that a stage keeps in its Python worker."""
    _holders[stage] = clear


def begin(stage: str) -> None:
    """Called where a stage's task starts: workers outlive stages, so the caches of others are freed."""
    for name, clear in _holders.items():
        if name != stage:
            clear()
    give_back()


def give_back() -> None:
    """Returns freed memory, which Arrow's pool and malloc keep, to the system: an idle worker's counts as its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def freeing(f: Callable) -> Callable:
    """For mapInArrow: f, whose task ends by giving its memory back."""

    @wraps(f)
    def run(batches):
        yield from f(batches)
        give_back()

    return run


# ------------------------------------------------------------ bitmaps

BITMAP_BITS = 1 << 23  # 1 MB, whatever the input


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashes of a long column: at most bits/8 bytes at the driver.

    It only ever saves work: a row whose bit is not set has no partner, the
    others go on to an exact join. When it fills up, it lets everything pass.
    """
    rows = (
        df.select(F.col(col).bitwiseAND(F.lit(bits - 1)).alias("h"))
        .select(F.expr("shiftright(h, 6)").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)
