"""Suffix-array dedup (operator 10): bytes of 400-byte strings that occur twice.

1. Each text's 400-byte windows are parted into runs with one anchor: the
   leftmost least hash of the 64-byte strings in the window. Equal windows have
   equal anchors at equal offsets, so they can only meet in strings (the bytes
   that a run's windows cover) of one anchor. Equal strings are one, with a count;
   all windows of a string that occurs twice are repeated.
2. The different strings of one anchor are compared by column-wise construction:
   aligned at the anchor, one symbol of each string is inserted each round, from
   the last column to the first, which updates the order of all suffixes (stable
   by the new symbol) and the common prefixes of neighbours. A window is repeated
   when its suffix shares 400 bytes or more with a neighbour in that order. Columns
   come one after the other from a sequential external file in the task's own
   temporary folder, removed at the end.

The plain form of the method, with a whole collection in one order and a round
for each byte of its longest text, takes as many passes over all data as that text
has bytes; here rounds are bounded by the 736 columns around an anchor, and the
collections of different anchors are built side by side. An anchor with more than
SMALL strings is split by the symbols next to it: its windows are halved by the column
where they start; all windows of a half hold certain columns whole (those after its last
start, up to the end of its first window), so strings that differ there go to different
parts. Equal pieces of a part are one, with a count. Parts that are still too large are
halved again, to single windows at most, whose parts hold one string each; all others
are compared column-wise as above.

Cases: null text is empty; texts of under 400 bytes have no window; every row is a
document, so a repeated row repeats all its windows; a null id is kept as such; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import begin, bitmap, freeing, keyed, mix, of_row, parts, read, table, temporary, whole
from quern.llm.neardup import held_in

WINDOW, ANCHOR, SMALL, TOGETHER, CHUNK = 400, 64, 1024, 4096, 1 << 22
#: Bytes of texts, or of their strings, that give one batch of rows.
HELD = 1 << 23
#: Bytes and words of a repeated passage: 50 words are rarely under 256 bytes, so such passages are found by these and then counted.
PASSAGE, WORDS = 256, 50
_U = np.uint64


def _anchors(x: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """v, a, p1, p2 of each run in bytes x (at most 2**24 of them): anchor hash and place, first and last window."""
    h, w, base = x.astype(np.uint64) + _U(1), 1, 0x9E3779B97F4A7C15
    while w < anchor:  # anchor is a power of two
        h = h[:-w] * _U(base) + h[w:]
        base, w = base * base % 2**64, 2 * w
    h = mix(h)
    span, n = window - anchor + 1, len(x) - window + 1
    key = (h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // span)
    grid = np.full(rows * span, _U(2**64 - 1))
    grid[: len(key)] = key
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    a = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _U(0xFFFFFF)).astype(np.int64)
    p1 = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    p2 = np.concatenate([p1[1:], [n]]) - 1
    return h[a[p1]], a[p1], p1, p2


def runs(data: bytes, window: int = WINDOW, anchor: int = ANCHOR):
    """v, hs, a, p1, p2: the runs of a text; hs is the hash of a run's string."""
    out = []
    for at in range(0, max(len(data) - window + 1, 0), CHUNK):
        x = data[at : at + CHUNK + window - 1]
        v, a, p1, p2 = _anchors(np.frombuffer(x, np.uint8), window, anchor)
        hs = np.array([xxhash.xxh3_64_intdigest(x[i : j + window], int(k - i)) for i, j, k in zip(p1.tolist(), p2.tolist(), a.tolist(), strict=True)], np.uint64)
        out.append((v.view(np.int64), hs.view(np.int64), a + at, p1 + at, p2 + at))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def bytes_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, data (UTF-8 bytes) of every row."""
    return keyed(docs).select("doc_id", "th", F.col("text").cast("binary").alias("data"))


def together(sizes, most: int):
    """Ranges of rows of this total size, or with one row: a batch of Arrow's for each text costs more than what is done with it."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def run_rows(d: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, th and runs of the rows of d (doc_id, th, data)."""

    @freeing
    def run(batches):
        begin("suffix")
        for b in batches:
            data = b.column("data")
            for i, j in together([len(x.as_buffer()) for x in data], HELD):
                found = [runs(x.as_py(), window, anchor) for x in data.slice(i, j - i)]
                at = pa.array(np.repeat(np.arange(i, j), [len(r[0]) for r in found]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))], ["doc_id", "th", "v", "hs", "a", "p1", "p2"])

    return d.mapInArrow(run, "doc_id long, th long, v long, hs long, a long, p1 long, p2 long")


def column_wise(strings: list[bytes], leads: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Which windows of each string are repeated: (strings, columns), by the column where a window starts.

    leads: bytes before a string's anchor, which stands in column window - anchor.
    """
    n, left = len(strings), window - anchor
    first = left - leads
    length = np.array([len(s) for s in strings])
    last = first + length - window  # the last window's column
    marks = np.zeros((n, left + 1), bool)
    least, width = int(first.min()), int((first + length).max())
    with tempfile.TemporaryFile(dir=os.environ.get("TMPDIR") or None) as columns:
        block = np.full((n, width - least), 256, "<u2")
        put = np.arange(n) * (width - least) + first - least - np.concatenate([[0], np.cumsum(length)[:-1]])
        block.reshape(-1)[np.repeat(put, length) + np.arange(length.sum())] = np.frombuffer(b"".join(strings), np.uint8)
        for at in range(0, width - least, 64):  # written once, column after column
            columns.write(block[:, at : at + 64].T.tobytes())
        del block
        order = np.arange(n)
        lcp = np.zeros(n + 1, np.int32)  # lcp[k]: of order[k - 1] and order[k]
        for c in range(width - 1, least - 1, -1):  # read once, from the last column to the first
            columns.seek((c - least) * n * 2)
            symbol = np.frombuffer(columns.read(n * 2), "<u2")[order]
            by = np.argsort(symbol, kind="stable")
            symbol = symbol[by]
            new = np.zeros(n + 1, np.int32)
            # Between neighbours with one symbol: the least prefix of all that stood between; by rises from one to the other.
            between = 1 + np.minimum.reduceat(lcp, by + 1)[:-1]
            new[1:n] = np.where((symbol[1:] == symbol[:-1]) & (symbol[1:] < 256), between, 0)
            order, lcp = order[by], new
            if c <= left:
                same = np.maximum(lcp[:-1], lcp[1:]) >= window
                at = order[same]
                at = at[(first[at] <= c) & (c <= last[at])]
                marks[at, c] = True
    return marks


def _spans(mark: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return [{"s": int(s), "e": int(e) - 1} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


SPANS = "array<struct<s: long, e: long>>"
_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def repeated_spans(d: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, th, p1, spans of the rows of d (doc_id, th, data): ranges of repeated windows, counted from p1."""
    with temporary() as keep:
        occ = keep(table(run_rows(d, window, anchor), "runs"))
        # The first row of a group gives all of a place's columns; they are hashed, where a struct of them would be sorted.
        place = [F.first(c).alias(c) for c in ("doc_id", "th", "a", "p1", "p2")]
        strings = table(occ.groupBy("v", "hs").agg(F.count("*").alias("n"), *place), "strings")
        several = strings.groupBy("v").agg(F.count("*").alias("d"), F.min("n").alias("least")).filter("d > 1 and least = 1").drop("least")
        cand = strings.join(several, "v").select("v", "hs", "n", "d", "doc_id", "th", "a", "p1", "p2")
        per_doc = table(cand.groupBy("doc_id", "th").agg(F.collect_list(F.struct("v", "hs", "n", "d", "a", "p1", "p2")).alias("cut")), "cuts")
        per_doc = per_doc.withColumnsRenamed({"doc_id": "at_doc", "th": "at_th"})
        d = held_in(d, "th", bitmap(per_doc, "at_th"))
        held = d.join(per_doc, d["doc_id"].eqNullSafe(per_doc["at_doc"]) & (d["th"] == per_doc["at_th"])).select("data", "cut")

        @freeing
        def cut(batches):
            names = ["v", "hs", "n", "d", "lead", "s"]
            for b in batches:
                sizes = [len(rows) * 2 * window for rows in b.column("cut")]  # more than the strings of a text mostly have
                for i, j in together(sizes, HELD):
                    cuts = b.column("cut").slice(i, j - i)
                    r = {k: x.to_numpy() for k, x in zip(names[:4] + ["a", "p1", "p2"], cuts.flatten().flatten(), strict=True)}
                    ends = np.cumsum([0, *(len(rows) for rows in cuts)]).tolist()
                    p1, p2 = r["p1"].tolist(), r["p2"].tolist()
                    s = [data[p1[k] : p2[k] + window] for t, lo, hi in zip(b.column("data").slice(i, j - i), ends, ends[1:], strict=False) for data in [t.as_py()] for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(r[k]) for k in names[:4]), pa.array(r["a"] - r["p1"]), pa.array(s, pa.binary())], names)

        texts = table(held.mapInArrow(cut, "v long, hs long, n long, d long, lead long, s binary").dropDuplicates(["v", "hs"]), "texts")
        left = window - anchor
        whole = strings.filter("n > 1").select("v", "hs", F.expr(f"cast(array(named_struct('s', 0L, 'e', p2 - p1)) as {SPANS})").alias("spans"))
        few = texts.filter(F.col("d") <= SMALL).select("n", F.struct("v", "hs").alias("f"), F.col("v").alias("g"), (left - F.col("lead")).alias("lo"), "s")
        found = _compared(few, window, anchor, "struct<v: long, hs: long>").select("f.*", F.expr("transform(spans, x -> named_struct('s', x.s - lo, 'e', x.e - lo))").alias("spans"))
        repeated = whole.union(found)
        many = texts.filter(F.col("d") > SMALL).select("v", "hs", "n", (left - F.col("lead")).alias("first"), (left - F.col("lead")).alias("lo"), "s")
        for part in _split(many, window, anchor):
            repeated = repeated.union(part)
        repeated = keep(table(repeated, "repeated"))
    return occ.join(repeated, ["v", "hs"]).select("doc_id", "th", "p1", "spans")


def _compared(rows: DataFrame, window: int, anchor: int, kind: str) -> DataFrame:
    """f, lo, spans (columns) of the strings (n, f, g, lo: first window's column, s) with n = 1 that share windows with others of group g."""
    left = window - anchor

    @freeing
    def run(batches):
        rows: list = []
        for b in batches:
            rows += zip(*(b.column(c).to_pylist() for c in ("g", "f", "n", "lo", "s")), strict=True)
            while len(rows) >= TOGETHER:
                end = next((k for k in range(len(rows) - 1, 0, -1) if rows[k][0] != rows[k - 1][0]), 0)
                if not end:
                    break
                yield found(rows[:end])
                rows = rows[end:]
        if rows:
            yield found(rows)

    def found(rows):
        _, f, n, lo, s = zip(*rows, strict=True)
        marks = column_wise(list(s), left - np.array(lo), window, anchor)
        keep = [k for k in range(len(rows)) if n[k] == 1 and marks[k].any()]
        spans = [_spans(marks[k]) for k in keep]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for k in keep], pa_kind), pa.array([lo[k] for k in keep], pa.int64()), pa.array(spans, _SPANS)], ["f", "lo", "spans"])

    pa_kind = pa.binary() if kind == "binary" else pa.struct([("v", pa.int64()), ("hs", pa.int64())])
    n_parts = max(parts(rows.sparkSession), rows.count() // TOGETHER)
    return rows.repartition(n_parts, "g").sortWithinPartitions("g").mapInArrow(run, f"f {kind}, lo long, spans {SPANS}")


def _cut_at(width: int, window: int):
    """For mapInArrow: a row for each aligned range of ``width`` columns where windows of a string start, with the bytes of these windows.

    g is of the anchor, the range and the bytes that all windows of the range hold; f of all the row's bytes too.
    """

    @freeing
    def run(batches):
        names = ["v", "hs", "n", "first", "lo", "s", "g", "f"]
        for b in batches:
            out = []
            for v, hs, n, first, lo, s in zip(*(b.column(c).to_pylist() for c in names[:6]), strict=True):
                last = lo + len(s) - window
                for k in range(lo // width, last // width + 1):
                    c1, c2 = k * width, (k + 1) * width - 1
                    i, j = max(c1, lo), min(c2, last)
                    own = s[i - lo : j + window - lo]
                    g = xxhash.xxh3_128_digest(np.array([v, width, k], "<i8").tobytes() + s[c2 - lo : c1 + window - lo])
                    out.append((v, hs, n, first, i, own, g, xxhash.xxh3_128_digest(g + np.array([i, j], "<i8").tobytes() + own)))
            cols = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, [pa.int64()] * 5 + [pa.binary()] * 3, strict=True)], names)

    return run


def _split(many: DataFrame, window: int, anchor: int) -> list[DataFrame]:
    """v, hs, spans of repeated windows, for strings (v, hs, n, first: its column, lo, s) of anchors that have too many for one task."""
    out, width = [], window - anchor + 1
    while width > 1 and not many.isEmpty():
        width = (width + 1) // 2
        rows = table(many.mapInArrow(_cut_at(width, window), "v long, hs long, n long, first long, lo long, s binary, g binary, f binary"), "ranges")
        # Equal pieces are one: copies of a hot passage shrink to a row before they are compared.
        items = rows.groupBy("g", "f").agg(F.sum("n").alias("n"), F.first(F.struct("lo", "s")).alias("x"))
        items = table(items.select("g", "f", "n", "x.lo", "x.s"), "pieces")
        sizes = items.groupBy("g").agg(F.count("*").alias("d"))
        whole = items.filter("n > 1").select("f", F.expr(f"cast(array(named_struct('s', lo, 'e', lo + length(s) - {window})) as {SPANS})").alias("spans"))
        few = items.join(sizes.filter(f"d > 1 and d <= {SMALL}"), "g").select("n", "f", "g", "lo", "s")
        found = table(whole.union(_compared(few, window, anchor, "binary").select("f", "spans")), "found")
        out.append(rows.select("v", "hs", "first", "f").join(found, "f").select("v", "hs", F.expr("transform(spans, x -> named_struct('s', x.s - first, 'e', x.e - first))").alias("spans")))
        many = rows.join(sizes.filter(f"d > {SMALL}"), "g", "left_semi").select("v", "hs", "n", "first", "lo", "s")
    return out


def _cuts(spans: DataFrame) -> DataFrame:
    """at_doc, at_th, cut: ranges of the repeated windows of each document that has one, from rows of ``repeated_spans``."""
    per_doc = spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.expr("transform(spans, x -> named_struct('s', p1 + x.s, 'e', p1 + x.e))"))).alias("cut"))
    return per_doc.withColumnsRenamed({"doc_id": "at_doc", "th": "at_th"})


def _stretches(d: DataFrame, short: DataFrame, least: int, window: int) -> DataFrame:
    """doc_id, th, at, data: the stretches of each text, of ``window`` bytes or more, where repeated strings of ``least`` bytes start at every place.

    short: at_doc, at_th, short (ranges of the places of those strings). A repeated window is
    repeated strings from end to end, so it stands whole in one stretch, and so does each of its repeats.
    """

    @freeing
    def run(batches):
        begin("suffix")
        for b in batches:
            sizes = [len(x.as_buffer()) for x in b.column("data")]
            for i, j in together(sizes, HELD):
                of, at, out = [], [], []
                for k in range(i, j):
                    s, e = (x.to_numpy() for x in b.column("short")[k].values.flatten())
                    edge = np.zeros(sizes[k] + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e + 1, -1)
                    edge = np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]))
                    text = b.column("data")[k].as_py()
                    for first, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                        if end - 1 + least - first >= window:
                            of.append(k)
                            at.append(first)
                            out.append(text[first : end - 1 + least])
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("th").take(of), pa.array(at, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "th", "at", "data"])

    some = short.filter(f"aggregate(short, 0L, (n, x) -> n + x.e - x.s + 1) > {window - least}")
    d = held_in(d, "th", bitmap(some, "at_th"))
    held = d.join(some, d["doc_id"].eqNullSafe(some["at_doc"]) & (d["th"] == some["at_th"])).select("doc_id", "th", "data", "short")
    return held.mapInArrow(run, "doc_id long, th long, at long, data binary")


def _covered(n: int, cut: pa.Scalar, window: int) -> np.ndarray:
    """Which of n bytes the windows of cut cover."""
    s, e = (x.to_numpy() for x in cut.values.flatten())
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _of_words(data: bytes, covered: np.ndarray, words: int) -> int:
    """Bytes in the runs of covered bytes that hold so many words (also in part) or more."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    blank = np.isin(np.frombuffer(data, np.uint8), [9, 10, 11, 12, 13, 32])
    begun = np.append(0, np.cumsum(~blank & np.append(True, blank[:-1])))
    held = begun[e] - begun[np.minimum(s + 1, e)] + ~blank[s]
    return int((e - s)[held >= words].sum())


def dedup_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, as_text: bool = False, passages: tuple[int, int] | None = None) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans (long) and kept (binary, or text without characters cut in two).

    passages (bytes, at most window; words) adds repeats (long): bytes in runs of at least so many words that such
    shorter strings, which also start elsewhere, cover. They are counted, not removed. Windows are then
    looked for in the stretches that these strings leave no gap in; there is no repeated one elsewhere.
    """
    if passages and passages[0] > window:
        raise ValueError("the strings of passages can't be longer than the window")
    if passages:
        with temporary() as keep:
            short = keep(table(_cuts(repeated_spans(bytes_of(docs), passages[0], anchor)).withColumnRenamed("cut", "short"), "passages"))
        with temporary() as keep:
            # Copies of a document all stay, since they repeat each other's windows. A table holds the numbers fast.
            some = table(_stretches(bytes_of(docs), short, passages[0], window).withColumn("id", F.monotonically_increasing_id()), "stretches")
            spans = repeated_spans(some.select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("th"), "data"), window, anchor)
            spans = spans.select(F.col("doc_id").alias("id"), "p1", "spans").join(some.select("id", "doc_id", "th", "at"), "id")
            cuts = keep(table(_cuts(spans.withColumn("p1", F.col("p1") + F.col("at"))), "cuts"))
        cuts = cuts.withColumnsRenamed({"at_doc": "in_doc", "at_th": "in_th"})
        per_doc = short.join(cuts, short["at_doc"].eqNullSafe(cuts["in_doc"]) & (short["at_th"] == cuts["in_th"]), "left").select("at_doc", "at_th", "cut", "short")
    else:
        per_doc = _cuts(repeated_spans(bytes_of(docs), window, anchor)).withColumn("short", F.lit(None).cast(SPANS))
    with temporary() as keep:
        per_doc = keep(table(per_doc, "removed"))
    held = bitmap(per_doc, "at_th")
    d = whole(docs, doc_id=F.col("doc_id"), th=F.xxhash64(F.coalesce("text", F.lit(""))))
    # The others, most texts, have nothing removed and need no shuffle.
    others = held_in(d, "th", held, "left_anti")
    d = held_in(d, "th", held)
    joined = d.join(per_doc, d["doc_id"].eqNullSafe(per_doc["at_doc"]) & (d["th"] == per_doc["at_th"]), "left")
    added = ["n_bytes", "n_removed", "n_spans", "repeats", "kept"]

    def run(texts: pa.Array, cuts: pa.Array, shorts: pa.Array) -> pa.Array:
        n, gone, count, held, kept = [], [], [], [], []
        for t, cut, short in zip(texts, cuts, shorts, strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            n.append(len(data))
            held.append(_of_words(data, _covered(len(data), short, passages[0]), passages[1]) if short.is_valid else 0)
            if not cut.is_valid:
                gone.append(0)
                count.append(0)
                kept.append(data)
                continue
            out = _covered(len(data), cut, window)
            gone.append(int(out.sum()))
            count.append(int((np.diff(np.concatenate([[0], out.astype(np.int8)])) == 1).sum()))
            kept.append(np.frombuffer(data, np.uint8)[~out].tobytes())
        last = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in (n, gone, count, held)), last], added)

    # Not deterministic for the optimiser, which would copy the call into filters on what it gives.
    call = F.arrow_udf(run, f"struct<n_bytes: long, n_removed: long, n_spans: long, repeats: long, kept: {'string' if as_text else 'binary'}>").asNondeterministic()
    names = [c for c in added if passages or c != "repeats"]
    text, zero = F.coalesce(F.col("row.text"), F.lit("")), F.lit(0).cast("long")
    same = {"n_bytes": F.octet_length(text).cast("long"), "n_removed": zero, "n_spans": zero, "repeats": zero, "kept": text if as_text else text.cast("binary")}
    some = joined.select("row", call(F.col("row.text"), F.col("cut"), F.col("short")).alias("m")).select(*of_row(docs), *[F.col(f"m.{c}").alias(c) for c in names])
    return some.unionAll(others.select(*of_row(docs), *[same[c].alias(c) for c in names]))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"), passages=(PASSAGE, WORDS))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "repeats", F.sha2("kept", 256).alias("kept_sha256"))
