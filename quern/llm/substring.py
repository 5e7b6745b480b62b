"""Substring dedup (operator 7): paragraphs by MinHash banding.

A text's lines of MIN_WORDS words or more are its paragraphs. Bands are tuned
for the wanted recall at similarity 0.75 of five-word shingle sets; paragraphs
that share a band are joined (see neardup), verified by exact Jaccard, and
clustered by components. Of each cluster the paragraph that is first in the
order (doc_id, text hash, line) stays and the others are removed.

Passages on lines that stay: each word in PASSAGE = 49 words in a row (A-Z in lower case; line
ends part words like blanks, and no word is on a removed line) that also stand at an earlier place
goes, with the blanks after it. A place is (doc_id, text hash, line of the first word), so a line
that repeats itself stays. To find these without a row per word, blocks come first: of every BLOCK
places in a row the one with the least hash of its next five words (ties: the first) starts a block of
BLOCK words, so equal passages share a block. Only passages around blocks that several places share are
compared, by 64-bit hashes.

Cases: null text is empty; shorter lines, blank ones too, always stay; rows
that repeat id and text count once and get the same result; a null id sorts
first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import GOLD, PIECE, begin, forget, keyed, mix, powers, read, table, temporary, word_hashes
from quern.llm.neardup import WORDS, band, distinct_sets, lowered, shingle_hashes, shingles, similar, sketches, texts_at, tune_bands

MIN_WORDS, RECALL = 20, 0.998
BLOCK = 25
PASSAGE = 2 * BLOCK - 1
TOGETHER = 1 << 18  # bytes of texts whose words are hashed at once


def together(texts: pa.Array):
    """Words of texts, A-Z in lower case, of as many texts at once as stay small.

    Gives the first text's number; hashes of the words; the word that each text starts at, and
    their number; the same of each line; the line that each text starts at.
    """
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        data = lowered(t.as_py())
        if held and size + len(data) > TOGETHER:
            yield at, *_joined(held)
            held, size, at = [], 0, k
        held.append(data)
        size += len(data) + 1
    if held:
        yield at, *_joined(held)


def _joined(held: list[bytes]):
    data = b"\n".join(held)  # a line end parts words, and lines as the end of a text does
    h, start, _ = word_hashes(data)
    begins = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return h, np.append(np.searchsorted(start, begins), len(h)), np.concatenate([[0], np.searchsorted(start, ends), [len(h)]]), np.searchsorted(ends, begins)


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, line, sid, sketch of each paragraph."""

    def run(batches):
        begin("substring")
        for b in batches:
            for k, h, _, lines, line0 in together(b.column("text")):
                n = np.flatnonzero(np.diff(lines) >= max(min_words, WORDS))
                if not len(n):
                    continue
                sizes = lines[n + 1] - lines[n] - WORDS + 1
                starts = np.cumsum(sizes) - sizes
                grams, starts = distinct_sets(shingle_hashes(h)[np.arange(sizes.sum()) + np.repeat(lines[n] - starts, sizes)], starts)
                data, ends = memoryview(grams.tobytes()), np.append(starts[1:], len(grams)).tolist()
                sid = [xxhash.xxh3_128_digest(data[8 * i : 8 * j]) for i, j in zip(starts.tolist(), ends, strict=True)]
                sk = [s.tobytes() for s in sketches(grams, starts)]
                own = np.searchsorted(line0, n, side="right") - 1
                at = pa.array(k + own)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("th").take(at), pa.array((n - line0[own]).astype(np.int32)), pa.array(sid, pa.binary()), pa.array(sk, pa.binary())],
                    ["doc_id", "th", "line", "sid", "sketch"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, line int, sid binary, sketch binary")


def _grams(batches):
    for b in batches:
        grams = [shingles(t.as_py().split("\n")[n.as_py()]).tobytes() for t, n in zip(b.column("text"), b.column("line"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(grams, pa.binary())], ["cid", "grams"])


def removals(docs: DataFrame, min_words: int = MIN_WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, th, line of each paragraph to remove, with first: the place that stays."""
    p = table(paragraphs(docs, min_words), "paragraphs")
    place = F.struct("doc_id", "th", "line")
    nodes = p.groupBy("sid").agg(F.min(place).alias("place"), F.first("sketch").alias("sketch"))
    nodes = table(nodes.withColumn("cid", F.monotonically_increasing_id()), "nodes")
    full, p = p, table(p.drop("sketch"), "paragraphs")
    forget(full)

    def grams_of(ids: DataFrame) -> DataFrame:
        places = nodes.join(ids, "cid").select("cid", "place.doc_id", "place.th", "place.line")
        return texts_at(keyed(docs), places).select("cid", "line", "text").mapInArrow(_grams, "cid long, grams binary")

    bands, rows = tune_bands(recall, most_rows=4)
    root = similar(nodes, partial(band, bands=bands, rows=rows), grams_of)
    known = nodes.join(root, "cid", "left").select("sid", "place", F.coalesce("root", "cid").alias("root"))
    known = table(known, "roots")
    first = known.groupBy("root").agg(F.min("place").alias("first"))
    named = known.join(first, "root").select("sid", "first")
    return p.join(named, "sid").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "line", "first")


def least_at(h: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each n values in a row stands (ties: the first)."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    at, w = np.arange(len(h)), 1
    while w < n:  # of w values so far
        k = min(w, n - w)
        at, h = np.where(h[k:] < h[:-k], at[k:], at[:-k]), np.minimum(h[k:], h[:-k])
        w += k
    return at


def block_starts(h: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The words that start a block, in order, of texts whose shingles have the hashes h.

    first: the word that each text starts at, and their number (without: h is one text).
    """
    if first is None:
        first = np.array([0, len(h) + WORDS - 1])
    words = np.diff(first)
    at = least_at(h, BLOCK)
    at = at[np.flatnonzero(np.repeat(first[1:], words)[: len(at)] - np.arange(len(at)) >= PASSAGE)]
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def runs(g: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of so many words that start at the given words, in order; g are the hashes of the text's shingles.

    A polynomial of its shingles, from differences of running sums.
    """
    n = words - WORDS + 1
    power, inverse = powers(PIECE + n)
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(g), PIECE):
        i, j = np.searchsorted(at, [k, k + PIECE])
        if i < j:
            part = g[k : k + PIECE + n]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(part * inverse[: len(part)])])
            own = at[i:j] - k
            out[i:j] = (sums[own + n] - sums[own]) * power[own + n - 1]
    return mix(out + np.full(1, words, np.uint64) * power[n]).view(np.int64)


def words_of(text: str) -> tuple[np.ndarray, ...]:
    """Hashes, starts, stops (bytes) and lines of a text's words."""
    data = lowered(text)
    h, start, stop = word_hashes(data)
    return h, start, stop, np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), start)


def _line_of(lines: np.ndarray) -> np.ndarray:
    """The line of each word."""
    return np.repeat(np.arange(len(lines) - 1), np.diff(lines))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, th, line, last (of the lines it is on), key of each different block."""

    def run(batches):
        begin("substring")
        for b in batches:
            out = []
            for k, h, words, lines, line0 in together(b.column("text")):
                g = shingle_hashes(h)
                i = block_starts(g, words)
                if not len(i):
                    continue
                line, own = _line_of(lines), np.searchsorted(words, i, side="right") - 1
                key, first, last = runs(g, i, BLOCK), line[i] - line0[own], line[i + BLOCK - 1] - line0[own]
                same = mix(np.array([own, first, last]).astype(np.uint64) + np.array([[1], [2], [3]], np.uint64) * GOLD)
                _, one = np.unique(mix(key.view(np.uint64) + same[0] + same[1] * GOLD + mix(same[2])), return_index=True)
                out.append((k + own[one], first[one], last[one], key[one]))
            at, first, last, key = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at)), b.column("th").take(pa.array(at)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(key)],
                ["doc_id", "th", "line", "last", "key"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, line int, last int, key long")


def _items(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists (null: none), one after the other, and the number of each one's list."""
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def _passages(batches):
    """doc_id, th, line, word, h of the passages around shared blocks, none of them on a removed line."""
    begin("substring")
    for b in batches:
        out = []
        for k, h, words, lines, line0 in together(b.column("text")):
            g = shingle_hashes(h)
            i = block_starts(g, words)
            keys, of = _items(b.column("keys").slice(k, len(line0)))
            own = np.searchsorted(words, i, side="right") - 1
            known = np.isin(mix(runs(g, i, BLOCK).view(np.uint64) + mix(own)), mix(keys.view(np.uint64) + mix(of)))
            i, own = i[known], own[known]
            near = np.zeros(len(h) + 1, np.int64)
            np.add.at(near, np.maximum(i - (PASSAGE - BLOCK), words[own]), 1)
            np.add.at(near, np.minimum(i, words[own + 1] - PASSAGE) + 1, -1)
            i = np.flatnonzero(np.cumsum(near)[:-1])
            gone, of = _items(b.column("gone").slice(k, len(line0)))
            off = np.zeros(len(lines) - 1, np.int64)
            off[line0[of] + gone] = 1
            off = np.append(0, np.cumsum(np.repeat(off, np.diff(lines))))
            i = i[off[np.minimum(i + PASSAGE, len(h))] == off[i]]
            line, own = _line_of(lines)[i], np.searchsorted(words, i, side="right") - 1
            out.append((k + own, line - line0[own], i - words[own], runs(g, i, PASSAGE)))
        at, line, word, h = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(at)), b.column("th").take(pa.array(at)), pa.array(line.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(h)],
            ["doc_id", "th", "line", "word", "h"])


def repeats(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, th, word (where it starts), stays of each passage that several places hold on lines that aren't in gone (doc_id, th, line); it stays at the first of them."""
    lines = gone.groupBy(F.col("doc_id").alias("at_doc"), F.col("th").alias("at_th")).agg(F.collect_list("line").alias("gone"))  # as many as the text has
    b = blocks(docs)
    b = b.join(lines, b["doc_id"].eqNullSafe(lines["at_doc"]) & (b["th"] == lines["at_th"]), "left")
    b = table(b.filter("gone is null or not exists(gone, x -> x between line and last)").select("doc_id", "th", "line", "key"), "blocks")
    place = F.struct("doc_id", "th", "line")
    several = lambda d, key: d.groupBy(key).agg(F.min(place).alias("first"), F.max(place).alias("least")).filter("not first <=> least")
    shared = b.join(several(b, "key").select("key"), "key").groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys"))
    shared = shared.join(lines, shared["doc_id"].eqNullSafe(lines["at_doc"]) & (shared["th"] == lines["at_th"]), "left").select("doc_id", "th", "keys", "gone")
    shared = table(shared, "shared")
    # Rows that repeat id and text are one document.
    found = texts_at(keyed(docs), shared).mapInArrow(_passages, "doc_id long, th long, line int, word int, h long")
    found = table(found, "passages")
    first = several(found, "h").select("h", "first")
    return found.join(first, "h").select("doc_id", "th", "word", place.eqNullSafe(F.col("first")).alias("stays")).distinct()


def kept_text(text: str, removed: list[int], words: list[int]) -> tuple[str, int]:
    """The text without the removed lines and the passages that start at these words, and the characters in passages."""
    n_cut = 0
    if words:
        data, (h, start, stop, line) = text.encode("utf-8", "surrogatepass"), words_of(text)
        n = np.zeros(len(h) + 1, np.int64)
        np.add.at(n, words, 1)
        np.add.at(n, np.array(words) + PASSAGE, -1)
        # A word's blanks go with it, but not those at its line's end.
        ends = np.where(np.append(line[1:] == line[:-1], False), np.append(start[1:], 0), stop)
        i = np.flatnonzero(np.cumsum(n)[:-1])
        out, end = [], 0
        for x, y in zip(start[i].tolist(), ends[i].tolist(), strict=True):
            out.append(data[end:x])
            end = y
        rest = (b"".join(out) + data[end:]).decode("utf-8", "surrogatepass")
        n_cut, text = len(text) - len(rest), rest
    if removed:
        drop = set(removed)
        text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
    return text, n_cut


def _kept(texts: pa.Array, removed: pa.Array, words: pa.Array) -> pa.Array:
    got = [(len(t), *kept_text(t, r or [], w or [])) for t, r, w in zip(texts.to_pylist(), removed.to_pylist(), words.to_pylist(), strict=True)]
    lost = [n - len(kept) for n, kept, _ in got]
    return pa.StructArray.from_arrays([pa.array(lost, pa.int64()), pa.array([n for *_, n in got], pa.int64()), pa.array([k for _, k, _ in got], pa.string())], ["removed_chars", "n_cut", "kept_text"])


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, removed_chars (all that goes), n_lines, n_removed, removed (line numbers), n_cut (characters cut out of other lines), n_first, kept_text.

    n_first: lines and starts of passages that stay here, as the first of several.
    """
    with temporary() as keep:
        found = table(removals(docs, min_words, recall).distinct(), "removed")
        lines = found.select("doc_id", "th", "line")
        part = repeats(docs, lines)
        none, one = F.lit(None).cast("int"), F.lit(1)
        rows = [lines.select("doc_id", "th", "line", none.alias("word"), none.alias("first")),
                found.select("first.*").distinct().select("doc_id", "th", none, none, one),
                part.select("doc_id", "th", none, F.when(~F.col("stays"), F.col("word")), F.when(F.col("stays"), one))]
        # As many as the text has lines and words.
        gone = rows[0].union(rows[1]).union(rows[2]).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("line")).alias("removed"), F.collect_list("word").alias("words"), F.count("first").alias("n_first"))
        gone = keep(table(gone, "gone"))
    gone = gone.withColumnsRenamed({"doc_id": "at_doc", "th": "at_th"})
    d = keyed(docs)
    out = d.join(gone, d["doc_id"].eqNullSafe(gone["at_doc"]) & (d["th"] == gone["at_th"]), "left")
    # Not deterministic for the optimiser, which would copy the call into filters on what it gives.
    call = F.arrow_udf(_kept, "struct<removed_chars: long, n_cut: long, kept_text: string>").asNondeterministic()
    out = out.select("doc_id", "text", F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"), F.coalesce("n_first", F.lit(0)).alias("n_first"), call("text", "removed", "words").alias("m"))
    return out.select(
        "doc_id", "m.removed_chars", F.expr("cast(size(split(text, '\n')) as long)").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        "removed", "m.n_cut", "n_first", "m.kept_text")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_paragraphs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removed_chars", F.col("n_removed").alias("removed_lines"), F.col("n_cut").alias("cut_chars"), (F.col("removed_chars") + F.col("n_first")).alias("repeats"), "removed", F.sha2("kept_text", 256).alias("kept_sha256"))
