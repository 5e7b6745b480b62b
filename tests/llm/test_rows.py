"""Long rows, nulls, ties, repeated rows and clashing names, for every operator and every stage of the pipeline."""

import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA  # noqa: E402
from test_operators import jaccard_brute, quality_brute, suffix_brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from quern.llm import chat, jaccard, lattice, license_scan, line_dedup, packing, quality, sentencepieces, substring, suffix  # noqa: E402

#: Names that the operators use themselves, and odd ones.
NAMES = "row m cut at_doc at_th th sid cid starts line x l q w p r s k v hs d n a b first last lead th_ __th __doc __hash __starts __cut __bins __lang __words half lang_ spans removed piece salt rank base unit keys".split() + ["a.b", "two words"]
LONG = " ".join(f"w{i % 5000}z{i}" for i in range(60_000))
ROWS = [(1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \n\t "), (None, "lonely text of a null id that has ten words or so"),
        (5, LONG), (6, LONG + " end"), (7, "\n".join(f"line {i}" for i in range(20_000))), (8, "x" * 200_000)]


def clashing(spark, rows=ROWS):
    df = spark.createDataFrame([(i, t, "en" if i != 3 else None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 0), (5, 0), (5, 1)], "doc_id long, quality int")


def test_line_dedup_rows(spark):
    d = clashing(spark)
    out = line_dedup.dedup_lines(d)
    assert out.columns == [*d.columns, "n_lines", "n_removed", "n_spans", "kept_text"]
    got = out.select("doc_id", "text", "n_lines", "n_removed", "kept_text").collect()
    assert len(got) == len(ROWS) and all(r["n_removed"] == 0 and r["kept_text"] == (r["text"] or "") and r["n_lines"] == (r["text"] or "").count("\n") + 1 for r in got)


def test_quality_rows(spark):
    d = clashing(spark)
    out = quality.judge(d, labels(spark))
    assert out.columns[: len(d.columns)] == d.columns
    for r in out.collect():
        base = quality_brute(r["text"])
        assert [r[c] for c in quality.BASE] == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])


def test_jaccard_rows(spark):
    got = jaccard.classes(clashing(spark)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == jaccard_brute(ROWS)


def test_suffix_rows(spark):
    rows = [x for x in ROWS if x[0] != 8]  # 200,000 equal bytes take the brute force too long
    d = clashing(spark, rows)
    out = suffix.dedup_bytes(d)
    assert out.columns[: len(d.columns)] == d.columns
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in out.collect()}
    assert got[(5, len(LONG))] == (len(LONG), 1) and got[(6, len(LONG) + 4)] == (len(LONG), 1) and got[(2, 0)] == (0, 0)
    one = suffix.dedup_bytes(clashing(spark, [ROWS[-1]])).collect()[0]
    assert (one["n_removed"], one["n_spans"]) == (200_000, 1)


def test_other_document_operators(spark):
    path = __import__("public_tokenizers").path
    d, n = clashing(spark), len(ROWS)
    packed = packing.pack_documents(d, path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in ROWS} and sum(r["piece"] == 0 for r in packed) == n
    cut = {r["doc_id"]: r for r in substring.dedup_paragraphs(d).collect()}
    assert cut[6]["removed"] == [0] and cut[6]["removed_chars"] == len(LONG) + 4 and all(cut[i]["removed_chars"] == 0 for i in cut if i != 6)
    found = license_scan.scan(d).collect()
    assert len(found) == n and all(r["n_base"] == 0 and r["base_labels"] == "" for r in found)
    coded = sentencepieces.round_trip(d, path("piece_bpe_32k.model")).collect()
    assert len(coded) == n and all(r["parity"] for r in coded) and {r["n_tokens"] for r in coded if r["doc_id"] in (2, 3)} == {0}


def test_vector_and_chat_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (2, None, 1), (3, [1.0, 0.0], None), (4, [0.0, 1.0] * 4000, 1), (5, [0.0, 1.0] * 4000, 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(0).alias(c) for c in NAMES])
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_vectors(v).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4)], key=str)
    turns = spark.createDataFrame([(None, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns.select("*", *[F.lit(0).alias(c) for c in NAMES]))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("assistant", LONG), ("user", "b"), ("user", "b")] and back[1]["loss"] == LONG and [tuple(t) for t in back[None]["turns"]] == [("", "")]


def test_stages_rows(spark):
    """Every stage takes nulls, long texts, repeated rows, an empty table and clashing names."""
    d = clashing(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, DATA)
        none = stage(spark, d.filter("false"), DATA)
        assert none.count() == 0
        out = stage(spark, d, DATA)
        if name != "best-fit packing":
            assert out.columns == d.columns
        ids = sorted({r["doc_id"] for r in out.select("doc_id").collect()}, key=str)
        want = {"quality rules": [1, 5, 6, 7, None], "n-gram Jaccard join": [1, 2, 3, 4, 5, 7, 8, None], "suffix-array dedup": [1, 2, 3, 4, 6, 7, None]}
        if name == "quality rules":
            assert set(ids) <= {1, 5, 6, 7, None} and {1, 5, 6, None} <= set(ids)
        elif name in want:
            assert set(ids) == set(want[name]), name
        else:
            assert set(ids) == {i for i, _ in ROWS}, name


def test_long_rows_take_linear_time(spark):
    lines = "\n".join(f"line {i}" for i in range(32_000))
    d = spark.createDataFrame([(1, lines + "\nx\ny\nz"), (2, "x\ny\nz\n" + lines[:-3])], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(d).collect()}
    assert got == {1: 0, 2: 32_002} and time.time() - began < 60
    turns = spark.range(16_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("hello </s> there").alias("text"))
    began = time.time()
    r = chat.read_back(chat.format_chats(turns)).collect()[0]
    assert len(r["turns"]) == 16_000 and len(r["loss"]) == 8_000 * 16 and time.time() - began < 60


@pytest.mark.parametrize("small", [1024, 40])
def test_suffix_of_a_hot_anchor(spark, monkeypatch, small):
    """The production window; a passage in 300 texts of different words, so one anchor has hundreds of strings."""
    monkeypatch.setattr(suffix, "SMALL", small)
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 2**40, n))
    passage = word(70)
    rows = [(k, word(rng.integers(40, 60)) + " " + passage[rng.integers(0, 60) :] + " " + word(rng.integers(40, 60))) for k in range(300)]
    out = suffix.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == suffix_brute(rows, 400)
