"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA, both  # noqa: E402

from quern.llm import chat, jaccard, lattice, license_scan, line_dedup, neardup, packing, quality, queries, sentencepieces, substring, suffix  # noqa: E402

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two"
LONG = " ".join(f"w{i}" for i in range(300))
ODD = [
    (1, BASE), (2, BASE + " more"), (3, None), (4, ""), (5, "a b"), (6, "A\tB"), (7, LONG), (8, LONG + " x"), (None, BASE), (9, "no " * 40), (9, "no " * 40), (10, BASE), (10, "other text under one id"),
]


def documents(spark, rows=ODD):
    """With columns named as the operators' own."""
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    return df.withColumn("sid", F.lit(1)).withColumn("cid", F.lit(2)).withColumn("th", F.lit("x")).withColumn("starts", F.lit(0))


def empty(spark):
    return documents(spark).filter("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    ours, theirs = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs


def test_empty_tables(spark):
    path = __import__("public_tokenizers").path
    d = empty(spark)
    assert line_dedup.dedup_lines(d).count() == 0
    assert jaccard.classes(d).count() == 0
    assert packing.pack_documents(d, path("word_bpe_49k.json")).count() == 0
    assert substring.dedup_paragraphs(d).count() == 0
    assert suffix.dedup_bytes(d).count() == 0
    assert license_scan.scan(d).count() == 0
    assert sentencepieces.round_trip(d, path("piece_bpe_32k.model")).count() == 0
    assert quality.judge(d, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_line_windows(spark):
    text = "\n".join(["a", "b", "c", "d"])
    rows = [(1, text), (2, text + "\ne"), (3, "\n\n\n\n"), (4, "\n\n\n\n"), (5, None), (1, text)]
    got = sorted(line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "n_lines", "n_removed", "n_spans", "kept_text").collect())
    assert got == [(1, 4, 0, 0, text), (1, 4, 0, 0, text), (2, 5, 4, 1, "e"), (3, 5, 0, 0, "\n\n\n\n"), (4, 5, 0, 0, "\n\n\n\n"), (5, 1, 0, 0, "")]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok", "\\", "\\<|end|>", None, "<|text|>\n<|start|>", "[/INST]\\\\", ""]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "<|end|>", None, "user"], texts))] + [(None, None, "user", "x"), (1, 6, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:7]] + [("user", "")]
    assert got[1]["loss"] == "\\<|end|>" and got[1]["n_messages"] == 5
    assert not any(c in got[1]["formatted"] for c in ("</s>", "[INST]"))


def test_sentencepiece_parity(spark):
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    texts = ["plain text", " two  blanks ", "\n\ttabs", "日本語 ☃ 𝔘", "a", " ", BASE]
    c = sentencepieces.Codec(path)
    ids, parity = c.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == c.sp.encode(texts) and all(parity)
    assert c.decode(ids) == texts
    d = documents(spark, list(enumerate(texts)))
    back = sentencepieces.decode(sentencepieces.encode(d, path), path)
    assert sorted(x["text"] for x in back.collect()) == sorted(texts)
    assert all(x["parity"] for x in sentencepieces.round_trip(spark.read.parquet(f"{DATA}/documents.parquet"), path).collect())


def license_brute(text):
    """n_words, n_base, first, last, base labels, in plain Python."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(ws)) if ws[i : i + p.count(" ") + 1] == p.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark):
    texts = ["Under the MIT License; Apache License, Version 2.0", "CC BY-NC 4.0 cc-by-nc", "apache license version 20", "under the mit licenses", None, "", "Kelvin K under the mit license", "GPLv3 é SPDX-License-Identifier: MIT"]
    rows = list(enumerate(texts)) + [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "gpl-3,mit" and got[0]["labels"] == "apache-2,mit"
    for row in license_scan.rules():
        re.compile(row[4])
        assert any(x in row[2] for x in license_scan.ROOTS)


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {x: min((rows[k][0] for k in range(len(rows)) if root[k] == x and rows[k][0] is not None), default=None) for x in set(root)}
    return sorted(((rows[k][0], len(sets[k]), least[root[k]]) for k in range(len(rows))), key=str)


def test_jaccard(spark):
    rng = np.random.default_rng(0)
    rows = list(ODD)
    for k in range(12):  # copies with more and more words changed
        w = LONG.split()
        for at in rng.choice(300, k, replace=False):
            w[at] = f"z{k}"
        rows.append((20 + k, " ".join(w)))
    got = jaccard.classes(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == jaccard_brute(rows)


def test_packing():
    rng = np.random.default_rng(1)
    for size in (12, 4096):
        counts = Counter(rng.integers(1, size + 1, 400).tolist())
        groups = packing.plan(counts, size)
        used = Counter()
        for slots, bins in groups:
            assert sum(n * k for n, k in slots) <= size and sum(k for n, k in slots if 3 * n > size) <= 2
            for n, k in slots:
                used[n] += k * bins
        assert used == counts
        assert sum(b for _, b in groups) <= 1.25 * sum(n * c for n, c in counts.items()) / size + 1


def test_packing_of_documents(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = list(ODD) + [(50, LONG * 9), (51, "It's <|endoftext|> THE, the!! é É. ǰ J̌ Σ")]
    got = packing.pack_documents(documents(spark, rows), path).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[(i, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_substring(spark):
    other = "quite different words stand here " * 1 + " ".join(f"v{i}" for i in range(30))
    rows = [(1, f"{BASE}\nshort"), (2, f"{other}\n{BASE} more"), (3, "short\n\nshort"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in substring.dedup_paragraphs(documents(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["kept_text"] == other and got[2]["removed"] == [1]
    assert got[3]["kept_text"] == "short\n\nshort" and got[4]["kept_text"] == "" and got[5]["n_lines"] == 1
    bands, rows_ = neardup.tune_bands(0.998, most_rows=4)
    assert 1 - (1 - 0.75**rows_) ** bands >= 0.998


def test_substring_inside_lines(spark):
    own = lambda k, n: " ".join(f"{k}e{j}" for j in range(n))
    rows = []
    for k in range(20):  # a passage of 60 words in two lines of 150, at different places
        passage = own(f"p{k}", 60)
        rows += [(2 * k, f"{own(f'a{k}', 30)} {passage} {own(f'b{k}', 60)}"), (2 * k + 1, f"head\n{own(f'c{k}', 70)}  {passage.upper()}  {own(f'd{k}', 20)}")]
    rows += [(100, "no " * 200), (101, "no " * 200 + "yes"), (102, own("z", 24) + " " + own("y", 60)), (103, own("x", 60) + " " + own("z", 24)), (None, None)]
    got = {r["doc_id"]: r for r in substring.dedup_paragraphs(documents(spark, rows + rows[:1])).collect()}
    for i, t in rows:
        if i is None or i % 2 == 0 or i > 99:
            if i != 101:
                assert (got[i]["n_cut"], got[i]["kept_text"]) == (0, t or "")
            continue
        k = i // 2
        words, kept = t.split(), got[i]["kept_text"].split()
        assert got[i]["n_removed"] == 0 and got[i]["n_cut"] == len(t) - len(got[i]["kept_text"])
        assert 25 <= len(words) - len(kept) <= 60  # only words of the passage go, in one run
        at = next(j for j, (x, y) in enumerate(zip(words, kept)) if x != y)
        assert words[:at] + words[at + len(words) - len(kept) :] == kept and 71 <= at and all(w.startswith(f"P{k}") for w in words[at : at + len(words) - len(kept)])
        assert got[i]["kept_text"].startswith("head\n")
    assert len(substring.block_starts(np.arange(44, dtype=np.uint64))) == 0 and len(substring.block_starts(np.arange(45, dtype=np.uint64))) == 1


def test_repeated_passages_go_whole(spark):
    """Against plain Python: words in 49 words in a row that an earlier place holds, across lines too."""
    own = lambda k, n: [f"{k}e{j}" for j in range(n)]
    rng, passages = np.random.default_rng(7), [own(f"p{k}", n) for k, n in enumerate((48, 49, 50, 75, 130))]
    rows = [(0, "no " * 300), (1, "no " * 300 + "yes"), (2, None), (3, "")]
    for i in range(10, 40):
        words = own(f"a{i}", 30) + passages[i % 5] + own(f"b{i}", 40)
        n = 12 + i % 4  # lines of under 20 words stay
        rows.append((i, "\n".join(" ".join(words[j : j + n]) for j in range(0, len(words), n))))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    first, want = {}, {}
    for i, t in sorted(rows):
        at = [(w, n) for n, line in enumerate((t or "").split("\n")) for w in line.split()]
        gone = set()
        for k in range(len(at) - 48):
            if first.setdefault(tuple(w for w, _ in at[k : k + 49]), (i, at[k][1])) != (i, at[k][1]):
                gone.update(range(k, k + 49))
        want[i] = [w for k, (w, _) in enumerate(at) if k not in gone]
    got = {r["doc_id"]: r for r in substring.dedup_paragraphs(documents(spark, rows), min_words=500).collect()}
    texts = dict(rows)
    assert {i: r["kept_text"].split() for i, r in got.items()} == want
    assert all(r["removed_chars"] == r["n_cut"] == len(texts[i] or "") - len(r["kept_text"]) for i, r in got.items())
    assert want[1] == ["no"] * 0 + ["yes"] and len(want[39]) == 70 and {i for i, r in got.items() if r["n_first"]} == {0, 11, 12, 13, 14}


def test_words_of_many_texts_at_once(monkeypatch):
    """Texts are hashed together, with the results of each text by itself."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["", "\n", "a b\n" * 80, " x" * 48, " x" * 49, *("\n".join(" ".join(rng.choice(list("ABcd"), rng.integers(0, 60))) for _ in range(rng.integers(1, 8))) for _ in range(200))]
    calls = []
    monkeypatch.setattr(substring, "word_hashes", lambda data: calls.append(len(data)) or neardup.word_hashes(data))
    got = list(substring.together(pa.array(texts)))
    assert len(calls) == len(got) == 1
    monkeypatch.setattr(substring, "TOGETHER", 1000)
    for k, h, words, lines, line0 in got + list(substring.together(pa.array(texts))):
        g = neardup.shingle_hashes(h)
        starts = substring.block_starts(g, words)
        for j in range(len(line0)):
            own = neardup.word_hashes(neardup.lowered(texts[k + j]))[0]
            assert np.array_equal(h[words[j] : words[j + 1]], own)
            at = lines[line0[j] : [*line0[1:], len(lines) - 1][j] + 1]
            assert np.diff(at).tolist() == [len(x.split()) for x in texts[k + j].split("\n")]
            own = neardup.shingle_hashes(own)
            x, y = substring.block_starts(own), starts[(starts >= words[j]) & (starts < words[j + 1])]
            assert np.array_equal(x, y - words[j]) and np.array_equal(substring.runs(own, x, substring.BLOCK), substring.runs(g, y, substring.BLOCK))


def test_distinct_sets():
    low = np.array([5, 3, 5, 4, 7, 7, 2**63, 2**63 + 1], np.uint64)  # grams that differ in low bits only
    grams, starts = neardup.distinct_sets(low, np.array([0, 4, 6]))
    assert grams.tolist() == [3, 4, 5, 7, 2**63, 2**63 + 1] and starts.tolist() == [0, 3, 4]
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**64, 1 + 97 * k, np.uint64)) for k in range(40)]
    grams, starts = neardup.distinct_sets(np.concatenate([x[::-1] for x in sets]), np.cumsum([0, *map(len, sets[:-1])]))
    assert np.array_equal(grams, np.concatenate(sets))
    assert [x.tobytes() for x in neardup.sketches(grams, starts)] == [neardup.sketch(x) for x in sets]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    rows = []
    for k in range(200):
        v = base[k % 40] + rng.standard_normal(64) * [0, 0.1, 0.25, 0.35, 0.5][k // 40]
        rows.append((k, [float(x) for x in v], k % 2 if k % 40 > 3 else 0))
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [1.0, None], 1), (904, rows[0][1], None), (905, rows[0][1], rows[0][2]), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [], 1)]
    rows += odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit(1))
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    near = {i: {j for j in units if j != i and label[i] == label[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93} if i in units else set() for i in label}

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(df).collect()}
    assert got == {i: (len(near[i]), least(i), least(i) == i) for i in label}


def test_lattice_recall():
    rng = np.random.default_rng(0)
    a, n = rng.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    x, y = lattice.cells(a).reshape(2000, -1), lattice.cells(0.93 * a + np.sqrt(1 - 0.93**2) * n).reshape(2000, -1)
    assert np.mean([np.intersect1d(p, q).size > 0 for p, q in zip(x, y)]) >= 0.98


def quality_brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_quality(spark):
    rows = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [t for _, t in ODD] + ["a b \x1c c", "x\n\nx\n y\n y", "a b c d e a b c d e f", "a a a a a a"]
    for t in rows:
        assert quality.measure(t or "")[0] == quality_brute(t)
    d = documents(spark, [(i, BASE if i % 3 else "%% && " * 20 + f"{i}") for i in range(60)] + [(None, None)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, quality int")
    judged = quality.judge(d, labels)
    assert judged.columns[: len(d.columns)] == d.columns
    assert all(r["kept"] for r in judged.filter("doc_id % 3 > 0").collect())


def test_quality_certifies_every_stratum(spark):
    rows = [(i, ["en", "de", "fr", None][i % 4], " ".join(f"w{i}x{j}" for j in range(30)) + " " + "%&" * (15 if i % 16 < 4 else 0) + "!" * (40 if 4 <= i % 16 < 8 else 0)) for i in range(3200)]
    bad = {i for i, *_ in rows if i % 16 < 8}
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, *_ in rows], "doc_id long, quality int")
    judged = quality.judge(d, labels).collect()
    assert not any(r["base_failed"] for r in judged)
    assert {r["doc_id"] for r in judged if not r["kept"]} == bad
    # Rules are certified together: none of a stratum with too few good documents, and no rule after one that fails.
    few = spark.createDataFrame([(i, "en", i % 2, [199 if i < 100 else 0] + [0] * 5) for i in range(250)], "doc_id long, lang string, half int, __bins array<int>")
    assert quality.thresholds(few, labels.select("doc_id", F.expr("int(doc_id >= 100)").alias("quality"))).count() == 0
    split = [(i, "en", i % 2, [199 if i < 300 else 0, 199 if i < 200 or i % 2 and i % 10 == 9 else 0, 199 if i < 100 else 0, 0, 0, 0]) for i in range(1300)]
    split = spark.createDataFrame(split, "doc_id long, lang string, half int, __bins array<int>")
    cuts = quality.thresholds(split, labels.select("doc_id", F.expr("int(doc_id >= 300)").alias("quality"))).collect()
    assert [r["cutoffs"] for r in cuts] == [{0: 198}]


def test_exact_tail():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (200, 9, 0.03)):
        assert quality.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    good, bad = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    good[:10], bad[100:] = 1000, 50
    assert 9 <= quality.choose(good, bad, good, 24) < 100
    assert quality.choose(good, bad, good // 1000, 24) is None  # too few to certify


def suffix_brute(rows, window):
    count = Counter(b[k : k + window] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [256, 1])
def test_suffix(spark, monkeypatch, small):
    monkeypatch.setattr(suffix, "SMALL", small)
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"é{x}" for x in rng.integers(0, 99999, n))
    shared, rows = word(60), list(ODD)
    for k in range(20):
        cut = rng.integers(0, len(shared) // 2)
        rows.append((100 + k, word(rng.integers(1, 60)) + shared[cut : cut + int(rng.integers(100, 500))] + word(20)))
    rows += [(200, "xy" * 900), (201, "z" * 2000 + shared), (202, shared * 2)]
    out = suffix.dedup_bytes(documents(spark, rows), window=200, anchor=32)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == suffix_brute(rows, 200)
