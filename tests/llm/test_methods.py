"""Methods against plain versions: unigram models, exact joins, paragraphs, detections, thresholds."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA  # noqa: E402
from test_operators import LONG, jaccard_brute, suffix_brute  # noqa: E402

from quern.llm import jaccard, license_scan, neardup, quality, sentencepieces, substring, suffix  # noqa: E402
from quern.llm.common import freeing, read  # noqa: E402


def test_unigram_model(tmp_path):
    """A model made by hand: pieces with scores, an unknown piece, byte fallback or none."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    words = ["▁the", "▁cat", "▁", "the", "cat", "at", "▁sat", "s", "t", "h", "e", "c", "a", "▁th", "ca", "é", "▁c", "on", "o", "n"]
    for fallback in (False, True):
        m = sentencepiece_model_pb2.ModelProto()
        m.trainer_spec.model_type, m.trainer_spec.unk_id, m.trainer_spec.byte_fallback = 1, 0, fallback
        m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.escape_whitespaces = m.normalizer_spec.remove_extra_whitespaces = True
        m.normalizer_spec.name = "identity"
        for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{i:02X}>", 6) for i in range(256 * fallback))):
            m.pieces.add(piece=piece, score=0.0, type=kind)
        for k, piece in enumerate(words):
            m.pieces.add(piece=piece, score=-1.0 - 0.37 * k, type=1)
        path = str(tmp_path / f"{fallback}.model")
        with open(path, "wb") as f:
            f.write(m.SerializeToString())
        c = sentencepieces.Codec(path, one_in=1)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = ["the cat sat on the cat", "  the   cats ", "thecat at", "é", "s", "cat\tsat", "a x b", "xyz", "日本 the"]
        ids, parity = c.encode(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == sp.encode(texts), fallback
        assert all(parity)


def test_parity_flags_a_wrong_rebuild():
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    c = sentencepieces.Codec(path, one_in=1)
    c.sp = type("Other", (), {"encode": lambda self, texts, **k: [[5]] * len(texts), "piece_to_id": lambda self, p: 5})()
    assert c.encode(["some text", ""])[1] == [False, True]


def test_every_chunk_is_checked_and_decoded():
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    texts = [f"word{k}" for k in range(64)] + ["two  blanks", " a", "▁a", "", "日本 ☃ 𝔘", "a\n▁ b"]
    c = sentencepieces.Codec(path)
    ids, parity = c.encode(texts)
    assert all(parity) and c.decodes(texts, ids) == [x == y for x, y in zip(c.decode(ids), texts)] and not c.lost
    # One wrong id in any chunk shows, in its texts only.
    c = sentencepieces.Codec(path)
    c.sp = type("Other", (), {"encode": lambda self, texts, **k: [[5]] * len(texts), "piece_to_id": lambda self, p: 5})()
    assert c.encode(texts)[1] == [not t for t in texts]
    # Chunks that don't come back: the texts that hold them are decoded as a whole.
    c = sentencepieces.Codec(path)
    right = c.tok
    c.tok = type("Lossy", (), {"encode_batch_fast": right.encode_batch_fast, "decode_batch": lambda self, ids, **k: [t.replace("word7", "w") for t in right.decode_batch(ids, **k)]})()
    ids, _ = c.encode(texts)
    assert c.decodes(texts, ids) == [x == y for x, y in zip(c.decode(ids), texts)] and len(c.lost) == 1


def test_exact_jaccard(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        w = LONG.split()
        for at in rng.choice(300, k // 3, replace=False):
            w[at] = f"y{k}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for exact in (False, True):
        got = jaccard.classes(d, exact).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == jaccard_brute(rows)


def test_paragraphs_against_all_pairs(spark):
    """Whole lines: components of exact similarity over all pairs of lines; the first of each stays."""
    docs = sorted((r["doc_id"], r["text"]) for r in read(spark, DATA, "documents").collect())
    at, sets = [], []
    for i, t in docs:
        for n, line in enumerate(t.split("\n")):
            w = line.lower().split() if line.isascii() else line.encode().lower().split()
            if len(w) >= substring.MIN_WORDS:
                at.append((i, n))
                sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    held, root = {}, list(range(len(at)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in held.get(g, ())).items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
        for g in s:
            held.setdefault(g, []).append(k)
    want = {at[k] for k in range(len(at)) if find(k) != k}
    out = substring.dedup_paragraphs(read(spark, DATA, "documents")).collect()
    got = {(r["doc_id"], n) for r in out for n in r["removed"]}
    assert got == want and len(want) > 20
    texts = dict(docs)
    for r in out:
        assert r["removed_chars"] == len(texts[r["doc_id"]]) - len(r["kept_text"]) and (r["removed_chars"] > 0) == bool(r["removed"] or r["n_cut"])
    # No 49 words of a line that stays are in another line that stays.
    seen = Counter()
    for r in out:
        for line in r["kept_text"].split("\n"):
            w = line.encode().lower().split()
            seen.update({tuple(w[k : k + 49]) for k in range(len(w) - 48)})
    assert max(seen.values(), default=1) == 1


def detections_brute(text):
    """labels and score, each rule run on every text, each detection against each other."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    joined = " ".join(ws)
    found = [(m.start(), -m.end(), p, n, label) for n, p, _, label, x in license_scan.rules() for m in re.finditer(f"(?<![^ ]){x}(?![^ ])", joined)]
    found.sort()
    kept = []
    for k, (s, e, p, _, label) in enumerate(found):
        inside = any(q <= p and -f >= -e for _, f, q, *_ in found[:k])
        beaten = any(q < p and (-f > s if j < k else t < -e) for j, (t, f, q, *_) in enumerate(found) if j != k)
        if not inside and not beaten:
            kept.append((s, -e, label))
    covered = len({i for s, e, _ in kept for i in range(s, e)})
    base = {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in f" {joined} "}
    return ",".join(sorted(base | {label for *_, label in kept})), min(1.0, round(covered / (4 * len(ws)), 6)) if kept else 0.0


def test_detections(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (the License)", "MIT license or the GNU General Public License version 3; see the LICENSE file for details", "CC BY-NC-SA 4.0, CC BY 4.0", "licensed under the mit license and the mit license",
             "SPDX-License-Identifier: GPL-2.0-or-later", "all rights reserved copyright 2020 proprietary and confidential", "creative commons attribution noncommercial sharealike 3 0", ""]
    rows = list(enumerate(texts)) + [(100 + r["doc_id"], r["text"]) for r in read(spark, DATA, "documents").collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(d).collect()}
    assert got == {i: detections_brute(t) for i, t in rows}


def test_thresholds_on_the_labels(spark):
    """Every stratum of sf0.1 gets certified rules, and what they keep is what plain Python keeps."""
    where = DATA.replace("0.001", "0.1")
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in read(spark, where, "documents").collect()]
    label = {r["doc_id"]: r["quality"] for r in read(spark, where, "labels").collect()}
    m = quality.slim(read(spark, where, "documents"))
    half = {r["doc_id"]: r["half"] for r in m.select("doc_id", "half").collect()}
    known = {}
    for i, lang, t in docs:
        base, scores = quality.measure(t)
        known[i] = (lang, base, [min(int(s * quality.BINS), quality.BINS - 1) for s in scores])
    langs = {lang for lang, *_ in known.values()}
    cuts = {}
    for lang in langs:
        own = [(i, known[i][2]) for i in label if i in known and known[i][0] == lang]
        picked = []
        for rule in range(len(quality.RULES)):
            tune = [(b[rule], label[i]) for i, b in own if half[i] == 0]
            best = max(((sum(1 if not q else -quality.COST for b, q in tune if b > c), c) for c in range(quality.BINS)))
            if best[0] > 0:
                picked.append((-best[0], rule, best[1]))
        held = [b for i, b in own if half[i] == 1 and label[i]]
        used = []
        for _, rule, c in sorted(picked):
            tried = [*used, (rule, c)]
            k = sum(any(b[x] > y for x, y in tried) for b in held)
            if quality.tail(k, len(held), quality.ALPHA) > quality.DELTA / len(langs):
                break
            used = tried
        cuts[lang] = dict(used)
    found = quality.thresholds(m, read(spark, where, "labels"))
    assert {r["lang"]: r["cutoffs"] for r in found.collect()} == cuts and all(cuts.values())
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(m, found).collect()}
    failed = lambda b: b[0] < 10 or 100 * b[4] > 20 * b[0]
    assert kept == {i: not failed(b) and not any(bins[x] > y for x, y in cuts[lang].items()) for i, (lang, b, bins) in known.items()}
    bad = [i for i, q in label.items() if not q and not failed(known[i][1])]
    good = [i for i, q in label.items() if q and not failed(known[i][1])]
    assert sum(not kept[i] for i in bad) > 0.9 * len(bad) and sum(not kept[i] for i in good) <= quality.ALPHA * len(good)


def test_workers_give_freed_memory_back():
    def held() -> float:
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    pins = []

    def task(batches):
        for n in batches:
            blocks = [bytes(3000) for _ in range(n)]
            pins.extend(blocks[::100])  # what stays between freed blocks keeps malloc from shrinking its heap by itself
            yield len(blocks)

    before = held()
    assert list(freeing(task)([60_000, 10])) == [60_000, 10]
    assert held() - before < 60  # of 180


def test_passages_under_400_bytes_are_counted(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x:04}" for x in rng.integers(0, 9999, n))
    short, few, long = word(53), "longerthanmost " * 20, word(90)  # 317 bytes, 20 words of 299 bytes, 539 bytes
    rows = [(1, f"{word(30)} {short} {word(30)}"), (2, f"{word(9)} {short} {word(40)}"), (3, word(120)), (4, None), (5, word(3))]
    rows += [(6, f"{word(20)} a{few}b {word(20)}"), (7, f"{word(20)} c{few}d {word(20)}"), (8, f"{long} {word(20)}"), (9, f"{word(20)} {long}"), (None, short), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix.dedup_bytes(docs, passages=(256, 50)).select("doc_id", "repeats", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(((r[0], *r[2:]) for r in out), key=str) == suffix_brute(rows, 400)
    assert {r[0] for r in out if r[1]} == {1, 2, 8, 9, None}
    assert all(r[1] == 0 for r in out if r[0] in (3, 4, 5, 6, 7))
    assert {r[0]: r[1] for r in out}[None] == 317
    assert suffix.dedup_bytes(docs.limit(0), passages=(256, 50)).count() == 0


def test_windows_in_stretches_of_shorter_strings(spark):
    """Repeats of 399 to 401 bytes, one that two others cover only together, one in a text twice, and copies of a row."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(chr(x) for x in rng.integers(97, 123, n))
    a, b, c = word(900), word(399), word(700)
    rows = [(1, word(50) + a[:399] + word(50)), (2, word(70) + a[:401] + word(9)), (3, a[1:401]), (4, b), (5, word(30) + b + word(30)), (6, c), (6, c), (7, c[:300] + "é" + c[300:])]
    rows += [(8, word(10) + a[200:700] + word(5)), (9, a[450:] + word(20)), (10, word(300) + a[:700]), (11, c[100:600] + word(300) + c[100:600]), (None, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix.dedup_bytes(docs, passages=(256, 50)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, out), key=str) == suffix_brute(rows, 400)
    d = suffix.bytes_of(docs)
    short = suffix._cuts(suffix.repeated_spans(d, 256, 64)).withColumnRenamed("cut", "short").cache()
    found = suffix._stretches(d, short, 256, 400).select("doc_id", F.length("data")).collect()
    assert all(n >= 400 for _, n in found) and {i for i, _ in found} >= {2, 3, 6, 8, 10, 11} and not {i for i, _ in found} & {1, 4, 5, 9, 12, None}


def test_runs_of_many_texts_are_one_batch():
    class Frame:
        def mapInArrow(self, f, _):  # noqa: N802
            self.f = f

    texts = [bytes([65 + k % 26, 66 + k % 7]) * 300 for k in range(300)] + [b"", b"short"]
    d = Frame()
    suffix.run_rows(d, 400, 64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array(range(302)), pa.array(texts, pa.binary())], ["doc_id", "th", "data"])
    got = list(d.f([batch]))
    assert len(got) == 1 and set(got[0].column("doc_id").to_pylist()) == set(range(300))
    for k in (0, 299):
        rows = pa.Table.from_batches(got).filter(pa.array(np.array(got[0].column("doc_id")) == k))
        assert all(np.array_equal(rows.column(c).to_numpy(), x) for c, x in zip(["v", "hs", "a", "p1", "p2"], suffix.runs(texts[k]), strict=True))


def test_components_end_when_all_are_stars(spark, monkeypatch):
    made, table = [], neardup.table
    monkeypatch.setattr(neardup, "table", lambda df, name="t", scratch=True: made.append(name) or table(df, name, scratch))
    of = lambda edges: dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert of([(3, 1), (1, 4), (9, 7), (9, 7)]) == {1: 1, 3: 1, 4: 1, 7: 7, 9: 7}
    assert made == ["edges"]  # no round
    assert of([(k, k + 1) for k in range(40)] + [(50, 52), (51, 52), (53, 51)]) == dict.fromkeys(range(41), 0) | dict.fromkeys(range(50, 54), 50)
    assert of([]) == {}


def test_sets_across_components_are_read_once(spark, monkeypatch):
    """Chains of texts that share signatures without being alike: the sets compared at the end are those made for their bits."""
    made, table = [], neardup.table
    monkeypatch.setattr(neardup, "table", lambda df, name="t", scratch=True: made.append(name) or table(df, name, scratch))
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 90])) for k in range(10)] + [(20, " ".join(base)), (21, None)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == jaccard_brute(rows)
    assert made.count("grams") == 2 and made.count("links") == 2
