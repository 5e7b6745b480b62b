"""The stages in order, each held against brute force on its own input."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA  # noqa: E402
from test_operators import jaccard_brute, quality_brute, suffix_brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from quern.llm.common import read, table  # noqa: E402


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made.append(table(stage(spark, made[-1], DATA), "test", scratch=False))
        assert made[-1].columns == docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, made[-1], DATA).collect()
    first, good, lines, near, rest = [rows(d) for d in made]
    base = lambda t: (lambda n, *_, rep: n < 10 or 100 * rep > 20 * n)(*quality_brute(t)[:4], rep=quality_brute(t)[4])
    assert set(good) <= {x for x in first if not base(x[1])}
    bad = {r["doc_id"] for r in read(spark, DATA, "labels").filter("quality = 0").collect()}
    assert {i for i, t in first if not base(t)} - {i for i, _ in good} <= bad
    # Every distinct line of the good documents is still somewhere.
    assert {x for _, t in good for x in t.split("\n") if x.strip()} == {x for _, t in lines for x in t.split("\n") if x.strip()}
    assert sorted(i for i, _ in near) == sorted({c for *_, c in jaccard_brute(lines)})
    kept = {i: n - gone for i, n, gone, *_ in suffix_brute(near, corpus_pipeline.PASSAGE)}
    left = {i: len(t.encode()) for i, t in rest}
    assert all(kept[i] - 6 * 50 <= n <= kept[i] for i, n in left.items())
    assert {i for i, n in kept.items() if n > 0} >= set(left)
    assert {r["doc_id"] for r in packed} == set(left)
