"""Quality rules with risk-controlled thresholds (operator 9).

Each rule is a score from 0 to 1 of a document (higher is worse) and rejects
above a cutoff. Cutoffs are chosen per stratum (language) and rule from the
labelled documents, split into two halves by a hash of the text, so that
copies fall into one half:

* the tuning half picks for each rule the cutoff that catches the most bad
  documents, each good one caught counting COST bad ones (ties: the higher
  cutoff), and puts the stratum's rules in order, most gained first (ties: the
  rule's number);
* the other half certifies the first rule, the first two together and so on, up
  to all: if good documents were rejected by any of them at a rate of ALPHA or
  more, so few rejections among that many would have, by the exact binomial
  tail, a chance of at most DELTA / strata (Bonferroni). The first failure ends
  it: that rule and the later ones are not used.

More rules reject no fewer documents, so a stratum errs only where the first
set of too high a rate is certified. So with confidence 1 - DELTA, in every
stratum all rules in use together reject at most ALPHA of the good documents.
All labels count; histograms are made by Spark and hold BINS numbers per
stratum and rule, and one per stratum and rule of the certifying half.

Cases: null text has no words; labels without a quality are ignored, and of
several for one id the lowest counts; a null stratum is a stratum; repeated
rows get one verdict each; without labels only the base rules reject; an empty
table gives no rows; ``judge`` keeps all columns of its input, whatever their
names, but for those that it adds (n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words, base_failed, kept).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import GOLD, begin, give_back, of_row, read, table, temporary, whole, word_hashes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbols", "shouting", "dup_lines", "repeats", "few_distinct", "bars"]
BLANKS, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
ALPHA, DELTA, COST, BINS = 0.03, 0.05, 20, 200


def repeated_words(h: np.ndarray) -> int:
    """Words in five-word windows that occur twice or more; h: the words' hashes."""
    if len(h) <= WINDOW:
        return 0
    n = len(h) - WINDOW + 1
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w = w * GOLD + h[i : n + i]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the rules' scores of a text."""
    data = text.encode("utf-8", "surrogatepass")
    h, _, _ = word_hashes(data)
    n = len(h)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(h)
    marks = text.count("!")
    scores = [
        symbols / (symbols + n) if n else 0.0,
        marks / (marks + n) if n else 0.0,
        dups / len(lines) if lines else 0.0,
        repeats / n if n else 0.0,
        1 - len(np.unique(h)) / n if n else 0.0,
        text.count("|") / n if n else 0.0,
    ]
    return [n, chars, symbols, dups, repeats], [min(s, 1.0) for s in scores]


def measured(df: DataFrame, text: Column) -> DataFrame:
    """df with a struct m of the text's base counts, and its scores as bins (0 to BINS - 1); texts don't come back from Python."""

    def run(texts: pa.Array) -> pa.Array:
        begin("quality")
        base, bins = [], []
        for t in texts:
            x, y = measure(t.as_py() or "")
            base.append(x)
            bins.append([min(int(s * BINS), BINS - 1) for s in y])
        cols = np.array(base, np.int64).reshape(-1, len(BASE)).T
        out = pa.StructArray.from_arrays([*(pa.array(c) for c in cols), pa.array(bins, pa.list_(pa.int32()))], [*BASE, "__bins"])
        del base, bins, cols
        give_back()
        return out

    # Not deterministic for the optimiser, which would copy the call into filters on what it gives.
    call = F.arrow_udf(run, f"struct<{', '.join(f'{c}: long' for c in BASE)}, __bins: array<int>>").asNondeterministic()
    return df.withColumn("m", call(text))


def tail(k: int, n: int, p: float) -> float:
    """The chance of at most k of n at rate p, exactly."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)))]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return min(1.0, float(np.exp(logs - top).sum()) * math.exp(top))


def tuned(good: np.ndarray, bad: np.ndarray) -> tuple[int, int] | None:
    """The cutoff bin (reject above it) and its gain, or None. Histograms by bin."""
    above = lambda h: h.sum() - np.cumsum(h)
    gain = above(bad) - COST * above(good)
    if gain.max() <= 0:
        return None
    return int(np.flatnonzero(gain == gain.max())[-1]), int(gain.max())


def certified(k: int, n: int, tests: int, alpha: float = ALPHA, delta: float = DELTA) -> bool:
    """Whether k rejections of n good documents show a rate under alpha; tests: how many are made at once."""
    return tail(k, n, alpha) <= delta / tests


def choose(good: np.ndarray, bad: np.ndarray, held_good: np.ndarray, tests: int, alpha: float = ALPHA, delta: float = DELTA) -> int | None:
    """The cutoff bin of one rule alone, or None where it isn't certified."""
    cut = tuned(good, bad)
    k = cut and int(held_good[cut[0] + 1 :].sum())
    return cut[0] if cut and certified(k, int(held_good.sum()), tests, alpha, delta) else None


def thresholds(measured_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, cutoffs: map of rule number to cutoff bin, per stratum with certified rules."""
    q = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = table(measured_docs.select("doc_id", "lang", "half", "__bins").join(q, "doc_id"), "labelled")
    tests = known.select("lang").distinct().count()
    each = known.filter("half = 0").select("lang", "quality", F.posexplode("__bins").alias("rule", "bin"))
    hist = each.groupBy("lang", "rule", "bin").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((len(RULES), 2, BINS), np.int64)
        for rule, b, g, d in zip(rows.rule, rows.bin, rows.good, rows.bad, strict=True):
            h[rule, :, b] += (g, d)
        cuts = [(rule, *cut) for rule in range(len(RULES)) if (cut := tuned(*h[rule]))]
        cuts.sort(key=lambda c: (-c[2], c[0]))
        return pd.DataFrame({"lang": rows.lang[:1], "rules": [[c[0] for c in cuts]], "cuts": [[c[1] for c in cuts]]})[: min(len(cuts), 1)]

    picked = table(hist.groupBy("lang").applyInPandas(pick, "lang string, rules array<int>, cuts array<int>"), "picked")
    # place: the first rule in order that rejects a good document of the other half; -1: none does.
    c = picked.withColumnRenamed("lang", "__lang")
    place = F.expr("array_position(transform(rules, (r, i) -> __bins[r] > cuts[i]), true) - 1").alias("place")
    held = known.filter("half = 1 and quality > 0").join(c, known["lang"].eqNullSafe(c["__lang"])).select("lang", "rules", "cuts", place)
    held = held.groupBy("lang", "rules", "cuts", "place").agg(F.count("*").alias("n"))

    def certify(rows: pd.DataFrame) -> pd.DataFrame:
        rules, cuts = list(rows.rules.iloc[0]), list(rows.cuts.iloc[0])
        n, k, used = int(rows.n.sum()), 0, 0
        for i in range(len(rules)):
            k += int(rows.n[rows.place == i].sum())
            if not certified(k, n, tests):
                break
            used = i + 1
        return pd.DataFrame({"lang": rows.lang.iloc[0], "rule": rules[:used], "cutoff": cuts[:used]})

    cuts = held.groupBy("lang").applyInPandas(certify, "lang string, rule int, cutoff int")
    return cuts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"


def verdicts(m: DataFrame, cuts: DataFrame) -> DataFrame:
    """m (lang, base counts, __bins and others) with base_failed and kept."""
    c = cuts.withColumnRenamed("lang", "__lang")
    out = m.join(c, m["lang"].eqNullSafe(c["__lang"]), "left").drop("__lang")
    above = F.expr("exists(sequence(0, size(__bins) - 1), i -> coalesce(__bins[i] > cutoffs[i], false))")
    return out.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(above, F.lit(False))).drop("cutoffs")


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, lang, half and what is measured of every row, as a table."""
    m = measured(docs.select("doc_id", "lang", "text"), F.col("text"))
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(9)), F.lit(2)).cast("int")
    return table(m.select("doc_id", "lang", half.alias("half"), "m.*"), "measured")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of docs with the base counts, base_failed and kept."""
    with temporary() as keep:
        cuts = keep(table(thresholds(slim(docs), labels), "cutoffs"))
    m = measured(whole(docs, lang=F.col("lang")), F.col("row.text")).select("row", "lang", "m.*")
    return verdicts(m, cuts).select(*of_row(docs), *BASE, "base_failed", "kept")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    with temporary() as keep:
        m = keep(slim(read(spark, sf_dir, "documents")))
        cuts = keep(table(thresholds(m, read(spark, sf_dir, "labels").select("doc_id", "quality")), "cutoffs"))
    return verdicts(m, cuts).select("doc_id", *BASE, "base_failed", "kept")
