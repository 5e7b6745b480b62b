"""A corpus pipeline: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. A stage first deletes the scratch tables
of the one before, so run one pipeline at a time in a session. All but the last return the columns
of documents; texts that a stage rewrites have their n_chars set anew.

Cases, in every stage: a null text is empty (the base rules reject it; where it stays, it stays
null); a null id is an id like any other; rows that repeat id and text are one document, of which the
third stage keeps one row and the others all; ties are broken by (doc_id, text hash); an empty table
gives an empty one; other columns come through whatever their names, but those that the stage's
operator adds (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
n_removed, n_spans, kept_text, n_bytes).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard, line_dedup, packing, quality, suffix
from quern.llm.common import drop, made, of_row, read, table, whole


#: Bytes of the shortest passage that the fourth stage removes: 50 words are rarely shorter
#: (of those that repeat in the test data 4 in 100 are; 47 in 100 are shorter than 400 bytes).
PASSAGE = 256


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a certified threshold rejects go."""
    judged = quality.judge(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.filter("kept").select(*_columns(docs))


def _rewritten(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so do documents of which nothing is left."""
    out = line_dedup.dedup_lines(docs).filter("n_removed = 0 or length(trim(kept_text)) > 0")
    return _rewritten(out, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))).select(*_columns(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least (doc_id, text hash) stays."""
    stays = jaccard.classes(docs).filter("first").select(F.col("doc_id").alias("at_doc"), F.col("th").alias("at_th")).distinct()
    d = whole(docs, doc_id=F.col("doc_id"), th=F.xxhash64(F.coalesce("text", F.lit(""))))
    # Rows that repeat id and text are one document: one row of them stays.
    kept = d.join(stays, d["doc_id"].eqNullSafe(stays["at_doc"]) & (d["th"] == stays["at_th"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "th"]).select(*of_row(docs))


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of PASSAGE bytes go; a character cut in two goes with them, and so do documents of which nothing is left."""
    out = suffix.dedup_bytes(docs, window=PASSAGE, as_text=True).filter("n_removed = 0 or length(trim(kept)) > 0")
    return _rewritten(out, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).select(*_columns(docs))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a packed sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


_left: list[str] = []


def _alone(f: Callable) -> Callable:
    """The stage, which first deletes the scratch tables that the stage before it has left."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(_left)
        before = set(made())
        out = f(spark, docs, sf_dir)
        _left[:] = [p for p in made() if p not in before]
        return out

    return run_stage


STAGES = [
    ("quality rules", _alone(quality_rules)),
    ("line dedup", _alone(line_windows)),
    ("n-gram Jaccard join", _alone(ngram_jaccard)),
    ("suffix-array dedup", _alone(suffix_array)),
    ("best-fit packing", _alone(best_fit)),
]

#: Tokens, exact binomial thresholds and bytes aren't SQL's: tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "stage")
        drop(old)
        old = [docs._path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(old)  # the pieces are a table by now
    return out
