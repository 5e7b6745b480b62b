"""N-gram Jaccard join (operator 5) by PartEnum signatures.

A document's set is its distinct five-word shingles. All sets are brought to
one size first: a sketch of 80 min-hash coordinates, each a feature (coordinate,
value), so every set lies in one size band. PartEnum deals these features to 10
first-level partitions of 4 second-level ones and enumerates the 2-of-4 subsets:
60 signatures a document, whatever its length. (On shingles themselves PartEnum
needs more signatures than differing shingles, a third of the words of every
text: more rows than the text has bytes to spare.) Two sets of similarity 0.75
share no signature with a chance of 3e-7, of 0.8 with 2e-9. Candidates are then
verified on the whole shingle sets, by 100 * both >= 75 * either; those whose sketches
rule that out (a similar pair is lost by it with a chance of under 1e-6) aren't, unless
``exact`` asks for all.

Cases: null and empty texts have an empty set and link with nothing; fewer than
five words are one shingle; equal sets are one node, so copies cost nothing;
rows that repeat an id are separate rows of the result, joined by their sets;
a component's id is its least doc_id (nulls aside); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import begin, freeing, keyed, read, table, temporary
from quern.llm.neardup import part_enum, shingles, similar, sketch, texts_at


def features(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, sid (128-bit hash of the set, null if empty), sketch."""

    @freeing
    def run(batches):
        begin("jaccard")
        for b in batches:
            n, sid, sk = [], [], []
            for t in b.column("text"):
                g = shingles(t.as_py())
                n.append(len(g))
                sid.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                sk.append(sketch(g) if len(g) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(sk, pa.binary())], ["doc_id", "th", "n_shingles", "sid", "sketch"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, sid binary, sketch binary")


@freeing
def _grams(batches):
    for b in batches:
        grams = [shingles(t.as_py()).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(grams, pa.binary())], ["cid", "grams"])


def classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, th, n_shingles, component_id, first (this row's set has the component's least place). exact: see ``neardup.similar``."""
    with temporary() as keep:
        f = keep(table(features(docs), "features"))
        nodes = f.filter("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("place"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
        nodes = table(nodes.withColumn("cid", F.monotonically_increasing_id()), "nodes")

        def grams_of(ids: DataFrame) -> DataFrame:
            places = nodes.join(ids, "cid").select("cid", "place.doc_id", "place.th")
            return texts_at(keyed(docs), places).select("cid", "text").mapInArrow(_grams, "cid long, grams binary")

        root = similar(nodes, part_enum, grams_of, exact)
        known = nodes.join(root, "cid", "left").select("sid", "place", "least", F.coalesce("root", "cid").alias("root"))
        known = keep(table(known, "roots"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.min("place").alias("first"))
    named = known.join(least, "root").select("sid", "component_id", F.col("first").alias("head"))
    out = f.join(named, "sid", "left")
    own = F.struct("doc_id", "th").eqNullSafe(F.col("head"))
    return out.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("head").isNull() | own).alias("first"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON d.doc_id = r.a LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""
