"""Parts that queries alone don't show: clocks, cursors, connectors, nested text, the engine's journal and subscriptions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import text as tx
from quern.functions.predicates import compile_predicate
from quern.operators import replicated as r
from quern.operators import search as s
from quern.plans.query import QuerySpec, decode_search_cursor, encode_search_cursor, furthest
from quern.sources.tables import entries, load_jdbc, save


def test_clock_never_goes_back():
    rng = random.Random(3)
    clock, last = r.Clock("n", lambda: 1000 + rng.randrange(50)), (0, -1, "")
    for _ in range(500):
        if rng.random() < 0.4:
            clock.update(1000 + rng.randrange(80), rng.randrange(5))
        now = clock.now()
        assert now > last
        last = now
    full = r.Clock("n", lambda: 5, at=(5, 2**32 - 1))
    assert full.now() == (6, 0, "n")
    with pytest.raises(ValueError):
        r.Clock("n", lambda: 5, strict=True).update(5 + 60_001, 0)


def test_clock_text(spark):
    rows = [("5:7:node:a",), ("x",), ("5:7",), (None,)]
    got = [x["c"] for x in spark.createDataFrame(rows, "t string").select(r.parse_clock(F.col("t")).alias("c")).collect()]
    assert got == [(5, 7, "node:a"), None, None, None]


@pytest.mark.parametrize("how", ["OWNER_ONLY", "VERSION_INCREMENT"])
def test_folds_against_plain_python(spark, how):
    rng = random.Random(8)
    log = [(f"k{rng.randrange(6)}", i, rng.randrange(4), "n", f"v{i}", rng.choice(["a", "b", None]), rng.choice(["a", "b"]), rng.choice([None, 1, 2, 3])) for i in range(300)]
    log.append((None, 1, 0, "n", "null key", "a", "a", 1))
    rng.shuffle(log)
    df = spark.createDataFrame(log, "k string, millis long, counter long, node_id string, v string, owner string, author string, version int")
    want = {}
    for k, *_, v, owner, author, version in sorted(log, key=lambda x: x[1:4]):
        if how == "OWNER_ONLY":
            ok = k not in want or want[k][1] is None or author == want[k][1]
        else:
            ok = version == (want[k][2] if k in want else 0) + 1
        if ok:
            want[k] = (v, owner, version)
    got = r.resolve(df, "k", "v", how, r.clock(), owner="owner", author="author", version="version")
    assert {x["k"]: x["v"] for x in got.collect()} == {k: v for k, (v, *_) in want.items()}


def test_search_cursors():
    c = encode_search_cursor("red ring", 1.5, 7, 1000)
    assert decode_search_cursor(c, "red ring", 2000) == ((1.5, 7), "valid")
    assert [decode_search_cursor(x, q, t)[1] for x, q, t in ((None, "a", 0), (c, "other", 2000), (c, "red ring", 1000 + 300_001), ("garbled", "red ring", 0))] == ["none", "invalid", "expired", "invalid"]
    assert furthest([(2.0, 5), (1.5, 3), (1.5, 9)]) == (1.5, 9)


def test_pages_of_hits_make_the_whole_order(spark):
    rng = random.Random(2)
    hits = spark.createDataFrame([(i, float(rng.randrange(5))) for i in range(53)], "k long, score double")
    place, got = None, []
    while rows := s.search_page(hits, "k", 7, place).collect():
        got += [x["k"] for x in rows]
        place = (rows[-1]["score"], rows[-1]["k"])
    assert got == [x["k"] for x in hits.orderBy(F.desc("score"), "k").collect()]


def test_no_terms_and_no_documents(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, None), (3, "")], "k long, t string")
    assert s.bm25(df, "k", tx.words(F.col("t")), []).count() == 0
    assert s.bm25(df.filter("false"), "k", tx.words(F.col("t")), ["red"]).count() == 0
    assert [x["k"] for x in s.bm25(df, "k", tx.words(F.col("t")), ["red", "red"]).collect()] == [1]
    assert df.filter(compile_predicate({"op": "not", "children": [{"op": "match", "attribute": "t", "value": "red"}]})).count() == 2


def test_texts_are_tokenised_once(spark):
    df = spark.createDataFrame([(1, "red ring")], "k long, t string")
    plan = s.bm25(df, "k", tx.words(F.col("t")), ["red", "ring"], 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def test_all_text(spark):
    df = spark.createDataFrame([("a", ("b", 1, ["c", "d"]), 5)], "x string, y struct<p: string, q: int, r: array<string>>, z int")
    assert df.select(tx.all_text(df).alias("t")).first()["t"] == "a b c d"


def test_token_hash():
    assert tx.fnv1a64("") == 0xCBF29CE484222325 and tx.fnv1a64("a") == 0xAF63DC4C8601EC8C


def test_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([("The cat, the CAT",), ("cat the the cat",), ("...",), ("  ",), (None,)], "t string").select(tx.embedded(F.col("t"), 32).alias("e"))
    e = [x["e"] for x in df.collect()]
    assert e[0] == e[1] and e[4] is None and not any(e[3]) and max(e[2]) == 1.0
    assert np.linalg.norm(e[0]) == pytest.approx(1)


def test_jdbc_and_parquet(spark, tmp_path):
    """A database in the JVM's memory (Derby comes with Spark), read in ranges."""
    df = spark.range(100).select(F.col("id").alias("n"), (F.col("id") * 2).alias("m"))
    url = "jdbc:derby:memory:quern;create=true"
    df.write.format("jdbc").options(url=url, dbtable="numbers", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = load_jdbc(spark, url, "numbers", "n", 0, 100, 4)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("m")).first()[0] == 9900
    save(df, f"{tmp_path}/n", ["m"])
    assert spark.read.parquet(f"{tmp_path}/n").count() == 100


def test_entries(spark):
    got = entries(spark.createDataFrame([("a", 1), (None, 2)], "_key string, n int")).collect()
    assert got[0] == ("a", '{"n":1}') and got[1]["key"].startswith("row-")
    assert entries(spark.createDataFrame([("k", "v")], "__key string, _value string")).collect() == [("k", "v")]


def test_engine(spark, tmp_path):
    e = Engine(spark)
    e.register_map("log", spark.createDataFrame([(i, "PUT" if i % 2 else "DELETE", f"k{i}", i) for i in range(30)], "sequence long, type string, key string, value long"))
    rows, more = e.journal_read("log", 3, 5, "PUT")
    assert [x["sequence"] for x in rows] == [3, 5, 7, 9, 11] and more
    df = spark.createDataFrame([("a", "red ring", [1.0, 0.0]), ("b", "blue ring", [0.0, 1.0]), ("c", "red gear", [1.0, 0.1])], "_key string, t string, v array<double>")
    e.register_map("things", df)
    assert [x["_key"] for x in e.search("things", None, "blue").collect()] == ["b"]
    assert [x["_key"] for x in e.vector_search("things", "v", [1.0, 0.0], 2, predicate={"op": "neq", "attribute": "_key", "value": "a"}).collect()] == ["c", "b"]
    assert {x["_key"] for x in e.hybrid_search("things", {"op": "eq", "attribute": "_key", "value": "b"}, ("t", "red"), k=5).collect()} == {"a", "b", "c"}
    schema = "_key string, n int, millis long, counter long, node_id string, deleted boolean"
    for k, row in enumerate([("a", 5, 1, 0, "n", False), ("a", 1, 2, 0, "n", False)]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*")
        e.subscribe(stream, lambda st: st.filter("n > 3").select("_key", "n"), schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    events = [spark.read.parquet(f"{tmp_path}/out/events/{k}").collect() for k in range(2)]
    assert [(x[0]["_key"], x[0]["change"]) for x in events] == [("a", "ENTER"), ("a", "LEAVE")]
    assert e.frame("things", QuerySpec(limit=1)).count() == 1
