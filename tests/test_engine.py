import random

import pytest
from pyspark.sql import functions as F

from quern.engine import Engine, UnknownMap
from quern.functions import scalars
from quern.functions.predicates import compile_predicate
from quern.functions.text import stem
from quern.operators import replicated as r
from quern.plans.query import QuerySpec, aggregate, page
from quern.sources.tables import Field, MapSchema, conform, struct_of, violations
from quern.streaming.live import LiveQuery, top


def test_not_is_two_valued(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "n int")
    gt = {"op": "gt", "attribute": "n", "value": 1}
    assert df.filter(compile_predicate({"op": "not", "children": [gt]})).count() == 2
    assert df.filter(compile_predicate({"op": "neq", "attribute": "n", "value": 1})).count() == 1
    assert df.filter(compile_predicate({"op": "and", "children": []})).count() == 3
    assert df.filter(compile_predicate({"op": "or", "children": []})).count() == 0


def test_bare_leaves_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter(compile_predicate({"op": "gt", "attribute": "o_totalprice", "value": 1000.0})).select("o_orderkey")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in text and "o_orderdate" not in text


def test_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("", 3), ("x", 4)], "cat string, price long")
    got = {x["cat"]: (x["__count"], x["__sum_price"]) for x in aggregate(df, ["cat"], [("sum", "price")]).collect()}
    assert got == {None: (2, 3), "": (1, 3), "x": (1, 4)}


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_make_the_whole_order(spark, direction):
    rng = random.Random(4)
    df = spark.createDataFrame([(f"k{i:03}", rng.choice([None, 1, 2, 3])) for i in range(37)], "_key string, n int")
    spec, got = QuerySpec(sort=[("n", direction)], limit=5), []
    while True:
        p = page(df, spec, 1000)
        got += [x["_key"] for x in p.rows]
        if not p.has_more:
            break
        spec = QuerySpec(sort=spec.sort, limit=5, cursor=p.next_cursor)
    by = F.col("n").asc_nulls_last() if direction == "asc" else F.col("n").desc_nulls_last()
    assert got == [x["_key"] for x in df.orderBy(by, "_key").collect()]
    assert page(df, spec, 1000 + 600_001).cursor_status == "expired"
    assert page(df, QuerySpec(sort=[("_key", "asc")], limit=5, cursor=spec.cursor), 1000).cursor_status == "invalid"


def test_hash_and_partition(spark):
    df = spark.createDataFrame([("hello",), ("key1",), ("",)], "k string").select("k", scalars.fnv1a(F.col("k")).alias("h"), scalars.partition_id(F.col("k")).alias("p"))
    assert {x["k"]: (x["h"], x["p"]) for x in df.collect()} == {"hello": (1335831723, 95), "key1": (927623783, 268), "": (2166136261, 2166136261 % 271)}


def test_last_write_does_not_depend_on_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(0, 5), rng.randint(0, 3), f"n{i}", i) for i in range(60)]
    run = lambda x: sorted(r.last_write(spark.createDataFrame(x, "k string, millis long, counter long, node_id string, v long"), ["k"], ["v"]).collect())
    want = run(rows)
    rng.shuffle(rows)
    assert run(rows + rows[:20]) == want


def test_validation(spark):
    schema = MapSchema({"name": Field("string", required=True, min_length=2), "age": Field("int", max_value=100)}, strict=True)
    df = spark.createDataFrame([("Al", 5, 1), ("x", 500, 1), (None, None, 1)], "name string, age long, other int")
    got = [x[0] for x in df.select(violations(schema, df.columns)).collect()]
    assert got == [["other: unknown"], ["name: shorter than 2", "age: more than 100", "other: unknown"], ["name: required", "other: unknown"]]
    assert struct_of(schema).fieldNames() == ["_key", "name", "age"]
    assert conform(spark.createDataFrame([("Al", "abc")], "name string, age string"), schema).first()["age"] is None


def test_engine(spark):
    e = Engine(spark)
    e.register_map("items", spark.createDataFrame([("a", "electronics", "good phone"), ("b", "books", "phone book"), ("c", "books", "novel")], "_key string, category string, body string"))
    assert [x["_key"] for x in e.query("items", QuerySpec(where={"category": "books"})).rows] == ["b", "c"]
    assert [x["_key"] for x in e.search("items", {"body": 1.0}, "phone").collect()] == ["a", "b"]
    assert e.sql("select count(*) from items").first()[0] == 3
    fused = e.hybrid_search("items", {"op": "eq", "attribute": "category", "value": "books"}, ("body", "phone"))
    assert {x["_key"] for x in fused.collect()} == {"a", "b", "c"}
    e.allow("it*", F.col("category") == "books")
    assert e.count("items") == 2 and e.list_maps() == ["items"]
    with pytest.raises(UnknownMap):
        e.map("none")


def test_stems():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration hopefulness:hope formaliti:formal replacement:replac adoption:adopt controll:control rate:rate"
    assert {w: stem(w) for w in (p.split(":")[0] for p in pairs.split())} == dict(p.split(":") for p in pairs.split())


def test_live_stream(spark, tmp_path):
    schema = "_key string, n long, millis long, counter long, node_id string, deleted boolean"
    folder, source = f"file://{tmp_path}/live", f"{tmp_path}/in"
    batches = [[("a", 1, 1, 0, "x", False), ("b", 2, 1, 0, "x", False), ("d", 3, 1, 0, "x", False)], [("c", 0, 2, 0, "x", False)], [("c", 9, 1, 0, "x", False), ("a", None, 3, 0, "x", True)]]
    live = LiveQuery(spark, lambda s: top(s, "n", 2), schema, folder)
    events = []
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        live.start(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/cp").awaitTermination()
        events.append(sorted((x["_key"], x["change"]) for x in spark.read.parquet(f"{folder}/events/{i}").collect()))
    assert events == [[("a", "ENTER"), ("b", "ENTER")], [("b", "LEAVE"), ("c", "ENTER")], [("a", "LEAVE"), ("b", "ENTER")]]
