"""Queries over the driver's tables, one for each operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.functions import text as tx
from quern.functions.predicates import compile_predicate, where
from quern.operators import replicated as r
from quern.operators import search as s
from quern.plans.query import QuerySpec, after, aggregate, group_key, order, plan, project
from quern.sources.tables import inferred, load
from quern.streaming.live import changes, top

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def leaf(name: str, table: str, predicate: dict, condition: str, columns: str) -> None:
    """A query that filters a table by a predicate, shown by some columns."""
    cols = columns.split(", ")
    query(name, f"SELECT {columns} FROM {table} WHERE {condition}")(lambda spark, d: load(spark, d, table).filter(compile_predicate(predicate)).select(*cols))


def _p(op: str, attribute: str, value=None, **more) -> dict:
    return {"op": op, "attribute": attribute, "value": value, **more}


# ------------------------------------------------------------ predicates

leaf("f01_eq", "customer", _p("eq", "c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'", "c_custkey, c_name")
leaf("f02_neq", "orders", _p("neq", "o_orderstatus", "F"), "o_orderstatus <> 'F'", "o_orderkey, o_orderstatus")
leaf("f03_gt", "orders", _p("gt", "o_totalprice", 100000), "o_totalprice > 100000", "o_orderkey")
leaf("f04_gte", "part", _p("gte", "p_size", 40), "p_size >= 40", "p_partkey, p_size")
leaf("f05_lt", "supplier", _p("lt", "s_acctbal", 0), "s_acctbal < 0", "s_suppkey")
leaf("f06_lte", "lineitem", _p("lte", "l_quantity", 2), "l_quantity <= 2", "l_orderkey, l_linenumber, l_quantity")
leaf("f07_like", "part", _p("like", "p_type", "%An%"), "p_type ILIKE '%An%'", "p_partkey, p_type")
leaf("f08_regex", "customer", _p("regex", "c_name", "[13]7$"), "regexp_matches(c_name, '[13]7$')", "c_custkey, c_name")
leaf("f09_in", "nation", _p("in", "n_regionkey", [1, 3]), "n_regionkey IN (1, 3)", "n_nationkey, n_name")
leaf("f10_between", "part", _p("between", "p_size", [10, 20], to_inclusive=False), "p_size >= 10 AND p_size < 20", "p_partkey, p_size")
leaf("f15_starts_with", "customer", _p("startsWith", "c_mktsegment", "B"), "starts_with(c_mktsegment, 'B')", "c_custkey")
leaf("f16_ends_with", "customer", _p("endsWith", "c_mktsegment", "Y"), "ends_with(c_mktsegment, 'Y')", "c_custkey")
leaf("f17_and", "orders", {"op": "and", "children": [_p("gt", "o_totalprice", 50000), _p("eq", "o_orderstatus", "O")]}, "o_totalprice > 50000 AND o_orderstatus = 'O'", "o_orderkey")
leaf("f18_or", "orders", {"op": "or", "children": [_p("lt", "o_totalprice", 2000), _p("eq", "o_orderstatus", "P")]}, "o_totalprice < 2000 OR o_orderstatus = 'P'", "o_orderkey")
leaf("f20_text_contains", "documents", _p("textContains", "text", "LICENSE"), "contains(lower(text), 'license')", "doc_id")
leaf("f27_not_in", "events", _p("notIn", "event_type", ["click", "view"]), "event_type NOT IN ('click', 'view')", "event_id, event_type")


def nullable(spark, d):
    """Events whose type is null for errors."""
    return load(spark, d, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))


_NULLABLE = "(SELECT *, nullif(event_type, 'error') AS kind FROM events)"


@query("f11_is_null", f"SELECT event_id FROM {_NULLABLE} WHERE kind IS NULL")
def _(spark, d):
    return nullable(spark, d).filter(compile_predicate(_p("isNull", "kind"))).select("event_id")


@query("f12_is_not_null", f"SELECT event_id, kind FROM {_NULLABLE} WHERE kind IS NOT NULL")
def _(spark, d):
    return nullable(spark, d).filter(compile_predicate(_p("isNotNull", "kind"))).select("event_id", "kind")


@query("f19_not", f"SELECT event_id, kind FROM {_NULLABLE} WHERE NOT coalesce(kind = 'click', false)")
def _(spark, d):
    return nullable(spark, d).filter(compile_predicate({"op": "not", "children": [_p("eq", "kind", "click")]})).select("event_id", "kind")


@query("f21_has", f"SELECT count(*) AS n FROM {_NULLABLE} WHERE kind IS NOT NULL")
def _(spark, d):
    return nullable(spark, d).filter(compile_predicate(_p("has", "kind"))).agg(F.count("*").alias("n"))


@query("f22_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def _(spark, d):
    return load(spark, d, "orders").filter(where({"o_orderstatus": "O", "o_orderpriority": "1-URGENT"})).select("o_orderkey")


@query("f23_value_ref", "SELECT event_id FROM events WHERE user_id = 7")
def _(spark, d):
    return load(spark, d, "events").filter(compile_predicate({"op": "eq", "attribute": "user_id", "value_ref": "auth.id"}, {"auth.id": 7})).select("event_id")


_TOKENS = "list_filter(string_split(text, ' '), lambda t: t <> '')"


def tokened(spark, d):
    return load(spark, d, "documents").select("doc_id", F.filter(F.split("text", " "), lambda t: t != "").alias("tokens"))


@query("f13_contains_all", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'and'])")
def _(spark, d):
    return tokened(spark, d).filter(compile_predicate(_p("containsAll", "tokens", ["the", "and"]))).select("doc_id")


@query("f14_contains_any", f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['und', 'les'])")
def _(spark, d):
    return tokened(spark, d).filter(compile_predicate(_p("containsAny", "tokens", ["und", "les"]))).select("doc_id")


@query("f09_has_element", f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'der')")
def _(spark, d):
    return tokened(spark, d).filter(compile_predicate(_p("hasElement", "tokens", "der"))).select("doc_id")


# ------------------------------------------------------------ scans and projection


@query("s01_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS _key, n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    return load(spark, d, "nation", keyed=True)


@query("s02_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) LIMIT 50")
def _(spark, d):
    return plan(load(spark, d, "orders", keyed=True), QuerySpec(sort=[("o_totalprice", "desc")], limit=50, fields=["o_orderkey", "o_totalprice"]))


@query("s03_merge_sources", """SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def _(spark, d):
    e = load(spark, d, "events").select("user_id", "value", "ts", "event_id")
    return r.merged(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", F.struct("ts", "event_id")).select("user_id", "value")


@query("s04_has_more", "SELECT least(count(*), 20) AS shown, count(*) > 20 AS has_more FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    got = load(spark, d, "customer", keyed=True).filter("c_acctbal > 5000").orderBy("_key").limit(21)
    return got.agg(F.least(F.count("*"), F.lit(20)).alias("shown"), (F.count("*") > 20).alias("has_more"))


leaf("s06_lookup", "customer", _p("in", "c_custkey", [1, 5, 99]), "c_custkey IN (1, 5, 99)", "c_custkey, c_name")


@query("s13_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 25")
def _(spark, d):
    return load(spark, d, "part").orderBy("p_partkey").offset(25).limit(10).select("p_partkey")


@query("p02_project", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    return project(load(spark, d, "customer"), ["c_custkey", "c_name", "missing"])


@query("p03_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return e.filter(compile_predicate(_p("gt", "props.k", 50))).select("event_id", F.col("props.k").alias("k"))


@query("p04_multi_valued", f"SELECT t, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS t FROM documents) GROUP BY t HAVING count(*) > 200")
def _(spark, d):
    return tokened(spark, d).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter("n > 200")


# ------------------------------------------------------------ aggregation

_FLAGSHIP = QuerySpec(
    predicate=_p("lte", "l_quantity", 45), group_by=["l_returnflag", "l_linestatus"],
    aggregations=[("sum", "l_quantity"), ("avg", "l_extendedprice"), ("max", "l_discount"), ("min", "l_tax")], sort=[("l_returnflag", "asc"), ("l_linestatus", "asc")])


@query("a00_flagship", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, round(avg(l_extendedprice), 4) AS p, max(l_discount) AS d, min(l_tax) AS t
FROM lineitem WHERE l_quantity <= 45 GROUP BY ALL""")
def flagship(spark, d):
    out = plan(load(spark, d, "lineitem"), _FLAGSHIP)
    return out.select("l_returnflag", "l_linestatus", F.col("__count").alias("n"), F.col("__sum_l_quantity").alias("q"), F.round("__avg_l_extendedprice", 4).alias("p"), F.col("__max_l_discount").alias("d"), F.col("__min_l_tax").alias("t"))


@query("a01_count", "SELECT event_type, count(*) AS __count FROM events GROUP BY event_type")
def _(spark, d):
    return aggregate(load(spark, d, "events"), ["event_type"], [])


@query("a02_sum_of_nothing", "SELECT c_mktsegment, count(*) AS __count, CAST(0 AS DOUBLE) AS __sum_c_name FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    return aggregate(load(spark, d, "customer"), ["c_mktsegment"], [("sum", "c_name"), ("min", None)])


@query("a06_null_group", f"SELECT kind, count(*) AS __count, round(avg(value), 6) AS mean FROM {_NULLABLE} GROUP BY kind")
def _(spark, d):
    return aggregate(nullable(spark, d), ["kind"], [("avg", "value")]).select("kind", "__count", F.round("__avg_value", 6).alias("mean"))


@query("a07_group_key", f"SELECT CASE WHEN kind IS NULL THEN 'N' ELSE 'S' || strlen(kind) || ':' || kind END AS _key, count(*) AS n FROM {_NULLABLE} GROUP BY 1")
def _(spark, d):
    return nullable(spark, d).groupBy("kind").count().select(group_key(["kind"]).alias("_key"), F.col("count").alias("n"))


@query("a11_count_matching", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    return load(spark, d, "orders").filter(compile_predicate(_p("gt", "o_totalprice", 200000))).agg(F.count("*").alias("n"))


@query("a12_counter", """SELECT user_id, sum(p) - sum(n) AS value FROM (SELECT user_id, event_id % 3 AS node, max(event_id) AS p, max(user_id) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def _(spark, d):
    e = load(spark, d, "events").withColumn("node", F.col("event_id") % 3)
    return r.counter(e, "user_id", "node", "event_id", "user_id")


@query("a14_statistics", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def _(spark, d):
    return load(spark, d, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("a15_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_brand", "p_type").distinct()


@query("a15_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("a15_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("a16_schema", """SELECT 'event_type' AS name, 'string' AS type, string_agg(v, ',' ORDER BY v) AS values FROM (SELECT DISTINCT event_type AS v FROM events)
UNION ALL SELECT 'user_id', 'bigint', NULL UNION ALL SELECT 'value', 'double', NULL""")
def _(spark, d):
    return inferred(load(spark, d, "events"), ["event_type", "user_id", "value"])


@query("a17_selectivity", "SELECT count(*) AS total, count(*) FILTER (WHERE l_quantity > 40) AS matching, round(avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END), 6) AS selectivity FROM lineitem")
def _(spark, d):
    c = compile_predicate(_p("gt", "l_quantity", 40))
    return load(spark, d, "lineitem").agg(F.count("*").alias("total"), F.count(F.when(c, 1)).alias("matching"), F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias("selectivity"))


@query("q01_buckets", "SELECT floor(o_totalprice / 10000) * 10000 AS bucket, pow(10.0, floor(log10(o_totalprice))) AS magnitude, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    c = F.col("o_totalprice")
    return load(spark, d, "orders").groupBy(scalars.integer_multiple(c, 10000).cast("double").alias("bucket"), scalars.power_of_ten(c).alias("magnitude")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------ sort, pages


@query("o01_sort_nulls_last", f"SELECT event_id, kind, value FROM {_NULLABLE} ORDER BY kind DESC NULLS LAST, value ASC NULLS LAST, event_id")
def _(spark, d):
    return nullable(spark, d).orderBy(*order([("kind", "desc"), ("value", "asc")], tie="event_id")).select("event_id", "kind", "value")


@query("o06_limit_by_key", "SELECT CAST(c_custkey AS VARCHAR) AS _key FROM customer ORDER BY 1 LIMIT 7")
def _(spark, d):
    return plan(load(spark, d, "customer", keyed=True), QuerySpec(limit=7, fields=["_key"]))


@query("o08_keyset", """SELECT o_orderkey FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND (o_totalprice < 100000 OR (o_totalprice = 100000 AND CAST(o_orderkey AS VARCHAR) > '5')))
ORDER BY o_orderstatus, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 40""")
def _(spark, d):
    sort = [("o_orderstatus", "asc"), ("o_totalprice", "desc")]
    return load(spark, d, "orders", keyed=True).filter(after(sort, ["F", 100000.0], "5")).orderBy(*order(sort)).limit(40).select("o_orderkey")


# ------------------------------------------------------------ sets, joins, SQL


@query("u01_union_keys", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    a = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return a.union(load(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("u02_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 1000")
def _(spark, d):
    return load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(load(spark, d, "customer").filter("c_acctbal > 1000").select("c_custkey"))


@query("u03_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("j01_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def _(spark, d):
    o = load(spark, d, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("j03_enrich", """SELECT o.o_orderkey, c.c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) o JOIN customer c ON o.o_custkey = c.c_custkey""")
def _(spark, d):
    best = load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    return best.join(load(spark, d, "customer"), best["o_custkey"] == F.col("c_custkey")).select("o_orderkey", "c_name")


_SQL_TABLES = "region nation customer supplier part orders lineitem events".split()


def over_views(text: str):
    def run(spark, d):
        for t in _SQL_TABLES:
            if t in text:
                load(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return run


for _name, _text in {
    "j06_inner": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "j06_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "j06_full": "SELECT coalesce(c_nationkey, s_nationkey) AS k, max(c) AS c, max(s) AS s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey) x FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY s_nationkey) y ON c_nationkey = s_nationkey GROUP BY 1",
    "j06_range": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey >= r_regionkey AND n_regionkey < r_regionkey + 2",
    "w01_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders",
    "w02_running": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events",
    "w03_lag": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "u06_union_all": "SELECT c_nationkey AS k, 'c' AS what FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    "u06_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "x01_scalars": "SELECT upper(c_name) AS u, lower(c_mktsegment) AS l, substr(c_name, 1, 4) AS s, replace(c_name, '0', '') AS r, round(sqrt(abs(c_acctbal)), 6) AS q FROM customer",
    "x02_dates": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
}.items():
    query(_name, _text)(over_views(_text))


# ------------------------------------------------------------ replicated state

_MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"  # whatever the session's zone


def log(spark, d):
    """events as a change log of users: errors delete."""
    return load(spark, d, "events").select("user_id", "event_id", F.expr(_MILLIS).alias("millis"), F.lit(0).alias("counter"), F.col("event_id").cast("string").alias("node_id"), "event_type", "value", (F.col("event_type") == "error").alias("deleted"))


_LOG = "(SELECT user_id, event_id, epoch_us(ts) // 1000 AS millis, CAST(event_id AS VARCHAR) AS node_id, event_type, value, event_type = 'error' AS deleted FROM events)"
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY millis DESC, node_id DESC) AS k FROM {_LOG}) WHERE k = 1)"


@query("c01_last_write", f"SELECT user_id, event_type, value FROM {_LAST}")
def _(spark, d):
    return r.last_write(log(spark, d), ["user_id"], ["event_type", "value"])


@query("c02_visible", f"SELECT user_id, value FROM {_LAST} WHERE NOT deleted AND millis + 86400000 * 20 >= (SELECT max(epoch_us(ts) // 1000) FROM events)")
def _(spark, d):
    now = load(spark, d, "events").agg(F.max(F.expr(_MILLIS))).first()[0]
    state = r.last_write(log(spark, d), ["user_id"], ["value", "millis", "deleted"]).withColumn("ttl", F.lit(86400000 * 20))
    return r.visible(state, "deleted", "millis", "ttl", now).select("user_id", "value")


@query("c03_observed_set", f"SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS values FROM {_LOG} WHERE event_id % 7 <> 0 GROUP BY user_id")
def _(spark, d):
    adds = log(spark, d).withColumn("tag", F.col("event_id").cast("string"))
    return r.observed_set(adds, adds.filter("event_id % 7 = 0").select("tag"), "user_id", "tag", "event_type").withColumn("values", F.array_join("values", ","))


@query("c04_observed_remove", "SELECT CAST(event_id AS VARCHAR) AS tag FROM events WHERE event_type = 'view'")
def _(spark, d):
    return r.tombstones_for(log(spark, d).withColumn("tag", F.col("event_id").cast("string")), "event_type", "view")


@query("c07_resolvers", f"""SELECT user_id, arg_min(value, struct_pack(a := millis, b := node_id)) AS first_write, min(value) AS least, max(value) AS most FROM {_LOG} GROUP BY user_id""")
def _(spark, d):
    l, at = log(spark, d), r.clock()
    return l.groupBy("user_id").agg(r.RESOLVERS["FIRST_WRITE_WINS"](F.col("value"), at).alias("first_write"), r.RESOLVERS["NUMERIC_MIN"](F.col("value"), at).alias("least"), r.RESOLVERS["NUMERIC_MAX"](F.col("value"), at).alias("most"))


@query("c07_array_union", f"SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_type FROM {_LOG} GROUP BY user_id")
def _(spark, d):
    return r.resolve(log(spark, d).withColumn("event_type", F.array("event_type")), "user_id", "event_type", "ARRAY_UNION", r.clock()).withColumn("event_type", F.array_join("event_type", ","))


@query("c08_processors", """SELECT event_id, value + 5 AS plus, greatest(value - 50, 0) AS floor, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS replaced, CASE WHEN event_type <> 'click' THEN event_type END AS deleted FROM events""")
def _(spark, d):
    v, t = F.col("value"), F.col("event_type")
    return load(spark, d, "events").select("event_id", r.processed(v, "INCREMENT", 5).alias("plus"), r.processed(v, "DECREMENT_FLOOR", 50).alias("floor"), r.processed(t, "REPLACE_IF_EQUALS", "view", "seen").alias("replaced"), r.processed(t, "DELETE_IF_EQUALS", "click").alias("deleted"))


@query("l12_journal", f"""SELECT event_id AS sequence, CASE WHEN deleted THEN 'DELETE' WHEN coalesce(lag(deleted) OVER w, true) THEN 'PUT' ELSE 'UPDATE' END AS type, user_id AS key,
CASE WHEN NOT deleted THEN value END AS value, CASE WHEN NOT coalesce(lag(deleted) OVER w, true) THEN lag(value) OVER w END AS previous FROM {_LOG} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(spark, d):
    return r.journal(log(spark, d), "user_id", "value", "deleted", "event_id")


@query("l12_journal_page", "SELECT event_id AS sequence, event_type FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 25")
def _(spark, d):
    return r.journal_page(load(spark, d, "events").select(F.col("event_id").alias("sequence"), "event_type"), 500, 25)


@query("l13_digest_differs", "SELECT user_id FROM (SELECT user_id, max(event_id) AS a, max(CASE WHEN event_id % 50 <> 0 THEN event_id END) AS b FROM events GROUP BY user_id) WHERE a IS DISTINCT FROM b")
def _(spark, d):
    e = load(spark, d, "events")
    full = e.groupBy("user_id").agg(F.max("event_id").alias("at"))
    return r.differing(full.select("user_id", F.col("at").alias("version")), e.filter("event_id % 50 <> 0").groupBy("user_id").agg(F.max("event_id").alias("version")), "user_id", ["version"])


@query("l15_prune", f"SELECT user_id FROM {_LAST} WHERE NOT (deleted AND millis < (SELECT min(epoch_us(ts) // 1000) + 86400000 * 10 FROM events))")
def _(spark, d):
    start = load(spark, d, "events").agg(F.min(F.expr(_MILLIS))).first()[0]
    return r.without_old_tombstones(r.last_write(log(spark, d), ["user_id"], ["millis", "deleted"]), "deleted", "millis", start + 86400000 * 10).select("user_id")


# ------------------------------------------------------------ live queries


def _halves(spark, d):
    l = log(spark, d)
    cut = lambda x: r.last_write(x, ["user_id"], ["value", "deleted"]).filter("not deleted").select(F.col("user_id").cast("string").alias("_key"), "value")
    return cut(l.filter("event_id % 2 = 0")), cut(l)


_STATE = "SELECT CAST(user_id AS VARCHAR) AS _key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY millis DESC, node_id DESC) AS k FROM {log} {cond}) WHERE k = 1 AND NOT deleted"
_OLD, _NEW = _STATE.format(log=_LOG, cond="WHERE event_id % 2 = 0"), _STATE.format(log=_LOG, cond="")
_DIFF = """WITH o AS ({old}), n AS ({new}) SELECT coalesce(o._key, n._key) AS _key, CASE WHEN o._key IS NULL THEN 'ENTER' WHEN n._key IS NULL THEN 'LEAVE' ELSE 'UPDATE' END AS change, n.value
FROM o FULL JOIN n ON o._key = n._key WHERE o._key IS NULL OR n._key IS NULL OR o.value IS DISTINCT FROM n.value"""


@query("l01_standing", _DIFF.format(old=f"SELECT * FROM ({_OLD}) WHERE value > 30", new=f"SELECT * FROM ({_NEW}) WHERE value > 30"))
def _(spark, d):
    old, new = _halves(spark, d)
    return changes(old.filter("value > 30"), new.filter("value > 30"))


@query("l02_live_top", _DIFF.format(old=f"SELECT * FROM ({_OLD}) ORDER BY value, _key LIMIT 15", new=f"SELECT * FROM ({_NEW}) ORDER BY value, _key LIMIT 15"))
def _(spark, d):
    old, new = _halves(spark, d)
    return changes(top(old, "value", 15), top(new, "value", 15))


@query("l03_clock_guard", f"SELECT user_id, max(millis) AS millis FROM {_LOG} GROUP BY user_id")
def _(spark, d):
    return r.last_write(log(spark, d), ["user_id"], ["millis"])


# ------------------------------------------------------------ search

_W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) BETWEEN 2 AND 40)"


def _docs(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("t"))


def _bm25_sql(terms: list[str], tail: str) -> str:
    one = lambda t: f"ln((n - df_{t} + 0.5) / (df_{t} + 0.5) + 1) * tf_{t} * 2.2 / (tf_{t} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return f"""WITH w AS (SELECT doc_id, {_W} AS t FROM documents),
f AS (SELECT doc_id, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf_{t}" for t in terms)} FROM w),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf_{t} > 0) AS df_{t}" for t in terms)} FROM f),
s AS (SELECT doc_id, round({" + ".join(map(one, terms))}, 6) AS score FROM f, c WHERE {" OR ".join(f"tf_{t} > 0" for t in terms)})
SELECT doc_id, score FROM s {tail}"""


@query("t01_tokens", f"SELECT doc_id, len({_W}) AS n, len(list_distinct({_W})) AS distinct_n FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.size("t").cast("long").alias("n"), F.size(tx.unique(F.col("t"))).cast("long").alias("distinct_n"))


@query("t01_stems")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(tx.search_tokens(F.col("text")), " ").alias("stems"))


@query("t02_ngrams", "SELECT p_partkey, len(p_name) - 2 AS n FROM part WHERE len(p_name) >= 3")
def _(spark, d):
    return load(spark, d, "part").filter(F.length("p_name") >= 3).select("p_partkey", F.size(tx.ngrams(F.col("p_name"))).cast("long").alias("n"))


@query("t05_inverted", f"SELECT doc_id FROM documents WHERE list_has_all({_W}, ['that', 'this'])")
def _(spark, d):
    return _docs(spark, d).filter(compile_predicate(_p("containsAll", "t", ["that", "this"]))).select("doc_id")


@query("t07_bm25", _bm25_sql(["that", "license"], ""))
def _(spark, d):
    return s.bm25(load(spark, d, "documents"), "doc_id", tx.words(F.col("text")), ["that", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query("t09_min_score", _bm25_sql(["der", "license"], "WHERE score >= 1.5"))
def _(spark, d):
    return s.bm25(load(spark, d, "documents"), "doc_id", tx.words(F.col("text")), ["der", "license"], 1.5).select("doc_id", F.round("score", 6).alias("score"))


@query("t14_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_W}, ' ') || ' ', ' mit license ')")
def _(spark, d):
    return _docs(spark, d).filter(s.phrase(F.col("t"), ["mit", "license"])).select("doc_id")


@query("t14_prefix", f"SELECT doc_id FROM documents WHERE len(list_filter({_W}, lambda t: starts_with(t, 'licen'))) > 0")
def _(spark, d):
    return _docs(spark, d).filter(s.prefix(F.col("t"), "licen")).select("doc_id")


def _unit(spark, d, vec_id: int = 0) -> list[float]:
    return load(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_E = "CAST(embedding AS DOUBLE[])"
_METRICS = {"cosine": f"1 - list_inner_product({_E}, q) / sqrt(list_inner_product({_E}, {_E}) * list_inner_product(q, q))", "l2": f"list_distance({_E}, q)", "dot": f"-list_inner_product({_E}, q)", "l1": f"list_sum(list_transform(list_zip({_E}, q), lambda z: abs(z[1] - z[2])))"}


def _nearest(metric: str):
    def run(spark, d):
        out = s.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", _unit(spark, d), 20, metric)
        return out.select("vec_id", F.round("distance", 5).alias("distance"))

    return run


for _m, _sql in _METRICS.items():
    query(f"v02_nearest_{_m}", f"SELECT vec_id, round({_sql}, 5) + 0.0 AS distance FROM embeddings, {_Q} ORDER BY {_sql}, vec_id LIMIT 20")(_nearest(_m))


@query("v04_min_score", f"SELECT vec_id FROM embeddings, {_Q} WHERE 1 - ({_METRICS['cosine']}) >= 0.2")
def _(spark, d):
    return s.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", _unit(spark, d), None, "cosine", 0.2).select("vec_id")


_LISTS = """a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 30),
b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice * (o_orderkey % 5) DESC, o_orderkey) AS r FROM orders QUALIFY r <= 30)"""


def _two_lists(spark, d):
    o = load(spark, d, "orders")
    best = lambda c: o.select(F.col("o_orderkey").alias("k"), c.alias("score")).orderBy(F.desc("score"), "k").limit(30)
    return [best(F.col("o_totalprice")), best(F.col("o_totalprice") * (F.col("o_orderkey") % 5))]


@query("h01_fused", f"WITH {_LISTS} SELECT k, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k ORDER BY sum(1.0 / (60 + r)) DESC, k LIMIT 25")
def _(spark, d):
    return s.fused(_two_lists(spark, d), "k", 25).select("k", F.round("score", 8).alias("score"))


@query("h02_weighted", f"WITH {_LISTS} SELECT k, round(sum(w / (60 + r)), 8) AS score FROM (SELECT *, 2.0 AS w FROM a UNION ALL SELECT *, 0.5 FROM b) GROUP BY k ORDER BY sum(w / (60 + r)) DESC, k LIMIT 25")
def _(spark, d):
    return s.fused(_two_lists(spark, d), "k", 25, [2.0, 0.5]).select("k", F.round("score", 8).alias("score"))


@query("x03_partition", None)
def _(spark, d):
    c = F.col("c_name")
    return load(spark, d, "customer").select("c_custkey", scalars.fnv1a(c).alias("hash"), scalars.partition_id(c).alias("partition"))
