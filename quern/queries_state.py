"""Queries over replicated state, cursors, buckets, hashes, grouping and policies, with equivalent SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import scalars
from quern.operators import replicated as r
from quern.plans.query import QuerySpec, aggregate, decode_cursor, encode_cursor, order, page, shape_hash
from quern.queries import _LAST, _LOG, QUERIES, _p, log, nullable, over_views, query
from quern.sources.tables import entries, load
from quern.streaming.live import windowed_counts

_BEFORE = set(QUERIES)

# ------------------------------------------------------------ resolvers

_AUTHORS = f"(SELECT *, CASE WHEN event_id % 5 = 0 THEN 'server:1' ELSE 'u' || (event_id % 3) END AS author, CASE WHEN event_id % 7 > 0 THEN 'u' || (event_id % 4) END AS owner, event_id % 6 AS version FROM {_LOG})"


def _authored(spark, d):
    e = F.col("event_id")
    author = F.when(e % 5 == 0, "server:1").otherwise(F.concat(F.lit("u"), (e % 3).cast("string")))
    return log(spark, d).withColumns({"author": author, "owner": F.when(e % 7 > 0, F.concat(F.lit("u"), (e % 4).cast("string"))), "version": e % 6})


def _resolved(name: str, how: str, sql: str, **columns: str) -> None:
    query(name, sql)(lambda spark, d: r.resolve(_authored(spark, d), "user_id", "value", how, r.clock(), **columns))


def _last(condition: str) -> str:
    return f"SELECT user_id, arg_max(value, struct_pack(a := millis, b := node_id)) AS value FROM {_AUTHORS} WHERE {condition} GROUP BY user_id"


_resolved("c07_last_write", "LAST_WRITE_WINS", _last("true"))
_resolved("c07_immutable", "IMMUTABLE", _last("true").replace("arg_max", "arg_min"))
_resolved("c07_server_only", "SERVER_ONLY", _last("author LIKE 'server:%'"), author="author")
_CHAIN = f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY millis, node_id) AS place FROM {_AUTHORS}),
c AS ({{first}} UNION ALL SELECT c.user_id, n.place, n.owner, n.version FROM c, LATERAL (SELECT * FROM n WHERE n.user_id = c.user_id AND n.place > c.place AND ({{takes}}) ORDER BY n.place LIMIT 1) n)
SELECT user_id, arg_max(n.value, place) AS value FROM c JOIN n USING (user_id, place) GROUP BY user_id"""
_resolved("c07_owner_only", "OWNER_ONLY", _CHAIN.format(first="SELECT user_id, place, owner, version FROM n WHERE place = 1", takes="c.owner IS NULL OR n.author = c.owner"), owner="owner", author="author")
_resolved("c07_version_increment", "VERSION_INCREMENT", _CHAIN.format(
    first="SELECT user_id, min(place) AS place, any_value(owner) AS owner, CAST(1 AS BIGINT) AS version FROM n WHERE version = 1 GROUP BY user_id", takes="n.version = c.version + 1"), version="version")


@query("c07_non_negative", f"SELECT user_id, arg_max(value - 50, struct_pack(a := millis, b := node_id)) AS value FROM {_LOG} WHERE value >= 50 GROUP BY user_id")
def _(spark, d):
    return r.resolve(log(spark, d).withColumn("value", F.col("value") - 50), "user_id", "value", "NON_NEGATIVE", r.clock())


@query("c07_deep_merge", f"SELECT user_id, event_type AS k, arg_max(value, struct_pack(a := millis, b := node_id)) AS v FROM {_LOG} GROUP BY 1, 2")
def _(spark, d):
    merged = r.deep_merge(log(spark, d).withColumn("m", F.create_map("event_type", "value")), "user_id", "m", r.clock())
    return merged.select("user_id", F.explode("m").alias("k", "v"))


@query("c03_equal_tags", f"""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS values FROM
(SELECT *, row_number() OVER (PARTITION BY event_id % 3000 ORDER BY millis DESC, node_id DESC) AS k FROM {_LOG}) WHERE k = 1 AND event_id % 3000 % 11 <> 0 GROUP BY user_id""")
def _(spark, d):
    adds = log(spark, d).withColumn("tag", F.col("event_id") % 3000)
    return r.observed_set(adds, adds.filter("tag % 11 = 0").select("tag"), "user_id", "tag", "event_type").withColumn("values", F.array_join("values", ","))


@query("c05_clock_text", f"SELECT user_id, max(millis) || ':0:' || arg_max(node_id, struct_pack(a := millis, b := node_id)) AS at, max(millis) AS millis FROM {_LOG} GROUP BY user_id")
def _(spark, d):
    last = log(spark, d).groupBy("user_id").agg(F.max(r.clock()).alias("c")).select("user_id", r.format_clock(F.col("c")).alias("at"))
    return last.select("user_id", "at", r.parse_clock(F.col("at"))["millis"].alias("millis"))


@query("c05_clock_values", "SELECT * FROM (VALUES (1, 100, 0), (2, 100, 1), (3, 250, 8), (4, 250, 9), (5, 300, 0)) t(step, millis, counter)")
def _(spark, d):
    times = iter([100, 100, 100, 120, 300])
    clock, out = r.Clock("n", lambda: next(times)), []
    out += [(1, *clock.now()[:2]), (2, *clock.now()[:2])]
    clock.update(250, 7)
    out.append((3, *clock.at))
    out += [(4, *clock.now()[:2]), (5, *clock.now()[:2])]
    return spark.createDataFrame(out, "step int, millis int, counter int")


# ------------------------------------------------------------ entry processors


@query("c08_numbers", """SELECT event_id, coalesce(v, 0) - 5 AS decremented, coalesce(v, 1) * 3 AS multiplied, coalesce(v, 7.0) AS put, CASE WHEN v IS NOT NULL THEN 1.0 END AS replaced, v AS got
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)""")
def _(spark, d):
    v = F.expr("CASE WHEN event_type <> 'error' THEN value END")
    steps = {"decremented": ("DECREMENT", 5), "multiplied": ("MULTIPLY", 3), "put": ("PUT_IF_ABSENT", 7.0), "replaced": ("REPLACE", 1.0), "got": ("GET",)}
    return load(spark, d, "events").select("event_id", *[r.processed(v, *x).alias(n) for n, x in steps.items()])


@query("c08_arrays", """SELECT p_partkey, array_to_string(list_append(coalesce(a, []), 'new'), ',') AS pushed, array_to_string(coalesce(a[:-2], []), ',') AS popped,
array_to_string(coalesce(CASE WHEN list_contains(a, 'red') THEN list_concat(a[:list_position(a, 'red') - 1], a[list_position(a, 'red') + 1:]) ELSE a END, []), ',') AS removed
FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN list_concat(string_split(p_name, ' '), string_split(p_name, ' ')) END AS a FROM part)""")
def _(spark, d):
    words = F.split("p_name", " ")
    a = F.when(F.col("p_size") > 5, F.concat(words, words))
    steps = {"pushed": ("ARRAY_PUSH", "new"), "popped": ("ARRAY_POP",), "removed": ("ARRAY_REMOVE", "red")}
    return load(spark, d, "part").select("p_partkey", *[F.array_join(r.processed(a, *x), ",").alias(n) for n, x in steps.items()])


@query("c08_objects", """SELECT p_partkey, 'big' AS set_size, p_brand AS set_brand, CAST(NULL AS VARCHAR) AS deleted_brand, CASE WHEN p_size = 7 THEN 'updated' ELSE p_brand END AS updated_brand,
CASE WHEN p_size = 7 THEN '8' ELSE CAST(p_size AS VARCHAR) END AS updated_version, 'b' AS merged_brand, 'x' AS merged_more FROM part""")
def _(spark, d):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("version"), F.col("p_size").cast("string"))
    new = lambda **x: F.create_map(*[F.lit(y) for pair in x.items() for y in pair])
    put, gone = r.processed(m, "SET_PROPERTY", "size", "big"), r.processed(m, "DELETE_PROPERTY", "brand")
    updated, merged = r.processed(m, "CONDITIONAL_UPDATE", 7, new(brand="updated")), r.processed(m, "MERGE", new(brand="b", more="x"))
    return load(spark, d, "part").select(
        "p_partkey", put["size"].alias("set_size"), put["brand"].alias("set_brand"), gone["brand"].alias("deleted_brand"), updated["brand"].alias("updated_brand"),
        updated["version"].alias("updated_version"), merged["brand"].alias("merged_brand"), merged["more"].alias("merged_more"))


# ------------------------------------------------------------ journal

_JOURNAL = f"""(SELECT event_id AS sequence, CASE WHEN deleted THEN 'DELETE' WHEN coalesce(lag(deleted) OVER w, true) THEN 'PUT' ELSE 'UPDATE' END AS type, user_id AS key,
CASE WHEN NOT deleted THEN value END AS value FROM {_LOG} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _journal(spark, d):
    return r.journal(log(spark, d), "user_id", "value", "deleted", "event_id")


@query("l12_ring", f"SELECT sequence, type FROM {_JOURNAL} ORDER BY sequence DESC LIMIT 200")
def _(spark, d):
    return r.journal_ring(_journal(spark, d), 200).select("sequence", "type")


@query("l12_read", f"SELECT sequence, type, true AS has_more FROM {_JOURNAL} WHERE sequence >= 100 AND type = 'PUT' ORDER BY sequence LIMIT 15")
def _(spark, d):
    got, more = r.journal_read(_journal(spark, d), 100, 15, "PUT")
    return spark.createDataFrame([(x["sequence"], x["type"], more) for x in got], "sequence long, type string, has_more boolean")


@query("l12_map_filter", f"SELECT sequence, 'even' AS map FROM {_JOURNAL} WHERE key % 2 = 0 AND sequence >= 50 ORDER BY sequence LIMIT 40")
def _(spark, d):
    events = _journal(spark, d).withColumn("map", F.when(F.col("key") % 2 == 0, "even").otherwise("odd"))
    return r.journal_page(events, 50, 40, map_name="even").select("sequence", "map")


@query("l12_replay", f"SELECT key, arg_max(value, sequence) AS value FROM {_JOURNAL} GROUP BY key HAVING arg_max(type, sequence) <> 'DELETE'")
def _(spark, d):
    return r.replayed(_journal(spark, d))


# ------------------------------------------------------------ cursors and pages

_SPEC = QuerySpec(predicate=_p("gt", "o_totalprice", 1000), sort=[("o_orderstatus", "asc"), ("o_totalprice", "desc")], limit=20, fields=["o_orderkey"])
_PAGES = "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderstatus, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20 OFFSET 20"


@query("o11_next_page", _PAGES)
def _(spark, d):
    orders, now = load(spark, d, "orders", keyed=True), 1_000_000
    first = page(orders, _SPEC, now)
    second = page(orders, replace(_SPEC, cursor=first.next_cursor), now + 1000)
    assert (first.cursor_status, second.cursor_status) == ("none", "valid")
    return spark.createDataFrame([(x["o_orderkey"],) for x in second.rows], "o_orderkey long")


@query("o09_cursor_status", "SELECT * FROM (VALUES ('fresh', 'valid'), ('late', 'expired'), ('none', 'none'), ('other sort', 'invalid'), ('other predicate', 'invalid'), ('garbled', 'invalid')) t(which, status)")
def _(spark, d):
    c = encode_cursor(_SPEC, ["F", 5.0], "7", 1_000_000)
    held = replace(_SPEC, cursor=c)
    tries = [("fresh", held, 1_000_100), ("late", held, 1_700_000), ("none", _SPEC, 1_000_100), ("other sort", replace(held, sort=[("o_totalprice", "desc"), ("o_orderstatus", "asc")]), 1_000_100),
             ("other predicate", replace(held, predicate=_p("gt", "o_totalprice", 1)), 1_000_100), ("garbled", replace(held, cursor="x" + c[5:]), 1_000_100)]
    return spark.createDataFrame([(n, decode_cursor(spec, now)[1]) for n, spec, now in tries], "which string, status string")


@query("o10_cursor_shape", "SELECT * FROM (VALUES ('limit', true), ('fields', true), ('where', false), ('group', false)) t(changed, same)")
def _(spark, d):
    other = {"limit": replace(_SPEC, limit=5), "fields": replace(_SPEC, fields=None), "where": replace(_SPEC, predicate=None, where={"o_orderkey": 1}), "group": replace(_SPEC, group_by=["o_orderstatus"])}
    return spark.createDataFrame([(n, shape_hash(x) == shape_hash(_SPEC)) for n, x in other.items()], "changed string, same boolean")


@query("o14_clamped", "SELECT o_orderkey, true AS has_more FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderstatus, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 12")
def _(spark, d):
    got = page(load(spark, d, "orders", keyed=True), _SPEC, 0, most=12)
    return spark.createDataFrame([(x["o_orderkey"], got.has_more) for x in got.rows], "o_orderkey long, has_more boolean")


@query("o01_sorted", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY kind DESC NULLS LAST, value, event_id) AS place FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events)")
def _(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy(*order([("kind", "desc"), ("value", "asc")], tie="event_id"))
    return nullable(spark, d).select("event_id", F.row_number().over(by).alias("place"))


# ------------------------------------------------------------ sources and results


@query("s12_entries", """SELECT CAST(n_nationkey AS VARCHAR) AS key, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS value FROM nation""")
def _(spark, d):
    return entries(load(spark, d, "nation", keyed=True))


@query("s05_by_partitions", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    # Each split of the files counts for itself; only counts are shuffled.
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s10_collected", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    got = page(load(spark, d, "region", keyed=True), QuerySpec(sort=[("r_name", "desc")]), 0)
    return spark.createDataFrame([(x["r_regionkey"], x["r_name"]) for x in got.rows], "r_regionkey int, r_name string")


@query("a10_no_groups", "SELECT event_type, count(*) AS __count FROM events WHERE event_id < 0 GROUP BY event_type")
def _(spark, d):
    return aggregate(load(spark, d, "events").filter("event_id < 0"), ["event_type"], [])


@query("a17_advice", "SELECT 'none' AS filter, 'add a filter' AS advice UNION ALL SELECT 'narrow', 'sort or partition the table by the filter''s columns' UNION ALL SELECT 'half', ''")
def _(spark, d):
    e = Engine(spark)
    e.register_map("orders", load(spark, d, "orders", keyed=True))
    specs = {"none": QuerySpec(), "narrow": QuerySpec(predicate=_p("lt", "o_orderkey", 5)), "half": QuerySpec(predicate=_p("gt", "o_totalprice", 400000.0))}
    middle = load(spark, d, "orders").approxQuantile("o_totalprice", [0.7], 0.01)[0]
    specs["half"] = QuerySpec(predicate=_p("gt", "o_totalprice", middle))
    return spark.createDataFrame([(n, "; ".join(e.explain("orders", x)["advice"])) for n, x in specs.items()], "filter string, advice string")


@query("x01_policy", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND NOT c_nationkey = 3")
def _(spark, d):
    e = Engine(spark)
    e.register_map("sales.customer", load(spark, d, "customer"), view="sales_customer")
    e.allow("sales.*", F.col("c_mktsegment") == "BUILDING")
    e.allow("*.customer", F.col("c_acctbal") > 9000)
    e.allow("sales.cust*", F.col("c_nationkey") == 3, deny=True)
    e.allow("other.*", F.lit(True))
    return e.map("sales.customer").select("c_custkey")


# ------------------------------------------------------------ grouping, joins, windows

for _name, _text in {
    "a15_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "a15_grouping_sets": "SELECT p_brand, p_type, max(p_size) AS most FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "j06_right": "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9500",
    "j06_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "w04_ntile": "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quarter, lead(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS following FROM orders",
    "x02_text": "SELECT c_custkey, trim('  ' || c_name || ' ') AS t, lpad(c_mktsegment, 12, '*') AS p, reverse(c_mktsegment) AS v, length(c_name) AS n FROM customer",
}.items():
    query(_name, _text)(over_views(_text))
query("j06_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")(over_views("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"))
query("j06_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(over_views("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey"))


@query("a15_approximate", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    # Beside a distinct count Spark would hold a sketch per flag and part; of distinct rows the sketch is the same.
    exact, near = F.count("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    rows = load(spark, d, "lineitem").select("l_returnflag", "l_partkey").distinct()
    return rows.groupBy("l_returnflag").agg((F.abs(exact - near) <= 0.1 * exact).alias("close"))


@query("l17_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.timestamp_seconds(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    return windowed_counts(e, "ts", "1 hour", "1 hour", "event_type").withColumn("start", F.unix_timestamp("start"))


@query("l02_state_size", f"SELECT count(*) AS n FROM {_LAST} WHERE NOT deleted")
def _(spark, d):
    return r.last_write(log(spark, d), ["user_id"], ["deleted"]).filter("not deleted").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ buckets, hashes, neighbours


@query("q01_time_buckets", "SELECT epoch_us(ts) // 3600000000 * 3600000 AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    ts = F.timestamp_millis(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    return load(spark, d, "events").groupBy(scalars.time_interval(ts, 3_600_000).alias("bucket")).agg(F.count("*").alias("n"))


@query("q01_log_buckets", "SELECT pow(2.0, floor(ln(o_totalprice) / ln(2.0))) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupBy(scalars.logarithmic(F.col("o_totalprice"), 2).alias("bucket")).agg(F.count("*").alias("n"))


@query("sm_neighbours", """SELECT max(o_orderkey) FILTER (WHERE o_orderkey < 500) AS lower, max(o_orderkey) FILTER (WHERE o_orderkey <= 500) AS floor,
min(o_orderkey) FILTER (WHERE o_orderkey >= 500) AS ceiling, min(o_orderkey) FILTER (WHERE o_orderkey > 500) AS higher FROM orders WHERE o_orderkey % 7 <> 3""")
def _(spark, d):
    return scalars.neighbours(load(spark, d, "orders").filter("o_orderkey % 7 <> 3"), "o_orderkey", 500)


@query("sm_at", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 99")
def _(spark, d):
    return scalars.at_place(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 99)


_FNV32 = "list_reduce(list_transform(string_split(c_name, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, x: xor(h, x) * 16777619 % 4294967296, CAST(2166136261 AS BIGINT))"
_MIX = ["xor(h, h >> 16) AS h", "h * 2246822507 % 4294967296 AS h", "xor(h, h >> 13) AS h", "h * 3266489909 % 4294967296 AS h", "xor(h, h >> 16) AS h"]


def _mixed_sql(source: str) -> str:
    for step in _MIX:
        source = f"(SELECT * EXCLUDE (h), {step.replace('h *', 'CAST(h AS HUGEINT) *').replace(' AS h', '')}::BIGINT AS h FROM {source})" if "*" in step else f"(SELECT * EXCLUDE (h), {step} FROM {source})"
    return source


query("x03_partition", f"SELECT c_custkey, {_FNV32} AS hash, CAST({_FNV32} % 271 AS INTEGER) AS partition FROM customer")(QUERIES["x03_partition"])


@query("x03_combined", f"SELECT c_mktsegment, CAST(sum(h) % 4294967296 AS BIGINT) AS hash FROM {_mixed_sql(f'(SELECT c_mktsegment, {_FNV32} AS h FROM customer)')} GROUP BY c_mktsegment")
def _(spark, d):
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(scalars.combined_hash(scalars.fnv1a(F.col("c_name"))).alias("hash"))


NEW = [n for n in QUERIES if n not in _BEFORE] + ["x03_partition"]
