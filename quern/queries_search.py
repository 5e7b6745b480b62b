"""Queries over text, vectors and both, and their live forms, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.predicates import compile_predicate
from quern.operators import search as s
from quern.plans.query import decode_search_cursor, encode_search_cursor
from quern.queries import QUERIES, _METRICS, _Q, _p, _unit, leaf, query
from quern.sources.tables import load
from quern.streaming.live import applied, changes, cleared, latest_operations

_BEFORE = set(QUERIES)


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) BETWEEN 2 AND 40)"


def _scored(table: str, key: str, text: str, terms: list[str], times: float = 1.0) -> str:
    """k and score of a table's rows that hold a term."""
    one = lambda i: f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    ids = range(len(terms))
    return f"""(WITH w AS (SELECT {key} AS k, {_tokens(text)} AS t FROM {table}),
f AS (SELECT k, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))} FROM w),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in ids)} FROM f)
SELECT k, {times} * ({" + ".join(map(one, ids))}) AS score FROM f, c WHERE {" OR ".join(f"tf{i} > 0" for i in ids)})"""


# ------------------------------------------------------------ full-text predicates

leaf("f24_match", "part", _p("match", "p_name", "ring bolt"), f"list_has_any({_tokens('p_name')}, ['ring', 'bolt'])", "p_partkey, p_name")
leaf("f24_match_all", "part", _p("match", "p_name", "Red ring", operator="and"), f"list_has_all({_tokens('p_name')}, ['red', 'ring'])", "p_partkey, p_name")
leaf("f25_not_phrase", "part", {"op": "not", "children": [_p("matchPhrase", "p_name", "red widget")]}, f"NOT contains(' ' || array_to_string({_tokens('p_name')}, ' ') || ' ', ' red widget ')", "p_partkey")
leaf("f25_prefix", "part", _p("matchPrefix", "p_name", "Wid"), f"len(list_filter({_tokens('p_name')}, lambda t: starts_with(t, 'wid'))) > 0", "p_partkey, p_name")
leaf("f26_multi_match", "part", {"op": "multiMatch", "attributes": ["p_name", "p_type"], "value": "small ring"}, f"list_has_any({_tokens('p_name')}, ['small', 'ring']) OR list_has_any({_tokens('p_type')}, ['small', 'ring'])", "p_partkey, p_name, p_type")

# ------------------------------------------------------------ tokenisers

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_ASCII = r"list_filter(regexp_split_to_array(text, '\W+'), lambda t: t <> '')"


def _digests(**columns):
    def run(spark, d):
        c = F.col("text")
        return load(spark, d, "documents").select("doc_id", *[F.md5(F.array_join(f(c), "|")).alias(n) for n, f in columns.items()])

    return run


@query("t01_search_words", f"SELECT doc_id, md5(array_to_string(list_filter({_tokens('text')}, lambda t: t NOT IN ({_STOP})), '|')) AS words FROM documents")
def _(spark, d):
    return _digests(words=lambda c: tx.without_stopwords(tx.words(c)))(spark, d)


query("t02_tokenizers", f"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), '|')) AS blanks, md5(array_to_string({_ASCII}, '|')) AS boundaries FROM documents")(
    _digests(blanks=tx.whitespace, boundaries=tx.word_boundary))
query("t03_filters", "SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_transform(string_split(text, ','), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '' AND length(t) <= 50), lambda t: lower(t)), '|')) AS kept FROM documents")(
    _digests(kept=lambda c: tx.lowercase(tx.at_most(tx.trimmed(F.split(c, ","))))))
query("t04_pipelines", f"""SELECT doc_id, md5(array_to_string(l, '|')) AS minimal, md5(array_to_string(list_filter(l, lambda t: length(t) >= 2), '|')) AS simple,
md5(array_to_string(list_filter(l, lambda t: length(t) >= 2 AND t NOT IN ({_STOP})), '|')) AS search FROM (SELECT doc_id, list_transform({_ASCII}, lambda t: lower(t)) AS l FROM documents)""")(_digests(**tx.PIPELINES))


@query("t02_trigrams", "SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)), '|') AS grams FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array_join(tx.ngrams(F.col("p_name")), "|").alias("grams"))


# ------------------------------------------------------------ scored search

_PART = {"p_name": 2.0, "p_type": 1.0}
_TERMS = ["small", "ring", "standard"]
_PART_SQL = " UNION ALL ".join(_scored("part", "p_partkey", c, _TERMS, w) for c, w in _PART.items())


def _rounded(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.select(key, F.round("score", 6).alias("score"), *more)


@query("t15_multi_match", f"SELECT k AS p_partkey, round(sum(score), 6) AS score FROM ({_PART_SQL}) GROUP BY k")
def _(spark, d):
    return _rounded(s.search(load(spark, d, "part"), "p_partkey", _PART, _TERMS, None), "p_partkey")


@query("t09_options", f"SELECT k AS p_partkey, round(sum(score), 6) AS score FROM ({_PART_SQL}) GROUP BY k HAVING sum(score) >= 3 ORDER BY sum(score) DESC, k LIMIT 25")
def _(spark, d):
    return _rounded(s.search(load(spark, d, "part"), "p_partkey", _PART, _TERMS, 25, 3.0), "p_partkey")


@query("t10_combined", f"SELECT k AS p_partkey, round(score, 6) AS score FROM {_scored('part', 'p_partkey', 'concat_ws(chr(32), p_name, p_type)', _TERMS)}")
def _(spark, d):
    return _rounded(s.combined(load(spark, d, "part"), "p_partkey", ["p_name", "p_type"], _TERMS, None), "p_partkey")


@query("t11_all_text", f"SELECT k AS c_custkey, round(score, 6) AS score FROM {_scored('customer', 'c_custkey', 'concat_ws(chr(32), c_name, c_mktsegment)', ['building', '000000007'])}")
def _(spark, d):
    c = load(spark, d, "customer")
    return _rounded(s.bm25(c, "c_custkey", tx.words(tx.all_text(c)), ["building", "000000007"]), "c_custkey")


@query("t08_one_document", f"SELECT k AS p_partkey, round(score, 6) AS score FROM {_scored('part', 'p_partkey', 'p_name', ['ring', 'small', 'red', 'blue', 'hot', 'bolt', 'gear', 'widget'])} WHERE k = 3")
def _(spark, d):
    return _rounded(s.bm25(load(spark, d, "part"), "p_partkey", tx.words(F.col("p_name")), ["ring", "small", "red", "blue", "hot", "bolt", "gear", "widget"], only=3), "p_partkey")


@query("t12_terms", f"SELECT p_partkey, array_to_string(list_filter(['small', 'ring', 'red'], lambda x: list_contains({_tokens('p_name')}, x)), ',') AS terms FROM part WHERE list_has_any({_tokens('p_name')}, ['small', 'ring', 'red'])")
def _(spark, d):
    return s.bm25(load(spark, d, "part"), "p_partkey", tx.words(F.col("p_name")), ["small", "ring", "red"]).select("p_partkey", F.array_join("terms", ",").alias("terms"))


@query("h06_score_order", f"SELECT k AS p_partkey, row_number() OVER (ORDER BY score DESC, k) AS place FROM {_scored('part', 'p_partkey', 'p_name', ['ring', 'red'])} ORDER BY score DESC, k LIMIT 40")
def _(spark, d):
    best = s.search(load(spark, d, "part"), "p_partkey", {"p_name": 1.0}, ["ring", "red"], 40)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey")).alias("place"))


@query("o12_search_page", f"SELECT k AS p_partkey, round(score, 6) AS score FROM {_scored('part', 'p_partkey', 'p_name', ['ring', 'red'])} ORDER BY score DESC, k LIMIT 10 OFFSET 10")
def _(spark, d):
    hits, text, now = s.bm25(load(spark, d, "part"), "p_partkey", tx.words(F.col("p_name")), ["ring", "red"]), "ring red", 1_000_000
    last = s.search_page(hits, "p_partkey", 10).agg(F.min_by(F.struct("score", "p_partkey"), F.struct("score", -F.col("p_partkey"))).alias("x")).first()["x"]
    cursor = encode_search_cursor(text, last["score"], last["p_partkey"], now)
    place, status = decode_search_cursor(cursor, text, now + 1000)
    assert status == "valid"
    return _rounded(s.search_page(hits, "p_partkey", 10, place), "p_partkey")


# ------------------------------------------------------------ vectors

for _m, _sql in _METRICS.items():
    _score = {"cosine": f"1 - ({_sql})", "dot": f"-({_sql})"}.get(_m, f"1 / (1 + {_sql})")
    query(f"v03_score_{_m}", f"SELECT vec_id, round({_score}, 5) + 0.0 AS score FROM embeddings, {_Q}")(
        lambda spark, d, m=_m: s.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", _unit(spark, d), None, m).select("vec_id", F.round("score", 5).alias("score")))

_NEAR = f"SELECT *, {_METRICS['cosine']} AS distance FROM embeddings, {_Q}"


@query("v04_filtered", f"SELECT vec_id FROM ({_NEAR}) WHERE label = 1 ORDER BY distance, vec_id LIMIT 15")
def _(spark, d):
    return s.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", _unit(spark, d), 15, condition=F.col("label") == 1).select("vec_id")


@query("v04_post_filtered", f"SELECT vec_id FROM (SELECT * FROM ({_NEAR}) ORDER BY distance, vec_id LIMIT 60) WHERE label = 1 ORDER BY distance, vec_id LIMIT 15")
def _(spark, d):
    return s.nearest(load(spark, d, "embeddings"), "vec_id", "embedding", _unit(spark, d), 15, condition=F.col("label") == 1, post_filter=True).select("vec_id")


_FNV = "list_reduce(list_transform(string_split(w, ''), lambda x: CAST(ord(x) AS UHUGEINT)), lambda h, x: xor(h, x) * 1099511628211 % 18446744073709551616, CAST(14695981039346656037 AS UHUGEINT))"


@query("v07_embedding", rf"""WITH t AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS w FROM part),
h AS (SELECT p_partkey, {_FNV} AS h FROM t), b AS (SELECT p_partkey, CAST(h % 64 AS INTEGER) AS place, sum(CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END) AS v FROM h GROUP BY ALL)
SELECT p_partkey, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)), 4) + 0.0 AS value FROM b WHERE v <> 0""")
def _(spark, d):
    e = load(spark, d, "part").select("p_partkey", F.posexplode(tx.embedded(F.col("p_name"))).alias("place", "v")).filter("v <> 0")
    return e.select("p_partkey", "place", F.round(F.col("v").cast("double"), 4).alias("value"))


# ------------------------------------------------------------ hybrid search


def _both(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    return docs.join(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


_DOCS = "(SELECT doc_id, text, lang, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"
_WORDS = ["license", "that"]
_TEXT = f"SELECT k, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, k)) AS rr FROM {_scored(_DOCS, 'doc_id', 'text', _WORDS)} ORDER BY score DESC, k LIMIT 10"
_VECTOR = f"SELECT doc_id AS k, 1.0 / (60 + row_number() OVER (ORDER BY {_METRICS['cosine']}, doc_id)) AS rr FROM {_DOCS}, {_Q} ORDER BY {_METRICS['cosine']}, doc_id LIMIT 12"
_EXACT = f"SELECT doc_id AS k, 1.0 / 61 AS rr FROM {_DOCS} WHERE lang = 'fr'"
_HYBRID = f"(SELECT k, sum(rr) AS score FROM (({_TEXT}) UNION ALL ({_VECTOR}) UNION ALL ({_EXACT})) GROUP BY k)"


def _hybrid(spark, d, least: float = 0.0) -> DataFrame:
    return s.hybrid(_both(spark, d), "doc_id", F.col("lang") == "fr", ("text", _WORDS), ("embedding", _unit(spark, d)), 12, least)


@query("h03_hybrid", f"SELECT k AS doc_id, round(score, 8) AS score FROM {_HYBRID} h ORDER BY h.score DESC, k LIMIT 12")
def _(spark, d):
    return _hybrid(spark, d).select("doc_id", F.round("score", 8).alias("score"))


@query("h04_hybrid_min_score", f"SELECT k AS doc_id, round(score, 8) AS score FROM {_HYBRID} h WHERE h.score >= 0.0165 ORDER BY h.score DESC, k LIMIT 12")
def _(spark, d):
    return _hybrid(spark, d, 0.0165).select("doc_id", F.round("score", 8).alias("score"))


def _hits(spark, d, *terms: str) -> DataFrame:
    return s.search(load(spark, d, "part"), "p_partkey", {"p_name": 1.0}, terms, 30)


def _hits_sql(*terms: str) -> str:
    return f"(SELECT k, score FROM {_scored('part', 'p_partkey', 'p_name', list(terms))} ORDER BY score DESC, k LIMIT 30)"


@query("h05_fuse_mixed", f"""SELECT k AS p_partkey, round(sum(rr), 8) AS score FROM (SELECT k, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, k)) AS rr FROM {_hits_sql('ring', 'red')}
UNION ALL SELECT p_partkey, 1.0 / 61 FROM part WHERE p_size > 45) GROUP BY k""")
def _(spark, d):
    return s.fuse(load(spark, d, "part"), "p_partkey", [F.col("p_size") > 45], [_hits(spark, d, "ring", "red")]).select("p_partkey", F.round("score", 8).alias("score"))


@query("h05_fuse_scored", f"SELECT k AS p_partkey, round(sum(score), 6) AS score FROM (SELECT * FROM {_hits_sql('ring', 'red')} UNION ALL SELECT * FROM {_hits_sql('hot', 'red')}) GROUP BY k")
def _(spark, d):
    return _rounded(s.fuse(load(spark, d, "part"), "p_partkey", [], [_hits(spark, d, "ring", "red"), _hits(spark, d, "hot", "red")]), "p_partkey")


@query("h05_fuse_binary", "SELECT p_partkey, 1.0 AS score FROM part WHERE p_size > 45 AND p_type = 'SMALL'")
def _(spark, d):
    return s.fuse(load(spark, d, "part"), "p_partkey", [F.col("p_size") > 45, F.col("p_type") == "SMALL"])


# ------------------------------------------------------------ live search

_OLD_PART, _NEW_PART = "(SELECT * FROM part WHERE p_partkey % 3 <> 0)", "(SELECT * FROM part WHERE p_partkey % 5 <> 0)"
_LIVE = """SELECT coalesce(o.k, n.k) AS p_partkey, CASE WHEN o.k IS NULL THEN 'ENTER' WHEN n.k IS NULL THEN 'LEAVE' ELSE 'UPDATE' END AS change, round(n.score, 6) AS score
FROM {old} o FULL JOIN {new} n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR abs(o.score - n.score) > {tolerance}"""


def _part_hits(df: DataFrame, limit: int | None = None) -> DataFrame:
    return s.search(df, "p_partkey", {"p_name": 1.0}, ["ring", "red"], limit)


def _operations(spark, d) -> DataFrame:
    """Parts whose key 5 divides are deleted, after an insertion in the same batch; those that 3 but not 5 divides are added."""
    p = load(spark, d, "part").select("p_partkey", "p_name")
    put = p.filter("p_partkey % 3 = 0 or p_partkey % 5 = 0").withColumns({"deleted": F.lit(False), "at": F.lit(1)})
    return put.union(p.filter("p_partkey % 5 = 0").withColumns({"deleted": F.lit(True), "at": F.lit(2)}))


@query("l08_live_search", _LIVE.format(old=_scored(_OLD_PART, "p_partkey", "p_name", ["ring", "red"]), new=_scored(_NEW_PART, "p_partkey", "p_name", ["ring", "red"]), tolerance=0.02))
def _(spark, d):
    p = load(spark, d, "part")
    return _rounded(changes(_part_hits(p.filter("p_partkey % 3 <> 0")), _part_hits(p.filter("p_partkey % 5 <> 0")), "p_partkey", 0.02), "p_partkey", "change")


@query("l09_search_batch", _LIVE.format(old=_scored(_OLD_PART, "p_partkey", "p_name", ["ring", "red"]), new=_scored(_NEW_PART, "p_partkey", "p_name", ["ring", "red"]), tolerance=0))
def _(spark, d):
    old = load(spark, d, "part").filter("p_partkey % 3 <> 0").select("p_partkey", "p_name")
    new = applied(old, latest_operations(_operations(spark, d), "p_partkey", F.col("at")), "p_partkey")
    return _rounded(changes(_part_hits(old), _part_hits(new), "p_partkey", 0.0), "p_partkey", "change")


def _fused_sql(table: str) -> str:
    text = f"SELECT k, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, k)) AS rr FROM {_scored(table, 'p_partkey', 'p_name', ['ring', 'red'])} ORDER BY score DESC, k LIMIT 10"
    return f"(SELECT k, sum(rr) AS score FROM (({text}) UNION ALL (SELECT p_partkey, 1.0 / 61 FROM {table} WHERE p_size = 50)) GROUP BY k ORDER BY score DESC, k LIMIT 20)"


@query("l10_live_hybrid", _LIVE.format(old=_fused_sql(_OLD_PART), new=_fused_sql(_NEW_PART), tolerance="1e-9"))
def _(spark, d):
    p = load(spark, d, "part")
    run = lambda df: s.hybrid(df, "p_partkey", F.col("p_size") == 50, ("p_name", ["ring", "red"]), k=20)
    return _rounded(changes(run(p.filter("p_partkey % 3 <> 0")), run(p.filter("p_partkey % 5 <> 0")), "p_partkey", 1e-9), "p_partkey", "change")


@query("l05_clear", "SELECT p_partkey, 'LEAVE' AS change, CAST(NULL AS VARCHAR) AS p_name FROM part WHERE p_size = 50")
def _(spark, d):
    return cleared(load(spark, d, "part").filter("p_size = 50").select("p_partkey", "p_name"), "p_partkey")


NEW = [n for n in QUERIES if n not in _BEFORE]
