"""Line dedup (operator 1): windows of three consecutive lines.

Each window is hashed to 128 bits; a window that also starts earlier, in the
order (doc_id, text hash, line number) over all documents, is a later
occurrence, and the lines it covers are removed (overlapping windows merge).
Each distinct line survives somewhere: a removed line has an equal one earlier.

Cases: null text is empty; a text has one line more than it has newlines; a
text of fewer than three lines has no window; windows whose three lines are
all blank are left alone (they mark layout, not content); rows that repeat id
and text count once and get the same result; a null id sorts first; other
columns are carried along by ``dedup_lines`` and may have any name but those
it adds (``n_lines, n_removed, n_spans, kept_text``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import keyed, of_row, read, whole


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, th, line, h1, h2: one row per window, line counted from 0."""
    lines = keyed(docs).select("doc_id", "th", F.split("text", "\n").alias("l"))
    lines = lines.filter(F.size("l") >= 3)
    rows = lines.select("doc_id", "th", F.posexplode(F.expr(
        "transform(sequence(1, size(l) - 2), i -> if(length(trim(concat(l[i-1], l[i], l[i+1]))) = 0, null, "
        "named_struct('h1', xxhash64(l[i-1], l[i], l[i+1]), 'h2', xxhash64(7, l[i+1], l[i-1], l[i]))))")).alias("line", "w"))
    return rows.filter(F.col("w").isNotNull()).select("doc_id", "th", "line", "w.h1", "w.h2")


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th, line of every window that also starts earlier."""
    w = windows(docs)
    place = F.struct("doc_id", "th", "line")
    first = (
        w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    )
    return w.join(first, ["h1", "h2"]).filter(~F.struct("doc_id", "th", "line").eqNullSafe(F.col("first"))).select("doc_id", "th", "line")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs, with n_lines, n_removed, n_spans (long) and kept_text."""
    hit = later_windows(docs).groupBy("doc_id", "th").agg(F.collect_set("line").alias("starts")).withColumnsRenamed({"doc_id": "at_doc", "th": "at_th"})
    text = F.coalesce(F.col("text"), F.lit(""))
    d = whole(docs, doc_id=F.col("doc_id"), th=F.xxhash64(text))
    out = d.join(hit, d["doc_id"].eqNullSafe(hit["at_doc"]) & (d["th"] == hit["at_th"]), "left")
    cut = "if(starts is null, cast(array() as array<int>), array_sort(array_distinct(flatten(transform(starts, s -> array(s, s + 1, s + 2))))))"
    # Exploded, so that each array is made once and not once for each use.
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n")
    out = out.select("row", F.explode(F.array(F.struct(lines.alias("l"), F.expr(cut).alias("cut")))).alias("x")).select("row", "x.l", "x.cut")
    return out.select(
        *of_row(docs),
        F.size("l").cast("long").alias("n_lines"),
        F.size("cut").cast("long").alias("n_removed"),
        F.expr("cast(size(filter(cut, (x, i) -> i = 0 or cut[i - 1] < x - 1)) as long)").alias("n_spans"),
        F.expr("if(size(cut) = 0, coalesce(row.text, ''), array_join(transform(array_except(sequence(0, size(l) - 1), cut), i -> l[i]), '\n'))").alias("kept_text"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, text, l, unnest(range(0, len(l))) AS line FROM d),
w AS (SELECT doc_id, text, line, l[line + 1] AS a, l[line + 2] AS b, l[line + 3] AS c FROM p
      WHERE line + 2 < len(l) AND length(trim(l[line + 1] || l[line + 2] || l[line + 3])) > 0),
n AS (SELECT doc_id, text, line, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, line) AS k FROM w),
g AS (SELECT DISTINCT doc_id, text, line + o AS line FROM n, (SELECT unnest(range(0, 3)) AS o) WHERE k > 1),
r AS (SELECT p.doc_id, p.text, p.line, p.l[p.line + 1] AS s, g.line IS NOT NULL AS gone
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.text = g.text AND p.line = g.line),
q AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, text ORDER BY line), false) AS starts FROM r)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS n_spans,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM q GROUP BY doc_id, text
"""
