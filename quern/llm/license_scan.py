"""License scan (operator 4): ordered signature rules, with DataFrame functions only.

Words are the runs of letters, digits and non-ASCII characters of the text with
A-Z in lower case, joined by blanks. A short list of roots gates the texts; for
those that hold one, each rule whose keyword occurs runs its regex on whole words.
A detection is an interval of the text with a priority (1 is best): it is
suppressed if it lies within another of the same or a better priority that
starts earlier, or at the same place and ends no earlier (ties: the rule's order);
and it is suppressed where one of a better priority overlaps it.

Base phrases are counted apart, at all their places, and their labels always stay.

Cases: null and empty texts have no words; rows that repeat id and text are one
document, with the same result in each row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import keyed, read
from quern.llm.license_rules import rules

#: Fixed values of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Every rule's keyword holds one of these.
ROOTS = ["licen", "spdx", "cc by", "cc0", "creative", "gpl", "mpl", "bsd", "cddl", "odbl", "wtfpl", "rail", "cecill", "expat", "etalab", "mulan", "beer",
         "public domain", "permission is hereby", "hereby granted", "redistribution and use", "neither the name of", "advertising materials", "this software is provided",
         "open data commons", "w3c", "classpath", "commons clause", "polyform", "same terms as", "do what the", "used for good", "attribution",
         "rights reserved", "tous droits", "derechos reservados", "rechte vorbehalten", "lizen", "apache 2", "zlib", "unencumbered", "proprietary", "commercial use", "released under", "terms of the", "copyright"]
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words joined by blanks. The two letters outside ASCII whose lower case has an ASCII letter are kept from it."""
    apart = F.translate(text, "Kİ", "ķı")
    return F.trim(F.regexp_replace(F.lower(apart), _OTHER, " "))


def count_words(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def detections(joined: DataFrame) -> DataFrame:
    """doc_id, th, start, end (places in the joined words, end after the last), priority, number, label."""
    gate = F.lit(False)
    for r in ROOTS:
        gate = gate | F.col("w").contains(r)
    # One literal, parsed once: some hundreds of rules, whatever the input.
    text = json.dumps([{"number": n, "priority": p, "keyword": k, "label": label, "regex": f"(?<![^ ]){x}(?![^ ])"} for n, p, k, label, x in rules()])
    array = F.from_json(F.lit(text), "array<struct<number: int, priority: int, keyword: string, label: string, regex: string>>")
    rows = joined.filter(gate).dropDuplicates(["doc_id", "th"])
    hit = rows.select("doc_id", "th", "w", F.explode(F.filter(array, lambda x: F.col("w").contains(x["keyword"]))).alias("r"))
    found = hit.select("doc_id", "th", "r", F.expr("regexp_extract_all(w, r.regex, 0)").alias("m"), F.expr("split(w, r.regex)").alias("parts")).filter(F.size("m") > 0)
    # A match starts after the parts and matches before it.
    places = F.expr("""aggregate(sequence(1, size(m)),
        named_struct('at', 0L, 'out', cast(array() as array<struct<s: bigint, e: bigint>>)),
        (a, i) -> named_struct('at', a.at + length(parts[i - 1]) + length(m[i - 1]),
            'out', concat(a.out, array(named_struct('s', a.at + length(parts[i - 1]), 'e', a.at + length(parts[i - 1]) + length(m[i - 1]))))),
        a -> a.out)""")
    return found.select("doc_id", "th", "r", F.explode(places).alias("p")).select("doc_id", "th", F.col("p.s").alias("start"), F.col("p.e").alias("end"), "r.priority", "r.number", "r.label")


def surviving(found: DataFrame) -> DataFrame:
    """Detections that nothing suppresses."""
    w = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"), "priority", "number").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "th").orderBy(F.desc("start"), "end", F.desc("priority"), F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    better = lambda p, c, f: F.when(F.col("priority") == p, f(F.when(F.col("priority") < p, F.col(c))))
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(w)) for p in (1, 2, 3)])
    before = F.coalesce(*[better(p, "end", lambda c: F.max(c).over(w)) for p in (2, 3)])
    behind = F.coalesce(*[better(p, "start", lambda c: F.min(c).over(after)) for p in (2, 3)])
    inside = F.coalesce(reach >= F.col("end"), F.lit(False))
    overlapped = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    marked = found.withColumn("gone", inside | overlapped)
    return marked.filter("not gone").drop("gone")


def base(joined: Column) -> tuple[Column, Column, Column, Column]:
    """n_base, first_word, last_word, base_labels of the base phrases."""
    n, first, last, labels = F.lit(0), [], [], []
    for phrase, label in PHRASES.items():
        parts = F.when(joined.contains(phrase), F.split(joined, f"(?<![^ ]){phrase}(?![^ ])")).otherwise(F.array(joined))
        k = F.size(parts) - 1
        length = phrase.count(" ") + 1
        n = n + k
        held = k > 0
        first.append(F.when(held, count_words(F.trim(parts[0]))))
        last.append(F.when(held, count_words(joined) - length - count_words(F.trim(F.element_at(parts, -1)))))
        labels.append(F.when(held, F.lit(label)))
    return n.cast("long"), F.least(*first), F.greatest(*last), F.array_sort(F.array_compact(F.array(*labels)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (characters in detections, to four a word)."""
    # Exploded, so that filters on the words aren't pushed below with a copy of their expression for each use.
    joined = keyed(docs).select("doc_id", "th", F.explode(F.array(words(F.col("text")))).alias("w"))
    n, first, last, labels = base(F.col("w"))
    rows = joined.select("doc_id", "th", count_words(F.col("w")).alias("n_words"), n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("b"))
    # Covered places are counted once: each detection adds what lies after all earlier ones.
    w = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"), "number").rowsBetween(Window.unboundedPreceding, -1)
    kept = surviving(detections(joined))
    kept = kept.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0)))))
    kept = kept.groupBy("doc_id", "th").agg(F.collect_set("label").alias("found"), F.sum("new").alias("covered"))
    kept = kept.withColumnsRenamed({"doc_id": "at_doc", "th": "at_th"})
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["at_doc"]) & (rows["th"] == kept["at_th"]), "left")
    all_labels = F.array_sort(F.array_union("b", F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.col("covered").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.round(F.col("covered") / (F.col("n_words") * 4), 6)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
