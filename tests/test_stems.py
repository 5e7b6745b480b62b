"""The stems of whole texts of all documents, against plain Python."""

import re

from oracle import DATA

from quern.functions.text import STOPWORDS, stem
from quern.catalog import QUERIES


def test_all_stems_of_all_documents(spark, tmp_path):
    extra = [(10**6, "Running " * 50 + "the end", "en"), (10**6 + 1, "Häuser und Straßen, 2 x 42 " * 9, "de"), (10**6 + 2, None, None), (10**6 + 3, "", "fr")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return " ".join(stem(w) for w in words if 2 <= len(w) <= 40 and w not in STOPWORDS)

    want = {r["doc_id"]: r["text"] and brute(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["stems"] for r in QUERIES["t01_stems"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 200
