"""Steps whose state must not grow with the number of distinct values or the words of a batch."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.catalog import QUERIES
from quern.functions import text as tx


def test_sketches_are_held_by_flag_only(spark, tmp_path):
    rows = [("A", k) for k in range(300)] * 2 + [("N", 7), (None, None), (None, 3), ("R", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["a15_approximate"](spark, str(tmp_path))
    assert sorted(out.collect(), key=str) == sorted([("A", True), ("N", True), (None, True), ("R", True)], key=str)
    held = re.findall(r"keys=\[([^\]]*)\], functions=\[[^\n]*approx_count_distinct", out._jdf.queryExecution().executedPlan().toString())
    assert held and not any("l_partkey" in keys for keys in held)


def test_stems_of_a_large_batch_stay_small(spark):
    few = spark.createDataFrame([(1, ["running", "cats"]), (2, None), (3, []), (4, ["cats"])], "id long, t array<string>")
    assert {r["id"]: r["s"] for r in few.select("id", tx.stems(F.col("t")).alias("s")).collect()} == {1: ["run", "cat"], 2: None, 3: [], 4: ["cat"]}
    # 2 million tokens: lists of them take 16 MB of Python's memory in and 16 MB out, beside their strings.
    words = pa.array([f"running{k}" for k in range(1000)]).take(pa.array(np.arange(2_000_000) % 1000))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 1000), pa.int32()), words)
    tracemalloc.start()
    got = tx.stemmed(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and len(got) == 2000 and got[1999].as_py() == got[0].as_py() == [tx.stem(f"running{k}") for k in range(1000)]
