"""Keyed tables: schemas, validation, Parquet and JDBC sources."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The key of each of the driver's tables.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "timestamp": T.TimestampNTZType(), "map": T.StringType(), "any": T.StringType()}


@dataclass(frozen=True)
class Field:
    """A field of a map: its type (array of X as "array:X"), whether it is required, and its constraints."""

    type: str = "any"
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min_value: int | None = None
    max_value: int | None = None
    pattern: str | None = None
    enum: tuple[str, ...] | None = None


@dataclass(frozen=True)
class MapSchema:
    fields: Mapping[str, Field]
    version: int = 1
    strict: bool = False
    key: tuple[str, ...] = field(default=())


def spark_type(name: str) -> T.DataType:
    return T.ArrayType(spark_type(name.removeprefix("array:")), True) if name.startswith("array:") else TYPES[name]


def struct_of(schema: MapSchema) -> T.StructType:
    """_key first and not null, then the fields; required ones not null."""
    return T.StructType([T.StructField("_key", T.StringType(), False), *(T.StructField(n, spark_type(f.type), not f.required) for n, f in schema.fields.items())])


def conform(df: DataFrame, schema: MapSchema) -> DataFrame:
    """Columns of the schema in its types; what can't be cast is null."""
    have = set(df.columns)
    return df.select(*[(F.col(n).try_cast(spark_type(f.type)) if n in have else F.lit(None).cast(spark_type(f.type))).alias(n) for n, f in schema.fields.items()])


def violations(schema: MapSchema, columns: list[str]) -> Column:
    """An array of messages for a row: all that its constraints say against it."""
    tests: list[tuple[Column, str]] = []
    for n, f in schema.fields.items():
        if n not in columns:
            if f.required:
                tests.append((F.lit(True), f"{n}: required"))
            continue
        c = F.col(n)
        size = F.size(c) if f.type.startswith("array:") else F.length(c.cast("string"))
        tests += [(c.isNull(), f"{n}: required")] * f.required
        tests += [(size < f.min_length, f"{n}: shorter than {f.min_length}")] * (f.min_length is not None)
        tests += [(size > f.max_length, f"{n}: longer than {f.max_length}")] * (f.max_length is not None)
        if f.type in ("int", "timestamp"):
            tests += [(c < f.min_value, f"{n}: less than {f.min_value}")] * (f.min_value is not None)
            tests += [(c > f.max_value, f"{n}: more than {f.max_value}")] * (f.max_value is not None)
        tests += [(~c.rlike(f.pattern), f"{n}: does not match")] * (f.pattern is not None) if f.pattern else []
        tests += [(~c.isin(list(f.enum)), f"{n}: not among the values")] if f.enum else []
    if schema.strict:
        tests += [(F.lit(True), f"{n}: unknown") for n in columns if n not in schema.fields and n != "_key"]
    return F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests])) if tests else F.array().cast("array<string>")


def with_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """_key before all columns: the columns' texts joined by a dash."""
    return df.select(F.concat_ws("-", *[F.col(c).cast("string") for c in columns]).alias("_key"), "*")


def load(spark: SparkSession, sf_dir: str, name: str, keyed: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return with_key(df, KEYS[name]) if keyed else df


def entries(df: DataFrame) -> DataFrame:
    """key, value (JSON) of each row: the key is _key, else __key; a row without either gets a made one; a row's single _value stands for itself."""
    held = [c for c in ("_key", "__key") if c in df.columns]
    key = F.coalesce(*[F.col(c).cast("string") for c in held], F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string")))
    rest = [c for c in df.columns if c not in ("_key", "__key")]
    value = F.to_json(F.struct(*rest)) if rest != ["_value"] else F.col("_value").cast("string")
    return df.select(key.alias("key"), value.alias("value"))


def load_jdbc(spark: SparkSession, url: str, name: str, partition_column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A table of a database, read in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions).load()


def save(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Parquet; sorted within files where given, so that row groups can be skipped."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").parquet(path)


def inferred(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, type, values: each column's type, and its values where there are 2 to 10 distinct strings."""
    kinds = dict(df.dtypes)
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("type"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    # Distinct first: at most one row a value reaches the count.
    found = rows.distinct().groupBy("name", "type").agg(F.count("v").alias("n"))
    few = found.filter("type = 'string' and n between 2 and 10").select("name")
    values = rows.join(few, "name", "left_semi").groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("v")), ",").alias("values"))
    return found.join(values, "name", "left").select("name", "type", "values")
