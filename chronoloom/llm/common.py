"""Pieces that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Into so many runs a hot key is spread before anything is grouped or joined on it.
RUNS = 64
#: A table of keys is broadcast only if a count shows that it has no more rows; a row is two numbers. Larger ones are shuffled.
BROADCAST_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was given. It is an error if there is none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []
#: Spark removes the shuffle files of a query as soon as it has ended, where this is true.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it has ended, and not when the driver next collects garbage: for queries whose rows are written or collected by then."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, what cut() holds is removed at the end, and what queries shuffle as they end: for work whose result is written by then."""
    folders: list[str] = []
    _scratch.append(folders)
    try:
        with shuffles_removed(spark):
            yield
    finally:
        _scratch.remove(folders)
        for at in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and held as a table in the shared folder: later work neither repeats it nor loses it with an executor, and the planner knows its size."""
    at = new_folder(df.sparkSession, "cut")
    if _scratch:
        _scratch[-1].append(at)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the built-in is quicker, and the same where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents from which no model may learn. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(value: Column, kind: T.DataType) -> Column:
    """value in a form that the hash functions take: maps as their sorted entries, variants as JSON, at any depth."""
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        entries = F.transform(F.map_entries(value), lambda x: _hashable(x, entry))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType)) if _odd(kind) else value
    if isinstance(kind, T.StructType) and _odd(kind):
        fields = [_hashable(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _odd(kind: T.DataType) -> bool:
    """Whether a type holds a map or a variant."""
    if isinstance(kind, T.ArrayType):
        return _odd(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_odd(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType | T.VariantType)


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes over all columns of a row, of any type. They are the same however the table is split and in whatever order it is read; rows with equal keys are repeats of one another."""
    columns = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    nulls = F.array(*(c.isNull() for c in columns))
    return F.xxhash64(F.lit("a"), nulls, *columns), F.xxhash64(F.lit("b"), nulls, *columns)


def narrow(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast where a count shows that it is small, else to be hashed in the tasks of a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


def drop_rows(docs: DataFrame, gone: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key (_k1, _k2) is in gone, and with one row of those whose key is in repeats. Both have a key once, and are held already.

    Texts are shuffled only where the keys are too many to broadcast. All columns stay as they are.
    """
    names = [free_name(docs, "_k1"), free_name(docs, "_k2")]
    one, two = row_key(docs)
    own = lambda keys: narrow(keys.select(F.col("_k1").alias(names[0]), F.col("_k2").alias(names[1])))
    left = docs.withColumns({names[0]: one, names[1]: two}).join(own(gone), names, "left_anti")
    if repeats is not None and not repeats.isEmpty():
        twice = own(repeats)
        left = left.join(twice, names, "left_anti").unionAll(left.join(twice, names, "left_semi").dropDuplicates(names))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def lookup(rows: DataFrame, values: DataFrame, key: list[str], spread: Column) -> DataFrame:
    """rows with the columns of values for their key (a left join; values has a key once at most).

    No task gets all rows of a hot key: values first meets one row for each key and run, at most RUNS for a key,
    and the rows then join on key and run. Null keys find nothing.
    """
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(spread), F.lit(RUNS)).cast("int"))
    runs = rows.select(*key, "_run").distinct().join(values, key)
    return rows.join(runs, [*key, "_run"], "left").drop("_run")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_map(df: DataFrame, names: list[str], make: Callable[[], Callable[..., dict]], schema: str) -> DataFrame:
    """One result row for each row of df: make() gives a function once in a task; it maps lists of the named columns to a dict of lists."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            got = f(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.select(*names).mapInArrow(run, schema)
