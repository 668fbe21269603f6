"""Other sources and the sinks: CSV, profiles, resumable chunks, JSON parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.columns import fresh
from paneloom.session import discard, materialize, scratch_path


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, nulls, distinct_values`` of the columns, from one aggregate pass."""
    one = df.agg(*[F.struct(F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.countDistinct(c).alias("distinct_values")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns]))
    return one.select(rows.alias("x")).select("x.feature", "x.s.nulls", "x.s.distinct_values")


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header: for small tables only."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def csv_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` by way of a CSV file in the shared folder."""
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def write_chunks(df: DataFrame, key: str, path: str, chunks: int, make: Callable[[DataFrame], DataFrame]) -> int:
    """Resumable sink: ``df`` is cut into ``chunks`` by a hash of ``key`` and only chunks not yet complete under ``path`` are made
    (by ``make``) and written, each into its own folder. Returns how many were written. ``df`` is scanned once, whatever the number of
    missing chunks: their rows are put by, a folder for each, before the first is made."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folder = lambda i: f"{path}/chunk={i:05d}"
    missing = [i for i in range(chunks) if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder(i) + "/_SUCCESS"))]
    if not missing:
        return 0
    (at,) = fresh(df, "chunk")
    rows = df.withColumn(at, F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")).where(F.col(at).isin(missing))
    rows = rows.repartition(at, F.pmod(F.xxhash64(F.lit(1), key), F.lit(16)))  # up to 16 tasks and files a chunk
    apart = materialize(rows, "chunks", by=at)
    try:
        for i in missing:
            make(apart.where(F.col(at) == i).drop(at)).write.mode("overwrite").parquet(folder(i))
    finally:
        discard(apart)
    return len(missing)


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """Parameters as a JSON file of whatever file system ``path`` belongs to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(values, indent=1, sort_keys=True).encode()))
    finally:
        out.close()


def footers(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``file, row_group, rows, feature, nulls, least, greatest`` of the given columns from the footers of the Parquet files under
    ``path``: no data page is read. Limits are written as text and null where a file has no statistics of a column. Footers are read on the
    executors, one file a row."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "/*.parquet")) if fs.getFileStatus(hadoop).isDirectory() else [fs.getFileStatus(hadoop)]
    files = sorted(s.getPath().toString() for s in status)
    wanted = list(columns)

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for file in batch.column(0).to_pylist():
                system, inside = pafs.FileSystem.from_uri(file)
                with system.open_input_file(inside) as source:
                    meta = pq.ParquetFile(source).metadata
                places = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in wanted:
                        s = group.column(places[c]).statistics if c in places else None
                        ends = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        out.append((file, g, group.num_rows, c, s.null_count if s is not None and s.has_null_count else None, *ends))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=["file", "row_group", "rows", "feature", "nulls", "least", "greatest"])

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return listed.mapInArrow(read, "file string, row_group int, rows long, feature string, nulls long, least string, greatest string")


def schema_table(df: DataFrame) -> DataFrame:
    """``place, feature, type`` of each column of ``df``, from metadata alone."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "place int, feature string, type string")


def cache_or_compute(spark: SparkSession, root: str, name: str, params: dict, make: Callable[[], DataFrame], columns: Sequence[str] = ()) -> DataFrame:
    """The table made with ``params``, read back if it was made before. The path holds a hash of the parameters, and only a
    complete table with all ``columns`` is reused, so neither other parameters nor a broken run can be taken for it."""
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{key}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        old = spark.read.parquet(path)
        if set(columns) <= set(old.columns):
            return old
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_submission(book: DataFrame, ledger: DataFrame, folder: str, cap: float) -> None:
    """Holdings (``month, permno, weight``, one row a name and month) and monthly returns as CSV, if they keep the rules: no
    null or repeated key, no weight above ``cap``, legs of 1 and -1, the same months in both; else ValueError and no file."""
    w = F.col("weight")
    by = book.groupBy("month").agg(F.sum(F.when(w > 0, w)).alias("long"), F.sum(F.when(w < 0, w)).alias("short"))
    broken = {
        "null or repeated names": book.groupBy("month", "permno").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("k")).where("n > 1 or k < n or month is null or permno is null"),
        "weights above the cap": book.where(F.abs(w) > cap + 1e-9),
        "legs": by.where((F.abs(F.col("long") - 1) > 1e-5) | (F.abs(F.col("short") + 1) > 1e-5) | F.col("long").isNull() | F.col("short").isNull()),
        "months": by.select("month").join(ledger.select("month").withColumn("there", F.lit(1)), "month", "full_outer").join(by.select("month", "long"), "month", "left").where("there is null or long is null"),
    }
    if found := [name for name, rows in broken.items() if rows.limit(1).count()]:
        raise ValueError(f"not submitted: {', '.join(found)}")
    write_csv(book.select("month", "permno", "weight").orderBy("month", "permno"), f"{folder}/holdings")
    write_csv(ledger.orderBy("month"), f"{folder}/returns")
