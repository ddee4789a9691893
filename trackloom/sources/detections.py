"""Sources and sinks of detection records, and the stand-in tables derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

#: One row per detection. Labels are opaque strings; pos makes ties deterministic.
DETECTION = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("sample_index", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("t", "x", "y", "w", "h", "score")], T.StructField("class_id", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("pos", T.IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_cache(spark: SparkSession, path: str, schema: T.StructType = DETECTION, arrays: bool = False) -> DataFrame:
    """Gzip or plain JSON records, one schema for all (S1, S2, S4). arrays: each file is one list of records. What can't be read becomes _corrupt_record; files
    that can't be opened are skipped. _file_hash: the sixteen hex digits in the file's name, null if there are none."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreCorruptFiles", "true")
    found = F.regexp_extract(F.col("_metadata.file_name"), r"([0-9a-f]{16})", 1)
    return reader.option("multiLine", str(arrays).lower()).json(path).withColumn("_file_hash", F.nullif(found, F.lit("")))


def readable(records: DataFrame) -> DataFrame:
    """The records that could be read, without the column of those that couldn't."""
    return records.where("_corrupt_record is null").drop("_corrupt_record")


def unreadable_counts(records: DataFrame) -> DataFrame:
    """How many records of each file couldn't be read (S4): _file_hash, n."""
    return records.where("_corrupt_record is not null").groupBy("_file_hash").agg(F.count("*").alias("n"))


class CachedScans:
    """Parsed tables kept by path until the path's files change (S3)."""

    def __init__(self, spark: SparkSession, read):
        self.spark, self.read, self.held = spark, read, {}

    def version(self, path: str) -> tuple:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        out = []
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
        return tuple(sorted(out))

    def get(self, path: str) -> DataFrame:
        version = self.version(path)
        known = self.held.get(path)
        if known and known[0] == version:
            return known[1]
        self.forget(path)
        self.held[path] = version, self.read(self.spark, path).cache()
        return self.held[path][1]

    def forget(self, path: str) -> None:
        if path in self.held:
            self.held.pop(path)[1].unpersist()


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def append_run_log(df: DataFrame, path: str, failed: str) -> None:
    """Append run rows, those of failed runs to a log of their own."""
    append_json_lines(df.where(f"not coalesce({failed}, false)"), f"{path}/runs")
    append_json_lines(df.where(f"coalesce({failed}, false)"), f"{path}/failures")


def write_detections(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, committed as a whole, partitioned by what caches are looked up by."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def lookup(spark: SparkSession, path: str, **settings) -> DataFrame:
    """The cached rows of these settings: a predicate on partition columns, so only their folders are read."""
    out = spark.read.parquet(path)
    for name, value in settings.items():
        out = out.where(F.col(name) == value)
    return out


def tolerant_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed rows and whether each was malformed (S7); blank lines are left out."""
    some = lines.where(F.trim(column) != "")
    parsed = some.select(F.from_json(column, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").withColumn("malformed", F.col("_bad").isNotNull()).drop("_bad")


def skipped(parsed: DataFrame) -> DataFrame:
    """One row: good rows and skipped ones."""
    return parsed.agg(F.count_if(~F.col("malformed")).alias("rows"), F.count_if("malformed").alias("skipped"))


def sample_times(entities: DataFrame, offset: float = 0.0) -> DataFrame:
    """entities (entity_id, n, fps, native_fps): the sampling grid with frame indexes, floored but for the first, which rounds."""
    grid = entities.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    at = F.lit(offset) + F.col("i") / F.col("fps")
    return grid.withColumn("sample_time", at).withColumn("frame", F.when(F.col("i") == 0, F.bround(at * F.col("native_fps"))).otherwise(F.floor(at * F.col("native_fps"))).cast("long"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections derived from lineitem: an order is an instant of one of sixteen entities."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    instant = F.col("l_orderkey") - F.col("l_orderkey") % 16
    return li.select(
        (F.col("l_orderkey") % 16).alias("entity_id"),
        F.expr("(l_orderkey - l_orderkey % 16) div 16").alias("sample_index"),
        (instant / F.lit(16).cast("double") / F.lit(10).cast("double")).alias("t"),
        F.when(F.col("l_returnflag") == "A", "label_a").when(F.col("l_returnflag") == "N", "label_b").otherwise("label_c").alias("class_id"),
        ((F.col("l_partkey") * 37) % 300).cast("double").alias("x"),
        ((F.col("l_suppkey") * 53) % 200).cast("double").alias("y"),
        (40 + F.col("l_quantity") * 4).cast("double").alias("w"),
        (60 + (F.col("l_partkey") % 7) * 20).cast("double").alias("h"),
        (((F.col("l_partkey") * 17 + F.col("l_suppkey") * 29 + F.col("l_linenumber") * 13) % 1000).cast("double") / 1000).alias("score"),
        F.when(F.col("l_linestatus") == "F", 320).otherwise(640).alias("size"),
        F.row_number().over(order).alias("pos"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (entity_id, t in seconds, label, value, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(1e6)).alias("t"), F.col("event_type").alias("label"), "value", "event_id")


DET_SQL = """det AS (SELECT CAST(l_orderkey % 16 AS BIGINT) AS entity_id, CAST((l_orderkey - l_orderkey % 16) / 16 AS BIGINT) AS sample_index,
 CAST((l_orderkey - l_orderkey % 16) / 16 AS DOUBLE) / CAST(10 AS DOUBLE) AS t,
 CASE l_returnflag WHEN 'A' THEN 'label_a' WHEN 'N' THEN 'label_b' ELSE 'label_c' END AS class_id,
 CAST((l_partkey * 37) % 300 AS DOUBLE) AS x, CAST((l_suppkey * 53) % 200 AS DOUBLE) AS y, CAST(40 + l_quantity * 4 AS DOUBLE) AS w, CAST(60 + (l_partkey % 7) * 20 AS DOUBLE) AS h,
 CAST((l_partkey * 17 + l_suppkey * 29 + l_linenumber * 13) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score, CASE WHEN l_linestatus = 'F' THEN 320 ELSE 640 END AS size,
 ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS pos FROM lineitem)"""
EV_SQL = "ev AS (SELECT user_id AS entity_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_type AS label, value, event_id FROM events)"
