"""Readers and writers of the audit's files: declared schemas, checked columns, one table for all files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vendor headers of the sensor streams and the names they get.
SENSOR_NAMES = {
    "accel": {"Accelerometer [m/s²]": "ax_raw", "1": "ay_raw", "2": "az_raw"},
    "gyro": {"Gyroscope [rad/s]": "gx_raw", "1": "gy_raw", "2": "gz_raw"},
    "gps": {"GPS (Lat.) [deg]": "lat", "GPS (Long.) [deg]": "lon", "GPS (2D speed) [m/s]": "speed_ms"},
}
TELEMETRY_COLUMNS = ("cts", "ax_raw", "ay_raw", "az_raw")
GOLD_COLUMNS = ("clip_id", "start_time", "end_time")


def require(df: DataFrame, wanted: Sequence[str], what: str) -> DataFrame:
    """``df`` with trimmed column names; an error names what is missing and what was found."""
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")
    return df


def _separator(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"no rows in {path}")
    return "\t" if "\t" in head[0][0] else ","


def read_delimited(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Comma- or tab-separated text with a header, all columns as strings; the separator is that of the first line."""
    return spark.read.csv(path, header=True, sep=_separator(spark, path), encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as numbers; what is not one becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def clip_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def read_clips(spark: SparkSession, folder: str, columns: Sequence[str] = TELEMETRY_COLUMNS) -> DataFrame:
    """All CSV files of a folder as one table; clip_id is the file's stem."""
    path = f"{folder.rstrip('/')}/*.csv"
    raw = spark.read.csv(path, header=True, sep=_separator(spark, path))
    named = require(raw.withColumn("clip_id", clip_of_file()), columns, folder)
    return numeric(named, [c for c in named.columns if c not in ("clip_id", "date", "video_ts", "evasive_type")])


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    named = require(read_delimited(spark, path), TELEMETRY_COLUMNS, path)
    return numeric(named, [c for c in named.columns if c not in ("clip_id", "date", "video_ts", "evasive_type")])


def read_sensor_stream(spark: SparkSession, path: str, kind: str, clip: str | None = None) -> DataFrame:
    """A vendor stream: headers renamed, milliseconds to seconds, speed to km/h."""
    names = SENSOR_NAMES[kind]
    raw = require(read_delimited(spark, path), ["cts", *names], path).withColumnsRenamed(names)
    out = numeric(raw, ["cts", *names.values()]).withColumn("cts", F.col("cts") / 1000)
    if kind == "gps":
        out = out.withColumn("speed_kmh", F.col("speed_ms") * 3.6).drop("speed_ms")
    return out.withColumn("clip_id", F.lit(clip)) if clip else out


def seconds(df: DataFrame, time: str = "cts", above: float = 10_000.0) -> DataFrame:
    """Times as seconds: where the largest exceeds ``above`` they were milliseconds."""
    most = df.agg(F.max(time).alias("_most"))
    return df.crossJoin(most).withColumn(time, F.when(F.col("_most") > above, F.col(time) / 1000).otherwise(F.col(time))).drop("_most")  # single-row scalar


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return numeric(require(read_delimited(spark, path), GOLD_COLUMNS, path), GOLD_COLUMNS[1:])


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    df = require(read_delimited(spark, path), ["decision"], path)
    return df.withColumn("decision", F.lower(F.trim("decision")))


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl_last(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "event_id") -> DataFrame:
    """Lines of JSON; of lines with one key the last of its file counts."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "_file", "_line").where("r is not null").select("r.*", "_file", "_line")
    w = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_line"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file", "_line")


def read_text_any(spark: SparkSession, path: str) -> DataFrame:
    """file, value: lines of files that are UTF-8, or else Windows-1252, decided for each file."""
    files = spark.read.format("binaryFile").load(path)
    # Windows-1252 is Latin-1 but for the bytes 0x80 to 0x9F.
    high = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    before, after = "".join(a for a, b in high if b), "".join(b for _, b in high if b)
    western = F.translate(F.decode("content", "ISO-8859-1"), before, after)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(western)
    return files.select(F.col("path").alias("file"), F.explode(F.split(text, r"\r?\n")).alias("value")).where("value <> ''")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """clause_id, text from JSON files: {id: text}, {id: {text}}, or a list of records; a later file's clause wins."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    is_list = F.rlike(F.trim("value"), F.lit(r"(?s)^\["))
    flat = files.where(~is_list).select("file", F.explode(F.from_json("value", "map<string, string>")).alias("clause_id", "raw"))
    flat = flat.select("file", "clause_id", F.coalesce(F.get_json_object("raw", "$.text"), F.get_json_object("raw", "$.clause_text"), "raw").alias("text"))
    record = "array<struct<clause_id: string, id: string, clause: string, text: string, clause_text: string>>"
    listed = files.where(is_list).select("file", F.explode(F.from_json("value", record)).alias("r"))
    listed = listed.select("file", F.coalesce("r.clause_id", "r.id", "r.clause").alias("clause_id"), F.coalesce("r.text", "r.clause_text").alias("text"))
    return flat.unionByName(listed).where("clause_id is not null").groupBy("clause_id").agg(F.max_by("text", "file").alias("text"))


def read_clause_texts(spark: SparkSession, path: str) -> DataFrame:
    """clause_key ``<doc>_<clause>``, text from lines of JSON (doc, clause, text); a later file's text wins."""
    rows = spark.read.schema("doc string, clause string, text string").json(path).withColumn("_file", F.col("_metadata.file_path"))
    return rows.where("doc is not null and clause is not null").groupBy(F.concat_ws("_", "doc", "clause").alias("clause_key")).agg(F.max_by("text", F.struct("_file", "text")).alias("text"))


def write_named(df: DataFrame, folder: str, by: str, sep: str = ",") -> None:
    """One CSV file for each value of ``by``, named by it (``<value>.csv``), with a header."""
    spark = df.sparkSession
    df.repartition(by).write.mode("overwrite").partitionBy(by).option("header", True).option("sep", sep).csv(f"{folder}/_parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(path(f"{folder}/_parts/{by}=*/*.csv")):  # one file a value: metadata alone
        value = part.getPath().getParent().getName().split("=", 1)[1]
        files.rename(part.getPath(), path(f"{folder}/{value}.csv"))
    files.delete(path(f"{folder}/_parts"), True)


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``results_<model>_<config>.csv`` files with their model and config."""
    df = spark.read.csv(f"{folder.rstrip('/')}/results_*.csv", header=True)
    name = F.col("_metadata.file_name")
    return df.withColumns({"model": F.regexp_extract(name, r"^results_([^_]+)_(.+)\.csv$", 1), "config": F.regexp_extract(name, r"^results_([^_]+)_(.+)\.csv$", 2)})


def append_new(df: DataFrame, path: str, key: str, present: bool) -> None:
    """Append the rows whose key the Parquet table at ``path`` lacks, one a key; ``present``: whether it is there yet.

    Of rows that repeat a key the one of the least hash of all columns is written.
    """
    every = F.struct(*df.columns)
    df = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(every, F.xxhash64(*df.columns)).alias("_row")).select("_row.*")
    new = df.join(df.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti") if present else df
    new.write.mode("append").parquet(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """value: one line of a Markdown table for each row, missing values as NA."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns]), F.lit(" |")).alias("value"))


#: Writer's options for large texts: compressed (ids repeat much), a file of so many lines, as one task reads a compressed file.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "2000000"}


def write_nodes_json(nodes: DataFrame, edges: DataFrame, folder: str, **options: str) -> None:
    """Node-link JSON lines in two folders; ``options`` are the writer's."""
    nodes.write.mode("overwrite").options(**options).json(f"{folder}/nodes")
    edges.write.mode("overwrite").options(**options).json(f"{folder}/links")
