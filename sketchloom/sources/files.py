"""Readers of user-bin lists, sequences, precomputed hashes, sketches and layout files.

All go through Spark's own readers, so any store that Spark can open will do."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.sources import datasource


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, through Spark's file system, whatever the store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_lines(lines: DataFrame, path: str) -> None:
    """Rows (at, value) as one text file in the order of ``at``: sorted by all tasks, written by one
    as a stream, and moved to its name when the job has succeeded."""
    spark = lines.sparkSession
    held = f"{path}-{uuid.uuid4().hex}"
    lines.orderBy("at").select("value").coalesce(1).write.text(held)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(held).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(fs_path(held)) if x.getPath().getName().startswith("part-"))
    fs.delete(fs_path(path), False)
    fs.rename(part, fs_path(path))
    fs.delete(fs_path(held), True)


def missing(spark: SparkSession, names: list[str]) -> list[str]:
    """Those of the files that don't exist; every folder is listed once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    by_folder: dict[str, list[tuple[str, str]]] = {}
    for n in names:
        folder, _, name = n.rpartition("/")
        if not name or name in (".", ".."):  # what only a path can tell
            p = jvm.org.apache.hadoop.fs.Path(n)
            folder, name = str(p.getParent() or "."), p.getName()
        by_folder.setdefault(folder or ("/" if n.startswith("/") else "."), []).append((name, n))
    out = []
    for folder, files in by_folder.items():
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(conf)
        found = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(p)) if fs.exists(p) else None
        listing = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(found).mkString("\n") if found else ""  # one call, not some for each file
        there = {name.rsplit("/", 1)[-1] for name in listing.split("\n")}
        out += [n for name, n in files if name not in there]
    return sorted(out)


def user_bins(spark: SparkSession, path: str) -> DataFrame:
    """(ub_id, files): one line a user bin; files split by single spaces up to the first tab."""
    if not exists(spark, path):
        raise ValueError(f"The file {path} does not exist.")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("ub_id", "line"))
    out = lines.select(F.col("ub_id").cast("long"), F.split(F.substring_index("line", "\t", 1), " ").alias("files"))
    if out.isEmpty() or out.where(F.array_join("files", "") != "").isEmpty():
        raise ValueError(f"The file {path} appears to be empty.")
    if not out.where(F.array_join("files", "") == "").isEmpty():
        raise ValueError(f"The file {path} has an empty line.")
    return out


def check_files(spark: SparkSession, bins: DataFrame) -> bool:
    """Whether the files hold precomputed hashes; all must or none, and all must exist."""
    names = [r[0] for r in bins.select(F.explode("files")).distinct().toLocalIterator()]
    if lost := missing(spark, names):
        raise ValueError(f"File {lost[0]} does not exist!")
    kinds = {n.lower().endswith(".minimiser") for n in names}
    if len(kinds) > 1:
        first = bins.orderBy("ub_id").first()["files"][0].lower().endswith(".minimiser")
        odd = min(n for n in names if n.lower().endswith(".minimiser") != first)
        if first:
            raise ValueError(f"You are providing precomputed files but the file {odd} does not have the correct file extension (.minimiser). Mixing non-/precomputed files is not allowed.")
        raise ValueError(f"You are providing sequence files but the file {odd} was identified as a precomputed file (.minimiser). Mixing non-/precomputed files is not allowed.")
    return kinds == {True}


def _files(bins: DataFrame) -> DataFrame:
    return bins.select("ub_id", F.explode("files").alias("file"))


def sequences(spark: SparkSession, bins: DataFrame) -> DataFrame:
    """(ub_id, file, id, seq) of FASTA or FASTQ files, plain or gzipped.

    Both are read as text whose records end where a line starts with the format's mark, so a
    large plain file is read by many tasks. Of FASTQ only records of four lines are known."""
    wanted = _files(bins)
    paths = sorted({r[0] for r in wanted.select("file").distinct().toLocalIterator()})
    fastq = [p for p in paths if p.lower().removesuffix(".gz").endswith((".fq", ".fastq"))]
    fasta = [p for p in paths if p not in set(fastq)]
    parts = []
    for names, mark in ((fasta, ">"), (fastq, "@")):
        if not names:
            continue
        value = F.regexp_replace("value", rf"^\s*{mark}", "")  # only a file's first record keeps its mark
        raw = spark.read.option("lineSep", f"\n{mark}").text(names).select(value.alias("value"), F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
        head = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")).alias("id")
        if mark == ">":
            rest = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
            parts.append(raw.select("path", head, F.translate(rest, "\n\r\t ", "").alias("seq")))
        else:  # a quality line that starts with the mark is a piece of one line: no record
            lines = F.split("value", "\n")
            record = raw.where((F.size(lines) >= 3) & F.startswith(F.get(lines, 2), F.lit("+")))
            parts.append(record.select("path", head, F.translate(F.get(lines, 1), "\r\t ", "").alias("seq")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _attach(spark, wanted, out).select("ub_id", "file", "id", "seq")


def file_sizes(spark: SparkSession, bins: DataFrame) -> DataFrame:
    """(ub_id, file, bytes): the size of the first file of each user bin."""
    first = bins.select("ub_id", F.get("files", 0).alias("file"))
    paths = sorted({r[0] for r in first.select("file").distinct().toLocalIterator()})
    found = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    return _attach(spark, first, found).select("ub_id", "file", "bytes")


def _working_folder(spark: SparkSession) -> str:
    return str(spark._jvm.org.apache.hadoop.fs.Path(".").getFileSystem(spark._jsc.hadoopConfiguration()).getWorkingDirectory())


def _attach(spark: SparkSession, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Join rows read from ``path`` to the user bins that list the file."""
    tail = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/*", "/"), "^/+", "/")
    cwd = _working_folder(spark)
    absolute = F.when(F.col("file").rlike("^([a-z0-9]+:)?/"), F.col("file")).otherwise(F.concat(F.lit(cwd + "/"), F.col("file")))
    return rows.withColumn("p", tail(F.col("path"))).join(wanted.withColumn("p", tail(absolute)), "p")


def precomputed(spark: SparkSession, bins: DataFrame) -> DataFrame:
    """(ub_id, h) of files of consecutive little-endian 8-byte values; a short tail is dropped.

    Files that Arrow can open are read in ranges of bytes, of any size; others whole, a row each."""
    wanted = _files(bins)
    paths = sorted({r[0] for r in wanted.select("file").distinct().toLocalIterator()})
    if datasource.reachable(paths):
        cwd = _working_folder(spark)
        absolute = [p if "/" in p.split(":", 1)[-1][:1] else f"{cwd}/{p}" for p in paths]
        number = spark.createDataFrame(list(enumerate(paths)), "number int, file string")
        return datasource.read_hashes(spark, absolute, numbered=True).join(F.broadcast(wanted.join(number, "file").select("number", "ub_id")), "number").select("ub_id", "h")

    def parse(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                h = np.frombuffer(raw[: len(raw) // 8 * 8], "<i8")
                for at in range(0, len(h), 1 << 16):
                    part = h[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(part)], ["path", "h"])

    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(parse, "path string, h long")
    return _attach(spark, wanted, rows).select("ub_id", "h")
