"""Bar files: semicolon-separated text with a header, plain or gzipped, of several eras side by side.

Files are read by groups of equal header: one read over differing headers would bind columns by
position. Dirty cases: headers repeated as rows, files without the key column, unparseable dates and
numbers, duplicated and out-of-order rows, mixed cadences in one folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..operators.cleaning import first_of

SEP = ";"


def find_files(spark: SparkSession, folder: str, cadence: int | None = None, recursive: bool = False) -> list[str]:
    """Paths of .csv and .csv.gz files, sorted, by any file system Spark reads; cadence picks names with ".w{sec}."."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, recursive)
    out = []
    while listed.hasNext():
        name = listed.next().getPath().toString()
        last = name.rpartition("/")[2]
        if last.endswith((".csv", ".csv.gz")) and (cadence is None or f".w{cadence}." in last):
            out.append(name)
    return sorted(out)


def first_lines(spark: SparkSession, files: list[str], at_once: int = 16) -> dict[str, str]:
    """The first line of each file by its whole path: a file is opened, read to its first line and closed, some at a time."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(f: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(f)
        raw = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8")).readLine()
        finally:
            raw.close()

    with ThreadPoolExecutor(at_once) as pool:
        return {f: line.lstrip("\ufeff") for f, line in zip(files, pool.map(first, files), strict=True) if line}


def headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header."""
    out: dict[tuple[str, ...], list[str]] = {}
    for f, line in first_lines(spark, files).items():
        out.setdefault(tuple(line.split(SEP)), []).append(f)
    return out


def read_bars(spark: SparkSession, files: list[str], columns: list[str] | None = None, key: str = "spot_datetime", strict: bool = False) -> DataFrame:
    """Rows of all files that have the key, as text, with the file's path; missing columns are null.

    Column pruning reaches the reader. strict demands one header for all.
    """
    groups = headers(spark, files)
    if strict and len(groups) > 1:
        raise ValueError(f"files have {len(groups)} different headers")
    parts = []
    for header, members in groups.items():
        if key not in header:
            continue
        kept = [c for c in header if columns is None or c in columns or c == key]
        rows = spark.read.schema(", ".join(f"`{c}` string" for c in header)).csv(members, sep=SEP, header=True, mode="PERMISSIVE", enforceSchema=True)
        rows = rows.select(*[F.col(f"`{c}`").alias(c) for c in kept], F.col("_metadata.file_path").alias("_file"))
        parts.append(rows.filter(F.col(f"`{key}`") != key))
    if not parts:
        raise ValueError(f"no file has the column {key}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def typed(rows: DataFrame, key: str = "spot_datetime", form: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Dates parsed (rows without one dropped), numbers coerced, one row per time: the first by file name."""
    when = F.try_to_timestamp(F.col(f"`{key}`"), F.lit(form))
    others = [c for c in rows.columns if c not in (key, "_file") and not c.endswith("_datetime")]
    out = rows.select(when.alias(key), *[number(F.col(f"`{c}`")).alias(c) for c in others], "_file").filter(F.col(f"`{key}`").isNotNull())
    return first_of(out, [f"`{key}`"], ["_file", F.xxhash64(*[F.col(f"`{c}`") for c in others])] if others else ["_file"]).drop("_file")


def write_bars(bars: DataFrame, folder: str, lines: int | None = None, gzip: bool = False, by: list[str] | None = None) -> None:
    """Semicolon text with the columns in their order; ``lines`` rolls files over, gzip archives them."""
    writer = bars.write.mode("overwrite").option("sep", SEP).option("header", True).option("emptyValue", "").option("nullValue", "")
    if lines:
        writer = writer.option("maxRecordsPerFile", lines)
    if gzip:
        writer = writer.option("compression", "gzip")
    if by:
        writer = writer.partitionBy(*by)
    writer.csv(folder)


def lines_per_file(width: int, files_a_day: int = 6) -> int:
    return 24 * 3600 // (width * files_a_day)


def write_scores(scores: DataFrame, folder: str) -> None:
    """The archive of scores, as Parquet by fold."""
    scores.write.mode("overwrite").partitionBy("fold").parquet(folder)
