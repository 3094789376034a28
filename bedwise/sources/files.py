"""Daily CSV tables and exports."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedwise.operators.prep import union_all
from bedwise.schema import DAILY_TYPES
from bedwise.settings import CSV, DEFAULT_SITE, HOSPITALS

TRAINING_FILES = "donnees_*.csv"
HEADER_READERS = 32


class DataNotFoundError(FileNotFoundError):
    """No table at the given place."""


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths on any Hadoop file system that match a pattern, in name order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def get_available_data_path(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of ``paths`` that exists."""
    return next((p for p in paths if _glob(spark, p)), None)


def check_data_exists(spark: SparkSession, paths: Sequence[str]) -> bool:
    return get_available_data_path(spark, paths) is not None


def get_data_path(spark: SparkSession, paths: Sequence[str]) -> str:
    path = get_available_data_path(spark, paths)
    if path is None:
        raise DataNotFoundError(f"no data file among {list(paths)}")
    return path


def in_date_order(df: DataFrame, column: str = CSV.date_column) -> DataFrame:
    """Sorted by date, nulls last, then by site. For output only: no operator needs sorted input."""
    sites = ["hospital_id"] if "hospital_id" in df.columns else []
    return df.orderBy(F.asc_nulls_last(column), *sites) if column in df.columns else df


def _reader(spark: SparkSession):
    return spark.read.option("sep", CSV.separator).option("encoding", CSV.encoding).option("header", True)


def _scan(spark: SparkSession, paths: list[str], columns: list[str], parse_dates: bool) -> DataFrame:
    """One scan of files that share a header. Only columns outside the daily schema are inferred."""
    inferred = {}
    if any(c not in DAILY_TYPES for c in columns):
        inferred = {f.name: f.dataType for f in _reader(spark).option("inferSchema", True).csv(paths).schema.fields}
    types = {c: DAILY_TYPES.get(c, inferred.get(c)) for c in columns}
    # Whole numbers are also written as "12.0", so integers are read as doubles and cast.
    read_as = {
        c: T.StringType() if c == CSV.date_column else T.DoubleType() if isinstance(t, T.IntegralType) else t
        for c, t in types.items()
    }
    # Spark matches columns by position and checks the names: a file changed since its header was read is an error, not misread.
    df = _reader(spark).option("enforceSchema", False).schema(T.StructType([T.StructField(c, t) for c, t in read_as.items()])).csv(paths)
    casts = {c: F.col(c).cast(t) for c, t in types.items() if isinstance(t, T.IntegralType)}
    if parse_dates and CSV.date_column in columns:
        casts[CSV.date_column] = F.try_to_date(CSV.date_column, CSV.date_pattern)
    return df.withColumns(casts) if casts else df


def _part_files(spark: SparkSession, path: str) -> list[str]:
    """The files behind a path: itself, or the part files of a folder. A folder of folders stays as it is."""
    files = []
    for found in _glob(spark, path):
        at = spark._jvm.org.apache.hadoop.fs.Path(found)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.getFileStatus(at).isDirectory():
            files.append(found)
            continue
        parts = [f for f in fs.listStatus(at) if not f.getPath().getName().startswith(("_", "."))]
        files += [found] if any(f.isDirectory() for f in parts) else [str(f.getPath()) for f in parts]
    return sorted(files)


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, of which no more than a buffer is read. None for an empty file or a folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        return None
    stream = fs.open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        plain = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, CSV.encoding)).readLine()
    finally:
        stream.close()


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, ...]]:
    """The column names of every file, without a Spark job: only first lines are read, HEADER_READERS files at a time."""

    def names(path: str) -> tuple[str, ...]:
        line = _first_line(spark, path)
        header = tuple(next(csv.reader([line], delimiter=CSV.separator), ())) if line else ()
        # Spark names missing and repeated columns itself.
        plain = header and all(header) and len({h.lower() for h in header}) == len(header)
        return header if plain else tuple(_reader(spark).csv(path).columns)

    with ThreadPoolExecutor(HEADER_READERS) as readers:
        return list(readers.map(names, paths))


def _load(spark: SparkSession, paths: list[str], parse_dates: bool) -> DataFrame:
    """Files grouped by header, one scan per header, stacked by column name.

    Spark matches CSV columns by position, so files with another header need their own scan, part files of one folder too.
    Empty files hold no column and no row.
    """
    files = [f for p in paths for f in _part_files(spark, p)]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, _headers(spark, files)):
        by_header.setdefault(header, []).append(file)
    if len(by_header) > 1:
        by_header.pop((), None)
    return union_all([_scan(spark, group, list(header), parse_dates) for header, group in by_header.items()])


def load_data(spark: SparkSession, path: str, parse_dates: bool = True) -> DataFrame:
    """One daily CSV file, or directory of part files, whose columns are matched by name. Bad dates become null."""
    if not _glob(spark, path):
        raise DataNotFoundError(f"no data file at {path}")
    return _load(spark, [path], parse_dates)


def load_training_data(
    spark: SparkSession, directory: str, fallback: str | None = None, parse_dates: bool = True,
) -> DataFrame:
    """All ``donnees_*.csv`` of a directory, or what ``write_sites`` wrote there; else the single table ``fallback``."""
    paths = _glob(spark, f"{directory}/{TRAINING_FILES}")
    if paths:
        return _load(spark, paths, parse_dates)
    sites = _glob(spark, f"{directory}/hospital_id=*")
    if sites:
        if not _glob(spark, f"{directory}/hospital_id=*/*.csv"):
            return spark.read.parquet(directory)
        tables = _load(spark, [f"{directory}/hospital_id=*/*.csv"], parse_dates)
        # The site stands in the folder's name.
        site = F.url_decode(F.regexp_extract(F.input_file_name(), "/hospital_id=([^/]*)/", 1))
        return tables.withColumn("hospital_id", site)
    if fallback is None:
        raise DataNotFoundError(f"no training files in {directory}")
    return load_data(spark, fallback, parse_dates)


def load_reference(spark: SparkSession, path: str) -> DataFrame | None:
    """The calibration table, or None where it is absent."""
    return load_data(spark, path) if _glob(spark, path) else None


def hospital_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOSPITALS, "hospital_id string, name string, file string")


def get_available_hospitals(spark: SparkSession, directory: str) -> DataFrame:
    """Catalogue rows whose reference file, or folder written by ``write_sites``, exists."""
    names = [p.rsplit("/", 1)[-1] for p in _glob(spark, f"{directory}/*")]
    found = F.col("file").isin(names) | F.concat(F.lit("hospital_id="), "hospital_id").isin(names)
    return hospital_catalogue(spark).where(found)


def _dates_as_text(df: DataFrame) -> DataFrame:
    days = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.date_format(c, CSV.date_pattern) for c in days}) if days else df


def export_rows(df: DataFrame, format_dates: bool = True) -> DataFrame:
    return _dates_as_text(df) if format_dates else df


def export_csv(df: DataFrame, path: str, format_dates: bool = True) -> None:
    """``;``-separated CSV with a header; the action export keeps ISO dates."""
    rows = export_rows(df, format_dates)
    rows.write.mode("overwrite").option("sep", CSV.separator).option("encoding", CSV.encoding).option("header", True).csv(path)


def export_name(prefix: str, scenario: str, extension: str = "csv") -> str:
    """File name of a scenario export."""
    return f"{prefix}_{scenario.lower().replace(' ', '_').replace('é', 'e')}.{extension}"


def write_sites(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """One partition directory per hospital. A large hospital is written by many tasks."""
    writer = (_dates_as_text(df) if as_csv else df).write.mode("overwrite").partitionBy("hospital_id")
    if as_csv:
        writer.option("sep", CSV.separator).option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_single_site(df: DataFrame, path: str, hospital_id: str = DEFAULT_SITE) -> None:
    """One hospital's table without the ``hospital_id`` column."""
    export_csv(df.where(F.col("hospital_id") == hospital_id).drop("hospital_id"), path)
