"""Reading meter tables: one source per customer, and tables that may not exist."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions.columns import finite
from meterlens.params import BASE_COLUMNS, KEY, TIME
from meterlens.session import settle

RAW_DATE = "Fecha_original_etl"
LOAD_ORDER = ("_source", "_offset_in_source", "_line")


def raw_schema(columns: Sequence[str] = BASE_COLUMNS) -> T.StructType:
    fields = [T.StructField(KEY, T.StringType()), T.StructField(RAW_DATE, T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in columns]
    fields += [T.StructField("_source", T.StringType()), T.StructField("_offset_in_source", T.LongType()),
               T.StructField("_line", T.LongType())]
    return T.StructType(fields)


def _customer(named_by: str = "file") -> F.Column:
    """Customer id: the file's name without extension, trimmed; or with ``"folder"`` that of its folder, behind an = sign if there is one."""
    if named_by == "folder":
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1)
        return F.trim(F.regexp_replace(_decoded(folder), r"^[^=]*=", ""))
    return F.trim(F.regexp_replace(_decoded(F.col("_metadata.file_name")), r"(\.[^.]*)$", ""))


def _decoded(name: F.Column) -> F.Column:
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def source_files(spark: SparkSession, path: str, pattern: str, named_by: str = "file") -> DataFrame:
    """(path, source) of the files below ``path``; their content is not read. ``source`` is the path as scans name it."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(path).select("path", F.col("_metadata.file_path").alias("source"),
                                                                 _customer(named_by).alias(KEY)))


def source_columns(files: DataFrame, kind: str, separator: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(path, source, customer, columns, reason) per file, from the header line or the Parquet footer only.

    Tasks open the files they are given and read a few bytes each. A file whose header cannot be
    read as such gets a reason instead of columns; a file that cannot be opened is an error.
    """

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import urllib.parse

        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        def header(path: str) -> tuple[list[str] | None, str | None]:
            if path.startswith("file:"):
                system, inner = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                system, inner = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
            if kind == "parquet":
                with system.open_input_file(inner) as file:
                    try:
                        return pq.read_schema(file).names, None
                    except pa.ArrowInvalid as error:
                        return None, f"no Parquet file: {error}"
            head = b""
            with system.open_input_stream(inner) as stream:
                while b"\n" not in head and (piece := stream.read(65536)):
                    head += piece
            line = head.removeprefix(b"\xef\xbb\xbf").split(b"\n", 1)[0]
            if line.count(b'"') % 2:
                return None, "the header has a line break within quotes"
            try:
                names = next(csv.reader([line.decode(encoding).rstrip("\r")], delimiter=separator), None)
            except UnicodeDecodeError:
                return None, f"the header is not {encoding}"
            return ([n.strip() for n in names], None) if names else (None, "no header")

        for batch in batches:
            found = [header(p) for p in batch["path"]]
            yield batch.assign(columns=[c for c, _ in found], reason=[r for _, r in found])

    return files.mapInPandas(columns, f"path string, source string, {KEY} string, columns array<string>, reason string")


def judged_sources(spark: SparkSession, path: str, kind: str, needed: Sequence[str], separator: str = ",",
                   encoding: str = "utf-8", named_by: str = "file") -> DataFrame | None:
    """``source_columns`` with a reason for files that lack a needed column, too; None without a file."""
    try:
        files = source_files(spark, path, f"*.{kind}", named_by)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    lacks = F.filter(F.array(*map(F.lit, needed)), lambda c: ~F.array_contains("columns", c))
    found = source_columns(files, kind, separator, encoding)
    return settle(found.withColumn("reason", F.coalesce(
        "reason", F.when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", "))))))


def rejected_sources(spark: SparkSession, path: str, kind: str = "csv", date_column: str = TIME,
                     columns: Sequence[str] = BASE_COLUMNS, separator: str = ",", encoding: str = "utf-8",
                     named_by: str = "file") -> DataFrame:
    """(customer, source, reason) of the sources that the readers leave out."""
    found = judged_sources(spark, path, kind, [date_column, *columns], separator, encoding, named_by)
    if found is None:
        return spark.createDataFrame([], f"{KEY} string, source string, reason string")
    return found.where("reason IS NOT NULL").select(KEY, "source", "reason")


def _csv_lines(spark: SparkSession, path: str, date_column: str, columns: Sequence[str], separator: str,
               encoding: str, named_by: str) -> DataFrame | None:
    """Lines of the usable sources: customer, cells, the place of each needed cell, load order, and ``_line_text`` of a line that has
    more or fewer cells than its header. Sources of one width are one scan; the driver is told their files.
    """
    needed = [date_column, *columns]
    heads = judged_sources(spark, path, "csv", needed, separator, encoding, named_by)
    if heads is None:
        return None
    heads = heads.where("reason IS NULL").withColumn("width", F.size("columns"))
    places = heads.select("source", "width", *[(F.array_position("columns", c) - 1).cast("int").alias(f"_at_{i}") for i, c in enumerate(needed)])
    files: dict[int, list[str]] = {}
    for row in heads.select("width", "path").toLocalIterator():
        files.setdefault(row["width"], []).append(row["path"])
    out = None
    for width, paths in sorted(files.items()):
        cells = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
        scan = (spark.read.schema(T.StructType([*cells.fields, T.StructField("_line_text", T.StringType())]))
                .option("header", True).option("sep", separator).option("encoding", encoding)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line_text").csv(sorted(paths)))
        # A condition on all cells that always holds: a scan that reads some of them would not count the others.
        rows = scan.where(F.length(F.concat_ws("", *cells.names)) >= 0).select(F.array(*cells.names).alias("_cells"), "_line_text", _customer(named_by).alias(KEY), *_load_order())
        out = rows if out is None else out.unionByName(rows)
    return None if out is None else out.join(places, out["_source"] == places["source"])


def read_csv_sources(spark: SparkSession, path: str, date_column: str = TIME, columns: Sequence[str] = BASE_COLUMNS,
                     separator: str = ",", encoding: str = "utf-8", named_by: str = "file") -> DataFrame:
    """All CSV sources below ``path`` as one table.

    ``rejected_sources`` tells which are left out, and why; ``rejected_rows`` does so for lines. Sources may
    order their columns differently: cells are read by position, and each row picks its cells by where its
    source's header has them. Values that are no finite numbers become NULL. The load order of a row is
    (source, split offset, line), see ``LOAD_ORDER``.
    """
    lines = _csv_lines(spark, path, date_column, columns, separator, encoding, named_by)
    if lines is None:
        return spark.createDataFrame([], raw_schema(columns))
    date, *values = [F.get("_cells", F.col(f"_at_{i}")) for i in range(1 + len(columns))]
    return lines.where("_line_text IS NULL").select(
        KEY, date.alias(RAW_DATE), *[finite(v.try_cast("double")).alias(c) for v, c in zip(values, columns)], *LOAD_ORDER)


def rejected_rows(spark: SparkSession, path: str, date_column: str = TIME, columns: Sequence[str] = BASE_COLUMNS,
                  separator: str = ",", encoding: str = "utf-8", named_by: str = "file") -> DataFrame:
    """(customer, source, line, cells, reason) of the lines of usable CSV sources that ``read_csv_sources`` leaves out.

    Every line that is not empty is in one of the two. Lines end at line breaks, also within quotes.
    """
    lines = _csv_lines(spark, path, date_column, columns, separator, encoding, named_by)
    if lines is None:
        return spark.createDataFrame([], f"{KEY} string, source string, line string, cells array<string>, reason string")
    return lines.where("_line_text IS NOT NULL").select(
        KEY, "source", F.col("_line_text").alias("line"), F.col("_cells").alias("cells"),
        F.format_string("not %d cells", "width").alias("reason"))


def read_parquet_sources(spark: SparkSession, path: str, date_column: str = TIME,
                         columns: Sequence[str] = BASE_COLUMNS, named_by: str = "file") -> DataFrame:
    """Parquet sources, one file per customer; only the needed columns are scanned.

    The driver is told the files of each layout, as it lists them for any scan.
    """
    out = spark.createDataFrame([], raw_schema(columns))
    heads = judged_sources(spark, path, "parquet", [date_column, *columns], named_by=named_by)
    layouts: dict[tuple[str, ...], list[str]] = {}
    if heads is not None:
        for row in heads.where("reason IS NULL").select("columns", "path").toLocalIterator():
            layouts.setdefault(tuple(row["columns"]), []).append(row["path"])
    for _, files in sorted(layouts.items()):
        out = out.unionByName(spark.read.parquet(*sorted(files)).select(
            _customer(named_by).alias(KEY), F.col(date_column).cast("string").alias(RAW_DATE),
            *[finite(F.col(c).cast("double")).alias(c) for c in columns], *_load_order()))
    return out


def _load_order() -> list[F.Column]:
    return [F.col("_metadata.file_path").alias("_source"),
            F.col("_metadata.file_block_start").alias("_offset_in_source"),
            F.monotonically_increasing_id().alias("_line")]


def read_table(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """A CSV or Parquet table with the given schema; a missing path is an empty table."""
    reader = spark.read.schema(schema)
    try:
        if kind == "csv":
            # Columns are matched by position: an enforced schema never depends on inference.
            return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
        return reader.format(kind).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth as (customer, time, anomalia_real, criticidad_real)."""
    schema = T.StructType([
        T.StructField(KEY, T.StringType()), T.StructField(TIME, T.TimestampType()),
        T.StructField("anomalia_real", T.BooleanType()), T.StructField("criticidad_real", T.StringType())])
    return read_table(spark, path, schema)
