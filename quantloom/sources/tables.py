"""Readers for headered CSV, zipped CSV and Parquet."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quantloom.session import materialise

CHUNK_ROWS = 50_000


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read ``path`` by its suffix: ``.csv``, ``.zip`` (of CSV) or ``.parquet``.

    Globs such as ``dir/*.csv`` work. Give a schema for large CSV input, since inferring
    one reads the data a second time.
    """
    suffix = PurePosixPath(path).suffix
    if suffix == ".parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if suffix == ".csv":
        return _read_csv(spark, path, schema)
    if suffix == ".zip":
        return _read_zip(spark, path, schema)
    raise ValueError(f"Unsupported file format: {suffix}")


def _read_csv(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    """Headered CSV. A given schema is matched to the header by name, in any order; columns
    it does not name are left out. Every file's header is checked against the first one's.
    As in the zipped form, an empty value is missing and any other text, ``NA`` too, is itself."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    header = reader.csv(path).columns
    absent = [f.name for f in schema if f.name not in header]
    if absent:
        raise ValueError(f"Columns not in the CSV header: {absent}")
    kinds = {f.name: f for f in schema}
    ordered = StructType([kinds.get(c, StructField(c, StringType())) for c in header])
    return reader.schema(ordered).option("enforceSchema", False).csv(path).select(*schema.names)


def _open(uri: str):
    """A seekable file for a path or URI, opened where the task runs."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return open(parsed.path, "rb")
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(inner)


def _member(archive: zipfile.ZipFile) -> str:
    found = [n for n in archive.namelist() if n.endswith(".csv")]
    if not found:
        raise ValueError("No CSV files found in ZIP archive")
    return "train.csv" if "train.csv" in found else found[0]


def _is_empty(archive: zipfile.ZipFile) -> bool:
    """A CSV without a byte, such as an empty partition writes: no header and no rows, as in Spark's CSV reader."""
    return archive.getinfo(_member(archive)).file_size == 0


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch["path"]:
            with _open(uri) as raw, zipfile.ZipFile(raw) as archive:
                if _is_empty(archive):
                    continue
                with archive.open(_member(archive)) as member:
                    names = list(pd.read_csv(member, nrows=0).columns)
            yield pd.DataFrame({"path": [uri], "names": [names]})


def _read_zip(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    """Unpack each archive in its own task, chunk by chunk, into a stored table.

    A compressed member can only be read from its start, so one archive is one task; memory
    is bounded by the chunk. Everything after the landing table is parallel again.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")
    archives = listed.count()
    listed = listed.repartition(max(1, archives))
    if schema:
        names = schema.names
    else:
        headers = listed.mapInPandas(_headers, "path string, names array<string>")
        by_order = headers.groupBy(F.array_sort("names").alias("sorted")).agg(F.min(F.struct("path", "names")).alias("first"))
        kinds = by_order.limit(2).collect()
        if not kinds:
            raise ValueError("No columns in any archive")
        if len(kinds) != 1:
            raise ValueError(f"Archives of one table have different columns: {[k['sorted'] for k in kinds]}")
        names = kinds[0]["first"]["names"]
    text = StructType([StructField(n, StringType()) for n in names])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                with _open(uri) as raw, zipfile.ZipFile(raw) as archive:
                    if _is_empty(archive):
                        continue
                    with archive.open(_member(archive)) as member:
                        for chunk in pd.read_csv(
                            member, dtype=str, chunksize=CHUNK_ROWS, keep_default_na=False, na_values=[""]
                        ):
                            yield chunk[names].astype(object).where(chunk[names].notna(), None)

    landed = materialise(listed.mapInPandas(unpack, text), "unzipped")
    schema = schema or _infer(landed)
    return landed.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _infer(landed: DataFrame) -> StructType:
    """BIGINT where every value is one, else DOUBLE, else STRING; one aggregate job."""
    checks = []
    for c in landed.columns:
        filled = F.col(c).isNotNull()
        for kind in ("bigint", "double"):
            fits = F.col(c).try_cast(kind).isNotNull()
            checks.append(F.coalesce(F.bool_and(F.when(filled, fits)), F.lit(True)).alias(f"{kind} {c}"))
    fits = landed.agg(*checks).first()
    return StructType(
        [
            StructField(
                c,
                LongType() if fits[f"bigint {c}"] else DoubleType() if fits[f"double {c}"] else StringType(),
            )
            for c in landed.columns
        ]
    )
