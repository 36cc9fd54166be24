"""Arrow IPC stream files as a DataFrame.

Spark has no Arrow file source; three ways to one are given here. ``ArrowStreams`` is a
Python data source (``spark.read.format("arrow_streams").load(folder)``), one partition per
file, schema from the files' headers. ``read_arrow_streams`` takes paths, and ``decode`` a
DataFrame of files, as a stream of landed files hands over (see ``streaming/landing.py``);
these go through ``mapInArrow``. Each task opens its file with pyarrow's filesystem layer
(local, HDFS or object stores) and yields the stream's record batches one at a time, so a
file is never held whole in memory and files are read in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from trafficlens.functions.headers import reshape_pairs
from trafficlens.operators.store import align
from trafficlens.sources.pages import require


REQUIRED = {"metrics": ("period_start", "period_end"), "request_logs": ("timestamp", "request_uuid", "method", "url")}


def _filesystem(path: str):
    """pyarrow's filesystem for a path as Spark or a user writes it, and the path within."""
    from pyarrow import fs
    if path.startswith("file:"):  # Spark's own form has one slash and no escapes
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def _open(path: str):
    filesystem, p = _filesystem(path)
    return filesystem.open_input_stream(p)


def _spark_compatible(schema: pa.Schema) -> pa.Schema:
    """Arrow types Spark can take: timestamps of any unit become microseconds in UTC."""
    fields = []
    for f in schema:
        t = f.type
        if pa.types.is_timestamp(t):
            t = pa.timestamp("us", tz="UTC")
        fields.append(pa.field(f.name, t, f.nullable))
    return pa.schema(fields)


def stream_schema(path: str) -> pa.Schema:
    """Schema of one stream, from its header only."""
    with _open(path) as src:
        return _spark_compatible(pa.ipc.open_stream(src).schema)


def union_schema(files: DataFrame) -> pa.Schema:
    """All columns of all files (``files``: one path a row), each of a type that holds every
    file's: headers are read by the executors, distinct ones come to the driver."""

    def headers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = {stream_schema(p).remove_metadata().serialize().to_pybytes() for p in b.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["schema"])

    rows = files.mapInArrow(headers, "schema binary").distinct().collect()
    return _unified([pa.ipc.read_schema(pa.py_buffer(bytes(r["schema"]))) for r in rows])


def _unified(schemas: list[pa.Schema]) -> pa.Schema:
    return pa.unify_schemas(sorted(schemas, key=lambda s: s.names), promote_options="permissive")


def _batches(path: str, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The record batches of one stream with the columns of ``target``, absent ones NULL."""
    with _open(path) as src:
        for rb in pa.ipc.open_stream(src):
            cols = []
            for f in target:
                i = rb.schema.get_field_index(f.name)
                col = rb.column(i) if i >= 0 else pa.nulls(rb.num_rows, f.type)
                cols.append(col.cast(f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=target)


def read_arrow_streams(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """Rows of all Arrow IPC stream files in ``paths``; ``schema`` (Spark StructType)
    defaults to the union of all files' schemas. Columns absent from a file are NULL."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.createDataFrame([(p,) for p in paths], "path string") \
        .repartition(max(1, len(paths)), F.col("path"))
    if schema is None:
        schema = from_arrow_schema(union_schema(files))
    target = to_arrow_schema(schema, timestamp_utc=True)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p in b.column(0).to_pylist():
                yield from _batches(p, target)

    return files.mapInArrow(batches, schema)


def decode(files: DataFrame) -> DataFrame:
    """Rows of the streams in ``files`` (columns path, modificationTime), of the union of
    their schemas, each with the file it came from: ``_modified``, ``_file`` and ``_row``,
    its place in the file."""
    schema = from_arrow_schema(union_schema(files.select("path")))
    target = to_arrow_schema(schema, timestamp_utc=True)
    out = schema.add("_modified", "timestamp").add("_file", "string").add("_row", "long")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, modified in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = 0
                for rb in _batches(path, target):
                    size = rb.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [*rb.columns, pa.repeat(modified, size), pa.repeat(path, size), pa.array(range(n, n + size), pa.int64())],
                        names=[*target.names, "_modified", "_file", "_row"])
                    n += size

    return files.select("path", "modificationTime").mapInArrow(rows, out)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], target: pa.Schema):
        self.files, self.target = files, target

    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.path, self.target)


class ArrowStreams(DataSource):
    """``spark.read.format("arrow_streams").load(path or paths)`` after ``register_arrow``.

    A path is a stream file or a folder of them, subfolders included (names that begin with
    ``_`` or ``.`` are left out, as Spark does). Without ``.schema(...)`` the columns are those of all
    files, from their headers alone. A damaged stream raises an error; so does a path without files."""

    @classmethod
    def name(cls) -> str:
        return "arrow_streams"

    def _files(self) -> list[str]:
        from pyarrow import fs
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        files = set()
        for path in paths:
            filesystem, p = _filesystem(path)
            if filesystem.get_file_info(p).type != fs.FileType.Directory:
                files.add(path)
                continue
            for found in filesystem.get_file_info(fs.FileSelector(p, recursive=True)):
                inner = found.path[len(p):].strip("/")
                if found.type == fs.FileType.File and not any(x[0] in "_." for x in inner.split("/")):
                    files.add(f"{path.rstrip('/')}/{inner}")
        if not files:
            raise FileNotFoundError(f"no Arrow streams under {paths}")
        return sorted(files)

    def schema(self) -> StructType:
        with ThreadPoolExecutor(16) as pool:
            return from_arrow_schema(_unified(list(pool.map(stream_schema, self._files()))))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), to_arrow_schema(schema, timestamp_utc=True))


def register_arrow(spark: SparkSession) -> None:
    """Makes the format ``arrow_streams`` known to the session."""
    spark.dataSource.register(ArrowStreams)


def table_rows(df: DataFrame, table: str, app_id: int, required: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrow rows as rows of ``table``, header pairs as name/value structs."""
    for c in ("request_headers", "response_headers"):
        if c in df.columns:
            df = df.withColumn(c, reshape_pairs(F.col(c)))
    return require(align(df, table, app_id, keep), *required)


def read_metrics_arrow(spark: SparkSession, paths: list[str], app_id: int) -> DataFrame:
    """Metrics Arrow streams as the metrics table, ready for ``range_replace``."""
    return table_rows(read_arrow_streams(spark, paths), "metrics", app_id, REQUIRED["metrics"])


def read_request_logs_arrow(spark: SparkSession, paths: list[str], app_id: int) -> DataFrame:
    """Request-log Arrow streams as the request_logs table, header pairs as name/value
    structs, ready for ``upsert``."""
    return table_rows(read_arrow_streams(spark, paths), "request_logs", app_id,
                      REQUIRED["request_logs"])
