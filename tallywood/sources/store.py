"""Objects by key under a folder of any file system that Spark can read."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, folder: str, key: str = ""):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{key}".rstrip("/"))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme and signs escaped, as pyarrow takes it."""
    path, fs = _at(spark, folder)
    uri = fs.makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getRawAuthority() or ''}{uri.getRawPath()}".rstrip("/")


def put(spark: SparkSession, folder: str, key: str, content: bytes) -> None:
    """Write one object, over what was there."""
    path, fs = _at(spark, folder, key)
    out = fs.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def put_all(objects: DataFrame, folder: str, key: str = "key", content: str = "content") -> DataFrame:
    """Write many objects, each by the task that holds its row, over what was there: (key, size, sha256) of what was written.

    The answer is lazy: an object is written when it is computed, and written
    again, the same, when its task is. It opens files by pyarrow's file systems; a
    local folder has to be shared by all machines. Rows with a null key are
    skipped, null contents are empty, and of several rows of one key the one whose
    content is last in order stays.
    """
    uri = _uri(objects.sparkSession, folder)
    rows = objects.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")).where("key IS NOT NULL")
    rows = rows.groupBy("key").agg(F.max("content").alias("content"))

    def write(batches):
        fs, at = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            keys, sizes, sums = [], [], []
            for k, body in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                path, data = f"{at}/{k}", body.as_buffer()
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                # A name of its own first, so that nobody reads half an object.
                with fs.open_output_stream(made := f"{path}.{uuid.uuid4().hex}.part") as out:
                    out.write(data)
                fs.move(made, path)
                keys.append(k)
                sizes.append(len(data))
                sums.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["key", "size", "sha256"])

    return rows.mapInArrow(write, "key string, size long, sha256 string")


def fetch_all(keys: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """(key, content) for each given key, null where there is no such object; the task that holds a key reads its object, and no others are listed or read."""
    uri = _uri(keys.sparkSession, folder)

    def read(batches):
        fs, at = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for k in batch.column("key"):  # an object at a time in memory
                body = None
                if k.is_valid and fs.get_file_info(f"{at}/{k}").type == pyarrow.fs.FileType.File:
                    with fs.open_input_stream(f"{at}/{k}") as data:
                        body = data.read()
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.string()), pa.array([body], pa.binary())], names=["key", "content"])

    return keys.select(F.col(key).cast("string").alias("key")).mapInArrow(read, "key string, content binary")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(key, size, sha256) of all objects; their contents are hashed where they lie."""
    path, fs = _at(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], "key string, size long, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key) of all objects, empty ones too, of which nothing is read; a key is the path below the folder, as ``put`` and ``fetch`` take it. Names pass the driver, as in any listing of Spark's."""
    path, fs = _at(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], "key string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()
    below = len(unquote(urlsplit(_uri(spark, folder)).path)) + 1
    return spark.createDataFrame([(unquote(urlsplit(f).path)[below:],) for f in files], "key string")


def fetch(spark: SparkSession, folder: str, key: str) -> bytes:
    """One object; KeyError if it isn't there."""
    path, fs = _at(spark, folder, key)
    if not fs.exists(path):
        raise KeyError(key)
    return bytes(spark.read.format("binaryFile").load(path.toString()).select("content").first()[0])


def clear(spark: SparkSession, folder: str) -> int:
    """Delete all objects; how many there were."""
    n = keys(spark, folder).count()
    path, fs = _at(spark, folder)
    fs.delete(path, True)
    return n
