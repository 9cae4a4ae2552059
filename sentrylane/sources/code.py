"""Source text: repositories on a file system and tables of snippets."""

import os
import posixpath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentrylane.session import work_folder

# What a repository scan reads and skips, and the name of a bare snippet.
JAVA_SUFFIX = ".java"
SKIPPED_FOLDERS = ("/test/", "/target/", "/build/")
SNIPPET_NAME = "inline-code.java"

#: Files and bytes that one task of a repository scan reads, about.
_FILES, _BYTES = 20_000, 128 << 20


def scannable(path):
    """A Java file outside test and build output folders."""
    keep = path.endswith(JAVA_SUFFIX)
    for folder in SKIPPED_FOLDERS:
        keep = keep & ~path.contains(folder)
    return keep


def read_repository(spark: SparkSession, *roots: str) -> DataFrame:
    """``(path, content)`` of every scannable file below ``roots``.

    Folders are listed in tasks, level by level, into a table below the shared folder, so the
    driver holds no list of files; skipped and hidden folders are not entered. Bytes are read
    only where ``content`` is asked for. A file that is not UTF-8 text has null content; a
    scan lists it as unread and fails for it. Roots in a store that is no file system of the
    executors are listed by Spark's binary source, on the driver.
    """
    found = [r for root in roots for r in _expanded(spark, root)]
    if not all(r.startswith("file:/") for r in found):
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*" + JAVA_SUFFIX)
            .load(list(roots))
        )
        content = F.col("content")
    else:
        files = _listed(spark, found)
        content = F.udf(_bytes, T.BinaryType(), useArrow=False)("path")
    return files.filter(scannable(F.col("path"))).select(
        "path", F.try_validate_utf8(content.cast("string")).alias("content")
    )


def _expanded(spark: SparkSession, root: str) -> list[str]:
    """Full names of the files or folders that ``root``, which may be a pattern, stands for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(root)
    return [f.getPath().toString() for f in found]


def _bytes(path: str) -> bytes:
    with open(path.removeprefix("file:"), "rb") as file:
        return file.read()


def _listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path`` of the Java files below ``roots``, dealt to tasks by number and size."""
    suffix, skipped = JAVA_SUFFIX, SKIPPED_FOLDERS

    def row(path: str, folder: bool, size: int) -> list[tuple]:
        wanted = not any(s in f"{path}/" for s in skipped) if folder else path.endswith(suffix)
        return [(path, folder, size)] if wanted else []

    def inside(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = []
                with os.scandir(folder.removeprefix("file:")) as entries:
                    for e in entries:
                        # What Spark's readers take for hidden, too.
                        if e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name:
                            continue
                        is_folder = e.is_dir()
                        rows += row(f"{folder.rstrip('/')}/{e.name}", is_folder, 0 if is_folder else e.stat().st_size)
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names=names)

    names, schema = ["path", "folder", "size"], "path string, folder boolean, size bigint"
    top = work_folder(spark, "listing")
    first = [r for root in roots if (p := root.removeprefix("file:")) for r in row(root, os.path.isdir(p), os.path.getsize(p))]
    spark.createDataFrame(first, schema).write.parquet(f"{top}/level=0")
    level = 0
    while not (folders := spark.read.schema(schema).parquet(f"{top}/level={level}").filter("folder").select("path")).isEmpty():
        level += 1
        folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(inside, schema).write.parquet(f"{top}/level={level}")
    files = spark.read.schema(schema).parquet(*[f"{top}/level={n}" for n in range(level + 1)]).filter("NOT folder")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.select("path").repartition(max(spark.sparkContext.defaultParallelism, n // _FILES, size // _BYTES))


def write_files(files: DataFrame, root: str) -> None:
    """Write ``files(path, content)`` as files below ``root``, a URI or a local path.

    Every task writes its own rows; a task that runs again replaces its files. A file
    without content is empty.
    """
    def written(batches):
        system, folder = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        made = ""
        for b in batches:
            for path, content in zip(*(c.to_pylist() for c in b.columns)):
                target = posixpath.join(folder, path.lstrip("/"))
                if made != (made := posixpath.dirname(target)):
                    system.create_dir(made, recursive=True)
                with system.open_output_stream(target) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    files.select("path", "content").mapInArrow(written, "path string").write.format("noop").mode("overwrite").save()


def snippets(requests: DataFrame) -> DataFrame:
    """Analysis requests ``(filename, code, ...)`` to ``(path, content, ...)``.

    A request without a name gets the default one; a request without code or whose
    name is not a Java file has nothing to analyse and is dropped.
    """
    rest = [c for c in requests.columns if c not in ("filename", "code")]
    named = requests.select(
        *rest,
        F.coalesce("filename", F.lit(SNIPPET_NAME)).alias("path"),
        F.col("code").alias("content"),
    )
    return named.filter(F.col("content").isNotNull() & F.col("path").endswith(JAVA_SUFFIX))
