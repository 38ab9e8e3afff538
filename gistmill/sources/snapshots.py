"""Tables of notes and digests as snapshots: readers see a whole version, the former or the new one.

A version is a manifest, a small JSON file that names for each part (the day of a run, say)
the folder with its rows. Rows are written to a new folder first; the manifest comes last, by
a rename that fails where the version exists. A run that is killed before leaves a folder that
no manifest names, and a writer that was overtaken takes the next version, on top of what the
other wrote.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, so that any storage that Spark reads will do."""
    jvm = spark._jvm.org.apache.hadoop
    at = jvm.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    at = at.getFileSystem(conf).makeQualified(at)
    return jvm.fs, jvm.fs.FileContext.getFileContext(at.toUri(), conf), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, oldest first; none where nothing was written."""
    fs, files, at = _files(spark, f"{path.rstrip('/')}/versions")
    if not files.util().exists(at):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/versions/{version:012d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Whether the manifest became that version; false if another writer's did."""
    fs, files, folder = _files(spark, f"{path.rstrip('/')}/versions")
    fresh, final = fs.Path(folder, f".{uuid.uuid4().hex}"), fs.Path(folder, f"{version:012d}.json")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    out = system.create(fresh, False)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    try:
        files.rename(fresh, final, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        files.delete(fresh, False)
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def write_snapshot(rows: DataFrame, path: str, part: str) -> int:
    """Replaces one part by ``rows``, keeps the others, and returns the version.

    All parts must have the same columns. An empty table makes the part empty.
    """
    spark, folder = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{folder}")
    schema = json.loads(rows.schema.json())
    while True:
        known = versions(spark, path)
        last = _manifest(spark, path, known[-1]) if known else {"parts": {}, "schema": schema}
        if [f["name"] for f in last["schema"]["fields"]] != rows.columns:
            raise ValueError(f"columns {rows.columns} are not those of the parts before")
        version = known[-1] + 1 if known else 1
        if _publish(spark, path, version, {"parts": {**last["parts"], part: folder}, "schema": last["schema"]}):
            return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of the last version, or of the one asked for; a version that is not there is an error."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"{path} has no version" + ("" if version is None else f" {version}"))
    manifest = _manifest(spark, path, known[-1] if version is None else version)
    folders = [f"{path.rstrip('/')}/{f}" for f in sorted(set(manifest["parts"].values()))]
    return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*folders)
