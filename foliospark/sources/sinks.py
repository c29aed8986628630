"""Writers: keyed tables with upsert, indexes, stage outputs, manifests and images."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import image_uuid
from ..functions.render import data_uri_bytes
from ..operators.selection import last_wins, upsert


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _folders(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    """Folder of each bucket in a version."""
    return json.loads(spark.read.text(f"{path}/_versions/{version}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, folders: dict[str, str]) -> None:
    """Makes a version known by the rename of a finished file; that version must not be there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, target = _fs(spark, f"{path}/_versions/{version}")
    draft = at(f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {path} was committed by another writer")


def upsert_table(rows: DataFrame, path: str, key: str = "chunk_id", order: str | None = None, buckets: int = BUCKETS) -> None:
    """Upserts rows into a table by key; within the rows the greatest *order* wins.

    Rows lie in *buckets* by hash of the key.  Only buckets that the rows touch are written anew, into new folders; a
    small file then names the folder of every bucket, and its rename is the commit.  Readers see one version or the
    next, and a crash before the commit leaves the table as it was.  Folders of all but the last two versions go.
    """
    spark = rows.sparkSession
    new = last_wins(rows, key, order) if order else rows.dropDuplicates([key])
    new = new.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [str(r[0]) for r in new.select("_bucket").distinct().collect()]  # at most *buckets*
    have = _versions(spark, path)
    folders = _folders(spark, path, have[-1]) if have else {}
    old = [f"{path}/{folders[b]}" for b in touched if b in folders]
    if old:
        was = spark.read.parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        new = upsert(was.select(*new.columns), new, key)
    name = uuid.uuid4().hex
    new.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    folders = folders | {b: f"{name}/_bucket={b}" for b in touched}
    if not touched and not have:  # an empty table has its columns
        folders = {"": name}
    _commit(spark, path, have[-1] + 1 if have else 1, {b: f for b, f in folders.items() if b or len(folders) == 1})
    _clean(spark, path)


def _clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path
    have = _versions(spark, path)
    used = {f for n in have[-keep:] for f in _folders(spark, path, n).values()}
    fs, _ = _fs(spark, path)
    for n in have[:-keep]:
        for folder in set(_folders(spark, path, n).values()) - used:
            fs.delete(at(f"{path}/{folder}"), True)
        fs.delete(at(f"{path}/_versions/{n}"), False)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table, or an error that says it is not ready."""
    have = _versions(spark, path)
    if not have:
        raise LookupError(f"the index at {path} is not ready: ingest documents first")
    return spark.read.parquet(*[f"{path}/{f}" for f in sorted(_folders(spark, path, have[-1]).values())])


def stage_output(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)


def reset(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            fs.delete(p, True)


def commit_manifest(done: DataFrame, path: str) -> None:
    """Adds files to the manifest; called after their outputs are written, so that a failed run is taken up again."""
    upsert_table(done.select("path", "sha256", "has_text", "has_tables", "has_images"), path, "path")


def export_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes images (collection, name, uri) as files named by their UUID; returns (collection, name, path)."""
    named = images.select("collection", "name", F.concat(F.lit(folder.rstrip("/") + "/"), image_uuid(F.col("collection"), F.col("name")), F.lit(".png")).alias("path"), data_uri_bytes(F.col("uri")).alias("content"))


    def write(rows) -> None:
        from pyarrow import fs as arrow_fs

        for r in rows:  # the folder must be one that all executors share; a URI names its file system
            fs, path = arrow_fs.FileSystem.from_uri(r["path"]) if "://" in r["path"] else (arrow_fs.LocalFileSystem(), r["path"])
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(bytes(r["content"]))

    named.select("path", "content").foreachPartition(write)
    return named.select("collection", "name", "path")


def copy_folder(source: str, target: str, without: tuple[str, ...] = ("chunks.json",)) -> None:
    """Copies a folder on the driver, without the named files."""
    import shutil

    shutil.copytree(source, target, ignore=shutil.ignore_patterns(*without), dirs_exist_ok=True)
