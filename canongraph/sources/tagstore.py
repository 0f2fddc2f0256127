"""Tags of many objects kept in a folder, and names and relations written back into them as one step.

``tags/<run>/bucket=<b>/`` holds Parquet files (obj_id, key, value); ``manifests/<number>.json`` lists, bucket by bucket, the
folder that counts. A write stages new folders of the buckets it touches, and then creates the next manifest under a name
that must not exist yet. Readers take the highest manifest, so they see all of a write or nothing of it; a driver that dies before
that leaves folders that nobody reads (vacuum() removes them), tasks that are tried again are Spark's committer's matter, and of two
writers at once one finds its number taken and starts again from what the other wrote. A write that changes nothing adds no manifest.
That rests on a rename that refuses a name in use, as HDFS has it; where renames are no such step (object stores), and for two
writers within the same moment on a local disk, writers must take turns. Readers never need to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canongraph.functions.shared import file_system
from canongraph.sources.headers import NAME_KEY, set_tags

#: Buckets of a new store; a write rewrites those of the objects it is given.
BUCKETS = 64
SCHEMA = "obj_id string, key string, value string"


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, where = file_system(spark, f"{path}/manifests")
    return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(where) if x.getPath().getName().endswith(".json")) if fs.exists(where) else []


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    fs, where = file_system(spark, f"{path}/manifests/{number:012d}.json")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Writes a manifest beside and moves it to its name, unless that is taken."""
    fs, target = file_system(spark, f"{path}/manifests/{number:012d}.json")
    _, staged = file_system(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    stream = fs.create(staged, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if not fs.exists(target) and fs.rename(staged, target):
        return True
    fs.delete(staged, False)
    return False


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("obj_id"), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, manifest: dict | None, only: set[int] | None = None) -> DataFrame:
    folders = sorted({f"{path}/tags/{run}/bucket={b}" for b, run in (manifest or {"runs": {}})["runs"].items() if only is None or int(b) in only})
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def read_tags(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(obj_id, key, value) as of a version, the last one by default; a store that nobody has written holds nothing."""
    there = _manifests(spark, path)
    number = version if version is not None else there[-1] if there else None
    return _read(spark, path, None if number is None else _manifest(spark, path, number))


def _sum(tags: DataFrame) -> tuple:
    """What tells two tables of tags apart: the number of rows and sums of two hashes of them."""
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    return tuple(tags.agg(F.count("*"), total("obj_id", "key", "value"), total("value", F.lit(1), "key", "obj_id")).first())


def _replace(spark: SparkSession, path: str, change, objects: DataFrame, buckets: int) -> int:
    """The version after the tags of some objects are replaced: ``change`` gives new tags of whole buckets from old ones."""
    while True:
        there = _manifests(spark, path)
        number = there[-1] if there else 0
        old = _manifest(spark, path, number) if there else {"buckets": buckets, "runs": {}}
        n = old["buckets"]
        touched = {r.bucket for r in objects.select(_bucket(n).alias("bucket")).distinct().collect()}  # n at most
        before = _read(spark, path, old, touched)
        run = uuid.uuid4().hex
        changed = change(before).withColumn("bucket", _bucket(n))
        changed.repartition("bucket").sortWithinPartitions("bucket", "obj_id", "key").write.partitionBy("bucket").parquet(f"{path}/tags/{run}")
        fs, where = file_system(spark, f"{path}/tags/{run}")
        made = {x.getPath().getName()[7:] for x in fs.listStatus(where) if x.getPath().getName().startswith("bucket=")}
        runs = {b: r for b, r in old["runs"].items() if int(b) not in touched} | {b: run for b in made}
        after = _read(spark, path, {"runs": {b: run for b in made}})
        if there and _sum(before) == _sum(after):
            fs.delete(where, True)
            return number
        if _commit(spark, path, number + 1, {"buckets": n, "runs": runs}):
            return number + 1
        fs.delete(where, True)


def write_tags(spark: SparkSession, path: str, tags: DataFrame, buckets: int = BUCKETS) -> int:
    """Replaces all tags of the objects that ``tags`` (obj_id, key, value) holds. Returns the version."""
    new = tags.select(*[F.col(c).cast("string") for c in ("obj_id", "key", "value")])
    return _replace(spark, path, lambda old: old.join(new.select("obj_id").distinct(), "obj_id", "left_anti").unionByName(new), new, buckets)


def write_back(spark: SparkSession, path: str, graph_names: DataFrame, relations: DataFrame, name_key: str = NAME_KEY, buckets: int = BUCKETS) -> int:
    """Names and relations of the objects in ``graph_names`` into their tags; other tags and objects stay. Returns the version."""
    return _replace(spark, path, lambda old: set_tags(old, graph_names, relations.join(graph_names.select("obj_id").distinct(), "obj_id", "left_semi"), name_key), graph_names, buckets)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the last ``keep`` manifests and the folders that none of those needs; not while somebody writes."""
    there = _manifests(spark, path)
    needed = {r for n in there[-keep:] for r in _manifest(spark, path, n)["runs"].values()}
    gone = 0
    for n in there[:-keep]:
        fs, where = file_system(spark, f"{path}/manifests/{n:012d}.json")
        fs.delete(where, False)
    fs, where = file_system(spark, f"{path}/tags")
    for x in fs.listStatus(where) if fs.exists(where) else []:
        if x.getPath().getName() not in needed:
            fs.delete(x.getPath(), True)
            gone += 1
    return gone
