"""Collections of points in buckets: an upsert rewrites the buckets that it touches and then switches the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspring.functions import ids
from docspring.operators.batching import keep_last
from docspring.sources import manifests

#: Buckets of a collection. A bucket is what one task rewrites at least: choose some hundred MB of points for each.
BUCKETS = 32


def reset(spark: SparkSession, path: str, vector_size: int, buckets: int = BUCKETS) -> None:
    """An empty collection for vectors of this size under cosine, after whatever was there. Its old files go with the next
    upserts, so that readers can finish."""
    before = manifests.read(spark, path) or {}
    manifests.commit(spark, path, {"version": before.get("version", 0), "size": vector_size, "distance": "cosine", "buckets": buckets, "files": {}, "parts": []})


def state(spark: SparkSession, path: str) -> dict:
    found = manifests.read(spark, path)
    if found is None:
        raise FileNotFoundError(f"no collection in {path}")
    return found


def folders(path: str, held: dict, buckets: list[int] | None = None) -> list[str]:
    return [f"{path}/data/{part}/bucket={b}" for b, part in held["files"].items() if buckets is None or int(b) in buckets]


def points(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All points of the last version, or of another that is still there; None of an empty collection."""
    held = state(spark, path) if version is None else manifests.read(spark, path, version)
    some = folders(path, held)
    return spark.read.option("mergeSchema", "true").parquet(*some) if some else None


def upsert(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks with vectors as points, over those that are stored: of one chunk id the last of the batch overwrites the others,
    and points that the batch doesn't name stay. Returns all points.

    Buckets that no point of the batch falls into aren't read. Until the manifest is switched, readers see the version before,
    also if the job breaks off; a batch that is repeated gives the same points."""
    spark = chunks.sparkSession
    held = state(spark, path)
    size, bucket = held["size"], F.pmod(F.xxhash64("point_id"), F.lit(held["buckets"])).cast("int")
    good = F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector isn't of size {size}")))
    part = f"v{held['version'] + 1:012d}-{ids_of_job(spark)}"
    batch = keep_last(chunks, "chunk_id", "chunk_pos").withColumns({"point_id": ids.point_uuid("chunk_id"), "embedding": good}).withColumn("bucket", bucket)
    staged = f"{path}/data/{part}-batch"
    batch.write.mode("overwrite").parquet(staged)
    new = spark.read.parquet(staged)
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # as many as there are buckets
    if touched:
        merged, old = new, folders(path, held, touched)
        if old:
            before = spark.read.option("mergeSchema", "true").parquet(*old)
            kept = before.join(new.select("point_id"), "point_id", "left_anti").withColumn("bucket", bucket)
            merged = new.unionByName(kept, allowMissingColumns=True)
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{part}")
    files = held["files"] | {str(b): part for b in touched}
    made = manifests.commit(spark, path, held | {"files": files, "parts": sorted(set(files.values()))})
    manifests.swept(spark, path, "data", set(made["parts"]))
    return points(spark, path)


def ids_of_job(spark: SparkSession) -> str:
    """Part of a folder's name: two writers don't share one."""
    return f"{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid().alias('u')).head().u[:8]}"
