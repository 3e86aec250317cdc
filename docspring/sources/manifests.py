"""Versioned manifests: what belongs to a table, switched in one step when new files are in place."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from docspring.staging import filesystem

_NAME = re.compile(r"manifest-([0-9]{12})\.json")


def versions(spark: SparkSession, path: str) -> list[int]:
    p, fs = filesystem(spark, path)
    if not fs.exists(p):
        return []
    found = (_NAME.fullmatch(s.getPath().getName()) for s in fs.listStatus(p))
    return sorted(int(m[1]) for m in found if m)


def read(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or of the last; None where there is none."""
    if version is None:
        every = versions(spark, path)
        if not every:
            return None
        version = every[-1]
    raw = spark.read.text(f"{path}/manifest-{version:012d}.json", wholetext=True).head()[0]
    return json.loads(raw)


def commit(spark: SparkSession, path: str, state: dict) -> dict:
    """The state as the version after the one that it was made from. Written beside and renamed; a version that another writer
    took meanwhile isn't overwritten, that is an error, and nothing of what readers see changes before."""
    made = state | {"version": state.get("version", 0) + 1}
    name = f"{path}/manifest-{made['version']:012d}.json"
    target, fs = filesystem(spark, name)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{name}.tmp-{spark.sparkContext.applicationId}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(json.dumps(made).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise RuntimeError(f"version {made['version']} of {path} was written by another writer")
    return made


def swept(spark: SparkSession, path: str, folder: str, used: set[str], versions_kept: int = 2) -> None:
    """Deletes the parts of a folder that none of the last versions names, and older manifests. used: parts of the last version;
    those of the versions before it are looked up under "parts"."""
    every = versions(spark, path)
    for v in every[-versions_kept:-1]:
        used = used | set(read(spark, path, v).get("parts", []))
    p, fs = filesystem(spark, f"{path}/{folder}")
    if fs.exists(p):
        for s in fs.listStatus(p):
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
    for v in every[:-versions_kept]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{v:012d}.json"), False)
