"""State tables by version: every version is a folder of its own that a manifest names.

A writer puts its rows into a new folder and then claims the next version by creating that version's manifest, which
succeeds for one writer only; until then nobody sees the folder. Who loses reads the new version and makes its change
again. Manifests are created in one step: by an exclusive link on a local or mounted disk, elsewhere by the file system's
own create without overwriting (atomic on HDFS and on stores with conditional writes).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import unquote, urlparse
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.tables import read_state

Kinds = dict[str, str]


class Conflict(Exception):
    """Another writer has that version."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(home: str, version: int) -> str:
    return f"{home}/versions/{version:012d}"


def claim_local(path: str, text: str) -> None:
    """Creates a file with its text in one step; Conflict if there is one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    aside = f"{os.path.dirname(path)}/.{uuid4().hex}"
    with open(aside, "w") as f:
        f.write(text)
    try:
        os.link(aside, path)
    except FileExistsError as e:
        raise Conflict(path) from e
    finally:
        os.unlink(aside)


def claim(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _fs(spark, path)
    if fs.getScheme() == "file":
        return claim_local(unquote(urlparse(str(at.toUri())).path), text)
    if fs.exists(at):
        raise Conflict(path)
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(path) from e
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return None


def version_of(spark: SparkSession, home: str) -> tuple[int, str | None]:
    """(the last version, its folder); 0 and None where there is none."""
    at, fs = _fs(spark, f"{home}/versions")
    if not fs.exists(at):
        return 0, None
    found = max((f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=None)
    if found is None:
        return 0, None
    stream = fs.open(fs.makeQualified(_fs(spark, f"{home}/versions/{found}")[0]))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(found), f"{home}/data/{text.strip()}"


def latest(spark: SparkSession, home: str, kinds: Kinds) -> tuple[DataFrame, int]:
    """(the last version's rows, its number); an empty table and 0 where there is none."""
    version, folder = version_of(spark, home)
    return read_state(spark, folder or f"{home}/data/none", kinds), version


def commit(df: DataFrame, home: str, version: int) -> str:
    """Writes df as that version of the state; Conflict if another writer has it. The version's folder."""
    name = uuid4().hex
    df.write.mode("errorifexists").parquet(f"{home}/data/{name}")
    claim(df.sparkSession, _manifest(home, version), name)
    return f"{home}/data/{name}"


def update(spark: SparkSession, home: str, kinds: Kinds, change: Callable[[DataFrame], DataFrame], retries: int = 10) -> int:
    """Commits change(last version) as the next version; made again from the newer version each time another writer was
    first. The new version's number."""
    for _ in range(retries + 1):
        before, version = latest(spark, home, kinds)
        try:
            commit(change(before), home, version + 1)
            return version + 1
        except Conflict:
            continue
    raise Conflict(f"{home}: {retries + 1} times another writer was first")


def mirrored(spark: SparkSession, home: str, mirror: str, kinds: Kinds, change: Callable[[DataFrame], DataFrame]) -> str | None:
    """Commits to home and then copies that version to the mirror; what keeps the copy back is returned, not raised."""
    version = update(spark, home, kinds, change)
    try:
        folder = version_of(spark, home)[1]
        update(spark, mirror, kinds, lambda _: read_state(spark, folder, kinds))
    except Exception as e:  # the state itself is safe; the caller shows what went wrong with the copy
        return f"version {version}: {e}"
    return None
