"""Tables that are replaced as a whole: every version is a folder of its own, and a log of numbered commits says which is current.

A version is written first and committed last, so a write that fails leaves what was there. A number can be committed once only: of two
writers that started from one version, the second fails and may try again from what the first left.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class ConcurrentCommit(RuntimeError):
    """Somebody else has committed since the version that a write started from."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    log = path(f"{root}/_log")
    return path, log, log.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, folder) of the last commit; (0, None) where there is none."""
    path, log, files = _files(spark, root)
    if not files.exists(log):
        return 0, None
    names = sorted((s.getPath().getName() for s in files.listStatus(log)), reverse=True)
    for name in (n for n in names if n.isdigit()):
        stream = files.open(path(log, name))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        if text.endswith("\n"):  # a commit that is being written is none yet
            return int(name), text.strip()
    return 0, None


def new_folder() -> str:
    return f"v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, after: int, folder: str) -> int:
    """Make ``folder`` current, if the last commit is still number ``after``."""
    path, log, files = _files(spark, root)
    if current(spark, root)[0] != after:
        raise ConcurrentCommit(f"{root} has moved on from version {after}")
    target = path(log, f"{after + 1:012d}")
    try:
        stream = files.create(target, False)
    except Exception as e:
        raise ConcurrentCommit(f"{root} has moved on from version {after}") from e
    stream.write(bytearray(f"{folder}\n".encode()))
    stream.close()
    return after + 1


def state(spark: SparkSession, root: str, empty: dict) -> tuple[int, dict]:
    """The number of the last commit and what its version says of itself, or ``empty``."""
    number, folder = current(spark, root)
    return number, json.loads(spark.read.text(f"{root}/{folder}/state").first()["value"]) if folder else empty


def commit_state(spark: SparkSession, root: str, after: int, folder: str, held: dict) -> int:
    """Write what a version says of itself, and make it current."""
    spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{root}/{folder}/state")
    return commit(spark, root, after, folder)


def retried(write, tries: int = 3):
    """What ``write`` returns, called again while somebody else commits first."""
    for left in range(tries - 1, -1, -1):
        try:
            return write()
        except ConcurrentCommit:
            if not left:
                raise
