"""Stored tables that change as a whole: immutable versions and a put-if-absent pointer.

A table's folder holds ``versions/<id>/`` (data folders, never changed once published) and
``commits/<number>`` (small files).  A writer builds a version of its own, then puts the
next commit number; only one writer can put a number, and the file appears with its
whole content.  Readers take the version that the highest number names.  So a reader
sees the state before or after a commit and nothing between, two builders never touch
each other's files, and a writer that dies leaves at most a version that no commit names.

The pointer is put by an atomic operation of the file system: a hard link on a local one,
a rename that refuses an existing target elsewhere.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: versions and commits younger than this are never cleaned (readers may be planning on them)
KEEP_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Commit:
    """One committed state: its number, data folder and what the writer noted."""

    number: int
    path: str
    notes: dict = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> dict[str, float]:
    """Entries of a folder and when each changed (seconds); none when it is not there."""
    fs, p = _hadoop(spark, folder)
    try:
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)}
    except Exception as e:
        if "FileNotFoundException" in str(e):
            return {}
        raise


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Make the file with its whole content at once; False when another writer made it first."""
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target.getParent())
    local = fs.getUri().getScheme() == "file"
    fresh = f"{target.getParent().toString()}/.{target.getName()}-{os.urandom(6).hex()}"
    _, temp = _hadoop(spark, fresh)
    if local:
        here = temp.toUri().getPath()
        with open(here, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(here, target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
    out = fs.create(temp, False)
    out.write(bytearray(content.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(temp, target, options)
        return True
    except Exception as e:
        fs.delete(temp, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def current(spark: SparkSession, path: str) -> Commit | None:
    """The newest commit, or None."""
    numbers = sorted(int(n) for n in _names(spark, f"{path}/commits") if n.isdigit())
    if not numbers:
        return None
    body = json.loads(_read(spark, f"{path}/commits/{numbers[-1]:012d}"))
    return Commit(numbers[-1], f"{path}/versions/{body['version']}", body["notes"])


def new_version(path: str) -> str:
    """A data folder of one's own; no reader sees it before ``publish``."""
    return f"{path}/versions/{int(time.time()):010d}-{os.urandom(6).hex()}"


def publish(spark: SparkSession, path: str, version: str, after: Commit | None, notes: dict | None = None) -> Commit | None:
    """Make ``version`` the state that follows ``after``; None when another writer was first."""
    number = after.number + 1 if after else 1
    body = json.dumps({"version": version.rsplit("/", 1)[1], "notes": notes or {}})
    if put_if_absent(spark, f"{path}/commits/{number:012d}", body):
        return Commit(number, version, notes or {})
    return None


def discard(spark: SparkSession, version: str) -> None:
    """Drop a version of one's own that was not published."""
    fs, p = _hadoop(spark, version)
    fs.delete(p, True)


def replace(spark: SparkSession, path: str, build: Callable[[Commit | None, str], dict | None], tries: int = 20) -> Commit:
    """Commit what ``build(state, folder)`` writes to ``folder`` from the state it is given; it
    returns the notes.  When another writer commits meanwhile it builds again, on that state."""
    for _ in range(tries):
        state, version = current(spark, path), new_version(path)
        notes = build(state, version)
        done = publish(spark, path, version, state, notes)
        if done:
            return done
        discard(spark, version)
    raise RuntimeError(f"{path}: other writers committed first {tries} times")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the newest commit."""
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(state.path)


def clean(spark: SparkSession, path: str, older_than: float = KEEP_SECONDS) -> int:
    """Drop versions that the newest commit does not name and that are older than
    ``older_than`` seconds: superseded ones and those of writers that died.  Commits stay
    but for the superseded old ones.  Returns the number of versions dropped."""
    state, now, dropped = current(spark, path), time.time(), 0
    for name, changed in _names(spark, f"{path}/versions").items():
        if (state is None or not state.path.endswith("/" + name)) and now - changed >= older_than:
            discard(spark, f"{path}/versions/{name}")
            dropped += 1
    for name, changed in _names(spark, f"{path}/commits").items():
        if state and name.isdigit() and int(name) < state.number and now - changed >= older_than:
            fs, p = _hadoop(spark, f"{path}/commits/{name}")
            fs.delete(p, False)
    return dropped
