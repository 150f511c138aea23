"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a table is written: whole texts in batches of the usual 10,000 take much memory.
ROWS = 2000
#: Bytes that a table to be broadcast may have.
BROADCAST_BYTES = 64 << 20
_lock = threading.Lock()
_made: dict[str, SparkSession] = {}
_writing: dict[int, list] = {}
_local = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this machine only where that is unset and the master local.

    On a cluster that setting must be there: a machine's own folder is not seen by the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with _lock:
        if not _made:
            atexit.register(_clear)
        _made[path] = spark
    return path


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ROWS rows at most, until the last of the writes that run at a time has ended."""
    with _lock:
        held = _writing.setdefault(id(spark), [0, spark.conf.get(_BATCH)])
        held[0] += 1
        usual = int(held[1])
        spark.conf.set(_BATCH, str(min(usual, ROWS) if usual > 0 else ROWS))
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_BATCH, _writing.pop(id(spark))[1])


def stored(frame: DataFrame, what: str = "table") -> DataFrame:
    """Writes the frame to the shared folder and reads it again: its lineage ends there.

    A lost executor takes none of it along, unlike with a localCheckpoint. Within scratch() it is deleted at the end.
    """
    spark = frame.sparkSession
    path = new_path(spark, what)
    with _small_batches(spark):
        frame.write.parquet(path)
    for held in getattr(_local, "scratch", [])[-1:]:
        held.append(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Deletes the tables that stored() makes within it, but for those given to kept().

    A frame that is handed on must read kept tables only.
    """
    stack = _local.__dict__.setdefault("scratch", [])
    held: list[str] = []
    stack.append(held)
    try:
        yield held
    finally:
        stack.pop()
        for path in held:
            spark = _made.pop(path, None)
            if spark is not None:
                delete(spark, path)


def kept(frame: DataFrame) -> DataFrame:
    """A frame of stored(), which lives as long as what surrounds the innermost scratch()."""
    stack = getattr(_local, "scratch", [])
    if stack and frame._stored_at in stack[-1]:
        stack[-1].remove(frame._stored_at)
        if len(stack) > 1:
            stack[-2].append(frame._stored_at)
    return frame


def small(frame: DataFrame, row_bytes: int) -> bool:
    """Whether a stored frame, of about row_bytes bytes a row, may be broadcast."""
    return frame.count() * row_bytes <= BROADCAST_BYTES


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the context may be gone already
            return


def unused(frame: DataFrame, name: str) -> str:
    """name, or with underscores added until no column is called that."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def long_id(docs: DataFrame, name: str = "doc_id") -> Column:
    """The id column as a long. Ids of another type are refused: a cast would make nulls of them."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{name} must be of an integer type, not {kind.simpleString()}")
    return F.col(name).cast("long").alias(name)
