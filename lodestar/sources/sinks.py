"""Writing: appends that can be resumed, swaps of whole tables, reports, progress."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def exists(spark: SparkSession, path: str) -> bool:
    files, target, _ = _files(spark, path)
    return files.exists(target)


def append_new(rows: DataFrame, path: str, key: str, form: str = "json") -> int:
    """Appends the rows whose key is not there yet, one for each key; how many. Running it again adds nothing."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    if exists(spark, path):
        held = spark.read.schema(rows.schema).format(form).load(path).select(key)
        new = new.join(held, key, "left_anti")
    new = new.cache()
    count = new.count()
    if count:
        new.write.mode("append").format(form).save(path)
    new.unpersist()
    return count


def replace(rows: DataFrame, path: str, form: str = "json") -> None:
    """Writes beside the old table and then takes its place, so that a failure leaves the old one."""
    spark = rows.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    rows.write.format(form).save(fresh)
    files, target, jvm = _files(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(old)
    files.delete(aside, True)
    if files.exists(target):
        files.rename(target, aside)
    files.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    files.delete(aside, True)


def updated(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame], form: str = "json") -> None:
    """Replaces a table by what change makes of it."""
    replace(change(spark.read.schema(schema).format(form).load(path)), path, form)


class Progress:
    """Which inputs are done and which failed, in one small file that is replaced whole. A damaged file counts as none."""

    def __init__(self, path: str | Path, every: int = 50) -> None:
        self._path, self._every, self._since = Path(path), every, 0
        try:
            state = json.loads(self._path.read_text())
            self.processed, self.failed, self.last = int(state["processed"]), list(state["failed"]), state["last_processed_id"]
        except (OSError, ValueError, KeyError, TypeError):
            self.processed, self.failed, self.last = 0, [], None

    def succeeded(self, item: str) -> None:
        self.processed, self.last = self.processed + 1, item
        self.failed = [f for f in self.failed if f != item]
        self._count()

    def broke(self, item: str) -> None:
        if item not in self.failed:
            self.failed.append(item)
        self._count()

    def _count(self) -> None:
        self._since += 1
        if self._since >= self._every:
            self.save()

    def save(self) -> None:
        part = self._path.with_suffix(f".{uuid.uuid4().hex}")
        part.write_text(json.dumps({"processed": self.processed, "failed": self.failed, "last_processed_id": self.last}))
        part.replace(self._path)
        self._since = 0

    def remaining(self, items: Iterable[str]) -> Iterator[str]:
        """The items after the last one done, and those that failed; all of them if the last is not among them."""
        items = list(items)
        after = items.index(self.last) + 1 if self.last in items else 0
        return iter([i for i in items[:after] if i in self.failed] + items[after:])


def report_markdown(name: str, means: DataFrame, per_query: DataFrame, errors: Iterable[str] = ()) -> str:
    """An evaluation as text; both tables are small."""
    metrics = means.orderBy("metric").collect()
    rows = per_query.orderBy("query_id").collect()
    head = per_query.columns
    out = [f"# {name}", "", *(f"- {m['metric']}: {m['value']:.4f}" for m in metrics), "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    out += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join([*out, *(f"- error: {e}" for e in errors)])


def report_json(path: str | Path, name: str, means: DataFrame, per_query: DataFrame, curve: DataFrame) -> None:
    table: Callable[[DataFrame, str], list[dict[str, Any]]] = lambda frame, by: [r.asDict() for r in frame.orderBy(by).collect()]
    Path(path).write_text(json.dumps({"name": name, "aggregates": table(means, "metric"), "rows": table(per_query, "query_id"), "mean_curve": table(curve, "k")}, indent=1))
