"""Records of one patent from several sources, made one.

Records are taken by falling fidelity, then order of ingest. A scalar is the first that is not null (an empty string
counts); a list of claims, sections or figures is the first that is not empty; other lists are joined in that
order, each entry once by its key; citations' flags are or-ed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ("is_examiner", "is_applicant", "is_third_party", "is_family_to_family")


def _ordered(records: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce("fidelity", F.lit(0))), "ingest_seq")
    return records.withColumn("_n", F.row_number().over(order))


def _first(name: str, ok: Column) -> Column:
    return F.min_by(F.when(ok, F.col(name)), F.when(ok, F.col("_n"))).alias(name)


def merged(records: DataFrame, key: str = "doc_key", scalars: tuple[str, ...] = (), whole: tuple[str, ...] = (), joined: dict[str, str | None] | None = None) -> DataFrame:
    """A row for each key: n_records, fidelity, the scalars, the lists taken whole, and the lists joined.

    joined maps a list's column to the field that is its entries' key, or None for the entry itself;
    names compare without case.
    """
    rows = _ordered(records, key)
    base = rows.groupBy(key).agg(
        F.count("*").alias("n_records"),
        F.max(F.coalesce("fidelity", F.lit(0))).alias("fidelity"),
        *[_first(s, F.col(s).isNotNull()) for s in scalars],
        *[_first(w, F.size(w) > 0) for w in whole],
    )
    for name, field in (joined or {}).items():
        entries = rows.select(key, "_n", F.posexplode(name).alias("_p", "_e"))
        entry = F.col("_e") if field is None else F.col(f"_e.{field}")
        entries = entries.withColumn("_k", F.lower(entry.cast("string")))
        once = entries.groupBy(key, "_k").agg(F.min_by(F.struct("_n", "_p", "_e"), F.struct("_n", "_p")).alias("s"))
        lists = once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s._n", "s._p", "s._e"))), lambda x: x["_e"]).alias(name))
        base = base.join(lists, key, "left")
    return base


def citations(edges: DataFrame) -> DataFrame:
    """src_key, display and the or-ed flags of citation rows, in first-seen order by (n, pos)."""
    rows = edges.groupBy("src_key", "display").agg(*[F.bool_or(f).alias(f) for f in FLAGS], F.min(F.struct("n", "pos")).alias("_first"))
    order = Window.partitionBy("src_key").orderBy("_first")
    return rows.withColumn("n", F.row_number().over(order) - 1).drop("_first")


def fold(records: list[dict]) -> dict:
    """The same for a few records on the driver: scalars and lists without keys."""
    out: dict = {}
    for record in sorted(records, key=lambda r: -(r.get("fidelity") or 0)):
        for name, value in record.items():
            if isinstance(value, list):
                held = out.setdefault(name, [])
                held += [v for v in value if v not in held]
            elif out.get(name) is None:
                out[name] = value
    return out


def latest(records: DataFrame, key: str = "doc_key", seq: str = "ingest_seq") -> DataFrame:
    """The last record of each key, as an index that is written again keeps it."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")
