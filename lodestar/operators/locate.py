"""Line numbers on a page: gutter markers, a robust line through them, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, NEAR_MIDDLE, BAND = 3, 0.12, 0.03


def markers(candidates: DataFrame, page: str = "page", width: str = "width") -> DataFrame:
    """page, y and line of the gutter's numbers among words (page, x, y, text, width).

    A marker is a multiple of 5 from 5 to 100 near the middle of the page, or in the narrow band of the others: the
    band's place is the upper median of those near the middle, or of all if none is.
    """
    n = F.col("text").try_cast("int")
    rows = candidates.withColumn("text", F.trim("text")).where(F.col("text").rlike("^[0-9]{1,3}$")).withColumn("line", n).where("line % 5 = 0 and line between 5 and 100")
    middle = F.col(width) / 2
    rows = rows.withColumn("_near", F.abs(F.col("x") - middle) <= NEAR_MIDDLE * F.col(width))
    pool = F.sort_array(F.collect_list(F.when(F.col("_near"), F.col("x"))))
    every = F.sort_array(F.collect_list("x"))
    bands = rows.groupBy(page).agg(F.when(F.size(pool) > 0, pool).otherwise(every).alias("_xs"))
    band = F.try_element_at("_xs", (F.floor(F.size("_xs") / 2) + 1).cast("int"))
    rows = rows.join(bands, page).where(F.col("_near") | (F.abs(F.col("x") - band) <= BAND * F.col(width)))
    return rows.select(page, "y", F.col("line").cast("long").alias("line"))


def fitted(points: DataFrame, page: str = "page", y: str = "y", value: str = "line") -> DataFrame:
    """page, slope, intercept, r2, n, dropped of the line value = slope * y + intercept through each page's points.

    After a fit, points farther from it than two deviations of the residuals, and half a line at
    least, are dropped and the fit is made anew, three times at most and never below two points. Pages with
    fewer than two points, or all at one y, have no row.
    """
    own = Window.partitionBy(page)
    rows = points.select(page, F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v")).withColumn("live", F.lit(True))
    rows = rows.withColumn("_all", F.count("*").over(own)).withColumn("done", F.lit(False))
    live = lambda c: F.when(F.col("live"), c)

    def line(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("my", F.avg(live(F.col("y"))).over(own)).withColumn("mv", F.avg(live(F.col("v"))).over(own))
        frame = frame.withColumn("_var", F.sum(live((F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))).over(own)).withColumn("_cov", F.sum(live((F.col("y") - F.col("my")) * (F.col("v") - F.col("mv")))).over(own))
        frame = frame.withColumn("slope", F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var"))).withColumn("intercept", F.col("mv") - F.col("slope") * F.col("my"))
        return frame.withColumn("r", F.col("v") - (F.col("slope") * F.col("y") + F.col("intercept")))

    rows = line(rows)
    for _ in range(ROUNDS):
        limit = F.greatest(2 * F.stddev_pop(live(F.col("r"))).over(own), F.lit(0.5))
        rows = rows.withColumn("_limit", limit).withColumn("_keep", F.col("live") & (F.abs("r") <= F.col("_limit")))
        rows = rows.withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(own)).withColumn("_had", F.sum(F.col("live").cast("int")).over(own))
        rows = rows.withColumn("done", F.col("done") | (F.col("_kept") == F.col("_had")) | (F.col("_kept") < 2)).withColumn("live", F.when(F.col("done"), F.col("live")).otherwise(F.col("_keep")))
        rows = line(rows)
    squares = F.sum(live(F.col("r") * F.col("r")))
    spread = F.sum(live((F.col("v") - F.col("mv")) * (F.col("v") - F.col("mv"))))
    n = F.sum(F.col("live").cast("long"))
    out = rows.groupBy(page).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.when(spread > 0, 1 - squares / spread).otherwise(1.0).alias("r2"), n.alias("n"), (F.first("_all") - n).alias("dropped"))
    return out.where("slope is not null and n >= 2")


def predicted(y: Column, slope: Column, intercept: Column) -> Column:
    """The printed line at y: half to even, 1 at least."""
    return F.greatest(F.lit(1), F.rint(slope * y + intercept).cast("long"))


def columns(lines: DataFrame, page: str = "page") -> DataFrame:
    """lines with the printed column: two to a page, pages counted as they come; column is 0 or 1."""
    return lines.withColumn("printed", 2 * (F.dense_rank().over(Window.orderBy(page)) - 1) + F.col("column") + 1)


def offsets(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines with the offset of each in the document's text, read by page, column, y, joined by one character."""
    before = Window.partitionBy(doc).orderBy("page", "column", "y").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def citation(first_column: Column, first_line: Column, last_column: Column, last_line: Column, number: Column | None = None) -> Column:
    """As patents are cited: col. 3, ll. 45-52."""
    s = lambda c: c.cast("string")
    one = F.concat(F.lit("col. "), s(first_column), F.lit(", l. "), s(first_line))
    range_ = F.concat(F.lit("col. "), s(first_column), F.lit(", ll. "), s(first_line), F.lit("-"), s(last_line))
    over = F.concat(one, F.lit(" to col. "), s(last_column), F.lit(", l. "), s(last_line))
    body = F.when(first_column != last_column, over).when(first_line == last_line, one).otherwise(range_)
    return body if number is None else F.when(number.isNull(), body).otherwise(F.concat(number, F.lit(", "), body))
