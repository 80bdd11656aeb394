"""Total orders over tables of any size: places, pages written once and read by number, and single pages without a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.plans.shared import written

#: The lower bits of monotonically_increasing_id() count the rows of a task.
OF_TASK = (1 << 33) - 1


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place (from 1) in a total order, by all tasks.

    The rows are sorted by ranges and written; each task's rows are numbered where they are, and the numbers of rows of
    the tasks before (a row a task) are added. Rows that are equal in the order get places in no order.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(ranged.withColumns({"task_": F.shiftright(at, 33), "at_": at.bitwiseAND(OF_TASK)}))
    before = W.orderBy("task_").rowsBetween(W.unboundedPreceding, -1)
    sizes = local.groupBy("task_").agg(F.count("*").alias("n_"))
    starts = sizes.select("task_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return local.join(F.broadcast(starts), "task_").withColumn(name, F.col("start_") + F.col("at_") + 1).drop("task_", "at_", "start_")


def write_pages(rows: DataFrame, order: list[Column], size: int, path: str) -> None:
    """The rows in order, with place and page, in files that each hold a range of pages: a page is then read from one of them."""
    numbered = placed(rows, order).withColumn("page", F.floor((F.col("place") - 1) / size) + 1)
    numbered.repartitionByRange("page").sortWithinPartitions("place").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


def read_page(pages: DataFrame, page: int) -> DataFrame:
    """A page of written pages, clamped to those that there are; files and row groups of other pages are skipped."""
    if page > 1:
        last = F.coalesce(pages.agg(F.max("page")).scalar(), F.lit(1))
        return pages.filter(F.col("page") == F.least(F.lit(page), last)).orderBy("place")
    return pages.filter(F.col("page") == 1).orderBy("place")


def paged(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows in a total order, the last one if there are less; nothing runs before the result is asked for.

    The first page * size rows are found by a bounded top-k, and tell whether the page is there: pages far behind are
    better written once (write_pages).
    """
    page = max(1, page)
    top = rows.orderBy(*order).limit(page * size)
    place, count = F.row_number().over(W.orderBy(*order)), F.count("*").over(W.partitionBy(F.lit(0)))
    numbered = top.withColumns({"place_": place, "count_": count})
    return numbered.filter(F.col("place_") > (F.ceil(F.col("count_") / size) - 1) * size).orderBy("place_").drop("place_", "count_")


def last_page(rows: DataFrame, order: list[Column], reverse: list[Column], size: int) -> DataFrame:
    """The last page of a total order, however many there are; reverse: the same order from its end.

    The rows are counted, and those of the page are found by a bounded top-k from the end.
    """
    on_it = F.coalesce((rows.agg(F.count("*").alias("n_")).scalar() - 1) % size + 1, F.lit(0))
    top = rows.orderBy(*reverse).limit(size).withColumn("back_", F.row_number().over(W.orderBy(*reverse)))
    return top.filter(F.col("back_") <= on_it).orderBy(*order).drop("back_")
