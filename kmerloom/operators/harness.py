"""Read-level search: the first windows of one half of the reads against all windows of the other half."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import dna, hv
from kmerloom.operators import encode
from kmerloom.operators.similarity import MOST_BROADCAST, MOST_BROADCAST_KMERS, cells, met_by_broadcast

TOLERANCE = 1e-5


def halves(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first half of the reads (read_id, sequence) in order of read_id, rounded down, and the rest. Ids are distinct numbers."""
    n = reads.count()
    if n < 2:
        return reads.limit(0), reads
    last = reads.approxQuantile("read_id", [(n // 2) / n], 0.0)[0]
    return reads.where(F.col("read_id") <= last), reads.where(F.col("read_id") > last)


#: Queries of a group and windows of a strip (a quarter of a kilobyte each), and windows of a tile of scores.
GROUP = 512
STRIP = 16_384
TILE = 2048


def _best_of_cell(k: int, tile: int):
    """The k best windows of a strip for each query of a group; a tile of scores is made at a time and only what reaches the k-th best so far is kept."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        right = right.sort_by([("db_read", "ascending"), ("window_start", "ascending")]).combine_chunks()
        counts, n = encode.counts_of_lists(left.column("query_ids")), left.num_rows
        projected, length = counts @ hv.gram(), np.sqrt(left.column("query_norm2").to_numpy().astype(np.float64))
        size = np.sqrt(right.column("norm2").to_numpy().astype(np.float64))
        row, at, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        border = np.full(n, -np.inf)
        for lo in range(0, right.num_rows if n else 0, tile):
            made = (projected @ encode.counts_of_lists(right.column("ids").slice(lo, tile)).T) / (length[:, None] * size[None, lo : lo + tile])
            if k < made.shape[1]:
                border = np.maximum(border, np.partition(made, -k, axis=1)[:, -k])
            r, c = np.nonzero(made >= border[:, None])
            row, at, cosine = np.concatenate([row, r]), np.concatenate([at, lo + c]), np.concatenate([cosine, made[r, c]])
            order = np.lexsort((at, -cosine, row))
            row, at, cosine = row[order], at[order], cosine[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at, cosine = row[keep], at[keep], cosine[keep]
        columns = [left.column("read_id").take(pa.array(row)), right.column("db_read").take(pa.array(at)), right.column("window_start").take(pa.array(at)), pa.array(cosine)]
        return pa.table(columns, ["read_id", "db_read", "window_start", "cosine"])

    return search


def search_windows(queries: DataFrame, windows: DataFrame, k: int = 5, n_windows: int | None = None, group: int = GROUP, strip: int = STRIP, tile: int = TILE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(read_id, rank, db_read, window_start, cosine): the k best windows (read_id, window_start, ids, norm2) of each query (read_id, ids, norm2).

    Up to ``most_broadcast`` queries (and a bounded number of k-mers) are broadcast; the windows stay where they are, and each batch of them hands on k candidates a query. More queries
    are dealt with the windows into a grid (:func:`kmerloom.operators.similarity.cells`) of groups and strips, where each cell does so, and nothing passes through the
    driver. ``n_windows`` is an estimate where one is known, else the windows are counted for the grid. Dot products are exact;
    ties go to the lower read, then to the earlier window. Null vectors match nothing; an empty side gives no rows.
    """
    left = queries.where("norm2 > 0").select(F.col("read_id").cast("bigint").alias("read_id"), F.col("ids").alias("query_ids"), F.col("norm2").alias("query_norm2"))
    right = windows.where("norm2 > 0").select(F.col("read_id").cast("bigint").alias("db_read"), F.col("window_start").cast("bigint").alias("window_start"), "ids", "norm2")
    fields = "read_id bigint, db_read bigint, window_start bigint, cosine double"
    n, kmers = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("query_ids")), F.lit(0))).first()
    if n <= most_broadcast and kmers <= MOST_BROADCAST_KMERS:
        found = met_by_broadcast(left, right, _best_of_cell(k, tile), fields)
    else:
        groups = max(1, -(-n // group))
        strips = max(1, -(-(right.count() if n_windows is None else n_windows) // strip))
        a, b = cells(left, right, groups, strips)
        found = a.cogroup(b).applyInArrow(_best_of_cell(k, tile), fields)
    order = Window.partitionBy("read_id").orderBy(F.desc("cosine"), "db_read", "window_start")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("read_id", "rank", "db_read", "window_start", "cosine")


def read_search(reads: DataFrame, k: int = 5, rule: str = "gpu", **options) -> DataFrame:
    """:func:`search_windows` of the first window of each read of the first half; reads without a window are skipped."""
    first, second = halves(reads)
    n_windows = second.agg(F.coalesce(F.sum(F.size(dna.window_starts(F.length("sequence"), rule))), F.lit(0))).first()[0]
    # a first window needs no more of its read than its own bases and, by the cpu rule, one more
    begin = first.withColumn("sequence", F.substring("sequence", 1, dna.WINDOW + (1 if rule == "cpu" else 0)))
    inputs = encode.encode_windows(begin, rule=rule).where("window_start = 0").select("read_id", "ids", "norm2")
    return search_windows(inputs, encode.encode_windows(second, rule=rule), k, n_windows, **options)


def read_agreement(found: DataFrame, truth: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(n, n_agree): inputs whose best window's read is a read of ``truth`` (read_id, db_read, cosine) within the tolerance of the best."""
    top = truth.groupBy("read_id").agg(F.max("cosine").alias("top"))
    tied = truth.join(top, "read_id").where(F.col("cosine") >= F.col("top") - tolerance).select("read_id", "db_read").distinct().withColumn("ok", F.lit(1))
    hit = found.where("rank = 1").select("read_id", "db_read").join(tied, ["read_id", "db_read"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("n_agree"))
