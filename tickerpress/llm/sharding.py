"""Shards of near equal bytes from sampled splitters.

Records are put in the order of (hash of the text, id, row number): equal texts
are neighbours, and no key is shared by two rows, so a group of copies of any
size can be cut anywhere.  A weighted sample of the keys gives the boundaries of
many ranges, ranges that turn out overfull are sampled again and subdivided, and
running sums inside the ranges place every record exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerpress.session import write_through

#: Ranges per shard and key draws per range.  The draws are all that reaches the
#: driver, besides one sum per range.
RANGES_PER_SHARD = 16
DRAWS_PER_RANGE = 32
#: Rows that one range should hold at most; more rows make more ranges.
ROWS_PER_RANGE = 1_000_000
#: A range is overfull beyond so many times the mean weight.
OVERFULL = 2.0
KEY = ["text_key", "id_key", "row_no"]


def place(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every row a shard (0 .. shards-1) and a gapless slot in it.

    Returns id, size, text_crc32, law, shard, slot, grown_shard.  Size is the
    UTF-8 bytes of the text plus 8.  The law is ``bytes``: a row belongs to the
    shard that holds the middle of its bytes in key order, so a shard's bytes
    differ from an equal share by less than its two outermost records.

    Null texts count as empty (size 8, crc 0).  Null ids sort first among equal
    texts.  Repeated rows are placed one by one.  An empty table gives no rows;
    with fewer rows than shards some shards stay empty.  Other columns are not
    read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = write_through(docs.select(
        F.col(id_col), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("id_key"),
        # Frozen by the write: a lost executor cannot renumber rows.
        F.monotonically_increasing_id().alias("row_no")), "shard-rows")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return _result(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), id_col)
    # Ranges are balanced by bytes and rows alike: a third of all rows may be empty texts.
    mean = total / n
    weight = F.col("size") + F.lit(mean)
    ranges = max(RANGES_PER_SHARD * shards, -(-n // ROWS_PER_RANGE))
    bounds = _quantiles(_draws(rows, weight, 2 * total, ranges * DRAWS_PER_RANGE, 0), ranges)
    while True:
        ranged = rows.withColumn("range", _range_of(bounds)(*KEY))
        sums = ranged.groupBy("range").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).toPandas()
        full = sums[(sums.w > OVERFULL * 2 * total / ranges) & (sums.n > 2 * DRAWS_PER_RANGE)]
        if full.empty:
            break
        more = [_quantiles(_draws(ranged.where(F.col("range") == int(r.range)), weight, r.w,
                                  DRAWS_PER_RANGE * int(np.ceil(r.w * ranges / total)), len(bounds)),
                           int(np.ceil(r.w * ranges / total))) for r in full.itertuples()]
        finer = sorted({*bounds, *(b for bs in more for b in bs)})
        if len(finer) == len(bounds):
            break
        bounds = finer
    sums = sums.sort_values("range")
    sums["bytes_before"] = sums["size"].cumsum() - sums["size"]
    sums["rows_before"] = sums["n"].cumsum() - sums["n"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(sums[["range", "bytes_before", "rows_before"]],
                                   "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy(*KEY)
    inside = ranged.withColumns({
        "run": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "at": F.row_number().over(order)})
    # One row per range, counted above: small whatever the number of records.
    placed = inside.join(F.broadcast(starts), "range").withColumns({
        "middle": 2 * (F.col("bytes_before") + F.col("run")) - F.col("size"),
        "index": F.col("rows_before") + F.col("at") - 1})
    shard = F.floor(F.col("middle").cast("decimal(38,0)") * shards / F.lit(2 * total)).cast("int")
    placed = write_through(placed.withColumn("shard", F.least(shard, F.lit(shards - 1))), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    placed = placed.join(F.broadcast(first), "shard")  # one row per shard
    return _result(placed.withColumn("slot", F.col("index") - F.col("first")), id_col)


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> DataFrame:
    """Write the records as Parquet, one folder per shard, and return the placement.

    Ids have to be unique and not null here, since records meet their place by id.
    """
    placed = write_through(place(docs, shards, id_col), "shard-map")
    (docs.join(placed.select(id_col, F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), id_col)
         .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
         .write.partitionBy("_shard").parquet(path))
    return placed


def _draws(rows: DataFrame, weight, total: float, draws: int, salt: int) -> pd.DataFrame:
    """About ``draws`` keys, drawn by weight; a key heavier than a draw counts as often."""
    share = weight * F.lit(draws / total)
    coin = F.pmod(F.xxhash64(*KEY, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(coin < share).select(*KEY, F.greatest(share, F.lit(1.0)).alias("w")).toPandas()


def _quantiles(sample: pd.DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """Keys that cut the sample into ``ranges`` parts of equal weight."""
    if sample.empty:
        return []
    sample = sample.sort_values(KEY)
    upto = sample["w"].cumsum().to_numpy()
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    keys = sample[KEY].astype("int64").to_numpy()
    return sorted({tuple(map(int, keys[c])) for c in cuts})


def _range_of(bounds: list[tuple[int, int, int]]):
    """The number of boundaries at or below a key."""
    cuts = np.array(bounds, dtype=np.int64).reshape(-1, 3)

    @F.pandas_udf("int")
    def range_of(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        n = len(a)
        both = np.concatenate([cuts, np.stack([a, b, c], axis=1).astype(np.int64)])
        is_row = np.arange(len(both)) >= len(cuts)
        order = np.lexsort((is_row, both[:, 2], both[:, 1], both[:, 0]))
        below = np.cumsum(~is_row[order])
        out = np.empty(len(both), dtype=np.int32)
        out[order] = below
        return pd.Series(out[len(cuts):][:n])

    return range_of


def _result(placed: DataFrame, id_col: str) -> DataFrame:
    return placed.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
