"""Sharding by histogram sort: equal bytes, one exchange.

Rows are ordered by a 63-bit key: the upper 24 bits hash the text, the lower 39 the
id and the row's number (its partition and place in it). Copies of a text are neighbours,
yet a group of copies of any size, also of rows with equal ids or none, has as many keys
as rows and can be cut anywhere. A row's number may differ when it is computed anew, so rows
and keys are written once before they are counted. Splitters are found by counting, not by
sampling: the bytes in every interval of ``DIGIT`` key bits are summed (a map-side
sum, at most 2^DIGIT rows for each open splitter reach the driver), the interval that
holds a splitter's target is probed with the next bits, until every splitter is
within ``TOLERANCE`` of a shard's bytes or its interval is one key. Then every row
knows its shard, and the rows are exchanged once.

Slots are gapless: a shard's rows are dealt to lanes by low key bits, a lane is
ranked in key order and starts after the rows of the lanes before it, so no shard
is ever sorted in one task.

Law: ``bytes`` (shard sizes near equal; a size is the text's UTF-8 bytes plus 8).

Defined results: a null text has no bytes and its own key; a null id is a key like
others; repeated rows are sharded each; an empty table gives an empty table. Columns
of the input named like result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callwise.llm.textbytes import checkpointed

DIGIT = 12               # key bits probed at a time
TOLERANCE = 0.001        # accepted error of a splitter, as a share of a shard's bytes
LANE_ROWS = 20_000       # rows ranked together
BITS = 63                # keys are 0 .. 2^63 - 1


def sort_key(text: Column, doc_id: Column, number: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(F.lit("text"), text), 64 - 24)
    low = F.shiftrightunsigned(F.xxhash64(F.lit("id"), doc_id, number), 64 - (BITS - 24))
    return F.shiftleft(high, BITS - 24).bitwiseOR(low)


def splitters(keys: DataFrame, count: int) -> list[int]:
    """``count - 1`` rising keys; shard s holds the keys from splitter s-1 up to, not
    including, splitter s. ``keys`` has key and size."""
    total = keys.agg(F.sum(F.col("size").cast("decimal(38,0)"))).first()[0]
    if not total or count < 2:
        return []
    total = int(total)
    error = TOLERANCE * total / count
    found: dict[int, int] = {}
    # open intervals: (first key, bits left) -> (bytes before it, splitters with targets inside)
    open_ = {(0, BITS): (0, list(range(1, count)))}
    while open_:
        wide = next(iter(open_))[1]
        step = min(DIGIT, wide)
        part = F.shiftright("key", wide - step)
        inside = keys if wide == BITS else keys.where(F.shiftright("key", wide).isin([f >> wide for f, _ in open_]))
        sums = {r[0]: int(r[1]) for r in inside.groupBy(part.alias("p")).agg(F.sum(F.col("size").cast("decimal(38,0)"))).collect()}
        deeper: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (first, _), (before, mine) in open_.items():
            base = first >> (wide - step)
            for p in range(base, base + (1 << step)):
                after = before + sums.get(p, 0)
                while mine and total * mine[0] <= after * count:
                    s = mine.pop(0)
                    target = total * s / count
                    low, high = p << (wide - step), (p + 1) << (wide - step)
                    if min(target - before, after - target) <= error or wide == step:
                        found[s] = low if target - before < after - target else high
                    else:
                        deeper.setdefault((low, wide - step), (before, []))[1].append(s)
                before = after
        open_ = deeper
    return [found[s] for s in range(1, count)]


def sharded(docs: DataFrame, count: int = 24) -> DataFrame:
    """``docs`` with size, shard (0 .. count - 1), slot (gapless in its shard) and key."""
    made = ["size", "key", "shard", "slot"]
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    key = sort_key(text, F.col("doc_id"), F.monotonically_increasing_id())
    rows = checkpointed(docs.select(*[c for c in docs.columns if c not in made], size.alias("size"), key.alias("key")), "keys")
    keys = rows.select("key", "size")
    cuts = splitters(keys, count)
    shard = lambda k: sum((F.when(k >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # names of work columns that the documents don't have
    lane_, n_, before_, rank_ = (name + "_" * (1 + max((len(c) for c in docs.columns), default=0)) for name in ("lane", "n", "before", "rank"))
    lanes = max(1, -(-keys.count() // (count * LANE_ROWS)))
    lane = lambda k: F.pmod(k, F.lit(lanes)).cast("int")
    # rows of each lane, and of the lanes before it in its shard
    starts = (keys.groupBy(shard(F.col("key")).alias("shard"), lane(F.col("key")).alias(lane_)).agg(F.count(F.lit(1)).alias(n_))
              .withColumn(before_, F.sum(n_).over(W.partitionBy("shard").orderBy(lane_)) - F.col(n_)).drop(n_))
    rows = rows.withColumn("shard", shard(F.col("key"))).withColumn(lane_, lane(F.col("key")))
    rank = F.row_number().over(W.partitionBy("shard", lane_).orderBy("key", "doc_id"))
    return (rows.withColumn(rank_, rank).join(starts, ["shard", lane_])
            .withColumn("slot", F.col(before_) + F.col(rank_) - 1).drop(lane_, before_, rank_))


def op6_histogram_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return sharded(docs, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                    F.lit(None).cast("int").alias("grown_shard"))
