"""Operator 10: best-fit packing of documents into bins of CAPACITY words, hierarchical over residuals.

A document of n words is cut every CAPACITY words: full bins of one piece, and a rest. The rests are dealt by the hash of
doc_id to groups of about PER_GROUP items. Each group packs its items best-fit, longest first; bins filled to FULL or more
are done; the others go on as items, FAN groups to one, to the next round, until one group is left, which ends with
all. A group of a late round holds only the few bins that its FAN groups could not fill, so no round collects the items.

Defined results: a word is a run without white space. Null texts and texts without a word are in no bin. Rows are
packed as they are: repeated rows and null doc_ids are items of their own. Ties in length go by doc_id (null first), start. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY, FULL, PER_GROUP, FAN = 2048, 0.98, 20_000, 4

ITEM = "g long, n int, pieces array<struct<doc_id:long,start:long,n:int>>"
PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32())]))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: each item, in the given order, goes where it leaves least room; of equal bins to the latest."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set if there is a bin with room r
    for k, n in enumerate(sizes):
        fits = free >> n
        if n and fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            bins[b].append(k)
        else:
            r, b = capacity, len(bins)
            bins.append([k])
        if r > n:
            room.setdefault(r - n, []).append(b)
            free |= 1 << (r - n)
    return bins


def group_packer(capacity: int, full: int, fan: int, last: bool, level: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: packed_group(t, capacity, full, fan, last, level)


def packed_group(t: pa.Table, capacity: int, full: int, fan: int, last: bool, level: int) -> pa.Table:
    g = t["g"][0].as_py()
    items = list(zip(t["n"].to_pylist(), t["pieces"].to_pylist()))
    items.sort(key=lambda x: (-x[0], [(p["doc_id"] is not None, p["doc_id"] or 0, p["start"]) for p in x[1]]))
    out = []
    for k, b in enumerate(best_fit([n for n, _ in items], capacity)):
        n = sum(items[i][0] for i in b)
        out.append((g // fan, n, [p for i in b for p in items[i][1]], f"{level}.{g}.{k}" if last or n >= full else None))
    cols = list(zip(*out))
    return pa.table({"g": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int32()), "pieces": pa.array(cols[2], PIECES), "bin_id": pa.array(cols[3], pa.string())})


def packed(docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, per_group: int = PER_GROUP, fan: int = FAN) -> DataFrame:
    """(bin_id, slot, doc_id, start, n_words, bin_words): piece [start, start + n_words) of a document's words at place slot of a bin."""
    if capacity < 1 or fan < 2:
        raise ValueError("capacity is at least 1, fan at least 2")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count("text", F.lit(r"(?U)\S+")).cast("long").alias("n")).filter("n > 0")
    sizes = written(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    whole = sizes.filter(F.col("n") >= capacity).select("row", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("long") - 1)).alias("k"))
    whole = whole.select(F.concat_ws(".", F.lit("whole"), "row", "k").alias("bin_id"), F.lit(0).alias("slot"), "doc_id", (F.col("k") * capacity).alias("start"), F.lit(capacity).alias("n_words"), F.lit(capacity).alias("bin_words"))
    rest = sizes.withColumn("r", F.col("n") % capacity).filter("r > 0")
    groups = max(1, math.ceil(rest.count() / per_group))
    items = rest.select(
        F.pmod(F.xxhash64("doc_id", "n"), F.lit(groups)).alias("g"), F.col("r").cast("int").alias("n"),
        F.array(F.struct("doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").cast("int").alias("n"))).alias("pieces"),
    )
    done, level = None, 0
    while True:
        made = items.groupBy("g").applyInArrow(group_packer(capacity, math.ceil(full * capacity), fan, groups == 1, level), f"{ITEM}, bin_id string")
        made = written(made, "bins")
        bins = made.filter("bin_id IS NOT NULL")
        done = bins if done is None else done.unionByName(bins)
        if groups == 1:
            break
        items = made.filter("bin_id IS NULL").select("g", "n", "pieces")
        groups, level = math.ceil(groups / fan), level + 1
    rows = done.select("bin_id", F.col("n").alias("bin_words"), F.posexplode("pieces").alias("slot", "p"))
    return rows.select("bin_id", "slot", "p.doc_id", "p.start", F.col("p.n").alias("n_words"), "bin_words").unionByName(whole)
