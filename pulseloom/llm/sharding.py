"""Operator 7: shards from a consistent-hash ring with virtual nodes and bounded loads.

Rows fall into cells, arcs of the ring by the hash of the text, so that equal texts lie together. Cells are
placed on the ring, heaviest first; one whose shard is full goes on clockwise to the next shard with room.
A group of equal texts stays on one shard unless no shard has room for it: a text that holds more than HEAVY
of a shard's mean is a cell of its own, and if it fits nowhere, its rows are numbered throughout the table and
cut into HOT_PARTS by that number. The number of cells is fixed, and only their sizes leave the executors. Law: bytes.

Rows are numbered by the portion of a checkpoint that holds them and their place in it, so that no window, for
slots or for cuts, holds more rows than a portion. What is broadcast is a row for each cell or part, and one for each
portion and shard or hot text.

Defined results: a null text has size 1 and the checksum of an empty text; null and repeated doc_ids are
ordinary rows; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Cells: the bound of what is collected and broadcast.
ARC_BITS = 14
CELLS = 1 << ARC_BITS
#: A text of more than this share of a shard's mean is a cell of its own, in so many parts; fewer than shards / HEAVY texts are.
HEAVY, HOT_PARTS = 0.25, 1024
VIRTUAL_NODES = 128
#: A shard takes at most this much over the mean.
SLACK = 0.002


def ring(shards: int, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes in clockwise order; those of a shard do not depend on the others."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def place(weights: dict[int, int], shards: int, slack: float = SLACK, cells: int = CELLS, parts: dict[int, dict[int, int]] | None = None) -> dict[int, int]:
    """The shard of each cell, none of which exceeds (1 + slack) times the mean unless a single cell must.

    Cells in parts that fit nowhere are placed part by part: the result then has their parts' names instead.
    """
    nodes = ring(shards)
    where = [p for p, _ in nodes]
    most = (1 + slack) * sum(weights.values()) / shards
    loads, out = [0] * shards, {}

    def clockwise(at: int, weight: int, must: bool) -> int | None:
        start, tried = bisect_left(where, at), set()
        for i in range(len(nodes)):
            shard = nodes[(start + i) % len(nodes)][1]
            if shard in tried:
                continue
            if loads[shard] + weight <= most:
                return shard
            tried.add(shard)
            if len(tried) == shards:
                break
        return min(range(shards), key=lambda s: (loads[s], s)) if must else None

    left: list[tuple[int, int, int]] = []
    for cell, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        pieces = (parts or {}).get(cell)
        shard = clockwise(((2 * (cell % cells) + 1) << 63) // cells, weight, not pieces)
        if shard is None:
            left += [(w, name, _position(name)) for name, w in pieces.items()]
            continue
        loads[shard] += weight
        out |= dict.fromkeys(pieces or (cell,), shard)
    for weight, name, at in sorted(left, key=lambda x: (-x[0], x[1])):
        shard = clockwise(at, weight, True)
        loads[shard] += weight
        out[name] = shard
    return out


def _position(name: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"part {name}".encode(), digest_size=8).digest(), "big")


def assign_shards(docs: DataFrame, shards: int = 8, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of docs (doc_id, text)."""
    text = text_or_empty()
    own = F.xxhash64(text)
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), own.alias("own"), F.shiftrightunsigned(own, 64 - ARC_BITS).cast("int").alias("cell"))
    # numbers that stay as they are: a row's portion of the table, and its place there
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id())).withColumn("portion", F.shiftright("row", 33))
    weights = {r.cell: r.bytes for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes")).collect()}  # CELLS rows at most
    heavy = HEAVY * sum(weights.values()) / shards
    full = [c for c, w in weights.items() if w > heavy]  # fewer than shards / HEAVY
    hot = rows.where(F.col("cell").isin(full)).groupBy("own", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > heavy).orderBy("own").collect() if full else []
    rows, parts = rows.withColumn("part", F.col("cell")), {}
    if hot:
        # the rows of a hot text are numbered throughout the table, portion by portion, and cut by that number
        name = F.coalesce(*[F.when(F.col("own") == r.own, CELLS + i * HOT_PARTS) for i, r in enumerate(hot)])
        is_hot = F.col("own").isin([r.own for r in hot])
        before = Window.partitionBy("own").orderBy("portion")
        starts = rows.where(is_hot).groupBy("own", "portion").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(before) - F.col("n")).drop("n")
        total = F.coalesce(*[F.when(F.col("own") == r.own, r.n) for r in hot])
        nth = F.col("start") + F.row_number().over(Window.partitionBy("own", "portion").orderBy("row")) - 1
        cold = rows.where(~is_hot)
        rows = rows.where(is_hot).join(F.broadcast(starts), ["own", "portion"]).withColumn("part", (name + F.floor(nth * HOT_PARTS / total)).cast("int")).drop("start")
        for i, r in enumerate(hot):
            weights[r.cell] -= r.bytes
            weights[r.cell + CELLS * (i + 1)] = r.bytes  # the same place on the ring
            parts[r.cell + CELLS * (i + 1)] = {}
        rows = cut(cold.unionByName(rows))
        for r in rows.where(F.col("part") >= CELLS).groupBy("part").agg(F.sum("size").alias("bytes")).collect():  # HOT_PARTS rows a hot text at most
            i = (r.part - CELLS) // HOT_PARTS
            parts[hot[i].cell + CELLS * (i + 1)][r.part] = r.bytes
    shard_of = place({c: w for c, w in weights.items() if w}, shards, slack, parts=parts)
    table = docs.sparkSession.createDataFrame(pd.DataFrame(shard_of.items(), columns=["part", "shard"]).astype("int32"), "part int, shard int")
    placed = rows.join(F.broadcast(table), "part")
    before = Window.partitionBy("shard").orderBy("portion")  # a row for each portion of the table
    first = placed.groupBy("shard", "portion").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(before) - F.col("n")).drop("n")
    within = Window.partitionBy("shard", "portion").orderBy("row")
    return (
        placed.join(F.broadcast(first), ["shard", "portion"])
        .withColumn("nth", F.row_number().over(within))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The whole rows of docs, one folder for each shard. doc_id must be a key; rows without one stay out."""
    to = assign_shards(docs, shards).where("doc_id is not null").select("doc_id", "shard", "slot")
    docs.join(to, "doc_id").repartition(shards * 4, "shard", F.col("slot") % 4).write.partitionBy("shard").parquet(path)
