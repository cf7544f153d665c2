"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.session import global_rank, materialize


def ring_nodes(shards: int, nodes: int, cells: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of each shard's virtual nodes."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def place_cells(loads: dict[int, int], shards: int, nodes: int, cells: int, slack: float) -> dict[int, int]:
    """The shard of each cell. A cell walks clockwise from its own place to the first virtual node whose shard has room.

    A shard has room up to (1 + slack) times the mean. Cells come heaviest first, so that the light ones fill what is
    left; one that fits nowhere goes to the emptiest shard, which holds no more than the mean. So no shard ever holds more
    than (1 + slack) times the mean or the mean and the heaviest cell, whichever is more. A cell whose home shard has
    room does not move.
    """
    ring = ring_nodes(shards, nodes, cells)
    starts = [c for c, _ in ring]
    room = (1 + slack) * sum(loads.values()) / shards
    held = [0] * shards
    placed = {}
    for cell, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at, seen = bisect.bisect_left(starts, cell), set()
        home = -1
        for step in range(len(ring)):
            shard = ring[(at + step) % len(ring)][1]
            if shard not in seen and held[shard] + load <= room:
                home = shard
                break
            seen.add(shard)
            if len(seen) == shards:
                break
        if home < 0:
            home = min(range(shards), key=lambda s: (held[s], s))
        placed[cell] = home
        held[home] += load
    return placed


def ring_shards(
    docs: DataFrame,
    shards: int = 8,
    nodes: int = 128,
    cells: int = 65536,
    slack: float = 0.0002,
    hot: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id_col, size, text_crc32, cell, shard, slot.

    A document's place on the ring is a hash of its text, one of ``cells`` places, so equal texts go to one shard. Only
    a text whose copies weigh more than 1 / ``hot`` of a shard's mean is spread: its rows are dealt by id over as many
    places as keep each under that weight; there are fewer than ``hot`` * ``shards`` such texts, whatever the input. Heavy places
    are put first and light ones fill up, so groups below that weight need not be spread for balance.
    Loads are summed by place (a table whose size is fixed by ``cells``), the driver walks those sums clockwise
    to shards with room (``place_cells``, with the bound it keeps), and each row looks its place up in the broadcast of
    that same fixed-size table. slot is the row's gapless number in its shard, in order of id, from a range partitioning.

    Size is the text's UTF-8 bytes plus 1, a null text counting as empty. Rows equal in id and text share a place, so
    go to one shard; null ids are one id. Empty tables give empty results; other columns are ignored, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(
        docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text")), "shard"
    )
    most = (slim.agg(F.sum("size")).first()[0] or 0) / (shards * hot)
    copies = slim.groupBy("text").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > most) & (F.col("n") > 1))
    spread = F.broadcast(copies.select(F.col("text").alias("_text"), F.ceil(F.col("bytes") / F.lit(max(most, 1.0))).alias("parts")))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), F.col("parts")))
    celled = slim.join(spread, F.col("text") == F.col("_text"), "left").select("_id", "size", "text_crc32", F.pmod(F.xxhash64("text", part.cast("long")), F.lit(cells)).cast("int").alias("cell"))
    celled = materialize(celled, "cells")
    loads = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.sum("size").alias("n")).collect()}
    placed = spark.createDataFrame(sorted(place_cells(loads, shards, nodes, cells, slack).items()), "cell int, shard int")
    put = celled.join(F.broadcast(placed), "cell")
    return global_rank(put, ["shard"], ["_id", "text_crc32", "size"], "slot").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "cell", "shard", "slot"
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    out = ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
QUERIES = {"op9_sharding": op9_sharding}
