"""Shards as the leaves of a k-d tree over metadata, with DataFrame functions only.

A node is split along its widest metadata dimension at the weighted median, until a leaf is one shard's share of the
bytes. Medians are found for all nodes of a level at once, by distributed histograms that narrow down on the cut; the
driver sees one row per node. Equal texts are one point of the tree and stay together, unless they weigh more than a
tenth of a shard: then they are dealt into points of that size, so that no group, however large, unbalances shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Cells of a histogram, and rounds of narrowing at most (63 bits at 10 bits a round).
CELLS, ROUNDS = 1024, 7
#: A cut is exact enough at this share of a shard; points of the tree weigh at most this share.
TOLERANCE, POINT_SHARE = 0.002, 0.1
#: Metadata of the documents table: SQL expressions, numbers all. Categories lie at the place of their hash.
DIMENSIONS = {
    "doc_id": "doc_id", "size": "log2(size)",
    "source": "xxhash64(source) & 1048575", "lang": "xxhash64(lang) & 1048575",
}


def points_of(rows: DataFrame, dimensions: list[str], target: float) -> tuple[DataFrame, DataFrame]:
    """(rows with ``group`` and ``part``, points with their weight and one sortable key per dimension).

    A key holds the dimension's place within its range in the upper 32 bits, and a hash of the point below, which
    orders points of equal place.
    """
    groups = rows.groupBy("group").agg(F.sum("weight").alias("all_weight"))
    parts = F.greatest(F.ceil(F.col("all_weight") / (POINT_SHARE * target)), F.lit(1))
    heavy = written(groups.filter(F.col("all_weight") > POINT_SHARE * target).select("group", parts.alias("parts")),
                    "heavy-groups")
    # the weights of all groups make `total`, so at most shards / POINT_SHARE groups can be heavy
    rows = rows.join(F.broadcast(heavy), "group", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    points = written(rows.groupBy("group", "part").agg(
        F.sum("weight").alias("weight"), *[F.min(d).alias(d) for d in dimensions]), "points")
    ends = points.agg(*[f(d).alias(f"{d}_{f.__name__}") for d in dimensions for f in (F.min, F.max)]).first()
    keys = []
    for d in dimensions:
        low, high = ends[f"{d}_min"], ends[f"{d}_max"]
        spread = (high - low) if low is not None and high > low else 1.0
        place = F.floor((F.coalesce(F.col(d), F.lit(low)) - F.lit(low)) / spread * 4294967295) if low is not None else F.lit(0)
        tie = F.xxhash64("group", "part", F.lit(d)).bitwiseAND(0x7FFFFFFF)
        keys.append(F.shiftleft(place.cast("long"), 31).bitwiseOR(tie))
    return rows, written(points.select("group", "part", "weight", F.array(*keys).alias("keys")), "keys")


def split_level(points: DataFrame, nodes: dict[int, tuple[int, int]], target: float) -> list[tuple[int, int, int]]:
    """(node, dimension, cut) for every node of more than one shard: keys up to the cut go left."""
    spark = points.sparkSession
    n = len(points.select("keys").first()[0])
    ranges = points.groupBy("node").agg(
        F.sum("weight").alias("weight"),
        *[f(F.get("keys", F.lit(d))).alias(f"{f.__name__}{d}") for d in range(n) for f in (F.min, F.max)])
    todo = {}
    for r in ranges.collect():
        if nodes[r.node][1] > 1:
            widths = [(r[f"max{d}"] >> 31) - (r[f"min{d}"] >> 31) for d in range(n)]
            widest = widths.index(max(widths))
            share = (nodes[r.node][1] // 2) / nodes[r.node][1]
            todo[r.node] = (widest, r[f"min{widest}"], r[f"max{widest}"], share * r.weight)
    cuts = []
    for _ in range(ROUNDS):
        if not todo:
            break
        asked = spark.createDataFrame([(k, *v) for k, v in todo.items()],
                                      "node int, dim int, low long, high long, wanted double")
        inside = (points.join(F.broadcast(asked), "node").withColumn("key", F.get("keys", F.col("dim")))
                  .filter("key BETWEEN low AND high")
                  .withColumn("cell", F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low") + 1) * CELLS)))
        cells = inside.groupBy("node", "cell", "wanted").agg(
            F.sum("weight").alias("weight"), F.min("key").alias("first"), F.max("key").alias("last"))
        so_far = Window.partitionBy("node").orderBy("cell")
        running = cells.withColumn("upto", F.sum("weight").over(so_far)).withColumn(
            "before", F.max("last").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
        chosen = running.filter("upto >= wanted").groupBy("node").agg(F.min_by(
            F.struct("weight", "first", "last", "upto", "before"), "cell").alias("c")).select("node", "c.*").collect()
        found = {r.node: r for r in chosen}
        left = {}
        for node, (dim, low, high, wanted) in todo.items():
            r = found.get(node)
            if r is None:  # rounding left the whole range below the wanted weight
                cuts.append((node, dim, high))
            elif r["first"] == r["last"] or r.weight <= TOLERANCE * target:
                nearer = r.upto - wanted <= wanted - (r.upto - r.weight)
                cuts.append((node, dim, r["last"] if nearer else (r.before if r.before is not None else low - 1)))
            else:
                left[node] = (dim, r["first"], r["last"], wanted - (r.upto - r.weight))
        todo = left
    return cuts + [(node, dim, high) for node, (dim, _, high, _) in todo.items()]


def grow_tree(points: DataFrame, shards: int, target: float) -> DataFrame:
    """(group, part, shard): the leaves."""
    spark = points.sparkSession
    nodes = {0: (0, shards)}
    points = points.withColumn("node", F.lit(0))
    while any(count > 1 for _, count in nodes.values()):
        cuts = split_level(points, nodes, target)
        table, after = [], {k: v for k, v in nodes.items() if v[1] == 1}
        for node, dim, cut in cuts:
            first, count = nodes[node]
            left = max(nodes) + 1 + 2 * len(table)
            table.append((node, dim, cut, left, left + 1))
            after[left], after[left + 1] = (first, count // 2), (first + count // 2, count - count // 2)
        if not table:
            break
        splits = spark.createDataFrame(table, "node int, dim int, cut long, below int, above int")
        points = written(points.join(F.broadcast(splits), "node", "left").withColumn("node", F.expr(
            "CASE WHEN cut IS NULL THEN node WHEN get(keys, dim) <= cut THEN below ELSE above END")).select(
            "group", "part", "weight", "keys", "node"), "nodes")
        nodes = after
    leaves = spark.createDataFrame([(k, first) for k, (first, _) in nodes.items()], "node int, shard int")
    return points.join(F.broadcast(leaves), "node").select("group", "part", "shard")


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None,
              dimensions: dict[str, str] | None = None, by: str = "bytes",
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. Give the number of ``shards``, or the ``target_bytes``
    of a leaf. ``by`` "rows" weighs every row alike. ``dimensions`` are SQL expressions over the columns of ``docs``
    and ``size``; a null lies at the low end. ``slot`` counts from 0 in a shard by (doc_id, text). A null text counts
    as an empty one. Rows with equal ids and texts are neighbours in any order. An empty table gives an empty one.
    """
    dimensions = dimensions or DIMENSIONS
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
    rows = sized.select(
        F.col(id_col).cast("long").alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"), (F.col("size") if by == "bytes" else F.lit(1).cast("long")).alias("weight"),
        *[F.expr(e).cast("double").alias(f"dim_{d}") for d, e in dimensions.items()])
    rows = written(rows, "sizes")
    total = rows.agg(F.sum("weight"), F.sum("size")).first()
    if target_bytes:
        shards = max(1, -(-(total[1] or 0) // target_bytes))
    target = max((total[0] or 0) / shards, 1.0)
    names = [f"dim_{d}" for d in dimensions]
    rows, points = points_of(rows, names, target)
    if not total[0]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = rows.join(grow_tree(points, shards, target), ["group", "part"])
    order = ["shard", "doc_id", "text_crc32", "group"]
    blocks = written(placed.select("doc_id", "size", "text_crc32", "shard", "group").repartitionByRange(*order)
                     .withColumn("block", F.spark_partition_id()), "blocks")
    before = (blocks.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("n"))
    within = Window.partitionBy("block", "shard").orderBy("doc_id", "text_crc32", "group")
    return (blocks.withColumn("place", F.row_number().over(within) - 1).join(before, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot")))
