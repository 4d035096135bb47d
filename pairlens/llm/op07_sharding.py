"""K-d tree partitioning of documents into shards of near equal bytes, in DataFrame functions alone.

Each row is a point in [0, 1]^4 of its metadata: logarithm of its length, bytes a character, source and
language (hashed). From the root on, a node is cut along the dimension in which its points lie widest, at
the weighted quantile that gives each side its share of the leaves, until every leaf is one shard. All
nodes of a level are cut together: their extents come from one aggregate, and the quantiles from
histograms of partial sums that are refined until the bin that holds a cut is light; only a row a node
reaches the driver. A place along a dimension is an integer of the quantised coordinate, then the text's
checksum, then a hash of the id and of the row's number in its file part (written down at once, so that it
stays), so ties, equal texts, and rows equal in everything can be cut anywhere, and equal texts stay
next to each other. Slots are counted in hashed parts of a shard, so no task holds a whole one.

Defined cases: a null text has no bytes (size 8) and the checksum of an empty text; null source or
language is a value of its own; a null ``doc_id`` is carried; equal rows lie together (in one shard,
or on both sides of a cut) and get slots each; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, read, text_or_empty

SHARDS = 24
ROW_BYTES = 8
#: Bits of a place: quantised coordinate, checksum, hash of the id.
LEVEL_BITS, SUM_BITS, ID_BITS = 20, 16, 27
#: Bits by which one round refines a histogram, and the share of a shard that a cut may be off by.
ROUND_BITS = 13
TOLERANCE = 0.001
#: Rows whose slots one task counts, about.
SLOT_ROWS = 20_000


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, at): ``at`` holds the place along each dimension."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.octet_length(text).cast("long").alias("bytes"),
        F.char_length(text).cast("long").alias("chars"), F.crc32(text.cast("binary")).alias("text_crc32"))

    def hashed(name):
        return F.coalesce(F.crc32(F.col(name).cast("binary")) / float(1 << 32), F.lit(0.0))

    unit = [F.log2(F.col("chars") + 1) / 31.0, (F.col("bytes") / F.greatest("chars", F.lit(1)) - 1) / 3.0,
            hashed("source"), hashed("lang")]
    low = (F.shiftleft(F.shiftright("text_crc32", 32 - SUM_BITS), ID_BITS)
           + F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()).bitwiseAND((1 << ID_BITS) - 1))
    top = (1 << LEVEL_BITS) - 1
    at = [F.shiftleft((F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * top).cast("long"), SUM_BITS + ID_BITS) + low for u in unit]
    return rows.select("doc_id", (F.col("bytes") + ROW_BYTES).alias("size"), "text_crc32", F.array(*at).alias("at"))


def by_node(values: dict[int, int], default: int = 0):
    """The value of the row's node."""
    return F.element_at(F.array(*[F.lit(int(values.get(k, default))).cast("long") for k in range(max(values) + 1)]), F.col("node") + 1)


def cuts(rows: DataFrame, nodes: dict[int, tuple[int, int]], dim: dict[int, int], want: dict[int, float],
         allowed: float) -> dict[int, int]:
    """For each node the place (on its dimension) that has about ``want`` bytes before it."""
    bits = LEVEL_BITS + SUM_BITS + ID_BITS
    low = {k: 0 for k in nodes}
    before = {k: 0 for k in nodes}
    width = bits
    out: dict[int, int] = {}
    place = F.element_at(F.col("at"), by_node(dim).cast("int"))
    inside = rows.where(F.col("node").isin(list(nodes))).select("node", "size", place.alias("place"))
    while width and len(out) < len(nodes):
        step = max(0, width - ROUND_BITS)
        left = {k: want[k] - before[k] for k in nodes}
        here = inside.where(F.shiftright("place", width) == by_node({k: v >> width for k, v in low.items()}, -1)) if width < bits else inside
        bins = here.groupBy("node", F.shiftright("place", step).alias("bin")).agg(F.sum("size").alias("bytes"))
        w = Window.partitionBy("node").orderBy("bin")
        goal = F.element_at(F.array(*[F.lit(float(left.get(k, 0.0))) for k in range(max(nodes) + 1)]), F.col("node") + 1)
        crossing = (bins.withColumn("upto", F.sum("bytes").over(w)).where((F.col("upto") >= goal) & (F.col("upto") - F.col("bytes") < goal))
                    .select("node", "bin", "bytes", "upto").collect())
        hit = {r["node"]: r for r in crossing}
        for k in nodes:
            if k in out:
                continue
            if k not in hit:  # nothing wanted on the left
                out[k] = low[k]
                continue
            r = hit[k]
            low[k], start = r["bin"] << step, before[k] + r["upto"] - r["bytes"]
            if not step or r["bytes"] <= allowed:
                end = start + r["bytes"]
                out[k] = low[k] if want[k] - start <= end - want[k] else low[k] + (1 << step)
            before[k] = start
        width = step
    return out


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard): the leaf of each row."""
    rows = checkpointed(points(docs).withColumn("node", F.lit(0)))
    nodes = {0: (0, shards)}  # node: first shard, shards
    total = rows.agg(F.sum("size")).first()[0] or 0
    made = 1
    while any(n > 1 for _, n in nodes.values()):
        dims = 4
        wide = [F.max(F.element_at("at", d)) - F.min(F.element_at("at", d)) for d in range(1, dims + 1)]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(
            F.sum("size").alias("size"), *[w.alias(f"w{d}") for d, w in enumerate(wide, 1)]).collect()}  # a row a node
        open_ = {k: v for k, v in nodes.items() if v[1] > 1}
        dim = {k: max(range(1, dims + 1), key=lambda d: stats[k][f"w{d}"]) if k in stats else 1 for k in open_}
        want = {k: (stats[k]["size"] if k in stats else 0) * (v[1] // 2) / v[1] for k, v in open_.items()}
        at = cuts(rows, open_, dim, want, TOLERANCE * total / shards)
        right = {}
        for k, (first, n) in open_.items():
            nodes[k], nodes[made], right[k] = (first, n // 2), (first + n // 2, n - n // 2), made
            made += 1
        over = (by_node(right, -1) >= 0) & (F.element_at(F.col("at"), by_node(dim, 1).cast("int")) >= by_node(at))
        moved = F.when((F.col("node") <= max(open_)) & over, by_node(right, -1).cast("int")).otherwise(F.col("node"))
        rows = checkpointed(rows.withColumn("node", moved))  # numbers only; else each level would nest in the next
    return rows.select("doc_id", "size", "text_crc32", by_node({k: first for k, (first, _) in nodes.items()}).cast("int").alias("shard"))


def slotted(rows: DataFrame, shards: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: parts of a shard by hash, each after those before it."""
    rows = checkpointed(rows.withColumn("nr", F.monotonically_increasing_id()))
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "nr"), F.lit(parts)))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")))
    return placed.join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("nth") - 1).cast("long")).drop("part", "nth", "before", "nr")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return slotted(kd_shards(read(spark, sf_dir, "documents")), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
