"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VIRTUAL`` points of a ring of ``SLOTS`` slots; a document
belongs to the next point clockwise from the hash of its id (its arc). No shard
takes more than its share of the rows (shares differ by one row at most): what
a full shard can't take goes on clockwise to the next point whose shard has
room, own rows before rows that come from behind.

Who overflows follows from the row counts of the arcs alone, a table of at
most shards x VIRTUAL rows whatever the input. Rows only need their rank in
their arc: one narrow shuffle by arc, and a look-up. Only DataFrame functions
run on rows.

Defined cases: a null text has no bytes and checksum 0; rows without an id
share one place on the ring; rows that are equal in id, checksum and size are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, VIRTUAL = 40, 64
SLOTS = 1 << 16
ROW_BYTES = 16              # size of a row besides its text
LAW = "rows"


def ring_points(docs: DataFrame, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(slot, shard) of the ring, by slot; of points in one slot the first is kept."""
    point = F.col("id")
    points = (docs.sparkSession.range(shards * virtual)
              .select(F.pmod(F.xxhash64(F.lit("point"), point), F.lit(SLOTS)).alias("slot"), point)
              .groupBy("slot").agg(F.min("id").alias("id")).collect())
    return sorted((int(r.slot), int(r.id) // virtual) for r in points)


def constant_array(values: list[int], kind: str) -> Column:
    """A literal array; the optimiser folds it once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def place(counts: list[int], owner: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, first rank, last rank, shard, slot of the first rank)."""
    free, filled = list(capacity), [0] * len(capacity)
    over: list[tuple[int, int, int]] = []       # (arc, first rank, rows) that the owner can't take
    out = []

    def take(shard: int, origin: int, first: int, n: int) -> int:
        here = min(n, free[shard])
        if here:
            out.append((origin, first, first + here - 1, shard, filled[shard]))
            free[shard] -= here
            filled[shard] += here
        return here

    for arc, shard in enumerate(owner):         # own rows first
        here = take(shard, arc, 0, counts[arc])
        over.append((arc, here, counts[arc] - here))
    carried: list[tuple[int, int, int]] = []
    for turn in range(2):                       # two turns of the ring: everything finds room
        for arc, shard in enumerate(owner):
            queue = carried + ([over[arc]] if turn == 0 else [])
            carried = []
            for origin, first, n in queue:
                here = take(shard, origin, first, n)
                if n > here:
                    carried.append((origin, first + here, n - here))
    if carried:
        raise ValueError("some shard owns no point of the ring")
    return out


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.col(text_col).cast("string")
    points = ring_points(docs, shards, virtual)
    arc_of_slot, at = [], 0
    for slot in range(SLOTS):
        while at < len(points) and points[at][0] < slot:
            at += 1
        arc_of_slot.append(at % len(points))
    arc = F.element_at(constant_array(arc_of_slot, "int"), (F.pmod(F.shiftrightunsigned(F.col("spot"), 32), F.lit(SLOTS)) + 1).cast("int"))

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                      F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = ids.withColumn("spot", F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "bytes")).otherwise(F.xxhash64("doc_id"))).withColumn("arc", arc)
    counted = {r.arc: r["count"] for r in rows.groupBy("arc").count().collect()}     # at most shards x virtual rows
    counts = [counted.get(a, 0) for a in range(len(points))]
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = [dict(zip(("p_arc", "first", "last", "shard", "base"), p)) for p in place(counts, [s for _, s in points], capacity)]
    kind = "array<struct<p_arc:int,first:long,last:long,shard:int,base:long>>"
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(pieces)), kind)))

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("spot", "doc_id", "text_crc32", "bytes")) - 1)
    # The plan has at most one row for each arc and two for each shard and turn: its size is bounded by the ring.
    met = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("p_arc")) & F.col("rank").between(F.col("first"), F.col("last")))
    return met.select("doc_id", (F.col("bytes") + ROW_BYTES).alias("size"), "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
                      (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
