"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is a stream of blocks of `block` characters. With weights n of a total D, block k of
a source is released at slot floor(k * D / n) and due by slot ceil((k + 1) * D / n). Earliest
deadline first meets all deadlines, and so after any number of slots no source is a whole block
away from its share. Because all sources are level again after D slots, the schedule of one
period, which depends on the weights alone, gives the slot of every block by arithmetic.

The place of a document in its source needs a running sum. Rows are ordered by a digest of
doc_id; its first hexadecimal digits cut every source, the hot one too, into parts small enough
to be summed by themselves, and sums of the parts come before.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, REST, PART = 1 << 16, "*", 50_000


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline among what is released (ties: by name)."""
    total = sum(weights.values())
    if not weights or any(int(n) != n or n <= 0 for n in weights.values()):
        raise ValueError("weights are positive whole numbers")
    release = sorted((k * total // n, -(-(k + 1) * total // n), s) for s, n in weights.items() for k in range(n))
    slots: dict[str, list[int]] = {s: [] for s in weights}
    ready: list[tuple[int, str]] = []
    at = 0
    for t in range(total):
        while at < len(release) and release[at][0] <= t:
            heapq.heappush(ready, release[at][1:])
            at += 1
        due, source = heapq.heappop(ready)
        if due < t + 1:
            raise AssertionError("a deadline was missed")
        slots[source].append(t)
    return slots


def _group(weights: dict[str, int]) -> Column:
    source = F.coalesce(F.col("source"), F.lit(REST))
    return F.when(source.isin(*[s for s in weights if s != REST]), source).otherwise(F.lit(REST))


def schedule(docs: DataFrame, weights: dict[str, int], block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """docs with mix_source, mix_start, mix_block, mix_release, mix_deadline, mix_slot.

    Reading rows by (mix_slot, mix_start) is the mix. mix_start counts characters of the source
    before the row; the row belongs to the block in which it starts. A text counts one
    character at least, null and empty ones too. Sources without a weight, null among them,
    share the weight of `*` (1 unless given). Every row is kept; when a source has run
    out its slots stay vacant and the others keep their proportions. Rows are ordered by md5 of
    doc_id (null: as empty), then doc_id and size; `size` replaces the length of text. Columns of these names in docs are replaced.
    """
    weights = {REST: 1} | weights
    slots, total = period(weights), sum(weights.values())
    digits = 2
    n = docs.count()
    while n / 16**digits > PART:
        digits += 1
    made = ["mix_source", "mix_start", "mix_block", "mix_release", "mix_deadline", "mix_slot"]
    own = [c for c in docs.columns if c not in made]
    size = F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long") if size is None else size
    rows = docs.select(*own, _group(weights).alias("mix_source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__key"), size.alias("__size")).withColumn("__part", F.substring("__key", 1, digits))
    parts = docs.select(_group(weights).alias("mix_source"), F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, digits).alias("__part"), size.alias("__size")).groupBy("mix_source", "__part").agg(F.sum("__size").alias("__size"))
    before = parts.withColumn("__before", F.sum("__size").over(Window.partitionBy("mix_source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("mix_source", "__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    line = Window.partitionBy("mix_source", "__part").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__run", F.coalesce(F.sum("__size").over(line), F.lit(0))).join(before, ["mix_source", "__part"])
    weight = F.element_at(F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, w)]), F.col("mix_source")).cast("long")
    places = F.element_at(F.create_map(*[x for s in weights for x in (F.lit(s), F.lit(slots[s]))]), F.col("mix_source"))
    k = F.col("mix_block")
    rows = rows.withColumn("mix_start", F.col("__before") + F.col("__run")).withColumn("mix_block", F.floor(F.col("mix_start") / block).cast("long")).withColumn("__weight", weight)
    w = F.col("__weight")
    return rows.withColumns({
        "mix_release": F.expr(f"mix_block * {total} div __weight"),
        "mix_deadline": F.expr(f"((mix_block + 1) * {total} + __weight - 1) div __weight"),
        "mix_slot": F.expr(f"(mix_block div __weight) * {total}") + F.get(places, F.pmod(k, w).cast("int")),
    }).select(*own, *made)


def mixed(docs: DataFrame, weights: dict[str, int], block: int = BLOCK) -> DataFrame:
    """docs in the order of the mix: partitions are ranges of slots, and rows are sorted in them."""
    rows = schedule(docs, weights, block)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "mix_slot", "mix_start").sortWithinPartitions("mix_slot", "mix_start").select(*docs.columns)
