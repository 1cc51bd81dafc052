"""Document fingerprints: threshold-scaled sketches of five-word shingles, in DataFrame functions only.

A sketch holds every shingle hash among the lowest `fraction` of all 64-bit values; where there is
none, it holds the least hash, so that no text with words has an empty one. Because the threshold is the same
for all texts, merge() makes the sketch of a union of shingles from those of its parts, and containment of a short text in a very long
one is estimated as well as the likeness of two of a size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, FRACTION = 5, 1 / 16
_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct retained hashes; a text of fewer words than a shingle is one shingle; null or no words: empty."""
    limit = -(1 << 63) + int(fraction * (1 << 64))

    def hashed(words: Column) -> Column:
        n = F.size(words)
        full = F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: F.xxhash64(F.slice(words, i, shingle)))
        return F.when(n >= shingle, full).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")
    kept = _let(_let(words, hashed), lambda h: F.concat(F.filter(h, lambda x: x < limit), F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())))
    return F.array_sort(F.array_distinct(kept))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of all shingles of two texts from their sketches: what lies below the threshold, or else the least hash."""
    limit = -(1 << 63) + int(fraction * (1 << 64))

    def held(both: Column) -> Column:
        below = F.filter(both, lambda x: x < limit)
        return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))

    return _let(F.array_sort(F.array_union(a, b)), held)


def merged(sketches: DataFrame, keys: list[str], fraction: float = FRACTION) -> DataFrame:
    """One sketch for each value of `keys` (by name) from rows (keys, sketch array<bigint>), such as parts of documents.

    Hashes are made distinct before and after the exchange, so rows of one key never meet before they are
    combined. A key whose sketches are all null or empty has an empty one.
    """
    limit = -(1 << 63) + int(fraction * (1 << 64))
    rows = sketches.select(*keys, F.explode_outer("sketch").alias("__hash")).distinct()
    least = F.min("__hash")
    held = F.array_sort(F.collect_set(F.when(F.col("__hash") < limit, F.col("__hash"))))
    out = rows.groupBy(*keys).agg(held.alias("sketch"), least.alias("__least"))
    alone = F.when(F.col("__least").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("__least"))
    return out.select(*keys, F.when(F.size("sketch") > 0, F.col("sketch")).otherwise(alone).alias("sketch"))


def written(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, lowest first."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 where a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a)).cast("double"))


def with_next(rows: DataFrame, columns: list[str], per_bucket: int = 128, most: int = 1 << 14) -> DataFrame:
    """rows with `next_<column>`: values of the row that follows by descending doc_id; the first follows the last.

    Rows are dealt into ranges of doc_id (at most `most`, cut at approximate quantiles) and each
    range is sorted by itself; the head of a range goes as a guest to the range before it. A null
    doc_id comes last; ties are ordered by text.
    """
    n = rows.count()
    pieces = max(1, min(most, n // per_bucket))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)] or [0.5], 20 * pieces).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts)) if pieces > 1 else []
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if blocks:
        block = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda c: c <= F.col("doc_id")))
        inner = F.size(F.filter(F.get(F.array(*[F.lit(b) for b in blocks]), block - 1), lambda c: c <= F.col("doc_id")))
        place = F.when(F.coalesce(block, F.lit(0)) > 0, (block - 1) * wide + inner).otherwise(0)
    else:
        place = F.lit(0)
    placed = rows.withColumn("__place", place.cast("int"))
    heads = {r[0]: r[1] for r in placed.groupBy("__place").agg(F.max("doc_id")).collect()}  # one row a range
    order = sorted(heads)
    after = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    full = range(order[-1] + 1) if order else range(1)
    head = F.get(F.lit([heads.get(p) for p in full]).cast("array<bigint>"), F.col("__place"))
    goes = F.get(F.lit([after.get(p, 0) for p in full]), F.col("__place"))
    seats = F.when(head.eqNullSafe(F.col("doc_id")), F.array(F.struct(F.col("__place").alias("at"), F.lit(False).alias("guest")), F.struct(goes.alias("at"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("__place").alias("at"), F.lit(False).alias("guest"))))
    seated = placed.withColumn("__seat", F.explode(seats)).withColumns({"__at": F.col("__seat.at"), "__guest": F.col("__seat.guest")}).drop("__seat", "__place")
    line = Window.partitionBy("__at").orderBy("__guest", F.col("doc_id").desc_nulls_last(), "text")
    return seated.withColumns({f"next_{c}": F.lead(c).over(line) for c in columns}).where("not __guest").drop("__at", "__guest")


def compare_with_edits(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the beginning of the next text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is empty; an empty text has an empty fingerprint. Repeated rows follow
    each other. Nothing but the text and doc_id of docs is read. An empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), shingle, fraction))
    rows = with_next(texts, ["text", "sketch"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited")).withColumn("changed", sketch(F.col("edited"), shingle, fraction))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("changed")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
