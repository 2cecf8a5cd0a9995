"""Threshold-scaled document fingerprints, with DataFrame functions only.

A fingerprint keeps every distinct five-word shingle hash in the lowest ``FRACTION`` of the hash range, in order, as 16
hexadecimal digits each. The kept hashes of a union of texts are the union of the kept hashes, so fingerprints merge, and
intersections over unions or over one side estimate likeness and containment between texts of any lengths.

Words are runs between white space, in lower case; a text of one to four words has its whole sequence as its only
shingle; null counts as empty and has an empty fingerprint. Where neither of two texts keeps a hash, their likeness
is 1 if they are equal and else 0. Equal texts have equal fingerprints. Rows with equal ids follow each other in the order of a hash
of their text; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, ordered_buckets

#: Kept part of the hash range: 1 / 2**FRACTION_BITS.
FRACTION_BITS = 2
#: Rows of a bucket, and the most buckets that a plan lists; beyond MAX_BUCKETS * ROWS_PER_BUCKET rows, buckets have more rows, which
#: a window sorts with spilling and reads once.
ROWS_PER_BUCKET, MAX_BUCKETS = 1500, 32**3


def _words(text: Column) -> Column:
    words = F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, out: str, bits: int = FRACTION_BITS) -> DataFrame:
    """Adds column out: the sorted kept shingle hashes of column text."""
    w = f"_{out}_words"
    df = df.withColumn(w, _words(F.col(text)))
    n = F.size(w)
    limit = -(1 << 63) + (1 << 64 - bits)
    long = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(5)]))
    hashes = F.when(n >= 5, long).when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))).drop(w)


def digest(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / F.greatest(either, F.lit(1))).otherwise(F.when(equal, 1.0).otherwise(0.0))


def containment(a: Column, b: Column, equal: Column) -> Column:
    """Estimated part of the first text's shingles that the second one has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))).otherwise(F.when(equal, 1.0).otherwise(0.0))


def merge_sketches(df: DataFrame, group: str, sketch: str = "sketch") -> DataFrame:
    """group and sketch of the union of each group's texts. Hashes are made distinct before a group is put together."""
    hashes = df.select(group, F.explode_outer(sketch).alias("h")).distinct()
    return hashes.groupBy(group).agg(F.array_sort(F.collect_list("h")).alias(sketch))


def _with_next(df: DataFrame, key: str, text: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """key, text and sketch, and next_text and next_sketch of the row that follows in ascending key (after the last one: of the first).

    Texts are dealt once, to range buckets of bounded size, and sketched there once; a window finds the follower inside a bucket, and
    the one row at the end of a bucket takes its from a join with the first row of the following bucket, found from keys and
    then texts alone. A key with very many rows has several buckets.
    """
    df = df.select(key, text, F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("_k"), F.xxhash64(text).alias("_h"))
    bucket = ordered_buckets(df, key, F.col("_h"), rows_per_bucket, MAX_BUCKETS)[1]
    df = df.withColumn("_b", bucket)
    row = F.struct(F.col(text).alias("text"), F.col("sketch"))
    dealt = with_sketch(df.repartition("_b"), text, "sketch")
    lead = dealt.withColumn("_next", F.lead(row).over(Window.partitionBy("_b").orderBy("_k", "_h")))
    least = df.groupBy("_b").agg(F.min("_k").alias("_k"))  # a row for each bucket, so MAX_BUCKETS at most
    used = sorted(r["_b"] for r in least.collect())
    first = df.join(F.broadcast(least), ["_b", "_k"]).groupBy("_b").agg(F.min_by(text, "_h").alias(text))
    if used:
        before = F.map_from_arrays(F.array(*map(F.lit, used)), F.array(*map(F.lit, used[-1:] + used[:-1])))
        first = first.withColumn("_b", F.element_at(before, F.col("_b")))
    both = lead.join(with_sketch(first, text, "sketch").select("_b", row.alias("_first")), "_b", "left")
    both = both.withColumn("_next", F.coalesce("_next", "_first"))
    return both.select(key, text, "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and kept_in_edited of every document.

    The edited text replaces the last half of the characters by as many of the next document's first ones. kept_in_edited is the
    estimated part of a text's shingles that the edited text has.
    """
    base = _with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    base = with_sketch(base.withColumn("edited", edited), "edited", "edited_sketch")
    return base.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("sketch")).alias("fingerprint"),
        digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("kept_in_edited"),
    )
