"""Document fingerprints: threshold-scaled sketches (built-in expressions only).

The sketch of a text holds every hash of its five-word shingles that lies in the lowest
``1 / SCALE`` of all hashes, whatever the text's length. Because the threshold
is fixed, a shingle is in both sketches or in neither; so the share of one sketch that
another holds estimates how much of the one text the other contains, however unequal they are, and sketches of parts merge by
union (``merged``). A text of one to four words is one shingle.

A text without a hash below the threshold (a short one, as a rule) keeps all of its hashes instead. They are
compared with all shingles of the other text and not with its sketch (``share_in``), so this share is exact.

``report`` moves each text once. The ids alone give the buckets: ranges of (doc_id, hash), ``FINER`` times as many as there
are shuffle partitions. A text goes to its bucket; the last of a bucket goes to the next bucket too,
where it only serves the first there. A window over each bucket then has every text beside the next one.

Defined results: a null text counts as empty; a text without words has an empty sketch, like (1.0)
only to another empty one; documents stand in descending order of doc_id, null last, then of a hash of
the text; repeated rows (one id, one text) are one place in that order and give repeated
results; an only document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.llm.common import WORD, durable, let, whole

SHINGLE = 5
SCALE = 8
#: Hashes are signed 64-bit numbers; those below this one are the lowest 1 / SCALE.
BELOW = -(1 << 63) + (1 << 64) // SCALE
#: Buckets for each shuffle partition.
FINER = 8


def _hashes(text: Column) -> Column:
    """The hashes of a text's shingles, in order and repeated; none of a text without words."""

    def shingles(words: Column) -> Column:
        last = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
        return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)), shingles)


def _sketch(hashes: Column) -> Column:
    """Those below the threshold; all, where none is."""

    def kept(low: Column) -> Column:
        return F.array_sort(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(hashes)))

    return let(F.filter(hashes, lambda h: h < F.lit(BELOW)), kept)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """The rows and a column of sorted, distinct 64-bit hashes."""
    own = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select(*own, _hashes(F.col(f"`{text}`")).alias("__hashes"))
    return hashed.select(*own, _sketch(F.col("__hashes")).alias(name))


def merged(sketches: Column) -> Column:
    """Of an array of sketches, the sketch of the texts together, up to shingles across their ends."""
    return _sketch(F.flatten(sketches))


def containment(a: Column, b: Column) -> Column:
    """The share of a's sketch that b's holds, 0 to 1: how much of a's text b's contains."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(
        F.when(F.size(b) == 0, 1.0).otherwise(0.0)
    )


def is_whole(sketch: Column) -> Column:
    """Whether a sketch holds all hashes of a text with words, as none lies below the threshold."""
    return F.coalesce(F.get(sketch, 0) >= F.lit(BELOW), F.lit(False))


def share_in(a: Column, b: Column, b_text: Column) -> Column:
    """containment, from all shingles of b's text where a's sketch holds all of its own."""
    return F.when(is_whole(a), containment(a, _hashes(b_text))).otherwise(containment(a, b))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bounds(keys: DataFrame) -> DataFrame:
    """One row: ``starts``, the ascending first keys of the buckets, and ``ends``, the last key of each; none for no keys.

    keys: a column ``key``, distinct. Only keys move; their ranges are Spark's, each cut into ``FINER`` buckets.
    """
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as told, adaptive execution would merge them
    ranged = keys.repartitionByRange(ranges, "key").select("key", F.spark_partition_id().alias("range"))
    inside = Window.partitionBy("range")
    place = F.row_number().over(inside.orderBy("key")) - 1
    size = F.ceil(F.count("*").over(inside) / FINER)
    firsts = ranged.select("key", "range", F.floor(place / size).alias("part")).groupBy("range", "part").agg(
        F.min("key").alias("start"), F.max("key").alias("end")
    )
    return firsts.agg(F.sort_array(F.collect_list("start")).alias("starts"), F.sort_array(F.collect_list("end")).alias("ends"))


def _bucket(key: Column, starts: Column) -> Column:
    """The place of the last start that is not above the key, by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.get(starts, middle) <= key
        return F.struct(
            F.when(right, middle).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(middle).alias("high")
        )

    whole_range = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + F.lit(1))).cast("int"))
    return F.aggregate(steps, whole_range, halve, lambda acc: acc["low"])


def beside_next(texts: DataFrame) -> DataFrame:
    """The rows and next: struct<text,sketch> of the next in descending order of key, the first after the last.

    texts: key, text, sketch and others; key is distinct, and the columns of report.
    """
    found = durable(bounds(texts.select("key")))
    held = texts.select("*", found.select(F.struct("starts", "ends")).scalar().alias("bounds"))
    placed = held.select("*", _bucket(F.col("key"), F.col("bounds.starts")).alias("bucket"))
    last = F.get(F.col("bounds.ends"), F.col("bucket")) == F.col("key")
    after = F.pmod(F.col("bucket") + 1, F.size("bounds.starts"))
    copies = F.when(last, F.array(F.struct("bucket", F.lit(False).alias("serves")), F.struct(after.alias("bucket"), F.lit(True).alias("serves"))))
    spread = placed.select(
        *texts.columns, F.explode(F.coalesce(copies, F.array(F.struct("bucket", F.lit(False).alias("serves"))))).alias("at")
    )
    order = Window.partitionBy("at.bucket").orderBy(F.desc("at.serves"), "key")
    met = spread.select("*", F.lag(F.struct("text", "sketch")).over(order).alias("next"))
    return met.where(~F.col("at.serves")).drop("at")


def report(docs: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", whole("text").alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct("doc_id", "h").alias("key")
    most = plain.groupBy("doc_id", "h").count().agg(F.max("count").alias("n")).first()["n"]
    if (most or 1) > 1:  # repeated rows meet before the texts move, so that a very frequent one is few rows
        counted = plain.groupBy("doc_id", "h", "text").agg(F.count("*").alias("n"))
        texts = counted.select(key, "text", "n")
    else:
        texts = plain.select(key, "text", F.lit(1).cast("long").alias("n"))
    met = beside_next(with_sketch(texts, "text", "sketch"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = met.select(
        F.col("key.doc_id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "sketch",
        "next",
        "text",
        "n",
        F.concat(
            F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring("next.text", F.lit(1), half)
        ).alias("edited"),
    )
    both = with_sketch(edited, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        share_in(F.col("sketch"), F.col("edited_sketch"), F.col("edited")).alias("near_edited"),
        share_in(F.col("sketch"), F.col("next.sketch"), F.col("next.text")).alias("near_next"),
        share_in(F.col("edited_sketch"), F.col("sketch"), F.col("text")).alias("edited_in_own"),
        share_in(F.col("next.sketch"), F.col("sketch"), F.col("text")).alias("next_in_own"),
        F.sequence(F.lit(1).cast("long"), "n").alias("each"),
    ).select("*", F.explode("each")).drop("each", "col")
