"""Expressions and helpers that several text operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row; maps, which Spark doesn't hash, count by their sorted entries, inside other columns too."""
    return F.xxhash64(*[_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])


def _hashable(value: Column, kind: T.DataType) -> Column:
    if not _holds_map(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_hashable(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]))
    pair = lambda e: F.struct(e["key"].alias("k"), _hashable(e["value"], kind.valueType).alias("v"))
    return F.array_sort(F.transform(F.map_entries(value), pair))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind)


def shielded(*needed: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators that return the documents' own columns, in order and before any others.

    While such an operator runs, columns that it doesn't need itself have names that none of its own can be like.
    """

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            own = docs.columns
            found = operator(docs.toDF(*[c if c in needed else f"own column {i}" for i, c in enumerate(own)]), *args, **kwargs)
            return found.toDF(*own, *found.columns[len(own) :])

        return run

    return decorate


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session of one machine may do without and gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "ampflow-checkpoints")


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared checkpoint folder, without lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: columns apart and compressed, unlike ``durable``."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (upper and lower case alike)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def pieces_of(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at a space; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b" ", at + 1, at + size)
        if end < 0:
            end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def sums_before(df: DataFrame, key: Column, values: dict[str, Column], last: Column | None = None) -> DataFrame:
    """The rows and, by name, the sums of values over all rows that come before in the order of key.

    Rows are dealt by ranges of key, each of which a window sums; the ranges' own totals, one row each, give the
    rest. last: rows for which it holds come after all others.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    order = ([] if last is None else [last]) + [key]
    keyed = df.select(*own, F.struct(*order).alias("__order"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("__v"))
    ranged = durable(keyed.repartitionByRange("__order").select("*", F.spark_partition_id().alias("__range")))
    sums = [F.sum(f"__v.{n}").alias(n) for n in values]
    earlier = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("__range").alias("__at")).agg(*sums)
    begun = totals.select("__at", F.struct(*[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in values]).alias("__b"))
    inside = Window.partitionBy("__range").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.join(begun, F.col("__range") == F.col("__at"))
    return met.select(*own, *[(F.coalesce(F.sum(f"__v.{n}").over(inside), F.lit(0)) + F.col(f"__b.{n}")).alias(n) for n in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the expression of value stands in the plan once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Of an array of ints, what combine makes of all items before each, beginning with 0.

    An array that grows by an item is copied, so the items go in blocks of about the root of their number.
    """
    ints = F.array().cast("array<int>")

    def within(items: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(items, F.struct(begin.alias("at"), ints.alias("out")), step, lambda acc: acc["out"])

    def by_blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        places = F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1)
        blocks = F.transform(places, lambda b: F.slice(v, b * size + 1, size))
        begun = lambda parts: within(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), combine)), F.lit(0))
        done = let(blocks, lambda parts: F.flatten(F.zip_with(parts, begun(parts), within)))
        return F.when(F.size(v) > 0, done).otherwise(ints)

    return let(values, by_blocks)


def spans_of(text: Column, pattern: str, keep=None) -> Column:
    """Matches of a pattern, leftmost and not overlapping, as array<struct<start,end,match>>.

    Offsets are code points, the end exclusive. The pieces between the matches give the
    offsets, so no expression looks a match up again. ``keep`` maps a match to a condition.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(
        F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"))),
        lambda p: p["match"].isNotNull(),  # the last gap has no match
    )

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + F.length(x["match"])))
        spans = F.zip_with(
            p,
            before,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("match")
            ),
        )
        return spans if keep is None else F.filter(spans, lambda s: keep(s["match"]))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(pieces, placed)).otherwise(none)


#: Characters of a chunk, in which a part of a long text is looked up.
CHUNK = 4096


def replaced(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """The text with something else for its spans (array<struct<start,end,...>>, sorted by start).

    Spans that overlap count as one. fill maps the length of what goes to what comes.
    """
    shaped = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))

    def part(c: Column, start: Column, length: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        n = F.floor((start + length) / CHUNK).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(c, first + 1, n), ""), start - first * CHUNK + 1, length)

    def build(x: Column) -> Column:
        """x: struct<spans,chunks>."""
        before = running(F.transform(x["spans"], lambda s: s["end"]), lambda a, e: F.greatest(a, e))
        placed = F.zip_with(x["spans"], before, lambda s, b: F.struct(b.alias("from"), s["start"].alias("to")))
        kept = F.filter(placed, lambda k: k["to"] >= k["from"])
        tail = F.struct(F.array_max(F.transform(x["spans"], lambda s: s["end"])).alias("from"), F.length(text).alias("to"))

        def one(k: Column, i: Column, every: Column) -> Column:
            come = F.when(i > 0, fill(k["from"] - F.get(every, i - 1)["to"])).otherwise("")
            return F.concat(come, part(x["chunks"], k["from"], k["to"] - k["from"]))

        return let(F.concat(kept, F.array(tail)), lambda every: F.array_join(F.transform(every, lambda k, i: one(k, i, every)), ""))

    done = let(F.struct(shaped.alias("spans"), chunks.alias("chunks")), build)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<start,rank,end,kind>>, by start and then rank, comma-joined."""
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
