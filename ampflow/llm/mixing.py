"""Mixing sources to target weights by pivotal dependent rounding (built-in expressions only).

A source with words S and target T wants T / S copies of each of its documents: a whole number,
and a fraction that pivotal rounding makes whole. Two documents meet; mass moves from one to the
other, at random but with unchanged expectation, until one of them is whole. The other meets the next.
What moves is counted in words, so a source is off its target by the rounding of its one last residual.

Of two that meet, the larger moves between the whole numbers next to it and the smaller takes what that leaves, within
0 and ``most`` copies. So the residual goes on to ever smaller documents, and the last one is small.

The reduction tree has a width of about ``BLOCK``: a block of so many documents goes from its largest to its smallest
and leaves one residual; those residuals form blocks of the next level, and so on until a
source has one residual left, which becomes the nearest whole number (the one step that can change an expectation).
Blocks are numbered by a hash of the document, so a source of any share of the rows spreads over as many tasks as it
has blocks. Equal rows are one unit with a number, which want so many times the copies; they meet before anything is
dealt by that hash. All draws are hashes of the documents, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last; documents
of size 0 take 0 words, and their number is drawn alone; equal rows share their copies out, none gets two more than another;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import durable, let, n_words, row_hash, shielded, sums_before, whole

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, n): documents, n of them with this hash h of the whole row."""
    rows = docs.select("doc_id", "source", n_words(whole("text")).alias("size"), row_hash(docs).alias("h"))
    return rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n"))


def level_of(weighed: DataFrame, most: int) -> float:
    """The level at which min(most * size, level * weight) sums to all words of (source_size, weight).

    From the level without limits it rises, as sources reach theirs; one row of sums a step comes back.
    """
    level, limited = 0.0, -1
    while True:
        at = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(at, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0)).alias("free"),
            F.count_if(at).alias("limited"),
        ).first()
        if not row["free"] or row["limited"] == limited:
            return level
        level, limited = (row["all"] - most * row["held"]) / row["free"], row["limited"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_units, target): one row for each source, numbered in their order by range."""
    stats = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units"))
    placed = sums_before(stats, F.struct("source"), {"place": F.lit(1)}, last=F.col("source").isNull())
    each = F.array(*[F.lit(w) for w in weights])
    weighed = durable(placed.select("*", F.get(each, F.pmod("place", F.lit(len(weights))).cast("int")).alias("weight")))
    limit = most * F.col("source_size").cast("double")
    return weighed.select(
        "source", "source_size", "n_units", F.least(limit, F.lit(level_of(weighed, most)) * F.col("weight")).alias("target")
    )


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / float(1 << 52)


_UNIT = "struct<size:bigint,h:bigint,doc_id:bigint,n:bigint,copies:double>"


def _unit(x: Column, number: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("size", "h", "doc_id", "n")], number.cast("double").alias("copies"))


def _duel(a: Column, b: Column, most: int, turn: int) -> Column:
    """struct<left,done>: one of two units becomes whole (done), the other keeps the rest (left).

    b is not larger than a. What moves is words, so the words that both are expected to give stay as they were. a moves
    to the whole numbers next to it, b anywhere within its limits, 0 and ``most`` copies of each of its documents; each
    direction ends where a is whole or b is at a limit, and its probability is the other's length. So
    the rest goes to the smaller unit unless that one is at its limit first.
    """
    low, room = F.floor(a["copies"]), F.lit(float(most)) * b["n"]
    down, up = (a["copies"] - low) * a["size"], (1 - (a["copies"] - low)) * a["size"]
    rise, fall = (room - b["copies"]) * b["size"], b["copies"] * b["size"]
    to_b, to_a = F.least(down, rise), F.least(up, fall)
    ups = _uniform(a["h"], b["h"], F.lit(turn)) * (to_a + to_b) < to_b
    within = lambda x: F.greatest(F.lit(0.0), F.least(room, x))

    def out(left: Column, number: Column, done: Column, final: Column) -> Column:
        return F.struct(_unit(left, number).alias("left"), _unit(done, final).alias("done"))

    return (
        F.when(down == 0, out(b, b["copies"], a, low))
        .when(ups & (up <= fall), out(b, within(b["copies"] - up / b["size"]), a, low + 1))
        .when(ups, out(a, a["copies"] + fall / a["size"], b, F.lit(0.0)))
        .when(down <= rise, out(b, within(b["copies"] + down / b["size"]), a, low))
        .otherwise(out(a, a["copies"] - rise / a["size"], b, room))
    )


def _level(units: DataFrame, level: int, most: int) -> DataFrame:
    """(source, block, unit, done): units (source, block, unit) once their blocks were gone through, one of each still open."""
    blocks = units.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
    begin = F.struct(F.get("units", F.lit(0)).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def meet(acc: Column, x: Column) -> Column:
        return let(
            _duel(acc["left"], x, most, level),
            lambda met: F.struct(met["left"].alias("left"), F.concat(acc["done"], F.array(met["done"])).alias("done")),
        )

    tagged = F.aggregate(
        F.slice("units", 2, F.size("units")),
        begin,
        meet,
        lambda acc: F.concat(
            F.array(F.struct(acc["left"].alias("unit"), F.lit(False).alias("done"))),
            F.transform(acc["done"], lambda u: F.struct(u.alias("unit"), F.lit(True).alias("done"))),
        ),
    )
    return blocks.select("source", "block", F.explode(tagged).alias("x")).select("source", "block", "x.unit", "x.done")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, h, size, n, source_size, target, copies): copies of n equal documents together.

    doc_id is taken as a bigint. The number of levels of the tree follows the largest source.
    """
    sizes = durable(sized(docs))
    plan = durable(targets(sizes, weights, most))
    largest = plan.agg(F.max("n_units")).first()[0] or 0
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) * F.col("n")
    joined = sizes.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    wanted = joined.select("source", "h", F.col("doc_id").cast("bigint").alias("doc_id"), "size", "n", "n_units", share.alias("share"))
    as_unit = lambda number: F.struct("size", "h", "doc_id", "n", number.cast("double").alias("copies")).alias("unit")
    block = F.pmod(F.xxhash64("h", F.lit("block")), F.ceil(F.col("n_units") / BLOCK))
    units = wanted.where("size > 0").select("source", block.alias("block"), as_unit(F.col("share")))
    every = wanted.where("size = 0").select("source", as_unit(F.floor(F.col("share") + _uniform("h", F.lit("empty")))))
    level, blocks = 0, -(-largest // BLOCK)
    while True:
        ran = durable(_level(units, level, most))
        every = every.union(ran.where("done").select("source", "unit"))
        units = ran.where(~F.col("done")).select("source", F.floor(F.col("block") / BLOCK).alias("block"), "unit")
        if blocks <= 1:
            break
        level, blocks = level + 1, -(-blocks // BLOCK)
    last = units.select("source", F.col("unit").withField("copies", F.round("unit.copies")).alias("unit"))
    whole_units = every.union(last).select("source", "unit.*").withColumn("copies", F.col("copies").cast("long"))
    return whole_units.join(
        plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).select("doc_id", "source", "h", "size", "n", "source_size", "target", "copies")


def report(docs: DataFrame) -> DataFrame:
    """Of n equal documents each gets an n-th of their copies, the first ones one more."""
    found = copies(docs)
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.floor((F.col("copies") + F.col("n") - 1 - i) / F.col("n")).cast("int"),
    )
    return found.select("doc_id", "size", "source_size", "target", F.explode(each).alias("copies")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"
    )


@shielded("doc_id", "text", "source")
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with their own columns.

    Documents are told apart by all their columns; equal rows are taken as often as their copies say together.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    wanted = copies(docs, weights, most).where("copies > 0")
    picked = wanted.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("copies").alias("__copies"))
    keyed = docs.select(*own, row_hash(docs).alias("__key"))
    met = keyed.join(picked, (F.col("__key") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__nth")
    return met.dropDuplicates(["__key", "__id"]).select(*own, times).drop("__nth")
