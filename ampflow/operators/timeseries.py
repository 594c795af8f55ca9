"""Ordered per-device computation: gaps, as-of lookups, rolling windows, runs, resets, islands.

All windows of one device share one partitioning, so a plan built from these has one Exchange; a
second order costs a sort only. Columns that an operator needs for itself start with ``__``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DEVICE, TIME = "device_id", "ts"
KEY = "__key"
#: Of rows that are split over tasks: the beginning of the row's block, and whether the row is the block's own.
PART, OWN = "__part", "__own"
TIES = 1024
#: Most rows of a task, as a mean, and the rows that are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 50_000, 2_000


def micros(ts: str | Column = TIME) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


@dataclass(frozen=True)
class Reach:
    """All rows up to a distance from the row, and how the one that stands nearest is picked: a value of theirs as of then."""

    window: WindowSpec
    pick: Callable[[Column], Column]

    def of(self, value: Column) -> Column:
        return self.pick(value).over(self.window)


@dataclass(frozen=True)
class Clock:
    """How rows of a device are ordered and how far frames reach.

    Without ``tie`` (device, time) is unique and the key is microseconds. With ``tie`` (columns that
    order rows of equal time, at most 1,024 of them, else an error) the key leaves room for a row's number among its
    equals. Frames of rows go by the key and end at the row itself; frames of time go by the microseconds alone, which
    keeps or leaves all rows of a time together, and the key then picks among those.
    """

    tie: tuple[str, ...] = ()
    #: Whether the rows are split into blocks of time (``spread``), each of which is a window partition.
    split: bool = False

    @property
    def by(self) -> list[str]:
        return [DEVICE, PART] if self.split else [DEVICE]

    def keyed(self, df: DataFrame) -> DataFrame:
        """The rows with a device and a time, and their key."""
        rows = df.where(F.col(DEVICE).isNotNull() & F.col(TIME).isNotNull())
        if not self.tie:
            return rows.withColumn(KEY, micros())
        device = Window.partitionBy(DEVICE)
        nth = F.row_number().over(device.orderBy(TIME, *self.tie)) - F.rank().over(device.orderBy(TIME))
        fits = F.when(nth < TIES, nth).otherwise(F.raise_error(F.lit(f"more than {TIES} rows of a device at one time")).cast("int"))
        return rows.withColumn(KEY, micros() * TIES + fits)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(KEY)

    @property
    def us(self) -> Column:
        """A keyed row's microseconds: its key without the place among its equals."""
        return F.shiftright(KEY, TIES.bit_length() - 1) if self.tie else F.col(KEY)

    def until(self, back: int) -> Reach:
        """All rows at or before t - back; the last of them is picked."""
        window = Window.partitionBy(*self.by).orderBy(self.us).rangeBetween(Window.unboundedPreceding, -back)
        return Reach(window, (lambda v: F.max_by(v, F.col(KEY))) if self.tie else F.last)

    def after(self, ahead: int) -> Reach:
        """All rows at or after t + ahead; the first of them is picked."""
        window = Window.partitionBy(*self.by).orderBy(self.us.desc()).rangeBetween(Window.unboundedPreceding, -ahead)
        return Reach(window, (lambda v: F.min_by(v, F.col(KEY))) if self.tie else F.last)


PLAIN = Clock()


def spread(keyed: DataFrame, clock: Clock, block: int, back: int, ahead: int = 0) -> tuple[DataFrame, Clock]:
    """The keyed rows split into blocks of time, and the clock whose windows take a block each.

    A device's rows then are as many window partitions as it has blocks, however long its history is. For what reaches
    ``back`` or ``ahead`` (microseconds, a block at most), a block also gets its neighbours' rows that near, and beyond them the one
    row that stands next, so that it holds an unbroken piece of the history: previous rows, rolling values within
    ``back`` and as-of lookups come out as over the whole device (what such values are computed from in turn adds to ``back``). The next rows come from summaries, a
    row for each block. Only rows with OWN count afterwards (``gathered``).
    """
    if block < max(back, ahead):
        raise ValueError("a block has to be as long as what reaches over its ends")
    own = keyed.columns
    start = clock.us - F.pmod(clock.us, F.lit(block))
    placed = keyed.select("*", start.alias(PART))
    p, us = F.col(PART), clock.us
    late, early = us >= p + (block - back), us < p + ahead
    shown = lambda part, mine: F.struct(part.alias(PART), F.lit(mine).alias(OWN))
    places = [shown(p, True), F.when(late, shown(p + block, False))]
    if ahead:
        places.append(F.when(early, shown(p - block, False)))
    near = placed.select(*own, F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("__at")).select(*own, f"__at.{PART}", f"__at.{OWN}")

    whole, key = F.struct(*own), F.col(KEY)
    ends = placed.groupBy(DEVICE, PART).agg(
        F.max_by(whole, key).alias("last"),
        F.max_by(whole, F.when(~late, key)).alias("before"),
        F.min_by(whole, key).alias("first"),
        F.min_by(whole, F.when(~early, key)).alias("beyond"),
    )
    blocks = Window.partitionBy(DEVICE).orderBy(PART)
    prior = F.when(F.lag(PART).over(blocks) == p - block, F.coalesce(F.lag("before").over(blocks), F.lag("last", 2).over(blocks)))
    nexts = [prior.otherwise(F.lag("last").over(blocks))]
    if ahead:
        then = F.when(F.lead(PART).over(blocks) == p + block, F.coalesce(F.lead("beyond").over(blocks), F.lead("first", 2).over(blocks)))
        nexts.append(then.otherwise(F.lead("first").over(blocks)))
    carried = ends.select(PART, F.array(*nexts).alias("__rows")).select(PART, F.explode("__rows").alias("__row")).where("__row is not null")
    return near.unionByName(carried.select("__row.*", PART, F.lit(False).alias(OWN))), replace(clock, split=True)


def gathered(rows: DataFrame) -> DataFrame:
    """The rows of all blocks once, without what marks the blocks."""
    return rows.where(OWN).drop(PART, OWN)


def dealt(df: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """The rows dealt by columns over so many tasks that none gets more than ``TASK_ROWS`` or so, however large the table is.

    Windows over these columns then need no other exchange, and their sorts hold a task's rows. n: the rows, counted if not given.
    """
    n = df.count() if n is None else n
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(usual, -(-n // LEAST_ROWS)), -(-n // TASK_ROWS)), *by)


def asof(value: str | Column, reach: Reach, distance: int, tolerance: int | None = None) -> Column:
    """The value of the row that the reach picks, null values included.

    distance: how far the reach stands from the row (microseconds); with a tolerance, a row that is
    more than that beyond it does not count.
    """
    value = F.col(value) if isinstance(value, str) else value
    found = reach.of(F.struct(value.alias("v"), micros().alias("us")))
    if tolerance is None:
        return found["v"]
    return F.when(F.abs(micros() - found["us"]) <= distance + tolerance, found["v"])


def with_gap(df: DataFrame, clock: Clock = PLAIN, block: int | None = None) -> DataFrame:
    """Adds gap_sec, the seconds since the device's previous row. block: microseconds; splits long devices over tasks."""
    rows = clock.keyed(df)
    if block is not None:
        rows, clock = spread(rows, clock, block, 0)
    found = rows.withColumn("gap_sec", seconds_between(F.col(TIME), F.lag(TIME).over(clock.window))).drop(KEY)
    return gathered(found) if clock.split else found


@dataclass(frozen=True)
class Rolling:
    """One rolling aggregate: its name, its values, width in microseconds and least number of values."""

    name: str
    value: Column
    kind: str
    width: int
    least: int


def with_rolling(keyed: DataFrame, clock: Clock, wanted: list[Rolling]) -> DataFrame:
    """Adds rolling means, sample deviations and maxima to rows that have their key.

    Means and deviations come from running sums within blocks of time as long as the widest window, so a window reaches
    over a row's block and the one before: the sums so far, those of the block before, less those as of the window's
    start. The work does not grow with a window's width, and no sum with a device's history. Values are
    taken relative to the device's first, which keeps the squares small. A maximum has no inverse; see ``_with_maximum``.
    """
    for r in wanted:
        if r.kind == "max":
            keyed = _with_maximum(keyed, clock, r)
    linear = [r for r in wanted if r.kind in ("avg", "std")]
    names = {r.name for r in wanted}
    own = [c for c in keyed.columns if c not in names]
    if not linear:
        return keyed.select(*own, *[r.name for r in wanted])
    block = max(r.width for r in linear)
    running = clock.window.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*clock.by, "__start").orderBy(KEY).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*clock.by).orderBy("__start").rangeBetween(Window.unboundedPreceding, -block)
    first = keyed.select(
        "*",
        (micros() - F.pmod(micros(), F.lit(block))).alias("__start"),
        *[F.first(r.value, ignorenulls=True).over(running).alias(f"__{r.name}_0") for r in linear],
        *[r.value.alias(f"__{r.name}_v") for r in linear],
    )

    def sums(r: Rolling) -> Column:
        moved = F.col(f"__{r.name}_v") - F.col(f"__{r.name}_0")
        zero = F.lit(0.0)
        return F.struct(
            F.count(moved).over(inside).alias("n"),
            F.coalesce(F.sum(moved).over(inside), zero).alias("s"),
            F.coalesce(F.sum(moved * moved).over(inside), zero).alias("q"),
        )

    summed = first.select("*", F.struct("__start", *[sums(r).alias(r.name) for r in linear]).alias("__now"))
    prior = summed.select("*", F.max_by("__now", KEY).over(earlier).alias("__prior"))
    widths = sorted({r.width for r in linear})
    before = prior.select("*", *[clock.until(w).of(F.col("__now")).alias(f"__before_{w}") for w in widths])

    def part(r: Rolling, f: str) -> Column:
        now, past, gone = F.col("__now"), F.col("__prior"), F.col(f"__before_{r.width}")
        start = F.col("__start")
        both = now[r.name][f] + F.when(past["__start"] == start - block, past[r.name][f]).otherwise(0)
        within = F.when(gone["__start"] == start, now[r.name][f] - gone[r.name][f])
        return within.when(gone["__start"] == start - block, both - gone[r.name][f]).otherwise(both)

    parts = before.select("*", *[F.struct(*[part(r, f).alias(f) for f in "nsq"]).alias(f"__{r.name}_w") for r in linear])

    def of(r: Rolling) -> Column:
        n, s, q = (F.col(f"__{r.name}_w")[f] for f in "nsq")
        if r.kind == "avg":
            return F.when(n >= r.least, F.try_divide(s, n) + F.col(f"__{r.name}_0"))
        spread = F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))
        return F.when(n >= F.greatest(F.lit(r.least), F.lit(2)), F.sqrt(spread))

    return parts.select(*own, *[(F.col(r.name) if r.kind == "max" else of(r)).alias(r.name) for r in wanted])


def _with_maximum(keyed: DataFrame, clock: Clock, r: Rolling) -> DataFrame:
    """Adds a rolling maximum over (t - width, t] up to the row itself, in work that does not grow with the width.

    Time falls into blocks as long as the window, so a window is the beginning of the row's block up to the row, and the end
    of the block before: what follows, in that block, the last row at or before t - width. Running maxima from both ends of the
    blocks and that row, looked up as of then, give both parts.
    """
    own, w = keyed.columns, r.width
    start = clock.us - F.pmod(clock.us, F.lit(w))
    rows = keyed.select("*", start.alias("__start"), r.value.alias("__v"))
    block = Window.partitionBy(*clock.by, "__start")
    begun = block.orderBy(KEY).rowsBetween(Window.unboundedPreceding, 0)
    rest = block.orderBy(F.desc(KEY)).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("__v").over(clock.window.rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.select("*", F.struct("__start", n.alias("n"), F.max("__v").over(begun).alias("begun"), F.max("__v").over(rest).alias("rest")).alias("__now"))
    earlier = Window.partitionBy(*clock.by).orderBy("__start").rangeBetween(Window.unboundedPreceding, -w)
    met = ends.select("*", F.max_by("__now", KEY).over(earlier).alias("__prior"), clock.until(w).of(F.col("__now")).alias("__gone"))
    now, past, gone, before = F.col("__now"), F.col("__prior"), F.col("__gone"), F.col("__start") - w
    end = F.when(gone["__start"] == before, gone["rest"]).when(past["__start"] == before, past["begun"])
    enough = now["n"] - F.coalesce(gone["n"], F.lit(0)) >= r.least
    return met.select(*own, F.when(enough, F.greatest(now["begun"], end)).alias(r.name))


def with_run(keyed: DataFrame, member: Column, name: str, clock: Clock = PLAIN, add: Column | None = None) -> DataFrame:
    """Adds the running count (or the running sum of ``add``) of members since the last row that is none; 0 there."""
    running = clock.window.rowsBetween(Window.unboundedPreceding, 0)
    own = keyed.columns
    marked = keyed.select(
        "*",
        member.alias("__member"),
        F.sum((~member).cast("long")).over(running).alias("__block"),
        (F.lit(1).cast("long") if add is None else add).alias("__add"),
    )
    inside = Window.partitionBy(DEVICE, "__block").orderBy(KEY).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("__member"), F.col("__add"))).over(inside)
    zero = F.lit(0) if add is None else F.lit(0.0)
    return marked.select(*own, F.when(F.col("__member"), total).otherwise(zero).alias(name))


def islands(keyed: DataFrame, state: Column, clock: Clock = PLAIN) -> DataFrame:
    """(device, segment, state, start_ts, end_ts, n): maximal runs of rows in one state."""
    marked = keyed.select(DEVICE, TIME, KEY, state.alias("state"))
    changed = F.when(F.col("state").eqNullSafe(F.lag("state").over(clock.window)) & (F.row_number().over(clock.window) > 1), 0)
    stepped = marked.withColumn("__change", changed.otherwise(1))
    numbered = stepped.withColumn(
        "segment", F.sum("__change").over(clock.window.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(DEVICE, "segment").agg(
        F.first("state").alias("state"), F.min(TIME).alias("start_ts"), F.max(TIME).alias("end_ts"), F.count("*").alias("n")
    )


def top_devices(df: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(device, n): the k devices with most rows; ties go to the smaller id."""
    rows = df if where is None else df.where(where)
    counts = rows.where(F.col(DEVICE).isNotNull()).groupBy(DEVICE).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), DEVICE).limit(k)
