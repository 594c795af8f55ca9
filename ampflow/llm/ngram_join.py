"""Similarity join of texts on their sets of word shingles by parity sketches.

A document's set holds its distinct four-word shingles; two documents link when 100 * intersection >= 85 * union. That leaves the two
sets at most D(a, b) = 15 (a + b) / 185 shingles apart, where a and b are their sizes, and needs b <= a / 0.85.

Parity sketch: every shingle's hash flips one bit, so bits that two sets share cancel and the Hamming distance of two sketches
is never more than the symmetric difference of the sets. Two uses follow, both without a loss:

* Pigeonhole join. A size band has one D, that of its largest pair, and cuts the hash space into D + S segments (S: ``slack``). A pair
  in reach differs in D segments at most, so at least S segments have equal sketches. A segment's sketch is taken over all 2 ** 64
  bits (what a shingle flips never meets another's) and moves as the XOR of its hashes: one 64-bit key for each segment. A set
  takes part in its own band and, where it can be the larger partner of one there, in the band below.
* Fewer keys. At least S keys of a pair are equal, so a set may leave out its S - 1 most frequent keys: the rarest
  equal key of the pair stays. Segments without a shingle, or with a few common ones, go that way, and with them most sets that have
  nothing but such keys in common with others.
* Pruning. A folded sketch of 16 bits and more for each shingle of D, compared before any sets are.

Copies are one set from the start, and a task sends a set's keys once. The keys are the only wide shuffle, of 16 bytes each. Those that
only one set has (nearly all) go at once, and of those with the same members (128 bits tell) one stays; the rest make buckets, whose members are compared by sketch in blocks of ``BLOCK`` (a large
bucket becomes pairs of blocks, dealt to many tasks). First each member takes its nearest in a bucket; what links is contracted. Then
buckets whose members are of one class are done, and in the others every two members of unlike classes are compared. Only
pairs that the sketch cannot rule out leave a task, and they are verified on the whole sets. So no link between unlike sets is lost,
and members that are linked already are not compared.

The sets of pairs to verify are cut from the texts again, not stored for all. A bit map of fixed size tells which documents
that concerns (more than it can tell apart only cost time).

Shingles are compared as 64-bit hashes. Two sets of one 64-bit name would be found by a second hash, and raise an error.

Defined results: a null or blank text has an empty set, no link and itself as component; a null doc_id links by its text and is never the
smallest; a class without any id has a null component; repeated rows give repeated results; an empty table gives an
empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampflow.llm.common import durable, pieces_of, stored, whole
from ampflow.llm.components import components

WORDS = 4
PERCENT = 85
SLACK = 3
BLOCK = 1024
#: Bits of the map of documents, which is broadcast as words of 64 bits.
MAP = 1 << 24

_U = np.uint64
#: Upper case to lower case, and all white space to a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Names of sets that a task remembers having sent.
_SEEN = 200_000
_FLUSH = 1 << 20


def apart(a, b):
    """The most shingles that linked sets of these sizes can differ in."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def slack(most: int) -> int:
    """How many equal keys a pair in reach has at least, in a band whose pairs differ in so many shingles at most."""
    return SLACK + most // 6


def _bands() -> list[tuple[int, int, int, int, int]]:
    """(smallest, largest, segments, bits, slack) of each size band; smaller sets link to equal ones only."""
    low = next(a for a in range(1, 1000) if apart(a, 100 * a // PERCENT))
    found = []
    while low < 1 << 36:
        high = low * 10_000 // PERCENT**2
        most = apart(high, 100 * high // PERCENT)
        found.append((low, high, most + slack(most), 1 << max(9, (16 * most - 1).bit_length()), slack(most)))
        low = high + 1
    return found


#: Fewer than 128, as the lowest seven bits of a key hold its band.
BANDS = _bands()
_LOWS = [b[0] for b in BANDS]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a text of fewer words is one."""
    of = xxhash.xxh64_intdigest
    parts = []
    for piece in pieces_of((text or "").encode().translate(_CLEAN)):
        words = piece.split()
        parts.append(np.fromiter(map(of, words), _U, len(words)))
    words = np.concatenate(parts)
    if not len(words):
        return words
    n = min(WORDS, len(words))
    found = np.full(len(words) - n + 1, n, _U)
    for i in range(n):
        found = _mixed(found * _U(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return np.unique(found)


def keys_of(found: np.ndarray) -> np.ndarray:
    """The segment keys of a set in the bands it takes part in; the lowest bits tell the band."""
    n = len(found)
    own = np.searchsorted(_LOWS, n, side="right") - 1
    summed = np.concatenate([np.zeros(1, _U), np.bitwise_xor.accumulate(found)])
    keys = []
    for k in (own, own - 1):
        if k < 0 or n > 100 * BANDS[k][1] // PERCENT:
            continue
        m = BANDS[k][2]
        place = ((found >> _U(32)) * _U(m)) >> _U(32)  # rises with the hash, so a segment is a slice
        ends = np.searchsorted(place, np.arange(m + 1, dtype=_U))
        salt = np.arange(m, dtype=_U) * _U(0xD6E8FEB86659FD93) + _U(k + 1)
        hashed = _mixed(summed[ends[1:]] ^ summed[ends[:-1]] ^ _mixed(salt))
        keys.append(hashed & ~_U(127) | _U(k))
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def sketch_of(found: np.ndarray) -> bytes:
    """The parity sketch, of as many bits as the set's band has."""
    k = max(0, int(np.searchsorted(_LOWS, len(found), side="right")) - 1)
    bits = BANDS[k][3]
    flips = np.bincount((found & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(flips & 1, bitorder="little").tobytes()


def _name(found: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), seed) - (1 << 63) if len(found) else 0


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, sid, other, keys, sketch); keys and sketch once for each set of a task."""
    seen: set[int] = set()

    def out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n, sid, other, keys, sketch = zip(*rows)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate(keys).view(np.int64))
        columns = [ids, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(other, pa.int64()), lists, pa.array(sketch, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sid", "other", "keys", "sketch"])

    for batch in batches:
        rows, begin, held, texts = [], 0, 0, batch.column("text")
        for i in range(batch.num_rows):
            found = shingles(texts[i].as_py())
            sid = _name(found, 1)
            new = sid not in seen and len(found) >= _LOWS[0]
            if new:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sid)
            keys = keys_of(found) if new else found[:0]
            rows.append((len(found), sid, _name(found, 2), keys, sketch_of(found) if new else None))
            held += len(keys)
            if held > _FLUSH:
                yield out(batch.column("doc_id").slice(begin, len(rows)), rows)
                rows, begin, held = [], i + 1, 0
        if rows:
            yield out(batch.column("doc_id").slice(begin), rows)


def prints(docs: DataFrame) -> DataFrame:
    """What the join needs of every document, stored; no texts."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    return stored(texts.mapInArrow(_print, "doc_id bigint, n bigint, sid bigint, other bigint, keys array<bigint>, sketch binary"), "ngrams")


def buckets(found: DataFrame) -> DataFrame:
    """(key, sid): the keys by which unlike sets meet, without each set's most frequent ones; of keys with the same members one."""
    rows = found.select(F.explode("keys").alias("key"), "sid")
    met = Window.partitionBy("key")
    shared = rows.select("key", "sid", (F.min("sid").over(met) != F.max("sid").over(met)).alias("shared")).where("shared")
    live = durable(shared.select("key", "sid").distinct())
    counts = live.groupBy("key").agg(F.count("*").alias("c"))
    band = F.col("key").bitwiseAND(127)
    frequent = Window.partitionBy("sid", band).orderBy(F.desc("c"), F.desc("key"))
    kept = live.join(counts, "key").select("key", "sid", F.row_number().over(frequent).alias("nth"))
    enough = F.get(F.array(*[F.lit(b[4]) for b in BANDS]), band.cast("int"))
    rare = durable(kept.where(F.col("nth") >= enough).select("key", "sid"))
    marks = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    members = rare.groupBy("key").agg(F.count("*").alias("c"), *marks).where("c > 1")
    unlike = members.groupBy("c", "mark1", "mark2").agg(F.min("key").alias("key")).select("key")
    return durable(rare.join(unlike, "key", "left_semi"))


def sets_of(docs: DataFrame, found: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, items): the sets of these names, cut from the texts of one document each (and of some more)."""
    ids = found.select("sid", "doc_id").join(sids, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MAP)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(63))
    slots = ids.where("doc_id is not null").select(slot.alias("slot"))
    marked = slots.groupBy(F.shiftright("slot", 6).alias("of")).agg(F.bit_or(bit).alias("bits"))  # MAP / 64 rows at most
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text")).select("*", slot.alias("slot"))
    hit = F.col("doc_id").isNull() | (F.col("bits").bitwiseAND(bit) != 0)
    concerned = texts.join(F.broadcast(marked), F.shiftright("slot", 6) == F.col("of"), "left").where(hit).select("text")

    def out(names: list[int], items: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, items)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate(items).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists], ["sid", "items"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, items, held = [], [], 0
            for text in batch.column("text"):
                items.append(shingles(text.as_py()))
                names.append(_name(items[-1], 1))
                held += len(items[-1])
                if held > _FLUSH:
                    yield out(names, items)
                    names, items, held = [], [], 0
            if names:
                yield out(names, items)

    every = concerned.mapInArrow(cut, "sid bigint, items array<bigint>").join(sids, "sid", "left_semi")
    return stored(every.dropDuplicates(["sid"]), "ngram-sets")


def linked(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough, verified on the whole sets."""
    sets = sets_of(docs, found, durable(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("items").alias(f"{c}_items"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    sizes = F.size("a_items") + F.size("b_items")
    return durable(met.where(100 * common >= PERCENT * (sizes - common)).select("a", "b"))


def _near(sids, roots, sizes, sketches, left, right, only_nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike classes whose sketches do not rule a link out; of the nearest only, one for each member.

    left, right: the places that are compared; equal arrays stand for all pairs among them.
    """
    bits = min(map(len, sketches)) * 8
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, _U).reshape(-1, bits // 64), axis=0) for s in sketches])
    same = left is right
    firsts, seconds = [], []
    step = max(1, (1 << 22) // max(1, len(right) * folded.shape[1]))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        distance = np.bitwise_count(folded[some][:, None, :] ^ folded[right][None, :, :]).sum(axis=2, dtype=np.int64)
        a, b = sizes[some][:, None], sizes[right][None, :]
        fits = (roots[some][:, None] != roots[right][None, :]) & (distance <= apart(a, b))
        fits &= 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
        if only_nearest:
            distance[~fits] = 1 << 40
            place = distance.argmin(axis=1)
            rows = np.flatnonzero(fits[np.arange(len(some)), place])
            cols = place[rows]
        else:
            if same:
                fits &= some[:, None] < right[None, :]
            rows, cols = np.nonzero(fits)
        firsts.append(sids[some[rows]])
        seconds.append(sids[right[cols]])
    return np.concatenate(firsts), np.concatenate(seconds)


def _compared(only_nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows sorted by (key, i, j): each run is one pair of blocks of one bucket."""

    def run(part: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        block = part.column("block").to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        numbers = (part.column(c).to_numpy() for c in ("sid", "root", "n"))
        return _near(*numbers, part.column("sketch").to_pylist(), left, right, only_nearest)

    def out(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: pa.Table | None = None
        for batch in (b for b in batches if b.num_rows):
            table = pa.Table.from_batches([batch])
            if open_run is not None:
                table = pa.concat_tables([open_run, table])
            table = table.combine_chunks()
            changes = np.zeros(table.num_rows - 1, bool)
            for c in ("key", "i", "j"):
                changes |= np.diff(table.column(c).to_numpy()) != 0
            starts = [0, *(np.flatnonzero(changes) + 1).tolist()]
            found = [run(table.slice(s, e - s)) for s, e in zip(starts, starts[1:])]
            open_run = table.slice(starts[-1])
            if found := [f for f in found if f is not None and len(f[0])]:
                yield out(found)
        if open_run is not None and open_run.num_rows and (last := run(open_run)) is not None and len(last[0]):
            yield out([last])

    return compare


def _candidates(rows: DataFrame, roots: DataFrame | None, sketches: DataFrame, only_nearest: bool) -> DataFrame:
    """(a, b): pairs of members of one bucket that are of unlike classes and that the sketches do not rule out."""
    if roots is None:
        classed = rows.select("key", "sid", F.col("sid").alias("root"))
    else:
        classed = rows.join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    mixed = classed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).where("x != y")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    placed = classed.join(mixed.select("key", blocks.alias("nb")), "key").join(sketches, "sid")
    placed = placed.select("*", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int").alias("block"))
    partner = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = placed.select("key", "sid", "root", "n", "sketch", "block", partner.alias("with"))
    dealt = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "sid", "root", "n", "sketch", "block")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(_compared(only_nearest), "a bigint, b bigint").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, component_id) of every document."""
    found = prints(docs)
    names = durable(found.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("first"), F.min("other").alias("x"), F.max("other").alias("y")
    ))
    if not names.where("x != y").isEmpty():
        raise RuntimeError("two sets of shingles have one 64-bit name; change the seeds of _name")
    roots = _classed(docs, found)
    named = names.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classed = named.join(smallest, "root").select(F.col("sid").alias("of"), "component_id")
    met = found.where("n > 0").join(classed, F.col("sid") == F.col("of")).select("doc_id", "n", "component_id")
    return met.union(found.where("n = 0").select("doc_id", "n", "doc_id"))


def _classed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root): the class of every set that links to another."""
    rows = buckets(found)
    some = found.where("sketch is not null").select("sid", "n", "sketch").join(rows.select("sid").distinct(), "sid", "left_semi")
    sketches = durable(some.dropDuplicates(["sid"]))
    links = roots = None
    for only_nearest in (True, False):
        pairs = durable(_candidates(rows, roots, sketches, only_nearest))
        if pairs.isEmpty():
            continue
        more = linked(docs, found, pairs)
        links = more if links is None else links.union(more)
        roots = components(links)
    return found.sparkSession.createDataFrame([], "node bigint, root bigint") if roots is None else roots


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    kind = docs.schema["doc_id"].dataType
    return classes(docs).select(F.col("doc_id").cast(kind), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind))


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS shingle
  FROM d
), n AS MATERIALIZED (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.rid <> y.rid GROUP BY ALL)
  JOIN n na ON a = na.rid JOIN n nb ON b = nb.rid WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach(a, b) AS (
  SELECT rid, rid FROM d
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), first_ AS (
  SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON reach.b = d.rid GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN first_ ON d.rid = first_.a LEFT JOIN n USING (rid)
"""
