"""Vector code compression: each vector becomes one entry number for each of its parts.

A vector's components are scaled and floored to integers, its 16 equal parts are compared with 64 entries each, and only the
numbers of the nearest entries are kept. The tasks turn rows into columnar numpy blocks (one contiguous line of integers for
each component), so the distances of a block to all entries build up component by component. A round is one ``treeAggregate``:
a task adds its parts to integer tensors of sums and counts (``np.add.at``) and the tensors, whose size depends on the
settings and the vectors' length only, merge through a reduction tree. Everything is integer arithmetic, so the order of
the merges changes nothing and reruns agree.

Each round reads the vectors anew, in four bytes a component, and keeps no wider copy of them; a lost executor costs its tasks.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped. The length of the
vectors is that of the smallest id (null last) whose length is a positive multiple of the parts; a vector of any other
length keeps its row with a null code and error and takes no part in the codebooks. Of equal ids the smaller integers
come first in the codebook; a null id comes last. Fewer vectors than entries give as many entries. Scaled components
are held within a bound (``limit``, some 2 ** 26 for 64 components) beyond which squared distances would not
fit 64 bits. A sum of errors that does not fit is null. Repeated rows count each time. An empty table gives an empty
result. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.llm.common import durable

#: Vectors of a numpy block.
BLOCK = 4096


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass(frozen=True)
class Compressed:
    """rows: (vec_id, label, code array<int>, error bigint); books: int64 (part, component, entry)."""

    rows: DataFrame
    books: np.ndarray


def limit(length: int) -> int:
    """The largest scaled component: so large that a whole vector's squared distance stays below 2 ** 62."""
    return isqrt((1 << 62) // max(length, 1)) // 2


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """(n, length) of a list array without nulls."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(limit(length))
    return np.clip(np.floor(values * scale), -most, most).astype(np.int64).reshape(-1, length)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of a part (components, n); of equal ones the lower entry. book: (components, entries)."""
    distance = np.zeros((book.shape[1], part.shape[1]), np.int64)
    for line, entries in zip(part, book):
        off = line[None, :] - entries[:, None]
        off *= off
        distance += off
    entry = distance.argmin(axis=0)
    return entry, distance[entry, np.arange(part.shape[1])]


def _add(sums: tuple[np.ndarray, np.ndarray] | None, block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, width, entries = books.shape
    total, count = sums or (np.zeros_like(books), np.zeros((parts, entries), np.int64))
    for p in range(parts):
        part = block[p * width : (p + 1) * width]
        entry, _ = nearest(part, books[p])
        np.add.at(count[p], entry, 1)
        for d in range(width):
            np.add.at(total[p, d], entry, part[d])
    return total, count


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _first(vectors: DataFrame, settings: Settings) -> np.ndarray | None:
    """The first codebooks; None without a vector that can be cut."""
    size = F.size("v")
    cut = vectors.where((size > 0) & (size % settings.parts == 0))
    order = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", size.alias("n"))
    length = cut.agg(F.min_by(size, order)).first()[0]
    if length is None:
        return None
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * settings.scale))
    seeds = vectors.where(size == length).select("vec_id", "v", whole.alias("i"))
    rows = seeds.orderBy(F.asc_nulls_last("vec_id"), "i").limit(settings.entries).select("v").toArrow()
    ints = integers(rows.column(0).combine_chunks(), length, settings.scale)
    return np.ascontiguousarray(ints.T.reshape(settings.parts, length // settings.parts, len(ints)))


def compress(vectors: DataFrame, settings: Settings = Settings()) -> Compressed | None:
    """The codes of all usable rows and the codebooks; None where no vector can be cut. vectors: vec_id, embedding, label and others."""
    context = vectors.sparkSession.sparkContext
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("v"))
    books = _first(rows, settings)
    if books is None:
        return None
    parts, width, _ = books.shape
    length, scale = parts * width, settings.scale

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ints = integers(batch.column(0).slice(at, BLOCK), length, scale)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(ints.T).tobytes()], pa.binary())], ["block"])

    columnar = rows.where(F.size("v") == length).select("v").mapInArrow(blocks, "block binary").rdd
    for _ in range(settings.rounds):
        sent = context.broadcast(books)
        total, count = columnar.treeAggregate(
            None, lambda acc, r: _add(acc, np.frombuffer(r[0], np.int64).reshape(length, -1), sent.value), _merge, depth=3
        )
        books = np.where(count[:, None, :] > 0, total // np.maximum(count, 1)[:, None, :], books)
        sent.unpersist()
    return Compressed(_coded(rows, books, scale), books)


def _coded(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    parts, width, _ = books.shape
    length = parts * width
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                fits = some.column("v").is_valid().to_numpy(zero_copy_only=False)
                ints = np.ascontiguousarray(integers(some.column("v").drop_null(), length, scale).T)
                found = [nearest(ints[p * width : (p + 1) * width], sent.value[p]) for p in range(parts)]
                codes, error = np.zeros((len(fits), parts), np.int32), np.zeros(len(fits), np.int64)
                codes[fits] = np.stack([f[0] for f in found], axis=1)
                error[fits] = sum(f[1] for f in found)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), parts, mask=pa.array(~fits))
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), lists.cast(pa.list_(pa.int32())), pa.array(error, mask=~fits)],
                    ["vec_id", "label", "code", "error"],
                )

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType().add("vec_id", kinds["vec_id"]).add("label", kinds["label"])
    schema = schema.add("code", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    shown = rows.select("vec_id", "label", F.when(F.size("v") == length, F.col("v")).alias("v"))
    return shown.mapInArrow(code, schema)


def decoded(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes (n, parts) stand for."""
    return np.concatenate([books[p][:, code[:, p]].T for p in range(len(books))], axis=1)


def digest(books: np.ndarray) -> str:
    """sha256 of all components, comma-joined, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    done = compress(vectors)
    if done is None:
        unfit = vectors.where(usable(F.col("embedding"))).select("vec_id", F.lit(None).cast("string").alias("code"))
        none = F.lit(None).cast("bigint")
        return unfit.select("*", none.alias("error"), none.alias("label_error"), F.lit(digest(np.zeros((1, 1, 0), np.int64))).alias("codebooks_sha256"))
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = durable(done.rows.select("vec_id", "label", hexed.alias("code"), "error"))
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    met = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(done.books)).alias("codebooks_sha256"))


SQL = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, len(embedding) // 16 AS w,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (
  SELECT rid, i // w AS part, i % w AS pos, x
  FROM (SELECT rid, w, unnest(v) AS x, unnest(range(len(v))) AS i FROM k)
), b0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, pos, x AS y FROM x WHERE rid <= 64
), a0 AS MATERIALIZED (
  SELECT rid, part, min(d * 64 + entry) % 64 AS entry
  FROM (SELECT rid, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN b0 USING (part, pos) GROUP BY ALL)
  GROUP BY rid, part
), b1 AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, y) AS y FROM b0 LEFT JOIN (
    SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM x JOIN a0 USING (rid, part) GROUP BY ALL
  ) USING (part, entry, pos)
), a1 AS MATERIALIZED (
  SELECT rid, part, min(d * 64 + entry) % 64 AS entry
  FROM (SELECT rid, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN b1 USING (part, pos) GROUP BY ALL)
  GROUP BY rid, part
), b2 AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, y) AS y FROM b1 LEFT JOIN (
    SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM x JOIN a1 USING (rid, part) GROUP BY ALL
  ) USING (part, entry, pos)
), a2 AS MATERIALIZED (
  SELECT rid, part, min(d * 64 + entry) AS both_
  FROM (SELECT rid, part, entry, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN b2 USING (part, pos) GROUP BY ALL)
  GROUP BY rid, part
), r AS (
  SELECT rid, string_agg(printf('%02x', both_ % 64), '' ORDER BY part) AS code, sum(both_ // 64)::BIGINT AS error FROM a2 GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM k JOIN r USING (rid)
"""
