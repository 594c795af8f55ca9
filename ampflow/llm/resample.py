"""Importance resampling towards a target distribution, over hashed words and word pairs.

The features of a text are its words and its pairs of neighbouring words, each counted in the bucket that its crc32 gives.
A bucket's gain is the logarithm of how much likelier the target makes it than the corpus; a text's weight is the mean of
its features' gains. A document's score is its weight plus Gumbel noise drawn from its id, so that the highest
scores are a draw without replacement; reruns draw the same.

Identical texts collapse first: the table is grouped by the full text, with counts, so a text that a third of the rows
repeat costs each task one row. What a distinct text needs later (its digest, words, buckets) is cut once and stored in the
shared folder. The corpus counts are then sums of buckets times copies, of ``BUCKETS`` numbers in each task; weights are
computed once for each distinct text and join back to the documents by the text's digest (sha256). Only
then comes what differs between copies, the noise of their ids.

Ranks come from ranges of scores and the ranges' totals (``sums_before``), no single sort. Rows that are equal in id, weight and
features are one row with a count there, so repeated rows do not pile up in one range.

Defined results: a null text counts as empty; a text without words has no features and weight 0; the noise of a null id is that
of an empty id text, and a null id comes last among equal scores; of rows equal in score and id the one with fewer features, then
of the smaller weight, comes first, and repeated rows take ranks one after the other; an empty target leaves all t at 0; an empty
table gives an empty result. Other columns, whatever their names, are kept by ``draw`` and left alone by ``report``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import durable, free, pieces_of, stored, sums_before, whole

BUCKETS = 10_000


@dataclass(frozen=True)
class Settings:
    """What is drawn: percent of the documents with at least ``least_words`` words; seed begins the noise's text."""

    percent: int = 25
    least_words: int = 20
    seed: int = 7


#: Upper case to lower case, and all other ASCII characters but digits and letters to a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Buckets that leave a task at once.
_FLUSH = 1 << 21


def features(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words and the buckets (uint16) of all words and word pairs, repeats included."""
    last, n, found = None, 0, []
    for piece in pieces_of((text or "").encode().translate(_CLEAN)):
        words = piece.split()
        if not words:
            continue
        own = [crc32(w) for w in words]
        before = own[:-1] if last is None else [last, *own[:-1]]
        after = words[1:] if last is None else words
        # crc32 goes on from the state after the first word
        found += [own, [crc32(b" " + w, c) for w, c in zip(after, before)]]
        last, n = own[-1], n + len(words)
    if not n:
        return 0, np.zeros(0, np.uint16)
    return n, np.concatenate([np.array(x, np.int64) % BUCKETS for x in found]).astype(np.uint16)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, digest, copies) to (digest, copies, n_words, buckets)."""

    def out(rows: pa.RecordBatch, words: list, buckets: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, buckets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate(buckets).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [rows.column("digest"), rows.column("copies"), pa.array(words, pa.int64()), lists], ["digest", "copies", "n_words", "buckets"]
        )

    for batch in batches:
        begin, held, words, buckets = 0, 0, [], []
        texts = batch.column("text")
        for i in range(batch.num_rows):
            n, found = features(texts[i].as_py())
            words.append(n)
            buckets.append(found)
            held += len(found)
            if held > _FLUSH:
                yield out(batch.slice(begin, i + 1 - begin), words, buckets)
                begin, held, words, buckets = i + 1, 0, [], []
        if words:
            yield out(batch.slice(begin), words, buckets)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_FLUSH`` buckets."""
    ends = batch.column("buckets").offsets.to_numpy()
    cuts = (np.flatnonzero(np.diff((ends[1:] - ends[0]) // _FLUSH)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def collapsed(texts: DataFrame) -> DataFrame:
    """(digest, copies, n_words, buckets) of each distinct text."""
    every = texts.select(whole("text").alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = every.select("text", digest(F.col("text")).alias("digest"), "copies")
    return stored(keyed.mapInArrow(_cut, "digest binary, copies bigint, n_words bigint, buckets array<int>"), "resample")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_counts(distinct: DataFrame) -> np.ndarray:
    """How often each bucket stands in all texts, copies included; int64."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in (part for whole_batch in batches for part in _parts(whole_batch)):
            lists, copies = batch.column("buckets"), batch.column("copies").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            of = np.repeat(copies, sizes)
            np.add.at(total, lists.flatten().to_numpy(), of)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    parts = distinct.select("copies", "buckets").mapInArrow(count, "bucket int, n bigint")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    found = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        found[bucket] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the likelihood ratio) of each bucket, with one occurrence added to each."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = [float(t + 1) * all_s / (float(s + 1) * all_t) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(distinct: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of each distinct text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in _parts(whole_batch)):
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy()
            first = ends[0]
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            n = np.diff(ends).astype(np.int64)
            total = sums[ends[1:] - first] - sums[ends[:-1] - first]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("n_words"), pa.array(n), pa.array(weight)],
                ["digest", "n_words", "n_features", "weight"],
            )

    return distinct.select("digest", "n_words", "buckets").mapInArrow(
        weigh, "digest binary, n_words bigint, n_features bigint, weight bigint"
    )


def _score(weight: Column, doc_id: Column, seed: int) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, and the digest of the text) of every document."""
    distinct = collapsed(docs)
    gain = gains(bucket_counts(distinct), bucket_counts(collapsed(target)))
    found = weights(distinct, gain).withColumnRenamed("digest", "of")
    ids = docs.select("doc_id", digest(whole("text")).alias("digest"))
    score = _score(F.col("weight"), F.col("doc_id"), settings.seed).alias("score")
    return ids.join(found, F.col("digest") == F.col("of")).select("doc_id", "digest", "n_words", "n_features", "weight", score)


def _order() -> Column:
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), "doc_id", "n_features", "weight")


def _ranked(rows: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """Rows of equal values once, with their copies and how many rows come before, and how many rows are drawn."""
    enough = F.col("n_words") >= settings.least_words
    same = rows.groupBy("doc_id", "n_features", "weight", "score", enough.alias("enough")).agg(F.count("*").alias("copies"))
    same = durable(same)
    n = same.where("enough").agg(F.sum("copies")).first()[0] or 0
    before = sums_before(same, _order(), {"before": F.col("copies")}, last=~F.col("enough"))
    return before, n * settings.percent // 100


def report(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the rank of one that is not drawn is null."""
    ranked, drawn = _ranked(scored(docs, target, settings), settings)
    spread = ranked.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("nth"))
    place = F.col("before") + F.col("nth")
    return spread.select("doc_id", "n_features", "weight", "score", F.when(F.col("enough") & (place <= drawn), place).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents drawn, with their own columns.

    They are those before the place where the ranks end; of the rows equal in score, id, features and weight at that place, as many
    as the ranks still take.
    """
    rows = durable(scored(docs, target, settings))
    ranked, drawn = _ranked(rows, settings)
    end = ranked.where(F.col("enough") & (F.col("before") < drawn)).orderBy(F.desc("before")).first()
    own = [F.col(f"`{c}`") for c in docs.columns]
    if end is None:
        return docs.select(*own).limit(0)
    key, of = free(docs, "__key", "__of")
    keyed = docs.select(*own, F.struct("doc_id", digest(whole("text"))).alias(key))
    at = F.struct(*[F.lit(v).cast(kind) for v, kind in (
        (-end.score, "bigint"), (end.doc_id is None, "boolean"), (end.doc_id, rows.schema["doc_id"].dataType), (end.n_features, "bigint"), (end.weight, "bigint")
    )])
    chosen = rows.where(F.col("n_words") >= settings.least_words).select(F.struct("doc_id", "digest").alias(of), _order().alias("o"))
    pick = lambda held: keyed.join(chosen.where(held).select(of).distinct(), F.col(key).eqNullSafe(F.col(of)), "left_semi").select(*own)
    return pick(F.col("o") < at).unionAll(pick(F.col("o") == at).limit(drawn - end.before))


SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))
), texts AS (
  SELECT row_number() OVER () AS rid, doc_id, true AS own, coalesce(text, '') AS text FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, false, coalesce(text, '') FROM benchmark
), words AS MATERIALIZED (
  SELECT rid, doc_id, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), f AS MATERIALIZED (
  SELECT rid, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words
), hexed AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)
), bytes AS (
  SELECT feature, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hexed
), bucketed AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
                                  lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, tab
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN bucketed USING (feature) GROUP BY bucket)
), m AS (
  SELECT rid, count(*)::BIGINT AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN bucketed USING (feature) JOIN g USING (bucket) WHERE own GROUP BY rid
), d AS (
  SELECT doc_id, len(w) >= 20 AS enough, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN m USING (rid) WHERE own
), scores AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id, n_features, weight) AS r,
         count(*) OVER (PARTITION BY enough) AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""
