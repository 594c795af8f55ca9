"""Substring dedup by hashing lines and sentences.

Units are the lines of a text and the sentences inside its lines (a sentence ends at a full stop,
exclamation or question mark before a space), where they have ``LEAST_WORDS`` words or more. A unit is normalised (lower
case, white space as one space) and hashed; equal digests are one passage anywhere in the
table. The occurrence with the smallest doc_id, and in that document the first, stays; all others go.
What goes is a set of spans of the original text, so nothing is lost but what the spans say.

Each digest's smallest doc_id is found with map-side aggregation, so a line in a third of all
documents is one row a task. Only digests that occur more than once are joined back, on rows without
text; AQE splits a hot digest there.

Defined results: a null or empty text has no units; a null doc_id ranks last, and units that only
documents without id have stay once in each; repeated rows (one id, one text) rank alike and give repeated
results; an empty table gives an empty result; other columns are kept by ``remove`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import WHITE, WORD, durable, let, replaced, running, shielded, whole

LEAST_WORDS = 8
SPANS = "array<struct<start:int,end:int>>"


def _pieces(text: Column) -> Column:
    """array<struct<start,end,piece>> of the pieces between line ends."""

    def placed(pieces: Column) -> Column:
        starts = running(F.transform(pieces, lambda p: F.length(p) + 1))
        every = F.zip_with(
            pieces, starts, lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("piece"))
        )
        return F.filter(every, lambda u: F.regexp_count(u["piece"], F.lit(WORD)) >= LEAST_WORDS)

    return let(F.split(text, "\n"), placed)


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, h, units): sorted array<struct<digest,start,end>> of every document."""
    digest = lambda x: F.unhex(F.md5(F.btrim(F.regexp_replace(F.lower(x), WHITE, " "))))
    texts = docs.select("doc_id", whole("text").alias("text"))
    both = F.concat(_pieces(F.col("text")), _pieces(F.regexp_replace("text", r"([.!?])\x20", "$1\n")))
    cut = F.transform(
        both, lambda u: F.struct(digest(u["piece"]).alias("digest"), u["start"].alias("start"), u["end"].alias("end"))
    )
    once = lambda units: F.filter(units, lambda u, i: (i == 0) | (u != F.get(units, i - 1)))  # noqa: E731  array_distinct compares all structs with all
    return texts.select("doc_id", F.xxhash64("text").alias("h"), let(F.sort_array(cut), once).alias("units"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_units, spans): spans to remove of every document, sorted and apart."""
    cut = durable(units(docs))  # digests and offsets only; three reads of them would cut every text three times
    rows = cut.select(
        "doc_id",
        "h",
        F.explode(
            F.transform(
                "units",
                lambda u, i: F.struct(
                    u["digest"].alias("digest"),
                    u["start"].alias("start"),
                    u["end"].alias("end"),
                    F.coalesce(F.get("units", i - 1)["digest"] == u["digest"], F.lit(False)).alias("again"),
                ),
            )
        ).alias("u"),
    ).select("doc_id", "h", "u.*")
    repeated = (
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("__digest"), "first_id")
    )
    goes = F.col("again") | (F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    gone = (
        rows.join(repeated, F.col("digest") == F.col("__digest"))
        .where(goes)
        .groupBy("doc_id", "h")
        .agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("back")))).alias("found"))
        .select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "found")
    )

    def apart(found: Column) -> Column:
        """Sentences inside a line that goes are part of it."""
        ends = running(F.transform(found, lambda s: -s["back"]), lambda a, e: F.greatest(a, e))
        every = F.zip_with(
            found, ends, lambda s, at: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), at.alias("at"))
        )
        free = F.filter(every, lambda s: s["start"] >= s["at"])
        return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    spans = F.when(F.col("found").isNull(), F.array().cast(SPANS)).otherwise(let(F.col("found"), apart))
    return cut.select("doc_id", "h", F.size("units").cast("long").alias("n_units")).join(
        gone, (F.col("h") == F.col("g_h")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left"
    ).select("doc_id", "h", "n_units", spans.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    return removals(docs).select(
        "doc_id",
        "n_units",
        F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("chars_removed"),
        F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
        ).alias("removed"),
    )


@shielded("doc_id", "text")
def remove(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, and removed: the spans in the original text."""
    found = removals(docs).select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "spans").dropDuplicates(["r_h", "r_id"])
    text = whole("text")
    rest = replaced(text, F.col("spans"), lambda n: F.lit(""))
    keyed = docs.withColumn("__h", F.xxhash64(text))
    met = keyed.join(found, (F.col("__h") == F.col("r_h")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    own = [
        F.when(F.size("spans") > 0, rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return met.select(*own, F.col("spans").alias("removed"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), both_ AS (
  SELECT rid, doc_id, string_split(text, chr(10)) AS pieces FROM d
  UNION ALL
  SELECT rid, doc_id, string_split(regexp_replace(text, '([.!?])\x20', '\1' || chr(10), 'g'), chr(10)) FROM d
), p AS (
  SELECT rid, doc_id, pieces, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM both_
), o AS (
  SELECT rid, doc_id, piece,
         (list_sum(list_transform(pieces[1:i], lambda x: length(x))) - length(piece) + i - 1)::BIGINT AS s
  FROM p WHERE len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) >= 8
), u AS (
  SELECT DISTINCT rid, doc_id, s, s + length(piece) AS e,
         trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM o
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS first_id,
         row_number() OVER (PARTITION BY norm, rid ORDER BY s, e) AS nth
  FROM u
), g AS (
  SELECT rid, s, e FROM f WHERE nth > 1 OR (first_id IS NOT NULL AND doc_id IS DISTINCT FROM first_id)
), a AS (
  SELECT * FROM (SELECT rid, s, e, coalesce(max(e) OVER (
    PARTITION BY rid ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM g)
  WHERE s >= covered
), r AS (
  SELECT rid, count(*) AS n_removed, sum(e - s) AS chars_removed,
         string_agg(s || ':' || e, ',' ORDER BY s) AS removed FROM a GROUP BY rid
), n AS (
  SELECT rid, count(*) AS n_units FROM u GROUP BY rid
)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(chars_removed, 0)::BIGINT AS chars_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN n USING (rid) LEFT JOIN r USING (rid)
"""
