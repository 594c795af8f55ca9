"""Quality rules as a short-circuit cascade (built-in expressions only).

Base counts are exact for every document. The remaining rules form a cascade: a sample of about ``SAMPLE``
documents gives how many each rule rejects, and a timed run of each rule over the sample, less that of
a run without a rule, gives its cost; the rules run in the order of rejections per second. A CASE expression stops at the
first rule that rejects, so later and dearer rules run only on documents that are still in. The
order changes the work and the name of the rejecting rule, never the verdict; so noise in the times is harmless.

Defined results: a null text counts as empty (0 words, base_failed true); a null doc_id is
an ordinary row; repeated rows give repeated results; an empty table gives an empty result;
other columns, whatever their names, pass through ``keep_good`` and are dropped by ``report``; ``judge`` keeps those that don't begin with ``__q_``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import WORD, durable, shielded, whole

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
PREFIX = "__q_"
#: About so many documents go into the sample for the cascade; TIMED runs of each rule, of which the fastest counts.
SAMPLE, TIMED = 2000, 2


@dataclass(frozen=True)
class Rule:
    """reject: condition on the text and the base counts."""

    name: str
    reject: Column


def _c(name: str) -> Column:
    return F.col(PREFIX + name)


def rules() -> list[Rule]:
    """The rules after the base ones. Each compares whole numbers, so that any engine agrees."""
    upper = F.regexp_count(_c("text"), F.lit(r"\p{Lu}"))
    lower = F.regexp_count(_c("text"), F.lit(r"\p{Ll}"))
    digits = F.regexp_count(_c("text"), F.lit(r"[0-9]"))
    shouts = F.regexp_count(_c("text"), F.lit(r"!!"))
    return [
        Rule("symbols", _c("n_symbols") * 100 > _c("n_words") * 30),
        Rule("duplicate_lines", _c("n_dup_lines") * 100 > _c("n_lines") * 30),
        Rule("word_length", (_c("word_chars") < _c("n_words") * 2) | (_c("word_chars") > _c("n_words") * 20)),
        Rule("shouting", shouts * 100 > _c("n_words") * 30),
        Rule("upper_case", upper > lower),
        Rule("digits", digits * 100 > _c("word_chars") * 50),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """The documents with the base counts, under prefixed names."""
    kept = docs.columns
    first = docs.select(*[F.col(f"`{c}`") for c in kept], whole("text").alias(PREFIX + "text"))
    split = first.select(
        "*",
        F.regexp_extract_all(_c("text"), F.lit(WORD), F.lit(0)).alias(PREFIX + "words"),
        F.filter(F.split(_c("text"), "\n"), lambda x: F.regexp_like(x, F.lit(WORD))).alias(PREFIX + "lines"),
    )
    hashed = split.select(
        *[F.col(f"`{c}`") for c in kept],
        _c("text"),
        F.size(_c("words")).cast("long").alias(PREFIX + "n_words"),
        F.length(F.array_join(_c("words"), "")).cast("long").alias(PREFIX + "word_chars"),
        F.regexp_count(_c("text"), F.lit(SYMBOLS)).cast("long").alias(PREFIX + "n_symbols"),
        F.size(_c("lines")).cast("long").alias(PREFIX + "n_lines"),
        (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long").alias(PREFIX + "n_dup_lines"),
        F.transform(_c("words"), lambda w: F.xxhash64(w)).alias(PREFIX + "hashes"),
    )
    held = [c for c in hashed.columns if c != PREFIX + "hashes"]
    no_longs = F.array().cast("array<bigint>")
    windows = hashed.select(
        *[F.col(f"`{c}`") for c in held],
        F.when(
            F.size(_c("hashes")) > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size(_c("hashes")) - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(_c("hashes"), i, WINDOW)),
            ),
        )
        .otherwise(no_longs)
        .alias(PREFIX + "windows"),
    )
    ordered = windows.select(
        *[F.col(f"`{c}`") for c in held],
        F.when(
            F.size(F.array_distinct(_c("windows"))) < F.size(_c("windows")),
            F.sort_array(F.transform(_c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias(PREFIX + "ordered"),
    )
    same = lambda x, k: F.coalesce(F.get(_c("ordered"), k)["h"] == x["h"], F.lit(False))
    places = ordered.select(
        *[F.col(f"`{c}`") for c in held],
        F.sort_array(
            F.filter(
                F.transform(
                    _c("ordered"),
                    lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias(PREFIX + "places"),
    )
    covered = F.aggregate(
        F.transform(
            _c("places"),
            lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(_c("places"), k + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return places.select(*[F.col(f"`{c}`") for c in held], covered.alias(PREFIX + "n_repeat_words"))


def base_failed() -> Column:
    return (_c("n_words") < 10) | (_c("n_repeat_words") * 100 > _c("n_words") * 20)


def cascade(docs: DataFrame, one_in: int | None = None) -> list[Rule]:
    """The rules in the order of rejections per second, as estimated on one document in ``one_in``.

    The sample is chosen by a hash of the id and the text, so that copies of a text do not come together; without
    one_in it has about SAMPLE documents, whatever the table. Rules that reject nothing there come last, the cheap ones first.
    """
    every = rules()
    if one_in is None:
        one_in = max(1, docs.count() // SAMPLE)
    drawn = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0)
    held = measured(drawn.limit(4 * SAMPLE))
    sample = durable(held.select(*[c for c in held.columns if c.startswith(PREFIX)], base_failed().alias(PREFIX + "out")).coalesce(1))
    # Not a filter, which would not be counted among the rule's work alike.
    rejects = lambda rule: F.count_if(~_c("out") & rule.reject)

    def timed(*columns: Column) -> tuple[int, float]:
        took = []
        for _ in range(TIMED):
            began = time.perf_counter()
            found = sample.agg(F.sum(F.length(_c("text"))), *columns).first()
            took.append(time.perf_counter() - began)
        return found[-1] or 0, min(took)

    _, without = timed()
    measures = {r.name: timed(rejects(r)) for r in every}
    cost = {name: max(took - without, 1e-4) for name, (_, took) in measures.items()}
    return sorted(every, key=lambda r: (-measures[r.name][0] / cost[r.name], cost[r.name], r.name))


def judge(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The documents' own columns and __q_n_words ... __q_rule, __q_kept."""
    order = cascade(docs) if order is None else order
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.reject, F.lit(rule.name))
    judged = measured(docs).select("*", verdict.alias(PREFIX + "rule"))
    return judged.select("*", _c("rule").isNull().alias(PREFIX + "kept"))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id",
        _c("n_words").alias("n_words"),
        _c("word_chars").alias("word_chars"),
        _c("n_symbols").alias("n_symbols"),
        _c("n_dup_lines").alias("n_dup_lines"),
        _c("n_repeat_words").alias("n_repeat_words"),
        base_failed().alias("base_failed"),
        _c("kept").alias("kept"),
    )


@shielded("doc_id", "text")
def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    The verdict passes through an explode, below which no filter is pushed: else the filter would
    repeat the expressions of all counts.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    return judge(docs).select(*own, F.explode(F.array(_c("kept"))).alias(PREFIX + "in")).where(_c("in")).select(*own)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)
), r AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1)
  GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, text, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper_chars,
         length(regexp_replace(text, '[^\p{Ll}]', '', 'g')) AS lower_chars,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit_chars,
         len(regexp_extract_all(text, '!!')) AS shouts
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 100 > n_words * 30 OR n_dup_lines * 100 > n_lines * 30
            OR word_chars < n_words * 2 OR word_chars > n_words * 20 OR shouts * 100 > n_words * 30
            OR upper_chars > lower_chars OR digit_chars * 100 > word_chars * 50) AS kept
FROM b
"""
