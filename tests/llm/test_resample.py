"""Importance resampling against plain loops and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from ampflow.llm import resample
from ampflow.llm.common import pieces_of
from tests.compare import same
from tests.llm.test_text import SCHEMA, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


def slow_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def slow(rows, target):
    """[(doc_id, n_features, weight, score, rank)] of rows (doc_id, text)."""
    cut = [slow_features(t) for _, t in rows]
    s, t = Counter(b for _, f in cut for b in f), Counter(b for x in target for b in slow_features(x)[1])
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s) / (float(s[b] + 1) * float(all_t))))
    found = []
    for (i, _), (words, f) in zip(rows, cut):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    order = sorted((r for r in found if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(order[: 25 * len(order) // 100])]
    return drawn + [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in found if not r[4]]


@pytest.fixture(scope="module")
def many(spark):
    rows = odd_rows()
    rows += [(100 + i, "Some text of more than twenty words, " * 3 + f"and number {i % 7}.", "en", "s", 1) for i in range(40)]
    return spark.createDataFrame(rows + [rows[-1]] * 5 + [(None, *rows[-2][1:])] * 3, SCHEMA).selectExpr("*", "'x' AS digest", "1 AS weight", "2 AS copies")


def test_scores_and_ranks_as_plain_loops(spark, many):
    target = spark.createDataFrame([("number 3 and some other words",), (None,), ("number 3 and some other words",)], "text string")
    rows = [(r.doc_id, r.text) for r in many.select("doc_id", "text").collect()]
    want = slow(rows, [r.text for r in target.collect()])
    got = [tuple(r) for r in resample.report(many.repartition(5), target).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    drawn = resample.draw(many.withColumnRenamed("digest", "__key"), target)
    assert drawn.columns == ["__key" if c == "digest" else c for c in many.columns]
    ids = sorted((r.doc_id for r in drawn.collect()), key=str)
    assert ids == sorted((r[0] for r in want if r[4]), key=str)


def test_resampling_as_sql(spark):
    docs, target = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    same(resample.report(docs, target), resample.SQL, FOLDER)


def test_resampling_of_nothing_and_towards_nothing(spark, many):
    empty = many.where("false")
    assert resample.report(empty, many).count() == 0 and resample.draw(empty, many).count() == 0
    rows = [(r.doc_id, r.text) for r in many.select("doc_id", "text").collect()]
    assert sorted(map(tuple, resample.report(many, empty).collect()), key=str) == sorted(slow(rows, []), key=str)


def test_a_text_in_pieces_has_the_features_of_the_whole(monkeypatch):
    text = "One two, THREE ! four-five  é six " * 50 + "x" * 900 + " end"
    n, whole = resample.features(text)
    monkeypatch.setattr(resample, "pieces_of", lambda b: pieces_of(b, 37))
    again, parts = resample.features(text)
    words, plain = slow_features(text)
    assert (n, sorted(whole)) == (again, sorted(parts)) == (len(words), sorted(plain))
