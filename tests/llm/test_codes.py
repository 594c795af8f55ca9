"""Vector codes against plain loops and SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from ampflow.llm import codes
from tests.compare import same

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, of string, error string"


def slow(rows, parts=16, entries=64, rounds=2):
    """{(vec_id, vector): (code, error)} of the rows that fit, and the codebooks' digest."""
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v]
    length = len(min(((i is None, i or 0, len(v)), v) for i, v in fit if len(v) % parts == 0)[1])
    fit = [(i, v) for i, v in fit if len(v) == length]
    w = length // parts
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v in first] for p in range(parts)]

    def nearest(x, book):
        found = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        for p, book in enumerate(books):
            met = [[] for _ in book]
            for _, v in fit:
                x = v[p * w : (p + 1) * w]
                met[nearest(x, book)[0]].append(x)
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(met, book)]
    out = []
    for i, v in fit:
        found = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def odd_vectors(n):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(32)], rng.choice([0, 1, 2, None])) for i in rng.sample(range(1000), n)]
    rows += rows[:3] + [(rows[0][0], [0.5] * 32, 1), (None, [0.25] * 32, None), (None, [0.25] * 32, None)]
    bad = [(7001, None, 1), (7002, [None] + [0.0] * 31, 1), (7003, [float("nan")] + [0.0] * 31, None), (7004, [float("-inf")] * 32, 2)]
    return rows, bad, [(7005, [1.0] * 16, 1), (7006, [1.0, 2.0], 5), (7007, [], None)]


@pytest.mark.parametrize("n", [20, 150])
def test_codes_as_plain_loops(spark, n):
    rows, bad, unfit = odd_vectors(n)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows + bad + unfit], SCHEMA).repartition(5)
    got = codes.report(df).collect()
    floats = [(i, None if v is None else np.float32(v).tolist()) for i, v, _ in rows]
    want, digest = slow(floats)
    assert sorted(((r.vec_id, r.code, r.error) for r in got if r.code), key=str) == sorted(want, key=str)
    assert {r.vec_id for r in got if r.code is None} == {7005, 7006, 7007}
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = {}
    for (_, _, label), (_, _, error) in zip(rows, want):
        by_label[label] = by_label.get(label, 0) + error
    labels = {r[0]: r[2] for r in rows + unfit}
    assert all(r.label_error == by_label.get(labels[r.vec_id]) for r in got if r.vec_id is not None and r.vec_id != rows[0][0])


def test_codes_as_sql_and_of_nothing(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    same(codes.report(vectors), codes.SQL, "/root/testdata/sf0.001")
    assert codes.report(vectors.where("false")).count() == 0
    assert codes.report(vectors.selectExpr("vec_id", "slice(embedding, 1, 5) AS embedding", "label")).where("code IS NULL").count() == vectors.count()


def test_huge_components_are_held_within_the_bound(spark):
    rows = [(i, [3e38 * (-1) ** i] * 16, 0) for i in range(70)]
    done = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert abs(done.books).max() == codes.limit(16)
    assert done.rows.where("error <> 0").count() == 0


def test_decoded_is_as_far_as_the_error_says(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 200")
    done = codes.compress(vectors)
    rows = done.rows.orderBy("vec_id").toPandas()
    exact = np.floor(256 * np.stack(vectors.orderBy("vec_id").toPandas().embedding).astype(float)).astype(np.int64)
    back = codes.decoded(np.stack(rows.code), done.books)
    assert ((exact - back) ** 2).sum(axis=1).tolist() == rows.error.tolist()
