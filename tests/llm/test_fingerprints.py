"""Fingerprints and likenesses against plain loops, odd and repeated rows included."""

import hashlib
import re
import struct

import pytest
import xxhash

from ampflow.llm import sketch
from tests.llm.test_text import docs, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1
signed = lambda h: h - (1 << 64) if h >> 63 else h
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def hashes(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text)]
    out = []
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
        out.append(signed(h))
    return out


def sketched(text):
    every = hashes(text)
    return sorted({h for h in every if h < sketch.BELOW} or set(every))


def share(a, b, b_text):
    if not a:
        return 0.0 if b else 1.0
    other = set(hashes(b_text)) if a[0] >= sketch.BELOW else set(b)
    return len(set(a) & other) / len(a)


def slow(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))
    places = sorted({key(r): r for r in rows}.items(), reverse=True)
    out = {}
    for k, (at, (doc_id, text)) in enumerate(places):
        follows = places[(k + 1) % len(places)][1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        own, new, other = sketched(text), sketched(edited), sketched(follows)
        hexed = lambda s: "".join(f"{h & MASK:016x}" for h in s)
        out[at] = (
            doc_id, len(text), sha(edited), hexed(own), hexed(new), share(own, new, edited), share(own, other, follows),
            share(new, own, text), share(other, own, text),
        )
    return sorted((out[key(r)] for r in rows), key=repr)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_fingerprints_as_plain_loops(request, which):
    df = request.getfixturevalue(which)
    want = slow([(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in sketch.report(df).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_few_rows_and_very_many_buckets(spark):
    for n in (1, 2, 5):
        rows = [(i, f"text number {i} of a few") for i in range(n)]
        got = sketch.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((tuple(r) for r in got), key=repr) == slow(rows)


def test_texts_move_once(spark):
    df = spark.createDataFrame([(i, f"a text {i}") for i in range(50)], "doc_id long, text string")
    plan = sketch.report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
