"""The join of word shingles against brute force over all pairs, and the bounds it rests on."""

import random
import re

import numpy as np
import pytest

from ampflow.llm import ngram_join as ng
from tests.compare import same
from tests.llm.test_text import FOLDER, SCHEMA, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def slow(rows):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs of unlike sets."""
    sets = [slow_set(t) for _, t in rows]
    distinct = list(dict.fromkeys(s for s in sets if s))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if 100 * len(a & b) >= 85 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return [(i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets)]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Chains of edits of texts of all lengths, many edits of one text, texts that share a passage, odd rows."""
    rng = random.Random(11)
    found = [r[:2] for r in odd_rows()]
    for n in [*range(1, 40), 60, 100, 150, 250, 400, 900]:
        words = [f"w{rng.randrange(300)}" for _ in range(n)]
        found += [(len(found) + 100, edited(rng, words, k * n // 160)) for k in range(6)]
    base = [f"b{i}" for i in range(120)]
    found += [(len(found) + 100, edited(rng, base, rng.randrange(1, 6))) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(25))
    found += [(len(found) + 100, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 9)))) for _ in range(60)]
    rng.shuffle(found)
    return found + [found[0], (None, found[40][1]), (None, "only text without an id of this kind here")]


@pytest.mark.parametrize("block", [ng.BLOCK, 7])
def test_classes_as_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(ng, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).selectExpr("*", "'x' AS sid", "'x' AS n", "'x' AS `keys`", "'x' AS slot", "'x' AS root")
    got = [tuple(r) for r in ng.report(df.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_classes_of_nothing_and_of_blanks(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, None), (2, ""), (2, " \n"), (None, None)]], SCHEMA)
    assert ng.report(df.where("false")).count() == 0
    assert sorted(map(tuple, ng.report(df).collect()), key=str) == [(1, 0, 1), (2, 0, 2), (2, 0, 2), (None, 0, None)]


def test_linked_sets_share_keys_and_sketches_bound_their_difference():
    rng = np.random.default_rng(3)
    for n in [*range(6, 60), 100, 333, 1000, 5000]:
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            size = rng.integers(max(6, -(-85 * n // 100)), n + 1)
            common = rng.integers(1, min(size, n) + 1)
            if rng.random() < 0.7:  # as few in common as a link needs
                common = -(-85 * (size + n) // 185)
            if common > size:
                continue
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + size - common]]))
            differ = n + size - 2 * common
            x, y = (np.frombuffer(ng.sketch_of(s), np.uint64) for s in (a, b))
            k = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(s.reshape(-1, k), axis=0) for s in (x, y))
            assert np.bitwise_count(x ^ y).sum() <= differ
            if 100 * common >= 85 * (n + size - common):
                assert differ <= ng.apart(n, size)
                assert differ == 0 or len(np.intersect1d(ng.keys_of(a), ng.keys_of(b))) >= ng.SLACK


def test_a_text_in_pieces_has_the_same_set(monkeypatch):
    text = "One two\tTHREE  four five é six " * 40 + "y" * 500 + " end"
    whole, pieces = ng.shingles(text), ng.pieces_of
    monkeypatch.setattr(ng, "pieces_of", lambda b: pieces(b, 23))
    assert ng.shingles(text).tolist() == whole.tolist()
    assert len(whole) == len(slow_set(text))


def test_classes_as_sql(spark):
    same(ng.report(spark.read.parquet(f"{FOLDER}/documents.parquet")), ng.SQL, FOLDER)
