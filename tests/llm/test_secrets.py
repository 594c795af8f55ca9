"""The randomness battery against plain loops, and the false-discovery control on ordinary and random tokens."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from ampflow.llm import secrets
from tests.llm.test_text import FOLDER


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def slow_battery(token, encoding):
    alphabet = secrets.ALPHABETS[encoding]
    token = token.lower() if encoding == "hex" else token.translate(str.maketrans("-_", "+/", "="))
    k, n = len(alphabet), len(token)
    codes = [alphabet.index(c) + 1 for c in token]
    chi = (sum(token.count(c) ** 2 for c in alphabet) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
    low, high = secrets.CLASSES[encoding]
    member = [low < c <= high for c in codes]
    runs = 1 + sum(a != b for a, b in zip(member, member[1:]))
    ones = sum(member)
    expected = 2 * ones * (n - ones) / n + 1
    deviation = math.sqrt(max(0.0, (expected - 1) * (expected - 2) / (n - 1)))
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    serial = (sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread + 1 / n) * math.sqrt(n) if spread else 30.0
    ps = [tail(chi), 2 * tail(abs((runs - expected) / deviation if deviation else 30.0)), 2 * tail(abs(serial))]
    cauchy = sum(math.tan((0.5 - min(max(p, 1e-12), 1 - 1e-12)) * math.pi) for p in ps)
    return 0.5 - math.atan(cauchy / 3) / math.pi


def test_battery_as_plain_loops(spark):
    rng = random.Random(4)
    rows = []
    for encoding, alphabet in secrets.ALPHABETS.items():
        for _ in range(60):
            rows.append((encoding, "".join(rng.choices(alphabet, k=rng.randint(20, 90)))))
            rows.append((encoding, "".join(rng.choices(alphabet[:9], k=rng.randint(20, 40)))))
    df = spark.createDataFrame(rows, "encoding string, token string")
    got = df.select("encoding", "token", secrets.p_random(F.col("token"), F.col("encoding")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(slow_battery(r.token, r.encoding), abs=1e-5)


def ordinary_tokens(spark, n):
    """Three words of the documents and a number each."""
    rng = random.Random(9)
    texts = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    words = sorted({w.lower() for t in texts for w in t.split() if w.isascii() and w.isalpha() and len(w) > 3})
    found = set()
    while len(found) < n:
        token = "".join(rng.choices(words, k=3)) + str(rng.randint(0, 9999))
        if len(token) >= 20:
            found.add(token)
    return sorted(found)


def called(spark, tokens):
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)], "doc_id long, text string")
    return {tokens[r.doc_id] for r in secrets.report(df).where("n_random > 0").collect()}


def test_ordinary_tokens_alone_are_left_alone(spark):
    tokens = ordinary_tokens(spark, 6000)
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    high = df.where(secrets.p_random(F.col("token"), F.lit("base36")) >= 0.5).count()
    assert len(called(spark, tokens)) <= 6, f"{high} of them have p >= 0.5"


@pytest.mark.parametrize("kind", ["base36", "base64", "base32", "hex"])
def test_planted_tokens_are_found_among_ordinary_ones(spark, kind):
    rng = random.Random(kind)
    alphabet = secrets.ALPHABETS[kind].upper() if kind == "hex" else secrets.ALPHABETS[kind]
    planted = set()
    while len(planted) < 1500:
        token = "".join(rng.choices(alphabet, k=rng.randint(20, 64)))
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            planted.add(token)
    ordinary = set(ordinary_tokens(spark, 1500))
    found = called(spark, sorted(planted | ordinary))
    assert len(found & ordinary) <= 0.05 * len(found)
    assert len(found & planted) >= 0.9 * len(planted)


def test_base_spans_hide_what_they_cover(spark):
    token = "".join(random.Random(2).choices(string.ascii_letters + string.digits, k=48))
    df = spark.createDataFrame([(1, f"api_key={token} and AKIA{'A1' * 9}")], "doc_id long, text string")
    assert secrets.report(df).select("n_assign", "n_access", "n_random").first() == (1, 1, 0)
