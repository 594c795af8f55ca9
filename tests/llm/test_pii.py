"""Precision and recall of the spans that weak supervision adds, on planted data; recall of toxicity on held-out rows."""

import random
import zlib

import pytest

from ampflow.llm import pii, toxicity

WORDS = "the of and to in is that it was for on are with as his they be at one have this from".split()
N = 2000


def digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def iban(rng, ok=True):
    body = digits(rng, 18)
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    return f"DE{check if ok else (check + 1) % 97:02d}{body}"


#: (what stands before, the span) of each kind; names in and out of the gazetteer, the latter behind a cue or a plain word.
PLANTED = {
    "ssn": lambda r: (r.choice(["ssn ", "social security number "]), f"{r.randint(100, 650)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
    "iban": lambda r: (r.choice(["iban ", "pay to account ", "konto "]), iban(r)),
    "phone": lambda r: (r.choice(["call ", "phone ", "tel "]), f"({r.randint(200, 989)}) {r.randint(200, 989)}-{digits(r, 4)}"),
    "email": lambda r: (r.choice(["mail ", "write to "]), f"bob.k{digits(r, 2)} at {r.choice(['acme', 'site'])}.{r.choice(['com', 'de'])}"),
    "name": lambda r: (
        r.choice(["signed by ", "regards ", "my name is ", "talked to "]),
        f"{r.choice(['Anna', 'Robert', 'Klaus', 'Kevin', 'Zbigniew'])} {r.choice(['Berg', 'Keller', 'Dupont', 'Moreno'])}",
    ),
}
DECOYS = [
    lambda r: ("version ", f"{digits(r, 3)}-{digits(r, 2)}-{digits(r, 4)}"),
    lambda r: ("part no ", f"{digits(r, 3)}-{digits(r, 2)}-{digits(r, 4)}"),
    lambda r: ("code ", iban(r, ok=False)),
    lambda r: ("order no ", f"{digits(r, 3)} {digits(r, 3)} {digits(r, 4)}"),
    lambda r: ("visit ", "New York"),
    lambda r: ("read ", "Great Expectations"),
    lambda r: ("meet ", "us at noon.today"),
]


def planted(rng):
    rows, truth = [], set()
    for i in range(N):
        text = " ".join(rng.choices(WORDS, k=8)) + " "
        for _ in range(3):
            kind = rng.choice(list(PLANTED)) if rng.random() < 0.5 else None
            before, value = (PLANTED[kind] if kind else rng.choice(DECOYS))(rng)
            if kind:
                truth.add((i, kind, len(text) + len(before), len(text) + len(before) + len(value)))
            text += f"{before}{value} {' '.join(rng.choices(WORDS, k=5))}. "
        rows.append((i, text))
    return rows, truth


@pytest.mark.parametrize("beside", [False, True])
def test_added_spans_on_planted_data(spark, beside):
    rows, truth = planted(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if beside:  # the votes of other documents must not spoil those of the planted ones
        df = df.union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr(f"doc_id + {N}", "text"))
    got = set()
    for r in pii.report(df).where(f"doc_id < {N} and spans <> ''").collect():
        for span in r.spans.split(","):
            kind, start, end = span.split(":")
            got.add((r.doc_id, kind, int(start), int(end)))
    for kind in PLANTED:
        wanted, found = ({x for x in s if x[1] == kind} for s in (truth, got))
        assert len(wanted & found) >= 0.9 * len(wanted) and len(wanted & found) >= 0.9 * len(found), kind


def test_expectation_maximisation_finds_the_reliable_labeler():
    """Two labelers that agree and a third that is noise: the posteriors follow the two."""
    rng, table = random.Random(2), {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        right = lambda p: (1 if truth else -1) * (1 if rng.random() < p else -1)  # noqa: B023, E731
        vote = (right(0.95), right(0.95), rng.choice([-1, 1]), right(0.9), 0)
        table[vote] = table.get(vote, 0) + 1
    post = pii.expectation_maximisation(table)
    for noise in (-1, 1):
        assert post[1, 1, noise, 1, 0] > 0.9 and post[-1, -1, noise, -1, 0] < 0.1


def test_toxic_documents_not_seen_are_recalled(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.report(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas()
    held = scores.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id) and len(held) > 500
    toxic = held.toxic == 1
    rank = held.score.rank()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert held[toxic].predicted.mean() >= 0.9 and area >= 0.93
