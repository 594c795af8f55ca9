"""Quality classifier: supervised subword embeddings with a softmax output, trained in numpy.

Every word and its character 3- and 4-grams (with word ends) have learned vectors in hashed rows; a
document is the mean of its vectors, and a softmax over two classes follows. A few words of
another kind describe the shape of the text (length, share of distinct words and lines), with a fixed share of
the mean. Training is plain stochastic gradient descent over a bounded sample of the labelled
documents that may be learned from (``EACH`` of either class, whole texts); the classes' true sizes
set the bias afterwards.

The output is linear in the mean vector, so scoring needs one number for each hashed row:
those ``ROWS`` numbers (0.5 MB, whatever the input) go to the tasks, and each worker remembers the
sums of the words it has met.

Defined results: a null text counts as empty and still has a score, from its shape; a
null doc_id is not held out; without labels of both classes every score is 0.5; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.llm.samples import fold, training_texts

EACH = 3000
ROWS = 1 << 17
WIDTH = 8
EPOCHS = 4
RATE = 0.5
SHAPE = 0.3
#: A row's step is this many times its share of the mean, and never more than a whole step.
BOOST = 20.0
MEMO = 300_000


def rows_of(word: str) -> list[int]:
    """The hashed rows of a word and of its character 3- and 4-grams."""
    data = f"<{word}>".encode()
    grams = [data[i : i + n] for n in (3, 4) for i in range(len(data) - n + 1)]
    return [zlib.crc32(g) % ROWS for g in (data, *grams)]


def shape_rows(text: str, words: list[str]) -> list[int]:
    """The hashed rows of what describes the text as a whole."""
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    marks = [
        f"\0length {min(len(words), 1000).bit_length()}",
        f"\0distinct {10 * len(set(words)) // max(1, len(words))}",
        f"\0pairs {20 * pairs // max(1, len(words) - 1)}",
        f"\0lines {10 * len(set(lines)) // max(1, len(lines))}",
        f"\0upper {10 * sum(w.isupper() and len(w) > 1 for w in words) // max(1, len(words))}",
    ]
    return [zlib.crc32(m.encode()) % ROWS for m in marks]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and their weights in its mean."""
    words = text.split()
    own = [r for w in words for r in rows_of(w)]
    shape = shape_rows(text, words)
    share = SHAPE if own else 1.0
    every = np.array(own + shape)
    weight = np.concatenate([np.full(len(own), (1 - share) / max(1, len(own))), np.full(len(shape), share / len(shape))])
    rows, place = np.unique(every, return_inverse=True)
    return rows, np.bincount(place, weight)


def train(texts: pd.DataFrame, sizes: dict[int, int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number for each row, bias): the log odds of class 1 are the mean number plus the bias."""
    counts = texts["label"].value_counts().to_dict()
    if len(counts) < 2:
        return np.zeros(ROWS, np.float32), 0.0
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS, WIDTH))
    output = np.zeros((2, WIDTH))
    bias = np.zeros(2)
    cases = [(*features(t), int(y)) for t, y in zip(texts["text"], texts["label"])]
    weight = {k: len(cases) / (2 * n) for k, n in counts.items()}
    steps = EPOCHS * len(cases)
    for epoch in range(EPOCHS):
        for k, case in enumerate(random.permutation(len(cases))):
            rows, share, label = cases[case]
            rate = RATE * weight[label] * (1 - (epoch * len(cases) + k) / steps)
            own = vectors[rows]
            mean = share @ own
            odds = output @ mean + bias
            p = np.exp(odds - odds.max())
            error = p / p.sum()
            error[label] -= 1
            vectors[rows] = own - rate * np.minimum(1.0, BOOST * share)[:, None] * (error @ output)
            output -= rate * np.outer(error, mean)
            bias -= rate * error
    direction = output[1] - output[0]
    prior = math.log(sizes[1] / sizes[0])  # the sample's classes weigh the same
    return (vectors @ direction).astype(np.float32), float(bias[1] - bias[0] + prior)


def score(docs: DataFrame, numbers: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every document."""
    table = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = table.value.tolist()
        memo: dict[str, tuple[float, int]] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                words = text.split()
                for w in set(words):
                    if w not in memo:
                        rows = rows_of(w)
                        memo[w] = (sum([number[r] for r in rows]), len(rows))
                met = [memo[w] for w in words]
                n = sum([m[1] for m in met])
                shape = shape_rows(text, words)
                share = SHAPE if n else 1.0
                mean = share * sum([number[r] for r in shape]) / len(shape)
                if n:
                    mean += (1 - share) * sum([m[0] for m in met]) / n
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, mean + bias)))))
                if len(memo) > MEMO:
                    memo.clear()
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": out})

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("score", T.DoubleType())
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def report(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    held_out = lambda c: F.coalesce(fold(c, 3) == 1, F.lit(False))
    texts, sizes = training_texts(docs, labels, "quality", ~held_out(F.col("doc_id")), each)
    numbers, bias = train(texts, sizes)
    return score(docs, numbers, bias).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
