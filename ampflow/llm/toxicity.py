"""Toxicity behind disguises: a noisy channel restores the text, then restored words are scored.

Channel: a suspicious token (look-alike symbols before letters, a character three times or more in a row, or
single letters with spaces between them) becomes a lattice of characters. Each symbol may
stand for itself or for the letters it looks like, a repeat may be dropped, and a mark
inside a word may be dropped, each at a cost. Viterbi decoding finds the cheapest reading under
a character trigram model of the words of the training texts; a state is the last two characters. Tokens of
any length are decoded whole: the time grows with their characters, and the states are bounded by the channel.

Score: a word's evidence is the strongest of the word itself and its prefixes, each the
logarithm of a lower bound on the odds of its toxic documents against its clean ones. The document's evidence is the largest of
its words and the second largest; a logistic function calibrates both, for
each half of the texts by evidence that was counted in the other half. All labelled texts that are not held out are learned from, in the tasks; the
model keeps the ``KEPT`` strongest words and prefixes.

Defined results: a null text counts as empty and has the score of no evidence; a null doc_id is not
held out; without labels of both classes every score is 0; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.llm.samples import fold

KEPT = 50_000
MEMO = 300_000
#: Toxic documents that a key needs to be evidence; bits of a sieve at most (8 MB); points that one task takes through a step.
LEAST, BITS, POINTS = 3, 1 << 26, 250_000
PREFIXES = range(3, 9)
MARKS = string.punctuation + "«»„“”‘’…–—"

#: Marks before a word that stand for no letter.
OUTSIDE = "".join(c for c in MARKS if c not in "@$!|+(")

#: Letters that a symbol may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
DROPPED = "*.-_~'^ "
SYMBOL = re.compile(r"[0-9@$!|+€£(*._~^-]")
REPEAT = re.compile(r"(.)\1\1", re.S)
#: Characters after which the readings of a long token are put away in a chain that they share.
LINK = 64
LETTER = re.compile(r"[^\W\d_]")
SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\S)")
#: Costs of the channel, as negative logarithms.
LOOK, DROP_MARK, DROP_REPEAT, KEEP_SYMBOL = 1.5, 1.0, 0.7, 6.0


class Letters:
    """A character trigram model, interpolated with bigrams and letters."""

    def __init__(self, counts: Counter):
        self.costs: dict[tuple[str, str, str], float] = {}
        self.pairs, self.singles, self.context1, self.context2 = Counter(), Counter(), Counter(), Counter()
        self.triples = counts
        for (a, b, c), n in counts.items():
            self.pairs[b, c] += n
            self.singles[c] += n
            self.context1[b] += n
            self.context2[a, b] += n
        self.total = max(1, self.singles.total())

    @classmethod
    def of(cls, words: Counter) -> Letters:
        counts: Counter = Counter()
        for word, n in words.items():
            padded = "  " + word + " "
            for t in zip(padded, padded[1:], padded[2:]):
                counts[t] += n
        return cls(counts)

    def cost(self, a: str, b: str, c: str) -> float:
        found = self.costs.get((a, b, c))
        if found is None:
            if len(self.costs) > MEMO:
                self.costs.clear()
            found = self.costs[a, b, c] = self._cost(a, b, c)
        return found

    def _cost(self, a: str, b: str, c: str) -> float:
        p = 0.01 / 256 + 0.09 * self.singles[c] / self.total
        if self.context1[b]:
            p += 0.3 * self.pairs[b, c] / self.context1[b]
        if self.context2[a, b]:
            p += 0.6 * self.triples[a, b, c] / self.context2[a, b]
        return -math.log(p)


def restore(token: str, letters: Letters) -> str:
    """The cheapest reading of a token."""
    # By state: cost, a chain of the pieces before, and the characters since.
    best: dict[str, tuple[float, tuple | None, str]] = {"  ": (0.0, None, "")}
    for i, seen in enumerate(token):
        options = [(seen, 0.0 if LETTER.match(seen) else KEEP_SYMBOL)]
        options += [(c, LOOK) for c in LOOKS_LIKE.get(seen, "")]
        if seen in DROPPED:
            options.append(("", DROP_MARK))
        if i and token[i - 1] == seen:
            options.append(("", DROP_REPEAT))
        step: dict[str, tuple[float, tuple | None, str]] = {}
        for state, (cost, chain, text) in best.items():
            for char, extra in options:
                now = cost + extra + (letters.cost(state[0], state[1], char) if char else 0.0)
                to = state[1] + char if char else state
                if to not in step or now < step[to][0]:
                    step[to] = (now, chain, text + char)
        best = step if (i + 1) % LINK else {s: (cost, (chain, text), "") for s, (cost, chain, text) in step.items()}
    ends = [(cost + letters.cost(s[0], s[1], " "), chain, text) for s, (cost, chain, text) in best.items()]
    least = min(e[0] for e in ends)
    return min(_reading(chain, text) for cost, chain, text in ends if cost == least)


def _reading(chain: tuple | None, text: str) -> str:
    parts = [text]
    while chain is not None:
        chain, part = chain
        parts.append(part)
    return "".join(reversed(parts))


def tokens(text: str) -> set[str]:
    """The distinct lower-case words of a text; runs of spaced letters become one word besides."""
    text = text.lower()
    found = set(text.split())
    if SPACED.search(text):
        found |= {m.group().replace(" ", "") for m in SPACED.finditer(text)}
    return found


def suspicious(core: str) -> bool:
    """Whether a symbol stands before some letter, or a character three times or more in a row."""
    if not LETTER.search(core):
        return False
    first = SYMBOL.search(core)
    return bool(first and LETTER.search(core, first.end())) or bool(REPEAT.search(core))


def restored(token: str, letters: Letters) -> str:
    """The word inside a token: without marks around it, and read through the channel if it is suspicious."""
    if token.isalpha() and not REPEAT.search(token):  # as most words are
        return token
    core = token.lstrip(OUTSIDE).rstrip(MARKS)
    if suspicious(core):
        core = restore(core, letters)
    return core.strip(MARKS)


def keys(word: str) -> list[str]:
    """A word and its prefixes."""
    return [word + " ", *[word[:n] for n in PREFIXES if len(word) >= n]]


@dataclass
class Model:
    letters: Letters
    weights: dict[str, float]
    curve: tuple[float, ...]

    def __post_init__(self):
        self.heads = {k[:3] for k in self.weights}

    def evidence(self, word: str) -> float:
        if (word + " ")[:3] not in self.heads:  # all keys of a word begin alike
            return 0.0
        get = self.weights.get
        return max([get(k, 0.0) for k in keys(word)])

    def score(self, first: float, second: float) -> float:
        odds = sum(a * x for a, x in zip(self.curve, _terms(first, second)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _top(values: list[float]) -> tuple[float, float]:
    high = sorted(values, reverse=True)[:2] + [0.0, 0.0]
    return high[0], high[1]


def _terms(first: float, second: float) -> tuple[float, ...]:
    """What the logistic function sees; the squares let strong evidence count more than in proportion."""
    return 1.0, first, first * first / 4, second, second * second / 4


def _sieve(rows: DataFrame, key: Column) -> np.ndarray:
    """Bits, at most ``BITS``, of which those at the keys' crc32 are set: what it lets through is all that is among the keys, and a little more."""
    size = min(BITS, 1 << max(10, (16 * rows.count()).bit_length()))
    at = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(size))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("int"), F.pmod("at", F.lit(8)).cast("int")))
    found = rows.select(at.alias("at")).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(bits.alias("bits")).toPandas()
    out = np.zeros(size // 8, np.uint8)
    out[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def _passes(bits: np.ndarray, crc: int | np.ndarray) -> int | np.ndarray:
    at = crc % (8 * len(bits))
    return bits[at >> 3] >> (at & 7) & 1


def _tokenised(batches: Iterator[pd.DataFrame], sieve=None) -> Iterator[pd.DataFrame]:
    """The other columns, low and words: the distinct words, with spaces between, and the three lowest of their hashes."""
    for batch in batches:
        if sieve is not None:
            batch = batch[_passes(sieve.value, batch.pop("crc").to_numpy(np.int64)) == 1]
        if batch.empty:
            continue
        words = [sorted(tokens(t)) for t in batch.pop("text")]
        lows = [",".join(map(str, sorted(zlib.crc32(w.encode()) for w in own)[:3])) for own in words]
        yield batch.assign(low=lows, words=[" ".join(own) for own in words])


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    for batch in batches:
        for own in batch["words"]:
            words.update(own.split())
            if len(words) > MEMO:
                yield _counted(words)
                words.clear()
    yield _counted(words)


def _counted(words: Counter) -> pd.DataFrame:
    triples = Letters.of(Counter({w: n for w, n in words.items() if w.isalpha()})).triples
    return pd.DataFrame({"t": pd.Series(["".join(t) for t in triples], dtype=object), "n": pd.Series(list(triples.values()), dtype="int64")})


def _key_counts(batches: Iterator[pd.DataFrame], sieve=None) -> Iterator[pd.DataFrame]:
    """(key, n, n_half): documents of a task that hold a key, of those that the sieve lets through."""
    seen: dict[str, list[int]] = {}
    memo: dict[str, list[str] | tuple[str, ...]] = {}
    bits = None if sieve is None else sieve.value.tobytes()
    size, crc32 = 8 * len(bits or b""), zlib.crc32

    def sums() -> pd.DataFrame:
        out = pd.DataFrame(list(seen.values()), columns=["n", "n_half"], dtype="int64")
        out.insert(0, "key", pd.Series(list(seen), dtype=object))
        return out

    for batch in batches:
        for words, half in zip(batch["words"], batch["half"]):
            own: set[str] = set()
            for w in words.split():
                found = memo.get(w)
                if found is None:
                    found = keys(w)
                    if bits is not None:
                        places = [crc32(k.encode()) % size for k in found]
                        found = tuple([k for k, at in zip(found, places) if bits[at >> 3] >> (at & 7) & 1])
                    memo[w] = found
                if found:
                    own.update(found)
            for k in own:
                sum_of = seen.setdefault(k, [0, 0])
                sum_of[0] += 1
                sum_of[1] += half
            if len(memo) > MEMO:
                memo.clear()
            if len(seen) > MEMO:
                yield sums()
                seen.clear()
    yield sums()


def _counts(read: DataFrame, n: dict[tuple[int, int], int]) -> DataFrame:
    """(key, toxic, clean, toxic_half, clean_half) of every key of a toxic document; clean ones are counted where evidence may come of it.

    ``n``: documents by (label, half). A key that would not be evidence without any clean document isn't with some, so only the other keys are
    counted, and moved, of clean documents.
    """
    sums = lambda rows, kind: rows.groupBy("key").agg(F.sum("n").alias(kind), F.sum("n_half").alias(f"{kind}_half"))
    counted = lambda label, sieve: read.where(f"label = {label}").mapInPandas(partial(_key_counts, sieve=sieve), "key string, n long, n_half long")
    toxic = sums(counted(1, None), "toxic").persist(StorageLevel.MEMORY_AND_DISK)
    sides = [(F.col("toxic") - F.col("toxic_half"), (0,)), (F.col("toxic_half"), (1,)), (F.col("toxic"), (0, 1))]
    often = toxic.agg(*[F.sum((c > 0).cast("long")) for c, _ in sides]).first()
    may = F.lit(False)
    for (c, halves), seen in zip(sides, often):
        n1, n0 = (max(1, sum(n.get((k, h), 0) for h in halves)) for k in (1, 0))
        # The gain of _weighed without a clean document, a little lowered for rounding.
        may = may | ((c >= LEAST) & (c * math.log((n1 + n0) / n1) >= math.log(max(1, seen or 0)) - 1e-6))
    sieve = read.sparkSession.sparkContext.broadcast(_sieve(toxic.where(may), F.col("key")))
    both = toxic.join(sums(counted(0, sieve), "clean"), "key", "left").fillna(0, ["clean", "clean_half"]).persist(StorageLevel.MEMORY_AND_DISK)
    both.count()
    toxic.unpersist()
    return both


def _weighed(counts: DataFrame, toxic: str, clean: str, n1: int, n0: int) -> dict[str, float]:
    """The strongest keys and their evidence, from all counts."""
    n1, n0 = max(1, n1), max(1, n0)
    share = n1 / (n1 + n0)
    often = counts.where(F.col(toxic) > 0).count()
    a, b = F.col(toxic).cast("double"), F.col(clean).cast("double")
    # Of as many keys as were seen, about one would get this far by chance.
    gain = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0.0)
    p, n, z = a / n1 / (a / n1 + b / n0), a + b, 2.5  # a lower bound of the share of toxic documents, by Wilson's interval
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = counts.where((a >= LEAST) & (a / (a + b) > share)).where((gain >= math.log(max(1, often))) & (low > 0.2))
    found = good.select("key", (F.log(low / (1 - low)) + 1.4).alias("w")).orderBy(F.desc("w"), "key").limit(KEPT).collect()
    return {r["key"]: r["w"] for r in found}


def _curve(points: DataFrame, prior: dict[int, float]) -> tuple[float, ...]:
    """The logistic function over all (first, second, label), by Newton's method with a small ridge; each step sums in the tasks."""
    n = {int(r[0]): r[1] for r in points.groupBy("label").count().collect()}
    mean = sum(prior[k] * n[k] for k in n) / max(1, sum(n.values())) or 1.0
    curve = np.zeros(5)
    names = [f"s{i}" for i in range(30)]

    def sums(batches: Iterator[pd.DataFrame], curve: np.ndarray) -> Iterator[pd.DataFrame]:
        total = np.zeros(30)
        for batch in batches:
            x, y, labels = (batch[c].to_numpy() for c in ("first", "second", "label"))
            design = np.stack(_terms(x, y)[1:], axis=1)
            design = np.concatenate([np.ones((len(x), 1)), design], axis=1)
            weight = np.where(labels == 1, prior[1], prior[0]) / mean
            p = 1 / (1 + np.exp(-np.clip(design @ curve, -50, 50)))
            total[:5] += design.T @ (weight * (labels - p))
            total[5:] += ((design * (weight * p * (1 - p))[:, None]).T @ design).ravel()
        yield pd.DataFrame([total], columns=names)

    for _ in range(200):
        step = points.mapInPandas(partial(sums, curve=curve), ", ".join(f"{c} double" for c in names))
        total = np.array([v or 0.0 for v in step.agg(*[F.sum(c) for c in names]).first()])
        move = np.linalg.solve(total[5:].reshape(5, 5) + 0.1 * np.eye(5), total[:5] - 0.1 * curve)
        curve = curve + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(x) for x in curve)


def train(texts: DataFrame) -> Model:
    """Learns from all (doc_id, text, label). Copies, told by their three lowest word hashes, count once for a label."""
    known = texts.select("doc_id", F.col("label").cast("int")).distinct()
    return _learned(_words(texts.select("doc_id", "text"), None), known)


def _words(docs: DataFrame, known: DataFrame | None) -> DataFrame:
    """(doc_id, low, words) of the texts, of those without a known label hardly any."""
    texts, kind = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), docs.schema["doc_id"].dataType
    sieve = None
    if known is not None and kind == known.schema["doc_id"].dataType and isinstance(kind, (T.IntegralType, T.StringType)):
        sieve = docs.sparkSession.sparkContext.broadcast(_sieve(known, F.col("doc_id")))
        texts = texts.where("doc_id IS NOT NULL").withColumn("crc", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return texts.mapInPandas(partial(_tokenised, sieve=sieve), f"doc_id {kind.simpleString()}, low string, words string")


def _once(words: DataFrame, known: DataFrame) -> DataFrame:
    """(label, half, words, copies): one text of all copies with a label. Ids and hashes choose it; only then words move, and once."""
    met = words.select("doc_id", "low").join(known, "doc_id")
    first = met.groupBy("low", "label").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    rows = words.join(first, ["doc_id", "low"]).groupBy("doc_id", "low", "label").agg(F.min("words").alias("words"), F.first("copies").alias("copies"))
    return rows.select("label", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).cast("int").alias("half"), "words", "copies")


def _learned(words: DataFrame, known: DataFrame) -> Model:
    """The model of all (doc_id, low, words) with their labels (doc_id, label)."""
    context = words.sparkSession.sparkContext
    words = words.persist(StorageLevel.MEMORY_AND_DISK)
    once = _once(words, known).persist(StorageLevel.MEMORY_AND_DISK)
    found = once.groupBy("label", "half").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()
    words.unpersist()
    if len({r["label"] for r in found}) < 2:
        once.unpersist()
        return Model(Letters(Counter()), {}, (-50.0, 0.0, 0.0, 0.0, 0.0))
    n = {(int(r["label"]), int(r["half"])): r["n"] for r in found}
    of = lambda k: n.get((k, 0), 0) + n.get((k, 1), 0)
    sizes = {k: sum(r["copies"] for r in found if r["label"] == k) for k in (0, 1)}
    counted = once.mapInPandas(_trigrams, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    triples = Counter({tuple(r["t"]): r["n"] for r in counted})
    shared = context.broadcast(dict(triples))

    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, memo = Letters(Counter(shared.value)), {}
        for batch in batches:
            out = []
            for words in batch["words"]:
                own = words.split()
                for w in own:
                    if w not in memo:
                        memo[w] = restored(w, letters)
                out.append(" ".join({memo[w] for w in own}))
                if len(memo) > MEMO:
                    memo.clear()
            yield pd.DataFrame({"label": batch["label"].array, "half": batch["half"].array, "words": out})

    read = once.select("label", "half", "words").mapInPandas(reading, "label int, half int, words string").persist(StorageLevel.MEMORY_AND_DISK)
    counts = _counts(read, n)
    rest = counts.withColumns({"toxic_rest": F.col("toxic") - F.col("toxic_half"), "clean_rest": F.col("clean") - F.col("clean_half")})
    halves = {1: ("toxic_half", "clean_half"), 0: ("toxic_rest", "clean_rest")}
    trial = context.broadcast({k: _weighed(rest, *c, n.get((1, k), 0), n.get((0, k), 0)) for k, c in halves.items()})

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        others = [Model(Letters(Counter()), trial.value[1 - k], (0.0,) * 5) for k in (0, 1)]
        memos: tuple[dict[str, float], ...] = ({}, {})
        for batch in batches:
            found = []
            for words, half in zip(batch["words"], batch["half"]):
                own, memo = words.split(), memos[half]
                for w in own:
                    if w not in memo:
                        memo[w] = others[half].evidence(w)
                found.append(_top([memo[w] for w in own]))
                if len(memo) > MEMO:
                    memo.clear()
            yield pd.DataFrame({"first": [t[0] for t in found], "second": [t[1] for t in found], "label": batch["label"].array})

    points = read.mapInPandas(tops, "first double, second double, label int").repartition(-(-sum(n.values()) // POINTS)).persist(StorageLevel.MEMORY_AND_DISK)
    curve = _curve(points, {k: sizes[k] / max(1, of(k)) for k in (0, 1)})
    model = Model(Letters(triples), _weighed(rest, "toxic", "clean", of(1), of(0)), curve)
    for kept in (once, read, counts, points):
        kept.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((dict(model.letters.triples), model.weights, model.curve))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triples, weights, curve = shared.value
        own = Model(Letters(Counter(triples)), weights, curve)
        memo: dict[str, float] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = []
                for w in tokens(text or ""):
                    if w not in memo:
                        word = restored(w, own.letters)
                        memo[w] = own.evidence(word) if word else 0.0
                    found.append(memo[w])
                out.append(own.score(*_top(found)))
                if len(memo) > MEMO:
                    memo.clear()
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": out})

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("score", T.DoubleType())
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = lambda c: F.coalesce(fold(c, 5) == 0, F.lit(False))
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return score(docs, _learned(_words(docs, known), known)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
