"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four patterns with checks give the base spans (email, ip, card, phone). A wider net gives candidates of
seven kinds. Five labelers vote on each (for, against, or not at all): its shape, its checksum or ranges, a
gazetteer, the words around it, and its borders. Spark counts how often each combination of kind,
votes and features occurs in all documents; the features have a few levels each, so the table is bounded by
their product and not by the input. On it the driver runs expectation-maximisation, which
estimates each labeler's reliability for each kind without any labels, and trains a logistic span
classifier on the posteriors. A second pass adds the candidates that the classifier accepts and that
no base span overlaps.

Defined results: a null text counts as empty; null doc_ids and repeated rows are ordinary rows;
an empty table gives an empty result; offsets are code points, the end exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")

# The base patterns. The local part of an email is found backwards from its sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match can begin nowhere else, and a long number is read once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The wider net. That of emails begins behind the local part.
NET = {
    "email": re.compile(r"(?: ?(?:\(at\)|\[at\]) ?| at )[A-Za-z0-9-]++(?:(?: ?\(dot\) ?| ?\[dot\] ?| dot |\.)[A-Za-z]{2,})+"),
    "ip": re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])|(?<![0-9])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"),
    "phone": re.compile(r"(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
}
#: Takes one letter and looks ahead at the rest, so a name behind another capitalised word is tried too.
NAME = re.compile(r"[A-Z](?=[a-z]+ [A-Z][a-z]+(?P<end>))")
DIGIT = re.compile(r"[0-9]")

#: Gazetteers: common given names of several languages and ends of host names.
GIVEN = frozenset(
    "Adam Ahmed Alan Albert Alessandro Alex Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Ann Anna Anne Anthony "
    "Antonio Barbara Benjamin Bernard Brian Bruno Camille Carla Carlos Carmen Carol Caroline Catherine Charles Charlotte "
    "Chiara Christian Christine Christopher Claire Claudia Daniel David Deborah Diana Diego Donald Dorothy Edward Elena "
    "Elizabeth Emily Emma Eric Eva Fatima Federico Felix Fernando Francesca Francesco Francisco Frank Franz Gabriel George "
    "Giovanni Giulia Giuseppe Hannah Hans Heinz Helen Helga Henri Henry Ibrahim Ines Ingrid Isabel Jack Jacob James Jan Jane "
    "Jason Javier Jean Jennifer Jessica Joan John Jonas Jonathan Jorge Jose Joseph Juan Judith Julia Julie Karen Karl Kevin "
    "Klaus Laura Lea Leon Lisa Louis Lucas Lucia Luis Luca Manuel Marco Margaret Maria Marie Mario Mark Marta Martin Mary "
    "Matthew Michael Michel Miguel Mohammed Monika Nancy Nathalie Nicholas Nicolas Nicole Nina Olga Oliver Olivia Omar Pablo "
    "Pamela Patricia Patrick Paul Paula Pedro Peter Philip Philippe Pierre Rachel Raymond Rebecca Richard Robert Rosa Ruth "
    "Samuel Sandra Sara Sarah Sebastian Simon Sofia Sophie Stefan Stephen Susan Teresa Thomas Ursula William Wolfgang Yusuf".split()
)
ENDINGS = frozenset("com org net edu gov info io de fr es uk it nl eu ch at us ca".split())
TITLES = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? $")
NEAR = {
    "email": re.compile(r"mail|contact|write|schreib|écri|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|from", re.I),
    "card": re.compile(r"card|visa|master|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobil|handy|móvil", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta", re.I),
    "name": re.compile(r"name|sincerely|regards|author|signed|by $", re.I),
}
AGAINST = re.compile(r"version|v\.? ?$|isbn|page|chapter|section|order no|part no|§ ?$", re.I)

PSEUDO = 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: from the start of the run of local characters before a sign."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(done, at + 1))
    return found


def spelled_emails(text: str) -> list[tuple[int, int]]:
    """Emails with their sign spelled out: from the start of the run of local characters before it."""
    found, done = [], 0
    if " at " in text or "(at)" in text or "[at]" in text:
        for m in NET["email"].finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end()))
            done = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), by start and then rank."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the wider net, base spans included."""
    found = set(base_spans(text))
    digits = bool(DIGIT.search(text))
    for rank, kind in enumerate(KINDS):
        if kind == "name":
            found |= {(m.start(), rank, m.end("end")) for m in NAME.finditer(text)}
        elif kind == "email":
            found |= {(start, rank, end) for start, end in spelled_emails(text)}
        elif digits:
            found |= {(m.start(), rank, m.end()) for m in NET[kind].finditer(text)}
    return sorted(found)


def _iban_ok(value: str) -> bool:
    plain = value.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def votes(kind: str, value: str, left: str, right: str) -> tuple[int, ...]:
    """Of each labeler 1 (for), -1 (against) or 0 (no opinion, so where nearly every candidate of the net would pass)."""
    digits = "".join(DIGIT.findall(value))
    strict = {
        "email": "@" in value,
        "ip": IP.fullmatch(value) is not None,
        "card": re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{14}", value) is not None,
        "phone": value.startswith("+") or None,
        "ssn": None,  # the net asks for this shape, so it says nothing
        "iban": " " not in value or all(len(p) == 4 for p in value.split(" ")[:-1]),
        "name": None,
    }[kind]
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        check = 1 if _iban_ok(value) else -1
    elif kind == "ip":
        check = 1 if all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in value.split(".")) else -1
    elif kind == "phone":
        check = 0 if 10 <= len(digits) <= 15 else -1  # the net asks for so many, so it says nothing for a phone
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
    else:
        check = 0
    listed = 0
    if kind == "email":
        listed = 1 if re.split(r"[. \])]+", value)[-1].lower() in ENDINGS else -1
    elif kind == "name":
        listed = 1 if value.split(" ")[0] in GIVEN else 0  # no list has every name
    near = 1 if NEAR[kind].search(left) or (kind == "name" and TITLES.search(left)) else -1 if AGAINST.search(left) else 0
    border = -1 if (left[-1:].isalnum() or right[:1].isalnum() or (left[-1:] in ".-" and left[-2:-1].isdigit())) else 0
    return (0 if strict is None else 1 if strict else -1, check, listed, near, border)


def describe(kind: str, value: str, left: str, right: str) -> tuple[int, ...]:
    """Features of a span with a few levels each: length, share of digits, checksum, neighbours, context."""
    vote = votes(kind, value, left, right)
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4
    digits = len(DIGIT.findall(value))
    return (
        min(5, len(value) // 6),
        4 * digits // len(value),
        vote[1] + 1,
        vote[2] + 1,
        vote[3] + 1,
        side(left[-1:]),
        side(right[:1]),
    )


LEVELS = (6, 5, 3, 3, 3, 5, 5)


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[start:end], text[max(0, start - 24) : start], text[end : end + 2]


def expectation_maximisation(table: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """P(true) of each vote pattern of one kind, as counts of patterns -> posteriors.

    Two classes; given the class, the labelers are independent and each has its own probabilities of a
    vote for, none and against. Starts from the majority, in which a checksum counts three times. Few labelers and rare
    votes leave such a mixture open, so each labeler has pseudo-votes, ``PSEUDO`` of the candidates' number for a class:
    its own votes, those for leaning two to one to the true class and those against to the other. A labeler that always
    votes the same thus says nothing, and candidates of which no labeler says more than of others are rather false.
    """
    patterns = list(table)
    n = np.array([table[p] for p in patterns], float)
    vote = np.array(patterns) + 1
    post = 1 / (1 + np.exp(-2.0 * ((vote - 1).sum(axis=1) + 2 * (vote[:, 1] - 1))))
    own = PSEUDO * n.sum()
    lean = np.array([0.5, 1.0, 2.0])
    for _ in range(rounds):
        scores = np.full(len(patterns), np.log((n @ post + 0.9 * own) / (n @ (1 - post) + 1.1 * own)))
        for k in range(vote.shape[1]):
            often = np.array([n[vote[:, k] == level].sum() for level in range(3)])
            prior_good, prior_bad = (often * side / (often @ side) for side in (lean, lean[::-1]))
            for level in np.flatnonzero(often):
                here = vote[:, k] == level
                good = ((n * post)[here].sum() + own * prior_good[level]) / (n @ post + own)
                bad = ((n * (1 - post))[here].sum() + own * prior_bad[level]) / (n @ (1 - post) + own)
                scores[here] += np.log(good / bad)
        post = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    return dict(zip(patterns, post.tolist()))


def design(rank: int, feature: tuple[int, ...]) -> np.ndarray:
    row = [np.eye(len(KINDS))[rank], *(np.eye(n)[f] for n, f in zip(LEVELS, feature))]
    return np.concatenate(row)


def train(table: dict[tuple[int, tuple[int, ...], tuple[int, ...]], int]) -> np.ndarray:
    """Weights of the logistic span classifier, trained on the posteriors of all candidates."""
    if not table:
        return np.zeros(len(KINDS) + sum(LEVELS))
    posterior = {}
    for rank in {k[0] for k in table}:
        own: Counter = Counter()
        for (r, vote, _), n in table.items():
            if r == rank:
                own[vote] += n
        posterior |= {(rank, v): p for v, p in expectation_maximisation(own).items()}
    x = np.array([design(r, f) for r, _, f in table])
    y = np.array([posterior[r, v] for r, v, _ in table])
    n = np.sqrt(np.array(list(table.values()), float))  # frequent combinations do not drown rare ones
    n = n / n.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(100):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 1e-4 * weights
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(weights))
        move = np.clip(np.linalg.solve(curvature, gradient), -3, 3)
        weights = weights + move
        if np.abs(move).max() < 1e-8:
            break
    return weights


def counted(docs: DataFrame) -> DataFrame:
    """(kind, votes, features, n) over all documents; a batch reports each combination once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                for start, rank, end in candidates(text or ""):
                    where = around(text, start, end)
                    seen[rank, votes(KINDS[rank], *where), describe(KINDS[rank], *where)] += 1
            yield pd.DataFrame(
                [(r, list(v), list(f), n) for (r, v, f), n in seen.items()], columns=["kind", "votes", "features", "n"]
            )

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("kind", T.IntegerType()).add("votes", ints).add("features", ints).add("n", T.LongType())
    return docs.select("text").mapInPandas(run, schema).groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> np.ndarray:
    return train({(r.kind, tuple(r.votes), tuple(r.features)): r.n for r in counted(docs).collect()})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans)


def find(text: str, weights: np.ndarray, memo: dict) -> tuple[list, list]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    taken: list[list[int]] = []  # stretches that base spans cover, apart and in order
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    added: list[tuple[int, int, int]] = []
    at, free_from = 0, 0
    for start, rank, end in candidates(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start < free_from or at < len(taken) and taken[at][0] < end:
            continue
        key = (rank, describe(KINDS[rank], *around(text, start, end)))
        if key not in memo:
            memo[key] = float(design(*key) @ weights) > 0
        if memo[key]:
            added.append((start, rank, end))
            free_from = end
    return base, sorted(base + added)


def scan(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, every = find(text or "", weights, memo)
                n = Counter(r for _, r, _ in base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((n[0], n[1], n[2], n[3], digest, _joined(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType)
    for c in ("n_email", "n_ip", "n_card", "n_phone"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_sha256", T.StringType()).add("spans", T.StringType()).add("n_added", T.LongType())
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def report(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs))
