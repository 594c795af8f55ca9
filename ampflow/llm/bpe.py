"""Byte-level BPE encoding and decoding over a minimal acyclic transducer of frequent words.

1. Frequent words: every document is cut into pieces, pieces of over ``SHORT`` characters (as in scripts without spaces) into
   words, and what is longer even then is not counted; a task counts the rest, and whenever it holds ``HELD`` distinct ones it reports those that make up at least ``SHARE`` of what it has counted since its last
   report. Spark sums the reports. A piece with that share of all pieces has it in at least one report, and
   at most 1 / SHARE pieces can pass the sum, so the lexicon is bounded by construction, whatever the input.
2. Lexicon: the driver compiles their words, with their ids, into a minimal acyclic transducer: equal
   suffixes share states, and the numbers on the edges sum to the word's place in the id table. The
   transducer and the merge tables are files of flat arrays; Spark hands them to the executors as it hands out any file,
   and each worker maps them into memory, so the workers of a machine share their pages.
3. Encoding: a text is cut into words by the tokenizer's pattern. A worker resolves each distinct word of a group of
   texts once: the words of the lexicon in one vectorised walk, all others by the exact merges in order of rank.

Frequent words only save work: the ids are those of the merges for every word. A worker remembers at most
``MEMO_BYTES`` of short words; longer ones are resolved where they occur.

Defined results: a null text counts as empty and has no ids; null doc_ids and repeated rows are
ordinary rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import heapq
import json
import os
import re
import shutil
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.llm.common import durable

SHARE = 1 / 65536
#: Distinct pieces that a task counts before it reports.
HELD = 200_000
#: Estimated bytes of words that a worker remembers, and the characters of the longest of them.
MEMO_BYTES = 96 << 20
SHORT = 48
#: Texts are encoded in groups of so many, or of about so many characters.
TEXTS, CHARACTERS = 256, 1 << 20
NEVER = 1 << 60
LONG = 64

#: A space is a cut if a character follows that every Unicode version agrees is visible: no white space, control or format character.
HIDDEN = r"\x00-\x20\x7f-\xa0\xad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u1680\u180b-\u180f\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\ufff0-\uffff\U000e0000-\U0010ffff"
CUT = re.compile(f" (?=[^{HIDDEN}])")
#: A text with this has a space that is no cut.
UNCUT = re.compile(f" (?:[{HIDDEN}]|\\Z)")
#: Pieces for which every Unicode version agrees on letters, numbers and white space.
PLAIN = re.compile(r"[\n\r\t -~¡-¬®-ſ]*")


def _plain_pattern() -> re.Pattern:
    """The split pattern of the byte-level vocabulary (a fixed value), its classes written out for plain pieces."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(33, 0x180)):
        kinds.setdefault(unicodedata.category(c)[0], []).append(c)
    letters, numbers = ("".join(kinds[k]) for k in "LN")
    endings = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(f" ?[{letters}]++| ?[{numbers}]++|{endings}| ?[^\\s{letters}{numbers}]++|\\s+(?!\\S)|\\s+")


PLAIN_PATTERN = _plain_pattern()


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def keys_of(text: str) -> list[str]:
    """Keys of the pieces of a text.

    A piece that begins with the space of its cut has the rest of it as key; the first piece of a text, if it
    begins otherwise, has a space before it in its key. So most keys are what ``split`` gives.
    """
    keys = CUT.split(text) if UNCUT.search(text) else text.split(" ")
    if keys[0]:
        keys[0] = " " + keys[0]
        return keys
    return keys[1:]


def piece_of(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


@functools.cache
def _splitter() -> Callable[[str], list]:
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str


def words_of(piece: str) -> list[str]:
    """The words of a piece, in order."""
    if PLAIN.fullmatch(piece):
        return PLAIN_PATTERN.findall(piece)
    return [piece[a:b] for _, (a, b) in _splitter()(piece)]


def counted_keys(text: str) -> list[str]:
    """The keys that count for the lexicon: short pieces, and of longer ones the short words, as pieces of their own."""
    keys = keys_of(text)
    if max(map(len, keys), default=0) <= SHORT:
        return keys
    words = [w for k in keys if len(k) > SHORT for w in words_of(piece_of(k)) if len(w) <= SHORT]
    own = [w[1:] if w[0] == " " and w[1:].strip() else " " + w for w in words]
    return [k for k in keys if len(k) <= SHORT] + own


def _packed(arrays: list) -> bytes:
    """Flat arrays of 64-bit numbers, after their lengths."""
    parts = [np.asarray(x, "<i8") for x in arrays]
    return np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(x.tobytes() for x in parts)


def _mapped(path: str, n: int) -> list[np.ndarray]:
    data = np.memmap(path, dtype="<i8", mode="r")
    ends = np.cumsum([n, *data[:n]]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Vocabulary:
    """Merges and byte strings of a byte-level BPE tokenizer."""

    def __init__(self, path: str):
        """path: a file that ``compiled`` made."""
        first, self.pair_keys, self.pair_ranks, self.new_of_rank, ids, ends, data = _mapped(path, 7)
        self.first = np.array(first)
        every = data.astype(np.uint8).tobytes()
        self.bytes = {i: every[a:b] for i, a, b in zip(ids.tolist(), [0, *ends.tolist()], ends.tolist())}

    @staticmethod
    def compiled(spec: dict) -> bytes:
        """The arrays of a tokenizer file's contents."""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        pairs = sorted((ids[a] << 32 | ids[b], rank) for rank, (a, b) in enumerate(merges))
        special = special_of(spec)
        strings = {i: bytes(byte_of[c] for c in s) for s, i in ids.items() if s not in special}
        strings |= {i: s.encode() for s, i in special.items()}
        return _packed(
            [
                [ids[c] for c in byte_letters()],
                [p[0] for p in pairs],
                [p[1] for p in pairs],
                [ids[a + b] for a, b in merges],
                list(strings),
                np.cumsum([len(s) for s in strings.values()]),
                np.frombuffer(b"".join(strings.values()), np.uint8),
            ]
        )

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: again and again the leftmost pair of the lowest rank is merged.

        Short words of about the same length go through their merges side by side, in numpy.
        """
        out: list[list[int]] = [[] for _ in words]
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > LONG:
                out[k] = self._merge_long(self.first[np.frombuffer(word, np.uint8)].tolist())
            elif word:
                groups.setdefault(-(-len(word) // 4), []).append(k)
        for members in groups.values():
            for at in range(0, len(members), 1 << 12):
                part = members[at : at + (1 << 12)]
                for k, ids in zip(part, self._merge_short([words[k] for k in part])):
                    out[k] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == wanted) & (left >= 0) & (right >= 0), self.pair_ranks[at], NEVER)

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max()) + 1  # a column of -1 at the end
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        columns = np.arange(width)
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            live, at, best = live[best < NEVER], at[best < NEVER], best[best < NEVER]
            if not len(live):
                break
            row = np.arange(len(live))
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            moved = np.take_along_axis(ids[live], source, 1)
            moved[row, at] = self.new_of_rank[best]
            source = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 2)
            changed = np.take_along_axis(ranks[live], source, 1)
            changed[:, -1] = NEVER
            changed[row, at] = self._ranks(moved[row, at], moved[row, at + 1])
            inner = at > 0
            changed[row[inner], at[inner] - 1] = self._ranks(moved[row[inner], at[inner] - 1], moved[row[inner], at[inner]])
            ids[live], ranks[live] = moved, changed
        counts = (ids >= 0).sum(axis=1)
        flat, ends = ids[ids >= 0].tolist(), np.cumsum(counts).tolist()
        return [flat[e - n : e] for e, n in zip(ends, counts.tolist())]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long word, with a heap over linked symbols: n log n."""
        n, rank_of, new_of_rank = len(ids), self.rank_of, self.new_of_rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := rank_of.get(ids[i] << 32 | ids[after[i]])) is not None:
                heapq.heappush(heap, (rank, i))

        for i in range(n):
            offer(i)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], alive[j], after[i] = int(new_of_rank[rank]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x, lives in zip(ids, alive) if lives]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to ids, as one string of flat arrays.

    Words go in by order, and what no later word can change is replaced by an equal state that is
    there already. The number on an edge counts the words that come before it from its state, so
    a word's numbers sum to its place in sorted order, which is its place in the id table.
    """
    words = sorted(entries)
    states: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]

    def freeze(down_to: int, word: bytes) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            form = (final[state], tuple(sorted(states[state].items())))
            states[path[-1]][word[len(path) - 1]] = known.setdefault(form, state)

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        freeze(common, last)
        for byte in word[common:]:
            states.append({})
            final.append(False)
            states[path[-1]][byte] = len(states) - 1
            path.append(len(states) - 1)
        final[path[-1]] = True
        last = word
    freeze(0, last)
    used = [0, *sorted(known.values())]
    place = {s: k for k, s in enumerate(used)}
    below: dict[int, int] = {}
    for s in sorted(used, reverse=True):  # a state's targets have larger numbers or are frozen before it
        stack = [s]
        while stack:
            x = stack[-1]
            open_ = [t for t in states[x].values() if t not in below]
            if x in below or not open_:
                below.setdefault(x, final[x] + sum(below[t] for t in states[x].values()))
                stack.pop()
            else:
                stack += open_
    keys, targets, skips = [], [], []
    for s in used:
        count = int(final[s])
        for byte, t in sorted(states[s].items()):
            keys.append(place[s] << 8 | byte)
            targets.append(place[t])
            skips.append(count)
            count += below[t]
    return _packed(
        [
            keys,
            targets,
            skips,
            [final[s] for s in used],
            np.cumsum([0, *(len(entries[w]) for w in words)]),
            [i for w in words for i in entries[w]],
        ]
    )


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        self.keys, self.targets, self.skips, self.final, self.ends, self.ids = _mapped(path, 6)

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None; all words walk together, a byte a step."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.array([len(w) for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        there = np.arange(len(words))
        for step in range(int(lengths.max())):
            walking = there[lengths[there] > step]
            if not len(walking):
                break
            wanted = state[walking] << 8 | flat[starts[walking] + step]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[edge] == wanted
            state[walking[ok]] = self.targets[edge[ok]]
            number[walking[ok]] += self.skips[edge[ok]]
            there = np.setdiff1d(there, walking[~ok], assume_unique=True)
        found: list[list[int] | None] = [None] * len(words)
        for k in there[self.final[state[there]] == 1].tolist():
            n = int(number[k])
            found[k] = self.ids[self.ends[n] : self.ends[n + 1]].tolist()
        return found


def special_of(spec: dict) -> dict[str, int]:
    """The added tokens of a tokenizer file's contents; only plain ones are supported."""
    found = {}
    for added in spec["added_tokens"]:
        if added["lstrip"] or added["rstrip"] or added["single_word"] or added["normalized"]:
            raise ValueError(f"added token {added['content']!r} has options that are not supported")
        found[added["content"]] = added["id"]
    return found


class Encoder:
    """Encodes whole texts; each distinct word of a group of texts is resolved once, and short ones are remembered."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, special: dict[str, int]):
        self.vocabulary, self.lexicon, self.special = vocabulary, lexicon, special
        longest = sorted(special, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if special else None
        self.digits = [str(i) for i in range(1 + max(vocabulary.bytes))]
        self.ids_of: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        self.before: tuple[dict[str, str], dict[str, bytes]] = {}, {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; nothing is left out between them."""
        if self.parts is not None and self.parts.search(text):
            parts = self.parts.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.plain_words(part))]
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_PATTERN.findall(text)
        return [w for piece in map(piece_of, keys_of(text)) for w in words_of(piece)]

    def learn(self, words: list[str]) -> None:
        """Resolves words that are not remembered."""
        known = [w for w in words if w not in self.special]
        data = [w.encode() for w in known]
        found = self.lexicon.find(data)
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.vocabulary.merge([data[k] for k in rest])):
            found[k] = ids
        known += [w for w in words if w in self.special]
        found += [[self.special[w]] for w in words if w in self.special]
        of, digits = self.vocabulary.bytes, self.digits
        for word, ids in zip(known, found):
            text = ",".join([digits[i] for i in ids])
            self.ids_of[word] = text
            self.bytes_of[text] = b"".join([of[i] for i in ids])
            self.held += _size(word, text)

    def recall(self, words: set[str]) -> None:
        """Takes over what was remembered before the last change of memories."""
        ids_of, bytes_of = self.before
        for word in words.intersection(ids_of):
            text = ids_of.pop(word)
            self.ids_of[word], self.bytes_of[text] = text, bytes_of.pop(text)
            self.held += _size(word, text)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(decimal ids joined by commas, the bytes they decode to) of each text of a group."""
        if self.held > MEMO_BYTES // 2:  # what is not met again until the next change is forgotten
            self.before, self.ids_of, self.bytes_of, self.held = (self.ids_of, self.bytes_of), {}, {}, 0
        cut = [self.words(t) for t in texts]
        needed = {w for words in cut for w in words}
        self.recall(needed.difference(self.ids_of))
        new = list(needed.difference(self.ids_of))
        self.learn(new)
        for words in cut:
            found = list(map(self.ids_of.__getitem__, words))
            yield ",".join(found), b"".join(map(self.bytes_of.__getitem__, found))
        for word in new:
            if len(word) > SHORT:
                text = self.ids_of.pop(word)
                del self.bytes_of[text]
                self.held -= _size(word, text)


def _size(word: str, text: str) -> int:
    """About the bytes that a remembered word takes."""
    return 280 + 2 * len(word) + len(text)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(merges: str, lexicon: str, special: dict[str, int]) -> Encoder:
    """The worker's encoder; the files are those that Spark handed out under these names."""
    if (merges, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[merges, lexicon] = Encoder(Vocabulary(SparkFiles.get(merges)), Lexicon(SparkFiles.get(lexicon)), special)
    return _ENCODERS[merges, lexicon]


def frequent_words(docs: DataFrame) -> DataFrame:
    """(word, n): the short pieces that make up a share of SHARE or more of a report, with their counts there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(seen: Counter) -> pa.RecordBatch:
            total = seen.total()
            often = [(piece_of(k), n) for k, n in seen.items() if n >= total * SHARE]
            words = pa.array([w for w, _ in often] + [None], pa.string())
            return pa.record_batch([words, pa.array([n for _, n in often] + [total], pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(counted_keys(text.as_py() or ""))
                if len(seen) > HELD:
                    yield report(seen)
                    seen.clear()
        yield report(seen)

    schema = T.StructType().add("word", T.StringType()).add("n", T.LongType())
    return docs.select("text").mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary) -> bytes:
    """Compiles the frequent words of all documents; at most 1 / SHARE pieces come to the driver."""
    reported = durable(frequent_words(docs))
    total = reported.where("word is null").agg(F.sum("n").alias("total"))
    often = reported.where("word is not null").where(F.col("n") >= F.coalesce(total.scalar(), F.lit(0)) * SHARE)
    words = {word.encode() for row in often.select("word").collect() for word in words_of(row.word)}
    ordered = sorted(words)
    return compile_lexicon(dict(zip(ordered, vocabulary.merge(ordered))))


@functools.cache
def _folder() -> str:
    """The driver's folder of files to hand out, removed when it ends; workers that come late still fetch from it."""
    folder = tempfile.mkdtemp(prefix="lexicon")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _kept(kind: str, data: bytes) -> str:
    """The path of a file with these contents; equal contents are one file."""
    path = os.path.join(_folder(), f"{kind}-{hashlib.sha256(data).hexdigest()[:32]}")
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(data)
    return path


def _handed_out(spark: SparkSession, paths: list[str]) -> list[str]:
    """Names under which the workers find the files."""
    context = spark.sparkContext
    there = {os.path.basename(x) for x in context.listFiles}
    for path in paths:
        if os.path.basename(path) not in there:
            context.addFile(path)
    return [os.path.basename(p) for p in paths]


def encoded(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; with_ids adds ids and decoded."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = special_of(spec)
    merges = _kept("merges", Vocabulary.compiled(spec))
    lexicon = _kept("lexicon", build_lexicon(docs, Vocabulary(merges)))
    names = _handed_out(docs.sparkSession, [merges, lexicon])

    def rows(ids: pa.Array, texts: list[str], encoder: Encoder) -> pa.RecordBatch:
        out = [(x, data.decode("utf-8", errors="replace")) for x, data in encoder.encode(texts)]
        n = [x.count(",") + 1 if x else 0 for x, _ in out]
        columns = [
            ids,
            pa.array(n, pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in out], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in out], pa.string()),
        ]
        if with_ids:
            values = np.fromstring(",".join([x for x, _ in out if x]), np.int32, sep=",")
            ends = np.cumsum([0, *n]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(ends, values), pa.array([t for _, t in out], pa.string())]
        return pa.record_batch(columns, schema.names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*names, special)
        for batch in batches:
            begin, texts, size = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if len(texts) >= TEXTS or size >= CHARACTERS:
                    yield rows(batch.column(0)[begin : k + 1], texts, encoder)
                    begin, texts, size = k + 1, [], 0
            if texts:
                yield rows(batch.column(0)[begin:], texts, encoder)

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_tokens", T.LongType())
    schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return docs.select("doc_id", "text").mapInArrow(encode, schema)
