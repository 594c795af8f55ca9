"""Long tokens, many matches and many lines take seconds; long words of other scripts are encoded as by the library."""

import random
import time

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ampflow.llm import bpe, common, pii, repeats, secrets, toxicity
from tests.llm.test_text import TOKENIZER, sha

CYRILLIC = "абвгдежзийклмнопрст"
CHINESE = "".join(chr(0x4E00 + 7 * i) for i in range(900))


def within(seconds, f):
    began = time.perf_counter()
    out = f()
    assert time.perf_counter() - began < seconds
    return out


def test_long_texts_of_other_scripts_as_the_library(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    texts = [
        " ".join(word(CYRILLIC) for _ in range(20000)),
        "".join(rng.choices(CHINESE, k=30000)),
        "，".join(word(CHINESE) + " " + word("abc") for _ in range(5000)),
        "x" * 200_000,
        "7" * 200_000,
        "a b  c ​d́ é  \n\n f ᠎ g ﻿ h",
        "  <|endoftext|> a<|endoftext|>",
    ]
    library = Tokenizer.from_file(TOKENIZER)
    got = bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, with_ids=True).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == sha(",".join(map(str, ids)))


def test_words_of_every_script_are_in_the_lexicon(spark):
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = bpe.Vocabulary(bpe._kept("merges", bpe.Vocabulary.compiled(spec)))
    texts = ["привет мир", "καλημέρα κόσμε", "今天天气很好，我们去公园散步。" * 6, "hello world, " * 9, "字" * 400, "a" * 400] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = bpe.Lexicon(bpe._kept("lexicon", bpe.build_lexicon(docs, vocabulary)))
    words = [w.encode() for w in (" мир", "привет", "καλημέρα", " κόσμε", "今天天气很好", "我们去公园散步", " world")]
    assert lexicon.find(words) == vocabulary.merge(words)
    assert lexicon.find([("字" * 400).encode(), b"a" * 400]) == [None, None]
    library = Tokenizer.from_file(TOKENIZER)
    for r in bpe.encoded(docs, TOKENIZER, with_ids=True).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_unspaced_texts_are_counted_by_short_words_only():
    text = "，".join(["今天天气很好" * 20, "我们去"]) + " короткое"
    assert bpe.counted_keys(text) == ["короткое", " ，", " 我们去"]
    assert all(len(k) <= bpe.SHORT + 1 for k in bpe.counted_keys("字" * 100_000 + " " + "x" * 100_000))
    assert bpe.counted_keys("") == [] and bpe.counted_keys("a b") == bpe.keys_of("a b")


def test_an_encoder_that_forgets_gives_the_same_ids(monkeypatch):
    import json

    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = bpe.Vocabulary(bpe._kept("merges", bpe.Vocabulary.compiled(spec)))
    words = sorted({b" the", b" and", b"ing"})
    lexicon = bpe.Lexicon(bpe._kept("lexicon", bpe.compile_lexicon(dict(zip(words, vocabulary.merge(words))))))
    encoder = bpe.Encoder(vocabulary, lexicon, bpe.special_of(spec))
    library, rng = Tokenizer.from_file(path), random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(1, 6))) for _ in range(60)) + " the and" for _ in range(20)]
        got = [ids for ids, _ in encoder.encode(texts)]
        assert got == [",".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
        assert encoder.held <= bpe.MEMO_BYTES // 2 + 1300 * 400 and all(len(w) <= bpe.SHORT for w in encoder.ids_of)


@pytest.mark.parametrize("text", ["1" * 1_000_000, "x" * 1_000_000, "1." * 500_000, "a@" * 300_000, "x at " + "a" * 1_000_000, "-1" * 400_000])
def test_long_tokens_in_the_python_operators(text):
    letters = toxicity.Letters.of(toxicity.Counter({"word": 1}))
    within(8, lambda: pii.find(text, pii.train({}), {}))
    within(8, lambda: [toxicity.restored(t, letters) for t in toxicity.tokens(text)])


def test_many_spans_of_personal_data():
    text = " ".join(f"user{i}@mail.example.com" for i in range(100_000))
    base, every = within(20, lambda: pii.find(text, pii.train({}), {}))
    assert len(base) == len(every) == 100_000


def test_a_long_disguise_is_still_read():
    letters = toxicity.Letters.of(toxicity.Counter({"idiot": 40, "stupid": 40, "people": 60, "the": 200, "house": 50}))
    assert toxicity.restored("i" + "d" * 500_000 + "iot", letters) == "idiot"


def test_many_matches_and_lines(spark):
    rng = random.Random(3)
    hexes = [f"{rng.getrandbits(80):020x}" for _ in range(100_000)]
    lines = [f"line number {i % 50_000} of a text with more than eight words" for i in range(100_000)]
    rows = [(1, " ".join(hexes)), (2, "\n".join(lines)), (3, "A1" * 500_000), (4, "passwor" * 150_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in within(90, lambda: secrets.report(df).collect())}
    assert found[1].n_hex == 100_000 and found[1].spans.startswith("hex:0:20,hex:21:41")
    clean = {r.doc_id: r.text for r in within(90, lambda: secrets.redact(df).collect())}
    assert clean[1] == " ".join(["[SECRET]"] * 100_000)
    once = {r.doc_id: r.n_removed for r in within(90, lambda: repeats.report(df).collect())}
    assert once[2] == 50_000
    kept = {r.doc_id: r.text for r in within(90, lambda: repeats.remove(df).collect())}
    assert kept[2] == "\n".join(lines[:50_000]) + "\n" * 50_000


def test_running_and_replaced_as_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        text = "".join(rng.choices("ab é\U0001f600\n", k=rng.randint(0, 9000)))
        spans = sorted({(s, min(len(text), s + rng.randint(0, 40))) for s in (rng.randint(0, len(text)) for _ in range(rng.randint(0, 60)))})
        rows.append((text, [{"start": s, "end": e} for s, e in spans]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>")
    got = df.select("*", common.replaced(F.col("text"), F.col("spans"), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))).alias("out")).collect()
    for r in got:
        out, at, begun = "", 0, None
        for s in r.spans:
            if s.start >= at:
                out += ("" if begun is None else f"[{at - begun}]") + r.text[at : s.start]
                begun = s.start
            at = max(at, s.end)
        out += ("" if begun is None else f"[{at - begun}]") + r.text[at:]
        assert r.out == out
