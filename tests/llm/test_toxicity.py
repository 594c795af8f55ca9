"""The toxicity model learns from every labelled text that is not held out."""

import random

from pyspark.sql import functions as F

from ampflow.llm import toxicity


def test_counts_come_from_all_labelled_texts(spark, monkeypatch):
    seen = []
    weighed = toxicity._weighed
    monkeypatch.setattr(toxicity, "_weighed", lambda c, *a: seen.append(c.where("key = 'same '").first()) or weighed(c, *a))
    rows = [(i, f"same w{i} v{i} u{i}" + (" foulword" if i % 2 else ""), i % 2) for i in range(12_000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(texts.union(texts.limit(500)))
    assert {(r.toxic, r.clean) for r in seen} == {(6000, 6000)}
    assert model.evidence("foulword") > 0 == model.evidence("same")


def test_a_sieve_lets_through_its_keys_and_few_others(spark):
    ids = spark.range(40_000).withColumn("crc", F.crc32(F.col("id").cast("string").cast("binary")))
    bits = toxicity._sieve(ids.where("id % 20 = 0"), F.col("id"))
    rows = ids.toPandas()
    passed = toxicity._passes(bits, rows.crc.to_numpy()) == 1
    assert passed[rows.id % 20 == 0].all() and passed.mean() < 0.15


def test_copies_and_repeated_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (1, "aa bb cc dd"), (2, "dd cc bb aa"), (3, "x y z"), (4, None), (5, "p")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, label int")
    once = sorted((r.label, r.words, r.copies) for r in toxicity._once(toxicity._words(docs, known), known).collect())
    assert once == [(0, "", 1), (0, "x y z", 1), (1, "aa bb cc dd", 3)]


def plain(token, letters):
    """The cheapest reading by whole texts, a state being its last two characters."""
    best = {"  ": (0.0, "")}
    for i, seen in enumerate(token):
        ways = [(seen, 0.0 if seen.isalpha() else toxicity.KEEP_SYMBOL), *[(c, toxicity.LOOK) for c in toxicity.LOOKS_LIKE.get(seen, "")]]
        ways += [("", toxicity.DROP_MARK)] * (seen in toxicity.DROPPED) + [("", toxicity.DROP_REPEAT)] * (token[max(0, i - 1) : i] == seen)
        step = {}
        for state, (cost, text) in best.items():
            for char, extra in ways:
                to, now = (state + char)[-2:], cost + extra + (letters._cost(*state, char) if char else 0.0)
                if to not in step or now < step[to][0]:
                    step[to] = now, text + char
        best = step
    return min((cost + letters._cost(*s, " "), text) for s, (cost, text) in best.items())[1]


def test_tokens_of_any_length_are_restored_whole():
    rng = random.Random(5)
    letters = toxicity.Letters.of(toxicity.Counter({"foulword": 40, "stupid": 40, "people": 60, "the": 200, "house": 50, "zzz": 90}))
    long = "f0ulw0rd-" + "p.e.o.p.l.e_" * 12 + "h0use"
    assert toxicity.restored(long, letters) == "foulword" + "people" * 12 + "house"
    for n in (3, 63, 64, 65, 128, 300):
        for _ in range(10):
            token = "".join(c * rng.choice((1, 1, 1, 2, 7)) for c in rng.choices("stupidhoz01$!.*-_@", k=n))
            assert toxicity.restore(token, letters) == plain(token, letters)
    assert toxicity.restored("z" * 9 + "1", letters) == plain("z" * 9 + "1", letters)
    assert len(toxicity.restored("st0p-" * 20_000 + "house", letters)) == 80_005


def test_ordinary_words_take_no_other_way():
    rng = random.Random(6)
    weights = {k: rng.random() - 0.3 for k in ("foul", "ab ", "foulword ", "x ", "ñañ", "hou")}
    model = toxicity.Model(toxicity.Letters.of(toxicity.Counter({"foul": 1})), weights, (0.0,) * 5)
    for _ in range(3000):
        word = "".join(rng.choices("foulxabhñ1@.", k=rng.randint(0, 6))) + rng.choice(("", "foul", "hou", "ñañ"))
        assert model.evidence(word) == max(weights.get(k, 0.0) for k in toxicity.keys(word))
        core = word.lstrip(toxicity.OUTSIDE).rstrip(toxicity.MARKS)
        want = toxicity.restore(core, model.letters) if toxicity.suspicious(core) else core
        assert toxicity.restored(word, model.letters) == want.strip(toxicity.MARKS)
