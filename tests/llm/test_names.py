"""Extra columns: names that the operators use themselves, dotted names, maps; none is lost or mixed up."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ampflow.llm import (
    bpe, mixing, ngram_join, pii, quality_classifier, quality_rules, repeats, resample, secrets, simhash, sketch, toxicity,
)
from tests.llm.test_text import TOKENIZER

NAMES = (
    "spans", "r_h", "r_id", "removed", "__h", "__id", "__of", "__key", "__copies", "__nth", "__q_text", "__q_kept", "__q_rule", "__s_text",
    "__s_spans", "__s_clean", "h", "fp", "n", "size", "copies", "root", "node", "sid", "digest", "score", "weight", "a.dotted name", "own column 1", "Key", "units",
)
SENTENCE = "the quick brown fox {} jumps over a lazy dog and then sleeps near the old river until morning comes again"


@pytest.fixture(scope="module")
def docs(spark):
    """Good texts, copies and a secret; each extra column holds its own place and row, and one a map."""
    texts = [SENTENCE.format(w) for w in "one two three four five six".split()]
    texts += [texts[0], "few words", None, SENTENCE.format("seven") + " password = abcdEFGH12345678", f"{texts[1]}\n{texts[2]}"]
    rows = [(i, t, "s", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    extra = [F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(c) for k, c in enumerate(NAMES)]
    return df.select("*", *extra, F.create_map(F.lit("k"), "doc_id").alias("a map"))


def whole_rows(found, docs):
    """Every row's extra columns still belong to its doc_id."""
    assert found.columns[: len(docs.columns)] == docs.columns
    rows = found.collect()
    place = {c: docs.columns.index(c) for c in NAMES}
    for r in rows:
        assert all(r[place[c]] == f"{k}:{r[0]}" for k, c in enumerate(NAMES))
        assert r[docs.columns.index("a map")] == {"k": r[0]}
    return rows


def test_stages_keep_columns_of_any_name(spark, docs):
    kept = whole_rows(corpus_pipeline.drop_low_quality(spark, docs, ""), docs)
    assert {0, 1, 9} <= {r[0] for r in kept} and not {7, 8} & {r[0] for r in kept}
    apart = whole_rows(corpus_pipeline.drop_near_copies(spark, docs, ""), docs)
    assert 0 in {r[0] for r in apart} and 6 not in {r[0] for r in apart}
    clean = whole_rows(corpus_pipeline.redact_secrets(spark, docs, ""), docs)
    assert next(r for r in clean if r[0] == 9)[1].endswith("[SECRET]")
    assert next(r for r in clean if r[0] == 9)[3] == len(next(r for r in clean if r[0] == 9)[1])
    mixed = whole_rows(corpus_pipeline.mix_sources(spark, docs, ""), docs)
    assert set(range(7)) <= {r[0] for r in mixed}
    assert corpus_pipeline.encode_texts(spark, docs, "").count() == docs.count()


def test_removal_keeps_columns_of_any_name(docs):
    found = repeats.remove(docs)
    assert found.columns == [*docs.columns, "removed"]
    rows = whole_rows(found.toDF(*docs.columns, "what was removed"), docs)
    assert len(rows) == docs.count()
    assert next(r for r in rows if r[0] == 6)[1] == "" and next(r for r in rows if r[0] == 0)[1] == SENTENCE.format("one")


@pytest.mark.parametrize("name", ["secrets", "mixing", "bpe", "rules", "simhash", "sketch", "repeats", "pii", "ngrams", "resample", "quality", "toxicity"])
def test_reports_have_a_row_for_each_document(spark, docs, name):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], "doc_id long, quality int, toxic int")
    report = {
        "secrets": secrets.report, "mixing": mixing.report, "bpe": lambda d: bpe.encoded(d, TOKENIZER), "rules": quality_rules.report,
        "simhash": simhash.report, "sketch": sketch.report, "repeats": repeats.report, "pii": pii.report, "ngrams": ngram_join.report,
        "resample": lambda d: resample.report(d, d.limit(2)), "quality": lambda d: quality_classifier.report(d, labels),
        "toxicity": lambda d: toxicity.report(d, labels),
    }[name]
    assert sorted(r.doc_id for r in report(docs).collect()) == list(range(11))


def test_rows_that_differ_in_maps_only_all_stay_in_the_mix(spark):
    kinds = "doc_id long, text string, source string, m map<string,int>, s struct<a:array<map<string,int>>>"
    rows = [(1, SENTENCE, "a", {"k": 1}, None), (1, SENTENCE, "a", {"k": 2}, None), (1, SENTENCE, "a", None, ([{"x": 1}],)), (1, SENTENCE, "a", None, ([{"x": 2}],))]
    got = mixing.mix(spark.createDataFrame(rows, kinds)).collect()
    assert sorted(str((r.m, r.s)) for r in got) == sorted(str((r.m, r.s)) for r in spark.createDataFrame(rows, kinds).collect())


def test_order_inside_a_map_does_not_tell_rows_apart(spark):
    from ampflow.llm.common import row_hash

    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 2, 'b', 1)")
    found = [r[0] for r in df.select(row_hash(df)).collect()]
    assert found[0] == found[1] != found[2]
