"""The stages of the pipeline on odd rows, and run() as a whole against plain loops."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ampflow.llm import mixing, quality_rules, secrets, simhash
from tests.llm.test_text import SCHEMA, TOKENIZER, WORD, sha, slow_classes, slow_fingerprint

LONG = "the quick brown fox jumps over a lazy dog and then sleeps near number {} until morning comes again"


def wide(spark, rows):
    """Rows with columns whose names the operators use for themselves."""
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in ("h", "fp", "n", "size", "copies", "key", "root", "first")])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_unlike_documents_of_one_id_both_stay(spark):
    rows = [(5, LONG.format(1), "en", "a", 9), (5, "something that is quite unlike the other text of this id", "en", "a", 9)]
    assert rows_of(simhash.one_of_each(wide(spark, rows))) == rows_of(wide(spark, rows))


def test_one_of_equal_and_of_nameless_rows_stays(spark):
    rows = [(3, LONG.format(1), "en", "a", 9), (2, LONG.format(1), "de", "b", 9), (2, LONG.format(1), "de", "b", 9)]
    rows += [(None, LONG.format(1), "en", "a", 9), (None, "no id here at all", "en", None, 9), (None, "no id here at all", "fr", None, 9), (None, None, None, None, None)]
    kept = simhash.one_of_each(wide(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(2, LONG.format(1)), (None, "no id here at all"), (None, None)], key=repr)


def test_mix_keeps_rows_that_differ_in_other_columns(spark):
    rows = [(1, LONG.format(1), "en", "a", 9), (1, LONG.format(1), "de", "a", 9)]
    assert {r.lang for r in mixing.mix(wide(spark, rows)).collect()} == {"en", "de"}


def test_many_equal_rows_do_not_share_a_block(spark):
    rows = [(7, LONG.format(7), "en", "hot", 9)] * 3000 + [(100 + i, LONG.format(i), "en", "hot", 9) for i in range(100)]
    df = wide(spark, rows)
    found = mixing.report(df)
    assert found.count() == len(rows) and mixing.sized(df).count() == 101
    assert found.where("taken > 3 * size").count() == 0
    total, target = found.selectExpr("sum(taken)", "first(target)").first()
    assert abs(total - target) <= 20
    assert mixing.mix(df).count() == found.selectExpr("sum(copies)").first()[0]


def test_targets_as_plain_loops(spark):
    rows = [(i, " ".join(["w"] * size), "en", source, 1) for i, (source, size) in enumerate([("b", 5), ("a", 500), ("c", 40), (None, 7), ("é", 1), ("Z", 90)])]
    sizes = {r[3]: len(WORD.findall(r[1])) for r in rows}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    held: set = set()
    while True:
        free = [s for s in sizes if s not in held]
        level = (sum(sizes.values()) - 3 * sum(sizes[s] for s in held)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        held |= over
    want = {s: 3.0 * sizes[s] if s in held else level * weight[s] for s in sizes}
    got = {r.source: r.target for r in mixing.targets(mixing.sized(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == pytest.approx(want)


def test_reruns_of_the_mix_agree_under_another_partitioning(spark):
    rows = [(i, LONG.format(i) + " x" * (i % 50), "en", f"s{i % 4}", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(mixing.report(df)) == rows_of(mixing.report(df.repartition(37)))


def odd_documents():
    rows = [(i, LONG.format(i) + f" word{i} tail{i * 7}" * (1 + i % 5), ["en", None][i % 2], [None, "a", "b"][i % 3], i) for i in range(60)]
    rows += [(200, rows[0][1], "en", "b", 1), rows[1], rows[2], (None, LONG.format(99) + " unknown", None, None, None)]
    rows += [(300, "api_key: abcdefGHIJK0123456 " + LONG.format(300) + " and more", "en", "a", 5), (301, None, "en", "a", None), (302, "", "en", "a", 0)]
    return rows


def test_run_as_plain_loops(spark, tmp_path):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    good_ids = Counter((r.doc_id, r["__q_text"]) for r in quality_rules.judge(df).where("__q_kept").collect())
    good = [r for r in rows if (r[0], r[1] or "") in good_ids]
    classes = {}
    for k, (_, _, c) in enumerate(slow_classes([(k, slow_fingerprint(r[1])) for k, r in enumerate(good)])):
        classes.setdefault(c, []).append(good[k])
    single = [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]
    clean = {r[0]: secrets_out(r[1]) for r in single}
    cleaned = spark.createDataFrame([(i, t, *[r for r in single if r[0] == i][0][2:4], len(t)) for i, t in clean.items()], SCHEMA)
    taken = {r.doc_id: r.copies for r in mixing.report(cleaned).collect()}
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in clean.items():
        ids = library.encode(text, add_special_tokens=False).ids
        want += [(i, len(ids), sha(",".join(map(str, ids))), tuple(ids))] * taken[i]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def secrets_out(text):
    return text.replace("api_key: abcdefGHIJK0123456", "[SECRET]")


def test_stages_of_no_documents(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [quality_rules.keep_good, simhash.one_of_each, secrets.redact, mixing.mix])
def test_stages_keep_clashing_columns(spark, stage):
    df = wide(spark, odd_documents())
    assert stage(df).columns == df.columns and stage(df).count() > 0


def test_the_filter_of_the_rules_repeats_no_counts(spark):
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    calls = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert calls(quality_rules.keep_good(df)) <= calls(quality_rules.judge(df, quality_rules.rules()))
