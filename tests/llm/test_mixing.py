"""The mix by its tree alone: words near the targets, expectations kept, limits held."""

import pandas as pd

from ampflow.llm import mixing


def _docs(spark, sizes, source):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate(zip(sizes, source))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_the_last_residual_is_a_small_document(spark):
    sizes = [1 + (i * i * 7) % 400 for i in range(2400)]
    docs = _docs(spark, sizes, ["abc"[i % 3] for i in range(2400)])
    found = mixing.copies(docs).toPandas()
    assert len(found) == 2400
    for _, rows in found.groupby("source"):
        off = abs((rows["size"] * rows["copies"]).sum() - rows.target.iloc[0])
        assert off <= sorted(rows["size"])[len(rows) // 10] / 2 + 1e-6
        assert rows["copies"].between(0, 3).all()


def test_expectations_stay(spark):
    """Each class of sizes gets the share of its source; the bound is five deviations of a draw between 0 and 3."""
    sizes = [(5, 20, 80, 320)[i % 4] for i in range(6000)]
    found = mixing.copies(_docs(spark, sizes, ["a" if i % 3 else "b" for i in range(6000)])).toPandas()
    for (_, _), rows in found.groupby(["source", "size"]):
        share = rows.target.iloc[0] / rows.source_size.iloc[0]
        assert abs(rows["copies"].mean() - share) <= 5 * 0.75 / len(rows) ** 0.5


def test_at_its_limit_a_source_is_taken_whole_and_empty_documents_take_nothing(spark):
    sizes = [10, 7, 0, 4000, 0, 900, 30, 2]
    docs = _docs(spark, sizes, ["a", "a", "a", "b", "b", "b", "b", "b"])
    found = mixing.report(docs).toPandas().set_index("doc_id")
    assert found.taken[[2, 4]].tolist() == [0, 0] and (found.taken <= 3 * found["size"]).all()
    again = mixing.report(docs.repartition(5)).toPandas().set_index("doc_id")
    pd.testing.assert_series_equal(found.taken.sort_index(), again.taken.sort_index())


def test_equal_rows_share_what_their_unit_takes(spark):
    docs = _docs(spark, [50] * 40 + [1] * 200, ["a"] * 240)
    docs = docs.union(docs.where("doc_id < 20")).union(docs.where("doc_id < 20"))
    found = mixing.report(docs).toPandas()
    assert len(found) == 280 and (found.taken <= 3 * found["size"]).all()
    assert abs(found.taken.sum() - found.target.iloc[0]) <= 1
    spans = found.groupby("doc_id").copies.agg(["min", "max"])
    assert (spans["max"] - spans["min"] <= 1).all()
