import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from cairnflow.llm.store import stored

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(9001, None, None, None, None), (9002, "", "en", "s", 0)]
    docs = stored(docs.unionByName(spark.createDataFrame(extra, docs.schema)))
    out = [docs]
    for _, f in p.STAGES:
        out.append(stored(f(spark, out[-1], DATA)))
    return out


def test_stages_return_the_columns_of_documents(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_rejected_and_duplicate_documents_are_gone(spark, steps):
    from tests.llm.test_jaccard_join import brute

    texts = {r[0]: r[1] for r in steps[1].select("doc_id", "text").collect()}
    want = {k for k, (n, c) in brute(texts).items() if c == k}
    assert {r[0] for r in steps[2].select("doc_id").collect()} == want
    assert {9001, 9002} <= want


def test_repeats_are_cut_and_secrets_masked(steps):
    from tests.llm.test_secret_scan import brute
    from tests.llm.test_suffix_dedup import brute as cut

    before = sorted((r[0], (r[1] or "").encode()) for r in steps[2].select("doc_id", "text").collect())
    want = {k: rest.decode("utf-8", "ignore") for k, (_, n, _, rest) in cut(before).items() if n == 0 or rest.decode("utf-8", "ignore").strip()}
    assert {r[0]: r[1] or "" for r in steps[3].select("doc_id", "text").collect()} == want
    left = {r[0]: r[1] or "" for r in steps[4].select("doc_id", "text").collect()}
    assert left.keys() == want.keys()
    assert all(left[k] == want[k] for k in want if not brute(want[k]))
    assert all(left[k] != want[k] for k in want if brute(want[k]))
    assert steps[4].where("text IS NOT NULL").where(F.length("text") != F.col("n_chars")).count() == steps[0].where("text IS NOT NULL").where(F.length("text") != F.col("n_chars")).count() == 0


def test_all_that_is_left_is_packed(steps):
    assert {r[0] for r in steps[5].select("doc_id").distinct().collect()} == {r[0] for r in steps[4].select("doc_id").collect()}


def test_repeated_rows_leave_one(spark):
    long, short, other = "one two three four five six seven eight nine ten " * 5, "a short text", "quite another text under the same id"
    rows = [(3, long, "en", "a", len(long))] * 4 + [(5, short, "de", "b", len(short))] * 3 + [(7, None, None, None, None)] * 2 + [(5, other, "en", "c", len(other))]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    want = sorted(set(rows), key=str)
    one = stored(p.one_of_each(spark, docs, DATA))
    assert sorted(map(tuple, one.collect()), key=str) == want
    cut = lambda df: sorted(tuple(r) for r in p.cut_repeats(spark, df, DATA).collect() if r[0] != 7)
    whole = [r for r in cut(docs) if r[0] == 3]
    assert len(whole) == 1  # equal rows are repeats of the first and don't come back
    assert [r for r in cut(docs) if r[0] == 5] == sorted(r for r in rows if r[0] == 5)  # no pairs of equal rows
    assert len(cut(one)) == 3


def test_odd_rows_and_empty_tables_pass_every_stage(spark, edge, empty):
    odd = stored(edge.withColumn("mark", F.lit("m")).withColumn("rows", F.lit("r")).union(edge.where("doc_id = 6").withColumn("mark", F.lit("m")).withColumn("rows", F.lit("r"))))
    for table, most in ((odd, 9), (stored(empty), 0)):
        docs = table
        for name, f in p.STAGES[:-1]:
            alone = stored(f(spark, table, DATA))  # each stage meets the clashing columns, nulls, a very long text and a repeated row
            assert alone.columns == list(p.COLUMNS) and alone.count() <= most, name
            docs = stored(f(spark, docs, DATA))
        packed = p.pack(spark, docs, DATA)
        assert packed.count() >= docs.count() and (packed.count() == 0) == (most == 0)
    assert sorted(r[0] for r in p.one_of_each(spark, odd, DATA).select("doc_id").collect()) == [1, 2, 3, 5, 6, 7, 8]
