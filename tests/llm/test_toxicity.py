import os
import random

import pytest
from pyspark.sql import functions as F

from cairnflow.llm import toxicity as x

MILD = "house river stone window paper garden summer winter letter yellow simple market silver travel number people".split()
BAD = "idiot moron scum loser".split()


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(MILD) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(12)] = rng.choice(BAD)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    return x.train([(x.words_of(t), y) for _, t, y in sample(400, 1)])


def chance(model, text):
    return model.chance(x.summary(model.decide(list(x.words_of(text)))))


def test_held_out_accuracy(model):
    rows = sample(300, 2)
    right = sum((chance(model, t) >= 0.5) == y for _, t, y in rows)
    assert right >= 0.98 * len(rows)


def test_gaps_and_insertions_are_tolerated(model):
    for text in ("you id*iot there", "you i.d.i.o.t there", "what a mo-ron", "s c u m", "s. c. u. m", "i--d--i--o--t", "you idxiot", "IDIOT!!"):
        assert chance(model, text) > chance(model, "the house by the river")
    assert chance(model, "you id*iot there") >= 0.5


def test_edge_cases(spark, edge, empty, model):
    got = {r["doc_id"]: r for r in x.score(edge, "doc_id", "text", model, carry=("n", "rank")).collect()}
    assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[2]["score"] == got[3]["score"] == got[5]["score"] <= 0.5
    assert got[1]["score"] == got[4]["score"]
    assert x.score(empty, "doc_id", "text", model).count() == 0


def test_without_labels_all_scores_are_low(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert x.score(edge, "doc_id", "text", x.fitted(edge, labels)).agg({"score": "max"}).collect()[0][0] < 0.5


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = sample(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(999, None)], "doc_id long, toxic int")
    bags = x.labelled_bags(docs, labels, "doc_id", "text", "toxic")
    import zlib

    assert len(bags) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_rows_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic IS NOT NULL")
    model = x.fitted(docs, labels)
    got = x.score(docs.join(known.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text", model).join(known, "doc_id").where(x.held_out("doc_id"))
    right, toxic, called = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic"), F.sum("predicted")).first()
    assert right >= 0.85 * toxic and right >= 0.95 * called
