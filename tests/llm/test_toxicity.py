import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webloom.llm import queries, toxicity
from webloom.llm.common import bucket_of_id, hash_sample
from webloom.llm.textvec import utf8

SF = "/root/testdata/sf0.1"


def rows_of(n=400):
    rows = []
    for i in range(n):
        clean = f"Nice day number {i}. We went out\nand came home"
        rows.append((i, clean + (" you vile toad! Bye." if i % 4 == 0 else ". Bye."), int(i % 4 == 0)))
    return rows


def test_noisy_or_of_sentences():
    model = toxicity.fit([r[1] for r in rows_of()], np.array([r[2] for r in rows_of()]))
    data, offsets = utf8(pa.array(["One two. Three vile\nfour", "", None, "Nice"], pa.string()))
    p, text, first, end = model.sentences(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(first, end)] == [b"One two", b"Three vile", b"four", b"Nice"]
    got = model.documents(data, offsets)
    assert np.allclose(got, [1 - math.prod(1 - x for x in p[:3]), 0, 0, p[3]])


def test_labels_of_documents_locate_sentences(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, None, ""), (7777, "", ""), (8888, "word " * 50_000 + "vile toad", "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, bucket_of_id("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (y == 1) for i, y in held) and got[None] == got[7777] == 0 and got[8888] >= 0.7
    found = toxicity.locate(docs, model).collect()
    texts = {i: t for i, t, _ in rows} | {8888: "word " * 50_000 + "vile toad"}
    assert {r.doc_id for r in found} >= {i for i, y in held if y}
    assert all(texts[r.doc_id][r.begin : r.end] == r.sentence and "vile" in r.sentence for r in found)
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} <= {0.0} or max(r.score for r in toxicity.score(docs, nothing).collect()) < 1e-6


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in truth if got[d].held_out]
    toxic, clean = [d for d in held if truth[d]], [d for d in held if not truth[d]]
    # 9 of these 144 toxic texts hold no word or stem that is found more often in toxic texts than in clean ones
    assert np.mean([got[d].predicted for d in toxic]) >= 0.89 and np.mean([got[d].predicted for d in clean]) <= 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_slopes_against_differences():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(6), [1, 2, 5, 1, 3, 4])
    z, labels, share = rng.normal(0, 2, len(doc)), np.array([1, 0, 1, 0, 1, 0]), rng.uniform(0.5, 2, 6)

    def loss(z):
        total = 0.0
        for d in range(6):
            none = math.prod(1 - 1 / (1 + math.exp(-x)) for x in z[doc == d])
            total -= share[d] * math.log(1 - none if labels[d] else none)
        return total / 6

    for k, slope in enumerate(toxicity.slopes(z, doc, labels, share)):
        up, down = z.copy(), z.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - slope) < 1e-6


def test_fit_reaches_the_optimum():
    # "bad" in 30 of 40 toxic texts and 10 of 160 clean ones, twice in one sentence or in two: one weight, one bias
    texts = ["good day"] * 150 + ["a bad day"] * 10 + ["bad, so bad"] * 15 + ["bad. so bad"] * 15 + ["good day"] * 10
    labels = np.array([0] * 160 + [1] * 40)
    model = toxicity.fit(texts, labels, l1=0.0, weight=1.0, steps=6000)
    data, offsets = utf8(pa.array(["good day", "a bad day", "bad, so bad", "bad. so bad"]))
    plain, one, both, two = model.documents(data, offsets)

    def loss(one, both, two):
        return -(10 / 160 * math.log(1 - one) + 15 / 40 * math.log(both) + 15 / 40 * math.log(two))

    def grid():
        for b in range(-60, 1):
            for w in range(0, 60):
                p, q = (1 / (1 + math.exp(-z / 4)) for z in (b + w, b + 2 * w))
                yield loss(p, q, 1 - (1 - p) ** 2)

    assert plain == 0 and loss(one, both, two) <= min(grid()) + 0.02, (plain, one, both, two)


def test_no_length_adds_up():
    model = toxicity.fit([r[1] for r in rows_of()], np.array([r[2] for r in rows_of()]))
    data, offsets = utf8(pa.array(["A nice day. " * 100_000]))
    assert model.documents(data, offsets)[0] < 0.01


def test_hash_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(5000)] + [(1, "a")] * 3000 + [(7, "c")] * 4000, "doc_id long, g string")
    got = hash_sample(rows, "g", 30, F.xxhash64("doc_id")).distinct().collect()
    size = {g: sum(r.g == g for r in got) for g in "abc"}
    assert 12 <= size["a"] <= 60 and 12 <= size["b"] <= 60 and size["c"] == 1  # no group is lost, repeats don't crowd out others
    order = rows.select("doc_id", "g", F.shiftrightunsigned(F.xxhash64("doc_id"), 33).alias("h")).distinct().orderBy("h").collect()
    assert {r.doc_id for r in got} == {r.doc_id for g in "abc" for r in [x for x in order if x.g == g][: size[g]]}
    assert hash_sample(rows.limit(0), "g", 30, F.xxhash64("doc_id")).count() == 0


def test_bytes_of_the_sample_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(300)] + [(1000, "x" * 5000), (3, "word " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1000, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, F.lit(True), row_bytes=2000).collect()
    assert len(rows) == 300 and sorted(len(r.text) for r in rows)[:2] == [500, 1000]
    few = toxicity.sample(docs, labels, F.lit(True), row_bytes=2000, train_bytes=100_000).collect()
    assert 30 <= len(few) <= 100 and sum(len(r.text) for r in few) <= 100_000


def test_a_column_called_score_is_replaced(spark):
    model = toxicity.fit([r[1] for r in rows_of()], np.array([r[2] for r in rows_of()]))
    df = spark.createDataFrame([(1, "you vile toad", "old", 5.0), (2, None, "old", None)], "doc_id long, text string, Score string, label double")
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "label", "score"] and {r.doc_id: r.score >= 0.7 for r in got.collect()} == {1: True, 2: False}
