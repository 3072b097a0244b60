import math
import random

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import topk


def brute(rows, k=5, step=50):
    kept = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for q, a in {(i, tuple(v)) for i, v in kept if i % step == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank string").repartition(4)


def rows_of(n, seed, dims=16):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) * (1 if d % 3 else 0.2) for d in range(dims)], 1, "clash") for i in range(n)]
    same = rows[7][1]
    for i in range(0, n, 3):  # one vector of a third of all rows
        rows[i] = (i, same, 1, "")
    return rows + [(n, None, 0, ""), (n + 1, [float("nan")] * dims, 0, ""), (n + 2, [float("inf")] + [0.0] * (dims - 1), 0, ""), (n + 3, [None] + [1.0] * (dims - 1), 0, ""), (None, same, 0, ""), (n + 4, [0.0] * dims, 0, ""), (n + 5, [1.0, 2.0], 0, "")]


def test_against_brute_force(spark):
    for n, seed, settings in ((260, 1, {}), (700, 2, {"block": 64, "per_query_block": 4}), (3, 3, {})):
        rows = rows_of(n, seed) if n > 10 else [(0, [1.0, -1.0], 0, ""), (1, [0.5, 0.25], 0, ""), (50, [0.0, 0.0], 0, "")]
        got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, **settings).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in got) == brute(rows)


def test_repeated_ids_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (0, [1.0, 0.0], 0, ""), (1, [1.0, 1.0], 0, ""), (1, [1.0, 1.0], 0, "")]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 1)]
    assert topk.top_k(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_fewer_than_k_others_in_a_block():
    vectors = np.array([[3, 1], [3, 1], [2, 2], [1, 0], [5, -1], [4, 4], [0, 9]], np.int64) * 100  # levels are steps of more than 1
    index = topk.Index(np.array([0, 0, 0, 0, 1, 2, 3]), vectors)
    assert index.search(vectors[:1], 5, np.array([0])) == [[(160_000, 2), (140_000, 1), (90_000, 3)]]


def exact(vectors, query, own, k=5):
    score = vectors @ query
    return [(-s, i) for s, i in sorted((-int(s), i) for i, s in enumerate(score) if i != own)[:k]]


def test_index_stops_on_proof_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 64))
    vectors = np.round((centres[rng.integers(0, 60, 3000)] + 0.5 * rng.standard_normal((3000, 64))) * 100).astype(np.int64)
    index, report = topk.Index(np.arange(3000), vectors), []
    for q, found in enumerate(index.search(vectors[:64], 5, np.arange(64), report=report)):
        assert found == exact(vectors, vectors[q], q)
    assert len(report) == 64 and max(report) < 0.9 and sum(report) / 64 < 0.7  # every query stops before the end


def test_vectors_of_the_table_stop_on_proof(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v")).orderBy("vec_id").toArrow()
    ids, vectors = np.asarray(rows["vec_id"]), topk._matrix(rows["v"].combine_chunks())
    index, report, own = topk.Index(ids, vectors), [], np.flatnonzero(ids % 50 == 0)
    found = index.search(vectors[own], 5, ids[own], report=report)
    assert all(x == [(s, int(ids[i])) for s, i in exact(vectors, vectors[q], q)] for x, q in zip(found, own))
    assert sum(r < 1 for r in report) >= 0.9 * len(own) == 0.9 * len(report) and sum(report) / len(report) < 0.9


def test_floors_from_elsewhere_leave_out_only_what_lies_below():
    rng = np.random.default_rng(6)
    vectors = np.round(rng.standard_normal((500, 16)) * 50).astype(np.int64)
    index = topk.Index(np.arange(500), vectors)
    want = [exact(vectors, vectors[q], q) for q in range(8)]
    floors = np.array([w[2][0] for w in want], dtype=np.float64)
    got = index.search(vectors[:8], 5, np.arange(8), floors)
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_no_impacts():
    vectors = np.zeros((20, 3), np.int64)
    assert topk.Index(np.arange(20), vectors).search(vectors[:1], 2, np.array([0])) == [[(0, 1), (0, 2)]]


def test_one_id_with_unlike_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (0, [0.0, 1.0], 0, ""), (1, [2.0, 1.0], 0, ""), (2, [1.0, 3.0], 0, ""), (None, [1.0, 3.0], 0, "")]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r["score"]) for r in got) == [(0, 1, 1, 131072), (0, 1, 2, 196608)]
