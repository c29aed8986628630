import random

import numpy as np
from foliospark.llm import vectors

SCHEMA = "chunk_id long, embeddings array<float>, neighbour string"


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least}
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.standard_normal(32) * rng.uniform(0.05, 0.4)).astype(np.float32).tolist()))
    for _ in range(900):
        rows.append((len(rows), rng.standard_normal(32).astype(np.float32).tolist()))
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    true = brute([(i, v) for i, v in rows], 5, 0.85)
    found = {tuple(r) for r in vectors.similar_vector_pairs(df, "chunk_id", "embeddings").collect()}
    assert len(true) > 100 and len(true & found) >= 0.98 * len(true) and len(found - true) <= 0.02 * len(true)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], ""), (1, [1.0, 0.0], "again"), (2, [2.0, 0.0], ""), (3, None, ""), (4, [0.0, 0.0], ""), (5, [0.0, 0.0], ""), (6, [float("nan"), 1.0], ""), (7, [1.0], ""), (8, [], ""), (9, [0.0, -3.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in vectors.similar_vector_pairs(df, "chunk_id", "embeddings").collect()} == {(1, 2)}
    assert vectors.similar_vector_pairs(df.limit(0), "chunk_id", "embeddings").count() == 0
    assert vectors.similar_vectors(df.where("chunk_id = 3"), "chunk_id", "embeddings").count() == 0


def test_copies_give_k_neighbours_each(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(i, v, "") for i in range(50)] + [(100, [1.0, 2.0, 3.05], ""), (200, [-5.0, 0.0, 1.0], "")], SCHEMA)
    rows = vectors.similar_vectors(df, "chunk_id", "embeddings", 5, 0.85).collect()
    of = {}
    for r in rows:
        of.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    assert all(len(of[i]) == 5 for i in range(50)) and sorted(n for _, n in of[49]) == [0, 1, 2, 3, 4]
    assert sorted(n for _, n in of[100]) == [0, 1, 2, 3, 4] and 200 not in of


def test_split_cell_meets_all(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT_CELL", 20)
    rng = random.Random(1)
    rows = [(i, [1 + rng.gauss(0, 0.02), rng.gauss(0, 0.02), rng.gauss(0, 0.02)]) for i in range(90)]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)
    f32 = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    found = {tuple(r) for r in vectors.similar_vector_pairs(df, "chunk_id", "embeddings").collect()}
    true = brute(f32, 5, 0.85)
    assert len(found & true) >= 0.95 * len(true)


def test_groups_of_very_close_vectors(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(20):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        rows += [(len(rows) + i, (centre + rng.standard_normal(64) * 0.0022).astype(np.float32).tolist()) for i in range(100)]
    rows += [(len(rows) + i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)
    found = {tuple(r) for r in vectors.similar_vector_pairs(df, "chunk_id", "embeddings").collect()}
    true = brute(rows, 5, 0.85)
    assert len(found & true) >= 0.97 * len(true) and len(found - true) <= 0.03 * len(true)
