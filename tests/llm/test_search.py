"""Searches among vectors and codes, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlog.llm import hamming, nearest

VECTORS = "vec_id bigint, embedding array<float>, score string"


def rows_of(n, seed, width=8):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(20, width))
    points = (centres[random.integers(0, 20, n)] + random.normal(scale=0.3, size=(n, width))).astype(np.float32)
    points[n // 2 : n // 2 + n // 3] = points[n // 2]  # a third of all are copies
    return [(int(k), [float(x) for x in row], "x") for k, row in enumerate(points)]


@pytest.fixture(scope="module")
def vectors(spark):
    odd = [
        (None, [1.0] * 8, "x"), (9001, None, "x"), (9002, [0.0] * 8, "x"), (9003, [float("nan")] * 8, "x"),
        (9004, [None] + [1.0] * 7, "x"), (9005, [float("inf")] + [1.0] * 7, "x"), (9006, [], "x"), (9007, [1.0], "x"),
    ]
    return spark.createDataFrame(rows_of(1500, 1) + odd + rows_of(1500, 1)[:3], VECTORS)


def brute(rows, query, k):
    ids, points = np.array([row[0] for row in rows]), np.array([row[1] for row in rows], float)
    far = np.sqrt(((points - points[ids == query][0]) ** 2).sum(axis=1))
    far[ids == query] = np.inf
    order = np.lexsort((ids, far))[:k]
    return [(int(ids[at]), float(far[at])) for at in order]


def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 64)
    rows = rows_of(1500, 1)
    queries = vectors.where(F.col("vec_id") % 25 == 0)
    found = {}
    for row in nearest.nearest_vectors(vectors, queries, 10).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    assert set(found) == set(range(0, 1500, 25))
    hits = 0
    for query, own in found.items():
        assert sorted(own) == list(range(1, 11))
        got = [own[rank] for rank in range(1, 11)]
        assert got == sorted(got, key=lambda x: (x[1], x[0]))
        true = brute(rows, query, 10)
        exact = dict(brute(rows, query, 1499))
        assert all(exact[vec_id] == score for vec_id, score in got)
        hits += len({vec_id for vec_id, _ in got} & {vec_id for vec_id, _ in true})
    assert hits >= 0.9 * 10 * len(found)


def test_recall_over_many_leaves(spark, monkeypatch):
    """At least nine of ten true neighbours in 64 dimensions, and no more rows sent on than some for each neighbour."""
    from playlog.llm.tables import EMBEDDINGS, read

    for name, value in (("LEAF_ROWS", 64), ("FIRST_ROWS", 128), ("BLOCK_ROWS", 50), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(nearest, name, value)
    vectors = read(spark, "/root/testdata/sf0.1", "embeddings", EMBEDDINGS)
    sent = []
    original = nearest.searched

    def watched(*args):
        found = original(*args).cache()
        sent.append(found.count())
        return found

    monkeypatch.setattr(nearest, "searched", watched)
    queries = vectors.where(F.col("vec_id") % 20 == 0)
    found = nearest.nearest_vectors(vectors, queries, 10).collect()
    table = vectors.select("vec_id", "embedding").toPandas()
    ids, points = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    hits = 0
    for query in ids[ids % 20 == 0]:
        far = np.sqrt(((points - points[ids == query][0]) ** 2).sum(axis=1))
        far[ids == query] = np.inf
        hits += len({row["vec_id"] for row in found if row["query_id"] == query} & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    recall = hits / len(found)
    print(f"recall {recall:.3f}, rows sent on {sent} for {len(found)} neighbours")
    assert len(found) == 1_000 and recall >= 0.9
    assert sent[1] <= 12 * len(found)


def test_few_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [1.0, 0.0], "x"), (3, [1.0, 0.0], "x")]
    vectors = spark.createDataFrame(rows, VECTORS)
    found = nearest.nearest_vectors(vectors, vectors.where("vec_id = 3"), 10).collect()
    assert [(row["rank"], row["vec_id"]) for row in sorted(found)] == [(1, 1), (2, 2)]
    empty = vectors.limit(0)
    assert nearest.nearest_vectors(empty, empty).count() == 0
    assert nearest.nearest_vectors(vectors, empty).count() == 0


def test_best_first_visits_every_leaf():
    rows = np.random.default_rng(0).normal(size=(2000, 4))
    tree = nearest.fit_tree(rows, 20_000)
    assert tree.n_leaves > 8
    for row in rows[:5]:
        order = list(tree.best_first(row))
        assert sorted(order) == list(range(tree.n_leaves))
    assert (np.array([next(iter(tree.best_first(row))) for row in rows[:50]]) == tree.leaves(rows[:50])).mean() > 0.9


def brute_codes(codes, query, k):
    mine = codes[query]
    far = [
        (sum((x ^ y).bit_count() for x, y in zip(mine, code, strict=True)), vec_id)
        for vec_id, code in codes.items()
        if vec_id != query and len(code) == len(mine)
    ]
    return sorted(far)[:k]


@pytest.mark.parametrize("width", [3, 8])
def test_codes(spark, width, monkeypatch):
    monkeypatch.setattr(hamming, "CODES_IN_BLOCK", 300)
    monkeypatch.setattr(hamming, "QUERIES_IN_BLOCK", 20)
    random = np.random.default_rng(width)
    codes = {k: random.integers(0, 256, width, np.uint8).tobytes() for k in range(1000)}
    codes |= {k: codes[0] for k in range(1000, 1300)} | {2000: b"\1"}
    rows = [*codes.items(), (None, b"\1" * width), (3000, None), (3001, b""), (5, codes[5])]
    frame = spark.createDataFrame(rows, "vec_id bigint, code binary")
    found = {}
    for row in hamming.nearest_codes(frame, frame.where("vec_id % 31 = 0 OR vec_id >= 1290"), 10).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["distance"], row["vec_id"]))
    asked = [k for k in codes if k % 31 == 0 or k >= 1290]
    assert set(found) == {k for k in asked if k != 2000}
    for query, own in found.items():
        assert [(distance, vec_id) for _, distance, vec_id in sorted(own)] == brute_codes(codes, query, 10)


def test_few_codes(spark):
    frame = spark.createDataFrame([(1, b"ab"), (2, b"ac")], "vec_id bigint, code binary")
    assert hamming.nearest_codes(frame, frame, 10).count() == 2
    assert hamming.nearest_codes(frame.limit(0), frame.limit(0)).count() == 0


def test_signs(spark, vectors):
    codes = {row["vec_id"]: bytes(row["code"]) for row in hamming.sign_codes(vectors).collect()}
    assert {9001, 9003, 9004, 9005, 9006} & set(codes) == set()
    for vec_id, row, _ in rows_of(1500, 1)[:20]:
        assert codes[vec_id] == np.packbits(np.array(row) > 0).tobytes()
