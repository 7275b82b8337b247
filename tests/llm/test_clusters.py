import hashlib

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import hamerly, registry


def brute(rows, k=8, rounds=10, dims=64):
    """Plain k-means in whole numbers: (cluster, distance) by place, centroids."""
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    points = np.array([v for _, v in rows])
    seeds = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = np.array([v for _, v in seeds])
    for _ in range(rounds):
        near = ((points[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)
        for j in range(len(centroids)):
            if (near == j).any():
                centroids[j] = points[near == j].sum(0) // (near == j).sum()
    distances = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
    return sorted((i, int(c), int(d)) for (i, _), c, d in zip(rows, distances.argmin(1), distances.min(1))), centroids.tolist()


def test_op11(spark, sf_dir):
    want, centroids = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])
    rows = registry.op11_hamerly(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in rows) == want
    for r in rows:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)


def test_bounds_spare_scans(spark):
    """On vectors with clear clusters all but the first rounds scan next to nothing."""
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 5, (8, 64))
    rows = [(i, (middle[i % 8] + rng.normal(0, 0.3, 64)).tolist()) for i in range(800)]
    found = hamerly.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want, centroids = brute(rows)
    assert sorted(tuple(r) for r in found.rows.collect()) == want and found.centroids == centroids
    assert found.scanned[0] == 800 and sum(found.scanned[4:]) < 0.1 * 800 * len(found.scanned[4:])


def test_odd_vectors(spark):
    """Other lengths, nulls, infinite and too large components stay out; repeated rows, ids, ties and clashing names are kept apart."""
    line = lambda x: [x] * 64
    good = [(1, line(0.5)), (1, line(0.5)), (2, line(-0.25)), (3, line(0.125)), (4, line(0.5))]
    odd = [(5, None), (6, [1.0]), (7, [None, *line(1.0)[1:]]), (8, [float("nan"), *line(1.0)[1:]]), (9, [float("-inf"), *line(1.0)[1:]]), (10, line(1e300)), (11, [])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + odd], "vec_id long, embedding array<double>, cluster int, upper double")
    found = hamerly.cluster(df)
    want, centroids = brute(good)
    assert sorted(tuple(r) for r in found.rows.collect()) == want and found.centroids == centroids
    for part in (df.where(F.lit(False)), df.where("vec_id > 4")):
        assert hamerly.digests(hamerly.cluster(part)).count() == 0
    assert hamerly.cluster(df, rounds=0).rows.count() == 5
    without = spark.createDataFrame([(None, line(1.0)), (1, line(2.0))], "vec_id long, embedding array<float>")
    assert sorted(r.cluster for r in hamerly.cluster(without, k=1).rows.collect()) == [0, 0]
    large = [(i, [float(x) for x in np.random.default_rng(i).integers(-130000, 130000, 64)]) for i in range(30)]
    assert sorted(tuple(r) for r in hamerly.cluster(spark.createDataFrame(large, "vec_id long, embedding array<double>"), k=3).rows.collect()) == brute(large, 3)[0]
