"""Vectors with every awkward case."""

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int, x string, tree int, n long, score double, windows string"
EXTRA = ("x", 7, 8, 0.5, "w")


def rows(n=900, d=6, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = r.normal(size=d).astype(np.float32)
        if i % 3 == 0:  # a third are copies of one vector
            v = np.arange(d, dtype=np.float32) / 10
        out.append((i, [float(c) for c in v], int(r.integers(0, 4)), *EXTRA))
    vector = [0.5] * d
    out += [(100, None, 1, *EXTRA), (n, None, 1, *EXTRA), (n + 1, vector, None, *EXTRA), (n + 2, [None, *vector[1:]], 1, *EXTRA), (n + 3, [float("nan"), *vector[1:]], 1, *EXTRA), (n + 4, [float("inf"), *vector[1:]], 2, *EXTRA)]
    return out + [(None, vector, 1, *EXTRA), out[5], out[200], (n + 5, [0.0] * d, 1, *EXTRA), (n + 6, [0.25], 2, *EXTRA)]


def table(spark, made):
    return spark.createDataFrame(made, SCHEMA).repartition(3)
