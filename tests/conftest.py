import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from atomweave.session import local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def small_limit(spark):
    """Sets the model size limit in bytes for one test."""
    from atomweave.sizing import MAX_MODEL_BYTES

    def change(n):
        spark.conf.set(MAX_MODEL_BYTES, str(n))
    yield change
    spark.conf.unset(MAX_MODEL_BYTES)


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(7)


class Maker:
    """Tables from arrays and arrays from tables."""

    def __init__(self, spark):
        self.spark = spark

    def signals(self, y, parts=3, nodes=None):
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(y)]
        schema = "signal_id long, vec array<double>"
        if nodes is not None:
            rows = [(*r, int(n)) for r, n in zip(rows, nodes)]
            schema += ", node_id long"
        return self.spark.createDataFrame(rows, schema).repartition(parts, "signal_id")

    def atoms(self, d):
        return self.spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(d)],
                                          "atom_id int, atom array<double>")

    def codes(self, x):
        rows = [(int(i), int(k), float(x[i, k])) for i, k in zip(*np.nonzero(x))]
        return self.spark.createDataFrame(rows, "signal_id long, atom_id int, coef double")

    def entries(self, a):
        rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
        return self.spark.createDataFrame(rows, "row_id long, col_id int, value double")

    @staticmethod
    def dense_codes(df, n, k):
        out = np.zeros((n, k))
        for r in df.collect():
            out[r["signal_id"], r["atom_id"]] += r["coef"]
        return out

    @staticmethod
    def matrix(df, key, vec):
        return np.array([r[vec] for r in df.orderBy(key).collect()])

    @staticmethod
    def cells(df, shape, i="row_id", j="col_id", value="value"):
        out = np.zeros(shape)
        for r in df.collect():
            out[r[i], r[j]] += r[value]
        return out


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)
