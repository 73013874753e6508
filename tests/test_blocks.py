import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import blocks


@pytest.mark.parametrize("parts, fan_in", [(1, 256), (9, 2), (40, 4)])
def test_sums_of_blocks(spark, rng, parts, fan_in):
    """Every partition holds an array of 25 values for two keys, in blocks of 7; a key's sum is that of all partitions."""
    arrays = rng.normal(size=(parts, 2, 25))
    arrays[:, 1, 7:14] = 0  # blocks of zeros are left out

    def emit(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for key in (0, 1):
                    yield blocks.block_batch(arrays[i, key], 7, node_id=key)

    rows = spark.range(0, parts, 1, parts).mapInArrow(emit, f"node_id long, {blocks.BLOCK_FIELDS}")
    summed = blocks.added(rows, "node_id", "block", fan_in=fan_in)
    for key in (0, 1):
        got = blocks.local_array(summed.where(F.col("node_id") == key), 25, 7)
        assert np.allclose(got, arrays[:, key].sum(axis=0))
    assert summed.where("node_id = 1 and block = 1").isEmpty()


def test_no_rows(spark):
    empty = spark.createDataFrame([], blocks.BLOCK_FIELDS)
    assert not blocks.local_array(blocks.added(empty, "block"), 10).any()
