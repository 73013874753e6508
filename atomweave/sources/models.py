"""Dictionaries: small tables of atoms, and the local matrix form tasks work with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import arrow, vectors
from ..session import cached
from ..sizing import SizeLimitError, model_bytes_limit, pinned, table_bytes


@dataclass(frozen=True)
class Dictionary:
    """Atoms within the model size limit; row ``k`` of ``matrix`` is atom ``ids[k]``."""

    ids: np.ndarray
    matrix: np.ndarray

    @property
    def n_atoms(self) -> int:
        return len(self.matrix)

    @property
    def width(self) -> int:
        return self.matrix.shape[1]

    def table(self, spark: SparkSession) -> DataFrame:
        return matrix_to_table(spark, self.matrix, "atom_id", "atom", self.ids)

    def position(self) -> np.ndarray | None:
        """Sorted ids, an atom's place in them being its matrix row; None where id and row are the same."""
        if np.array_equal(self.ids, np.arange(len(self.ids))):
            return None
        return self.ids


def matrix_to_table(spark: SparkSession, matrix: np.ndarray, key: str = "row_id", vec: str = "vec",
                    ids: np.ndarray | None = None) -> DataFrame:
    """A local matrix as a table with one row per matrix row."""
    matrix = np.asarray(matrix, dtype=np.float64)
    if ids is None:
        ids = np.arange(len(matrix))
    rows = pa.table({key: pa.array(np.asarray(ids, dtype=np.int32)), vec: arrow.list_rows(matrix)})
    return spark.createDataFrame(rows)


def load_dictionary(atoms: DataFrame | Dictionary, limit: int | None = None) -> Dictionary | None:
    """The local form of a table of atoms, or None when it is over the size limit.

    The table is kept for the length of the size check, so that atoms computed from a
    large input are computed once.
    """
    if isinstance(atoms, Dictionary):
        return atoms
    spark = atoms.sparkSession
    limit = model_bytes_limit(spark) if limit is None else limit
    kept = cached(atoms.select(F.col("atom_id").cast("int").alias("atom_id"), vectors.as_vector("atom").alias("atom")))
    try:
        if table_bytes(kept) > limit:
            return None
        rows = kept.toArrow()
    finally:
        kept.unpersist()
    rows = rows.combine_chunks().sort_by("atom_id")
    ids = np.asarray(rows["atom_id"]).astype(np.int64)
    if len(np.unique(ids)) != len(ids):
        raise ValueError("atom_id must be unique")
    if not len(ids):
        return Dictionary(ids, np.zeros((0, 0)))
    column = rows["atom"].combine_chunks()
    return Dictionary(ids, arrow.dense_rows(column, len(column[0])))


def table_to_matrix(df: DataFrame, key: str = "row_id", vec: str = "vec") -> np.ndarray:
    """A model-sized table as a local matrix, rows in key order."""
    found = load_dictionary(df.select(F.col(key).alias("atom_id"), F.col(vec).alias("atom")))
    if found is None:
        raise SizeLimitError("only model-sized tables may be turned into a local matrix")
    return found.matrix


# Fixed values of the formula dictionary: cell (k, j) is (b^3 mod 1009 + 1) / 1010 before scaling to unit length,
# b = 37 k + 101 j + 11 + (k div 1009) (2 j + 3) + (j div 1009) (2 k + 3). The last two terms keep atoms and
# dimensions past the modulus from repeating earlier ones.
FORMULA = {"k": 37, "j": 101, "shift": 11, "modulus": 1009}


def init_dictionary(spark: SparkSession, m: int, n_atoms: int | None = None, seed: int = 0, init: str = "random",
                    signals: DataFrame | None = None) -> DataFrame:
    """A first dictionary with unit atoms, square (as many atoms as dimensions) by default.

    ``random``: uniform [0, 1) cells from ``seed``. ``formula``: fixed arithmetic, the
    same in every engine. ``first_k``: the signals with the lowest ids.
    """
    n_atoms = m if n_atoms is None else n_atoms
    if init == "first_k":
        if signals is None:
            raise ValueError("init='first_k' needs signals")
        # ids alone are ranked, as many narrow rows as there will be atoms; the vectors stay where they are
        first = signals.select("signal_id").orderBy("signal_id").limit(n_atoms)
        place = (F.row_number().over(Window.orderBy("signal_id")) - 1).cast("int")
        ranked, small = pinned(first.select("signal_id", place.alias("atom_id")))
        return signals.join(F.broadcast(ranked) if small else ranked, "signal_id").select(
            "atom_id", vectors.unit(vectors.as_vector("vec")).alias("atom"))
    atom = F.col("id")
    if init == "random":
        cell = lambda j: F.pmod(F.xxhash64(F.lit(seed), atom, j), F.lit(1 << 53)).cast("double") / float(1 << 53)
    elif init == "formula":
        c = FORMULA
        again = lambda x: F.floor(x / c["modulus"])
        base = lambda j: (atom * c["k"] + j * c["j"] + c["shift"] + again(atom) * (2 * j + 3) + again(j) * (2 * atom + 3)) % c["modulus"]
        cell = lambda j: (base(j) * base(j) * base(j) % c["modulus"] + 1).cast("double") / (c["modulus"] + 1)
    else:
        raise ValueError("init is 'random', 'formula' or 'first_k'")
    cells = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: cell(j.cast("long")))
    return spark.range(n_atoms).select(F.col("id").cast("int").alias("atom_id"), vectors.unit(cells).alias("atom"))
