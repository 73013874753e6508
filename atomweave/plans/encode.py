"""Coding a table of signals against a given dictionary, and storing the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.coding import omp
from ..sources.models import Dictionary
from ..sources.sinks import write_codes


def encode(signals: DataFrame, atoms: DataFrame | Dictionary, n_nonzero: int = 10, tol: float | None = None,
           path: str | None = None, layout: str = "sparse") -> DataFrame:
    """Codes of all signals, written to ``path`` when one is given."""
    codes = omp(signals, atoms, tol=tol, n_nonzero=n_nonzero)
    if path is None:
        return codes
    n_atoms = atoms.n_atoms if isinstance(atoms, Dictionary) else atoms.count()
    write_codes(codes, path, n_atoms=n_atoms, signals=signals, layout=layout)
    return codes.sparkSession.read.parquet(path) if layout == "sparse" else codes
