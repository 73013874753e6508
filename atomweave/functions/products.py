"""A sparse product's blocks, added up as the cells of both matrices stream through a task.

Cells travel in tiles: those of ``side`` neighbouring inner keys and ``side`` neighbouring rows (or columns), sorted by
``key * side + place`` and packed into bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FEW = 8          # a block with fewer products than one to so many cells is kept as a list
FILLED = 64      # a pair of tiles with a product to so many of their cells is multiplied as a matrix
GATHERED = 1 << 20  # cells that a task puts in order at a time
THIN = 64        # cells a tile from which tiles are packed one by one
RECORD = np.dtype([("cell", "<u4"), ("w", "<f8")])


class Block:
    """The cells of one block: a list of products while these are few, then an array."""

    def __init__(self, side: int):
        self.side, self.listed, self.total, self.seen = side, [], None, None
        self.n = 0

    def _open(self) -> None:
        if self.total is None:
            self.total, self.seen = np.zeros(self.side ** 2), np.zeros(self.side ** 2, dtype=bool)
            for cell, value in self.listed:
                self._scatter(cell, value)
            self.listed = []

    def _scatter(self, cell: np.ndarray, value: np.ndarray) -> None:
        np.add.at(self.total, cell, value)
        self.seen[cell] = True

    def add_list(self, cell: np.ndarray, value: np.ndarray) -> None:
        self.n += len(cell)
        if self.total is None and self.n * FEW > self.side ** 2:
            self._open()
        if self.total is None:
            self.listed.append((cell, value))
        else:
            self._scatter(cell, value)

    def add_matrix(self, rows: np.ndarray, cols: np.ndarray, value: np.ndarray, seen: np.ndarray) -> None:
        self._open()
        place = np.ix_(rows, cols)
        self.total.reshape(self.side, -1)[place] += value
        self.seen.reshape(self.side, -1)[place] |= seen

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        if self.total is not None:
            cell = np.flatnonzero(self.seen)
            return cell, self.total[cell]
        if not self.listed:
            return np.empty(0, np.int64), np.empty(0)
        cell, owner = np.unique(np.concatenate([c for c, _ in self.listed]), return_inverse=True)
        return cell, np.bincount(owner, np.concatenate([v for _, v in self.listed]), len(cell))


# --- tiles -------------------------------------------------------------------------------

def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: like bytes stand together."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_planes(raw: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack_tile(cell: np.ndarray, w: np.ndarray) -> bytes:
    """Sorted cells and their values; values that come often are named by a number."""
    names = pa.array(w.view(np.int64)).dictionary_encode()  # by their bits: -0 and NaN stay what they are
    many = len(names.dictionary)
    few = many <= min(len(w) // 4, 1 << 16)
    values = [np.asarray(names.dictionary).tobytes(), _planes(np.asarray(names.indices).astype("<u2"))] if few else [_planes(w.astype("<f8"))]
    raw = b"".join([_planes(np.diff(cell, prepend=0).astype("<u4")), *values])
    return np.array([len(cell), many if few else 0, len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_tile(packed: memoryview) -> tuple[np.ndarray, np.ndarray]:
    n, many, size = (int(x) for x in np.frombuffer(packed, "<i8", 3))
    raw = memoryview(pa.decompress(packed[24:], size, codec="zstd"))
    cell = np.cumsum(_of_planes(raw, "<u4", n), dtype=np.int64)
    if not many:
        return cell, _of_planes(raw[4 * n:], "<f8", n)
    return cell, np.frombuffer(raw, "<f8", many, 4 * n)[_of_planes(raw[4 * n + 8 * many:], "<u2", n)]


def _bytes(column: pa.Array, i: int) -> memoryview:
    return memoryview(column[i].as_buffer())


def parts_of_tiles(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """``k, block, packed, cells`` from ``mid, place, w``: what a task has of each tile, packed where that is much."""
    def gathered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        mid, place, w = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("mid", "place", "w"))
        k, block, cell = mid // side, place // side, mid % side * side + place % side
        order = np.lexsort((cell, block, k))
        k, block, cell, w = k[order], block[order], cell[order], w[order]
        first = np.r_[0, np.flatnonzero((np.diff(k) != 0) | (np.diff(block) != 0)) + 1]
        ends = np.r_[first[1:], len(k)]
        if packed := len(k) >= THIN * len(first):
            cells = pa.array([pack_tile(cell[a:b], w[a:b]) for a, b in zip(first, ends)], pa.binary())
        else:
            records = np.empty(len(k), RECORD)
            records["cell"], records["w"] = cell, w
            offsets = (np.r_[0, ends] * RECORD.itemsize).astype(np.int32)
            cells = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(records)])
        return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(block[first]), pa.array(np.full(len(first), packed)), cells],
                                          ["k", "block", "packed", "cells"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield gathered(held)
            held, n = [], 0
    if n:
        yield gathered(held)


def _folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order, those given more than once added up."""
    cell, w = (np.concatenate(x) for x in zip(*held))
    if (np.diff(cell) > 0).all():
        return cell, w
    order = np.argsort(cell, kind="stable")
    cell, w = cell[order], w[order]
    first = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
    with np.errstate(invalid="ignore"):  # infinities of both signs
        return cell[first], np.add.reduceat(w, first)


def whole_tiles(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """``k, block, size, keys, cells`` from :func:`parts_of_tiles` in the order of tiles; ``keys`` has a bit for every inner key."""
    def finished() -> pa.RecordBatch:
        cell, w = _folded(held)
        packed, keys = pack_tile(cell, w), np.zeros(-(-side // 64) * 64, dtype=np.uint8)
        keys[np.unique(cell // side)] = 1
        row = [here[0]], [here[1]], [len(packed)], [np.packbits(keys, bitorder="little").view("<i8")], [packed]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))],
                                          ["k", "block", "size", "keys", "cells"])

    here, held, n = None, [], 0
    for batch in batches:
        for at, (k, block, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "block", "packed")))):
            if here != (k, block):
                if here is not None:
                    yield finished()
                here, held, n = (k, block), [], 0
            raw = _bytes(batch.column("cells"), at)
            if packed:
                held.append(unpack_tile(raw))
            else:
                records = np.frombuffer(raw, RECORD)
                held.append((records["cell"].astype(np.int64), records["w"]))
            n += len(held[-1][0])
            if n > 4 * side ** 2 and n > GATHERED:  # cells given very often
                held = [_folded(held)]
                n = len(held[0][0])
    if here is not None:
        yield finished()


def sent_tiles(batches: Iterator[pa.RecordBatch], side: int, group: int, second: bool) -> Iterator[pa.RecordBatch]:
    """``i, j, k, second, block, cells`` from tiles and the blocks ``others`` that their keys reach, ``group`` by ``group`` blocks together.

    A tile goes once to every group that it reaches, without the keys that do not reach it.
    """
    words = -(-side // 64)
    for batch in batches:
        for at, (k, block, others) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "block", "others")))):
            bits = np.asarray(batch.column("reached")[at].values).astype("<i8").reshape(-1, words)
            to, owner = np.unique(np.asarray(others) // group, return_inverse=True)
            packed, cell, w, out = _bytes(batch.column("cells"), at), None, None, []
            cell, w = unpack_tile(packed)
            for place, other in enumerate(to.tolist()):
                reached = np.unpackbits(np.bitwise_or.reduce(bits[owner == place], axis=0).view(np.uint8), bitorder="little").astype(bool)
                own = reached[cell // side]
                if own.any():
                    i, j = (other, block // group) if second else (block // group, other)
                    out.append((i, j, k, second, block, bytes(packed) if own.all() else pack_tile(cell[own], w[own])))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["i", "j", "k", "second", "block", "cells"])


# --- products ----------------------------------------------------------------------------

def _add_tiles(block: Block, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> None:
    """The products of the inner keys that both tiles have."""
    side = block.side
    (key, at, w), (key2, at2, w2) = ((cell // side, cell % side, value) for cell, value in (left, right))
    many, many2 = np.bincount(key, minlength=side), np.bincount(key2, minlength=side)
    both = (many > 0) & (many2 > 0)
    if not both.any():
        return
    (key, at, w), (key2, at2, w2) = ((x, y, z) if (own := both[x]).all() else (x[own], y[own], z[own]) for x, y, z in ((key, at, w), (key2, at2, w2)))
    many, many2, place = many[both], many2[both], np.cumsum(both) - 1
    k, k2 = place[key], place[key2]
    rows, r = np.unique(at, return_inverse=True)
    cols, c = np.unique(at2, return_inverse=True)
    products = int((many * many2).sum())
    # a matrix would multiply its empty cells by infinity as well
    if products * FILLED >= len(rows) * len(cols) * len(many) and np.isfinite(w).all() and np.isfinite(w2).all():
        a, b = np.zeros((len(rows), len(many))), np.zeros((len(many), len(cols)))
        a[r, k], b[k2, c] = w, w2
        value = a @ b
        # a product of zero, or one too small, has a cell as well
        a, b = np.zeros(a.shape, dtype=np.float32), np.zeros(b.shape, dtype=np.float32)
        a[r, k], b[k2, c] = 1, 1
        block.add_matrix(rows, cols, value, a @ b > 0)
        return
    step = np.cumsum(many * many2) // max(1, block.side ** 2)
    for part in np.split(np.arange(len(many)), np.flatnonzero(np.diff(step)) + 1):
        low, high = part[0], part[-1] + 1
        own = slice(*np.searchsorted(k, [low, high]))
        each = many2[k[own]]
        first = np.cumsum(many2) - many2
        other = np.repeat(first[k[own]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        block.add_list(np.repeat(at[own], each) * block.side + at2[other], np.repeat(w[own], each) * w2[other])


def block_products(batches: Iterator[pa.RecordBatch], side: int, group: int = 1) -> Iterator[pa.RecordBatch]:
    """``row, col, w`` from :func:`sent_tiles` in the order of group, key, side and block.

    The tiles of a group of one block are multiplied as they stream; those of a larger one are held, packed, until all are there.
    """
    def finished(i: int, j: int, block: Block) -> Iterator[pa.RecordBatch]:
        cell, value = block.cells()
        row, col = i * side + cell // side, j * side + cell % side
        for start in range(0, len(cell), 1 << 16):
            part = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(col[part]), pa.array(value[part])], ["row", "col", "w"])

    def of_group() -> Iterator[pa.RecordBatch]:
        for i, above in held[0].items():
            for j, below in held[1].items():
                block = Block(side)
                for k in above.keys() & below.keys():
                    _add_tiles(block, unpack_tile(above[k]), unpack_tile(below[k]))
                yield from finished(i, j, block)

    here, block, left, held = None, None, None, ({}, {})
    for batch in batches:
        for at, (i, j, k, second, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "k", "second", "block")))):
            if here != (i, j):
                if here is not None:
                    yield from of_group() if group > 1 else finished(*here, block)
                here, block, left, held = (i, j), Block(side), None, ({}, {})
            packed = _bytes(batch.column("cells"), at)
            if group > 1:
                held[second].setdefault(own, {})[k] = bytes(packed)
            elif not second:
                left = k, unpack_tile(packed)
            elif left is not None and left[0] == k:
                _add_tiles(block, left[1], unpack_tile(packed))
    if here is not None:
        yield from of_group() if group > 1 else finished(*here, block)
