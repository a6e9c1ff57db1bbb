"""The best rows for a block of queries, in numpy, over Arrow batches.

Cosines of all pairs come from a matrix product in single precision, whose error has a bound.  Whatever could be among the best by that bound is scored again in double
precision, term after term as the column expressions do it, so that scores and ties are theirs.  Distances of sign codes are exact at once.  Memory is a block's
queries with their best k and one tile of scores, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: queries and rows of a tile of scores, and pairs that are scored again at once
TILE_QUERIES, TILE_ROWS, PAIRS = 512, 8192, 65_536
#: stands for no row; a missing score is -inf and NaN is inf, as they are ordered
NOTHING = np.iinfo(np.int64).max


def matrices(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Lengths (-1 for a null vector), (rows, matrix) for each length, and the rows and places of null elements, which are 0 in the matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, held = column.flatten(), np.maximum(size, 0)
    start = np.cumsum(held) - held
    empty = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.zeros(0, np.int64)
    values = (pc.fill_null(flat, 0) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.searchsorted(start + held, empty, side="right")
    parts = []
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        parts.append((rows, values[start[rows][:, None] + np.arange(n)]))
    return size, parts, (of, empty - start[of])


def summed(terms: np.ndarray) -> np.ndarray:
    """Sums of rows, one term after the other."""
    return np.cumsum(terms, axis=1)[:, -1] + 0.0 if terms.shape[1] else np.zeros(len(terms))


@dataclass
class Vectors:
    """ids and, for each length of vector, what scoring needs; at: a row's place in the matrix of its length; size: -1 where there is no cosine; kind: rows of
    equal kinds have a score, -1 has none.  Sign codes of any vectors compare, a null element being no bit."""

    ids: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    exact: dict[int, np.ndarray]
    norm: dict[int, np.ndarray]
    unit: dict[int, np.ndarray]
    bits: np.ndarray

    @staticmethod
    def of(ids: pa.Array, column: pa.Array, signs: bool) -> Vectors:
        size, parts, (rows, places) = matrices(column)
        at, exact, norm, unit = np.zeros(len(size), np.int64), {}, {}, {}
        bits = np.zeros((len(size), -(-max(size.max(initial=0), 1) // 64)), np.uint64)
        known = size.copy()
        known[rows] = -1
        for where, m in parts:
            n = m.shape[1]
            at[where] = np.arange(len(where))
            exact[n], norm[n] = m, np.sqrt(summed(m * m))
            unit[n] = (m / np.where(norm[n] == 0, 1.0, norm[n])[:, None]).astype(np.float32)
            if signs:
                # NaN is above every number
                packed = np.packbits(~(m <= 0), axis=1, bitorder="little")
                bits.view(np.uint8)[where, : packed.shape[1]] = packed
        return Vectors(np.asarray(ids, dtype=np.int64), known, np.where(size < 0, -1, 0) if signs else known, at, exact, norm, unit, bits)

    def cosines(self, mine: np.ndarray, other: Vectors, theirs: np.ndarray) -> np.ndarray:
        """Of pairs of the same length, in double precision; NaN as inf."""
        out = np.empty(len(mine))
        for a in range(0, len(mine), PAIRS):
            i, j = mine[a : a + PAIRS], theirs[a : a + PAIRS]
            part = np.full(len(i), -np.inf)
            for n in np.unique(self.size[i]):
                same = (self.size[i] == n) & (other.size[j] == n) & (n >= 0)
                if same.any():
                    x, y = self.at[i[same]], other.at[j[same]]
                    length = self.norm[n][x] * other.norm[n][y]
                    told = summed(self.exact[n][x] * other.exact[n][y]) / np.where(length == 0, 1.0, length)
                    part[same] = np.where(np.isnan(told), np.inf, told)
            out[a : a + PAIRS] = part
        return out


@dataclass
class Best:
    """The best k rows of each query so far.  signs: by Hamming distance (keys are its negatives), with each row's cosine beside it, instead of by cosine;
    own: a query meets its own id too; gap: rows are left out that are as near as this.  lists: each query's lists; a row then meets the queries of its list."""

    queries: Vectors
    k: int
    signs: bool = False
    own: bool = False
    gap: float | None = None
    lists: dict[int, np.ndarray] | None = None
    seen: int = 0
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    beside: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.queries.ids), self.k)
        self.keys, self.ids = np.full(shape, -np.inf), np.full(shape, NOTHING)
        self.beside = np.full(shape if self.signs else (0, 0), -np.inf)

    def add(self, rows: Vectors, homes: np.ndarray | None) -> None:
        """Rows come by ascending ids: of equal distances, those before stay."""
        done = 0
        while done < len(rows.ids):
            step = min(TILE_ROWS, max(512, 4 * self.k, self.seen))
            some = np.arange(done, min(done + step, len(rows.ids)))
            done, self.seen = done + step, self.seen + step
            if self.lists is None:
                self._meet(np.arange(len(self.queries.ids)), rows, some)
            else:
                for home in np.unique(homes[some]):
                    self._meet(self.lists.get(int(home), np.zeros(0, np.int64)), rows, some[homes[some] == home])

    def _meet(self, asked: np.ndarray, rows: Vectors, some: np.ndarray) -> None:
        for n in np.unique(self.queries.kind[asked]):
            mine, fit = asked[self.queries.kind[asked] == n], (rows.kind[some] == n) & (n >= 0)
            for a in range(0, len(mine), TILE_QUERIES):
                q = mine[a : a + TILE_QUERIES]
                if fit.any():
                    (self._distances if self.signs else self._cosines)(q, rows, some[fit], n)
                if not fit.all():
                    # no score at all: the least ids, after all others
                    last = some[~fit][np.argsort(rows.ids[some[~fit]], kind="stable")][: self.k + 1]
                    self._put(np.repeat(q, len(last)), np.full(len(q) * len(last), -np.inf), rows, np.tile(last, len(q)))

    def _cosines(self, q: np.ndarray, rows: Vectors, some: np.ndarray, n: int) -> None:
        near = self.queries.unit[n][self.queries.at[q]] @ rows.unit[n][rows.at[some]].T
        # rounding to single precision, the products' and the sums'
        error = 1.01 * (n + 8) * 2.0**-24
        least = self.keys[q, -1] - error
        if np.isneginf(least).any() and len(some) > self.k:
            # the k-th best of this tile, one more for the query's own row; what may be left out does not count
            sure = near if self.gap is None else np.where(near < 1 - self.gap - 4 * error, near, -np.inf)
            least = np.maximum(least, -np.partition(-sure, self.k, axis=1)[:, self.k].astype(np.float64) - 2 * error)
        # not below, so that NaN is looked at
        i, j = np.nonzero(~(near < np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]))
        for a in range(0, len(i), 16 * PAIRS):
            mine, theirs = q[i[a : a + 16 * PAIRS]], some[j[a : a + 16 * PAIRS]]
            keys = self.queries.cosines(mine, rows, theirs)
            if self.gap is not None:
                far = (1 - keys > self.gap) & np.isfinite(keys)
                mine, theirs, keys = mine[far], theirs[far], keys[far]
            self._put(mine, keys, rows, theirs)

    def _distances(self, q: np.ndarray, rows: Vectors, some: np.ndarray, _: int) -> None:
        a, b = self.queries.bits[q], rows.bits[some]
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        off = np.zeros((len(q), len(some)), np.uint8 if width < 4 else np.int32)
        for w in range(width):
            off += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
        most = -self.keys[q, -1]
        if np.isposinf(most).any() and len(some) > self.k:
            most = np.minimum(most, np.partition(off, self.k, axis=1)[:, self.k] + 1.0)
        i, j = np.nonzero(off < np.minimum(most, 64 * width + 1).astype(np.int32)[:, None])
        self._put(q[i], -off[i, j].astype(np.float64), rows, some[j])

    def _put(self, q: np.ndarray, keys: np.ndarray, rows: Vectors, at: np.ndarray) -> None:
        if not self.own:
            other = self.queries.ids[q] != rows.ids[at]
            q, keys, at = q[other], keys[other], at[other]
        order = np.lexsort((rows.ids[at], -keys, q))
        q, keys, at = q[order], keys[order], at[order]
        touched, start, count = np.unique(q, return_index=True, return_counts=True)
        place = np.arange(len(q)) - np.repeat(start, count)
        line = np.repeat(np.arange(len(touched)), count)[place < self.k]
        q, keys, at, place = (x[place < self.k] for x in (q, keys, at, place))
        new = np.full((len(touched), self.k), -np.inf), np.full((len(touched), self.k), NOTHING)
        new[0][line, place], new[1][line, place] = keys, rows.ids[at]
        every = [np.concatenate([old[touched], one], axis=1) for old, one in zip((self.keys, self.ids), new, strict=True)]
        best = np.lexsort((every[1], -every[0]), axis=1)[:, : self.k]
        self.keys[touched], self.ids[touched] = (np.take_along_axis(x, best, axis=1) for x in every)
        if self.signs:
            beside = np.full((len(touched), self.k), -np.inf)
            beside[line, place] = self.queries.cosines(q, rows, at)
            self.beside[touched] = np.take_along_axis(np.concatenate([self.beside[touched], beside], axis=1), best, axis=1)

    def told(self) -> Iterator[pa.RecordBatch]:
        """q_id, id, score, cosine."""
        for a in range(0, len(self.queries.ids), TILE_QUERIES):
            i, j = np.nonzero(self.ids[a : a + TILE_QUERIES] != NOTHING)
            key = self.keys[a + i, j]
            beside = self.beside[a + i, j] if self.signs else key
            score = lambda x, sign=1.0: pa.array(np.where(np.isposinf(x), np.nan, sign * x), mask=np.isneginf(x), from_pandas=False)
            yield pa.RecordBatch.from_arrays([pa.array(self.queries.ids[a + i]), pa.array(self.ids[a + i, j]), score(key, -1.0 if self.signs else 1.0), score(beside)], ["q_id", "id", "score", "cosine"])


def searcher(queries: pa.Table, k: int, signs: bool, own: bool, gap: float | None):
    """A function for mapInArrow: rows of id, v (and list) to the best k rows of each query.  queries: id, v (and lists)."""
    told = queries.select(["id", "v"]).combine_chunks()
    lists = queries["lists"].to_pylist() if "lists" in queries.column_names else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = None
        if lists is not None:
            by = {}
            for i, own_lists in enumerate(lists):
                for one in own_lists:
                    by.setdefault(one, []).append(i)
            by = {one: np.array(at) for one, at in by.items()}
        best = Best(Vectors.of(told["id"], told["v"], signs), k, signs, own, gap, by)
        for b in batches:
            if b.num_rows:
                best.add(Vectors.of(b.column("id"), b.column("v"), signs), None if by is None else np.asarray(b.column("list")))
        yield from best.told()

    return search


def unit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v to dim, n, v: for each length of vector their number and the sum of the vectors scaled to length 1."""
    sums: dict[int, list] = {}
    for b in batches:
        rows = Vectors.of(np.arange(b.num_rows), b.column("v"), False)
        for n in np.unique(rows.size[rows.size >= 0]):
            at = rows.at[rows.size == n]
            one = sums.setdefault(int(n), [0, np.zeros(n)])
            one[0] += len(at)
            one[1] += (rows.exact[n][at] / np.where(rows.norm[n][at] == 0, 1.0, rows.norm[n][at])[:, None]).sum(axis=0)
    yield _sums(sums)


def merged(table: pa.Table) -> pa.Table:
    """The sums of all parts for one length of vector."""
    dim = table["dim"][0].as_py()
    total = np.array(table["v"].to_pylist(), dtype=np.float64).reshape(table.num_rows, dim).sum(axis=0)
    return pa.Table.from_batches([_sums({dim: [pc.sum(table["n"]).as_py(), total]})])


def _sums(sums: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tolist() for x in sums.values()], pa.list_(pa.float64()))], ["dim", "n", "v"])
