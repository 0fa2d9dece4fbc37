"""Most similar vectors of every vector, by windows over shifted space-filling curves.

Each curve projects the unit vectors onto a few random directions, shifts them, and orders them along a Hilbert
curve.  The order is cut into ranges that Spark distributes.  Each vector is compared, by exact cosine, with all
vectors within a window of its place, in its own range and in those beside it.  Curves with other directions and
shifts meet the pairs that one curve tears apart; the best of all windows are merged and ranked.

How wide the window is follows from the data and the recall asked for.  The true neighbours of a bounded sample are found by comparing
it with all rows; the window is the distance along their nearest curve that so large a share of them keeps.
Vectors with structure need a narrow one, however many they are; vectors without any need a share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Curves, directions per curve, bits per direction, and the narrowest window (rows on either side).
CURVES, DIMENSIONS, BITS, LEAST_WINDOW = 12, 6, 10, 64
#: Vectors in one range of a curve, about; more once the curves' sample has fewer than PER_RANGE keys for a range.
RANGE, PER_RANGE = 8_000, 50
#: Rows, at most about, whose keys fit the places along the curves, and rows whose true neighbours fit the window.
PLACED_SAMPLE, TRUE_SAMPLE = 100_000, 500
#: Queries compared at a time.
STEP = 256

def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows of ``grid``, each below 2**bits).

    The transposed index is undone bit plane by bit plane: exchange or invert the lower bits, then Gray decode.
    """
    x = grid.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve(i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions and the shift of curve ``i``; fixed, so that a lost task repeats them."""
    rng = np.random.default_rng(1000 + i)
    basis, _ = np.linalg.qr(rng.standard_normal((width, DIMENSIONS)))
    return basis.astype(np.float32), rng.random(DIMENSIONS).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, version: str, vector: str = "embedding", width: int = 64) -> DataFrame:
    """id and unit vector of each id with a usable vector: ``width`` finite elements, not all zero.

    Of several usable rows of an id the one with the largest ``version`` counts, a null one being the smallest; null ids are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b[2]
            fits = np.flatnonzero((v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width) & ~np.asarray(b[0].is_null()))
            flat = v.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            fine = np.isfinite(flat).all(1) & (flat != 0).any(1)  # a null element reads as not a number
            flat, fits = flat[fine], pa.array(fits[fine])
            big = np.abs(flat).max(1, keepdims=True) if len(flat) else np.ones((0, 1))
            unit = flat / big  # so that squares neither vanish nor overflow
            unit = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b[0].take(fits), b[1].take(fits), _lists(unit)], names=["id", "version", "unit"])

    columns = vectors.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(version).cast("long"), F.lit(-(1 << 63))).alias("version"), F.col(vector).cast("array<double>").alias("unit"))
    return columns.mapInArrow(run, "id string, version long, unit array<float>").groupBy("id").agg(F.max_by("unit", "version").alias("unit"))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def keys_of(x: np.ndarray) -> list[np.ndarray]:
    """The key of each row of ``x`` on each curve."""
    out, spread = [], 6 / np.sqrt(x.shape[1])  # three deviations to either side, if directions are alike
    for i in range(CURVES):
        basis, shift = curve(i, x.shape[1])
        at = (x @ basis) / spread / 2 + 0.25 + shift / 2
        out.append(hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))
    return out


class Places:
    """Places along the curves, as shares of all rows, from the sorted keys of a sample.

    Rows of one key are spread over its places by a hash of their class, so that no place is crowded.
    """

    def __init__(self, sample: list[np.ndarray]) -> None:
        self.sample = sample

    def of(self, i: int, keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
        s = self.sample[i]
        lo, hi = np.searchsorted(s, keys, "left"), np.searchsorted(s, keys, "right")
        u = (classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        # between two keys of the sample by the distance to them
        below = s[np.maximum(lo - 1, 0)].astype(np.float64)
        above = s[np.minimum(lo, len(s) - 1)].astype(np.float64)
        inside = np.where(above > below, np.clip((keys - below) / np.maximum(above - below, 1), 0, 1), 0.5)
        return np.where(hi > lo, lo + 1 + u * (hi - lo), lo + inside) / (len(s) + 2)


def _sample(classes: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About ``most`` rows of ``classes``, or all if there are fewer; the same on every run."""
    return classes if n <= most else classes.where(F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                keys = keys_of(_matrix(b[0], width))
                yield pa.RecordBatch.from_arrays([pa.array([k.astype("<i8").tobytes() for k in keys]), pa.array(range(CURVES), pa.int32())], names=["keys", "curve"])

    return run


def _true_neighbours(asked: np.ndarray, own: np.ndarray, k: int, floor: float):
    """The best ``k`` of each partition for each sampled row, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = asked.shape[1]
        score, other, unit = np.full((len(asked), k), -2.0, np.float32), np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k, width), np.float32)
        for b in batches:
            if not len(b):
                continue
            ids, x = b[0].to_numpy(), _matrix(b[1], width)
            s = np.concatenate([score, np.where(ids[None, :] == own[:, None], np.float32(-2), asked @ x.T)], 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            new, row = top >= k, np.arange(len(asked))[:, None]
            at = np.maximum(top - k, 0)
            score = np.take_along_axis(s, top, 1)
            other = np.where(new, ids[at], other[row, np.minimum(top, k - 1)])
            unit = np.where(new[:, :, None], x[at], unit[row, np.minimum(top, k - 1)])
        q, j = np.nonzero(score >= max(floor, -1.5))
        if len(q):
            keys = np.stack(keys_of(unit[q, j]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(other[q, j]), pa.array(score[q, j].astype(np.float64)), _lists(keys)], names=["q", "other", "cosine", "keys"])

    return run


def fit(classes: DataFrame, n: int, k: int, floor: float, recall: float, width: int) -> tuple[Places, float]:
    """The places along the curves, and the window, in rows, that keeps ``recall`` of a sample's true neighbours."""
    held = _sample(classes, n, PLACED_SAMPLE, 1).select("unit").mapInArrow(_keys(width), "keys binary, curve int").collect()
    places = Places([np.sort(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["keys"], "<i8") for r in held if r["curve"] == i)])) for i in range(CURVES)])
    rows = _sample(classes, n, TRUE_SAMPLE, 2).select("class", "unit").orderBy(F.xxhash64("class", F.lit(2))).limit(2 * TRUE_SAMPLE).collect()
    own, asked = np.array([r["class"] for r in rows], np.int64), np.array([r["unit"] for r in rows], np.float32).reshape(-1, width)
    if not len(own):
        return places, LEAST_WINDOW
    found = classes.select("class", "unit").mapInArrow(_true_neighbours(asked, own, k, floor), "q int, other long, cosine double, keys array<long>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k).collect()
    if not best:
        return places, LEAST_WINDOW
    mine, q, other = keys_of(asked), np.array([r["q"] for r in best]), np.array([r["other"] for r in best], np.int64)
    away = [np.abs(places.of(i, mine[i], own)[q] - places.of(i, np.array([r["keys"][i] for r in best], np.int64), other)) for i in range(CURVES)]
    return places, max(LEAST_WINDOW, float(np.quantile(np.min(away, 0), recall, method="higher")) * n)


def _deal(places_bc, n: int, size: float, window: float, width: int):
    """Sends each (class, unit, asked) of each curve to the pairs (range, asking range) that its window touches.

    Role 1 is a row that may be found, 2 one that asks, 3 both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = places_bc.value
        last = int(n // size)
        for b in batches:
            if not len(b):
                continue
            ids, asks = b[0].to_numpy(), b[2].to_numpy(zero_copy_only=False)
            for i, keys in enumerate(keys_of(_matrix(b[1], width))):
                pos = places.of(i, keys, ids) * n
                own = np.minimum(pos // size, last).astype(np.int64)
                lo, hi = np.maximum((pos - window) // size, 0).astype(np.int64), np.minimum((pos + window) // size, last).astype(np.int64)
                each = hi - lo + 1
                row = np.repeat(np.arange(len(ids)), each)
                beside = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + lo[row]
                inside = beside == own[row]
                query = asks[row] & ~inside
                rows = np.concatenate([row, row[query]])
                found_in, asked_by = np.concatenate([own[row], beside[query]]), np.concatenate([beside, own[row][query]])
                role = np.concatenate([np.where(inside & asks[row], 3, 1), np.full(int(query.sum()), 2)]).astype(np.int8)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), i, np.int32)), pa.array(found_in), pa.array(asked_by), pa.array(role), pa.array(pos[rows]), b[0].take(at), b[1].take(at)],
                    names=["curve", "found_in", "asked_by", "role", "pos", "class", "unit"],
                )

    return run


_DEALT = "curve int, found_in long, asked_by long, role tinyint, pos double, class long, unit array<float>"


def _compare(k: int, window: float, floor: float, width: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role, pos, ids = t["role"].to_numpy(), t["pos"].to_numpy(), t["class"].to_numpy()
        x = _matrix(t["unit"].combine_chunks(), width)
        o = np.lexsort((ids, pos))
        d, q = o[role[o] & 1 > 0], o[role[o] & 2 > 0]
        out: list[tuple] = []
        for i in range(0, len(q), STEP):
            c = q[i : i + STEP]
            a, z = np.searchsorted(pos[d], (pos[c[0]] - window, pos[c[-1]] + window))
            near = d[a:z]
            if not len(near):
                continue
            s = x[c] @ x[near].T
            s[ids[c][:, None] == ids[near][None, :]] = -2.0
            some = np.flatnonzero(s.max(1) >= max(floor - 1e-6, -1.5))
            c, s, m = c[some], s[some], min(k, len(near))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            r, j = np.repeat(np.arange(len(c)), m), top.ravel()
            keep = s[r, j] >= max(floor - 1e-6, -1.5)
            r, j = c[r[keep]], near[j[keep]]
            exact = np.einsum("ij,ij->i", x[r].astype(np.float64), x[j].astype(np.float64))
            out.append((ids[r][exact >= floor], ids[j][exact >= floor], exact[exact >= floor]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"class": cols[0], "near": cols[1], "cosine": cols[2]})

    return run


def nearest(units: DataFrame, k: int = 5, floor: float = -1.0, width: int = 64, recall: float = 0.95, queries: DataFrame | None = None) -> DataFrame:
    """The ``k`` most similar others of each id: id, other, cosine, rank.

    ``units``: id STRING and unit ARRAY<FLOAT> of length one, as :func:`usable` gives.  Pairs below ``floor`` are left
    out.  ``recall``: the share of the true neighbours (of those above ``floor``) to find, by which the window is fitted
    on a sample.  With ``queries`` (id) only these ids get neighbours, out of all rows, in the same way.

    Equal vectors are one class: a class enters the curves once, and a member's neighbours are other members first, then
    those of near classes, each class with at most k + 1 smallest ids, which is all that k neighbours can come
    from.  Ties go to the smaller id.  An id is no neighbour of itself; an empty table gives an empty result.
    """
    units = units.select("id", "unit").withColumn("class", F.xxhash64("unit"))
    classes = units.groupBy("class").agg(F.min("id").alias("id"), F.first("unit").alias("unit"), F.count("*").alias("members"))
    members = units.select("class", "id")
    if queries is None:
        classes = cut(classes.withColumn("asked", F.lit(True)), "classes")
    else:
        members = cut(members.join(queries.select("id").distinct(), "id", "left_semi").select("class", "id"), "asked")
        classes = cut(classes.join(members.select("class").distinct().withColumn("asked", F.lit(True)), "class", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "classes")
    n = classes.count()
    places, window = fit(classes, n, k, floor, recall, width)
    size = max(RANGE, n * PER_RANGE / PLACED_SAMPLE)
    dealt = classes.select("class", "unit", "asked").mapInArrow(_deal(classes.sparkSession.sparkContext.broadcast(places), n, size, window, width), _DEALT)
    near = dealt.groupBy("curve", "found_in", "asked_by").applyInArrow(_compare(k, window, floor, width), "class long, near long, cosine double").dropDuplicates(["class", "near"])
    by_class = Window.partitionBy("class").orderBy(F.desc("cosine"), "near")
    near = cut(near.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k).drop("r"), "near")
    # at most k + 1 members of a class can be anybody's neighbours
    first = units.join(classes.where("members > 1").select("class"), "class", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1).select("class", F.col("id").alias("other"))
    single = classes.where("members = 1").select("class", F.col("id").alias("other"))
    shown = cut(first.union(single), "shown")
    copies = members.join(shown, "class").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
    others = members.join(near, "class").join(shown.withColumnRenamed("class", "near"), "near").select("id", "other", "cosine")
    ranked = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return copies.where(F.lit(floor) <= 1).union(others).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
