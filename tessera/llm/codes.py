"""Vector codes: each part of a vector becomes the number of the nearest entry of a codebook, found in a vantage-point tree.

All arithmetic is on integers, so that codes and codebooks are the same on every machine and in any partitioning.
A codebook has a tree for each part position: a node is an entry (the vantage point), the other entries are split into a near and a far
half, and each half keeps the least and the largest distance of its entries to the vantage point, rounded down and up. A half is
visited unless the triangle inequality shows that all of it is farther than the nearest entry found so far; distances are
rounded so that an entry at the same distance is still visited, and exact squared distances decide, of equals the lower number.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import stored

from .memory import bound_batches, tidy

#: A codebook: of each part position the entries, each a list of integers.
Codebooks = list[list[list[int]]]
_integers = np.frompyfunc(int, 1, 1)
_root = np.frompyfunc(math.isqrt, 1, 1)
_EXACT = 1 << 52


def _tree(entries: list[list[int]], numbers: list[int]) -> tuple | None:
    """(entry, near, far) of the entries numbered so; a half is (least distance rounded down, largest rounded up, tree)."""
    if not numbers:
        return None
    point = entries[numbers[0]]
    far = sorted((sum((a - b) ** 2 for a, b in zip(entries[k], point, strict=True)), k) for k in numbers[1:])
    halves = (far[: len(far) // 2], far[len(far) // 2 :])
    return numbers[0], *[(math.isqrt(h[0][0]), _up(h[-1][0]), _tree(entries, [k for _, k in h])) if h else None for h in halves]


def _up(x: int) -> int:
    """The square root, rounded up."""
    return math.isqrt(x - 1) + 1 if x > 0 else 0


def _roots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of integers, rounded down and up."""
    if x.dtype == object:
        low = _root(x)
    else:
        low = np.sqrt(x.astype(np.float64)).astype(np.int64)
        low -= low * low > x
        low += (low + 1) * (low + 1) <= x
    return low, low + (low * low < x)


def nearest(entries: list[list[int]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the number of the nearest entry and the squared distance, by branch and bound in a vantage-point tree."""
    book = np.array(entries, dtype=x.dtype)
    number, best = np.full(len(x), len(entries)), np.full(len(x), -1, dtype=x.dtype)

    def visit(node: tuple | None, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        point, near, far = node
        gap = x[rows] - book[point]
        square = (gap * gap).sum(axis=1)
        better = (best[rows] < 0) | (square < best[rows]) | ((square == best[rows]) & (point < number[rows]))
        best[rows[better]], number[rows[better]] = square[better], point
        low, high = _roots(square)
        inner = (low <= near[1]).astype(bool) if near else np.zeros(len(rows), bool)
        for one, other, ask in ((near, far, inner), (far, near, ~inner)):
            for half in (one, other):
                if half is not None and ask.any():
                    least, most, below = half
                    bound = np.maximum(low[ask] - most, least - high[ask])
                    visit(below, rows[ask][(bound <= _roots(best[rows[ask]])[1]).astype(bool)])

    visit(_tree(entries, list(range(len(entries)))), np.arange(len(x)))
    return number, best


def _parts(batch: pa.RecordBatch, parts: int, scale: int) -> np.ndarray:
    """The integers of a batch's vectors: row, part, position. Exact ones of any size where 64 bits could be too few."""
    flat = np.floor(batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    most = float(np.abs(flat).max()) if len(flat) else 0.0
    small = (2 * most + 1) ** 2 * max(1, len(flat) // max(1, len(batch))) < _EXACT
    return (flat.astype(np.int64) if small else _integers(flat)).reshape(len(batch), parts, -1)


def well_formed(vectors: DataFrame, parts: int, vector_col: str) -> DataFrame:
    """vectors without those that are null, hold a null, a NaN or an infinite component, or can't be cut into parts."""
    return vectors.where(f"size(`{vector_col}`) > 0 AND size(`{vector_col}`) % {parts} = 0 AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """The codebooks after so many rounds over all vectors; each starts as that part of the vectors of smallest id.

    A round is a scan: each task adds up the parts of each entry, and the tasks' sums are added in a tree, so the driver gets one table of
    parts x entries rows. Vectors of another length than that of the smallest id are left out, as those that well_formed leaves out.
    """
    bound_batches(vectors.sparkSession)
    good = well_formed(vectors, parts, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    order = [F.asc_nulls_last("id"), F.col("x")]
    head = good.orderBy(*order).first()
    if head is None:
        return []
    good = good.where(F.size("x") == len(head["x"]))
    first = [[math.floor(v * scale) for v in map(float, r["x"])] for r in good.orderBy(*order).limit(entries).collect()]
    width = len(head["x"]) // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        counts, sums = pickle.loads(good.select("x").mapInArrow(tidy(_sums(books, scale)), "sums binary").rdd.map(lambda r: bytes(r[0])).treeReduce(_added))
        books = [[[int(s) // int(counts[p, e]) for s in sums[p, e]] if counts[p, e] else books[p][e] for e in range(len(books[p]))] for p in range(parts)]
    return books


def _sums(books: Codebooks, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums: Any = np.zeros((*counts.shape, len(books[0][0])), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _parts(b, len(books), scale)
            if x.dtype == object and sums.dtype != object:
                sums = sums.astype(object)
            for p, entries in enumerate(books):
                number, _ = nearest(entries, x[:, p])
                for e in np.unique(number):
                    mine = number == e
                    counts[p, e] += mine.sum()
                    sums[p, e] += x[mine, p].sum(axis=0)
        yield pa.record_batch({"sums": [pickle.dumps((counts, sums))]})

    return run


def _added(a: bytes, b: bytes) -> bytes:
    (n, s), (m, t) = pickle.loads(a), pickle.loads(b)
    return pickle.dumps((n + m, s + t))


def _encoded(books: Codebooks, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(b, len(books), scale)
            found = [nearest(entries, x[:, p]) for p, entries in enumerate(books)]
            codes = np.stack([n for n, _ in found], axis=1).astype(np.uint8) if len(b) else np.zeros((0, len(books)), np.uint8)
            error = sum(d.astype(object) for _, d in found)
            yield pa.record_batch([b["id"], b["label"], pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], ["id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The code and error of each vector: vec_id, label, code (two hex digits a part), error (squared distances, summed over the parts; null beyond 64 bits).

    Left out are the vectors that fit leaves out; nothing else: repeated rows and ids, null ids and labels stay. No rows, and no codebooks, give no rows.
    """
    kinds = vectors.schema
    schema = f"id {kinds[id_col].dataType.simpleString()}, label {kinds[label_col].dataType.simpleString()}, code string, error long"
    rows = well_formed(vectors, max(1, len(books)), vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    rows = rows.where(F.size("x") == sum(len(b[0]) for b in books)) if books else rows.where("false")
    return rows.mapInArrow(tidy(_encoded(books, scale)), schema).withColumnRenamed("id", "vec_id")


def decode(codes: DataFrame, books: Codebooks, scale: int = 4096, code_col: str = "code") -> DataFrame:
    """codes with the vector that each code stands for, as column decoded."""
    entry = lambda p: F.get(F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in books[p]]), F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("decoded", F.concat(*[entry(p) for p in range(len(books))]))


def digest(books: Codebooks) -> str:
    """The SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """Codes, errors and the error of all vectors of a label: vec_id, code, error, label_error, codebooks_sha256.

    Labels are added up before they meet; null ones are one label. Sums beyond 64 bits are null.
    """
    books = fit(vectors)
    rows = stored(encode(vectors, books), "codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
