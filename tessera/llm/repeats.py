"""Repeated passages by seed and extend: winnowed anchors find where texts agree, extension both ways finds how far.

A window is a run of consecutive words. Its anchor is the k-gram of least hash in it, which depends on the window's
words alone; with k + w - 1 words a window, every two equal windows have the same anchor at the same place. Windows of a
text that share an anchor form a run, and each run is one seed. Three steps, none of which makes pairs:

- Seeds: anchors that occur under two ids. The first and last id of an anchor are found by a grouping that starts in the map tasks.
- Extension: of a seed, the words to the left and the right as far as the run goes. Runs with the same anchor and words form a class, known
  by its smallest id, so thousands of copies are one row. A class gives a row for each of its windows; the smallest
  id of a window is the smallest among all classes that have it, whatever the rest of their words.
- Maximal repeats: windows that a smaller id has are covers; covers that touch are one span.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.session import discard, stored

from .memory import bound_batches, shuffles_deleted, tidy

#: Words of an anchor.
ANCHOR = 5
_MOST_WORDS = 1 << 20
_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """x with all its bits spread over all others (x is overwritten)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(by)
    x ^= x >> np.uint64(29)
    return x


def _runs_of_words(x: np.ndarray, n: int, shift: int, by: int) -> np.ndarray:
    """The hash of each run of n words."""
    out = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        out += _SALT[shift + k] * x[k : len(x) - n + 1 + k]
    return _mixed(out, by)


def _first_least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each n neighbours is, the first of equals: neighbourhoods double until n is reached."""
    value, place, width = x, np.arange(len(x), dtype=np.int64), 1
    while width < n:
        step = min(width, n - width)
        later = value[step:] < value[: len(value) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        value = np.minimum(value[step:], value[: len(value) - step])
        width += step
    return place


def _seeds(texts: pa.Array, words: int, windows: bool = True) -> tuple[np.ndarray, ...]:
    """Of a batch's texts: row, first window (word number), windows and anchor of each run; if asked, the hashes of all windows; and where each run's first is among them."""
    if len(_HASHES) > _MOST_WORDS:
        _HASHES.clear()
    split = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    x = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(split)), np.uint64, sizes.sum())
    if len(x) < words:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), none
    ends = np.cumsum(sizes)
    anchors = _runs_of_words(x, ANCHOR, 0, 0x9E3779B97F4A7C15)
    place = _first_least(anchors, words - ANCHOR + 1)
    at = np.arange(len(place))
    row = np.repeat(np.arange(len(split)), sizes)[: len(place)]
    inside = at + words <= ends[row]
    at, row, place = at[inside], row[inside], place[inside]
    whole = _runs_of_words(x, words, 100, 0xD6E8FEB86659FD93) if windows else x[:0]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(at)])
    return row[first], at[first] - (ends - sizes)[row[first]], count, anchors[place[first]].view(np.int64), whole, at[first]


def _anchors(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, _, anchor, _, _ = _seeds(b["text"], words, windows=False)
            keys = pa.table({"row": row, "anchor": anchor}).group_by(["row", "anchor"]).aggregate([]).sort_by("row")
            yield pa.record_batch({"anchor": keys["anchor"].combine_chunks().cast(pa.int64()), "id": b["id"].take(keys["row"].combine_chunks()), "digest": b["digest"].take(keys["row"].combine_chunks())})

    return run


def _extended(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, count, anchor, whole, at = _seeds(b["text"], words)
            shared = b["anchors"].flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(b)), np.diff(b["anchors"].offsets.to_numpy()))
            marked = lambda anchors, rows: anchors + rows * -7046029254386353131  # noqa: E731  a run let through by chance meets nothing later
            keep = np.isin(marked(anchor, row), marked(shared, of))
            row, start, count, anchor, at = (v[keep] for v in (row, start, count, anchor, at))
            each = np.repeat(at - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            context = _mixed(whole[at] * _SALT[250] + whole[at + count - 1] * _SALT[251] + count.astype(np.uint64) * _SALT[252], 0xA0761D6478BD642F)
            windows = pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), whole[each].view(np.int64))
            yield pa.record_batch({"anchor": anchor, "context": context.view(np.int64), "id": b["id"].take(pa.array(row)), "digest": b["digest"].take(pa.array(row)), "start": start, "windows": windows})

    return run


def _cut(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"n_words": [], "n_removed": [], "kept": [], "spans": []}
            for text, starts in zip(b["text"], b["starts"], strict=True):
                ws = text.as_buffer().to_pybytes().split() if text.is_valid else []
                spans: list[list[int]] = []
                for s in sorted(starts.as_py() or []):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = s + words
                    else:
                        spans.append([s, s + words])
                kept, done = [], 0
                for s, e in spans:
                    kept += ws[done:s]
                    done = e
                kept += ws[done:]
                for name, value in (("n_words", len(ws)), ("n_removed", len(ws) - len(kept)), ("kept", b" ".join(kept).decode()), ("spans", [{"start": s, "end": e} for s, e in spans])):
                    out[name].append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], span)], ["doc_id", *out])

    return run


def remove_repeated_passages(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that a document of smaller id has: doc_id, n_words, n_removed, kept (the other words, joined by one space), spans (start, end: word numbers, end exclusive).

    A word goes if a window of words consecutive words over it also starts in a text of smaller id. Null texts and those without a
    word have 0 words and kept ''. Texts shorter than a window stay whole. Rows without an id neither give nor lose passages; rows
    of equal id don't take from each other, and repeated rows get the same result. Texts of any length are taken whole: memory follows the longest one.
    No rows give no rows; other columns, whatever their names, are not read.

    Equality is judged by two hashes of 64 bits, of the anchor and of the window. What is shuffled: an id for each anchor, twice; the texts, twice; of shared anchors the
    runs. A frequent anchor or class is added up in the map tasks, and joined from written tables, whose large partitions Spark splits.
    """
    if not ANCHOR <= words <= 100:
        raise ValueError(f"a window has {ANCHOR} to 100 words")
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    long = texts.where("id IS NOT NULL AND text IS NOT NULL")
    with shuffles_deleted(spark):
        found = stored(long.mapInArrow(tidy(_anchors(words), _HASHES.clear), f"anchor long, id {id_type}, digest long"), "repeats-anchors")
        shared = stored(found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "repeats-shared")
        seeds = stored(found.join(shared, "anchor").groupBy("id", "digest").agg(F.collect_set("anchor").alias("anchors")), "repeats-seeds")
        discard(found)
        runs = long.join(seeds, ["id", "digest"]).select("id", "digest", "text", "anchors").mapInArrow(tidy(_extended(words), _HASHES.clear), f"anchor long, context long, id {id_type}, digest long, start long, windows array<long>")
        runs = stored(runs, "repeats-runs")
        discard(shared, seeds)
        classes = runs.groupBy("anchor", "context").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("windows").alias("windows"))
        classes = stored(classes, "repeats-classes")
        windows = classes.select("anchor", "context", "low", "high", F.posexplode("windows").alias("k", "window"))
        first = windows.groupBy("anchor", "window").agg(F.min("low").alias("first"))
        judged = windows.join(first, ["anchor", "window"]).where("first < high").groupBy("anchor", "context").agg(F.collect_list(F.struct("k", "first")).alias("firsts"))
        judged = stored(judged, "repeats-judged")
        discard(classes)
        covers = runs.join(judged, ["anchor", "context"]).select("id", "digest", F.explode(F.transform(F.filter("firsts", lambda f: f["first"] < F.col("id")), lambda f: F.col("start") + f["k"])).alias("at"))
        covers = stored(covers.groupBy("id", "digest").agg(F.collect_set("at").alias("starts")), "repeats-covers")
        discard(runs, judged)
    out = texts.join(covers, ["id", "digest"], "left").select(F.col("id").alias("doc_id"), "text", "starts")
    return out.mapInArrow(tidy(_cut(words)), f"doc_id {id_type}, n_words long, n_removed long, kept string, spans array<struct<start long, end long>>")
