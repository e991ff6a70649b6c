"""Language identification by the nearest of several centroids per language.

A text becomes a hashed vector of letter n-grams, weighted by TF-IDF and normalised. Each
language has a few centroids (spherical k-means over a bounded sample of labelled texts);
the prediction is the language of the centroid of largest cosine, and texts too far from
every centroid are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.session import stored

from .memory import bound_batches, tidy

UNKNOWN = "und"
#: Lengths that rejection tells apart.
CLASSES = 7
#: Share of a sample that may be junk under its language's label.
FEW = 0.02
_LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Model:
    langs: list[str]  #: of each centroid
    centroids: np.ndarray  #: a row each, normalised
    idf: np.ndarray
    floors: np.ndarray  #: of each centroid and length, the cosine under which a text is rejected


def counts(text: str | None, bits: int) -> np.ndarray | None:
    """Hashed counts of the byte 2- and 3-grams within the lower-cased words; None without a letter."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return None
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    two = data[:-1] << np.uint32(8) | data[1:]
    three = two[:-1] << np.uint32(8) | data[2:]
    codes = np.concatenate([two | np.uint32(1 << 24), three])
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits).astype(np.float32)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the texts that are farthest from those taken before."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    centres = x[start]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    return centres


def _length_class(text: str | None) -> int:
    """The number of binary digits of the number of words, CLASSES - 1 at most: rejection asks more of longer texts."""
    return min(CLASSES - 1, len((text or "").split()).bit_length())


def _smallest(rows: DataFrame, per_lang: int, buckets: int = 64) -> DataFrame:
    """(lang, h) of the per_lang distinct smallest hashes of each language; first within buckets of the hash, so that no task gets a language's rows."""
    first = rows.select("lang", "h").distinct().selectExpr("lang", "h", f"row_number() OVER (PARTITION BY lang, pmod(h, {buckets}) ORDER BY h) AS k").where(F.col("k") <= per_lang)
    return first.selectExpr("lang", "h", "row_number() OVER (PARTITION BY lang ORDER BY h) AS k").where(F.col("k") <= per_lang).select("lang", "h")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, clusters: int = 4, bits: int = 12, slack: float = 0.6) -> Model:
    """Fit on a bounded sample: of each language the per_lang distinct texts of smallest hash.

    Rows with a null text or language, or without a letter, are left out; every other language is learned,
    each in a task of its own. The driver gets, for each language, clusters vectors of 2**bits numbers.
    A language's floors, the cosines of rejection by length, are slack times the cosine to its own centroids
    that all but FEW of the beginnings of its sample texts of that length reach.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    taken = stored(_smallest(rows, per_lang), "lang-taken")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(lang, h, x.tobytes(), " ".join(t.split()[: 1 << CLASSES])) for lang, h, t in zip(batch["lang"], batch["h"], batch["text"], strict=True) if (x := counts(t, bits)) is not None]
            yield pd.DataFrame(made, columns=["lang", "h", "x", "head"])

    # at most per_lang rows a language, and few languages
    sample = stored(rows.join(F.broadcast(taken), ["lang", "h"]).mapInPandas(tidy(vectors), "lang string, h long, x binary, head string").dropDuplicates(["lang", "h"]), "lang-sample")

    def seen_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for x in batch["x"]:
                n, seen = n + 1, seen + (np.frombuffer(x, dtype=np.float32) > 0)
        yield pd.DataFrame({"n": [n], "seen": [seen.tobytes()]})

    parts = sample.select("x").mapInPandas(tidy(seen_in), "n long, seen binary").collect()  # one row a partition
    seen = sum((np.frombuffer(r["seen"], dtype=np.int64) for r in parts), np.zeros(1 << bits))
    idf = (np.log((1 + sum(r["n"] for r in parts)) / (1 + seen)) + 1).astype(np.float32)

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        centres = _cluster(weigh(np.stack([np.frombuffer(x, dtype=np.float32) for x in group["x"]]), idf), clusters).astype(np.float32)
        near: list[list[float]] = [[] for _ in range(CLASSES)]
        for head in group["head"]:
            words = head.split()
            for n in {min(len(words), 1 << k) for k in range(CLASSES)}:
                x = counts(" ".join(words[:n]), bits)
                if x is not None:
                    near[_length_class(" ".join(words[:n]))].append(float((centres @ weigh(x, idf)).max()))
        floors = np.array([np.quantile(x, FEW) if x else 1.0 for x in near])
        # a longer text must not be asked for less than a shorter one, and a length unseen asks as the next
        floors = slack * np.minimum.accumulate(floors[::-1])[::-1]
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centres": [centres.tobytes()], "floors": [floors.tolist()]})

    found = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, centres binary, floors array<double>").collect(), key=lambda r: r["lang"])
    if not found:
        return Model([], np.zeros((0, 1 << bits), np.float32), idf, np.zeros((0, CLASSES)))
    centres = [np.frombuffer(r["centres"], dtype=np.float32).reshape(-1, 1 << bits) for r in found]
    repeat = [len(c) for c in centres]
    return Model([r["lang"] for r, k in zip(found, repeat, strict=True) for _ in range(k)], np.concatenate(centres), idf, np.repeat(np.array([r["floors"] for r in found]), repeat, axis=0))


def judge(texts: list[str | None], m: Model) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each text."""
    bits = m.centroids.shape[1].bit_length() - 1
    langs, scores, rejected = [], [], []
    for k in range(0, len(texts), 256):
        made = [counts(t, bits) for t in texts[k : k + 256]]
        known = [i for i, x in enumerate(made) if x is not None and len(m.langs)]
        cosines = weigh(np.stack([made[i] for i in known]), m.idf) @ m.centroids.T if known else np.zeros((0, 1))
        best = dict(zip(known, cosines.argmax(axis=1), strict=True))
        top = dict(zip(known, cosines.max(axis=1), strict=True))
        for i in range(len(made)):
            langs.append(m.langs[best[i]] if i in best else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, top[i]))) if i in top else 0.0)
            rejected.append(bool(i not in top or top[i] < m.floors[best[i], _length_class(texts[k + i])]))
    return langs, scores, rejected


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) of every row, from its whole text alone.

    score is the cosine to the nearest centroid (0 to 1; equal cosines: the language first in
    order). A text that is null or without a letter is `und`, score 0, rejected; so is every
    text if the model has no language. A text under the floor of its nearest centroid for its length keeps that
    language and is rejected; a long text in a language that was not learned is, one of a word or two may not be. The model (a bounded number of centroids) is broadcast.
    Texts of any length are read whole, repeated rows give repeated results, no rows give none, and other columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores, rejected = judge(batch["text"].tolist(), shared.value)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": langs, "score": scores, "rejected": rejected})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(tidy(run), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not rejected; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in judge(batch.column(text_col).to_pylist(), shared.value)[2]], type=pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """The fold that the query must not learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
