"""Near-duplicate components: MinHash bands find candidates, odd sketches sift, full sets decide.

An odd sketch is a bitmap in which each of a document's MinHash samples flips one bit. The
population count of the XOR of two sketches estimates how many samples differ, precisely so for
high similarities, from a few machine words.

Groups are never paired within themselves. Equal sets are one class, represented by its smallest
id. In a band bucket only a leader (its smallest class) is compared with the others; components of
the confirmed links come next; and only classes of one bucket that are still in different
components are compared with each other, for a link inside a component changes nothing.
There many pairs may lie just below the similarity asked for, so that round compares finer sketches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.session import is_empty, stored

from .components import components
from .memory import bound_batches, tidy

#: Members of one bucket that a block of the second round holds.
BLOCK = 500
#: Words whose hashes a task keeps; beyond this the cache starts anew.
CACHE_WORDS = 100_000


@dataclass(frozen=True)
class Params:
    """shingle words, similarity at least percent/100, bands x rows MinHashes (the sketch has samples of them); the finer sketch of the last round."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    samples: int = 128
    sketch_bits: int = 512
    fine_samples: int = 4096
    fine_bits: int = 4096

    def most_bits(self) -> int:
        """Bits that two sketches of similarity percent may differ in: the expectation at a similarity lower by 4.5 standard deviations."""
        s = self.percent / 100
        low = max(0.0, s - 4.5 * math.sqrt(s * (1 - s) / self.samples))
        m = self.sketch_bits
        return math.ceil(m / 2 * (1 - (1 - 2 / m) ** (2 * self.samples * (1 - low)))) + 8

    def most_fine_bits(self) -> int:
        """The same for fine sketches: 4.5 standard deviations above the expectation, those of the samples and of the bitmap together."""
        s, m = self.percent / 100, self.fine_bits
        even = (1 - 2 / m) ** (2 * self.fine_samples * (1 - s))
        by_samples = even * 2 * math.sqrt(self.fine_samples * s * (1 - s))
        return math.ceil(m / 2 * (1 - even) + 4.5 * math.sqrt(by_samples**2 + m / 4 * (1 - even**2))) + 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, cache: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased; words are runs of other bytes than space and 0x09-0x0D; a text with
    fewer words than a shingle has them all as one; without words it has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(parts).difference(cache):
        cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.array([cache[w] for w in parts], dtype=np.uint64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, len(parts) if len(parts) < words else 0, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def _keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:n, None], seed[n:, None] | np.uint64(1)


def signature(shingles: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The MinHash of each key over the set, in blocks of bounded size."""
    flip, times = keys
    best = np.full(len(flip), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 19) // len(flip))
    for k in range(0, len(shingles), step):
        best = np.minimum(best, ((shingles[None, k : k + step] ^ flip) * times).min(axis=1))
    return best


def odd_sketch(sig: np.ndarray, bits: int) -> np.ndarray:
    """The parity bitmap of the samples, as signed 64-bit words."""
    at = _mix(sig + np.arange(len(sig), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sketches(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n (set size), digest of the set, the band keys, the odd sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        keys = _keys(max(p.samples, p.bands * p.rows))
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_set(text, p.words, cache)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                sig = signature(s, keys)
                bands = np.zeros(p.bands, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64)
                for r in range(p.rows):
                    bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + sig[r : p.bands * p.rows : p.rows])
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands.view(np.int64), odd_sketch(sig[: p.samples], p.sketch_bits)))
            yield pd.DataFrame({"id": batch["id"], **{c: [o[k] for o in out] for k, c in enumerate(("n", "digest", "bands", "sketch"))}})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), "id long, n long, digest binary, bands array<long>, sketch array<long>")


def _near(p: Params):
    """Whether the sketches sa and sb allow the similarity asked for."""
    words = p.sketch_bits // 64
    return sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(1, words)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0]))) <= p.most_bits()


def _fine_sketches(sets: DataFrame, p: Params) -> DataFrame:
    """(id, fine: its fine sketch) of full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = _keys(p.fine_samples)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fine": [odd_sketch(signature(np.frombuffer(s, dtype=np.uint64), keys), p.fine_bits) for s in batch["s"]]})

    return sets.mapInPandas(tidy(run), "id long, fine array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """(id, s: the hashes of its full set) of the ids wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "s": [shingle_set(t, p.words, cache).tobytes() for t in batch["text"]]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(wanted.hint("merge"), "id").mapInPandas(tidy(run), "id long, s binary").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of the similarity asked for, by their full sets."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    with_x = pairs.join(sets.selectExpr("id AS a", "s AS x"), "a")
    return with_x.join(sets.selectExpr("id AS b", "s AS y"), "b").select("a", "b", "x", "y").mapInPandas(tidy(verify), "a long, b long")


def _sifted(pairs: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """The pairs whose sketches allow the similarity, smaller id first, each once."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    with_a = ordered.join(reps.selectExpr("id AS a", "sketch AS sa"), "a")
    return with_a.join(reps.selectExpr("id AS b", "sketch AS sb"), "b").where(_near(p)).select("a", "b")


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links of at least the similarity asked for
    (Jaccard of the shingle sets); kept says that it is the row's own id. A text that is null or
    has no words has no shingles and is alone. Rows that repeat an id are one node, with the
    union of their links. A null id is never linked: component_id null, kept true. Every link
    between sets is confirmed in full; a pair of the least similarity goes unseen by all bands
    with probability (1 - s^rows)^bands (3e-6 by default); the sketches, set 4.5 standard deviations wide, lose it about as seldom.
    Texts of any length are read whole; no rows give none; other columns, whatever their names, are not read.
    """
    p = params
    bound_batches(docs.sparkSession)
    marks = stored(sketches(docs, p, id_col, text_col), "near-marks")
    some = marks.where("n > 0 AND id IS NOT NULL")
    classes = stored(some.groupBy("digest").agg(F.min("id").alias("rep")), "near-classes")
    own = stored(some.select("id", "digest").join(classes, "digest").select("id", "rep"), "near-own")
    reps = stored(some.join(classes, "digest").where("id = rep").select("id", "bands", "sketch").dropDuplicates(["id"]), "near-reps")
    band_rows = reps.select("id", F.explode("bands").alias("bucket"))
    shared = stored(band_rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1"), "near-buckets")
    members = stored(band_rows.join(shared, "bucket"), "near-members")
    sets = stored(_sets(docs, members.select("id").distinct(), p, id_col, text_col), "near-sets")

    # first round: each class with the smallest leader of its buckets, and with that of its largest bucket
    led = members.groupBy("id").agg(F.array(F.min("leader"), F.max_by("leader", F.struct("size", "leader"))).alias("leaders"))
    pairs = led.select(F.explode("leaders").alias("a"), F.col("id").alias("b"))
    links = stored(_confirm(_sifted(pairs, reps, p), sets, p), "near-links")
    found = components(links)

    def apart(found: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
        """The buckets whose members are in several components, their largest one and their members."""
        labelled = stored(members.select("bucket", "id").join(found.selectExpr("node AS id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id")), f"near-labelled{round_}")
        parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.min_by("id", F.xxhash64("id", F.lit(round_))).alias("one"))
        whole = parts.groupBy("bucket").agg(F.count("*").alias("n_parts"), F.sum("k").alias("size"), F.max(F.struct("k", "component", "one")).alias("most")).where("n_parts > 1")
        mixed = stored(whole.selectExpr("bucket", "size", "most.component AS main", "most.one AS one"), f"near-mixed{round_}")
        return mixed, labelled.join(mixed, "bucket")

    # then each class outside its bucket's main component with some member of that, another one each round
    for round_ in (1, 2):
        mixed, rows = apart(found, round_)
        if is_empty(mixed):
            break
        one = rows.where("component <> main").groupBy("id").agg(F.min_by("one", F.xxhash64("bucket", F.lit(round_))).alias("a"))
        links = stored(links.union(_confirm(_sifted(one.selectExpr("a", "id AS b"), reps, p), sets, p)), "near-links")
        found = components(links)

    # last round: all that share a bucket and are still apart, in blocks; a pair counts in its first common bucket
    mixed, rows = apart(found, 3)
    if not is_empty(mixed):
        fine = stored(_fine_sketches(sets.join(rows.select("id").distinct(), "id"), p), "near-fine")
        rows = stored(rows.join(reps, "id").join(fine, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "near-apart")
        theirs = rows.selectExpr("bucket", "pmod(xxhash64(id), blocks) AS block", "id AS b", "component AS cb", "main AS m", "sketch AS sb", "fine AS fb", "bands AS bb")
        minor = rows.where("component <> main").selectExpr("bucket", "explode(sequence(0L, blocks - 1L)) AS block", "id AS a", "component AS ca", "sketch AS sa", "fine AS fa", "bands AS ba")
        # pairs of two minor parts come from both sides; keep the ordered one
        differ = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("m")) | (F.col("a") < F.col("b")))
        finely = F.expr(f"aggregate(zip_with(fa, fb, (x, y) -> bit_count(x ^ y)), 0, (n, k) -> n + k) <= {p.most_fine_bits()}")
        late = minor.join(theirs, ["bucket", "block"]).where(differ & _near(p) & F.expr("bucket = array_intersect(ba, bb)[0]") & finely)
        more = late.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = stored(links.union(_confirm(more, sets, p)), "near-links")
        found = components(links)

    # components of classes, and then of ids: an id that is in two classes joins them
    split = own.groupBy("id").agg(F.countDistinct("rep").alias("k")).where("k > 1")
    if is_empty(split):
        component = own.join(found.selectExpr("node AS rep", "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component")).distinct()
    else:
        found = components(links.union(own.where("id <> rep").selectExpr("rep AS a", "id AS b")).distinct())
        component = own.select("id").distinct().join(found.selectExpr("node AS id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    component = stored(component, "near-component")
    out = marks.select("id", "n").join(component, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
