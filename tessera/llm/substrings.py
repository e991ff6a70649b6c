"""Removal of repeated substrings, across all documents, by suffix arrays of shards.

Every string of ``length`` bytes (a window) has an anchor: the leftmost of its 32-byte grams of
smallest hash. Equal windows have equal anchors, at the same offset. The windows of one anchor
make two segments, those that begin in the further and in the nearer half of the offsets. All
windows of a segment share a core of over half their length, so a segment needs comparing only
with those of equal core. Those are brought together, copies of a whole segment are counted and
not moved, and the distinct segments become shards whose suffix arrays show which windows start
elsewhere too. In a shard a few symbols that number the core stand for its bytes, which shortens the
text by half without changing what is equal. A shard is bounded: where more distinct segments share
a core than fit one, they are divided into narrower ranges of windows, whose cores are longer, and
those become shards in turn. At the end a range is one window and its core the window itself, so
that the segments of one core are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.session import is_empty, stored

from .memory import bound_batches, tidy
from .suffixes import repeated_starts

GRAM = 32
#: Text positions that are hashed together; a position must fit 24 bits.
PIECE = 1 << 22
#: Distinct segments of one core that one shard can hold; more are divided first.
MOST = 2000
#: Symbols of a suffix-array shard beyond which it takes no further core, and of a task.
SHARD, TASK = 1 << 19, 1 << 21
#: Windows of a range, for cores that are divided: ever fewer, down to one.
WIDTHS = (32, 4, 1)
_MASK = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: bytes) -> np.ndarray:
    n = len(data) - 7
    words = np.empty(n, dtype=np.uint64)
    for k in range(min(8, n)):
        part = np.frombuffer(data, dtype="<u8", offset=k, count=(len(data) - k) // 8)
        words[k::8] = part
    m = len(data) - GRAM + 1
    total = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        total += words[k : k + m] * np.uint64(odd)
    return _mix(total)


def _digest(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def segments(data: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the core, the anchor's position, first and last start of the windows), in text order."""
    width = length - GRAM + 1
    half = (width + 1) // 2
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[base : base + PIECE + length - 1]
        hashes = _gram_hashes(piece)
        m = len(hashes)
        keys = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        keys[:m] = hashes & ~_MASK | np.arange(m, dtype=np.uint64)
        blocks = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchors = np.minimum(behind[: m - width + 1], ahead[width - 1 : m]) & _MASK
        at = anchors.astype(np.int64)
        far = at - np.arange(len(at)) >= half
        firsts = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (far[1:] != far[:-1])) + 1]
        lasts = np.r_[firsts[1:] - 1, len(at) - 1]
        for pos, is_far, lo, hi in zip((at[firsts] + base).tolist(), far[firsts].tolist(), (firsts + base).tolist(), (lasts + base).tolist(), strict=True):
            core = data[pos - half : pos + GRAM] if is_far else data[pos : pos + length - half + 1]
            yield _digest(b"f" if is_far else b"n", core), pos, lo, hi


def _marked(docs: DataFrame, text_col: str, *others) -> DataFrame:
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(*others, text.alias("data"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("t"))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """One row per distinct segment of a text: hash, dig, t, pos, lo, hi, and how often the text has it (k)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, data in zip(batch["t"], batch["data"], strict=True):
                found: dict[tuple[int, int], list] = {}
                for h, pos, lo, hi in segments(data, length):
                    dig = _digest(data[lo : hi + length])
                    seen = found.get((h, dig))
                    if seen:
                        seen[-1].append((lo, hi + length))
                    else:
                        found[h, dig] = [h, dig, t, pos, lo, hi, [(lo, hi + length)]]
                for row in found.values():
                    rows.append((*row[:6], len(row[6]), _merged(row[6]) if len(row[6]) > 1 else []))
            yield pd.DataFrame(rows, columns=["hash", "dig", "t", "pos", "lo", "hi", "k", "again"])

    return texts.select("t", "data").mapInPandas(tidy(run), "hash long, dig long, t binary, pos long, lo long, hi long, k long, again array<array<long>>")


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _counted(rows: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """What the rows show covered (t, a, b), and the distinct segments not alone with their hash (n of them)."""
    each = stored(rows.groupBy("hash", "dig").agg(F.sum("k").alias("k"), F.min(F.struct("t", "pos", "lo", "hi")).alias("one")), f"sub-each-{name}")
    covered = rows.select("hash", "dig", "t", "lo", "hi").join(each.where("k > 1").select("hash", "dig"), ["hash", "dig"]).select("t", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    several = stored(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), f"sub-several-{name}")
    return covered, each.join(several, "hash").select("hash", "dig", "k", "n", "one.*")


def _bytes_of(parts: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The parts with their bytes, each once."""
    wanted = parts.groupBy("t").agg(F.collect_list(F.struct("hash", "dig", "n", "pos", "lo", "hi")).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p["hash"], p["dig"], p["n"], t, p["pos"], p["lo"], p["hi"], data[p["lo"] : p["hi"] + length]) for t, data, parts in zip(batch["t"], batch["data"], batch["parts"], strict=True) for p in parts]
            yield pd.DataFrame(rows, columns=["hash", "dig", "n", "t", "pos", "lo", "hi", "bytes"])

    cut = texts.join(wanted.hint("merge"), "t").select("t", "data", "parts").mapInPandas(tidy(run), "hash long, dig long, n long, t binary, pos long, lo long, hi long, bytes binary")
    return cut.groupBy("hash", "dig").agg(F.first(F.struct("n", "t", "pos", "lo", "hi", "bytes")).alias("x")).select("hash", "dig", "x.*")


def _by_suffix_arrays(parts: DataFrame, length: int) -> DataFrame:
    """(t, a, b) that the suffix arrays of shards show; the parts of a core, at [core, core_end) of their bytes, are in one shard."""

    def solve(shard: list[tuple]) -> list[tuple]:
        cores: dict[tuple, int] = {}
        numbers = [cores.setdefault((h, data[c:d]), len(cores)) for h, _, _, data, c, d in shard]
        found = repeated_starts([(data, c, d, k) for (_, _, _, data, c, d), k in zip(shard, numbers, strict=True)], len(cores), length)
        return [(x[1], x[2] + a, x[2] + b) for x, starts in zip(shard, found, strict=True) for a, b in _merged([(s, s + length) for s in starts])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("hash", "t", "lo", "bytes", "core", "core_end")
        rows = (x for b in batches for x in zip(*(b[c] for c in columns), strict=True))
        shard, size = [], 0
        for _, same in groupby(rows, key=lambda x: x[0]):
            if size > SHARD:
                yield pd.DataFrame(solve(shard), columns=["t", "a", "b"])
                shard, size = [], 0
            more = list(same)
            shard += more
            size += sum(len(x[3]) - x[5] + x[4] for x in more)
        if shard:
            yield pd.DataFrame(solve(shard), columns=["t", "a", "b"])

    # tasks are sized by their work: the default partitions follow the few bytes moved
    work = parts.agg(F.sum(F.expr("length(bytes) - core_end + core"))).first()[0] or 0
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // TASK))
    dealt = parts.select("hash", "t", "lo", "bytes", "core", "core_end").repartition(tasks, "hash").sortWithinPartitions("hash")
    return dealt.mapInPandas(tidy(run), "t binary, a long, b long")


def _ranges(parts: DataFrame, width: int, length: int) -> DataFrame:
    """The parts' windows in ranges of so many offsets from the anchor; hash names what all windows of a range share, at [core, core_end) from their first byte."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, t, pos, base, lo, hi, data in zip(*(batch[c] for c in ("hash", "t", "pos", "base", "lo", "hi", "bytes")), strict=True):
                for r in range((pos - hi) // width, (pos - lo) // width + 1):
                    first, last = max(lo, pos - r * width - width + 1), min(hi, pos - r * width)
                    core = data[pos - r * width - base : pos - r * width - width + 1 + length - base]
                    whole = data[first - base : last + length - base]
                    rows.append((_digest(b"%d,%d,%d," % (h, width, r), core), _digest(b"%d,%d," % (pos - first, pos - last), whole), t, pos, first, last, 1))
            yield pd.DataFrame(rows, columns=["hash", "dig", "t", "pos", "lo", "hi", "k"])

    return parts.mapInPandas(tidy(run), "hash long, dig long, t binary, pos long, lo long, hi long, k long")


def _range_core(width: int, length: int) -> tuple[str, str]:
    """Where the core of a range is, from the range's first byte."""
    first = f"pos - cast(floor((pos - lo) / {width}) AS bigint) * {width} - lo"
    return f"cast({first} AS int)", f"cast({first} - {width} + 1 + {length} AS int)"


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(t, a, b): byte ranges of the texts (t: digest, data) covered by strings that start elsewhere too."""
    rows = stored(_anchors(texts, length), "sub-anchors")
    twice = stored(rows.groupBy("hash").agg(F.sum("k").alias("k")).where("k > 1").select("hash"), "sub-twice")
    live = stored(rows.join(twice.hint("merge"), "hash"), "sub-live")
    own = live.where("k > 1").select("t", F.explode("again").alias("x")).select("t", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    covered, several = _counted(live.drop("again"), length, "all")
    half = (length - GRAM + 2) // 2
    far = f"pos - lo >= {half}"
    core, core_end = f"cast(IF({far}, pos - lo - {half}, pos - lo) AS int)", f"cast(IF({far}, pos - lo + {GRAM}, pos - lo + {length - half + 1}) AS int)"
    parts = stored(_bytes_of(several, texts, length).selectExpr("*", f"{core} AS core", f"{core_end} AS core_end"), "sub-parts")
    found = [own, covered, _by_suffix_arrays(parts.where(F.col("n") <= MOST), length)]
    left = parts.where(F.col("n") > MOST)
    if not is_empty(left):
        hot = stored(left.select("hash", "t", "pos", F.col("lo").alias("base"), "lo", "hi", "bytes"), "sub-hot")
        left = hot
        for width in WIDTHS:
            divided = stored(_ranges(left, width, length), f"sub-ranges{width}")
            covered, several = _counted(divided, length, f"ranges{width}")
            found.append(covered)
            if width > 1:
                core, core_end = _range_core(width, length)
                with_bytes = several.join(hot.select("t", "pos", "base", F.col("bytes").alias("all")), ["t", "pos"]).where(f"lo >= base AND hi + {length} <= base + length(all)")
                parts = stored(with_bytes.selectExpr("hash", "dig", "n", "t", "pos", "base", "lo", "hi", "all", f"substring(all, cast(lo - base AS int) + 1, cast(hi - lo AS int) + {length}) AS bytes", f"{core} AS core", f"{core_end} AS core_end"), f"sub-parts{width}")
                found.append(_by_suffix_arrays(parts.where(F.col("n") <= MOST), length))
                left = parts.where(F.col("n") > MOST).select("hash", "t", "pos", "base", "lo", "hi", F.col("all").alias("bytes"))
                if is_empty(left):
                    break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept binary, kept_sha256.

    Texts count as UTF-8 bytes, null as empty. A byte goes if a string of ``length`` bytes that
    covers it also starts anywhere else, in this or another text; strings are judged on the
    input. Texts under that length keep all; of equal texts of that length or more every copy goes
    whole. kept has the remaining bytes, which may begin or end inside a character. Repeated rows are
    copies, and an empty table gives no rows. Very long texts are read in pieces that overlap, and
    other columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    texts = _marked(docs, text_col, F.col(id_col).alias("id"))
    marks = stored(texts.select("t", F.length("data").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= length), "sub-marks")
    copied = stored(marks.groupBy("t").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")).where("copies > 1"), "sub-copied")
    spans = stored(repeated_spans(texts.select("t", "data"), length), "sub-spans").join(copied, "t", "left_anti")
    per_text = spans.groupBy("t").agg(F.collect_set(F.array("a", "b")).alias("spans"))
    gone_of = stored(per_text.union(copied.select("t", F.array(F.array(F.lit(0).cast("long"), "n_bytes")))), "sub-gone")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, data, spans in zip(batch["id"], batch["data"], batch["spans"], strict=True):
                gone = [] if spans is None else _merged(spans)
                edges = [0] + [x for s in gone for x in s] + [len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((i, len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    judged = texts.join(gone_of.hint("merge"), "t", "left").select("id", "data", "spans")
    return judged.mapInPandas(tidy(cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("id", id_col)
