"""Byte-level BPE: a segment tree over byte positions, whole texts in, ids and bytes out.

Every pre-token is a row of a matrix; its segment tree has one leaf for each byte
position. A leaf holds ``rank * size + position`` of the pair that starts there (or NONE),
so that the root names the leftmost pair of minimum rank. A merge writes three leaves
(the merged part, its dead right neighbour, its live left neighbour) and repairs their
paths to the root. numpy applies one merge to all rows of a size class at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .memory import bound_batches, tidy

#: Pre-tokens kept with their ids by a Python worker; beyond this the cache starts anew.
CACHE_TOKENS = 100_000
#: Characters encoded together: bounds a task's memory whatever the batch size.
CHUNK_CHARS = 1_000_000
#: Byte positions merged together, in as many rows as that makes.
CELLS = 500_000
NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Encodes pre-tokens by the ranks. ids equal ranks, as in rank files."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pair_keys = np.array([p for p, _ in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the parts joined, NONE where the vocabulary lacks them."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """ids of each token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(tokens)
        classes: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            whole = self.ranks.get(t)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif t:
                classes.setdefault(1 << (len(t) - 1).bit_length(), []).append(i)
        for size, members in classes.items():
            step = max(1, CELLS // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_class([tokens[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge_class(self, tokens: list[bytes], size: int) -> list[bytes]:
        n, lengths = len(tokens), np.array([len(t) for t in tokens])
        raw = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in tokens), dtype=np.uint8).reshape(n, size)
        inside = np.arange(size) < lengths[:, None]
        ids = np.full((n, size + 1), -1, dtype=np.int64)
        ids[:, :size] = np.where(inside, self.byte_ids[raw], -1)
        after = np.minimum(np.arange(1, size + 2), size)[None, :].repeat(n, 0)  # the live neighbours; column size ends a row
        before = np.arange(-1, size)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        leaf = self._rank(ids[:, :size], ids[:, 1 : size + 1])
        tree[:, size:] = np.where(leaf == NONE, NONE, leaf * size + np.arange(size))
        level = size >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        root = 1 if size > 1 else size
        rows = np.flatnonzero(tree[:, root] != NONE)
        while len(rows):
            best = tree[rows, root]
            at = best % size
            dead = after[rows, at]
            beyond, left = after[rows, dead], before[rows, at]
            ids[rows, at] = best // size
            ids[rows, dead] = -1
            after[rows, at] = beyond
            before[rows, beyond] = at
            right_rank = self._rank(ids[rows, at], ids[rows, beyond])
            tree[rows, size + at] = np.where(right_rank == NONE, NONE, right_rank * size + at)
            tree[rows, size + dead] = NONE
            has = left >= 0
            left_at = np.where(has, left, at)
            left_rank = self._rank(np.where(has, ids[rows, left_at], -1), ids[rows, at])
            tree[rows, size + left_at] = np.where(has, np.where(left_rank == NONE, NONE, left_rank * size + left_at), tree[rows, size + at])
            up = np.stack([at, dead, left_at]) + size >> 1
            while up[0, 0]:
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                up >>= 1
            rows = rows[tree[rows, root] != NONE]
        live = ids[:, :size] >= 0
        flat, ends = ids[:, :size][live].astype("<u4"), np.cumsum(live.sum(axis=1))
        return [flat[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each whole text, as bytes of little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            end, chars = k, 0
            while end < len(texts) and (end == k or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.find(t) for t in texts[k:end]]
            new = list({w for words in split for w in words if w not in self.cache})
            if len(self.cache) + len(new) > CACHE_TOKENS:
                self.cache.clear()
                new = list({w for words in split for w in words})
            self.cache.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
            known = self.cache
            out += [b"".join([known[w] for w in words]) for words in split]
            k = end
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_encoders: dict[tuple[int, str], Encoder] = {}


def _forget() -> None:
    """At the end of a task only the last vocabulary's tables stay in its worker, without pre-tokens."""
    for key in list(_encoders)[:-1]:
        del _encoders[key]
    for encoder in _encoders.values():
        encoder.cache = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, kept between its tasks."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids again.

    Returns (id_col, n_tokens long, ids binary: little-endian unsigned 32-bit, decoded binary).
    A null text counts as empty: 0 tokens, empty ids. The order of merges is tiktoken's: the
    smallest rank, leftmost of equals. Only the two named columns are read, so other columns
    and their names don't matter; repeated rows give repeated results; null ids are kept.
    The vocabulary (one file, about 1 MB) is broadcast; nothing is shuffled.
    Texts of any length are encoded whole, an Arrow batch at a time; no rows give none.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            ids = encoder.encode(["" if t is None else t for t in batch["text"]])
            yield pd.DataFrame({"id": batch["id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [encoder.decode(x) for x in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(tidy(run, _forget), f"id {kind}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


