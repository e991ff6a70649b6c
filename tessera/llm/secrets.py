"""Secret scan over a trigram inverted index.

Each regex yields a Boolean query over trigrams that every match must contain. An index
shard (one Arrow batch of whole texts) has postings for the trigrams of these queries;
postings are intersected and united, and only the candidates are verified by the regex.
A rule without mandatory trigrams scans the whole shard.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .memory import bound_batches, tidy


@dataclass(frozen=True)
class Rule:
    """kind, its regex, and the least length of a group (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The three base rules, then the rules that the method adds, in the order of the result.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # greedy, so the maximal runs, as [0-9a-f]+ of 24 and more
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A trigram query: True (any text), a trigram, or ("and" | "or", queries).
Query = object


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """The query of a text that contains one of the strings; a string under three bytes asks for nothing."""
    grams = [s.encode().lower() for s in sorted(strings)]
    return _any_of([_all_of([g[i : i + 3] for i in range(len(g) - 2)]) for g in grams])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The Boolean trigram query of a regex, over its bytes with A-Z lower-cased.

    most bounds the exact strings followed at once; beyond it the query asks for less.
    """

    def walk(nodes) -> tuple[set[str] | None, Query]:
        """What the nodes match exactly (None: too many strings), and what they ask for besides."""
        exact: set[str] | None = {""}
        run: set[str] = {""}
        asked: list[Query] = []
        for op, arg in nodes:
            if op is ops.LITERAL:
                some, also = {chr(arg)}, True
            elif op is ops.SUBPATTERN:
                some, also = walk(arg[3])
            elif op is ops.BRANCH:
                each = [walk(x) for x in arg[1]]
                some = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
                also = True if some is not None else _any_of([q if s is None else _of_strings(s) for s, q in each])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                low, high, inner = arg
                some, also = walk(inner)
                if (low, high) == (0, 1) and some is not None:
                    some = some | {""}
                elif not (low == high == 1):
                    also = (also if some is None else _of_strings(some)) if low else True
                    some = None
            elif op is ops.AT:
                some, also = {""}, True
            else:
                some, also = None, True
            asked.append(also)
            if some is None or len(run) * len(some) > most:
                asked += [_of_strings(run), True if some is None else _of_strings(some)]
                exact, run = None, {""}
            else:
                run = {a + b for a in run for b in some}
                exact = run if exact is not None else None
        if exact is None:
            asked.append(_of_strings(run))
        return exact, _all_of(asked)

    exact, asked = walk(parser.parse(pattern))
    return asked if exact is None else _of_strings(exact)


def trigrams_of(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(trigrams_of, query[1]))


class Shard:
    """The inverted index of some texts: trigram to the sorted numbers of its texts."""

    def __init__(self, texts: list[str], trigrams: set[bytes]):
        self.n = len(texts)
        self.postings: dict[bytes, np.ndarray] = {g: np.empty(0, dtype=np.int64) for g in trigrams}
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(e) + 1 for e in encoded])
        data = np.frombuffer(b"\xff".join(encoded).lower(), dtype=np.uint8).astype(np.int32)
        if len(data) < 3 or not trigrams:
            return
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        wanted = np.array(sorted(int.from_bytes(g, "big") for g in trigrams), dtype=np.int32)
        seen = np.zeros(1 << 24, dtype=bool) if len(codes) > 1 << 16 else None
        if seen is not None:
            seen[wanted] = True
            at = np.flatnonzero(seen[codes])
        else:
            at = np.flatnonzero(np.isin(codes, wanted))
        text_of = np.searchsorted(ends, at, side="right")
        pairs = np.unique(codes[at].astype(np.int64) << 32 | text_of)
        for g in trigrams:
            c = int.from_bytes(g, "big")
            lo, hi = np.searchsorted(pairs, [c << 32, (c + 1) << 32])
            self.postings[g] = pairs[lo:hi] & 0xFFFFFFFF

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def scan_texts(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, number of the rule, end) of each finding, sorted; code points, end exclusive."""
    queries = [trigram_query(r.pattern) for r in rules]
    shard = Shard(texts, set().union(*map(trigrams_of, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        find = rule.compiled().finditer
        for i in shard.candidates(query).tolist():
            found[i] += [(m.start(), k, m.end()) for m in find(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [sorted(x) for x in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text: (id_col, spans array<struct<kind, start, end>>) by start, then rule order.

    Of each rule: its leftmost non-overlapping matches, less those whose group is shorter than
    the rule asks. A null or empty text has no findings. Other columns are not read; repeated
    rows give repeated results. Nothing is shuffled; a shard is one batch of a partition.
    Texts of any length are read whole. Matches of two rules at one start come in the order of the rules; no rows give none.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            found = scan_texts(texts, rules)
            yield pd.DataFrame({"id": batch["id"], "spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(tidy(run), f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


