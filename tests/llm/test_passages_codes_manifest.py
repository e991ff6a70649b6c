"""Repeated passages, vector codes and the Merkle manifest against brute force and SQL, on given and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, manifest, queries, repeats

SF01 = "/root/testdata/sf0.01"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_substring_dedup", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF01}/{t}.parquet'")
    theirs = con.sql(queries.ORACLE_SQL[name])
    ours = queries.QUERIES[name](spark, SF01).select(*theirs.columns)
    assert Counter(map(tuple, ours.collect())) == Counter(theirs.fetchall())


# 12: repeated passages
def plain_removal(rows, words):
    split = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, ws in split:
        for k in range(len(ws) - words + 1):
            key = tuple(ws[k : k + words])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, ws in split:
        gone = [False] * len(ws)
        for k in range(len(ws) - words + 1):
            if i is not None and first[tuple(ws[k : k + words])] < i:
                gone[k : k + words] = [True] * words
        out[i, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode()] += 1
    return out


def got_removal(df, words=13):
    return Counter(map(tuple, repeats.remove_repeated_passages(df, words).select("doc_id", "n_words", "n_removed", "kept").collect()))


def test_passages_equal_brute_force_on_awkward_rows(spark, awkward, clashing, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for words in (5, 13):
        want = plain_removal(rows, words)
        assert got_removal(awkward, words) == got_removal(clashing, words) == want
    assert repeats.remove_repeated_passages(nothing).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeated_passages(nothing, 4)


def test_passages_of_few_words_overlaps_and_hot_groups(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for k in range(120)]  # every window many times, many ties
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(1000 + k, f"u{k} v{k} {passage} w{k}") for k in range(150)] + [(1000 + k, "same words " * 20) for k in range(150)]
    rows += [(7, "x " * 12), (8, "x " * 13), (9, "  ".join(["nbsp"] * 14)), (2, None), (None, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got_removal(df) == plain_removal(rows, 13)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repeats.remove_repeated_passages(df).where("doc_id between 1001 and 1003 and n_words = 43").collect()}
    assert spans == {k: [(2, 42)] for k in (1001, 1002, 1003)}


def test_passage_windows_share_their_anchor(spark):
    """Any two equal windows have one anchor at one place, wherever they stand."""
    import pyarrow as pa

    rng = random.Random(1)
    shared = " ".join(rng.choices([f"w{k}" for k in range(9)], k=13))
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 30))) + " " + shared + " " + " ".join(rng.choices("abcdef", k=rng.randint(0, 30))) for _ in range(50)]
    row, start, count, anchor, _, _ = repeats._seeds(pa.array(texts), 13)
    of = set()
    for k, t in enumerate(texts):
        at = len(t[: t.index(shared)].split())
        of.add(next(int(a) for r, s, c, a in zip(row, start, count, anchor, strict=True) if r == k and s <= at < s + c))
    assert len(of) == 1


# 11: vector codes
def plain_codes(rows, parts=8, entries=16, rounds=6):
    good = [(i, label, [math.floor(4096 * float(x)) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(good[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[best(p, c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out = [(i, label, [best(p, c[p]) for p in range(parts)]) for (i, label, _), c in zip(good, cut, strict=True)]
    sums = defaultdict(int)
    for _, label, found in out:
        sums[label] += sum(d for d, _ in found)
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    return Counter((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), sums[label], digest) for i, label, found in out)


VECTORS = "vec_id long, label int, embedding array<float>, code string, x int, id string"


def got_codes(spark, rows):
    df = spark.createDataFrame([(i, label, v, "clash", 1, "clash") for i, label, v in rows], VECTORS).repartition(3)
    return Counter(map(tuple, codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_codes_equal_brute_force_with_nulls_ties_and_large_values(spark):
    rng = np.random.default_rng(3)
    draw = lambda n, scale: [[float(np.float32(x)) for x in v] for v in rng.normal(0, scale, (n, 16))]
    rows = [(k, k % 3 if k % 7 else None, v) for k, v in enumerate(draw(60, 0.2))]
    rows += [(100 + k, 1, rows[3][2]) for k in range(5)] + [rows[4], rows[4], (None, None, rows[5][2]), (3, 2, rows[6][2])]
    rows += [(-k, 0, [0.0] * 16) for k in range(3)]  # equal entries: the lower number
    bad = [(200, 1, None), (201, 1, [None] + [0.1] * 15), (202, 1, [math.nan] * 16), (203, 1, [math.inf] + [0.0] * 15), (204, 1, [])]
    assert got_codes(spark, rows + bad) == plain_codes(rows)
    assert got_codes(spark, rows[:5]) == plain_codes(rows[:5])  # fewer vectors than entries
    large = [(k, 0, v) for k, v in enumerate(draw(30, 30000.0))]  # squares beyond what a double holds exactly
    assert got_codes(spark, large) == plain_codes(large)
    assert not got_codes(spark, []) and not got_codes(spark, bad)


def test_tree_finds_the_lowest_of_the_nearest():
    rng = np.random.default_rng(4)
    for _ in range(200):
        entries = rng.integers(-4, 5, (rng.integers(1, 17), 2)).tolist()
        x = rng.integers(-6, 7, (40, 2))
        number, square = codes.nearest(entries, x)
        for v, n, s in zip(x.tolist(), number, square, strict=True):
            assert (s, n) == min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(entries))


def test_decoded_vectors_are_near(spark):
    vectors = spark.read.parquet(f"{SF01}/embeddings.parquet")
    books = codes.fit(vectors)
    rows = codes.decode(codes.encode(vectors, books), books).join(vectors, "vec_id").select("error", "decoded", "embedding").collect()
    for r in rows:
        gap = sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(r["embedding"], r["decoded"], strict=True))
        assert gap == r["error"]


# 13: manifest
def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, k):
        for level in levels[:-1]:
            yield k % 2, level[k ^ 1] if k ^ 1 < len(level) else None
            k //= 2

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in langs])
    out = Counter()
    for j, g in enumerate(langs):
        for k, r in enumerate(groups[g]):
            steps = [*path(trees[g], k), *path(top, j)]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:4], r[4] + 1)) if bad else leaf(r)
            for right, other in steps:
                h = sha(h if other is None else other + h if right else h + other)
            out[r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(o for _, o in steps if o)), h, h == top[-1][0]] += 1
    return out


def got_manifest(df):
    return Counter(map(tuple, manifest.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()))


def test_manifest_equals_brute_force(spark, awkward, clashing, nothing):
    rows = [tuple(r) for r in awkward.collect()]
    want = plain_manifest(rows)
    assert got_manifest(awkward) == got_manifest(clashing) == want
    assert got_manifest(nothing) == Counter()
    assert got_manifest(nothing.sparkSession.createDataFrame(rows[:1], awkward.schema)) == plain_manifest(rows[:1])


@pytest.mark.parametrize("n", [256, 257, 600])
def test_manifest_of_several_blocks(spark, n):
    rows = [(k, f"t{k}", "en" if k % 5 else f"l{k % 25}", "s", k) for k in range(n)] + [(None, "no id", "en", None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = got_manifest(df)
    assert got == plain_manifest(rows)
    assert {r[0] for r in got if not r[-1]} == {k for k in range(n) if zlib.crc32(str(k).encode()) % 7 == 0}
