"""Clusters of streams, similarity joins, models and tests against plain versions on small tables."""

import itertools
import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import clustering, fusion, graphs, inference, learning, similar

RNG = random.Random(11)
TOPICS = [[f"{t}{k}" for k in range(8)] for t in "abcde"]


def stream(n, seed, days=12.0, unlocated=0.2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        topic = rng.choice(TOPICS)
        words = rng.choices(topic, k=rng.randint(2, 6)) + rng.choices(["the", "of", "in"], k=3)
        place = None if rng.random() < unlocated else (23.0 + rng.choice([0, 0.02, 1.5]), 90.0 + rng.choice([0, 0.03, 2.0]))
        rows.append((k * 7 % n + 1 if n % 7 else k, rng.choice([0.0, rng.uniform(0, days * 86400)]), *(place or (None, None)), rng.uniform(0, 3), rng.choice([0, 1, None]), " ".join(words)))
    return rows


def frames(spark, rows):
    items = spark.createDataFrame(rows, "id long, t double, lat double, lon double, reach double, type long, text string").repartition(5)
    vectors = similar.weighted_terms(items, "id", F.split("text", " ")).cache()
    table = defaultdict(dict)
    for r in vectors.collect():
        table[r["id"]][r["term"]] = r["w"]
    return items, vectors, table


def cosine(a, b):
    return min(1.0, sum(w * b.get(t, 0.0) for t, w in a.items()))


def km(a, b):
    if a[2] is None or b[2] is None:
        return None
    p, q = math.radians(a[2]), math.radians(b[2])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(x, 1.0)))


def plain_online(rows, table, least):
    clusters = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        best, found = -1.0, None
        for c in clusters:
            total = 0.0
            for o in c:
                d = km(r, o)
                if abs(r[1] - o[1]) <= 48 * 3600 and (d is None or d <= 5 + min(r[4] + o[4], 300)):
                    total += cosine(table[r[0]], table[o[0]])
            if total / len(c) > best:
                best, found = total / len(c), c
        if found is not None and best >= least:
            found.append(r)
        else:
            clusters.append([r])
    return {r[0]: c[0][0] for c in clusters for r in c}


@pytest.mark.parametrize(("seed", "block", "least"), [(1, 24.0, 0.5), (2, 72.0, 0.35), (3, 1000.0, 0.5)])
def test_online_clusters_equal_a_plain_loop(spark, seed, block, least):
    rows = stream(120, seed)
    items, vectors, table = frames(spark, rows)
    found = clustering.online(clustering.items_with_terms(items, vectors), clustering.rule_links(items, vectors, least), clustering.by_mean(least), block_hours=block)
    got = {r["id"]: r["label"] for r in found.collect()}
    assert got == plain_online(rows, table, least)
    assert 5 < len(set(got.values())) < 115


def test_online_clusters_of_nothing_and_of_equal_items(spark):
    schema = "id long, t double, lat double, lon double, reach double, type long, text string"
    none = spark.createDataFrame([], schema)
    vectors = similar.weighted_terms(none, "id", F.split("text", " "))
    assert clustering.online(clustering.items_with_terms(none, vectors), clustering.rule_links(none, vectors, 0.5), clustering.by_mean(0.5)).count() == 0
    rows = [(k, 0.0, None, None, None, None, "same words here" if k else None) for k in range(40)]
    items, vectors, table = frames(spark, rows)
    found = clustering.online(clustering.items_with_terms(items, vectors), clustering.rule_links(items, vectors, 0.5), clustering.by_mean(0.5))
    assert {r["id"]: r["label"] for r in found.collect()} == {0: 0, **{k: 1 for k in range(1, 40)}}


def plain_features(r, members, table, grown):
    cos = [cosine(table[r[0]], table[m[0]]) for m in members]
    square = sum(1 + 2 * grown[m[0]] for m in members)
    centroid = sum(cos) / math.sqrt(square)
    since, age = (r[1] - max(m[1] for m in members)) / 3600, (r[1] - min(m[1] for m in members)) / 3600
    places = [(km(r, m), 1 + r[4] + m[4]) for m in members if km(r, m) is not None]
    known = [m for m in members if m[5] is not None and r[5] is not None]
    gap = (age - since) / max(len(members) - 1, 1)
    near = [math.log1p(min(d for d, _ in places)), math.log1p(min(d / s for d, s in places))] if places else [0.0, 0.0]
    return [centroid, max(cos), math.log1p(since), math.log1p(age), math.log(len(members)), float(bool(places)), *near, sum(m[5] == r[5] for m in known) / max(len(known), 1), float(not known), centroid * math.log1p(since), math.log1p(since / (gap + 1))]


def test_cluster_features_equal_plain_ones_and_those_of_the_stream(spark):
    rows = stream(70, 5)
    items, vectors, table = frames(spark, rows)
    gold = {r[0]: r[0] % 6 for r in rows}
    asked = [(r[0], c) for r in rows for c in range(6)]
    got = {(r["id"], r["cluster"]): list(r[2:]) for r in clustering.cluster_features(items.drop("text"), vectors, spark.createDataFrame(list(gold.items()), "id long, cluster long"), spark.createDataFrame(asked, "id long, cluster long")).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    frame = pd.DataFrame([{**dict(zip(("id", "t", "lat", "lon", "reach", "type"), r[:6], strict=True)), "terms": [{"term": t, "w": w} for t, w in table[r[0]].items()]} for r in order])
    m = clustering.Members(frame.astype({"lat": float, "lon": float}))
    want, streamed = {}, {}
    grown = {}
    for i, r in enumerate(order):
        before = defaultdict(list)
        for k, o in enumerate(order[:i]):
            before[gold[o[0]]].append(k)
        grown[r[0]] = sum(cosine(table[r[0]], table[order[k][0]]) for k in before[gold[r[0]]])
        for c, ks in before.items():
            if ks:
                want[r[0], c] = plain_features(r, [order[k] for k in ks], table, grown)
                streamed[r[0], c] = clustering.features_of(m, i, ks, m.cosines(i), m.km(i))
    assert got.keys() == want.keys() == streamed.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9) and streamed[k] == pytest.approx(want[k], abs=1e-9)


def test_model_clusters_equal_a_plain_loop_and_links_lose_little(spark):
    rows = stream(110, 8)
    items, vectors, table = frames(spark, rows)
    model = {"names": clustering.FEATURES, "mean": [0.0] * 12, "scale": [1.0] * 12, "coef": [6.0, 3.0, -0.3, -0.1, 0.1, 0.2, -0.4, -0.1, 0.8, 0.1, -0.2, -0.1], "intercept": -3.0}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(table), 2) if cosine(table[a], table[b]) >= 0.2]
    full = clustering.items_with_terms(items, vectors)
    run = lambda links, block: {r["id"]: r["label"] for r in clustering.online(full, spark.createDataFrame(links, "a long, b long"), clustering.by_model(model, 0.5), block_hours=block, open_hours=24 * 30.0).collect()}
    everything = list(itertools.combinations(sorted(r[0] for r in rows), 2))
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    clusters, grown = [], {}
    for r in order:  # a plain loop over all clusters
        best, found = -1.0, None
        for f, c in sorted(((plain_features(r, c, table, grown), c) for c in clusters), key=lambda x: -x[0][0])[:20]:
            p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(f, model["coef"], strict=True)) - 3.0)))
            if p > best + 1e-12:
                best, found = p, c
        grown[r[0]] = sum(cosine(table[r[0]], table[m[0]]) for m in found) if best >= 0.5 else 0.0
        if best >= 0.5:
            found.append(r)
        else:
            clusters.append([r])
    want = {r[0]: c[0][0] for c in clusters for r in c}
    assert run(everything, 48.0) == want
    linked = run(pairs, 48.0)
    assert sum(linked[k] == want[k] for k in want) >= 0.9 * len(want)


def test_decisions_are_the_same_in_any_partitioning(spark):
    rows = stream(80, 9)
    items, vectors, _ = frames(spark, rows)
    gold = spark.createDataFrame([(r[0], r[0] % 9) for r in rows], "id long, cluster long")
    near = gold.join(gold.withColumnRenamed("id", "o").withColumnRenamed("cluster", "oc"), F.abs(F.col("id") - F.col("o")) <= 2).select("id", F.col("oc").alias("cluster"), F.lit(0.5).alias("cos")).distinct()
    draw = lambda n: Counter(map(tuple, clustering.decisions(items.repartition(n), gold.repartition(n), near.repartition(n), 2, 3).collect()))
    got = draw(3)
    assert got == draw(7) and max(got.values()) == 1
    per = defaultdict(Counter)
    for i, c, y in got:
        per[i][y] += 1
        assert (i % 9 == c) == (y == 1)
    assert all(v[1] <= 1 and v[0] <= 6 for v in per.values())


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 9), (20, 10), (10, 30), (None, 1), (7, None)] + [(100 + k, 101 + k) for k in range(60)]
    got = {r["node"]: r["component"] for r in graphs.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 9, 10: 10, 20: 10, 30: 10} | {100 + k: 100 for k in range(61)}
    assert graphs.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.7, 0.95])
def test_similarity_joins_equal_all_pairs(spark, least):
    rows = [(k, " ".join(RNG.choices([f"w{j}" for j in range(25)], k=RNG.randint(1, 9)))) for k in range(90)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    terms = F.filter(F.split("text", " "), lambda w: w != "")
    vectors = similar.weighted_terms(df, "id", terms).cache()
    table = defaultdict(dict)
    for r in vectors.collect():
        table[r["id"]][r["term"]] = r["w"]
    got = {(r["a"], r["b"]): r["cosine"] for r in similar.similar_pairs(vectors, least).collect()}
    want = {(a, b): sum(w * table[b].get(t, 0.0) for t, w in table[a].items()) for a, b in itertools.combinations(sorted(table), 2)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least})
    sets = {k: set(t.split()) for k, t in rows if t}
    got = {(r["a"], r["b"]): r["jaccard"] for r in similar.similar_sets(df.select("id", F.explode(F.array_distinct(terms)).alias("term")), least).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least - 1e-9})


def test_claim_hints_chain_to_the_first(spark):
    day = lambda n: None if n is None else f"2024-01-{n:02d}"
    rows = [(1, "Flood water enters the old market", 1), (2, "Old market: flood water enters", 2), (3, "flood water enters old market square", 5), (4, "Boat sinks in river", None), (5, "fire in mill", 2), (6, "fire in mill", 2), (7, "fire at the mill today", 9)]
    rows += [(10 + k, f"fact number{k} alpha{k} beta{k}", 3) for k in range(12)]
    df = spark.createDataFrame([(i, t, day(d)) for i, t, d in rows], "id long, title string, day string").withColumn("day", F.to_date("day"))
    assert {r["id"]: r["same"] for r in similar.claim_hints(df).collect()} == {2: 1, 3: 1, 6: 5}


def test_claim_hints_equal_a_loop_and_compare_few(spark, monkeypatch):
    """Repeated and altered titles, some in common words only: the same hints as all pairs give, and few pairs of claims are compared."""
    made = {}
    monkeypatch.setattr(similar, "stored", lambda df, name: made.setdefault(name, session.stored(df, name)))
    rng = random.Random(4)
    rows = []
    for k in range(240):
        ws = list(rows[rng.randrange(k)][1]) if k and rng.random() < 0.4 else [f"w{int(rng.random() ** 2 * 150)}" for _ in range(rng.randrange(2, 12))]
        if rng.random() < 0.6:
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(150)}"
        rows.append((k, tuple(ws), None if k % 17 == 0 else rng.randrange(40)))
    df = spark.createDataFrame([(k, " ".join(ws), d) for k, ws, d in rows], "id long, title string, d int").withColumn("day", F.expr("date_add(DATE'2024-01-01', d)"))
    df_of = Counter(w for _, ws, _ in rows for w in set(ws))
    for least, days, least_words in ((0.5, 3, 3), (0.3, 5, 1), (0.8, 0, 3)):
        made.clear()
        kept = {k: (d, {w for w in ws if df_of[w] <= 24}) for k, ws, d in rows if d is not None}
        kept = {k: v for k, v in kept.items() if len(v[1]) >= least_words}
        alike = lambda x, y, least=least: len(x & y) / len(x | y) >= least - 1e-9
        up = {k: min(found) for k, (d, ws) in kept.items() if (found := [(e, j) for j, (e, vs) in kept.items() if d - days <= e and (e, j) < (d, k) and alike(ws, vs)])}
        want = {}
        for k in up:
            j = k
            while j in up:
                j = up[j][1]
            want[k] = j
        assert {r["id"]: r["same"] for r in similar.claim_hints(df.select("id", "title", "day"), least, days, least_words).collect()} == want and (want or days == 0)
        if least_words == 3:
            assert made["hint-candidates"].count() < 10 * max(len(want), 10)


def test_logistic_model_equals_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (x @ [1.0, -0.3, 4.0] + rng.normal(size=300) > 2.5).astype(int)
    rows = [(*map(float, v), 1.5, int(t)) for v, t in zip(x, y, strict=True)] + [(0.0, 0.0, 0.0, 1.5, None)]
    model = inference.fit_logistic(spark.createDataFrame(rows, "a double, b double, c double, same double, y int"), ["a", "b", "c", "same"], c=2.0)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.zeros(300), np.ones(300)]
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    beta = np.zeros(5)
    for _ in range(20000):  # gradient descent
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= 0.01 * (z.T @ (w * (p - y)) + np.r_[np.full(4, 0.5), 0] * beta)
    assert [*model["coef"], model["intercept"]] == pytest.approx(beta.tolist(), abs=1e-6)
    with pytest.raises(ValueError, match="both classes"):
        inference.fit_logistic(spark.createDataFrame([(1.0, 1)], "a double, y int"), ["a"])


def test_isotonic_steps_equal_plain_pooling(spark):
    rng = random.Random(4)
    for n, levels in ((1, 5), (200, 12), (400, 1000)):
        data = [(round(rng.random() * levels) / levels, int(rng.random() < 0.3)) for _ in range(n)]
        blocks = []
        for s in sorted({s for s, _ in data}):
            ys = [y for t, y in data if t == s]
            blocks.append([s, s, len(ys), sum(ys)])
            while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
        df = spark.createDataFrame(data, "score double, y int").repartition(6)
        steps = inference.isotonic(df)
        assert sorted(map(tuple, steps.collect())) == [tuple(map(float, b)) for b in blocks]
    asked = [(-1.0,), (2.0,), (None,), (blocks[0][1],), ((blocks[0][1] + blocks[1][0]) / 2,)]
    got = [r["p"] for r in inference.stepped(spark.createDataFrame(asked, "score double"), steps).collect()]
    first, second, last = (b[3] / b[2] for b in (blocks[0], blocks[1], blocks[-1]))
    assert got[:3] == [first, last, None] and got[3:] == pytest.approx([first, (first + second) / 2])


def test_bootstrap_covers_and_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    hits = 0
    for t in range(20):
        rows = [(t * 1000 + k, 0.0, rng.gauss(0.1, 1.0)) for k in range(150)]
        df = spark.createDataFrame(rows, "id long, a double, b double")
        got = inference.paired_bootstrap(df.repartition(3), 200, 1).first()
        assert t or got == inference.paired_bootstrap(df.repartition(7).orderBy(F.desc("id")), 200, 1).first()
        hits += got["ci_low"] <= 0.1 <= got["ci_high"]
        mean = sum(r[2] for r in rows) / 150
        assert got["ci_high"] - got["ci_low"] == pytest.approx(4 * math.sqrt(sum((r[2] - mean) ** 2 for r in rows)) / 150, rel=0.3)
    assert hits >= 17
    got = inference.paired_bootstrap(spark.createDataFrame([(1, None, 0.0)], "id long, a double, b double")).first()
    assert got["n"] == 0 and got["diff"] is None


def test_wilcoxon_equals_enumeration(spark):
    cases = {"a": [1.0, -2.0, 3.0, 4.0, -1.0, 0.0, 2.0], "b": [0.5] * 6, "c": [0.0, 0.0], "d": [-1.0], "e": [1.0, 1.0, -1.0, 2.0, 2.5, -3.0, 4.0, 4.0, 0.1]}
    got = {r["k"]: (r["n"], r["w"], r["p"]) for r in inference.wilcoxon(spark.createDataFrame([(k, d) for k, ds in cases.items() for d in [*ds, None]], "k string, d double"), "k", "d").collect()}
    for k, ds in cases.items():
        ds = [d for d in ds if d]
        ranks = [sum(abs(o) < abs(d) for o in ds) + (sum(abs(o) == abs(d) for o in ds) + 1) / 2 for d in ds]
        w = sum(r for r, d in zip(ranks, ds, strict=True) if d > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(ds))]
        p = min(1.0, 2 * sum(s <= min(w, sum(ranks) - w) for s in sums) / len(sums))
        assert got[k] == (len(ds), w, pytest.approx(p, abs=1e-9))


def plain_sensing(votes, silence, known, dependence):
    rows = [v for v in votes if v[4] is not None]
    if dependence:
        rows = [v for v in rows if not any(o[0] == v[5] and o[1] == v[1] for o in rows)]
    latest = {}
    for v in sorted(rows, key=lambda v: (v[3], v[0])):
        latest[v[2], v[1]] = v[4] > 0
    items, sources = sorted({i for _, i in latest}), sorted({s for s, _ in latest})
    q = {i: known.get(i, (sum(u for (_, j), u in latest.items() if j == i) + 1) / (sum(j == i for _, j in latest) + 2)) for i in items}
    z = {}
    for _ in range(100):
        rates = {}
        for s in sources:
            for truth in (0, 1):
                n = [1.0, 1.0, 1.0]
                for i in items:
                    w = q[i] if truth else 1 - q[i]
                    o = latest.get((s, i))
                    if o is not None or silence:
                        n[2 if o is None else 0 if o else 1] += w
                rates[s, truth] = [x / sum(n) for x in n]
        d = min(max(sum(q.values()) / len(q), 1e-3), 1 - 1e-3)
        for i in items:
            z[i] = math.log(d / (1 - d))
            for s in sources:
                o = latest.get((s, i))
                if o is not None or silence:
                    k = 2 if o is None else 0 if o else 1
                    z[i] += math.log(rates[s, 1][k] / rates[s, 0][k])
        new = {i: known.get(i, 1 / (1 + math.exp(-max(-30, min(30, z[i]))))) for i in items}
        moved = max(abs(new[i] - q[i]) for i in items)
        q = new
        if moved < 1e-6:
            break
    return z


def ballots(n=160, seed=3):
    rng = random.Random(seed)
    truth = {i: rng.random() < 0.5 for i in range(12)}
    rows = []
    for k in range(n):
        i, s = rng.randrange(12), rng.randrange(9)
        right = rng.random() < 0.55 + 0.05 * s
        vote = None if rng.random() < 0.1 else (1 if truth[i] == right else -1)
        copy = rng.randrange(k) if k and rng.random() < 0.2 else None
        rows.append((k, i, s, float(k // 2), vote, copy, "news", 0))
    return rows, {i: float(v) for i, v in truth.items() if i < 4}


VOTES = "vote_id long, item long, source long, seen double, vote int, copy_of long, source_type string, relation int"


@pytest.mark.parametrize(("silence", "supervised", "dependence"), [(True, False, False), (False, False, True), (True, True, True)])
def test_social_sensing_equals_a_dense_version(spark, silence, supervised, dependence):
    rows, known = ballots()
    votes = spark.createDataFrame(rows, VOTES).repartition(3)
    outcomes = spark.createDataFrame([(i, int(v)) for i, v in known.items()], "item long, happened int") if supervised else None
    got = {r["item"]: r["z"] for r in fusion.social_sensing(votes, silence, outcomes, dependence).collect()}
    assert got == pytest.approx(plain_sensing(rows, silence, known if supervised else {}, dependence), abs=1e-6)
    assert fusion.social_sensing(votes.where("false")).count() == 0


@pytest.mark.parametrize(("supervised", "shrink"), [(False, None), (True, None), (False, 4.0)])
def test_dawid_skene_equals_a_plain_version(spark, supervised, shrink):
    rows, known = ballots(seed=8)
    known = known if supervised else {}
    cast = [(r[1], r[2], r[4] > 0) for r in rows if r[4] is not None]
    items = sorted({i for i, _, _ in cast})
    p = {i: known.get(i, (sum(u for j, _, u in cast if j == i) + 1) / (sum(j == i for j, _, _ in cast) + 2)) for i in items}
    prior = min(max(sum(known.values()) / len(known), 0.05), 0.95) if known else 0.5
    for _ in range(50):
        n = defaultdict(lambda: [0.0] * 4)
        for i, s, u in cast:
            n[s][0] += p[i] * u
            n[s][1] += p[i]
            n[s][2] += (1 - p[i]) * (not u)
            n[s][3] += 1 - p[i]
        pool = [min(max(sum(v[a] for v in n.values()) / sum(v[a + 1] for v in n.values()), 0.05), 0.95) for a in (0, 2)]
        rate = lambda v, a: (v[a] + shrink * pool[a // 2]) / (v[a + 1] + shrink) if shrink else (v[a] + 2) / (v[a + 1] + 3)  # noqa: E731,B023
        z = {i: math.log(prior / (1 - prior)) for i in items}
        for i, s, u in cast:
            a, b = rate(n[s], 0), rate(n[s], 2)
            z[i] += math.log(a / (1 - b)) if u else math.log((1 - a) / b)
        new = {i: known.get(i, 1 / (1 + math.exp(-z[i]))) for i in items}
        moved = max(abs(new[i] - p[i]) for i in items)
        p = new
        if not known:
            prior = min(max(sum(p.values()) / len(p), 0.02), 0.98)
        if moved < 1e-6:
            break
    outcomes = spark.createDataFrame([(i, int(v)) for i, v in known.items()], "item long, happened int") if known else None
    got = {r["item"]: r["p"] for r in fusion.dawid_skene(spark.createDataFrame(rows, VOTES), known=outcomes, shrink=shrink).collect()}
    assert got == pytest.approx(p, abs=1e-4)


def test_budgets_draw_the_same_votes_in_any_partitioning(spark):
    votes = spark.createDataFrame([(k, k % 4 if k < 50 else 9) for k in range(80)], "vote_id long, item long")
    draw = lambda n, seed: set(map(tuple, inference.budgeted(votes.repartition(n), "item", "vote_id", 6, seed).select("vote_id", "item").collect()))
    assert draw(2, 1) == draw(5, 1) != draw(2, 2)
    assert Counter(i for _, i in draw(3, 1)) == {k: 6 for k in (0, 1, 2, 3, 9)}
    assert inference.budgeted(votes, "item", "vote_id", 0).count() == 80


def test_diverse_pick(spark):
    rows = [(1, k, k, f"s{k}", "big" if k < 6 else f"o{k}", k < 12) for k in range(20)] + [(1, 30, 2, "s1", "other", False), (2, 40, 1, "x", None, False), (2, 41, 1, "x", None, True)]
    got = {}
    for r in inference.diverse(spark.createDataFrame(rows, "q long, id long, rank long, story string, outlet string, bangla boolean"), "q", 8, 3).orderBy("q", "place").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == {1: [0, 1, 2, 6, 12, 13, 14, 15], 2: [40]}
    few = [(1, k, k, f"s{k}", f"o{k}", True) for k in range(6)]
    assert [r["id"] for r in inference.diverse(spark.createDataFrame(few, "q long, id long, rank long, story string, outlet string, bangla boolean"), "q", 6).orderBy("place").collect()] == list(range(6))


def test_pair_features_of_unknown_places_and_types(spark):
    rows = [(1, 0.0, 23.0, 90.0, 1.0, 0, 0), (2, 7200.0, 23.0, 90.1, None, 1, 0), (3, 0.0, None, None, 2.0, None, None)]
    items = spark.createDataFrame(rows, "id long, t double, lat double, lon double, reach double, type int, family int")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "a long, b long, cosine double")
    got = {r["b"]: list(r[2:]) for r in learning.pair_features(pairs, items).collect()}
    apart = km((0, 0, 23.0, 90.0), (0, 0, 23.0, 90.1))
    assert got[2] == pytest.approx([0.9, 1.0, math.log1p(apart), math.log1p(apart / 2), math.log1p(2), 0.0, 1.0, 0.0])
    assert got[3] == [0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    scores = learning.beside(pairs, items).select("b", learning.rule_score(F.col("cosine"), F.col("km"), F.col("reach_km"), F.col("hours")).alias("s"))
    assert {r["b"]: r["s"] for r in scores.collect()} == {2: 0.0, 3: 0.5}  # 10 km is beyond 5 and a reach of 1


def test_alike_rows_meet_in_blocks_and_are_not_rows_of_candidates(spark):
    """Frequent terms that all rows share give no table of candidates; blocks of any size find the same pairs, each once."""
    rng = random.Random(3)
    sets = {k: {f"t{rng.randrange(12)}" for _ in range(6)} | {"all"} for k in range(60)}
    rows = spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts], "id long, term string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    for block, chunk in ((7, 2), (512, 16)):
        got = [(r["a"], r["b"]) for r in similar._meeting(rows.withColumn("w", F.lit(1.0)), 0.6 - 1e-9, True, block, chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_cosines_within_clusters_come_from_blocks(spark):
    rng = random.Random(4)
    rows = {k: {f"t{rng.randrange(9)}": rng.random() for _ in range(4)} | {f"own{k}": 1.0} for k in range(40)}
    vectors = spark.createDataFrame([(k, t, w) for k, ts in rows.items() for t, w in ts.items()], "id long, term string, w double")
    members = {k: (k % 3, float(k // 4)) for k in rows}
    right = spark.createDataFrame([(k, f"c{c}", t) for k, (c, t) in members.items()], "id long, cluster string, t double")
    left = right.union(right.selectExpr("id", "'c1'", "t"))
    want = {}
    for a in rows:
        for b in rows:
            dot = sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items())
            if (members[a][0] == members[b][0] or members[b][0] == 1) and (members[b][1], b) < (members[a][1], a) and dot > 0:
                want[a, b] = dot
    for block in (3, 512):
        got = similar.cosines_within(vectors, left, right, block).collect()
        assert len(got) == len(want) and {(r["my_id"], r["id"]): round(r["cos"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_rows_that_share_common_terms_only_are_not_compared_in_full():
    """Every row has common terms of little weight and a few of its own or of a near copy; chunks and batches of any size find the same pairs, each once."""
    rng = random.Random(8)
    rows = {}
    for k in range(300):
        own = {1000 + 10 * k + j: 1.0 for j in range(6)} if k < 260 else {t: w * rng.uniform(0.8, 1.2) for t, w in rows[rng.randrange(k)].items() if t >= 1000}
        rows[k] = {t: 0.3 for t in rng.sample(range(9000, 9012), 8)} | own
    rows = {k: {t: w / math.sqrt(sum(v * v for v in x.values())) for t, w in x.items()} for k, x in rows.items()} | {300: {9001: 0.8, 9002: 0.6}, 301: {9001: 0.6, 9002: 0.8}, 302: {}}
    df = Counter(t for x in rows.values() for t in x)
    code = {t: k for k, t in enumerate(sorted((t for t in df if df[t] > 1), key=lambda t: (df[t], t)))}
    flat = sorted((k, code.get(t, -1), w) for k, x in rows.items() for t, w in x.items())
    batches = [pa.record_batch({"part": pa.array([0] * len(b), pa.int32()), "id": pa.array([e[0] for e in b]), "code": pa.array([None if e[1] < 0 else e[1] for e in b], pa.int64()), "w": pa.array([e[2] for e in b])}) for b in (flat[k : k + 37] for k in range(0, len(flat), 37))]
    want = {(a, b) for a, b in itertools.combinations(rows, 2) if sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items()) >= 0.5}
    made = list(similar._rows_of(batches, 0.5, False, 50))
    compared, got = [], []
    for at in range(0, len(made), 2):
        whole = pa.Table.from_batches(made[at : at + 2])
        (terms, start), w = similar.lists(whole["terms"]), similar.lists(whole["w"])[0]
        chunk = SimpleNamespace(value={c: whole[c].to_numpy() for c in ("id", "n", "r")} | {"terms": terms, "start": start, "w": w})
        score = lambda dot, common, qn, vn: compared.append(len(dot)) or dot
        got += [(r["a"], r["b"]) for b in similar._alike(made, f"test{at}", chunk, 0.5, score, 64, 100) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want and (300, 301) in want and len(want) > 40
    assert sum(compared) < 3 * len(want) < len(rows) ** 2 / 100


def test_cluster_features_make_no_table_of_pairs(spark, monkeypatch):
    """Chunks that split clusters give the features that one chunk gives; no table has a row for each item and member."""
    made = {}

    def kept(df, name):
        made[name] = session.stored(df, name)
        return made[name]

    monkeypatch.setattr(clustering, "stored", kept)
    monkeypatch.setattr(clustering, "discard", lambda *tables: None)
    rows = stream(60, 6)
    items, vectors, _ = frames(spark, rows)
    gold = spark.createDataFrame([(r[0], f"c{r[0] % 3}") for r in rows] + [(rows[0][0], None)], "id long, cluster string")
    asked = items.select("id").crossJoin(gold.select("cluster").distinct())
    got = [{(r["id"], r["cluster"]): list(r[2:]) for r in clustering.cluster_features(items.drop("text"), vectors, gold, asked, chunk).collect()} for chunk in (16, 32768)]
    assert got[0].keys() == got[1].keys() and len(got[0]) > 150
    assert all(got[0][k] == pytest.approx(got[1][k], abs=1e-9) for k in got[0])
    assert max(df.count() for df in made.values()) <= 60 * 3
