"""Votes of sources about items: independent voices, rates from known outcomes, fused scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import discard, stored

# What a kind of source is trusted before anything is known of it, and the lines of the labels.
STARTING_RATES = {"field": 0.80, "public_record": 0.90, "news": 0.75, "social": 0.60, "video_platform": 0.60, "other": 0.60}
DEFAULT_RATE, STRENGTH, TYPE_PRIOR, LOW_RATE, HIGH_RATE = 0.60, 3.0, 2.0, 0.05, 0.98
HIGH, LOW, CREDIBLE = 0.80, 0.20, 0.50


def logit(p: Column, clip: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def sigmoid(z: Column, most: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), z))))


def _clamp(rate: Column) -> Column:
    return F.greatest(F.lit(LOW_RATE), F.least(F.lit(HIGH_RATE), rate))


def starting_rate(kind: Column) -> Column:
    out = F.lit(DEFAULT_RATE)
    for name, rate in STARTING_RATES.items():
        out = F.when(kind == name, rate).otherwise(out)
    return out


def latest_votes(votes: DataFrame, copies: bool = False) -> DataFrame:
    """The last vote of each source about each item (later id wins a tie); rows without a vote, and copies unless asked for, don't count."""
    rows = votes.where("vote IS NOT NULL") if copies else votes.where("vote IS NOT NULL AND copy_of IS NULL")
    last = rows.groupBy("item", "source").agg(F.max_by(F.struct("vote_id", "vote", "source_type", "relation", *[c for c in ("conflict", "stated") if c in votes.columns]), F.struct("seen", "vote_id")).alias("x"))
    return last.select("item", "source", "x.*")


def evidence_tally(votes: DataFrame) -> DataFrame:
    """Evidence about an item by relation (0 and 1 support, 2 denies, 3 and 4 are about something else), and its distinct sources."""
    about = F.col("relation") < 3
    return votes.groupBy("item").agg(F.count_if(F.col("relation") < 2).alias("n_for"), F.count_if(F.col("relation") == 2).alias("n_against"), F.count_if(~about).alias("n_other"), F.countDistinct(F.when(about, F.col("source"))).alias("n_sources"))


def equal_vote(votes: DataFrame) -> DataFrame:
    """Support minus denial of independent voices."""
    return latest_votes(votes).groupBy("item").agg(F.sum("vote").cast("long").alias("score"))


def majority(votes: DataFrame) -> DataFrame:
    """The log odds of the smoothed share of support among all votes."""
    n = votes.where("vote IS NOT NULL").groupBy("item").agg(F.count_if(F.col("vote") > 0).alias("f"), F.count("*").alias("n"))
    return n.select("item", F.round(logit((F.col("f") + 1) / (F.col("n") + 2)), 6).alias("log_odds"))


def type_rates(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """How often a kind of source was right about items whose outcome is known, shrunk towards its starting rate."""
    judged = _judged(votes, outcomes).groupBy("source_type").agg(F.sum("ok").alias("right"), F.count("*").alias("n"))
    return judged.select("source_type", "right", "n", _clamp((F.col("right") + TYPE_PRIOR * starting_rate(F.col("source_type"))) / (F.col("n") + TYPE_PRIOR)).alias("type_rate"))


def _judged(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    return latest_votes(votes).join(outcomes, "item").withColumn("ok", (F.col("vote") == F.when(F.col("happened") == 1, 1).otherwise(-1)).cast("long"))


def source_rates(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The same for each source, shrunk towards its kind's rate."""
    judged = _judged(votes, outcomes).groupBy("source", "source_type").agg(F.sum("ok").alias("right"), F.count("*").alias("n"))
    rows = judged.join(F.broadcast(type_rates(votes, outcomes).select("source_type", "type_rate")), "source_type")  # a row a kind
    return rows.select("source", "right", "n", _clamp((F.col("right") + STRENGTH * F.col("type_rate")) / (F.col("n") + STRENGTH)).alias("rate"))


def rated_votes(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Independent votes with the rate of their source, else of its kind, else where that kind starts."""
    kinds = F.broadcast(type_rates(votes, outcomes).select("source_type", "type_rate"))
    rows = latest_votes(votes).join(source_rates(votes, outcomes).select("source", "rate"), "source", "left").join(kinds, "source_type", "left")
    return rows.withColumn("rate", F.coalesce("rate", "type_rate", starting_rate(F.col("source_type")))).drop("type_rate")


def scores(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log odds of an item: each independent voice weighs as the log odds of its rate."""
    r = _clamp(F.col("rate"))
    return rated_votes(votes, outcomes).groupBy("item").agg(F.sum(F.col("vote") * F.log(r / (1 - r))).alias("z"))


def label_rule(votes: DataFrame, outcomes: DataFrame, share: float = 0.2, hours: float = 12.0) -> DataFrame:
    """The label of each item, those without a vote too: from its probability, the credible voices of both sides and the details in dispute.

    A detail is in dispute where a credible source supports in part and marks something else than the occurrence as wrong (conflict), or
    where the counts that two credible sources state within hours, none of them denying, differ by more than share of the larger.
    """
    credible = F.col("rate") >= CREDIBLE
    rated = rated_votes(votes, outcomes)
    marked = credible & (F.col("relation") == 1) & F.coalesce(F.col("conflict") != "occurrence", F.lit(False))
    sides = rated.groupBy("item").agg(F.bool_or(credible & (F.col("vote") > 0)).alias("up"), F.bool_or(credible & (F.col("vote") < 0)).alias("down"), F.bool_or(marked).alias("marked"))
    said = rated.where(credible & (F.col("vote") > 0) & F.col("stated").isNotNull()).join(votes.select("vote_id", "seen"), "vote_id").select("item", "stated", "seen")
    apart = in_dispute(said, "item", "stated", "seen", share, hours).select("item", F.lit(True).alias("apart"))
    rows = votes.select("item").distinct().join(scores(votes, outcomes).select("item", sigmoid(F.col("z")).alias("p")), "item", "left").join(sides, "item", "left").join(apart, "item", "left")
    label = (
        F.when(F.col("p").isNull(), "insufficient_evidence")
        .when((F.col("p") >= HIGH) & (F.col("marked") | F.coalesce("apart", F.lit(False))), "partially_verified")
        .when(F.col("p") >= HIGH, "verified")
        .when(F.col("p") <= LOW, "refuted")
        .when(F.col("up") & F.col("down"), "conflicting")
        .otherwise("unverified")
    )
    return rows.select("item", F.round("p", 6).alias("p"), label.alias("label"))


def rising(counts: DataFrame, now: float, share: float = 1.2, hours: float = 24.0) -> DataFrame:
    """Items whose largest count of the hours before now is more than share times the largest before: item, before, since. counts: item, at (seconds), count, credible support only; later ones don't count."""
    cut = now - hours * 3600
    per = counts.where((F.col("at") <= now) & F.col("count").isNotNull()).groupBy("item").agg(F.max(F.when(F.col("at") < cut, F.col("count"))).alias("before"), F.max(F.when(F.col("at") >= cut, F.col("count"))).alias("since"))
    return per.where(F.col("since") > F.col("before") * share)


def zone(p: Column) -> Column:
    return F.when(p.isNull(), "none").when(p >= HIGH, "yes").when(p <= LOW, "no").otherwise("open")


def check_value(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What one more field report would tell of an item: its chance of support, the chance of crossing a line, and the need for it."""
    field = F.coalesce(F.max(F.when(F.col("source_type") == "field", F.col("type_rate"))), F.lit(STARTING_RATES["field"]))
    r = type_rates(votes, outcomes).agg(field.alias("r"))  # one row
    rows = votes.select("item").distinct().join(scores(votes, outcomes), "item", "left").join(F.broadcast(r))
    step = F.log(F.col("r") / (1 - F.col("r")))
    z, p = F.coalesce("z", F.lit(0.0)), F.when(F.col("z").isNotNull(), sigmoid(F.col("z")))
    rows = rows.withColumns({"p": p, "plus": sigmoid(z + step), "minus": sigmoid(z - step)})
    chance = F.when(F.col("p").isNull(), 0.5).otherwise(F.col("p") * F.col("r") + (1 - F.col("p")) * (1 - F.col("r")))
    crosses = lambda c: (zone(F.col(c)) != zone(F.col("p"))).cast("int")
    rows = rows.withColumn("chance", chance)
    changes = F.when(F.col("p").isNull(), 1.0).otherwise(F.col("chance") * crosses("plus") + (1 - F.col("chance")) * crosses("minus"))
    unsure = F.when(F.col("p").isNull(), 1.0).otherwise(1 - F.abs(2 * F.col("p") - 1))
    return rows.select("item", F.round("chance", 6).alias("chance"), F.round(changes, 6).alias("changes"), F.round((unsure + changes) / 2, 6).alias("need"))


def roots(copies: DataFrame, node: str, origin: str) -> DataFrame:
    """(node, root): the end of each node's chain of origins, by pointer jumping: as many rounds as the longest chain or cycle has binary digits.

    An origin that is no node of the table is a root. The root of a chain that runs into a cycle is the cycle's smallest node: the node
    that is the smallest its own steps come to. It is found when the steps first go round; all whose steps have it as their smallest end there.
    """
    rows = copies.select(F.col(node).alias("node"), F.coalesce(origin, node).alias("up"))
    ends = rows.select(F.col("node").alias("up"), (F.col("up") == F.col("node")).alias("end"))
    links = stored(rows.join(ends, "up", "left").select("node", "up", F.col("up").alias("low"), F.coalesce("end", F.lit(True)).alias("done")), "roots")
    for _ in range(links.count().bit_length() + 3):
        n_open, n_heads = links.where("NOT done").agg(F.count("*"), F.count_if(F.col("low") == F.col("node"))).first()  # one row
        if not n_open:
            return links.select("node", F.col("up").alias("root"))
        if n_heads:
            heads = links.where("NOT done AND low = node").select(F.col("node").alias("low"), F.lit(True).alias("head"))
            marked = links.join(heads, "low", "left").withColumn("head", ~F.col("done") & F.coalesce("head", F.lit(False)))
            new = stored(marked.select("node", F.when(F.col("head"), F.col("low")).otherwise(F.col("up")).alias("up"), "low", (F.col("done") | F.col("head")).alias("done")), "roots")
            discard(links)
            links = new
        above = links.select(F.col("node").alias("up"), F.col("up").alias("beyond"), F.col("low").alias("low_beyond"), F.col("done").alias("ends"))
        step = links.join(above, "up", "left")
        new = stored(step.select("node", F.coalesce("beyond", "up").alias("up"), F.least("low", F.coalesce("low_beyond", "low")).alias("low"), (F.col("done") | F.coalesce("ends", F.lit(False))).alias("done")), "roots")
        discard(links)
        links = new
    raise ValueError("a node with two origins")


def independent(votes: DataFrame) -> DataFrame:
    """One vote per item and cascade of copies: its origin's if in view, else the earliest (smallest id in a tie)."""
    root = roots(votes, "vote_id", "copy_of")
    rows = votes.join(root, votes["vote_id"] == root["node"]).where("vote IS NOT NULL")
    w = Window.partitionBy("item", "root").orderBy((F.col("vote_id") != F.col("root")).cast("int"), "seen", "vote_id")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("item", "root", "vote_id", "vote", "source", "source_type")


def truthfinder(votes: DataFrame, rounds: int = 30) -> DataFrame:
    """Belief in each item from its sources' trust, and trust from agreement with the beliefs (Beta(3.5, 1.5) prior), round by round.

    Every round is two groupings of the votes; its trust is written, so that the plan stays short.
    """
    cells = stored(votes.where("vote IS NOT NULL").groupBy("item", "source").agg(F.sum("vote").cast("double").alias("net"), F.count_if(F.col("vote") > 0).cast("double").alias("f"), F.count("*").cast("double").alias("n")), "truth-cells")
    trust = None
    for k in range(rounds):
        rated = cells.withColumn("trust", F.lit(0.7)) if trust is None else cells.join(trust, "source")
        z = rated.groupBy("item").agg(F.sum(F.col("net") * logit(F.col("trust"))).alias("z"))
        if k == rounds - 1:
            return z.select("item", F.round("z", 4).alias("log_odds"))
        p = sigmoid(F.col("z"), 30.0)
        agreed = cells.join(z, "item").groupBy("source").agg(F.sum(F.col("f") * p + (F.col("n") - F.col("f")) * (1 - p)).alias("a"), F.sum("n").alias("m"))
        new = stored(agreed.select("source", ((F.col("a") + 3.5) / (F.col("m") + 5)).alias("trust")), "truth-trust")
        if trust is not None:
            discard(trust)
        trust = new


def dawid_skene(votes: DataFrame, rounds: int = 50, prior: float = 0.5, strong: float = 2.0, weak: float = 1.0, known: DataFrame | None = None, shrink: float | None = None, close: float = 1e-6) -> DataFrame:
    """Items' probabilities and sources' two rates (support if true, denial if false) by EM from the smoothed share of support, until no
    probability moves by close.

    Without known outcomes the prior is learned; known (item, happened) items keep their outcome, and the prior is theirs. With shrink the rates
    are drawn to the pooled rates of all sources by so many votes (empirical Bayes) instead of to the prior strong / (strong + weak).
    Every round is two groupings of the votes; the items' table is written, so that the plan stays short.
    """
    cells = stored(votes.where("vote IS NOT NULL").groupBy("item", "source").agg(F.count_if(F.col("vote") > 0).cast("double").alias("f"), F.count_if(F.col("vote") < 0).cast("double").alias("a")), "ds-cells")
    p = cells.groupBy("item").agg(((F.sum("f") + 1) / (F.sum(F.col("f") + F.col("a")) + 2)).alias("p"))
    p = p.withColumn("fixed", F.lit(None).cast("double"))
    if known is not None:
        prior = min(max(known.agg(F.avg("happened")).first()[0] or 0.5, 0.05), 0.95)
        p = p.drop("fixed").join(known.select("item", F.col("happened").cast("double").alias("fixed")), "item", "left").withColumn("p", F.coalesce("fixed", "p"))
    p = stored(p, "ds-p")
    for _ in range(rounds):
        both = cells.join(p, "item")
        q, n = 1 - F.col("p"), F.col("f") + F.col("a")
        rates = both.groupBy("source").agg(F.sum(F.col("p") * F.col("f")).alias("sn"), F.sum(F.col("p") * n).alias("sd"), F.sum(q * F.col("a")).alias("cn"), F.sum(q * n).alias("cd"))
        if shrink:
            pool = rates.agg(F.sum("sn"), F.sum("sd"), F.sum("cn"), F.sum("cd")).first()
            ms, mc = (min(max(x / max(y, 1e-9), 0.05), 0.95) for x, y in (pool[:2], pool[2:]))
            rate = lambda num, den, mean: (F.col(num) + shrink * mean) / (F.col(den) + shrink)
        else:
            ms = mc = strong / (strong + weak)
            rate = lambda num, den, mean: (F.col(num) + strong) / (F.col(den) + strong + weak)
        rates = rates.select("source", rate("sn", "sd", ms).alias("sens"), rate("cn", "cd", mc).alias("spec"))
        step = F.col("f") * F.log(F.col("sens") / (1 - F.col("spec"))) + F.col("a") * F.log((1 - F.col("sens")) / F.col("spec"))
        z = cells.join(rates, "source").groupBy("item").agg(F.sum(step).alias("z"))
        new = z.join(p.select("item", F.col("p").alias("was"), "fixed"), "item").select("item", F.coalesce("fixed", sigmoid(F.col("z") + float(_logit_of(prior)))).alias("p"), "fixed", "was")
        new = stored(new, "ds-p")
        free, moved = new.agg(F.avg(F.when(F.col("fixed").isNull(), F.col("p"))), F.max(F.abs(F.col("p") - F.col("was")))).first()
        discard(p)
        p = new.drop("was")
        if known is None and free is not None:
            prior = min(max(free, 0.02), 0.98)
        if moved is None or moved < close:
            break
    discard(cells)
    return p.select("item", F.round("p", 4).alias("p"))


def social_sensing(votes: DataFrame, silence: bool = True, known: DataFrame | None = None, dependence: bool = False, rounds: int = 100, smoothing: float = 1.0, close: float = 1e-6) -> DataFrame:
    """(item, z): the log odds of each item by EM over what sources do, support, deny or stay silent, when an item is true and when it is false.

    With silence a source that spoke about any item is silent about all others. That is never a table of sources x items: of a source's
    silence only the sums over all items less those it spoke about are needed, and an item's silent sources weigh as all do
    less those that spoke. known (item, happened) holds items' truth; dependence leaves out copies whose origin is among the item's votes. A source's
    latest vote on an item counts. EM starts from the smoothed share of support and ends when no belief moves by close. Items without a vote are absent; no votes give no rows.
    """
    rows = votes.where("vote IS NOT NULL")
    if dependence:
        rows = rows.join(rows.select("item", F.col("vote_id").alias("copy_of")).distinct(), ["item", "copy_of"], "left_anti")
    cells = stored(latest_votes(rows, copies=True).select("item", "source", (F.col("vote") > 0).alias("up")), "sensing-cells")
    start = cells.groupBy("item").agg(((F.count_if("up") + 1) / (F.count("*") + 2)).alias("q")).withColumn("fixed", F.lit(None).cast("double"))
    if known is not None:
        start = start.drop("fixed").join(known.select("item", F.col("happened").cast("double").alias("fixed")), "item", "left").withColumn("q", F.coalesce("fixed", "q"))
    q = stored(start.withColumn("z", F.lit(0.0)), "sensing-q")
    n, total = q.agg(F.count("*"), F.sum("q")).first()
    a = smoothing
    for _ in range(rounds if n else 0):
        spoke = cells.join(q, "item").groupBy("source").agg(
            F.sum(F.when(F.col("up"), F.col("q")).otherwise(0.0)).alias("ut"), F.sum(F.when(F.col("up"), 1 - F.col("q")).otherwise(0.0)).alias("uf"), F.sum(F.when(F.col("up"), 0.0).otherwise(F.col("q"))).alias("dt"), F.sum(F.when(F.col("up"), 0.0).otherwise(1 - F.col("q"))).alias("df")
        )
        silent = {"t": F.lit(total) - F.col("ut") - F.col("dt"), "f": F.lit(n - total) - F.col("uf") - F.col("df")} if silence else {"t": F.lit(0.0), "f": F.lit(0.0)}
        whole = {k: F.col(f"u{k}") + F.col(f"d{k}") + silent[k] + 3 * a for k in "tf"}
        ratio = lambda t, f: F.log((t + a) / whole["t"]) - F.log((f + a) / whole["f"])
        rates = stored(spoke.select("source", ratio(F.col("ut"), F.col("uf")).alias("up_by"), ratio(F.col("dt"), F.col("df")).alias("down_by"), ratio(silent["t"], silent["f"]).alias("silent_by")), "sensing-rates")
        quiet = rates.agg(F.sum("silent_by")).first()[0] if silence else 0.0
        d = min(max(total / n, 1e-3), 1 - 1e-3)
        step = F.when(F.col("up"), F.col("up_by")).otherwise(F.col("down_by")) - (F.col("silent_by") if silence else F.lit(0.0))
        z = cells.join(rates, "source").groupBy("item").agg((F.sum(step) + float(_logit_of(d)) + float(quiet)).alias("z"))
        new = stored(z.join(q.select("item", "fixed", F.col("q").alias("was")), "item").select("item", F.coalesce("fixed", sigmoid(F.col("z"), 30.0)).alias("q"), "fixed", "z", "was"), "sensing-q")
        total, moved = new.agg(F.sum("q"), F.max(F.abs(F.col("q") - F.col("was")))).first()
        discard(q, rates)
        q = new.drop("was")
        if moved < close:
            break
    discard(cells)
    return q.select("item", "z")


def _logit_of(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The smallest value at which half the weight of its group is reached."""
    w = Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    per_value = rows.groupBy(key, value).agg(F.sum(weight).alias("w"))
    run = per_value.select(key, value, F.sum("w").over(w).alias("up"), F.sum("w").over(Window.partitionBy(key)).alias("all"))
    return run.where(2 * F.col("up") >= F.col("all")).groupBy(key).agg(F.min(value).alias("median"))


def weighted_mode(rows: DataFrame, key: str, value: str, weight: str, at: str) -> DataFrame:
    """The value of most weight in each group; of equals the one stated first."""
    per_value = rows.groupBy(key, value).agg(F.sum(weight).alias("w"), F.min(at).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("w"), "first", value)
    return per_value.withColumn("k", F.row_number().over(w)).where("k = 1").select(key, F.col(value).alias("mode"))


def four_values(rows: DataFrame, key: str, value: str, at: str, root: str, weight: str) -> DataFrame:
    """A group's value by four rules: the first stated, that of most statements, of most cascades, and of most weight (ties: stated first)."""
    first = rows.groupBy(key).agg(F.min_by(value, F.struct(at, value)).alias("first"))
    once = rows.groupBy(key, root, value).agg(F.min(at).alias(at))
    parts = [first, weighted_mode(rows.withColumn("one", F.lit(1)), key, value, "one", at).withColumnRenamed("mode", "majority"), weighted_mode(once.withColumn("one", F.lit(1)), key, value, "one", at).withColumnRenamed("mode", "per_cascade"), weighted_mode(rows, key, value, weight, at).withColumnRenamed("mode", "weighted")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


def disputed(rows: DataFrame, key: str, value: str, at: str, share: float = 0.2, hours: float = 12.0) -> DataFrame:
    """Groups in which two counts stated within hours differ by more than share of the larger: key, n_pairs.

    Only statements in the same or the next stretch of hours meet.
    """
    slot = F.floor(F.col(at) / (hours * 3600))
    a = rows.select(key, F.col(value).alias("va"), F.col(at).alias("ta"), F.explode(F.array(slot, slot + 1)).alias("slot"), slot.alias("sa"))
    b = rows.select(key, F.col(value).alias("vb"), F.col(at).alias("tb"), slot.alias("slot"))
    pairs = a.join(b, [key, "slot"]).where((F.col("tb") - F.col("ta")).between(0, hours * 3600) & ((F.col("ta") < F.col("tb")) | (F.col("va") < F.col("vb"))))
    return pairs.where(F.abs(F.col("va") - F.col("vb")) > share * F.greatest(F.abs("va"), F.abs("vb"))).groupBy(key).agg(F.count("*").alias("n_pairs"))


def in_dispute(rows: DataFrame, key: str, value: str, at: str, share: float = 0.2, hours: float = 12.0) -> DataFrame:
    """The groups in which two counts stated within hours differ by more than share of the larger: key.

    Each count meets the least and the largest of the hours before it, for if any differs too much, one of these does; time is cut into
    stretches of hours, each with the one before it, so that a large group is many tasks' work and no pairs are made.
    """
    span = int(hours * 3_600_000_000)
    us = F.round(F.col(at) * 1e6).cast("long")
    slot = F.floor(us / span)
    both = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), us.alias("us"), F.explode(F.array(slot, slot + 1)).alias("slot"), slot.alias("own"))
    w = Window.partitionBy(key, "slot").orderBy("us").rangeBetween(-span, 0)
    seen = both.select(key, "v", (F.col("slot") == F.col("own")).alias("here"), F.min("v").over(w).alias("low"), F.max("v").over(w).alias("high"))
    apart = lambda c: F.abs(F.col("v") - F.col(c)) > share * F.greatest(F.abs("v"), F.abs(c))
    return seen.where(F.col("here") & (apart("low") | apart("high"))).select(key).distinct()


def weighted_by_story(votes: DataFrame) -> DataFrame:
    """Votes with the weight 1 over the number of votes of their item and cascade: a story counts once however often it is told."""
    root = roots(votes, "vote_id", "copy_of")
    rows = votes.join(root, votes["vote_id"] == root["node"])
    return rows.select("vote_id", "item", "root", (1 / F.count("*").over(Window.partitionBy("item", "root"))).alias("weight"))
