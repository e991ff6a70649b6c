"""What is known of an incident: the suggested label with its reasons, the best value of each detail, what changed, and a briefing that cites its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.fusion import CREDIBLE, in_dispute, label_rule, logit, rated_votes, weighted_median, weighted_mode

# Reasons and denials shown, the least weight of a source, hours in which counts are compared, the rise that is told, attributes that are counts.
REASONS, DENIALS, LEAST_WEIGHT, HOURS, RISE = 5, 3, 0.01, 12.0, 1.2
COUNTS = {"casualty_count": "Casualties", "affected_count": "People affected"}


def assessments(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """An item's label and probability, and what they rest on: item, p, label, supporting, denying, credible_supporting, credible_denying, counted_once.

    Items without a vote have counts of 0. counted_once: votes that repeat another source's and don't count again.
    """
    rated = rated_votes(votes, outcomes)
    sides = {"supporting": F.col("vote") > 0, "denying": F.col("vote") < 0}
    sides |= {f"credible_{k}": c & (F.col("rate") >= CREDIBLE) for k, c in sides.items()}
    counts = rated.groupBy("item").agg(*[F.count_if(c).alias(k) for k, c in sides.items()])
    once = votes.groupBy("item").agg(F.count_if(F.col("vote").isNotNull() & F.col("copy_of").isNotNull()).alias("counted_once"))
    rows = label_rule(votes, outcomes).join(once, "item").join(counts, "item", "left")
    return rows.select("item", "p", "label", *[F.coalesce(k, F.lit(0)).alias(k) for k in sides], "counted_once")


def reasons(votes: DataFrame, outcomes: DataFrame, most: int = REASONS) -> DataFrame:
    """The voices that weigh most for or against an item: item, place (from 1), source, source_type, vote, rate; of equals the earlier vote_id first."""
    w = Window.partitionBy("item").orderBy(F.desc("weight"), "vote_id")
    rows = rated_votes(votes, outcomes).withColumn("weight", F.round(F.abs(logit(F.col("rate"))), 9))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("item", "place", "source", "source_type", "vote", F.bround("rate", 3).alias("rate"))


def detail_estimates(said: DataFrame, share: float = 0.2, hours: float = HOURS) -> DataFrame:
    """The best value of each detail that supporters state: item, attribute, estimate (text), n_statements, disputed.

    said: item, attribute, value (text), number (of counts, else null), at (seconds), rate (of its source). A count is the weighted median of
    what is said from hours before the latest credible statement (before the latest, where none is credible); other details have the value of most
    weight, the one stated first among equals, unknown only where nothing else is stated. A source weighs as its log odds, in whole millionths.
    Disputed: two credible statements differ; counts, by more than share of the larger and within hours. Rows without a value don't count.
    """
    weight = F.round(F.greatest(logit(F.col("rate")), F.lit(LEAST_WEIGHT)) * 1e6).cast("long")
    rows = said.where("value IS NOT NULL AND at IS NOT NULL").withColumns({"of": F.struct("item", "attribute"), "w": weight, "credible": F.coalesce(F.col("rate") >= CREDIBLE, F.lit(False)), "known": F.col("value") != "unknown"})
    facts = rows.groupBy("of").agg(
        F.count("*").alias("n_statements"),
        F.coalesce(F.max(F.when(F.col("credible"), F.col("at"))), F.max("at")).alias("latest"),
        F.bool_or("known").alias("any_known"),
        (F.min(F.when(F.col("credible") & F.col("known"), F.col("value"))) != F.max(F.when(F.col("credible") & F.col("known"), F.col("value")))).alias("apart"),
    )
    now = rows.join(facts.select("of", "latest", "any_known"), "of").where(F.when(F.col("number").isNull(), F.col("known") | ~F.col("any_known")).otherwise(F.col("at") >= F.col("latest") - hours * 3600))
    median = weighted_median(now.where("number IS NOT NULL"), "of", "number", "w").select("of", F.when(F.col("median") == F.floor("median"), F.floor("median").cast("string")).otherwise(F.col("median").cast("string")).alias("estimate"), F.lit(True).alias("counted"))
    mode = weighted_mode(now.where("number IS NULL"), "of", "value", "w", "at").select("of", F.col("mode").alias("estimate"), F.lit(False).alias("counted"))
    clash = in_dispute(rows.where("credible AND number IS NOT NULL"), "of", "number", "at", share, hours).withColumn("clash", F.lit(True))
    found = median.union(mode).join(facts, "of").join(clash, "of", "left")
    return found.select("of.item", "of.attribute", "estimate", "n_statements", F.coalesce(F.when(F.col("counted"), F.col("clash")).otherwise(F.col("apart")), F.lit(False)).alias("disputed"))


def moved_figures(said: DataFrame, since: float, now: float, rise: float = RISE) -> DataFrame:
    """Counts that rose after since: item, attribute, before (null: a first figure), after, before_id, after_id (the evidence), source.

    said: item, id, source, attribute, number, at. The largest count of either side speaks, the earliest among equals; rises up to rise times aren't told.
    """
    rank = F.struct("number", -F.col("at"), -F.col("id"))
    top = lambda when, c: F.max_by(c, F.when(when, rank))
    rows = said.where(F.col("number").isNotNull() & (F.col("at") <= now) & F.col("attribute").isin(list(COUNTS)))
    old, new = F.col("at") <= since, F.col("at") > since
    sides = rows.groupBy("item", "attribute").agg(*[F.max(F.when(w, F.col("number"))).alias(c) for w, c in ((old, "before"), (new, "after"))], top(old, "id").alias("old_id"), top(new, "id").alias("after_id"), top(new, "source").alias("source"))
    told = sides.where(F.col("after").isNotNull() & (F.col("before").isNull() | (F.col("after") > F.col("before") * rise)))
    return told.select("item", "attribute", "before", "after", F.when(F.col("before").isNotNull(), F.col("old_id")).alias("before_id"), "after_id", "source")


def shown_time(seconds: Column, offset: int = 21600) -> Column:
    """A moment in Bangladesh time, as briefings write it."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds) + offset), "dd MMM yyyy, HH:mm")


def shown_count(number: Column) -> Column:
    """A count with thousands set apart, with one decimal if it isn't whole."""
    return F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 1))


def _plural(n: Column, one: str, more: str) -> Column:
    return F.when(n == 1, one).otherwise(more)


def briefing(incidents: DataFrame, evidence: DataFrame, said: DataFrame, since: float, now: float) -> DataFrame:
    """Sentences of each incident, each resting on evidence: item, kind, place (order within the kind), text, cites (ids, at most three, earliest first).

    incidents: item, event_type, place_name, started, ended. evidence: id, item, source, rate, at, relation (0 and 1 support, 2 denies, 3 comments), copy_of.
    said: item, id, source, attribute, number, at, of supporters. Copies don't count as evidence of their own. Kinds: lead, balance, denial (the first
    three), copies, latest; and since a moment: new, count, none. An incident without evidence gets a lead that says so. Times are in seconds; a null place is left out.
    """
    supports, denies, counted = F.col("relation") < 2, F.col("relation") == 2, F.col("copy_of").isNull()
    new = counted & (F.col("at") > since) & (F.col("at") <= now)
    n = lambda c: F.count_if(c)
    voices = lambda c: F.count_distinct(F.when(counted & c, F.col("source")))
    facts = evidence.groupBy("item").agg(
        voices(supports).alias("n_for"), voices(supports & (F.coalesce("rate", F.lit(0.0)) >= CREDIBLE)).alias("n_credible"), voices(denies).alias("n_against"),
        n(~counted).alias("n_copies"), n(new).alias("n_new"), n(new & supports).alias("new_for"), n(new & denies).alias("new_against"), n(new & (F.col("relation") == 3)).alias("new_other"),
        F.max_by(F.struct("id", "source", "at"), F.when(counted, F.struct("at", -F.col("id")))).alias("last"), n(counted).alias("n_counted"),
    )
    at = Window.partitionBy("item", "side").orderBy("at", "id")
    sided = evidence.where(counted & (F.col("relation") < 3)).withColumn("side", denies).withColumn("k", F.row_number().over(at)).where(F.col("k") <= DENIALS)
    firsts = sided.groupBy("item").agg(F.sort_array(F.collect_list(F.when(~F.col("side"), F.struct("k", "id"))))["id"].alias("firsts"), F.sort_array(F.collect_list(F.when(F.col("side"), F.struct("k", "id"))))["id"].alias("denials"))
    rows = incidents.join(facts, "item", "left").join(firsts, "item", "left")

    none, ids = F.array().cast(evidence.select(F.array("id")).schema[0].dataType), lambda c: F.coalesce(c, F.array().cast(evidence.select(F.array("id")).schema[0].dataType))
    known = (F.coalesce("n_for", F.lit(0)) + F.coalesce("n_against", F.lit(0))) > 0
    kind = F.replace("event_type", F.lit("_"), F.lit(" "))
    span = F.when(F.col("ended").isNull(), F.concat(F.lit("since "), shown_time(F.col("started")))).otherwise(F.concat(F.lit("from "), shown_time(F.col("started")), F.lit(" to "), shown_time(F.col("ended"))))
    lead = F.concat(F.upper(F.substring(kind, 1, 1)), F.expr("substring(replace(event_type, '_', ' '), 2)"), F.coalesce(F.concat(F.lit(" at "), "place_name"), F.lit("")), F.lit(", "), span, F.lit("."), F.when(known, "").otherwise(" No evidence is linked yet, so there is nothing to summarise."))
    cites = ids(F.when(F.size(ids(F.col("firsts"))) > 0, F.col("firsts")).otherwise(F.slice(ids(F.col("denials")), 1, 1)))
    balance = F.concat(F.col("n_for").cast("string"), F.lit(" sources say it happened"), F.when(F.col("n_for") > 0, F.concat(F.lit(" ("), F.col("n_credible").cast("string"), F.lit(" credible)"))).otherwise(""), F.when(F.col("n_against") > 0, F.concat(F.lit("; "), F.col("n_against").cast("string"), _plural(F.col("n_against"), " says", " say"), F.lit(" it did not"))).otherwise(""), F.lit("."))
    copies = F.concat(F.col("n_copies").cast("string"), _plural(F.col("n_copies"), " item repeats", " items repeat"), F.lit(" an earlier one and "), _plural(F.col("n_copies"), "is", "are"), F.lit(" counted once."))
    latest = F.concat(F.lit("Latest: "), F.col("last.source").cast("string"), F.lit(", "), shown_time(F.col("last.at")), F.lit("."))
    fresh = F.concat(F.col("n_new").cast("string"), _plural(F.col("n_new"), " new item: ", " new items: "), F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t))) for c, t in (("new_for", " support it"), ("new_against", " say it did not happen"), ("new_other", " only comment"))])), ", "), F.lit("."))
    says = [("lead", F.lit(True), lead, cites), ("balance", known, balance, ids(F.slice(F.concat(ids(F.col("firsts")), ids(F.col("denials"))), 1, 3))), ("copies", known & (F.col("n_copies") > 0), copies, none), ("latest", known & (F.col("n_counted") > 0), latest, F.array("last.id")), ("new", F.col("n_new") > 0, fresh, none)]
    one = F.array_compact(F.array(*[F.when(w, F.struct(F.lit(k).alias("kind"), F.lit(1).alias("place"), t.alias("text"), c.alias("cites"))) for k, w, t, c in says]))
    general = rows.select("item", F.explode(one).alias("s")).select("item", "s.*")
    denial = sided.where("side").join(incidents.select("item"), "item").select("item", F.lit("denial").alias("kind"), F.col("k").alias("place"), F.concat(F.col("source").cast("string"), F.lit(" calls it false.")).alias("text"), F.array("id").alias("cites"))
    name = F.create_map(*[F.lit(x) for pair in COUNTS.items() for x in pair])[F.col("attribute")]
    figure = F.when(F.col("before").isNull(), F.concat(name, F.lit(": first figure, "), shown_count(F.col("after")), F.lit(" ("), F.col("source").cast("string"), F.lit(")."))).otherwise(F.concat(name, F.lit(": "), F.col("source").cast("string"), F.lit(" now says "), shown_count(F.col("after")), F.lit(", up from "), shown_count(F.col("before")), F.lit(".")))
    counts = moved_figures(said, since, now).join(incidents.select("item"), "item").select("item", F.lit("count").alias("kind"), F.array_position(F.array(*map(F.lit, sorted(COUNTS))), F.col("attribute")).cast("int").alias("place"), figure.alias("text"), F.array_compact(F.array("after_id", "before_id")).alias("cites"))
    told = general.union(denial).union(counts)
    quiet = incidents.select("item").join(told.where("kind IN ('new', 'count')").select("item").distinct(), "item", "left_anti").select("item", F.lit("none").alias("kind"), F.lit(1).alias("place"), F.concat(F.lit("Nothing new since "), shown_time(F.lit(since)), F.lit(".")).alias("text"), none.alias("cites"))
    return told.union(quiet)


def requests_for_evidence(requests: DataFrame, events: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests to check each event, newest first: event_id, place (from 1), request_id, status, closed, responses.

    requests: request_id, event_id, created, status, closed (seconds). events: event_id, status, changed. responses: request_id.
    An open request is cancelled when its event is resolved or dismissed, at that time; requests of unknown events stay as they are.
    """
    sent = responses.groupBy("request_id").agg(F.count("*").alias("responses"))
    states = events.select("event_id", F.col("status").alias("event_status"), "changed")
    rows = requests.join(states, "event_id", "left").join(sent, "request_id", "left")
    gone = (F.col("status") == "open") & F.coalesce(F.col("event_status").isin("resolved", "dismissed"), F.lit(False))
    newest = Window.partitionBy("event_id").orderBy(F.desc("created"), F.desc("request_id"))
    return rows.select("event_id", F.row_number().over(newest).alias("place"), "request_id", F.when(gone, "cancelled").otherwise(F.col("status")).alias("status"), F.when(gone, F.col("changed")).otherwise(F.col("closed")).alias("closed"), F.coalesce("responses", F.lit(0)).alias("responses"))


def repeated_requests(requests: DataFrame) -> DataFrame:
    """Events with more than one open request, which may not be: event_id, n_open, first_request."""
    return requests.where("status = 'open'").groupBy("event_id").agg(F.count("*").alias("n_open"), F.min_by("request_id", F.struct("created", "request_id")).alias("first_request")).where("n_open > 1")


def visible_statements(statements: DataFrame, pages: DataFrame, role: str, page: int | None = None) -> DataFrame:
    """The statements that a user sees, with the one that corrects each: those of verified pages, all for admins, and those of the user's own page.

    statements: statement_id, page_id, supersedes. pages: page_id, status. Of several corrections the largest statement_id counts; statements of unknown pages are for admins only.
    """
    corrected = statements.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("statement_id")).agg(F.max("statement_id").alias("superseded_by"))
    rows = statements.join(pages.select("page_id", F.col("status").alias("page_status")), "page_id", "left").join(corrected, "statement_id", "left")
    seen = F.coalesce(F.col("page_status") == "verified", F.lit(False)) | F.lit(role == "admin") | F.coalesce(F.col("page_id") == F.lit(page), F.lit(False))
    return rows.where(seen).select("statement_id", "page_id", "superseded_by")
