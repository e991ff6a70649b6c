"""Benchmark decontamination by templates, in SQL expressions.

Numbers, units and names become typed placeholders, so that a question asked again with other
values has the template of the original. A capitalised word that may only begin a sentence is a
literal in one template and a name in a second one; both are windowed, and a window counts as met by
either. Windows of template words are hashed and joined; aligned
windows of one item and one document are then checked for consistent slots: each value of the
item stands for one value of the document, save where a few slots were edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import stored

#: Template words of a window; items with fewer have one window.
WINDOW = 8
#: An item counts as found from this share of its windows on, or from so many windows.
SHARE, ENOUGH = 0.3, 6
#: Where an item's value stands for several of the document: the distinct pairs of values beyond the values of either side, one or this share of the pairs at most.
EDITED = 0.25
#: Windows of the benchmark up to which they are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
# Units, and the marks of the typed placeholders.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|mi|ft|lb|oz|h|hr|hrs|min|s|hours|hour|minutes|minute|days|day|weeks|years|miles|metres|meters|kilometres|kilometers|dollars|euros|eur|usd|percent"
# Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3fffd}]"
NUMBER, UNIT, NAME, INITIAL = "\u0001", "\u0002", "\u0003", "\u0004"


def typed_text(text: Column) -> Column:
    """A text lower-cased, without punctuation, one space between words, each placeholder's value behind its mark; INITIAL marks the capitalised words that are no NAME. Characters of UNSPACED scripts are words."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0001-\u0004]", " ")
    clean = F.regexp_replace(clean, f"(?=[\\u0e00-\\x{{10ffff}}])({UNSPACED})", " $1 ")
    t = F.regexp_replace(clean, r"(?=\d)(?<![\p{L}\p{N}])(\d+(?:[.,]\d+)*)", f"{NUMBER}$1")
    t = F.regexp_replace(t, rf"(\d) ?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)(?![\p{L}])", f"{NAME}$1")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{NAME}])(\p{{Lu}}\p{{Ll}}+)(?![\p{{L}}])", f"{INITIAL}$1")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", "")  # 1,000 is 1000, and a fraction stays in its number's word
    t = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", "p")
    return F.trim(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}\u0001-\u0004]+", " "))


def split_words(typed: Column) -> Column:
    """The words of a typed text, none of an empty one; the text is computed once, as a condition on it would not be."""
    return F.array_remove(F.split(typed, " "), "")


def typed_words(text: Column) -> Column:
    return split_words(typed_text(text))


def plain(word: Column) -> Column:
    """A typed word without its mark."""
    return F.when(word < "\u0005", word.substr(F.lit(2), F.length(word))).otherwise(word)


def with_templates(df: DataFrame) -> DataFrame:
    """Adds to df with typed the texts tpl and tpl2: a mark for each placeholder; in the second the words marked INITIAL are names."""
    df = df.withColumn("marks", F.regexp_replace("typed", f"([{NUMBER}-{NAME}])[^ ]*", "$1"))
    return df.withColumn("tpl", F.replace("marks", F.lit(INITIAL), F.lit(""))).withColumn("tpl2", F.regexp_replace("marks", f"{INITIAL}[^ ]*", NAME)).drop("marks")


def windows(words: Column) -> Column:
    """The hash of each window of an item's template words."""
    one = lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0))), one)


def _literal(words: Column) -> Column:
    """The windows' starts whose words hold at least three literals."""
    n = F.size(words)
    return F.filter(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.size(F.filter(F.slice(words, i + 1, WINDOW), lambda w: w >= "\u0004")) >= 3)


def placed_windows(typed: DataFrame, sizes: list[int], exact_sizes: list[int]) -> DataFrame:
    """id, key, pos, hash of the windows of texts (id, key, typed), by either template.

    Also of the runs of as many template words as sizes says, and of words, values included, as exact_sizes says.
    Each position becomes a row with its next WINDOW words and is hashed there: built-in functions
    without lambdas, so that all of it and the join after it are generated code.
    """
    plain_text = F.regexp_replace("typed", "[\u0001-\u0004]", "").alias("words")
    words = with_templates(typed).select("id", "key", "tpl", "tpl2", *[plain_text] * bool(exact_sizes))
    kinds = [c for c in ("tpl", "tpl2", "words") if c in words.columns]
    # an empty text is one empty word here, which no item has
    rows = words.select("id", "key", *[F.split(c, " ").alias(c) for c in kinds])
    ahead = [F.slice(c, k + 1, F.size(c)) for c in kinds for k in range(WINDOW)]
    rows = rows.select("id", "key", F.posexplode(F.arrays_zip(*ahead)).alias("pos", "next"))
    word = lambda kind, k: F.col("next")[str(kinds.index(kind) * WINDOW + k)]

    def run(kind: str, n: int, *before: Column) -> Column:
        """The hash of the next n words, null where the text ends before."""
        return F.when(word(kind, n - 1).isNotNull(), F.xxhash64(*before, *[word(kind, k) for k in range(n)]))

    def window(kind: str) -> Column:
        whole = word(kind, WINDOW - 1).isNotNull() | (F.col("pos") == 0)  # a shorter text is one window
        return F.when(whole, F.xxhash64(*[word(kind, k) for k in range(WINDOW)]))

    pairs = [(window("tpl"), window("tpl2"))] + [(run("tpl", n), run("tpl2", n)) for n in sizes]
    named = {f"h{i}_{j}": h for i, pair in enumerate(pairs) for j, h in enumerate(pair)}
    named |= {f"e{n}": run("words", n, F.lit("exact")) for n in exact_sizes}
    rows = rows.select("id", "key", "pos", *[h.alias(name) for name, h in named.items()])
    # null, which joins nothing, where both templates agree
    found = [F.col(c) if not c.endswith("_1") else F.when(F.col(c) != F.col(c[:-1] + "0"), F.col(c)) for c in named]
    return rows.select("id", "key", "pos", F.explode(F.array(*found)).alias("hash")).where("hash IS NOT NULL")


def _exact_hash(words: Column, start: Column, n: Column) -> Column:
    return F.xxhash64(F.lit("exact"), F.slice(words, start, n))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document that holds a benchmark item: id_col, n_items, items (sorted), coverage (the largest).

    An item is found where at least SHARE of its windows, or ENOUGH of them, occur in a document at
    one alignment with consistent slots: in the windows met, each value of the item stands for one value
    of the document (several may have become equal); or else few values were edited, see EDITED. Windows with fewer than three literals don't count; an item
    that has no others (short, or mostly values) is found where all its words occur in a row, values
    included; so an item of one word is found wherever that word is. Not found are: such an item with other values
    or words, and any item whose windows hold too few literals once its changed names are placeholders. Letter case,
    punctuation and signs between words are not compared. Null texts, and texts without a letter or
    digit, hold and give nothing. Documents that repeat an id count as one; a null id is reported
    as null, a null item id never. Other columns are not read. Texts of any length are searched whole. No documents or no items give no rows;
    items repeated with one id are one.
    """
    item = benchmark.select(F.col(item_col).alias("item"), typed_text(F.col(item_text)).alias("typed")).where("typed <> ''")
    item = with_templates(item).select("item", *[split_words(F.col(c)).alias(to) for c, to in [("typed", "raw"), ("tpl", "tpl"), ("tpl2", "tpl2")]])
    item = stored(item.withColumn("ok", _literal(F.col("tpl"))).withColumn("ok2", _literal(F.col("tpl2"))).withColumn("wins", windows(F.col("tpl"))).withColumn("wins2", windows(F.col("tpl2"))).withColumn("short", F.size("raw") < WINDOW).withColumn("exact", F.size("ok") == 0), "decon-items")
    hashed = lambda ok, wins: F.transform(ok, lambda i: F.struct(i.alias("at"), F.get(wins, i).alias("hash")))
    item_windows = item.where("NOT exact").select("item", "exact", F.size("ok").alias("n_windows"), F.inline(F.array_distinct(F.concat(hashed("ok", "wins"), hashed("ok2", "wins2")))))
    # items without windows: the first words, at most WINDOW; the others are compared below
    n_first = F.least(F.size("raw"), F.lit(WINDOW))
    firsts = item.where("exact").withColumn("words", F.transform("raw", plain))
    item_windows = item_windows.unionByName(firsts.select("item", "exact", F.lit(1).alias("n_windows"), F.lit(0).alias("at"), _exact_hash(F.col("words"), F.lit(1), n_first).alias("hash")))
    item_windows = stored(item_windows, "decon-windows")
    # short items have windows of their own length, looked up among the runs of as many words
    few = item_windows.count() <= BROADCAST_WINDOWS
    sizes = [r["n"] for r in item.where("short AND NOT exact").select(F.size("raw").alias("n")).distinct().orderBy("n").collect()]  # fewer than WINDOW values
    exact_sizes = [r["n"] for r in item.where("exact").select(n_first.alias("n")).distinct().orderBy("n").collect()]  # at most WINDOW values
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    placed = placed_windows(texts.select("id", "key", typed_text(F.col("text")).alias("typed")), sizes, exact_sizes)
    hits = placed.join(F.broadcast(item_windows) if few else item_windows, "hash")
    runs = hits.groupBy("id", "key", "item", "exact", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("met"), F.max("n_windows").alias("n_windows")).withColumn("n", F.size("met"))
    runs = stored(runs.where((F.col("n") >= SHARE * F.col("n_windows")) | (F.col("n") >= ENOUGH)), "decon-runs")
    # slots of the aligned words, for the documents with runs only
    held = stored(texts.select("key", "text").join(runs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "decon-held")
    both = runs.join(held.select("key", typed_words(F.col("text")).alias("raw")), "key").join(item.select("item", "exact", F.col("raw").alias("own")), ["item", "exact"])
    same = F.transform(F.slice("raw", F.col("shift") + 1, F.size("own")), plain) == F.transform("own", plain)
    both = both.where(~F.col("exact") | same)
    # slots count inside the windows met; the words between them may have been edited
    span = F.array_distinct(F.flatten(F.transform("met", lambda i: F.sequence(i, F.least(i + WINDOW, F.size("own")) - 1))))
    # a word marked INITIAL is a slot where it changed, or where it is a name elsewhere in the item
    there = lambda i: plain(F.get("raw", i + F.col("shift")))
    slot = lambda i, w: (w < INITIAL) | ((w < "\u0005") & ((plain(w) != there(i)) | F.array_contains("own", F.concat(F.lit(NAME), plain(w)))))
    value = lambda w: F.when(w < INITIAL, w).otherwise(F.concat(F.lit(NAME), plain(w)))
    slots = F.array_distinct(F.transform(F.filter(span, lambda i: slot(i, F.get("own", i))), lambda i: F.struct(value(F.get("own", i)).alias("a"), there(i).alias("b"))))
    values = lambda f: F.size(F.array_distinct(F.transform("slots", lambda s: s[f])))
    sound = both.withColumn("slots", slots).where((values("a") == F.size("slots")) | (F.size("slots") - F.least(values("a"), values("b")) <= F.greatest(F.lit(1), EDITED * F.size("slots"))))
    per_item = sound.groupBy("id", "item").agg(F.max(F.col("n") / F.col("n_windows")).alias("coverage"))
    return per_item.groupBy("id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage")).withColumnRenamed("id", id_col)
