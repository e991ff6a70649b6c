"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL expressions.

A text's paragraphs (its lines, in runs of at most so many words) are digests; each digest is
added to three cells of a sketch, a cell being (index, count, XOR of digests, XOR of their
checks). Sketches of two texts subtract cell by cell; cells that hold one digest are peeled
until all that differ are recovered. A sketch that doesn't peel is built again, larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import discard, stored

from .memory import shuffles_deleted

#: Words of a paragraph run; cells of the first sketch (a multiple of 3).
WORDS, CELLS = 16, 24
_CELL = "array<struct<c:int,n:int,k:bigint,h:bigint>>"


def paragraphs(text: Column, words: int = WORDS) -> Column:
    """The distinct digests of a text's paragraph runs."""
    runs = F.regexp_extract_all(text, F.lit(rf"\S+(?:[^\S\n]+\S+){{0,{words - 1}}}"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(key: Column, n: Column, third: Column, seed: int) -> Column:
    """What a digest adds to its three cells, one in each third of the sketch."""

    def cells(check: Column) -> Column:
        return F.array(*[F.struct((third * j + F.pmod(F.xxhash64(key, F.lit(seed * 3 + j)), third)).cast("int").alias("c"), n.alias("n"), key.alias("k"), check.alias("h")) for j in range(3)])

    return _let(_check(key), cells)


def _third(size: Column, use) -> Column:
    """use(third of the cells), computed once and not once a digest."""
    return _let((size / 3).cast("int"), use)


def _fold(entries: Column) -> Column:
    """Entries by cell, those of a cell added up; cells that come to nothing go. In time of a sort: each cell's entries are one slice."""

    def add(done: Column, x: Column) -> Column:
        return F.struct(x["c"].alias("c"), (done["n"] + x["n"]).alias("n"), done["k"].bitwiseXOR(x["k"]).alias("k"), done["h"].bitwiseXOR(x["h"]).alias("h"))

    def by_cell(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(e, i)["c"] != F.get(e, i - 1)["c"]))

        def cells(s: Column) -> Column:
            end = lambda j: F.coalesce(F.get(s, j + 1), F.size(e))
            one = lambda at, n: F.when(n == 1, F.get(e, at)).when(n == 2, add(F.get(e, at), F.get(e, at + 1))).otherwise(F.aggregate(F.slice(e, at + 2, n - 1), F.get(e, at), add))
            return F.transform(s, lambda at, j: one(at, end(j) - at))  # most cells have one entry or two

        return F.when(F.size(e) < 2, e).otherwise(_let(starts, cells))

    return F.filter(_let(F.sort_array(entries), by_cell), lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))


def _all_entries(digests: Column, n: int, third: Column, seed: int) -> Column:
    return F.flatten(F.transform(digests, lambda k: _entries(k, F.lit(n), third, seed)))


def sketch(digests: Column, cells: Column, seed: int = 0) -> Column:
    return _third(cells, lambda third: _fold(_all_entries(digests, 1, third, seed)))


def subtracted(a: Column, b: Column, cells: Column, seed: int = 0) -> Column:
    """The sketch of a less that of b, added up at once."""
    return _third(cells, lambda third: _fold(F.concat(_all_entries(a, 1, third, seed), _all_entries(b, -1, third, seed))))


def subtract(a: Column, b: Column) -> Column:
    return _fold(F.concat(a, F.transform(b, lambda x: F.struct(x["c"].alias("c"), (-x["n"]).alias("n"), x["k"].alias("k"), x["h"].alias("h")))))


def peel(cells: Column, size: Column, seed: int = 0, rounds: int = 40) -> Column:
    """struct(plus, minus): the digests only in the first and only in the second, null if the sketch doesn't peel."""

    def step(state: Column, third: Column) -> Column:
        # a digest may be alone in several cells: sorted, its equals are neighbours
        alone = F.sort_array(F.transform(F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"]))), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"))))
        pure = _let(alone, lambda e: F.filter(e, lambda x, i: (i == 0) | (x != F.get(e, i - 1))))

        def off(found: Column) -> Column:
            rest = _fold(F.concat(state["cells"], F.flatten(F.transform(found, lambda x: _entries(x["k"], -x["n"], third, seed)))))
            stuck = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("stuck"))
            return F.when(F.size(found) == 0, stuck).otherwise(F.struct(rest.alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(False).alias("stuck")))

        return F.when(state["stuck"] | (F.size(state["cells"]) == 0), state).otherwise(_let(pure, off))

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"), F.lit(False).alias("stuck"))

    def sides(state: Column) -> Column:
        side = lambda n: F.transform(F.filter(state["found"], lambda x: x["n"] == n), lambda x: x["k"])
        return F.when(F.size(state["cells"]) == 0, F.struct(side(1).alias("plus"), side(-1).alias("minus")))

    peeled = lambda third: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: step(state, third))
    return _let(_third(size, peeled), sides)


def difference(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """The digests that differ, from the first sketches; on failure from larger ones; at the last from the digests."""

    def larger(factor: int, seed: int) -> Column:
        size = (F.ceil((F.size(a) + F.size(b)) * factor / 2) * 3 + 12).cast("int")
        return _let(size, lambda cells: peel(subtracted(a, b, cells, seed), cells, seed))

    exact = F.struct(F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))
    return F.coalesce(peel(subtract(fa, fb), F.lit(CELLS)), larger(1, 1), larger(2, 2), exact)


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Twice the shared digests over all digests, by the recovered difference; 1 for two texts without any."""
    total = (F.size(a) + F.size(b)).cast("double")
    return F.when(fa == fb, F.lit(1.0)).otherwise(_let(difference(a, b, fa, fb), lambda d: (total - F.size(d["plus"]) - F.size(d["minus"])) / total))


def as_text(cells: Column) -> Column:
    """A sketch as a string: index.count.digest.check of each cell, in order."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(".", x["c"].cast("string"), x["n"].cast("string"), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"])))), " ")


#: Characters of a range of texts that follow each other.
RANGE_CHARS = 32 << 20


def _at_most(cuts: Column, n: int, key: Column) -> Column:
    """How many of the n cuts, in ascending order, are at most the key: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at))


def with_next(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each row with columns of the row that follows by id as next_<column> (after the last: the first).

    Null ids come first; equal ids, and null ones, are ordered by a hash of the columns. The rows are
    cut into ranges of about RANGE_CHARS by id and hash, as many as that makes; a range is a partition of a window, and gets a copy of
    the first row of the next range, so that no row needs more than its own range.
    """
    spark = rows.sparkSession
    # a range's place is the order of ids, nulls in front, then that of hashes
    keyed = rows.withColumn("key", F.struct(F.col(id_col).isNotNull().alias("some"), F.coalesce(id_col, F.lit(0)).alias("id"), F.xxhash64(*columns).alias("h")))
    keys = stored(keyed.select("key", F.length("text").alias("n")), "iblt-keys")
    n = max(2, int((keys.agg(F.sum("n")).first()[0] or 0) // RANGE_CHARS) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_range = keys.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("cut"))
    found = [r["cut"] for r in per_range.orderBy("p").collect()][1:]  # one row a range
    discard(keys)
    cuts = F.array(*[F.struct(F.lit(c["some"]).alias("some"), F.lit(c["id"]).cast("long").alias("id"), F.lit(c["h"]).cast("long").alias("h")) for c in found])
    ranged = keyed.withColumn("range", _at_most(cuts, len(found), F.col("key")) if found else F.lit(0)).withColumn("guest", F.lit(False))
    # the first row of each range, as a guest after the last of the range in front; n rows at most
    firsts = stored(ranged.groupBy("range").agg(F.min_by(F.struct(id_col, *columns), "key").alias("x")), "iblt-firsts")
    numbers = sorted(r["range"] for r in firsts.select("range").collect())
    if numbers:
        moves = spark.createDataFrame(list(zip(numbers, [numbers[-1], *numbers[:-1]], strict=True)), "range int, to int")
        guests = firsts.join(F.broadcast(moves), "range").select("x.*", F.col("to").alias("range"), F.lit(True).alias("guest"))
        ranged = ranged.select(id_col, *columns, "key", "range", "guest").unionByName(guests, allowMissingColumns=True)
    w = Window.partitionBy("range").orderBy("guest", "key")
    return ranged.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("NOT guest").drop("key", "range", "guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter is the start of the next text's.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is empty (an empty fingerprint; two of them are alike: 1). Rows without an id come
    first, in the order of their texts' hashes, and rows that repeat an id follow each other so; after the last row comes the first.
    An empty table gives no rows. Very long texts make longer lists of digests only, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("units", paragraphs(F.col("text")))
    with shuffles_deleted(docs.sparkSession):
        pairs = with_next(rows, "id", ["text", "units"])
        pairs = pairs.withColumn("next_text", F.coalesce("next_text", "text")).withColumn("next_units", F.coalesce("next_units", "units"))
        n = F.length("text").cast("long")
        quarter = F.floor(n / 4).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")), F.substring(F.col("next_text"), F.lit(1), quarter))
        units = stored(
            pairs.withColumn("edited", edited).select("id", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "units", "next_units", paragraphs(F.col("edited")).alias("edited_units")), "iblt-units"
        )
        size = F.lit(CELLS)
        made = units.select("*", sketch(F.col("units"), size).alias("f"), sketch(F.col("edited_units"), size).alias("fe"), sketch(F.col("next_units"), size).alias("fn"))
        # between stages the sketches are columns, so that no expression is computed twice
        made = stored(made, "iblt-sketches")
        discard(units)
    return made.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("units"), F.col("edited_units"), F.col("f"), F.col("fe")).alias("near_edited"), likeness(F.col("units"), F.col("next_units"), F.col("f"), F.col("fn")).alias("near_next"),
    )
