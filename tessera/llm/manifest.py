"""A Merkle manifest of a table, by supersteps: children message their parents upward, parents' paths go down to the leaves.

Rows are leaves, each group of rows is a tree, and the groups' roots are the leaves of one more tree. A vertex is a block of the tree: FAN
neighbouring nodes of one height and everything above them up to the node they share. In a superstep up, each node messages the block that it
belongs to; a block that has heard from all its children (their number follows from the size of the tree) hashes them pair by pair,
and its top node is a child in the next superstep. In a superstep down, each block gets the path from its top node to the root, and
sends every child that path with the child's siblings inside the block in front. Messages are keyed by tree and block, so that a tree of any
size is spread over all tasks, a block is FAN messages, and a tree of n leaves takes log n / log FAN supersteps each way.

Each superstep's messages are written to the shared folder: a lost executor costs tasks of one superstep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.session import discard, is_empty, stored

#: Levels of the tree in a block, and the children of a block.
LEVELS = 8
FAN = 1 << LEVELS


def field(value: Column) -> Column:
    """A value's text as it goes into a leaf: its length in bytes, a colon and itself; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _place(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _hash(*digests: bytes) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def _grown(children: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels of a block from its children to its top node; the block of a whole tree ends where one node remains."""
    levels = [children]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([_hash(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def _path(levels: list[list[bytes]], slot: int) -> bytes:
    """The steps from a child to the top: L or R and the digest of the sibling on that side, or - where there is none."""
    steps = []
    for level in levels[:-1]:
        other = slot ^ 1
        steps.append(b"-" if other >= len(level) else (b"L" if other < slot else b"R") + level[other])
        slot >>= 1
    return b"".join(steps)


def _steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        size = 0 if side == b"-" else 32
        yield side, path[at + 1 : at + 1 + size]
        at += 1 + size


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path lead to."""
    for side, other in _steps(path):
        digest = _hash(digest) if side == b"-" else _hash(other, digest) if side == b"L" else _hash(digest, other)
    return digest


def proof(path: bytes) -> str:
    """The SHA-256 of the siblings on a path, as hex text, from leaf to root."""
    return sha256("".join(other.hex() for _, other in _steps(path)).encode()).hexdigest()


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with their position (from 0) in their group by order, and the group's size n; order must tell rows apart.

    Ranges of the sorted rows are numbered by themselves; the sizes of a group's earlier ranges, a row a range and group, are added.
    """
    ranged = rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id()).sortWithinPartitions(group, *order)
    at = ranged.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = count, 0  # equal to no value
        for b in batches:
            places = []
            for value in b.column(at).to_pylist():
                n = n + 1 if value == last else 0
                last = value
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "inside"])

    inside = stored(ranged.mapInArrow(count, f"{_schema(ranged)}, inside long"), "merkle-rows")
    sizes = inside.groupBy(F.col("range").alias("r"), F.col(group).alias("g")).agg((F.max("inside") + 1).alias("size"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("size").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("r", "g", before.alias("before"), F.sum("size").over(w).alias("n"))
    out = inside.join(sizes, (F.col("range") == F.col("r")) & F.col(group).eqNullSafe(F.col("g")))
    return stored(out.withColumn("position", F.col("before") + F.col("inside")).drop("range", "inside", "r", "g", "before", "size"), "merkle-numbered")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _tasks(spark: SparkSession, height: int) -> int:
    """Tasks of a superstep: as many as Spark's shuffles have, fewer where a block has taken the place of FAN nodes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FAN**height)


def _asked(tree: object, n: int, position: int) -> tuple[tuple, int]:
    """The block that a node belongs to, and how many children that block waits for."""
    block = position // FAN
    return (tree, block), min(FAN, n - block * FAN)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The supersteps upward. nodes: tree, n, position, digest. Of each height the blocks: tree, n (blocks), position, digest (top), children, whole."""
    spark, heights = nodes.sparkSession, []

    def send(r) -> tuple:
        key, _ = _asked(r["tree"], r["n"], r["position"])
        return key, (r["position"] % FAN, bytes(r["digest"]), r["n"])

    def complete(item: tuple) -> Iterator[tuple]:
        (tree, block), heard = item
        heard = sorted(heard)
        n = heard[0][2]
        if len(heard) != _asked(tree, n, block * FAN)[1]:
            raise ValueError(f"block {block} of tree {tree} has {len(heard)} children")
        children = [d for _, d, _ in heard]
        yield tree, -(-n // FAN), block, _grown(children, n <= FAN)[-1][0], children, n <= FAN

    while True:
        tasks = _tasks(spark, len(heights))
        blocks = nodes.rdd.map(send).groupByKey(tasks, _place).flatMap(complete)
        done = stored(spark.createDataFrame(blocks, f"tree {nodes.schema['tree'].dataType.simpleString()}, n long, position long, digest binary, children array<binary>, whole boolean", verifySchema=False), "merkle-up")
        heights.append(done)
        nodes = done.where("NOT whole").select("tree", "n", "position", "digest")
        if is_empty(nodes):
            return heights


def roots(heights: list[DataFrame]) -> DataFrame:
    """(tree, digest) of all trees."""
    out = heights[0].where("whole").select("tree", "digest")
    for h in heights[1:]:
        out = out.union(h.where("whole").select("tree", "digest"))
    return out


def _delivered(children: RDD, paths: RDD, tasks: int) -> RDD:
    """The superstep down: of each child (its block's key; slot, digest, payload) what its block's path says: tree, position, payload, path, subroot, root."""

    def routed(item: tuple) -> Iterator[tuple]:
        (tree, block), heard = item
        head, mine = None, []
        for kind, value in heard:
            if kind:
                mine.append(value)
            else:
                head = value
        mine.sort(key=lambda c: c[0])
        above, whole, subroot, root = head
        levels = _grown([c[1] for c in mine], whole)
        for slot, _, payload in mine:
            yield tree, block * FAN + slot, payload, _path(levels, slot) + above, subroot, root

    tagged = children.mapValues(lambda c: (True, c)).union(paths.mapValues(lambda p: (False, p)))
    return tagged.groupByKey(tasks, _place).flatMap(routed)


_PATHS = "position long, path binary, whole boolean, subroot binary, root binary"


def descend(heights: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The supersteps downward from the trees' roots (heads: tree, path, subroot, root) to the lowest blocks: tree, position, path, whole, subroot, root."""
    spark = heads.sparkSession
    kind = heights[0].schema["tree"].dataType.simpleString()
    start = lambda h: h.where("whole").select(F.col("tree").alias("t"), "position", "whole").join(heads, F.col("t").eqNullSafe(F.col("tree"))).select("tree", "position", "path", "whole", "subroot", "root")
    paths = start(heights[-1])
    for k in range(len(heights) - 1, 0, -1):
        children = heights[k].rdd.flatMap(lambda r: (((r["tree"], r["position"]), (slot, bytes(d), None)) for slot, d in enumerate(r["children"])))
        told = _delivered(children, _sent(paths), _tasks(spark, k)).map(lambda r: (r[0], r[1], r[3], False, r[4], r[5]))
        paths = stored(spark.createDataFrame(told, f"tree {kind}, {_PATHS}", verifySchema=False), "merkle-down").union(start(heights[k - 1]))
    return paths


def _sent(paths: DataFrame) -> RDD:
    return paths.rdd.map(lambda r: ((r["tree"], r["position"]), (bytes(r["path"]), r["whole"], bytes(r["subroot"]), bytes(r["root"]))))


def _leaves(nodes: DataFrame, heights: list[DataFrame], heads: DataFrame, *payload: str) -> RDD:
    """The last superstep down, to the nodes themselves."""
    children = nodes.rdd.map(lambda r: (_asked(r["tree"], r["n"], r["position"])[0], (r["position"] % FAN, bytes(r["digest"]), tuple(r[c] for c in payload))))
    return _delivered(children, _sent(descend(heights, heads)), _tasks(nodes.sparkSession, 0))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, roots and proof of each row, and whether the row, perhaps tampered with, still leads to the root: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: doc_id, source, lang, n_chars, text; other columns, whatever their names, are not read. Where tampered holds, n_chars is one more in the row that is
    checked (a null stays). A tree is all rows of one lang (null is one), in the order of doc_id, null first, of equal ones by leaf; rows
    repeated whole have neighbouring places, either order of which gives the same rows. Empty and very long values are hashed whole. No rows give no rows.
    """
    spark = docs.sparkSession
    ident = docs.schema["doc_id"].dataType.simpleString()
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = leaf(*values[:3], values[3].cast("decimal(38,0)") + 1, values[4])
    broken = F.when(tampered & values[3].isNotNull(), F.unhex(changed)) if tampered is not None else F.lit(None).cast("binary")
    made = stored(docs.select("doc_id", F.col("lang").alias("tree"), F.unhex(leaf(*values)).alias("digest"), broken.alias("broken"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    if is_empty(made):
        return spark.createDataFrame([], f"doc_id {ident}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    nodes = numbered(made, "tree", "doc_id", "digest", "row")
    heights = climb(nodes.select("tree", "n", "position", "digest"))
    tops = numbered(roots(heights).select(F.lit("").alias("all"), "tree", "digest"), "all", "tree")
    tops = tops.select(F.col("all").alias("tree"), "n", "position", "digest", F.col("tree").alias("of"))
    above = climb(tops.select("tree", "n", "position", "digest"))
    top = roots(above).select("tree", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    subtrees = _leaves(tops, above, top, "of", "digest").map(lambda r: (r[2][0], r[3], bytes(r[2][1]), r[5]))
    kind = made.schema["tree"].dataType.simpleString()
    heads = stored(spark.createDataFrame(subtrees, f"tree {kind}, path binary, subroot binary, root binary", verifySchema=False), "merkle-heads")

    def checked(r: tuple) -> tuple:
        _, _, (doc_id, digest, other), path, subroot, root = r
        found = folded(bytes(digest if other is None else other), path)
        return doc_id, bytes(digest).hex(), subroot.hex(), root.hex(), proof(path), found.hex(), found == root

    out = _leaves(nodes, heights, heads, "doc_id", "digest", "broken").map(checked)
    out = stored(spark.createDataFrame(out, f"doc_id {ident}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", verifySchema=False), "merkle-manifest")
    discard(made, nodes, *heights, *above, heads)
    return out
