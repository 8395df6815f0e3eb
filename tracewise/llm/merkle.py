"""Merkle manifest of a dataset, and the climb from every leaf to the root.

``build`` makes a tree a group (``lang``) over its rows in the order of ``doc_id``, and one over the groups' tops in the
bytewise order of the group (null first): each run of FANOUT consecutive nodes becomes the digest of their digests (hex text,
concatenated), until one is left.  A leaf is the digest of the row's columns, each ``-`` if null, else its UTF-8 byte count,
``:`` and its value.  Levels are stored as parent-linked node rows: node, what stands before and after it in its run, parent.

``climb`` is one Spark recursive query over these rows.  It takes other leaves (say, of a tampered copy) up to the root: at each
step a digest is folded with its run's other digests, which are appended to the proof.  The leaves of one run share
all siblings above them, so a run climbs as one row that holds a folded digest a leaf; that is an eighth of the rows and of the
siblings moved.

Places of leaves come from one range partitioning by (group, id, leaf) and a prefix sum over a row for each partition and group,
so a group of any size is spread over tasks; rows a level fall by FANOUT.  Where many runs meet one node high in the tree, the
join by node is split by Spark (a plain sort-merge join over written node rows).

Null ids come first (and are never tampered with in ``op11``), a null group is a group of its own.  Repeated rows are leaves each;
ties of the id go by the leaf's digest.  A row of nulls is ``-----``.  Texts are hashed whole, in the JVM.  An empty table gives
an empty result, and its root is null.  A lone leaf is its group's top; a lone group's top is the root; without siblings the proof
is empty.  Only named columns are read, so further columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small
from tracewise.functions.ranking import global_position
from tracewise.llm.common import materialise

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOPS = -1  # the number of the tree over the groups' tops
NODE = ("tree", "level", "place")


class Manifest(NamedTuple):
    """``runs``: tree, run, hashed, leaves (id, digest and what the caller carries); ``nodes``: parent-linked node rows;
    ``tops``: tree, subroot; ``root`` (hex text, null for an empty table) and ``top``, the root's node."""

    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: str | None
    top: tuple[int, int, int]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    """Digest (32 bytes) of the values of a row."""
    return digest(F.concat(*[field(c) for c in columns]))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _places(leaves: DataFrame) -> DataFrame:
    """Adds tree (number of the group), place in it and size of the tree."""
    order = [F.col("_group").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("_leaf"), F.col("_row")]
    rows = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    rows = rows.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"_offset": F.coalesce(before, F.lit(0)) - F.col("_first"), "size": F.sum("_n").over(whole)})
    groups = global_position(leaves.select(F.col("_group").alias("_g")).distinct(), "_g", "tree")
    counts = counts.join(groups, F.expr("_group <=> _g")).select(F.col("_part").alias("_p"), "_g", "_offset", "size", "tree")
    counts = broadcast_if_small(materialise(counts, "places"))
    return rows.join(counts, F.expr("_part = _p and _group <=> _g")).withColumn("place", F.col("_offset") + F.col("_at"))


def _raise(level: DataFrame, number: int, most: int, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """Builds the levels above ``level`` (tree, place, size, digest, node); the top of each tree, and all node rows below them."""
    tops, nodes = level.filter("size = 1"), []
    while most > 1:
        run = F.floor(F.col("place") / fanout)
        member = F.struct("place", "digest", "node")
        runs = level.filter("size > 1").groupBy("tree", run.alias("run")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(member)).alias("of"))
        runs = materialise(runs, "level")
        parent = F.struct("tree", F.lit(number + 1).alias("level"), F.col("run").alias("place")).alias("parent")
        part = lambda side: _joined(F.transform(F.filter("of", side), lambda x: x["digest"]))
        each = runs.select("of", parent, F.explode("of").alias("x"))
        nodes.append(each.select(F.col("x.node").alias("node"), part(lambda o: o["place"] < F.col("x.place")).alias("before"),
                                 part(lambda o: o["place"] > F.col("x.place")).alias("after"), "parent"))
        level = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("size") / fanout).alias("size"),
                            digest(text_of(_joined(F.col("of.digest")))).alias("digest"), parent.alias("node"))
        tops = tops.unionByName(level.filter("size = 1"))
        most, number = -(-most // fanout), number + 1
    return tops, nodes


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", group: str = "lang", fanout: int = FANOUT,
          carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` names further values that stay with each leaf."""
    carry = carry or {}
    spark = docs.sparkSession
    leaves = docs.select(F.col(doc_id).alias("_id"), F.col(group).alias("_group"), leaf_of([F.col(c) for c in columns]).alias("_leaf"),
                         *[v.alias(f"_c_{k}") for k, v in carry.items()])
    placed = _places(materialise(leaves, "digests"))
    member = F.struct("place", F.col("_id").alias("id"), F.col("_leaf").alias("digest"), *[F.col(f"_c_{k}").alias(k) for k in carry])
    runs = placed.groupBy("tree", F.floor(F.col("place") / fanout).alias("run")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(member)).alias("leaves"))
    # a lone leaf is the top of its tree as it is
    runs = materialise(runs.withColumn("hashed", F.col("size") > 1), "runs")
    found = runs.agg(F.max("size"), F.max("tree")).first()
    if found[0] is None:
        none = spark.createDataFrame([], "node struct<tree:bigint,level:int,place:bigint>, before binary, after binary, parent struct<tree:bigint,level:int,place:bigint>")
        return Manifest(runs, none, spark.createDataFrame([], "tree bigint, subroot binary"), None, (0, 0, 0))
    first = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("size") / fanout).alias("size"),
                        F.when(F.col("hashed"), digest(text_of(_joined(F.col("leaves.digest"))))).otherwise(F.col("leaves")[0]["digest"]).alias("digest"),
                        F.struct("tree", F.col("hashed").cast("int").alias("level"), F.col("run").alias("place")).alias("node"))
    tops, nodes = _raise(first, 1, -(-found[0] // fanout), fanout)
    tops = materialise(tops, "tops")
    groups = found[1] + 1
    over = tops.select(F.lit(TOPS).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(groups).cast("long").alias("size"), "digest", "node")
    root, more = _raise(over, 0, groups, fanout)
    nodes = nodes + more
    root = root.first()
    rows = nodes[0] if nodes else tops.select("node", F.lit(b"").alias("before"), F.lit(b"").alias("after"), F.col("node").alias("parent")).limit(0)
    for n in nodes[1:]:
        rows = rows.unionByName(n)
    return Manifest(runs, materialise(rows, "nodes"), tops.select("tree", F.col("digest").alias("subroot")), bytes(root["digest"]).hex(), tuple(root["node"]))


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """A recursive query stops at a million rows by default; the depth of a tree bounds this one."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def climb(manifest: Manifest, leaf: str = "digest") -> DataFrame:
    """tree, id, digest, proof (siblings from the leaf's run to the root, 32 bytes each) and folded (the root that the value ``leaf``
    of each leaf leads to)."""
    spark = manifest.runs.sparkSession
    others = lambda x: _joined(F.transform(F.filter("leaves", lambda o: o["place"] != x["place"]), lambda o: o["digest"]))
    side = lambda x, low: _joined(F.transform(F.filter("leaves", lambda o: (o["place"] < x["place"]) if low else (o["place"] > x["place"])), lambda o: o["digest"]))
    fold = F.transform("leaves", lambda x: digest(F.concat(text_of(side(x, True)), text_of(x[leaf]), text_of(side(x, False)))))
    start = manifest.runs.select(F.col("tree").alias("run_tree"), "run", "tree", F.col("hashed").cast("int").alias("level"), F.col("run").alias("place"),
                                 F.when(F.col("hashed"), fold).otherwise(F.col(f"leaves.{leaf}")).alias("folded"), F.lit(b"").alias("proof"))
    tree, level, place = manifest.top
    with _unlimited(spark):
        risen = spark.sql("""
            with recursive climb(run_tree, run, tree, level, place, folded, proof) as (
                select run_tree, run, tree, level, place, folded, proof from {start}
                union all
                select c.run_tree, c.run, n.parent.tree, n.parent.level, n.parent.place,
                       transform(c.folded, f -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(f)), lower(hex(n.after))), 256))),
                       concat(c.proof, n.before, n.after)
                from climb c join {nodes} n on c.tree = n.node.tree and c.level = n.node.level and c.place = n.node.place)
            select run_tree, run, folded, proof from climb where tree = {tree} and level = {level} and place = {place}""",
                          start=start, nodes=manifest.nodes, tree=tree, level=level, place=place)
        risen = materialise(risen, "risen")
    runs = manifest.runs.join(risen.withColumnRenamed("run_tree", "tree"), ["tree", "run"])
    each = runs.select("tree", "proof", "leaves", F.explode(F.arrays_zip("leaves", "folded")).alias("x"))
    return each.select("tree", "x.leaves.*", F.concat(others(F.col("x.leaves")), F.col("proof")).alias("proof"), F.col("x.folded").alias("folded"))


def verify(docs: DataFrame) -> DataFrame:
    """Of every document the proof that it belongs to the dataset, and whether its text, in which A-Z are lower-cased where 3 divides
    the id's crc32, still leads to the root."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    value = lambda t: leaf_of([t if c == "text" else F.col(c) for c in COLUMNS])
    manifest = build(docs, carry={"now": F.when(hit, value(text)).otherwise(value(F.col("text")))})
    out = climb(manifest, "now").join(broadcast_if_small(manifest.tops), "tree")
    root = F.lit(manifest.root).cast("string")
    return out.select(F.col("id").alias("doc_id"), text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"),
                      F.sha2(text_of(F.col("proof")), 256).alias("proof_sha256"), text_of(F.col("folded")).alias("folded_root"),
                      (text_of(F.col("folded")) == root).alias("verified"))
