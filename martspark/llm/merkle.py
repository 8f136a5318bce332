"""Merkle manifest of a table: a level of a block is one string of hex digests, parents are hashes of its substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.llm.common import text_or_empty
from martspark.session import stage

# Fixed by the contract: children of a node, and the digits of a digest.
FAN = 16
_HEX = 64
# Levels that a block keeps: 16 * 16 * 16 nodes make one block, whose strings have at most 256 KiB.
_LEVELS = 3
BLOCK = FAN**_LEVELS
# Every fifth document, by checksum of its id, is tampered with.
_TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """`-` for NULL, else the length in bytes, a colon and the value."""
    plain = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the digest of each row, and after tampering (NULL where it is not tampered with).

    `doc_id` and `n_chars` are integers. A row without id is not tampered with.
    """
    known = [F.col(c) for c in FIELDS[:-1]]
    text = F.col("text").cast("string")
    hit = F.crc32(text_or_empty("doc_id")) % F.lit(_TAMPERED) == 0
    lower = F.translate(text, _UPPER, _LOWER)
    return docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_digest(*known, text).alias("leaf"),
        F.when(F.col("doc_id").isNotNull() & hit, leaf_digest(*known, lower)).alias("tampered"),
    )


def ordered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with gid and pos, the places of their group among the groups and of the row in its group, from 0, and size.

    Groups and rows ascend, NULL first. The rows are written once in ranges of the whole order, so that the place is
    the row number in the file, shifted by what the files before hold: no group, however large, is ranked in
    one task. The shifts come from one count for each group and file.
    """
    by = [group, *order]
    # A range for each file; equal rows may share a place in the order, their digests are the same then.
    sorted_rows = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in by]
    )
    written = stage(sorted_rows, "ordered")
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    placed = written.select("*", number.alias("file"), F.col("_metadata.row_index").alias("row"))
    runs = placed.groupBy("file", group).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy(group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs = stage(runs, "runs")
    # A group is numbered where it begins: by the groups that begin in earlier files, and in its file.
    begins = runs.where("before = 0")
    files = begins.groupBy("file").agg(F.count(F.lit(1)).alias("groups"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shifts = files.select("file", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("file").orderBy("first")) - 1
    gids = begins.withColumn("inside", inside).join(shifts, "file").select(
        F.col(group).alias("group_"), (F.col("shift") + F.col("inside")).cast("long").alias("gid")
    )
    sizes = runs.groupBy(group).agg(F.sum("n").alias("size"))
    known = runs.join(sizes.withColumnRenamed(group, "sized_"), F.col(group).eqNullSafe(F.col("sized_")))
    known = known.join(gids, F.col(group).eqNullSafe(F.col("group_"))).select(
        F.col("file").alias("file_"), F.col(group).alias("of_"), "before", "first", "gid", "size"
    )
    same = (F.col("file") == F.col("file_")) & F.col(group).eqNullSafe(F.col("of_"))
    pos = (F.col("before") + F.col("row") - F.col("first")).cast("long").alias("pos")
    return placed.join(known, same).select(*rows.columns, "gid", pos, "size")


def _nodes_at(size: Column, level: int) -> Column:
    """The nodes of a level above `size` nodes."""
    return F.ceil(size / F.lit(FAN**level)).cast("long")


def _parents(level: Column) -> Column:
    """The level above a level string."""
    run = FAN * _HEX
    runs = F.ceil(F.octet_length(level) / F.lit(run)).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)
    )
    return F.array_join(hashed, "").cast("binary")


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """(gid, block, size, items, s0, s1, s2, top): aligned runs of nodes (gid, pos, size, node) with their levels.

    Level strings hold the digests of a block one after the other. A parent is the hash of a substring of 16
    digests, so a level is hashed by cutting its string. `top` is the digest that remains: the block's node
    three levels up, or the root if the group ends in this block. A level is built only while the group has several
    nodes. Items are (pos, node, carried columns), ascending.
    """
    item = F.struct("pos", "node", *carried)
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    found = nodes.groupBy("gid", block).agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items")
    )
    # Binary, in which a substring is found without reading what is in front of it.
    levels = found.withColumn("s0", F.array_join(F.transform("items", lambda i: i["node"]), "").cast("binary"))
    for level in range(1, _LEVELS + 1):
        below = F.col(f"s{level - 1}")
        # Where one node is left the level stays as it is.
        several = _nodes_at(F.col("size"), level - 1) > 1
        levels = levels.withColumn(f"s{level}", F.when(several, _parents(below)).otherwise(below))
    return levels.withColumn("top", F.col(f"s{_LEVELS}").cast("string")).drop(f"s{_LEVELS}")


def _siblings(string: Column, place: Column) -> Column:
    """The digests around a node in its run: what stands in front of it and behind it."""
    own = (place * F.lit(_HEX)).cast("int")
    start = (F.floor(place / FAN) * F.lit(FAN * _HEX)).cast("int")
    behind = own + F.lit(_HEX)
    return F.struct(
        F.substring(string, start + 1, own - start).cast("string").alias("left"),
        F.substring(string, behind + 1, start + F.lit(FAN * _HEX) - behind).cast("string").alias("right"),
    )


def _own_path(place: Column, size: Column) -> Column:
    """The siblings of a node within its block, level by level."""
    steps = [
        F.when(_nodes_at(size, level) > 1, F.array(_siblings(F.col(f"s{level}"), F.floor(place / F.lit(FAN**level)))))
        for level in range(_LEVELS)
    ]
    none = F.array().cast("array<struct<left:string,right:string>>")
    return F.concat(*[F.coalesce(s, none) for s in steps])


def _exploded(made: DataFrame, *names: str) -> DataFrame:
    """A row for each node of the blocks: gid, block, the named fields of its item, and the path inside its block."""
    fields = ("pos", "node", *names)
    rows = made.select(
        "gid", "block", "size", "s0", "s1", "s2", F.posexplode("items").alias("place", "item")
    )
    return rows.select(
        "gid", "block", *[F.col(f"item.{n}").alias(n) for n in fields], _own_path(F.col("place"), F.col("size")).alias("path")
    )


def tree(nodes: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of each group of nodes (gid, pos, size, node): its blocks, the paths above them, and the roots.

    Returns the staged blocks, (gid, block, path) with the siblings between a block's top and the root, and
    (gid, root). The tops of blocks are the nodes of the next round, so rounds grow with the logarithm of the largest
    group, and each has 4096 times fewer nodes than the one below.
    """
    rounds = [stage(blocks(nodes, *carried), "merkle-blocks")]
    while True:
        last = rounds[-1]
        if last.where(F.col("size") > BLOCK).isEmpty():
            break
        # Three levels up, groups of one block have ended.
        above = last.where(F.col("size") > BLOCK).select(
            "gid", F.col("block").alias("pos"), _nodes_at(F.col("size"), _LEVELS).alias("size"), F.col("top").alias("node")
        )
        rounds.append(stage(blocks(above), "merkle-blocks"))
    roots, paths = None, None
    for made in reversed(rounds):
        ended = made.where(F.col("size") <= BLOCK)
        done = ended.select("gid", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        none = F.array().cast("array<struct<left:string,right:string>>").alias("path")
        at_root = ended.select("gid", "block", none)
        if paths is None:
            paths = at_root
        else:
            paths = at_root.unionByName(higher.join(paths.withColumnRenamed("path", "rest"), ["gid", "block"]).select(
                "gid", F.col("pos").alias("block"), F.concat("path", "rest").alias("path")
            ))
            paths = stage(paths, "merkle-paths")
        higher = _exploded(made)
    return rounds[0], paths, roots


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree over all rows: (doc_id, source, leaf, tampered, path, subroot, root), and (source, rows, subroot, root).

    A path lists for each level the digests (left, right) around the node, from the leaf by the root of its source to
    the root of all. Rows of a source ascend by id, NULL first, ties by digest; sources ascend by their bytes, NULL first.
    Repeated rows are leaves of their own. An empty table has no rows and no root.
    """
    # Written first: the ranges of the order are sampled from their input, which would hash all texts twice.
    placed = ordered(stage(leaves(docs), "leaves"), "source", "doc_id", "leaf")
    made, above, subroots = tree(
        placed.select("gid", "pos", "size", F.col("leaf").alias("node"), "doc_id", "source", "tampered"),
        "doc_id", "source", "tampered",
    )
    subroots = stage(subroots, "subroots")
    number = subroots.count()
    top = subroots.select(
        F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(number).cast("long").alias("size"),
        F.col("root").alias("node"),
    )
    top_made, top_above, roots = tree(top)
    to_root = _exploded(top_made).join(top_above.withColumnRenamed("path", "rest"), ["gid", "block"]).join(roots, "gid")
    to_root = to_root.select(
        F.col("pos").alias("gid"), F.col("node").alias("subroot"), F.concat("path", "rest").alias("beyond"), "root"
    )
    # Paths are joined to the blocks, of which there is one for 4096 rows, and spread to the rows with them.
    joined = made.join(above.join(to_root, "gid"), ["gid", "block"])
    rows = joined.select(
        "size", "s0", "s1", "s2", F.concat("path", "beyond").alias("rest"), "subroot", "root",
        F.posexplode("items").alias("place", "item"),
    )
    whole = F.concat(_own_path(F.col("place"), F.col("size")), F.col("rest")).alias("path")
    found = rows.select(
        "item.doc_id", "item.source", F.col("item.node").alias("leaf"), "item.tampered", whole, "subroot", "root"
    )
    names = made.where("block = 0").select("gid", F.col("items")[0]["source"].alias("source"), F.col("size").alias("rows"))
    sources = names.join(to_root, "gid").select("source", "rows", "subroot", "root")
    return found, sources


def verify(found: DataFrame) -> DataFrame:
    """The digests of a manifest and whether its rows, some of them tampered with, still lead to the root."""
    leaf = F.coalesce("tampered", "leaf")
    checked = found.withColumn("folded_root", fold(leaf, F.col("path")))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
