"""Merkle manifest of a dataset: leaves, a tree per group, a tree over the groups, and proofs.

Slot pivot.  The nodes of a level stand in order, and ``fanout`` consecutive ones are a run.
Conditional aggregates spread the children of each run into that many columns of one row:
the columns concatenated are hashed to the parent, and all but one of them are the siblings of
that one.  Levels are built upwards from written tables, each a ``fanout`` part of the one
below; paths of siblings come down again by joins on (group, run), and the rows of the lowest
runs are turned back into leaves, so the leaf level is never joined.

Leaves are numbered inside ranges of (group, id, digest) that Spark samples, and shifted by the
sizes of the ranges before, so a group of any size is many tasks.  Groups of any number are
numbered in the same way for the upper tree.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.tables import written

FANOUT = 16
#: One step of a proof: the digests of a run before and after the own one, as hex text one after another.
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*fields: Column) -> Column:
    """Hex sha256 over the fields: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda so_far, step: F.sha2(F.concat(step["before"], so_far, step["after"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path one after another, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _numbered(nodes: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``place`` (0-based, per key) and ``n`` (nodes of the key), whatever share of the rows one key has."""
    by = [*keys, *order]
    ranges = written(nodes.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), f"{name}-ranges")
    earlier = Window.partitionBy(*keys).orderBy("_range")
    sizes = (ranges.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_until", F.sum("_n").over(earlier)).withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)))
             .select(*keys, "_range", (F.col("_until") - F.col("_n")).alias("_before"), "n"))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return (ranges.withColumn("_local", local).join(sizes, [*keys, "_range"])
            .withColumn("place", F.col("_local") + F.col("_before")).drop("_range", "_local", "_before"))


def _runs(nodes: DataFrame, fanout: int, held: list[str]) -> DataFrame:
    """(grp, place, n, digest, s0, s1, ...) of the level above: the children of each run, structs of ``held`` (digest first), as columns."""
    child, slot = F.struct(*held), F.col("place") % fanout
    spread = [F.first(F.when(slot == i, child), ignorenulls=True).alias(f"s{i}") for i in range(fanout)]
    up = nodes.groupBy("grp", F.expr(f"place div {fanout}").alias("run"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("runs")).agg(*spread)
    joined = F.concat(*(F.coalesce(F.col(f"s{i}")[held[0]], F.lit("")) for i in range(fanout)))
    return up.select("grp", F.col("run").alias("place"), F.col("runs").alias("n"), F.sha2(joined, 256).alias("digest"), *(f"s{i}" for i in range(fanout)))


def _children(runs: DataFrame, fanout: int, held: list[str], handed: list[str]) -> DataFrame:
    """The children of runs again, each with its path (its siblings, then the path of its run) and the columns handed down."""
    digest = [F.coalesce(F.col(f"s{i}")[held[0]], F.lit("")) for i in range(fanout)]
    each = []
    for i in range(fanout):
        before, after = (F.concat(*part) if part else F.lit("") for part in (digest[:i], digest[i + 1:]))
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        here = F.struct(F.col(f"s{i}").alias("child"), (F.col("place") * fanout + i).alias("at"), F.concat(step, "path").alias("path"))
        each.append(F.when(F.col(f"s{i}").isNotNull(), here))
    rows = runs.select("grp", *handed, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("c"))
    return rows.select("grp", F.col("c.at").alias("place"), *(F.col(f"c.child.{h}").alias(h) for h in held), F.col("c.path").alias("path"), *handed)


def _tree(nodes: DataFrame, fanout: int, held: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(grp, digest) of the roots of all groups, and the runs of each level from the lowest up.

    ``nodes`` has grp, place, n and the columns ``held``, the digest first.
    """
    levels: list[DataFrame] = []
    roots = nodes.where("n = 1").select("grp", F.col(held[0]).alias("digest"))
    while not nodes.where("n > 1").isEmpty():
        up = written(_runs(nodes.where("n > 1"), fanout, held), f"{name}-{len(levels)}")
        levels.append(up)
        roots = roots.union(up.where("n = 1").select("grp", "digest"))
        nodes, held = up.select("grp", "place", "n", "digest"), ["digest"]
    return roots, levels


def _paths(nodes: DataFrame, levels: list[DataFrame], top: DataFrame, fanout: int, held: list[str], name: str) -> DataFrame:
    """(grp, held, path, handed) of all lowest ``nodes``; ``top`` has grp, path and the columns to hand down, once per group."""
    handed = [c for c in top.columns if c not in ("grp", "path")]
    alone = nodes.where("n = 1").select("grp", *held).join(top, "grp").select("grp", *held, "path", *handed)
    found = None
    for depth in range(len(levels) - 1, -1, -1):
        runs, own = levels[depth].drop("digest"), held if depth == 0 else ["digest"]
        under = runs.where("n = 1").drop("n").join(top, "grp")
        if found is not None:
            under = under.unionByName(runs.where("n > 1").drop("n").join(found, ["grp", "place"]))
        found = _children(under, fanout, own, handed)
        if depth:
            found = written(found.drop("digest"), f"{name}-path-{depth}")
    return alone if found is None else alone.unionByName(found.drop("place"))


def manifest(docs: DataFrame, fields: list[Column], id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT,
             extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, path, and the extra columns) of every row, id and group under their own names.

    A leaf is ``leaf_digest`` of ``fields``.  Leaves of a group stand by id (nulls first), equal
    ids by digest; while a group has more than one node, every ``fanout`` consecutive ones (the
    last run may be shorter, even one) become their hash.  Groups, null first and then by UTF-8
    bytes, make the tree above in the same way.  A row that repeats is a leaf each time; an
    empty table has an empty manifest.  ``extra`` are values that travel with their leaf; names
    taken by others get an underscore.  ``path`` is what ``fold`` and ``siblings`` read.
    """
    grp, key = docs[docs.columns.index(group_col)].cast("string"), docs[docs.columns.index(id_col)]
    extra = extra or {}
    own = [f"x{i}" for i in range(len(extra))]
    rows = docs.select(F.coalesce(F.concat(F.lit("="), grp), F.lit("")).alias("grp"), key.alias("id"), leaf_digest(*fields).alias("leaf"),
                       *(c.alias(n) for n, c in zip(own, extra.values(), strict=True)))
    leaves = written(_numbered(written(rows, "merkle-rows"), ["grp"], ["id", "leaf"], "merkle"), "merkle-leaves")
    held = ["leaf", "id", *own]
    subroots, levels = _tree(leaves, fanout, held, "merkle-low")

    members = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest")
    members = written(_numbered(written(members, "merkle-subroots"), ["grp"], ["member"], "merkle-top"), "merkle-members")
    root, upper = _tree(members, fanout, ["digest", "member"], "merkle-high")
    top = root.select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    over = _paths(members, upper, top, fanout, ["digest", "member"], "merkle-high")
    tips = written(over.select(F.col("member").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "merkle-tips")

    done = _paths(leaves, levels, tips, fanout, held, "merkle-low")
    named = done.select(F.col("id"), F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).alias("grp"), "leaf", "subroot", "root", "path", *own)
    names: list[str] = []
    for name in (id_col, group_col, "leaf", "subroot", "root", "path", *extra):
        while name.lower() in (n.lower() for n in names):
            name += "_"
        names.append(name)
    return named.toDF(*names)
