"""A Merkle manifest of a dataset: one root that fixes every row, and each row's proof.

1. A row's leaf is the digest of its fields. Leaves are numbered within their group in order
   (``operators.sequence`` cuts a large group into slices, so no task sorts a whole group).
2. Each level is a self-join: a node's siblings are the nodes whose index differs in the slot
   alone (index XOR 1 in a binary tree, index + 1 ... index + arity - 1 from slot zero
   otherwise), so slot-zero rows are equijoined with each other slot and emit the parent. A
   node of index zero without siblings is its group's subroot and leaves the loop. Levels are
   written to the shared checkpoint folder; they shrink by the arity, so all levels together
   have about as many rows as the leaves.
3. The subroots, in the order of their groups, are the leaves of one more tree.
4. Proofs are built from the top: a child's path is its run's other children, then its
   parent's path. Every level is one equijoin of runs with their parents' paths. Tables of at
   most ``SMALL`` rows, by a bound that follows from the number of leaves, are broadcast.

The leaves never meet in one task or on the driver, which sees the counts and the root.

Digests are SHA-256; what is hashed is the concatenation of the parts, digests as lowercase
hex text. A field is `-` if null, else its UTF-8 byte count, `:` and the value as text.

Defined cases: the null group is a group of its own and the first; nulls of the order column
come first; equal order values are ordered by their leaf; equal rows are leaves of their own
and interchangeable; a single leaf is its group's subroot, a single subroot the root, with an
empty path; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.components import tasks_for
from sensorlake.operators.sequence import number_rows
from sensorlake.session import scratch_path

#: Rows of a table that is broadcast, at most (paths are about a kilobyte each).
SMALL = 4096
#: Levels of paths in one plan.
LINEAGE = 6

STEP = "struct<before:binary,after:binary>"


def field_text(value: Column) -> Column:
    """A field as it is hashed."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_digest(*values: Column) -> Column:
    """The leaf of a row with these fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_text(digests: Column) -> Column:
    """Several digests as one value: the parts of an array behind each other."""
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex text) that follows from a leaf and the siblings on its path."""

    def up(below: Column, step: Column) -> Column:
        return F.sha2(F.concat(hex_text(step["before"]), below, hex_text(step["after"])), 256)

    return F.aggregate(path, hex_text(leaf), up)


def proof_digest(path: Column) -> Column:
    """The digest (hex text) of all siblings on the path, level by level, left to right."""
    each = F.transform(path, lambda step: hex_text(F.concat(step["before"], step["after"])))
    return F.sha2(F.array_join(each, ""), 256)


@dataclass
class Tree:
    """levels[l]: (tree, idx, children, digest, done) for each run of level l, children an
    array of (digest, payload); a run whose only child is its tree's last node is ``done``."""

    levels: list[DataFrame]
    rows: list[int]  # a bound on the rows of each level
    heights: list[int]  # the levels on which trees end
    arity: int

    def tops(self, height: int) -> DataFrame:
        """(tree, top): the last node of each tree that ends on this level."""
        return self.levels[height].where("done").select("tree", F.col("children")[0].alias("top"))

    def all_tops(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.tops(h) for h in self.heights]).select("tree", "top.digest", "top.payload")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. A checkpoint would pass on what Catalyst knows
    of the columns, which grows with every level."""
    path = scratch_path(df.sparkSession, "merkle")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def build_tree(nodes: DataFrame, arity: int) -> Tree:
    """All levels above ``nodes`` (tree, idx from 0 without gaps, digest, payload)."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("trees")).first()
    rows, levels, bounds = int(size["rows"] or 0), [], []
    # Runs of runs, as long as the largest tree has several nodes; a tree ends on the level
    # whose power reaches its size.
    powers = [arity**k for k in range(64) if arity**k < int(size["most"] or 0)]
    height = reduce(Column.__add__, [F.when(F.col("n") > p, 1).otherwise(0) for p in powers], F.lit(0))
    heights = sorted({0} | {r["h"] for r in sizes.select(height.alias("h")).distinct().collect()})
    while True:
        slots = nodes.withColumn("slot", F.pmod("idx", F.lit(arity)))
        children = [F.struct("digest", "payload")]
        joined = slots.where("slot = 0")
        for slot in range(1, arity):
            # The index that the run's first node has, seen from this slot.
            first = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot
            child = F.struct("digest", "payload").alias(f"child{slot}")
            others = slots.where(F.col("slot") == slot).select("tree", first.alias("idx"), child)
            joined = joined.join(small(others, rows), ["tree", "idx"], "left")
            children.append(F.col(f"child{slot}"))
        runs = joined.select("tree", "idx", F.filter(F.array(*children), lambda c: c.isNotNull()).alias("children"))
        parent = F.unhex(F.sha2(F.array_join(F.transform("children", lambda c: hex_text(c["digest"])), ""), 256))
        level = runs.select(
            "tree",
            F.floor(F.col("idx") / arity).cast("long").alias("idx"),
            "children",
            parent.alias("digest"),
            ((F.col("idx") == 0) & (F.size("children") == 1)).alias("done"),
        )
        rows = -(-rows // arity) + int(size["trees"])
        levels.append(stored(level.coalesce(tasks_for(rows))))
        bounds.append(rows)
        if len(levels) > len(powers):
            return Tree(levels, bounds, heights, arity)
        payload = F.lit(None).cast(nodes.schema["payload"].dataType).alias("payload")
        nodes = levels[-1].where("not done").select("tree", "idx", "digest", payload)


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(tree, payload, leaf, path, and what ``above`` has) for each leaf of the trees.
    ``above``: (tree, path, ...) for each tree, the path of its subroot."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    nodes = None
    for at in reversed(range(len(tree.levels))):
        if nodes is not None:
            runs = tree.levels[at].where("not done").select("tree", "idx", F.posexplode("children").alias("slot", "child"), "children")
            digests = F.transform("children", lambda c: c["digest"])
            before = joined_text(F.slice(digests, F.lit(1), F.col("slot")))
            after = joined_text(F.slice(digests, F.col("slot") + 2, F.lit(tree.arity)))
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            runs = runs.select("tree", "idx", (F.col("idx") * tree.arity + F.col("slot")).alias("own"), "child", step.alias("step"))
            parents = nodes.select("tree", "idx", "path", *carried)
            nodes = runs.join(small(parents, tree.rows[at]), ["tree", "idx"]).select(
                "tree", F.col("own").alias("idx"), "child", F.concat("step", "path").alias("path"), *carried
            )
        if at in tree.heights:
            here = tree.tops(at).join(small(above, tree.rows[-1]), "tree")
            here = here.select("tree", F.lit(0).cast("long").alias("idx"), F.col("top").alias("child"), "path", *carried)
            nodes = here if nodes is None else nodes.unionByName(here)
        if at and at % LINEAGE == 0:  # a small part of the leaves: plans stay short
            nodes = stored(nodes)
    return nodes.select("tree", "child.payload", F.col("child.digest").alias("leaf"), "path", *carried)


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, carry: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``order``, the columns of ``carry`` (name to
    expression over ``docs``), leaf, subroot and root (bytes), and path, an array of (before,
    after): the siblings on either side, from the leaf's run up to the root's."""
    carry = {"key": F.col(f"`{order}`"), **{f"c_{k}": v for k, v in (carry or {}).items()}}
    name = F.col(f"`{group}`").cast("string")
    leaves = docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("tree"),
        record_digest(*[F.col(f"`{f}`") for f in fields]).alias("digest"),
        F.struct(*[v.alias(k) for k, v in carry.items()]).alias("payload"),
        F.col(f"`{order}`").alias("place"),
    )
    leaves = stored(leaves)
    # The numbers are written once, so that no later scan can number equal rows otherwise.
    numbered = number_rows(leaves, ["place", "digest"], "tree", name="idx")
    nodes = stored(numbered.select("tree", (F.col("idx") - 1).alias("idx"), "digest", "payload"))
    tree = build_tree(nodes, arity)

    tops = stored(tree.all_tops().select("tree", "digest"))
    subroots = number_rows(tops, ["tree"], name="idx")
    named = F.struct("tree").alias("payload")
    over = build_tree(stored(subroots.select(F.lit("").alias("tree"), (F.col("idx") - 1).alias("idx"), "digest", named)), arity)
    root = over.all_tops().select("digest").first()
    top = docs.sparkSession.createDataFrame([("", [])], f"tree string, path array<{STEP}>")
    above = paths(over, top).select("payload.tree", F.col("leaf").alias("subroot"), "path")
    above = stored(above)

    found = paths(tree, above)
    return found.select(
        F.col("payload.key").alias(order),
        *[F.col(f"payload.`{c}`").alias(c[2:]) for c in carry if c != "key"],
        "leaf",
        "subroot",
        F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"),
        "path",
    )
