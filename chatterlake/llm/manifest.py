"""Merkle dataset manifest: a hash tree over rows within groups and over the groups, with a proof for every row.

Leaves of a group stand in the order of their ids; every FANOUT consecutive nodes (the last run may have fewer, even one)
become the hash of their digests, until one node is left. The groups' last nodes, in the order of their names,
become one root in the same way.

Leaves are dealt out in aligned blocks of FANOUT^BLOCK_LEVELS consecutive ones, and each block hashes its own subtree.
The levels above are a butterfly exchange: in round r, blocks whose numbers differ in digit r alone (to the base FANOUT)
swap the subtree roots they have, so each has the whole run, hashes the common ancestor itself, and keeps the
others as the next step of its proofs. After the last round every block knows the root and all upper proofs;
nothing is passed down again. At the ragged end, where a subtree has fewer blocks than its neighbours, its blocks share
the neighbours' requests among them. All of it is built-in expressions.

Defined results: equal ids stand in the order of their leaves, so repeated rows are leaves side by side; a null id
comes first, a null group too; null values hash as ``-``, unlike empty texts; an empty table gives an empty result; columns
that aren't hashed are not read. The manifest holds for values as Spark prints them (integers decimal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved, small

FANOUT = 8
#: Levels within a block: 512 leaves, whose digests are 32 KB.
BLOCK_LEVELS = 3


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def runs_of(nodes: Column) -> Column:
    """The runs of FANOUT consecutive nodes."""
    starts = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(FANOUT))
    return F.when(F.size(nodes) > 0, F.transform(starts, lambda i: F.slice(nodes, i + 1, FANOUT))).otherwise(F.array().cast("array<array<string>>"))


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def step(run: Column, place: Column) -> Column:
    """What stands before and after a place (0 on) in a run: a step of a proof."""
    return F.struct(joined(F.slice(run, F.lit(1), place)).alias("before"), joined(F.slice(run, place + 2, FANOUT)).alias("after"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right, in one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``place``, from 0 within the group. The sort deals rows out by ranges; a place is what the group has in the
    ranges before, and the place within the range."""
    parts = saved(rows.orderBy(group, *order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()), name)
    sizes = parts.groupBy(group, "__part").agg(F.count("*").alias("size"), F.min("__n").alias("first"))
    # windowed is a row for each range that has the group, not the rows
    before = F.sum("size").over(Window.partitionBy(group).orderBy("__part")) - F.col("size")
    starts = small(saved(sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), "first", before.alias("before")), f"{name}-starts"))
    both = parts.join(starts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return both.select(*rows.columns, (F.col("before") + F.col("__n") - F.col("first")).alias("place"))


def own_trees(leaves: DataFrame, group: str, levels: int) -> DataFrame:
    """(group, block, blocks, members, level0 ..: the nodes of each level). A block that isn't its group's only one
    rises to the full number of levels, the last too, so that blocks meet at the same height."""
    size = FANOUT**levels
    kept = [c for c in leaves.columns if c not in (group, "place")]
    sizes = leaves.groupBy(group).agg(F.max("place").alias("last")).select(F.col(group).alias("__group"), (F.floor(F.col("last") / size) + 1).alias("blocks"))
    blocks = leaves.groupBy(group, F.floor(F.col("place") / size).alias("block")).agg(F.collect_list(F.struct("place", *kept)).alias("members"))
    # places differ, so the order is theirs
    blocks = blocks.join(small(saved(sizes, "sizes")), F.col(group).eqNullSafe(F.col("__group"))).withColumn("members", F.array_sort("members"))
    rows = blocks.select(group, "block", "blocks", "members", F.col("members.leaf").alias("level0"))
    for k in range(1, levels + 1):
        under = F.col(f"level{k - 1}")
        done = (F.col("blocks") == 1) & (F.size(under) <= 1)
        rows = rows.withColumn(f"level{k}", F.when(done, F.array().cast("array<string>")).otherwise(F.transform(runs_of(under), lambda run: digest(joined(run)))))
    return rows


def partners(width: Column, block: Column, blocks: Column) -> Column:
    """The blocks that a block sends its subtree's root to in the round of subtrees of ``width`` blocks, with the
    place it has in their run. In a full subtree it is the one of the same offset in each sibling; a ragged last subtree of
    m blocks serves all offsets that agree modulo m."""
    first = F.floor(block / (width * FANOUT)) * width * FANOUT  # of the run's subtrees
    own = F.floor((block - first) / width)
    offset = (block - first) % width
    here = F.least(width, blocks - first - own * width)  # blocks of the own subtree
    last = F.floor((F.least(blocks - first, width * FANOUT) - 1) / width)
    offsets = F.sequence(offset, width - 1, here)
    to = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda d: F.transform(offsets, lambda o: first + d * width + o)))
    return F.transform(F.filter(to, lambda b: b < blocks), lambda b: F.struct(b.alias("to"), own.alias("digit")))


def tops(blocks: DataFrame, group: str, levels: int) -> DataFrame:
    """(group, block, blocks, node): the only node of each block's highest level."""
    own = [F.col(f"level{k}") for k in range(levels, -1, -1)]
    return blocks.select(group, "block", "blocks", F.coalesce(*(F.when(F.size(c) > 0, c[0]) for c in own)).alias("node"))


def butterfly(start: DataFrame, group: str) -> DataFrame:
    """``start``: (group, block, blocks, node). Returns (group, block, upper: steps of proofs above the block, root)."""
    most = start.agg(F.max("blocks")).first()[0] or 1
    state, width = start.withColumn("upper", F.array().cast("array<struct<before: string, after: string>>")), 1
    while width < most:
        sent = state.select(group, "blocks", "node", F.explode(partners(F.lit(width).cast("long"), F.col("block"), F.col("blocks"))).alias("x"))
        # at most FANOUT nodes for each block
        got = sent.groupBy(group, F.col("x.to").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("x.digit").alias("digit"), "node"))).alias("run"))
        got = got.select(F.col(group).alias("__group"), F.col("block").alias("__block"), F.col("run.node").alias("run"))
        met = state.join(got, F.col(group).eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__block")))
        digit = (F.floor(F.col("block") / width) % FANOUT).cast("int")
        on = F.col("blocks") > width  # a group of fewer blocks is done
        state = saved(
            met.select(
                group,
                "block",
                "blocks",
                F.when(on, digest(joined(F.col("run")))).otherwise(F.col("node")).alias("node"),
                F.when(on, F.concat("upper", F.array(step(F.col("run"), digit)))).otherwise(F.col("upper")).alias("upper"),
            ),
            "butterfly",
        )
        width *= FANOUT
    return state.select(group, "block", "upper", F.col("node").alias("root"))


def proofs(blocks: DataFrame, known: DataFrame, group: str, levels: int) -> DataFrame:
    """A row a leaf: the columns of ``known`` but block and upper, the members' columns, and path. Blocks are taken apart
    in one projection of plain expressions, so their arrays aren't copied for each leaf."""
    told = known.withColumnsRenamed({group: "__group", "block": "__block"})
    met = blocks.join(told, F.col(group).eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__block")))
    more = [c for c in told.columns if c not in ("__group", "__block", "upper")]
    met = met.select(group, "members", "upper", *more, *(runs_of(F.col(f"level{k}")).alias(f"runs{k}") for k in range(levels)), *(F.size(f"level{k + 1}").alias(f"up{k}") for k in range(levels)))
    each = met.select(group, "upper", *more, *(f"{c}{k}" for c in ("runs", "up") for k in range(levels)), F.posexplode("members").alias("at", "member"))
    none, steps = F.array().cast("array<struct<before: string, after: string>>"), []
    for k in range(levels):
        place = F.floor(F.col("at") / FANOUT**k).cast("int")
        steps.append(F.when(F.col(f"up{k}") > 0, F.array(step(F.col(f"runs{k}")[F.floor(place / FANOUT).cast("int")], place % FANOUT))).otherwise(none))
    return each.select(group, *more, "member.*", F.concat(*steps, "upper").alias("path"))


def manifest(rows: DataFrame, group: str, order: list[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """``rows``: the group, columns to order by, ``leaf``, and others to keep. Adds place (from 0 in the group), subroot (the
    group's), root (of all groups) and path: the steps of the proof, from the leaf to the root. ``order`` must tell
    rows with different leaves apart."""
    blocks = saved(own_trees(numbered(rows, group, order, "leaves"), group, levels), "blocks")
    known = butterfly(saved(tops(blocks, group, levels), "tops"), group)
    # the groups' roots are the leaves of one more tree
    names = known.where("block = 0").select(F.lit(0).alias("__all"), F.col(group).alias("__name"), F.col("root").alias("leaf"))
    above = saved(own_trees(numbered(names, "__all", ["__name"], "names"), "__all", levels), "names-blocks")
    upper = proofs(above, butterfly(saved(tops(above, "__all", levels), "names-tops"), "__all"), "__all", levels)
    upper = small(saved(upper.select("__name", F.col("leaf").alias("subroot"), F.col("root").alias("__root"), F.col("path").alias("__path")), "upper"))
    known = known.join(upper, F.col(group).eqNullSafe(F.col("__name"))).select(group, "block", "subroot", F.col("__root").alias("root"), F.concat("upper", "__path").alias("upper"))
    return proofs(blocks, known, group, levels)


def document_manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = BLOCK_LEVELS, altered: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path) for each row; with ``altered`` (new values of some fields), also altered_leaf."""
    values = {c: F.col(c) for c in fields}
    rows = docs.select(F.col(id_col).alias("__id"), F.col(group).cast("string").alias("__name_of_group"), leaf_of(*values.values()).alias("leaf"), *([leaf_of(*(values | altered).values()).alias("altered_leaf")] if altered else []))
    out = manifest(rows, "__name_of_group", ["__id", "leaf"], levels)
    return out.select(F.col("__id").alias(id_col), "leaf", *(["altered_leaf"] if altered else []), "subroot", "root", "path")
