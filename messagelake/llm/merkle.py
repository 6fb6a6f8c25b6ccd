"""Merkle manifest: rows hashed to leaves, a tree over each key, a tree over the keys, and proofs by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, written

#: Bytes of ancestors' segments that may be broadcast in a round, and rows below one ancestor that may meet in one task.
BROADCAST_BYTES, ROWS_A_KEY = 32 << 20, 4096
#: The tree over the keys' roots; keys of rows begin with "-" or ":".
TOP = ""
#: Bytes of a digest.
WIDTH = 32


def leaf_digest(*fields: Column) -> Column:
    """H of a row: each value as "-" if null, else its UTF-8 byte count, a colon and itself; integers in decimal."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(_hex(s["before"]), h, _hex(s["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


def _placed(nodes: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The nodes with `pos`, from 0 in each tree in an order, and `n`, the tree's size; and (tree, n) of all trees.

    Sorted by ranges; a range is offset by what the ranges before hold of a tree. So a tree that a third of the rows
    belong to is dealt over many tasks, and windows see a row for each tree and range.
    """
    rows = kept(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    ends = kept(rows.groupBy("tree", "range").agg(F.min("at").alias("low"), F.count("*").alias("own")))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select(F.col("tree").alias("s_tree"), F.col("range").alias("s_range"), (F.col("low") - before).alias("shift"), F.sum("own").over(tree).alias("n"))
    met = rows.join(starts, (F.col("tree") == F.col("s_tree")) & (F.col("range") == F.col("s_range")))
    return met.withColumn("pos", F.col("at") - F.col("shift")).drop("at", "range", "s_tree", "s_range", "shift"), ends.groupBy("tree").agg(F.sum("own").alias("n"))


def _id(level: int | Column, pos: Column, tree: Column) -> Column:
    return F.concat_ws("/", (F.lit(level) if isinstance(level, int) else level).cast("string"), pos.cast("string"), tree)


def _grown(nodes: DataFrame, largest: int, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of `fan` consecutive nodes become their parents, until each tree has one node. nodes: (tree, pos, n, digest, rest).

    Returns, for each level, its nodes that have a parent: (id, up, digest, proof, rest), the proof being the
    siblings towards the parent; and the roots (id, tree, digest, rest). A run is a group of `fan` rows at most.
    """
    linked, roots, level = [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select(_id(level, F.col("pos"), F.col("tree")).alias("id"), "tree", "digest", "rest"))
        if largest <= 1:
            return linked, _union(roots)
        run = nodes.where("n > 1").withColumn("run", F.floor(F.col("pos") / fan))
        runs = run.groupBy("tree", "run", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "rest"))).alias("kids"))
        runs = kept(runs.withColumn("all", F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), "")))
        kids = runs.select("tree", "run", F.unhex("all").alias("all"), F.posexplode("kids").alias("k", "kid"))
        segment = F.struct(F.substring("all", F.lit(1), F.col("k") * WIDTH).alias("before"), F.substring("all", (F.col("k") + 1) * WIDTH + 1, F.lit(fan * WIDTH)).alias("after"))
        linked.append(kids.select(_id(level, F.col("kid.pos"), F.col("tree")).alias("id"), _id(level + 1, F.col("run"), F.col("tree")).alias("up"), F.col("kid.digest").alias("digest"), F.array(segment).alias("proof"), F.col("kid.rest").alias("rest")))
        none = F.lit(None).cast(nodes.schema["rest"].dataType)
        nodes = runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / fan).alias("n"), F.unhex(F.sha2("all", 256)).alias("digest"), none.alias("rest"))
        largest, level = -(-largest // fan), level + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _jumped(rows: DataFrame, ancestors: DataFrame, few: bool, copies: int) -> DataFrame:
    """Rows one self-join further: their segments, then those of the ancestor they point to, whose pointer they take over.
    Ancestors go out to all if they are few; else each is sent to as many places as its descendants are dealt over."""
    facts = ancestors.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("proof").alias("a_proof"), F.col("subroot").alias("a_subroot"), F.col("root").alias("a_root"))
    if few:
        met = rows.join(F.broadcast(facts), F.col("up") == F.col("a_id"), "left")
    elif copies == 1:
        met = rows.join(facts, F.col("up") == F.col("a_id"), "left")
    else:
        facts = facts.withColumn("a_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        rows = rows.withColumn("copy", F.pmod(F.xxhash64("digest"), F.lit(copies)).cast("int"))
        met = rows.join(facts, (F.col("up") == F.col("a_id")) & (F.col("copy") == F.col("a_copy")), "left").drop("copy", "a_copy")
    proof = F.when(F.col("a_id").isNull(), F.col("proof")).otherwise(F.concat("proof", "a_proof"))
    changed = {"proof": proof, "up": F.col("a_up"), "subroot": F.coalesce("subroot", "a_subroot"), "root": F.coalesce("root", "a_root")}
    return met.withColumns(changed).drop("a_id", "a_up", "a_proof", "a_subroot", "a_root")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...], tree_col: str, order_col: str, fan: int = 8, carry: tuple[str, ...] = (), broadcast_bytes: int = BROADCAST_BYTES, rows_a_key: int = ROWS_A_KEY) -> DataFrame:
    """(order_col, leaf, subroot, root, proof, columns to carry) of every row; digests in hex.

    A leaf is the digest of the row's fields. In each tree_col, leaves ascend by order_col and every `fan` consecutive nodes
    become their digest until one is left, the subroot; subroots, by tree_col with null first, bytewise, become the
    root in the same way. proof lists for each level the digests before and after the own one in its run, as bytes.

    Every node starts with a pointer to its parent and the siblings towards it. Rounds of self-joins put the ancestor's
    segment behind the own one and take over its pointer, so after as many rounds as the logarithm of the height all
    proofs reach the root. Only inner nodes, an eighth of all, are written in a round; leaves pass through the rounds'
    ancestors in one plan. In a round at distance d an ancestor has fan^d leaves below: beyond `broadcast_bytes`,
    its leaves are dealt over so many copies of it that `rows_a_key` meet in one place. Texts are read once and never moved.

    Nulls in fields are hashed as such; a null order value comes first, equal ones are ordered by leaf. Rows
    that repeat each are leaves. Carried columns must be orderable. Other columns are ignored; no rows give none.
    """
    key = F.when(F.col(tree_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(tree_col).cast("string")))
    rest = F.struct(F.col(order_col).alias("key"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    leaves = written(docs.select(key.alias("tree"), F.unhex(leaf_digest(*(F.col(f) for f in fields))).alias("digest"), rest.alias("rest")), "leaves")
    nodes, trees = _placed(leaves.withColumn("order", F.col("rest.key")), "order", "digest")
    size = trees.agg(F.max("n").alias("largest"), F.sum("n").alias("rows"), F.count("*").alias("trees")).first()
    linked, roots = _grown(nodes.drop("order"), size["largest"] or 0, fan)

    named = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("order"), "digest", F.struct("id").alias("rest"))
    tops, _ = _placed(named, "order")
    above, crown = _grown(tops.drop("order"), size["trees"], fan)

    none, empty = F.lit(None).cast("binary"), F.array().cast("array<struct<before:binary,after:binary>>")
    inner = [part.select("id", "up", "digest", "proof", none.alias("subroot"), none.alias("root"), F.lit(k).alias("height")) for k, part in enumerate(linked) if k]
    inner += [part.select("rest.id" if not k else "id", "up", "digest", "proof", (F.col("digest") if not k else none).alias("subroot"), none.alias("root"), F.lit(None).cast("int").alias("height")) for k, part in enumerate(above)]
    lone = size["trees"] == 1
    inner.append(crown.select("rest.id" if lone else "id", F.lit(None).cast("string").alias("up"), "digest", empty.alias("proof"), (F.col("digest") if lone else none).alias("subroot"), F.col("digest").alias("root"), F.lit(None).cast("int").alias("height")))
    inner = kept(_union(inner))

    own = nodes.where("n = 1").select(F.lit(None).cast("string").alias("id"), _id(0, F.col("pos"), F.col("tree")).alias("up"), "digest", empty.alias("proof"), "rest")
    rows = own if not linked else linked[0].unionByName(own)
    rows = rows.select("up", "digest", "proof", "rest", none.alias("subroot"), none.alias("root"))
    distance, height = 1, max(len(linked), 1) + len(above)
    while True:
        ancestors = inner.where(F.col("height").isNull() | (F.col("height") >= distance))
        count = (size["rows"] or 0) // fan**distance + distance + 2 * size["trees"]
        few = count * (distance * (fan - 1) * WIDTH + 256) <= broadcast_bytes
        copies = max(1, fan**distance // rows_a_key)
        rows = _jumped(rows, ancestors, few, copies)
        if 2 * distance > height:
            break
        inner = kept(_jumped(inner, ancestors, few, copies))
        distance *= 2
    return rows.select(F.col("rest.key").alias(order_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "proof", *(F.col(f"rest.c{k}").alias(c) for k, c in enumerate(carry)))
