"""Near duplicates by a chosen-path set similarity join over minwise tokens, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few_files, kept, steps, text_buffers, whole_groups, written
from .textscan import FOLD, NOT_SPACE, mix, powers, prefix, runs, stretch

#: Minwise tokens of a set, each of 16 bits: the low bytes serve to compare, both to branch.
TOKENS = 128
#: Independent trees. Two sets of similarity 0.8 are together at level 3 of one tree with a chance of 0.375, so 24 miss 1 in
#: 60,000 there; the chance falls to 0.12 at level 12, and sets that are dealt further than SURE levels get more trees.
TREES, SURE, MISS = 24, 3, 1 / 60_000
#: Sets that a node compares exhaustively, at most; larger nodes branch, down to DEPTH levels, or are gathered whole.
SMALL, DEPTH = 2048, 12
#: What is known of each large node is broadcast if there are fewer of them than this.
FEW = 100_000
#: Share of equal tokens from which two sets are taken for a family: five standard deviations below the threshold.
ALIKE = 0.62
#: Distinct sets of a family that are confirmed together; larger families are dealt into blocks that meet in pairs. A set of
#: more than LONG shingles counts as several, so long texts don't pile up in a task.
FAMILY, LONG = 4000, 4096


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) of the distinct shingles of k words, sorted by text and then shingle; fewer words are one shingle."""
    data = FOLD[data]
    first, last, text = runs(data, at, NOT_SPACE)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(at) - 1
    words = stretch(prefix(data), first, last)
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    count = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    many = np.where(count == 0, 0, np.maximum(1, count - k + 1))
    owner = np.repeat(np.arange(n), many)
    low = begin[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(k, count[owner])
    value = mix(mix((sums[low + size] - sums[low]) * down[low]) + size.astype(np.uint64))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def minwise(value: np.ndarray, begin: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """Tokens of 64 bits for each set: from the smallest of its shingles under each of so many hashes."""
    r = np.random.default_rng(97)
    factor = r.integers(1, 1 << 62, tokens, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    add = r.integers(1, 1 << 62, tokens, dtype=np.int64).astype(np.uint64)
    out = np.empty((len(begin), tokens), np.uint64)
    for k in range(tokens):
        out[:, k] = mix(np.minimum.reduceat(value * factor[k] + add[k], begin) + np.uint64(k))
    return out


def _profiles(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """(id, text_hash, n_shingles, sid, tokens, high, roots) of each text: sid is a 128-bit hash of its set, null for an empty one;
    roots are its whole first tokens, under which the trees begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            for low, high in steps(at, 1 << 20):
                value, text = shingles(data[at[low] : at[high]], at[low : high + 1] - at[low], k)
                count = np.bincount(text, minlength=high - low)
                full = np.flatnonzero(count)
                sid, tokens, upper, roots = ([None] * (high - low) for _ in range(4))
                if len(full):
                    begin = np.concatenate([[0], np.cumsum(count[full])])[:-1]
                    found = minwise(value, begin)
                    a, b = np.add.reduceat(mix(value), begin), np.add.reduceat(mix(value + np.uint64(0x51ED)), begin)
                    ids = np.stack([mix(a), mix(b + np.uint64(1))], 1)
                    for j, i in enumerate(full.tolist()):
                        sid[i], tokens[i], upper[i] = ids[j].tobytes(), found[j].astype(np.uint8).tobytes(), (found[j] >> np.uint64(8)).astype(np.uint8).tobytes()
                        roots[i] = found[j, :trees].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(low, high - low), batch["text_hash"].slice(low, high - low), pa.array(count, pa.int64()), pa.array(sid, pa.binary()), pa.array(tokens, pa.binary()), pa.array(upper, pa.binary()), pa.array(roots, pa.list_(pa.int64()))], ["id", "text_hash", "n_shingles", "sid", "tokens", "high", "roots"])

    return docs.mapInArrow(run, "id long, text_hash long, n_shingles long, sid binary, tokens binary, high binary, roots array<long>")


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    return _bytes(batch["tokens"]).astype(np.uint64) | _bytes(batch["high"]).astype(np.uint64) << np.uint64(8)


def _children(batch: pa.RecordBatch, level: int, chance: float) -> pa.ListArray:
    """The nodes one level down of each row: its node chooses each token with the chance, alike for all its sets."""
    each = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(level))
    path = batch["path"].to_numpy().astype(np.int64).view(np.uint64)
    chosen = mix(path[:, None] ^ each) < np.uint64(chance * 2.0**64)
    row, token = np.nonzero(chosen)
    t = _tokens(batch)[row, token]
    child = mix(mix(path[row] + np.uint64(level)) ^ (t | (token.astype(np.uint64) + np.uint64(1)) << np.uint64(32)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(chosen.sum(1))]).astype(np.int32)), pa.array(child.view(np.int64)))


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b): for each node edges that connect what its pairs of alike sets connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "path", 20_000):
            path = table["path"].to_numpy()
            tokens, sid = _bytes(table["tokens"]), table["sid"].to_pylist()
            begin = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            end = np.append(begin[1:], len(path))
            pairs = []
            size = end - begin
            for own in np.unique(size[size > 1]).tolist():
                i, j = np.triu_indices(own, 1)
                blocks = begin[size == own]
                for k in range(0, len(blocks), max(1, 100_000 // len(i))):
                    low = blocks[k : k + max(1, 100_000 // len(i)), None]
                    pairs.append(_likely((low + i).ravel(), (low + j).ravel(), tokens))
            found = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
            label = clusters(len(path), found[0], found[1])
            moved = np.flatnonzero(label != np.arange(len(path)))
            yield pa.RecordBatch.from_arrays([pa.array([sid[k] for k in moved.tolist()], pa.binary()), pa.array([sid[k] for k in label[moved].tolist()], pa.binary())], ["a", "b"])

    return nodes.mapInArrow(run, "a binary, b binary")


def _near_first(nodes: DataFrame, level: int, chance: float, small_side: Callable[[DataFrame], DataFrame], rows: int) -> DataFrame:
    """(path, sid, first, alike, children): each set of a node beside the node's smallest, whether the two are alike, and the
    nodes that it goes to if its node branches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = (_bytes(batch["tokens"]) == _bytes(batch["first_tokens"])).sum(1, dtype=np.uint8) >= ALIKE * TOKENS
                yield pa.RecordBatch.from_arrays([batch["path"], batch["sid"], batch["first"], pa.array(alike), _children(batch, level, chance)], ["path", "sid", "first", "alike", "children"])

    first = nodes.groupBy("path").agg(F.min(F.struct("sid", "tokens")).alias("low"))
    first = small_side(first.select("path", F.col("low.sid").alias("first"), F.col("low.tokens").alias("first_tokens")))
    beside = nodes.join(first, "path").select("path", "sid", "tokens", "high", "first", "first_tokens")
    return few_files(beside, rows).mapInArrow(run, "path long, sid binary, first binary, alike boolean, children array<long>")


def _more_roots(sets: DataFrame, begin: int, end: int) -> DataFrame:
    """(path, sid) under which the trees begin to end - 1 start, each with one token of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(begin, end, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows:
                path = mix(mix(tree + np.uint64(0x6A09)) ^ _tokens(batch)[:, np.arange(begin, end) % TOKENS])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64).ravel()), batch["sid"].take(pa.array(np.repeat(np.arange(batch.num_rows), end - begin)))], ["path", "sid"])

    return sets.mapInArrow(run, "path long, sid binary")


def _likely(a: np.ndarray, b: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    good = [np.flatnonzero((tokens[a[k : k + 50_000]] == tokens[b[k : k + 50_000]]).sum(1, dtype=np.uint8) >= ALIKE * TOKENS) + k for k in range(0, len(a), 50_000)]
    good = np.concatenate(good) if good else np.zeros(0, np.int64)
    return np.stack([a[good], b[good]])


def clusters(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n things the smallest that pairs lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            return label


def meeting(depth: int, threshold: float) -> float:
    """The chance that two sets of the threshold's similarity are still together at a level of one tree."""
    equal, chance = round(threshold * TOKENS), 1.0
    for _ in range(depth - 1):
        chance = 1 - (1 - chance / (threshold * TOKENS)) ** equal
    return threshold * chance


def trees_for(depth: int, threshold: float) -> int:
    """Trees of so many levels that miss two sets of the threshold's similarity with a chance below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - meeting(depth, threshold)))


def _candidates(sets: DataFrame, threshold: float, trees: int, small: int) -> DataFrame:
    """Edges (a, b), some more than once, between sets that pairs of alike sets in a node of a tree connect. Sets that the trees deal further
    than SURE levels get as many trees more as the levels reached need."""
    found, deep, depth = _grown(sets.select(F.explode("roots").alias("path"), "sid"), sets, threshold, small, DEPTH)
    if deep is not None:
        more = _more_roots(deep.join(sets.select("sid", "tokens", "high"), "sid"), trees, trees + trees_for(depth, threshold))
        found = found.union(_grown(more, sets, threshold, small, depth)[0])
    return found


def _grown(level: DataFrame, sets: DataFrame, threshold: float, small: int, most: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(edges, sets dealt further than SURE levels, levels): small nodes of all levels are compared exhaustively, together. A large
    node is one family at once if half of its sets are alike its first, or if it is left at the last level: a family is confirmed
    on full sets, so what is gathered too much costs time and no link. Other large nodes branch."""
    leaves, edges, deep = [], [], None
    for depth in range(1, most + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        nodes = written(level.join(sizes, "path"), "nodes")
        leaves.append(nodes.where(F.col("size") <= small).select("path", "sid"))
        large = nodes.where(F.col("size") > small).select("path", "sid")
        rows = large.count()
        if not rows:
            break
        small_side = F.broadcast if rows // small < FEW else lambda df: df
        large = large.join(sets.select("sid", "tokens", "high"), "sid").select("path", "sid", "tokens", "high")
        near = written(_near_first(large, depth, 1 / (threshold * TOKENS), small_side, rows), "near")
        share = near.groupBy("path").agg((F.lit(depth == most) | (F.avg(F.col("alike").cast("int")) >= 0.5)).alias("family"))
        share = written(few_files(share, rows // small), "families")
        near = near.join(small_side(share), "path")
        edges.append(near.where("(family or alike) and sid != first").select(F.col("sid").alias("a"), F.col("first").alias("b")))
        if depth == most or share.where("not family").isEmpty():
            break
        rest = near.where("not family")
        if depth == SURE:
            deep = rest.select("sid").distinct()
        level = rest.select(F.explode("children").alias("path"), "sid")
    compared = reduce(DataFrame.union, leaves).join(sets.select("sid", "tokens"), "sid").select("path", "sid", "tokens")
    # a node's edges lead to the smallest set, so those of several nodes are mostly the same
    return reduce(DataFrame.union, edges, _alike(compared.repartition("path").sortWithinPartitions("path", "sid"))), deep, depth


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of families, b the smallest id that links of the family reach: members are (family, id, tokens, content), complete families together.
    With (side, label) also: only sets of different sides meet, and those of one label are linked already.

    Pairs are tried in the order of their likeness and confirmed on their full sets, unless links found before
    connect them already; so every link between two sets joins them, and no family is written out as pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "family", 2_000):
            family = table["family"].to_numpy()
            ids = table["id"].to_numpy()
            tokens = _bytes(table["tokens"])
            sets = [np.frombuffer(x, np.uint64) for x in table["content"].to_pylist()]
            met = [table[c].to_numpy() for c in ("side", "label")] if "label" in table.column_names else None
            begin = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
            out_a, out_b = [], []
            for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(family)], strict=True):
                order = low + np.argsort(ids[low:high], kind="stable")
                for i, root in enumerate(_linked(tokens[order], [sets[k] for k in order.tolist()], percent, met and [x[order] for x in met])):
                    if ids[order[i]] != ids[order[root]]:
                        out_a.append(ids[order[i]])
                        out_b.append(ids[order[root]])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _linked(tokens: np.ndarray, sets: list[np.ndarray], percent: int, met: list[np.ndarray] | None = None) -> list[int]:
    """Of each set the first that confirmed links lead to; met are the sets' sides and labels.

    Sets are taken one after the other and tried on what later ones are alike and not yet connected, likest first; it ends
    when all are connected. So it holds one set's likenesses and no list of pairs.
    """
    n = len(sets)
    group = np.arange(n) if met is None else np.unique(met[1], return_inverse=True)[1].astype(np.int64)
    parts, size = len(np.unique(group)), np.array([len(s) for s in sets])
    for i in range(n - 1):
        if parts == 1:
            break
        small, large = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        good = (100 * small >= percent * large) & (group[i + 1 :] != group[i])
        good = i + 1 + np.flatnonzero(good & (met[0][i + 1 :] != met[0][i]) if met else good)
        if not len(good):
            continue
        same = np.concatenate([(tokens[good[k : k + 4096]] == tokens[i]).sum(1, dtype=np.uint8) for k in range(0, len(good), 4096)])
        alike = same >= ALIKE * TOKENS
        left, step = good[alike][np.argsort(-same[alike].astype(np.int64), kind="stable")], 1
        while len(left):  # a few at first, as the likest mostly connect the rest
            tried, left = left[:step], left[step:]
            most = _shared_at_most(sets[i], [sets[j] for j in tried.tolist()])
            for j in tried[100 * most >= percent * (size[i] + size[tried] - most)].tolist():
                if group[i] == group[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    group[group == group[j]] = group[i]
                    parts -= 1
            left, step = left[group[left] != group[i]], min(4 * step, 256)
    _, first, back = np.unique(group, return_index=True, return_inverse=True)
    return first[back].tolist()


def _shared_at_most(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """A bound for how many items of one set each of the others holds: those with the low bits of one of them."""
    low = np.uint64((1 << max(16, len(one).bit_length() + 6)) - 1)
    there = np.zeros(int(low) + 1, bool)
    there[one & low] = True
    size = np.array([len(x) for x in others])
    return np.add.reduceat(there[np.concatenate(others) & low], np.cumsum(size) - size, dtype=np.int64)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, small: int = SMALL, family: int = FAMILY) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, text_hash) of each row: component_id is the smallest id that links reach;
    text_hash is xxhash64 of the text, by which rows that repeat an id are told apart.

    Words are what stands between white space, A-Z lower-cased; a set holds the distinct shingles of so many words.
    1. Equal sets are one set. 2. Each tree deals the sets out by one minwise token, and goes on dealing large
    nodes by tokens that each node chooses with a chance of 1 / (threshold * tokens), so alike sets stay together
    in some branch and others part. Small nodes are compared exhaustively on their tokens. 3. What is alike is
    gathered to families by connected components. 4. In each family links are confirmed on the full sets. Each
    node and family passes on a spanning forest and not its pairs. A family of more than `family` sets, or of as many
    times LONG shingles, is dealt into blocks of half as many, and no task holds more than two of its blocks together.

    Null texts and texts without words have an empty set, no links and themselves as component. Rows that repeat
    an id share its smallest component's links by their own texts. A row without id is
    linked to rows of an equal set alone; it never represents them, and is kept if none of them has an id. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    profiles = kept(_profiles(rows, shingle_words, trees))
    sets = profiles.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"), F.first("high").alias("high"), F.first("roots").alias("roots"), F.ceil(F.first("n_shingles") / LONG).alias("weight"))
    sets = kept(sets.where("id is not null"))
    pairs = _candidates(sets, percent / 100, trees, small)
    families = components(pairs)
    found = families.withColumnRenamed("node", "sid").join(sets.select("sid", "id", "tokens", "weight"), "sid")
    sizes = found.groupBy("root").agg(F.sum("weight").alias("size"))
    members = found.join(sizes, "root").select("sid", F.xxhash64("root").alias("family"), "size", "id", "tokens", "weight")
    members = kept(members)

    wanted = members.select(F.col("id").alias("m_id"), F.col("sid").alias("m_sid"))
    texts = rows.join(wanted, F.col("id") == F.col("m_id")).select("id", "text", "m_sid")
    content = _contents(texts, shingle_words).select(F.col("id").alias("c_id"), "content").dropDuplicates(["c_id"])
    full = members.join(content, F.col("id") == F.col("c_id")).select("family", "id", "tokens", "content", "size", "weight")
    whole = full.where(F.col("size") <= family)
    columns = ["family", "id", "tokens", "content"]
    links = _confirmed(whole.select(columns).repartition("family").sortWithinPartitions("family"), percent)
    if not members.where(F.col("size") > family).isEmpty():
        links = components(links.union(_by_blocks(full.where(F.col("size") > family), family, percent))).select(F.col("node").alias("a"), F.col("root").alias("b"))
    linked = links.select(F.col("a").alias("n_id"), F.col("b").alias("n_root"))
    named = sets.select("sid", "id").join(linked, F.col("id") == F.col("n_id"), "left").select(F.col("sid").alias("s_sid"), F.coalesce("n_root", "id").alias("component_id"))
    out = profiles.select("id", "text_hash", "n_shingles", "sid").join(named, F.col("sid") == F.col("s_sid"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash")


def _by_blocks(full: DataFrame, most: int, percent: int) -> DataFrame:
    """Links of large families, dealt by hash into blocks of about most / 2 sets: each block is confirmed by itself and
    then with the family's first block. What is not yet in the family's largest component is dealt into blocks of its
    own, and each of them meets every block of the family. So all pairs have met that were not linked already."""
    half = max(1, most // 2)
    cut = full.withColumn("blocks", F.ceil(F.col("size") / half)).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    cut = kept(cut.select("family", "id", "tokens", "content", "weight", "blocks", "block"))

    def confirmed(parts: DataFrame, *by: str) -> DataFrame:
        others = [c for c in ("side", "label") if c in parts.columns]
        parts = parts.select(F.xxhash64("family", *by).alias("family"), "id", "tokens", "content", *others)
        return kept(_confirmed(parts.repartition("family").sortWithinPartitions("family"), percent))

    def labelled(links: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("node").alias("r_id"), "root")
        return cut.join(roots, F.col("id") == F.col("r_id"), "left").withColumn("label", F.coalesce("root", "id")).drop("r_id", "root")

    links = confirmed(cut, "block")
    sides = labelled(links).withColumn("side", (F.col("block") == 0).cast("int"))
    parts = F.when(F.col("block") == 0, F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    links = links.union(confirmed(sides.withColumn("part", F.explode(parts)), "part"))

    now = labelled(links)
    sizes = now.groupBy("family", "label").agg(F.sum("weight").alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    main = main.where("rest > 0").withColumn("groups", F.ceil(F.col("rest") / half))
    now = now.join(main, "family")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = now.where("label != main").withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), "groups")).withColumn("part", upto("blocks")).withColumn("side", F.lit(0))
    every = now.withColumn("group", upto("groups")).withColumn("part", F.col("block")).withColumn("side", F.lit(1))
    return links.union(confirmed(rest.unionByName(every), "group", "part"))


def _contents(texts: DataFrame, k: int) -> DataFrame:
    """(id, content): the shingles of each text, sorted, as bytes; only where the text's set is the one asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            wanted = batch["m_sid"].to_pylist()
            for low, high in steps(at, 1 << 20):
                value, text = shingles(data[at[low] : at[high]], at[low : high + 1] - at[low], k)
                cut = np.searchsorted(text, np.arange(high - low + 1))
                ids, content = [], []
                for i in range(high - low):
                    own = value[cut[i] : cut[i + 1]]
                    if len(own):
                        a, b = mix(own).sum(dtype=np.uint64), mix(own + np.uint64(0x51ED)).sum(dtype=np.uint64)
                        if np.stack([mix(np.array([a])), mix(np.array([b]) + np.uint64(1))], 1).tobytes() == wanted[low + i]:
                            ids.append(low + i)
                            content.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(ids, pa.int64())), pa.array(content, pa.binary())], ["id", "content"])

    return texts.mapInArrow(run, "id long, content binary")
