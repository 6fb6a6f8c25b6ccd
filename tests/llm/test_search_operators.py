"""Near duplicates, repeated passages, neighbours and quotes against plain versions, with nulls, ties and odd columns."""

import hashlib
import os
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("messagelake.llm.common")
from pyspark.sql import functions as F  # noqa: E402

from messagelake.llm import common, near_dedup, neighbours, queries, quotes, suffix_dedup  # noqa: E402
from messagelake.llm.common import components  # noqa: E402

COLUMNS = "doc_id long, text string, id long, doc long, body string, tokens string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(k, t, 7, 1, "x", "y") for k, t in zip(ids or range(len(texts)), texts)], COLUMNS)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def some_documents(seed, families=14, vocabulary=4000):
    r = random.Random(seed)
    texts = [None, "", " \n\t", "One", "one ", "two words", "TWO\nwords"]
    for _ in range(families):
        base = [f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(3, 160))]
        for _ in range(r.randrange(1, 14)):
            texts.append(r.choice([" ", "\n", "  "]).join(edited(r, base, r.randrange(0, 5))))
        texts.append(" ".join(base).upper())
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [f"{' '.join(f'q{r.randrange(9999)}' for _ in range(60))} {passage}" for _ in range(30)]
    r.shuffle(texts)
    return texts


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(ids, sets, percent):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(ids[a]), find(ids[b])
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,small,family", [(4, 256, 4000), (5, 8, 4000), (4, 6, 10)])
def test_near_duplicates_equal_brute_force(spark, k, small, family):
    texts = some_documents(k * 10 + small)
    sets = sets_of(texts, k)
    want = brute_components(list(range(len(texts))), sets, 80)
    rows = near_dedup.near_duplicates(frame(spark, texts), shingle_words=k, small=small, family=family).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.component_id == want[row.doc_id], texts[row.doc_id]
        assert row.kept == (row.doc_id == row.component_id)


def test_a_node_left_large_loses_no_pair(spark, monkeypatch):
    r = random.Random(5)
    common, texts = [f"c{k}" for k in range(150)], []
    for pair in range(40):
        own = [f"p{pair}w{k}" for k in range(150)]
        texts += [" ".join([*common, *edited(r, own, 3)]) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text_hash", F.xxhash64("text"))
    sets = near_dedup._profiles(rows, 4, 1).withColumn("roots", F.array(F.lit(0).cast("long"))).cache()
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    name = {bytes(x.sid): x.id for x in sets.select("id", "sid").collect()}
    up = near_dedup.Union(len(texts))
    for edge in near_dedup._candidates(sets, 0.8, 1, 6).collect():
        up.join(name[bytes(edge.a)], name[bytes(edge.b)])
    assert [k for k in range(0, len(texts), 2) if up.find(k) != up.find(k + 1)] == []


def test_nodes_of_a_family_tell_one_edge_for_each_set(spark):
    r = random.Random(8)
    own = [f"w{k}" for k in range(200)]
    texts = sorted({" ".join(edited(r, own, 1)) for _ in range(30)})
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text_hash", F.xxhash64("text"))
    roots = F.array(*(F.lit(k).cast("long") for k in range(6)))
    sets = near_dedup._profiles(rows, 4, 6).withColumn("roots", roots).repartition(7, "id").cache()
    for small in (256, 4):  # one small node for each tree, one large node for each tree
        edges = {(bytes(x.a), bytes(x.b)) for x in near_dedup._candidates(sets, 0.8, 6, small).collect() if x.a != x.b}
        smallest = min(bytes(x.sid) for x in sets.select("sid").collect())
        assert {b for _, b in edges} == {smallest} and len(edges) == len(texts) - 1


def test_trees_follow_the_depth_reached():
    assert near_dedup.trees_for(near_dedup.SURE, 0.8) <= near_dedup.TREES
    for depth in range(near_dedup.SURE, near_dedup.DEPTH + 1):
        assert (1 - near_dedup.meeting(depth, 0.8)) ** near_dedup.trees_for(depth, 0.8) <= near_dedup.MISS


def test_parts_of_a_large_family_are_bounded(spark, monkeypatch):
    r = random.Random(11)
    words = [f"b{k}" for k in range(200)]
    texts = [" ".join(edited(r, words, 1)) for _ in range(400)] + [" ".join(edited(r, words, 9)) for _ in range(60)]
    sets, largest, confirmed = sets_of(texts, 4), [], near_dedup._confirmed

    def seen(members, percent):
        largest.append(members.groupBy("family").count().agg(F.max("count")).first()[0] or 0)
        return confirmed(members, percent)

    monkeypatch.setattr(near_dedup, "_confirmed", seen)
    rows = near_dedup.near_duplicates(frame(spark, texts), shingle_words=4, family=100).collect()
    assert {x.doc_id: x.component_id for x in rows} == brute_components(list(range(len(texts))), sets, 80)
    assert 0 < max(largest) <= 2 * 50 * 1.5


def test_long_texts_of_a_family_are_dealt_by_their_shingles(spark, monkeypatch):
    r = random.Random(12)
    words = [f"b{k}" for k in range(900)]
    texts = [" ".join(edited(r, words, k % 30)) for k in range(60)] + ["a b c d", "a b c d e"]
    sets, heaviest, confirmed = sets_of(texts, 4), [], near_dedup._confirmed

    def seen(members, percent):
        heaviest.append(members.groupBy("family").agg(F.sum(F.octet_length("content")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return confirmed(members, percent)

    monkeypatch.setattr(near_dedup, "_confirmed", seen)
    monkeypatch.setattr(near_dedup, "LONG", 100)
    rows = near_dedup.near_duplicates(frame(spark, texts), shingle_words=4, family=100).collect()
    assert {x.doc_id: x.component_id for x in rows} == brute_components(list(range(len(texts))), sets, 80)
    assert 0 < max(heaviest) < sum(8 * len(x) for x in sets) / 2


def test_a_family_of_thousands_holds_no_list_of_pairs():
    """4,000 alike sets in two groups that no link connects, and a few apart, within a bound of memory."""
    r, sets = np.random.default_rng(3), []
    bases = [np.arange(300, dtype=np.uint64) + np.uint64(10**6), np.concatenate([np.arange(220), np.arange(80) + 10**7]).astype(np.uint64) + np.uint64(10**6)]
    for k in range(4000):
        own = bases[k % 2].copy()
        own[r.integers(0, 300, 5)] = r.integers(10**9, 2**62, 5).astype(np.uint64)
        sets.append(np.unique(own))
    tokens = np.stack([near_dedup.minwise(s, np.array([0]))[0].astype(np.uint8) for s in sets])
    tracemalloc.start()
    found = near_dedup._linked(tokens, sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [k % 2 for k in range(4000)] and peak < 100 << 20
    sides, labels = np.arange(4000) // 2 % 2, np.arange(4000) % 4
    assert len(set(near_dedup._linked(tokens, sets, 80, [sides, labels]))) == 2


def test_alike_sets_without_links_are_told_apart_by_a_bound(monkeypatch):
    """Sets that look alike on their tokens but share too little were each intersected with all others, one pair at a time."""
    r = np.random.default_rng(5)
    base, calls, exact = r.integers(1, 1 << 60, 300).astype(np.uint64), [], np.intersect1d
    own = lambda share: np.unique(np.concatenate([base[: int(300 * share)], r.integers(1, 1 << 60, 300 - int(300 * share)).astype(np.uint64)]))
    sets = [own(0.8) for _ in range(60)] + [own(0.97) for _ in range(5)]
    tokens = near_dedup.minwise(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]).astype(np.uint8)
    monkeypatch.setattr(np, "intersect1d", lambda *a, **k: calls.append(1) or exact(*a, **k))
    found = near_dedup._linked(tokens, sets, 80)
    share = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    brute = near_dedup.clusters(65, *np.array([(i, j) for i in range(65) for j in range(65) if 100 * share[i][j] >= 80 * (len(sets[i]) + len(sets[j]) - share[i][j])]).T)
    assert found == brute.tolist() and len(set(found)) == 61 and len(calls) < 10


def test_whole_groups_go_out_by_bytes():
    t = pa.table({"key": [k // 3 for k in range(30)], "x": ["y" * 1000] * 30})
    got = list(common.whole_groups(iter(t.to_batches(max_chunksize=4)), "key", 1_000_000, 5_000))
    assert len(got) > 2 and pa.concat_tables(got).equals(t)
    seen = [set(g["key"].to_pylist()) for g in got]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])
    one = pa.table({"key": [1] * 30, "x": ["y" * 1000] * 30})
    assert [g.num_rows for g in common.whole_groups(iter(one.to_batches(max_chunksize=4)), "key", 1_000_000, 5_000)] == [30]


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    spread = common.spread_join
    monkeypatch.setattr(common, "spread_join", lambda *x: spread(*x, least=4))
    r = random.Random(2)
    pairs = [(0, k) for k in range(1, 60)] + [(100 + r.randrange(90), 100 + r.randrange(90)) for _ in range(70)] + [(59, 120)]
    up = near_dedup.Union(200)
    for a, b in pairs:
        up.join(a, b)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: up.find(k) for k in {x for p in pairs if p[0] != p[1] for x in p}}


def test_components_come_in_few_files(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 5).alias("b")))
        assert got.rdd.getNumPartitions() <= 8 and {x.node: x.root for x in got.collect()} == {k: k - k % 5 for k in range(200)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def brute_repeats(texts, ids, length):
    seen, out = set(), {}
    for k in sorted(range(len(texts)), key=lambda k: ids[k]):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[ids[k]] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length,hot", [(8, None), (30, 3), (100, None), (100, 2)])
def test_repeats_equal_brute_force(spark, length, hot):
    r = random.Random(length)
    passages = ["".join(r.choice("abcdé \n") for _ in range(r.randrange(length // 2, 3 * length))) for _ in range(12)] + ["a" * (4 * length), "ab" * (2 * length), "\0" * (2 * length)]
    texts = [None, "", "x" * (length - 1), "x" * (length - 1), "y" * length, "y" * length]
    for _ in range(120):
        texts.append("".join(r.choice(passages)[r.randrange(0, length // 2) :] if r.random() < 0.6 else "".join(r.choice("abcd") for _ in range(r.randrange(length))) for _ in range(r.randrange(1, 5))))
    texts += texts[10:20]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    want = brute_repeats(texts, ids, length)
    rows = suffix_dedup.remove_repeats(frame(spark, texts, ids).repartition(5), length, hot=hot).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_bytes, sum(s.high - s.low for s in row.spans), len(row.spans), row.kept_sha256) == want[row.doc_id]


def test_repeats_of_empty_tables_and_repeated_rows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    text = "".join(f"{k} " for k in range(80))
    rows = suffix_dedup.remove_repeats(frame(spark, [text, text, text, None], [3, 3, 4, None])).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in rows) == [(0, 0), (3, len(text)), (3, len(text)), (4, 0)]
    rows = near_dedup.near_duplicates(frame(spark, [text, text, text, None], [3, 3, 4, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (3, 3), (3, 3), (4, 3)]
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, True), (3, True), (3, True), (4, False)]


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 24))
    x[100:140] = x[100]
    rows = [(k, [float(v) for v in x[k]], 1, 2) for k in range(900)]
    rows += [(900, None, 1, 2), (901, [0.0] * 24, 1, 2), (902, [float("nan")] * 24, 1, 2), (903, [1.0, None] + [0.0] * 22, 1, 2), (904, [1.0], 1, 2), (20, rows[20][1], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, query int")
    got = {}
    for row in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0, block_floats=300 * 24).collect():
        got.setdefault(row.query_id, {})[row.rank] = (row.vec_id, row.score)
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        pairs = [found[k] for k in range(1, 21)]
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0])) and q not in [p[0] for p in pairs]
        score = x @ x[q]
        score[q] = -np.inf
        assert np.allclose([p[1] for p in pairs], score[[p[0] for p in pairs]], rtol=1e-12)
        hits += len(set(np.lexsort((np.arange(900), -score))[:20].tolist()) & {p[0] for p in pairs})
    assert hits / (20 * len(got)) >= 0.9
    few = neighbours.nearest_neighbours(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, k) for k in range(1, 5)]
    assert neighbours.nearest_neighbours(df.where("vec_id > 899"), F.lit(True)).count() == 0


def test_probes_retrieve_all_within_a_radius():
    r = np.random.default_rng(8)
    codes = r.integers(0, 1 << 16, (400, 4), dtype=np.uint16)
    codes[200:] = codes[3] ^ np.where(r.random((200, 4, 16)) < 0.2, 1 << np.arange(16), 0).sum(2).astype(np.uint16)
    index = neighbours.MultiIndex(codes)
    far = np.bitwise_count(codes ^ codes[3])
    for radius in (0, 5, 8, 13, 21, 26, 40, 64, 1000):
        reach = neighbours.Coder(np.zeros(1), np.zeros((1, 64)), 1.0, radius).reach()
        seen = index.probe(codes[[3, 7]], reach)
        assert np.array_equal(seen[0], (far <= np.array(reach)).any(1))
        assert seen[0][far.sum(1) <= radius].all()


def test_a_vector_that_many_rows_share(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 8))
    x[::3] = x[0] / np.linalg.norm(x[0]) * 9
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)]
    got = {}
    for row in neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 60 == 0, block_floats=400).collect():
        got.setdefault(row.query_id, {})[row.rank] = row.vec_id
    for q in (0, 60, 120):
        assert [got[q][k] for k in range(1, 21)] == [k for k in range(0, 300, 3) if k != q][:20]


def test_reply_chains_and_crowds(spark):
    """Positions and depths of trees of any shape, by a walk."""
    r = random.Random(31)
    shapes = {0: {k: k - 1 for k in range(1, 70)}, 1: {k: 0 for k in range(1, 50)}, 2: {k: r.randrange(k) for k in range(1, 60) if r.random() < 0.8}}
    talk = []
    for conv, parent in shapes.items():
        for turn in range(1 + max(parent)):
            quote = [f"> line {parent[turn]} of {conv}"] if turn in parent else []
            talk.append((conv, turn, "user", "\n".join([*quote, f"line {turn} of {conv}"])))
    rows = quotes.link_quotes(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    got = {(x.conv_id, x.turn): (x.position, x.depth) for x in rows}
    for conv, parent in shapes.items():
        want, stack = [], [(k, 0) for k in range(max(parent), -1, -1) if k not in parent]
        while stack:
            k, depth = stack.pop()
            want.append((k, depth))
            stack += [(c, depth + 1) for c in sorted(parent, reverse=True) if parent[c] == k]
        assert [(k, *got[conv, k]) for k, _ in want] == [(k, n + 1, d) for n, (k, d) in enumerate(want)]


def test_quotes(spark):
    talk = [
        (1, 0, "user", "Hello there.\n\nWhere is the Station?"),
        (1, 1, "assistant", "> where is the   station?\nBehind the market."),
        (1, 2, "user", "On Monday B wrote:\n>> Where is the station?\n> Behind the market.\n\nThank you!\n"),
        (1, 3, "user", "> Hello there.\n\nHi!"),
        (1, 4, "user", "> nobody said so\nWhat?"),
        (2, 0, "user", "Where is the station?"),
        (2, 1, "user", None),
        (2, 1, "user", None),
        (None, 0, "user", "> Where is the station?"),
    ]
    df = spark.createDataFrame([(*t, 5, "z") for t in talk], "conv_id long, turn long, role string, text string, th long, path string")
    rows = quotes.link_quotes(df).collect()
    assert len(rows) == len(talk)
    twice = quotes.link_quotes(df.union(df)).collect()  # repeated rows each stay, with the links that they have alone
    links = lambda found: sorted(str((r.conv_id, r.turn, r.n_quotes, r.n_linked, r.parent_turn, r.body)) for r in found)
    assert links(twice) == sorted(links(rows) * 2)
    one = {r.turn: r for r in rows if r.conv_id == 1}
    assert [one[t].parent_turn for t in range(5)] == [None, 0, 1, 0, None]
    assert [one[t].depth for t in range(5)] == [0, 1, 2, 1, 0]
    assert [one[t].position for t in range(5)] == [1, 2, 3, 4, 5]
    assert [(one[t].n_quotes, one[t].n_linked) for t in range(5)] == [(0, 0), (1, 1), (2, 2), (1, 1), (1, 0)]
    assert one[2].body == "Thank you!" and one[1].body == "Behind the market." and one[4].body == "What?"
    two = sorted((r.turn, r.position, r.body) for r in rows if r.conv_id == 2)
    assert two == [(0, 1, "Where is the station?"), (1, 2, ""), (1, 3, "")]
    assert quotes.link_quotes(df.limit(0)).count() == 0

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("conversations", df.where("conv_id is not null").dropDuplicates().select("conv_id", "turn", "role", "text").toPandas())
    want = con.sql(f"SELECT conv_id, turn, position, depth, coalesce(parent_turn, -1), n_quotes, n_linked, body_sha256 FROM ({queries.OP2_SQL})").fetchall()
    own = quotes.link_quotes(df.where("conv_id is not null").dropDuplicates()).withColumn("sha", F.sha2("body", 256))
    assert sorted(want) == sorted((r.conv_id, r.turn, r.position, r.depth, -1 if r.parent_turn is None else r.parent_turn, r.n_quotes, r.n_linked, r.sha) for r in own.collect())


def test_quotes_of_parts_equal_brute_force(spark):
    r = random.Random(21)
    talk, own = [], {}
    for conv in range(16):
        for turn in range(12):
            lines = [r.choice(["One line.", "Another  line", "Last line", f"Said in {conv} at {turn}", ""]) for _ in range(r.randrange(1, 7))]
            own[conv, turn] = [" ".join(x.lower().split()) for x in lines if x]
            quote = []
            if turn and r.random() < 0.8:
                told = own[conv, r.randrange(turn)]
                low = r.randrange(len(told) + 1)
                quote = told[low : low + r.randrange(1, 5)]
                quote += ["nobody said so"] if r.random() < 0.1 else []
            talk.append((conv, turn, "user", "\n".join([*(f"> {x}" + r.choice(["", "\n>"]) for x in quote), *lines]), quote))
    want, parts = {}, 0
    for conv, turn, _, _, quote in talk:
        holds = [t for t in range(turn) if any(own[conv, t][k : k + len(quote)] == quote for k in range(len(own[conv, t])))] if quote else []
        want[conv, turn] = max(holds, default=None)
        parts += len(holds) > 0 and len(quote) > 1
    assert parts > 10
    rows = quotes.link_quotes(spark.createDataFrame([t[:4] for t in talk], "conv_id long, turn long, role string, text string")).collect()
    assert {(x.conv_id, x.turn): x.parent_turn for x in rows} == want
    assert all(x.n_linked == (want[x.conv_id, x.turn] is not None) for x in rows)


DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_registered_queries_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = [d.doc_id for d in docs], [d.text for d in docs]
    sets = sets_of(texts, 4)
    want = brute_components(ids, sets, 80)
    rows = queries.QUERIES["op3_near_duplicates"](spark, DATA).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == sorted((i, len(s), want[i], want[i] == i) for i, s in zip(ids, sets, strict=True))

    want = brute_repeats(texts, ids, 100)
    rows = queries.QUERIES["op5_suffix_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and len(rows) == len(docs)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in zip(ids, texts, strict=True):
        own = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(own), sha(",".join(map(str, own))), sha(library.decode(own, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op7_bpe"](spark, DATA).collect()} == want


@needs_data
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_registered_neighbours_reach_the_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got = queries.QUERIES["op10_neighbours"](spark, folder).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    asked = np.flatnonzero(ids % 20 == 0)
    for k in asked:
        score = x @ x[k]
        score[k] = -np.inf
        own = got[got.query_id == ids[k]]
        assert own["rank"].tolist() == list(range(1, 21))
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits / (20 * len(asked)) >= 0.9
