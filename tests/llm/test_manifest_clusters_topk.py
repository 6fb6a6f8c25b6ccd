"""Manifest, clusters and exact search against plain versions, with nulls, ties, repeated rows, empty tables and odd columns."""

import hashlib
import math
import random
import zlib

import pytest

pytest.importorskip("messagelake.llm.common")
from pyspark.sql import functions as F  # noqa: E402

from messagelake.llm import centroids, merkle, queries, topk  # noqa: E402

DATA = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes, fan):
    """(root, siblings of each node)"""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fan * fan : p // fan * fan + fan]
            proofs[i].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
            at[i] = p // fan
        nodes = [H(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
    return nodes[0] if nodes else None, proofs


def plain_manifest(rows, fan):
    """rows: (doc_id, source, lang, n_chars, text)"""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: grown([leaf for *_, leaf in sorted(trees[x])], fan) for x in langs}
    root, above = grown([built[x][0] for x in langs], fan)
    out = []
    for x, over in zip(langs, above):
        for (there, key, leaf), own in zip(sorted(trees[x]), built[x][1]):
            out.append((key if there else None, leaf, built[x][0], root, own + over))
    return out


def documents(seed, n, langs):
    r = random.Random(seed)
    return [(r.randrange(3 * n), r.choice(["web", None, ""]), r.choice(langs), r.choice([None, 5, -7]), r.choice([None, "", "Abc é", "x" * r.randrange(2000)])) for _ in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id string, up string, proof long"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CASES = {
    "many": (documents(1, 300, ["en", "de", None, "", "É", "-", "e"]), 8),
    "narrow": (documents(2, 90, ["en", "de"]), 2),
    "one language": (documents(3, 65, ["en"]), 8),
    "full runs": (documents(4, 64, [None]), 8),
    "one document": (documents(5, 1, ["en"]), 8),
    "each its own": ([(k, None, f"l{k:02}", 1, "t") for k in range(20)], 8),
    "repeated": ([(7, "s", "en", 3, "abc")] * 20 + [(None, "s", "en", 3, "abc"), (7, "s", "de", 3, "abc")], 8),
    "none": ([], 8),
}


@pytest.mark.parametrize("case,salted", [*((case, False) for case in CASES), ("many", True), ("narrow", True)])
def test_manifest_equals_plain(spark, case, salted):
    rows, fan = CASES[case]
    df = spark.createDataFrame([(*r, "i", "u", 1) for r in rows], SCHEMA)
    more = {"broadcast_bytes": 0, "rows_a_key": 4} if salted else {}
    got = merkle.merkle_manifest(df, FIELDS, "lang", "doc_id", fan=fan, carry=("up",), **more).collect()
    assert all(r.up == "u" for r in got)
    key = lambda r: tuple((v is not None, v) for v in r[:4]) + (r[4],)
    own = [(r.doc_id, r.leaf, r.subroot, r.root, [(bytes(s.before).hex(), bytes(s.after).hex()) for s in r.proof]) for r in got]
    assert sorted(own, key=key) == sorted(plain_manifest(rows, fan), key=key)


def test_manifest_query_finds_each_tampered_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*FIELDS).collect()
    want = {(key, leaf): proof for key, leaf, _, _, proof in plain_manifest([tuple(d) for d in docs], 8)}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 0 and d.text and d.text.translate(low) != d.text}
    got = queries.op11(spark, DATA).collect()
    assert {r.doc_id for r in got if not r.verified} == changed and len(got) == len(docs)
    for r in got:
        proof = want[r.doc_id, r.leaf]
        assert r.proof_sha256 == H(*(a + b for a, b in proof))
        assert r.verified == (r.folded_root == r.root)


def plain_clusters(rows, k, rounds, dims, scale=64):
    """rows: (vec_id, components); in whole numbers throughout."""
    good = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    packed = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v)
    starts = sorted(good, key=lambda r: (r[0] is None, H(f"1:{r[0]}") if r[0] is not None else "", packed(r[1])))[:k]
    c = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in good]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [good[i][1] for i in range(len(good)) if at[i] == j]
            c[j] = tuple(sum(x) // len(own) for x in zip(*own)) if own else c[j]
    at = assign()
    d = [far(v, c[j]) for (_, v), j in zip(good, at)]
    return [(i, j, x, sum(y for y, o in zip(d, at) if o == j), sum(d), list(c[j])) for (i, _), j, x in zip(good, at, d)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string")


def some_vectors(seed, n, dims, spread, centres=5):
    r = random.Random(seed)
    base = [[r.uniform(-2, 2) for _ in range(dims)] for _ in range(centres)]
    near = lambda: [x + r.gauss(0, spread) for x in r.choice(base)]
    f32 = lambda v: [float(__import__("numpy").float32(x)) for x in v]
    return [(i, f32(near())) for i in range(n)]


@pytest.mark.parametrize("seed,n,spread,k,rounds", [(1, 400, 0.2, 16, 3), (2, 400, 2.0, 16, 6), (3, 300, 0.05, 4, 9), (4, 9, 1.0, 16, 3), (5, 50, 1.0, 1, 2)])
def test_clusters_equal_plain(spark, seed, n, spread, k, rounds):
    rows = some_vectors(seed, n, 6, spread)
    rows += [(3, [0.5] * 6)] * 30 + [(900 + i, [0.25, -0.25] * 3) for i in range(40)]  # repeated rows, many equal vectors, ties
    rows += [(None, [1.0] * 6), (1001, None), (1002, [1.0]), (1003, [1.0, None] * 3), (1004, [float("nan")] * 6), (1005, [float("inf")] * 6), (1006, [])]
    got = centroids.centroid_clusters(vectors(spark, rows).repartition(5), k=k, rounds=rounds, dims=6)
    own = [(r.vec_id, r["cluster"], r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(own, key=key) == sorted(plain_clusters(rows, k, rounds, 6), key=key)


def test_clusters_of_nothing_and_of_large_numbers(spark):
    assert centroids.centroid_clusters(vectors(spark, []), dims=6).collect() == []
    rows = [(i, [float(2**20 + 977 * i), -float(2**20 - i), float(i)]) for i in range(40)] + [(99, [3e38, 0.0, 0.0])]
    got = centroids.centroid_clusters(vectors(spark, rows), k=5, dims=3).collect()
    want = plain_clusters(rows[:-1], 5, 3, 3)
    assert sorted((r.vec_id, r["cluster"], r.distance) for r in got) == sorted(w[:3] for w in want)


def test_heaps_leave_settled_vectors_alone(spark, monkeypatch):
    """Well parted groups: after the first rounds hardly a vector's gap is used up, and only those are scanned."""
    scanned, push = [], centroids._pushed

    def counting(popped, *rest):
        scanned.append(popped.count())
        return push(popped, *rest)

    monkeypatch.setattr(centroids, "_pushed", counting)
    rows = some_vectors(8, 600, 6, 0.01, centres=3)
    got = centroids.centroid_clusters(vectors(spark, rows), k=3, rounds=6, dims=6).collect()
    assert len(got) == 600 and scanned[0] == 600 and sum(scanned[3:]) < 600


def plain_top(rows, is_query, k, scale=1024):
    packed = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v)
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = tuple(math.floor(scale * x) for x in v)
            whole[i] = min(whole.get(i, w), w, key=packed)
    out = []
    for q in whole:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k,numbers", [(10, 1 << 22), (3, 200), (1, 60), (1000, 500)])
def test_top_k_equals_plain(spark, k, numbers):
    rows = some_vectors(k, 260, 6, 0.5)
    rows += [(2000 + 7 * i, [0.5, -1.0] * 3) for i in range(150)]  # far more than k with one score
    rows += [(-(2**62) + i, [0.5, -1.0] * 3) for i in range(3)] + [(2**62 + 5, [0.0] * 6), (5, [9.0] * 6), (5, [9.0] * 6)]
    rows += [(None, [1.0] * 6), (3001, None), (3002, [1.0, None] * 3), (3004, [float("nan")] * 6), (3005, [float("-inf")] * 6), (3006, [])]
    got = topk.exact_top_k(vectors(spark, rows).repartition(4), F.col("vec_id") % 10 == 0, k=k, block_numbers=numbers)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 10 == 0, k)


def test_top_k_of_few_and_of_large_numbers(spark):
    every = F.col("vec_id") >= 0
    assert topk.exact_top_k(vectors(spark, []), every).collect() == []
    assert topk.exact_top_k(vectors(spark, [(1, [1.0, 2.0])]), every).collect() == []
    assert topk.exact_top_k(vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") < 0).collect() == []
    assert topk.exact_top_k(vectors(spark, [(1, [0.0]), (2, [0.0])]), every).count() == 2
    rows = [(i, [131000.0 - 3 * i, 7.0 * i, -130000.0 + i]) for i in range(50)] + [(99, [3e38, 0.0, 0.0])]
    got = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 7 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == plain_top(rows[:-1], lambda i: i % 7 == 0, 5)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroid_clusters", "op13_exact_top_k"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
