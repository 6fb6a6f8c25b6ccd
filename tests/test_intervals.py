"""Interval operators against sets of ids, on seeded random input."""

import random

import pytest
from pyspark.sql import functions as F

from messagelake.operators import intervals as I


def spans_of(r, n, top=200):
    return [(r.choice("ab"), lo, lo + r.randrange(12)) for lo in (r.randrange(1, top) for _ in range(n))]


def cells(spans):
    return {(k, x) for k, lo, hi in spans for x in range(lo, hi + 1)}


def ranges(ids):
    out = []
    for k, x in sorted(ids):
        if out and out[-1][0] == k and out[-1][2] == x - 1:
            out[-1] = (k, out[-1][1], x)
        else:
            out.append((k, x, x))
    return out


def frame(spark, spans):
    return spark.createDataFrame(spans, "k string, lo long, hi long")


def rows(df, *more):
    return sorted(tuple(r) for r in df.select("k", "lo", "hi", *more).collect())


@pytest.mark.parametrize("seed", range(3))
def test_merge_subtract_intersect(spark, seed):
    r = random.Random(seed)
    a, b = spans_of(r, 25), spans_of(r, 20)
    x, y = frame(spark, a), frame(spark, b)
    assert rows(I.merge_spans(x, ["k"], 4)) == ranges(cells(a))
    assert rows(I.subtract_spans(x, y, ["k"], 4)) == ranges(cells(a) - cells(b))
    assert rows(I.intersect_spans(x, y, ["k"], 4)) == ranges(cells(a) & cells(b))


@pytest.mark.parametrize("seed", range(2))
def test_stamp(spark, seed):
    r = random.Random(seed)
    old = [(k, lo, hi, r.randrange(5), f"o{lo}") for k, lo, hi in ranges(cells(spans_of(r, 8)))]
    new = [(*s, r.randrange(6), f"n{n % 3}", n) for n, s in enumerate(spans_of(r, 12))]
    want = {(k, x): (at, run) for k, lo, hi, at, run in old for x in range(lo, hi + 1)}
    for k, lo, hi, at, run, _ in new:
        for x in range(lo, hi + 1):
            if (k, x) not in want or want[k, x][0] <= at:
                want[k, x] = (at, run)
    got = I.stamp(spark.createDataFrame(old, "k string, lo long, hi long, at int, run string"), spark.createDataFrame(new, "k string, lo long, hi long, at int, run string, arrival long"), ["k"])
    found = [tuple(t) for t in got.select("k", "lo", "hi", "at", "run").collect()]
    assert {(k, x): (at, run) for k, lo, hi, at, run in found for x in range(lo, hi + 1)} == want
    assert sum(hi - lo + 1 for _, lo, hi, _, _ in found) == len(want)
    for one in found:
        assert not any(t[0] == one[0] and t[1] == one[2] + 1 and t[3:] == one[3:] for t in found)


@pytest.mark.parametrize("seed", range(2))
def test_asof_and_overlap(spark, seed):
    r = random.Random(seed)
    iv = [(*s, n) for n, s in enumerate(ranges(cells(spans_of(r, 10))))]
    keys = [(r.choice("ab"), r.randrange(220)) for _ in range(50)]
    df = spark.createDataFrame(iv, "k string, lo long, hi long, name long")
    got = I.asof_interval(spark.createDataFrame(keys, "k string, key long"), df, ["k"], "key", ["name"])
    want = sorted((k, x, next((n for q, lo, hi, n in iv if q == k and lo <= x <= hi), -1)) for k, x in keys)
    assert sorted((t.k, t.key, -1 if t.name is None else t.name) for t in got.collect()) == want
    a, b = spans_of(r, 20), spans_of(r, 20)
    met = I.overlap_join(frame(spark, a), frame(spark, b), ["k"])
    want = sorted((k, lo, hi, x, y) for k, lo, hi in a for q, x, y in b if k == q and lo <= y and x <= hi)
    assert rows(met, "b_lo", "b_hi") == want


@pytest.mark.parametrize("seed", range(2))
def test_a_key_of_many_blocks(spark, seed):
    """One key, blocks of 8 ids: nothing is lost or left apart at their borders."""
    r = random.Random(seed)
    ids = {("a", r.randrange(300)) for _ in range(220)} | {("b", x) for x in range(5, 120)}
    got = I.islands(spark.createDataFrame(sorted(ids), "k string, id long"), ["k"], bits=3)
    assert rows(got) == ranges(ids)
    pieces = [(k, x, x, x % 50 < 25) for k, x in sorted(ids)]
    runs = I.coalesce_runs(spark.createDataFrame(pieces, "k string, lo long, hi long, flag boolean"), ["k"], ["flag"], bits=3)
    want = sorted((k, lo, hi, f) for f in (True, False) for k, lo, hi in ranges({(k, x) for k, x in ids if (x % 50 < 25) == f}))
    assert rows(runs, "flag") == want
    keys = [("a", x) for x in range(0, 310, 3)] + [("b", 60), ("c", 1), ("a", None)]
    at = I.asof_interval(spark.createDataFrame(keys, "k string, key long"), got.withColumn("first", F.col("lo")), ["k"], "key", ["first"], bits=3)
    assert {(t.k, t.key): t.first for t in at.collect()} == {(k, x): next((lo for q, lo, hi in ranges(ids) if q == k and x is not None and lo <= x <= hi), None) for k, x in keys}
    stamps = [("a", lo, lo + r.randrange(60), r.randrange(9), f"n{n}", n) for n, lo in enumerate(r.randrange(250) for _ in range(40))]
    old = [(k, lo, hi, 4, "o") for k, lo, hi in ranges(ids)]
    best = {(k, x): (4, -1, "o") for k, x in ids}
    for k, lo, hi, t, run, n in stamps:
        for x in range(lo, hi + 1):
            best[k, x] = max(best.get((k, x), (-1, -1, "")), (t, n, run))
    out = I.stamp(spark.createDataFrame(old, "k string, lo long, hi long, at int, run string"), spark.createDataFrame(stamps, "k string, lo long, hi long, at int, run string, arrival long"), ["k"])
    found = {(t.k, x): (t.at, t.run) for t in out.collect() for x in range(t.lo, t.hi + 1)}
    assert found == {c: (t, run) for c, (t, _, run) in best.items()}


def test_forget_keeps_attributes(spark):
    df = spark.createDataFrame([("a", 1, 9, "r"), ("a", 10, 12, "s"), ("b", 1, 3, "r")], "k string, lo long, hi long, run string")
    ids = spark.createDataFrame([("a", 4), ("a", 5), ("a", 10), ("a", 99)], "k string, id long")
    assert rows(I.forget(df, ids, ["k"], ["run"]), "run") == [("a", 1, 3, "r"), ("a", 6, 9, "r"), ("a", 11, 12, "s"), ("b", 1, 3, "r")]


@pytest.mark.parametrize("seed", range(2))
def test_forget_equals_sets(spark, seed):
    r = random.Random(seed)
    iv = [(k, lo, hi, f"r{lo % 3}") for k, lo, hi in ranges(cells(spans_of(r, 14)))]
    iv += [(k, hi + 1, hi + 3, "next") for k, _, hi, _ in iv if not any(q == k and x - 4 <= hi < x for q, x, _, _ in iv)]
    ids = [(r.choice("ab"), r.randrange(1, 220)) for _ in range(60)]
    got = I.forget(spark.createDataFrame(iv, "k string, lo long, hi long, run string"), spark.createDataFrame(ids, "k string, id long"), ["k"], ["run"], bits=4)
    left = {(k, x, run) for k, lo, hi, run in iv for x in range(lo, hi + 1)} - {(k, x, run) for k, x in ids for _, _, _, run in iv}
    found = [(t.k, x, t.run) for t in got.collect() for x in range(t.lo, t.hi + 1)]
    assert sorted(found) == sorted(left)


def test_translate_permuted_ids(spark):
    pairs = [("p", n, 100 + (n * 7) % 20, n % 5 != 0) for n in range(1, 20)]
    m = I.affine_map(spark.createDataFrame(pairs, "k string, producer_id long, local_id long, eligible boolean"), ["k"])
    local, unknown = I.translate(frame(spark, [("p", 3, 25)]), m, ["k"])
    assert rows(local) == ranges({("p", q) for _, n, q, ok in pairs if ok and n >= 3})
    assert rows(unknown) == [("p", 20, 25)]


def wide(r, n):
    """Spans of all widths up to 2**62, with shared and adjacent ends."""
    ends, out = [1], []
    for _ in range(n):
        lo = r.choice(ends[-6:]) + r.choice([0, 0, 1, 1, -1, r.randrange(2 ** r.randrange(1, 61))])
        hi = min(lo + r.choice([0, 1, r.randrange(2 ** r.randrange(1, 62))]), 2**62 - 2)
        if abs(lo) < 2**61 and lo <= hi:
            ends += [lo, hi, hi + 1]
            out.append((r.choice(["a", "a", "b", None]), lo, hi))
    return out


def plain_sweep(a, b, wanted):
    out = []
    for k in {s[0] for s in a + b}:
        at = sorted({x for q, lo, hi in a + b if q == k for x in (lo, hi + 1)})
        for lo, end in zip(at, at[1:]):
            n = [sum(q == k and x <= lo <= y for q, x, y in side) for side in (a, b)]
            if wanted(*n):
                if out and out[-1][0] == k and out[-1][2] == lo - 1:
                    out[-1] = (k, out[-1][1], end - 1)
                else:
                    out.append((k, lo, end - 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,bits", [(1, 21), (2, 21), (3, 8), (4, 3)])
def test_spans_of_any_width(spark, seed, bits):
    r = random.Random(seed)
    a, b = wide(r, 60), wide(r, 50)
    if bits < 21:
        a, b = [[(k, lo >> 48, (lo >> 48) + (hi >> 48) % 40) for k, lo, hi in s] for s in (a, b)]
    x, y = frame(spark, a), frame(spark, b)
    plain = lambda df: sorted((tuple(t) for t in df.select("k", "lo", "hi").collect()), key=str)
    assert plain(I.merge_spans(x, ["k"], bits)) == plain_sweep(a, [], lambda n, m: n > 0)
    assert plain(I.subtract_spans(x, y, ["k"], bits)) == plain_sweep(a, b, lambda n, m: n > 0 and m == 0)
    assert plain(I.intersect_spans(x, y, ["k"], bits)) == plain_sweep(a, b, lambda n, m: n > 0 and m > 0)
    met = [(k, lo, hi, p, q) for k, lo, hi in a for o, p, q in b if k == o and lo <= q and p <= hi]
    got = [tuple(t) for t in I.overlap_join(x, y, ["k"]).select("k", "lo", "hi", "b_lo", "b_hi").collect()]
    assert sorted(got, key=str) == sorted(met, key=str)
    totals = {t.k: (t.pairs, t.ids) for t in I.overlap_totals(x, y, ["k"], bits).collect()}
    if bits < 21:  # sums of ids fit a long
        for k in totals:
            assert totals[k] == (sum(m[0] == k for m in met), sum(min(m[2], m[4]) - max(m[1], m[3]) + 1 for m in met if m[0] == k))


def test_a_single_span_of_2_to_the_61_is_quick_and_a_hot_key_is_split(spark):
    one = frame(spark, [("a", 5, 5 + 2**61)])
    assert rows(I.merge_spans(one, ["k"])) == [("a", 5, 5 + 2**61)]
    n = 6000
    t = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + F.col("id") % 7).alias("hi"))
    u = t.withColumns({"lo": F.col("lo") + 1, "hi": F.col("hi") + 1})
    want = sum(1 for i in range(n) for j in range(max(0, i - 4), min(n, i + 5)) if i * 3 <= j * 3 + j % 7 + 1 and j * 3 + 1 <= i * 3 + i % 7)
    assert I.overlap_join(t, u, ["k"]).count() == want == I.overlap_totals(t, u, ["k"]).first().pairs
