"""Algebra of inclusive id intervals per key: islands, merge, subtract, overlay, look-up, overlap, translation.

The work follows the number of intervals, whatever their width: a sweep sees two borders of each. Its windows are over a key
and a block of 2**bits ids; what a block hands on (running counts, the last value seen, runs that touch its ends) goes through
windows over 2**(bits + MORE) blocks and then through one over the key, so none holds more than 2**22 blocks or twice as
many distinct ids as a block has, and a key with a third of all rows is dealt over many tasks. Ids are longs below 2**62 in size.

What several branches of a sweep read is stored, as plans would else hold it once for each branch, and again in each sweep
over the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of a block, and how many more blocks the next level takes, as powers of 2.
BITS, MORE = 18, 4


def _block(value: Column, bits: int) -> Column:
    return F.shiftright(value, bits)


def _levels(bits: int) -> list[int | None]:
    """By how many bits ids are shifted to blocks, to blocks of blocks, and to the key."""
    return [bits, 2 * bits + MORE, None]


def _stored(df: DataFrame) -> DataFrame:
    from ..plans.state import stored

    return stored(df)


def _met(rows: DataFrame, facts: DataFrame, by: Sequence[str], kind: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    facts = facts.withColumnsRenamed({c: f"_f_{c}" for c in by})
    test = F.lit(True)
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    return rows.join(facts, test, kind).drop(*(f"_f_{c}" for c in by))


def _summed(rows: DataFrame, by: Sequence[str], at: str, names: Sequence[str], bits: int) -> DataFrame:
    """Rows of distinct (*by, at) with `_run_x`, for each of the names, its sum from the key's smallest `at` up to this row."""
    here, wide = [*by, "_b"], [*by, "_w"]
    rows = rows.withColumn("_b", _block(F.col(at), bits))
    blocks = rows.groupBy(*here).agg(*(F.sum(n).alias(n) for n in names)).withColumn("_w", _block(F.col("_b"), bits + MORE))
    wides = blocks.groupBy(*wide).agg(*(F.sum(n).alias(n) for n in names))
    past = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wides = wides.select(*wide, *(past(Window.partitionBy(*by).orderBy("_w"), n).alias(f"_c_{n}") for n in names))
    blocks = _met(blocks, wides, wide)
    blocks = blocks.select(*here, *((past(Window.partitionBy(*wide).orderBy("_b"), n) + F.col(f"_c_{n}")).alias(f"_c_{n}") for n in names))
    own = Window.partitionBy(*here).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_run_{n}": F.sum(n).over(own) for n in names})
    return _met(rows, blocks, here).withColumns({f"_run_{n}": F.col(f"_run_{n}") + F.col(f"_c_{n}") for n in names}).drop("_b", *(f"_c_{n}" for n in names))


def _handed(rows: DataFrame, by: Sequence[str], at: Column, order: Sequence[Column], value: str, bits: int, upto: int = 0) -> DataFrame:
    """Rows with `_last`, the last value that isn't null among those of the key from the start up to this row (or, with
    upto=-1, the row before it), in the order of `at` and then of `order`."""
    here, wide = [*by, "_b"], [*by, "_w"]
    rows = rows.withColumn("_at", at).withColumn("_b", _block(F.col("_at"), bits))
    blocks = rows.groupBy(*here).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_v")).withColumn("_w", _block(F.col("_b"), bits + MORE))
    wides = blocks.groupBy(*wide).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_b"))).alias("_v"))
    last = lambda w, n, x: F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, n))
    wides = wides.select(*wide, last(Window.partitionBy(*by).orderBy("_w"), -1, "_v").alias("_c"))
    blocks = _met(blocks, wides, wide).select(*here, F.coalesce(last(Window.partitionBy(*wide).orderBy("_b"), -1, "_v"), "_c").alias("_c"))
    rows = rows.withColumn("_last", last(Window.partitionBy(*here).orderBy("_at", *order), upto, value))
    return _met(rows, blocks, here).withColumn("_last", F.coalesce("_last", "_c")).drop("_at", "_b", "_c")


def islands(ids: DataFrame, by: Sequence[str], value: str = "id", bits: int = BITS, distinct: bool = True) -> DataFrame:
    """Ids as ranges of consecutive ones: (*by, lo, hi). They are made distinct first, which few equal ones needn't be."""
    order = Window.partitionBy(*by, "_block").orderBy(value)
    known = ids.select(*by, value).where(F.col(value).isNotNull())
    known = (known.distinct() if distinct else known).withColumn("_block", _block(F.col(value), bits))
    numbered = known.withColumn("_g", F.col(value) - F.dense_rank().over(order))
    parts = _stored(numbered.groupBy(*by, "_block", "_g").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(*by, "lo", "hi"))
    edge = (F.col("lo") == F.shiftleft(_block(F.col("lo"), bits), bits)) | (F.col("hi") + 1 == F.shiftleft(_block(F.col("hi") + 1, bits), bits))
    return parts.where(~edge).unionByName(_chained(parts.where(edge), by, [], _levels(bits)[1:]))


def _chained(intervals: DataFrame, by: Sequence[str], attributes: Sequence[str], shifts: Sequence[int | None]) -> DataFrame:
    """Adjacent disjoint intervals with equal attributes as one. First in blocks of ids; only the first and the last run of a
    block can go on in another, and these are put together in larger blocks, at the end in the key."""
    done = None
    for shift in shifts:
        within = [] if shift is None else ["_block"]
        if within:
            intervals = intervals.withColumn("_block", F.shiftright("lo", shift))
        order = Window.partitionBy(*by, *within).orderBy("lo")
        same = F.lag("hi").over(order) == F.col("lo") - 1
        for a in attributes:
            same = same & F.lag(a).over(order).eqNullSafe(F.col(a))
        marked = intervals.withColumn("_new", F.when(same, 0).otherwise(1))
        marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = marked.groupBy(*by, *within, "_run", *attributes).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        if within:
            last = F.max("_run").over(Window.partitionBy(*by, *within))
            runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last))
            runs = _stored(runs) if len(shifts) > 2 and done is None else runs  # all rows; later levels have few
            inner = runs.where(~F.col("_edge")).select(*by, "lo", "hi", *attributes)
            done = inner if done is None else done.unionByName(inner)
            runs = runs.where("_edge")
        intervals = runs.select(*by, "lo", "hi", *attributes)
    return intervals if done is None else done.unionByName(intervals)


def coalesce_runs(intervals: DataFrame, by: Sequence[str], attributes: Sequence[str], bits: int = BITS) -> DataFrame:
    """Adjacent intervals with equal attributes as one. Intervals of a key are disjoint."""
    return _chained(intervals, by, attributes, _levels(bits))


def _borders(spans: DataFrame, by: Sequence[str], keep: int, cut: int) -> DataFrame:
    """(*by, _at, keep, cut, keeps, cuts): +1 where a span starts, -1 after its end; and the starts alone."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("s")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("s"))))
    e = spans.select(*by, ends.alias("e")).select(*by, F.col("e.at").alias("_at"), F.col("e.s").alias("_s"))
    start = F.greatest("_s", F.lit(0))
    return e.select(*by, "_at", *((c * n).cast("long").alias(name) for name, c, n in (("keep", F.col("_s"), keep), ("cut", F.col("_s"), cut), ("keeps", start, keep), ("cuts", start, cut))))


def _counted(events: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """A row for each border, with how many spans of each side hold the ids from it on."""
    names = ("keep", "cut", "keeps", "cuts")
    summed = _stored(events.groupBy(*by, "_at").agg(*(F.sum(n).alias(n) for n in names)))
    return _summed(summed, by, "_at", ("keep", "cut"), bits)


def _both(a: DataFrame, b: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    return _counted(_borders(a, by, 1, 0).unionByName(_borders(b, by, 0, 1)), by, bits)


def _sweep(borders: DataFrame, by: Sequence[str], wanted: Callable[[Column, Column], Column], bits: int) -> DataFrame:
    """Maximal ranges of ids where the counts of both sides (_counted) fulfil a condition."""
    now = wanted(F.col("_run_keep"), F.col("_run_cut"))
    was = wanted(F.col("_run_keep") - F.col("keep"), F.col("_run_cut") - F.col("cut"))
    turns = borders.where(now != was).select(*by, F.col("_at").alias("lo"), now.alias("_starts"))
    done = None
    for shift in _levels(bits):  # starts and ends take turns; one start of a block may end in a later one
        within = [] if shift is None else [F.shiftright("lo", shift)]
        order = Window.partitionBy(*by, *within).orderBy("lo")
        turns = turns.withColumn("_next", F.lead("lo").over(order)).withColumn("_first", F.lag("lo").over(order).isNull())
        turns = _stored(turns) if done is None else turns  # all rows; later levels have few
        whole = turns.where("_starts and _next is not null").select(*by, "lo", (F.col("_next") - 1).alias("hi"))
        done = whole if done is None else done.unionByName(whole)
        turns = turns.where("(_starts and _next is null) or (not _starts and _first)").select(*by, "lo", "_starts")
    return done


def merge_spans(spans: DataFrame, by: Sequence[str], bits: int = BITS) -> DataFrame:
    """Overlapping and adjacent spans as one: (*by, lo, hi)."""
    return _sweep(_counted(_borders(spans, by, 1, 0), by, bits), by, lambda keep, cut: keep > 0, bits)


def subtract_spans(a: DataFrame, b: DataFrame, by: Sequence[str], bits: int = BITS) -> DataFrame:
    """What of the spans of a no span of b covers."""
    return _sweep(_both(a, b, by, bits), by, lambda keep, cut: (keep > 0) & (cut == 0), bits)


def parted_spans(a: DataFrame, b: DataFrame, by: Sequence[str], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(a without b, b without a), counted once."""
    borders = _stored(_both(a, b, by, bits))
    return _sweep(borders, by, lambda keep, cut: (keep > 0) & (cut == 0), bits), _sweep(borders, by, lambda keep, cut: (keep == 0) & (cut > 0), bits)


def intersect_spans(a: DataFrame, b: DataFrame, by: Sequence[str], bits: int = BITS) -> DataFrame:
    return _sweep(_both(a, b, by, bits), by, lambda keep, cut: (keep > 0) & (cut > 0), bits)


def overlap_totals(a: DataFrame, b: DataFrame, by: Sequence[str], bits: int = BITS) -> DataFrame:
    """(*by, pairs, ids): how many pairs of intervals overlap and in how many ids, from one sweep and without any pair. Where
    a border is, all pairs of intervals that hold it are new but those that held the id before."""
    borders = _both(a, b, by, bits)
    big = lambda x: x.cast("decimal(19,0)")
    now = big(F.col("_run_keep")) * big(F.col("_run_cut"))
    old = big(F.col("_run_keep") - F.col("keeps")) * big(F.col("_run_cut") - F.col("cuts"))
    before = big(F.col("_run_keep") - F.col("keep")) * big(F.col("_run_cut") - F.col("cut"))
    turned = F.sum(((before - now).cast("decimal(19,0)") * big(F.col("_at"))).cast("decimal(38,0)"))
    return borders.groupBy(*by).agg(F.sum(now - old).cast("long").alias("pairs"), turned.cast("long").alias("ids"))


def forget(intervals: DataFrame, ids: DataFrame, by: Sequence[str], attributes: Sequence[str], value: str = "id", bits: int = BITS) -> DataFrame:
    """Disjoint intervals without some ids, attributes kept: each hole takes from the interval that holds it, found by its
    start, its own ids; what lies between holes stays."""
    holes = ids.select(*by, F.col(value).alias("_id")).where("_id is not null").distinct()
    held = asof_interval(holes, intervals.withColumn("_hi", F.col("hi")), by, "_id", ["_hi", *attributes], bits).where("_hi is not null")
    cuts = held.select(*by, F.col("_hi").alias("hi"), *attributes, F.col("_id").alias("_place"), F.lit(1).alias("_kind"), F.col("_id").alias("_next"))
    starts = intervals.select(*by, "hi", *attributes, (F.col("lo") - 1).alias("_place"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_next"))
    pieces = _handed(cuts.unionByName(starts), by, -F.col("_place"), [F.col("_kind")], "_next", bits, -1)  # with the next hole
    rest = pieces.select(*by, (F.col("_place") + 1).alias("lo"), F.least("hi", F.col("_last") - 1).alias("hi"), *attributes)
    return rest.where("lo <= hi")


def stamp(intervals: DataFrame, stamps: DataFrame, by: Sequence[str], bits: int = BITS) -> DataFrame:
    """Lays stamps (lo, hi, at, run, arrival) over intervals (lo, hi, at, run).

    A piece keeps its time only where it is strictly newer than all stamps; of stamps with one time the later arrival
    wins. Gaps are filled and neighbours with equal (at, run) become one.

    An interval is the sum of few dyadic ranges, two of a level at most, and the best stamp of each such range is known by
    a plain aggregation; an elementary cell between two borders takes the best of the ranges that hold it, on those levels
    that occur. So the work follows the number of stamps and the logarithm of their width, however many overlap.
    """
    cols = [*by, "lo", "hi", "at", "run", "arrival"]
    both = intervals.withColumn("arrival", F.lit(-1).cast("long")).select(*cols).unionByName(stamps.withColumn("arrival", F.col("arrival").cast("long")).select(*cols))
    borders = both.select(*by, F.explode(F.array("lo", F.col("hi") + 1)).alias("lo")).distinct()
    cells = _handed(borders, by, -F.col("lo"), [], "lo", bits, -1).where("_last is not null").select(*by, "lo", (F.col("_last") - 1).alias("hi"))
    width = F.length(F.bin(F.col("hi") - F.col("lo") + 1)).cast("int")
    best = both.select(*by, F.explode(_dyadic("lo", "hi", F.sequence(F.lit(0), width))).alias("d"), F.struct("at", "arrival", "run").alias("m"))
    best = _stored(best.groupBy(*by, "d").agg(F.max("m").alias("m")))
    levels = best.agg(F.collect_set("d.level").alias("levels"))  # one row
    asked = cells.crossJoin(F.broadcast(levels)).select(*by, "lo", "hi", F.explode("levels").alias("level"))
    asked = asked.select(*by, "lo", "hi", F.struct("level", F.expr("shiftright(lo, level)").alias("node")).alias("d"))
    met = _met(asked, best, [*by, "d"]).groupBy(*by, "lo", "hi").agg(F.max("m").alias("m"))
    return coalesce_runs(met.select(*by, "lo", "hi", F.col("m.at").alias("at"), F.col("m.run").alias("run")), by, ["at", "run"], bits)


def _dyadic(lo: str, hi: str, levels: Column) -> Column:
    """The interval as ranges (level, node): node n of a level k holds the ids from n * 2**k on, 2**k of them; two ranges of
    a level at most."""

    def at(k: Column) -> Column:
        low = F.call_function("shiftright", F.col(lo) - 1, k) + 1
        end = F.call_function("shiftright", F.col(hi) + 1, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        first = F.when(odd(low) & (low < end), F.struct(k.alias("level"), low.alias("node")))
        second = F.when(odd(end) & (low + F.when(odd(low), 1).otherwise(0) < end), F.struct(k.alias("level"), (end - 1).alias("node")))
        return F.array(first, second)

    return F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())


def asof_interval(keys: DataFrame, intervals: DataFrame, by: Sequence[str], key: str, carry: Sequence[str], bits: int = BITS) -> DataFrame:
    """Each key with the attributes of the interval that holds it; else nulls. Intervals of one `by` are disjoint.

    Distinct keys and starts of intervals are sorted together instead of a range join, and rows take what their key found;
    a key that very many rows have is one row in the sort.
    """
    left = keys.select(*by, F.col(key).alias("_asked"), F.lit(1).alias("_is")).where("_asked is not null").distinct()
    right = intervals.select(*by, F.col("lo").alias("_asked"), F.lit(0).alias("_is"), F.struct("hi", *carry).alias("_iv"))
    seen = _handed(left.unionByName(right, allowMissingColumns=True), by, F.col("_asked"), [F.col("_is")], "_iv", bits)
    found = seen.where((F.col("_is") == 1) & (F.col("_last.hi") >= F.col("_asked"))).select(*by, "_asked", F.col("_last").alias("_iv"))
    rows = keys.select(*keys.columns, F.col(key).alias("_asked"))
    return _met(rows, found, [*by, "_asked"], "left").select(*keys.columns, *(F.col(f"_iv.{c}").alias(c) for c in carry))


def _holding(points: DataFrame, spans: DataFrame, by: Sequence[str], point: str, lo: str, hi: str, test: str) -> DataFrame:
    """Points joined with the spans that hold them: a span is sought at the two dyadic ranges of its own size that it touches,
    a point at its range of each size that occurs. A pair meets once; hot ranges are split by the skew join."""
    level = F.when(F.col(lo) == F.col(hi), F.lit(0)).otherwise(F.length(F.bin(F.col(hi) - F.col(lo)))).cast("int")
    sized = spans.withColumn("_level", level)
    node = lambda c: F.expr(f"shiftright({c}, _level)")
    ranged = sized.withColumn("_node", F.explode(F.array_distinct(F.array(node(lo), node(hi)))))
    levels = sized.agg(F.collect_set("_level").alias("_levels"))  # one row
    asked = points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_node", node(point))
    return _met(asked, ranged, [*by, "_level", "_node"]).where(test).drop("_level", "_node")


def overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of intervals that overlap, b's columns as b_lo, b_hi and its others: the start of one lies in the other. For
    counts of pairs take overlap_totals, which makes none."""
    right = b.withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"})
    first = _holding(a, right, by, "lo", "b_lo", "b_hi", "lo between b_lo and b_hi")
    second = _holding(right, a, by, "b_lo", "lo", "hi", "b_lo > lo and b_lo <= hi")
    return first.unionByName(second)


def point_join(points: DataFrame, spans: DataFrame, by: Sequence[str], point: str) -> DataFrame:
    """Points with the spans that hold them, with the columns of both: overlap_join where one side has single ids."""
    return _holding(points, spans, by, point, "lo", "hi", f"{point} between lo and hi")


def affine_map(pairs: DataFrame, by: Sequence[str], distinct: bool = True) -> DataFrame:
    """(producer_id, local_id, eligible) as intervals of constant distance: (*by, lo, hi, shift, eligible). distinct: as for
    islands."""
    shifted = pairs.select(*by, "producer_id", (F.col("local_id") - F.col("producer_id")).alias("shift"), "eligible")
    return islands(shifted, [*by, "shift", "eligible"], "producer_id", distinct=distinct)


def translate(spans: DataFrame, mapping: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(local spans of eligible ids, producer spans of unknown ids) of producer spans; the second must be empty."""
    merged = _stored(merge_spans(spans, by))
    return local_spans(merged, mapping, by), subtract_spans(merged, mapping.select(*by, "lo", "hi"), by)


def local_spans(merged: DataFrame, mapping: DataFrame, by: Sequence[str]) -> DataFrame:
    """Local spans of the eligible ids of disjoint producer spans, whether or not all ids are known."""
    met = overlap_join(merged, mapping, by).where("eligible")
    local = met.select(*by, (F.greatest("lo", "b_lo") + F.col("shift")).alias("lo"), (F.least("hi", "b_hi") + F.col("shift")).alias("hi"))
    return merge_spans(local, by)


def contiguous(seq: DataFrame, by: Sequence[str], value: str = "seq") -> DataFrame:
    """(*by, contiguous): whether the values of a key follow each other without gap or repetition."""
    return seq.groupBy(*by).agg(((F.max(value) - F.min(value) + 1 == F.count(value)) & (F.count(value) == F.count_distinct(value))).alias("contiguous"))
