"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the words of training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, spread_join, steps, text_buffers
from .textscan import FOLD, LETTERS, mix, powers, prefix, runs, stretch

#: Bytes of benchmark text that are broadcast as a set; the set takes about six times as much. Of a larger benchmark
#: only a filter of FILTER_BITS bits is broadcast.
BLOCK_BYTES = 32 << 20
FILTER_BITS = 1 << 27

_STEP = 1 << 20


@dataclass
class Words:
    """The words of some texts: where they begin and end as bytes, their text, their hashes, and the texts' bounds."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    sums: np.ndarray

    def windows(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all windows of m words; none crosses texts."""
        low = np.arange(max(0, len(self.hashes) - m + 1))
        low = low[self.text[low] == self.text[low + m - 1]]
        return low, mix((self.sums[low + m] - self.sums[low]) * powers(len(self.sums))[1][low]) + np.uint64(m)


def words_of(data: np.ndarray, at: np.ndarray, twist: int = 0) -> Words:
    """Words are runs of a-z, 0-9 and what is not ASCII, A-Z lower-cased; a twist gives hashes of another kind."""
    data = FOLD[data]
    first, last, text = runs(data, at, LETTERS)
    hashes = stretch(prefix(data ^ np.uint8(twist)), first, last) if len(first) else np.zeros(0, np.uint64)
    count = np.bincount(text, minlength=len(at) - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes) + 1)[0][: len(hashes)])])
    return Words(first, last, text, hashes, np.concatenate([[0], np.cumsum(count)]), sums)


class NgramSet:
    """The windows of some items as arrays: distinct hashes in order, the word each window begins with, and its items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number[item] for item, _ in items], np.int32)
        own = words_of(*text_buffers(pa.array([t for _, t in items], pa.large_string())))
        self.words = own.hashes
        size = np.minimum(n, np.diff(own.begin))
        self.sizes = sorted(set(size[size > 0].tolist()))
        low, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for m in self.sizes:
            first, h = own.windows(m)
            fits = size[own.text[first]] == m
            low.append(first[fits])
            hashes.append(h[fits])
        low, hashes = np.concatenate(low), np.concatenate(hashes)
        item = owner[own.text[low]]
        order = np.lexsort((item, hashes))
        low, hashes, item = low[order], hashes[order], item[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
        again = np.concatenate([[False], item[1:] == item[:-1]])[: len(hashes)] & ~new
        self.hashes, self.low = hashes[new], low[new]
        self.items = item[~again]
        self.of = np.append(np.flatnonzero(new[~again]), len(self.items))  # where each hash's items begin
        bits = max(10, (8 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.hashes >> self.shift).astype(np.int64)] = True

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.words, self.hashes, self.low, self.items, self.of, self.filter))

    def find(self, own: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, number of the window) of the windows of texts that the set holds, verified word by word."""
        out = [(np.zeros(0, np.int64),) * 3]
        for m in self.sizes:
            low, h = own.windows(m)
            maybe = np.flatnonzero(self.filter[(h >> self.shift).astype(np.int64)])
            low, h = low[maybe], h[maybe]
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[place] == h
            low, place = low[same], place[same]
            turn = np.arange(m)
            true = (own.hashes[low[:, None] + turn] == self.words[self.low[place][:, None] + turn]).all(1)
            out.append((low[true], np.full(true.sum(), m), place[true]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hit_runs(own: Words, low: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) words of the runs that windows cover; no run crosses texts."""
    change = np.zeros(len(own.hashes) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, low + m, -1)
    hit = np.cumsum(change[:-1]) > 0
    inner = hit[1:] & hit[:-1] & (own.text[1:] == own.text[:-1])
    first = np.flatnonzero(hit & ~np.concatenate([[False], inner])[: len(hit)])
    last = np.flatnonzero(hit & ~np.append(inner, False)[: len(hit)])
    return first, last


def without_spans(raw: bytes, own: Words, base: int, spans: list[tuple[int, int]]) -> bytes:
    """A text without the runs of words (first, last), counted in own, and what stands between their words."""
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : int(own.first[first]) - base])
        at = int(own.last[last]) - base
    return b"".join([*out, raw[at:]])


_ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("cleaned", T.StringType()),
]


def _scan(rows: DataFrame, grams: NgramSet) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            for a, b in steps(at, _STEP):
                own = words_of(data[at[a] : at[b]], at[a : b + 1] - at[a])
                low, m, window = sent.value.find(own)
                first, last = hit_runs(own, low, m)
                yield _result(batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a], own, first, last, *_named(own.text[low], window, sent.value))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *_ADDED]))


def _named(text: np.ndarray, window: np.ndarray, grams: NgramSet) -> tuple[np.ndarray, list[str]]:
    """(text, item) of the items whose windows occur, each once for a text, in order."""
    pairs = np.unique(text * len(grams.hashes) + window) if len(text) else text
    text, window = (pairs // len(grams.hashes), pairs % len(grams.hashes)) if len(pairs) else (pairs, pairs)
    size = grams.of[window + 1] - grams.of[window]
    item = grams.items[np.repeat(grams.of[window] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    both = np.unique(np.repeat(text, size) * max(1, len(grams.names)) + item)
    return both // max(1, len(grams.names)), [grams.names[k] for k in (both % max(1, len(grams.names))).tolist()]


def _result(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, own: Words, first: np.ndarray, last: np.ndarray, text: np.ndarray, names: list[str]) -> pa.RecordBatch:
    n = batch.num_rows
    owner = own.text[first]
    base = own.begin[owner]
    places = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    pair = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["first", "last"])
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(names, pa.string()))
    cleaned: list[str | None] = [None] * n
    for k in np.unique(owner).tolist():
        own_runs = list(zip(first[places[k] : places[k + 1]].tolist(), last[places[k] : places[k + 1]].tolist(), strict=True))
        cleaned[k] = without_spans(data[at[k] : at[k + 1]].tobytes(), own, int(at[k]), own_runs).decode()
    columns = [*batch.columns, pa.array(np.diff(own.begin)), pa.ListArray.from_arrays(pa.array(places), pair), items, pa.array(cleaned, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_words", "spans", "items", "cleaned"])


# --- a benchmark too large to broadcast


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """(m, h, h2, item): the distinct windows of items, by two hashes of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            for a, b in steps(at, _STEP):
                own, other = (words_of(data[at[a] : at[b]], at[a : b + 1] - at[a], twist) for twist in (0, 0x55))
                size = np.minimum(n, np.diff(own.begin))
                for m in sorted(set(size[size > 0].tolist())):
                    (low, h), (_, h2) = own.windows(m), other.windows(m)
                    fits = size[own.text[low]] == m
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(fits.sum(), m, np.int32)), pa.array(h[fits].view(np.int64)), pa.array(h2[fits].view(np.int64)), batch["item"].take(pa.array(a + own.text[low][fits]))], ["m", "h", "h2", "item"])

    return items.mapInArrow(run, "m int, h long, h2 long, item string").distinct()


def _candidates(rows: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    """(id, th, first, m, h, h2): the windows of texts that pass the filter."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            for a, b in steps(at, _STEP):
                own, other = (words_of(data[at[a] : at[b]], at[a : b + 1] - at[a], twist) for twist in (0, 0x55))
                for m in sizes:
                    (low, h), (_, h2) = own.windows(m), other.windows(m)
                    bit = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    maybe = np.flatnonzero(sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    low, text = low[maybe], own.text[low[maybe]]
                    row = pa.array(a + text)
                    first = (low - own.begin[text]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["th"].take(row), pa.array(first), pa.array(np.full(len(low), m, np.int32)), pa.array(h[maybe].view(np.int64)), pa.array(h2[maybe].view(np.int64))], ["id", "th", "first", "m", "h", "h2"])

    return rows.mapInArrow(run, "id long, th long, first int, m int, h long, h2 long")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the windows (first, m) that hit them and the items, as _scan() gives them."""
    kinds = T.StructType([f for f in rows.schema.fields if f.name not in ("hits", "names")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            hits, names = batch["hits"].to_pylist(), batch["names"].to_pylist()
            plain = batch.select(kinds.fieldNames())
            for a, b in steps(at, _STEP):
                own = words_of(data[at[a] : at[b]], at[a : b + 1] - at[a])
                low = np.array([own.begin[k] + x["first"] for k in range(b - a) for x in hits[a + k] or ()], np.int64)
                m = np.array([x["m"] for k in range(a, b) for x in hits[k] or ()], np.int64)
                first, last = hit_runs(own, low, m)
                text = np.array([k for k in range(b - a) for _ in names[a + k] or ()], np.int64)
                yield _result(plain.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a], own, first, last, text, [x for k in range(a, b) for x in sorted(names[k] or ())])

    return rows.mapInArrow(run, T.StructType([*kinds.fields, *_ADDED]))


def _by_join(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """What _scan() gives, for a benchmark of any size: one scan of the documents against a filter of fixed size finds
    candidate windows, which meet the items' windows by a join. Windows that many documents hold are spread."""
    windows = kept(_item_windows(items, n))
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = windows.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.expr(f"bitmap_construct_agg(h & {(1 << 15) - 1})").alias("bits")).collect()  # of FILTER_BITS at most
    bitmap = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in parts:
        bitmap[r["part"] << 12 : r["part"] + 1 << 12] = np.frombuffer(r["bits"], np.uint8)
    sizes = [r["m"] for r in windows.select("m").distinct().orderBy("m").collect()]  # n numbers at most
    rows = rows.withColumn("th", F.xxhash64("text"))
    key = ["m", "h", "h2"]
    found = kept(_candidates(rows, sizes, bitmap))
    seen = kept(found.groupBy(*key).agg(F.count("*").alias("rows")).join(windows.select(*key).distinct(), key))
    total = seen.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hits = kept(spread_join(found, seen, key, "rows", total))
    own = ["id", "th"]
    marks = hits.select(*own, F.struct("first", "m").alias("hit"), F.lit(None).cast("string").alias("item"))
    names = hits.select(*key, *own).distinct().join(windows, key).select(*own, F.lit(None).alias("hit"), "item")
    facts = marks.union(names).groupBy(*own).agg(F.collect_set("hit").alias("hits"), F.collect_set("item").alias("names"))
    facts = facts.select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "hits", "names")
    met = rows.join(facts, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    return _marked(met.select("id", "text", "rest", "hits", "names"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of documents that lie inside a window of n words of a benchmark item.

    Returns (id_col, text, n_words, n_hit, spans of hit words, items as strings, contaminated, cleaned, columns to
    carry), one row for each row; cleaned is the text without the spans, null where nothing is hit. The benchmark's size
    is summed first: up to block_bytes its windows are one broadcast set of hashes in order. Beyond that only a filter
    of fixed size is broadcast, and what passes it is joined with the items' windows by two hashes; the documents are
    scanned once for that, whatever the benchmark's size. In the set every candidate is verified word by word.

    An item of fewer words than n is one window of all its words; an item without words, or null, has none. Null
    or empty documents have no words. Rows that repeat an id or an item are kept as they are; equal item ids count
    once. Rows of an empty benchmark hit nothing. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = _scan(rows, NgramSet([tuple(r) for r in items.collect()], n)) if size <= block_bytes else _by_join(rows, items, n)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"] + 1)
    return found.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", hit.alias("n_hit"), "spans", "items", (hit > 0).alias("contaminated"), "cleaned", *(F.col("rest")[c].alias(c) for c in carry))
