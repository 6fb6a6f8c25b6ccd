"""Repeated passages: suffixes of what may repeat, ordered by two-stage sorting, and their adjacent common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_buffers, whole_groups
from .textscan import mix, prefix, stretch

#: Bytes of a string that may not occur twice; the anchor of such a string is its smallest gram of a third of the length.
LENGTH = 100
_PLACE = np.uint64((1 << 24) - 1)
#: Bits of the filter that names anchors whose stretches meet window by window.
FILTER_BITS = 1 << 25


# --- anchors: equal strings of `length` bytes have equal anchors, so they meet under the anchor's hash


def gram_of(length: int) -> int:
    return max(4, length // 3)


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: (hash of the anchor, text, first window, anchor, windows), places
    counted from the text's start. A window's anchor is the leftmost of its grams with the smallest hash."""
    gram = gram_of(length)
    span = length - gram + 1  # grams in a window
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    sums = prefix(data)
    start = np.arange(n - gram + 1)
    h = stretch(sums, start, start + gram)
    low = (h & ~_PLACE) | start.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n - length + 1], low[span - width : span - width + n - length + 1])
    size = np.diff(at)
    many = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), many)
    window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + at[:-1][text]
    anchor = (low[window] & _PLACE).astype(np.int64)
    if not len(anchor):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(cut, len(anchor)))
    text, first, anchor = text[cut], window[cut], anchor[cut]
    return h[anchor], text, first - at[:-1][text], anchor - at[:-1][text], count


def _pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple]:
    """anchors() in steps of bounded size; texts longer than a step are taken in overlapping pieces."""
    step = 1 << 20
    for low, high in steps(at, step):
        if at[high] - at[low] <= 8 * step:
            h, text, first, anchor, count = anchors(data[at[low] : at[high]], at[low : high + 1] - at[low], length)
            yield h, text + low, first, anchor, count
        else:
            size = at[high] - at[low]
            for begin in range(0, size - length + 1, step):
                end = min(begin + step + length - 1, size)
                h, text, first, anchor, count = anchors(data[at[low] + begin : at[low] + end], np.array([0, end - begin]), length)
                yield h, text + low, first + begin, anchor + begin, count


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(key, doc, place, kind): place packs the first window, the anchor's distance and the number of windows.

    Kind 0 is an anchor seen once in its batch, and meets the others under its hash. One seen more often is known to
    repeat: it goes anywhere (kind 1), and one row for all of them (kind 2) tells the other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            docs = batch["doc"].to_numpy()
            found = [(h, docs[text], first << 16 | (anchor - first) << 8 | (count - 1)) for h, text, first, anchor, count in _pieces(data, at, length)]
            if not found:
                continue
            h, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
            h = h >> np.uint64(16)  # 48 bits: a chance meeting costs a look and changes nothing
            order = np.argsort(h)
            h, doc, place = h[order], doc[order], place[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            lone = new & np.append(new[1:], True) if len(h) else new
            spread = mix(h ^ mix(place.astype(np.uint64) ^ doc.view(np.uint64))) >> np.uint64(16)
            tell = new & ~lone
            key = np.concatenate([np.where(lone, h, spread), h[tell]]).view(np.int64)
            kind = np.concatenate([np.where(lone, 0, 1), np.full(tell.sum(), 2)]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([doc, doc[tell]])), pa.array(np.concatenate([place, place[tell]])), pa.array(kind)], ["key", "doc", "place", "kind"])

    return rows.mapInArrow(run, "key long, doc long, place long, kind byte")


def _hot_anchors(rows: DataFrame, length: int, most: int) -> np.ndarray | None:
    """A filter of fixed size, as bits, of anchors that more stretches have than one key should gather; counted over all
    batches in which an anchor occurs twice. Where the filter admits other anchors too they only go the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            found = [h >> np.uint64(16) for h, *_ in _pieces(data, at, length)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

    counts = rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    part = F.shiftright(F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)), 15)
    parts = counts.groupBy(part.alias("part")).agg(F.expr(f"bitmap_construct_agg(key & {(1 << 15) - 1})").alias("bits")).collect()  # FILTER_BITS at most
    if not parts:
        return None
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in parts:
        out[r["part"] << 12 : r["part"] + 1 << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _repeated(found: DataFrame) -> DataFrame:
    """(doc, place) of the anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            yield from table.select(["doc", "place"]).filter(pa.array((kind == 1) | (same & (kind == 0)))).to_batches()

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, place long")


# --- two-stage suffix sorting


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of the suffixes that start there, told apart by `depth` bytes at least.

    Only suffixes smaller than their successors are sorted directly. The others follow from one scan over the
    buckets of first bytes in ascending order: each suffix found puts the one before it, if that is larger, next
    in its bucket. Runs of one byte longer than `depth` are equal as far as the depth goes and end their bucket.
    """
    n = len(text)
    words = depth // 8 + 1
    padded = np.concatenate([text, np.zeros(8 * words + 8, np.uint8)])
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    run_end = change[np.searchsorted(change, np.arange(n))]  # the last place of each place's run
    after = padded[np.minimum(run_end + 1, n)].astype(np.int16)
    after[run_end == n - 1] = -1
    larger = after < text  # than the successor; the last run is larger than the end
    larger[n - 1] = False  # the last place starts the induction of its run
    needed = np.zeros(n + 1, bool)
    needed[wanted] = True
    # what a larger suffix is induced from is needed too, down to the next one that is sorted directly
    stop = np.flatnonzero(~larger)
    lead = wanted[larger[wanted]]
    reach = stop[np.searchsorted(stop, lead)]
    sweep = np.zeros(n + 2, np.int32)
    np.add.at(sweep, lead, 1)
    np.add.at(sweep, reach + 1, -1)
    needed[:n] |= np.cumsum(sweep[:n]) > 0

    direct = np.flatnonzero(needed[:n] & ~larger)
    direct = direct[_direct_order(padded, direct, words)]
    if n - 1 in direct[-1:] or needed[n - 1]:  # the last suffix ends at once: it leads its bucket
        direct = np.concatenate([[n - 1], direct[direct != n - 1]])
        direct = direct[np.argsort(text[direct], kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {}
    induced = needed[:n] & larger
    out = []
    for c in np.unique(text[needed[:n]]).tolist():
        wave = np.concatenate(waiting.pop(c)) if c in waiting else np.zeros(0, np.int64)
        small = direct[bounds[c] : bounds[c + 1]]
        tail = small[:1] if len(small) and small[0] == n - 1 else small[:0]
        parts, turns = [tail, wave], 0
        wave = np.concatenate([tail, wave])
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == c)]
            turns += 1
            if turns > depth:  # what isn't placed by now starts with a longer run
                left = np.flatnonzero(induced & (text == c))
                parts.append(np.setdiff1d(left, np.concatenate(parts)))
                break
            parts.append(wave)
        bucket = np.concatenate([*parts, small[len(tail) :]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        cuts = np.flatnonzero(np.diff(chars[order])) + 1
        for part in np.split(before[order], cuts) if len(before) else []:
            waiting.setdefault(int(text[part[0]]), []).append(part)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    keep = np.zeros(n + 1, bool)
    keep[wanted] = True
    return found[keep[found]]


def _word(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers that compare as the bytes do."""
    window = np.lib.stride_tricks.sliding_window_view(padded, 8)[place]
    return np.ascontiguousarray(window).view(">u8").ravel().astype(np.uint64)


def _direct_order(padded: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """The order of suffixes by so many words, each word telling apart only what the ones before left equal."""
    key = _word(padded, place)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(place) + 1, bool)  # equal to the one before
    same[1:-1] = key[1:] == key[:-1]
    for k in range(1, words):
        tied = np.flatnonzero(same[:-1] | same[1:])
        if not len(tied):
            break
        own = order[tied]
        key = _word(padded, place[own] + 8 * k)
        group = np.cumsum(~same[tied])
        inner = np.lexsort((key, group))
        order[tied] = own[inner]
        key, group = key[inner], group[inner]
        equal = np.zeros(len(tied), bool)
        equal[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        same[tied] = equal
    return order


def common_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each place in order and the one before: the bytes they have in common, up to length. The first has 0."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    open_ = np.arange(1, len(order))
    for k in range(0, length, 8):
        if not len(open_):
            break
        gone = _word(padded, order[open_] + k) ^ _word(padded, order[open_ - 1] + k)
        full = gone == 0
        bits = np.where(full, 1, gone)
        lead = 7 - np.floor(np.log2(bits.astype(np.float64))).astype(np.int64) // 8
        out[open_] = k + np.where(full, 8, np.clip(lead, 0, 7))
        open_ = open_[full]
    return np.minimum(out, length)


def later_occurrences(text: np.ndarray, wanted: np.ndarray, length: int, rank: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which wanted places start a string of `length` bytes that also starts at one ranked before (the keys of rank,
    most significant first); places of equal rank are one."""
    late = np.zeros(len(wanted), bool)
    if len(wanted) < 2:
        return late
    index = np.zeros(len(text) + 1, np.int64)
    index[wanted] = np.arange(len(wanted))
    order = suffix_order(text, wanted, length)
    equal = common_prefix(text, order, length) >= length
    group = np.cumsum(~equal)
    tied = equal.copy()
    tied[:-1] |= equal[1:]
    own, group = index[order[tied]], group[tied]
    keys = [r[own] for r in rank]
    inner = np.lexsort((*keys[::-1], group))
    own, group = own[inner], group[inner]
    keys = [k[inner] for k in keys]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(own) else np.zeros(0, np.int64)
    lead = np.repeat(first, np.diff(np.append(first, len(own))))
    late[own] = ~np.logical_and.reduce([k == k[lead] for k in keys]) if len(own) else False
    return late


# --- the job


def _slices(rows: DataFrame, length: int, hot: np.ndarray | None) -> DataFrame:
    """Of first texts, what may repeat: (key, doc, th, first, windows, content) under the anchor's hash. Equal slices of
    a batch are sent once, by the earliest; the others are removed at once, and come as rows without content. Under a
    hot anchor each window is a slice of its own under its own hash, so only equal windows meet."""
    sent = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = gram_of(length)
        for batch in batches:
            data, at = text_buffers(batch["text"])
            if not len(data):
                continue
            doc, th = batch["doc"].to_numpy(), batch["th"].to_numpy()
            places = batch["places"]
            count = np.array([len(x) if x.is_valid else 0 for x in places], np.int64)
            if not count.sum():
                continue
            place = places.flatten().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), count)
            first, anchor, many = place >> 16, (place >> 16) + (place >> 8 & 255), (place & 255) + 1
            size = np.diff(at)[text]
            inside = (first + many + length - 1 <= size) & (anchor + gram <= size)  # a repeated id may have another text
            text, first, anchor, many = text[inside], first[inside], anchor[inside], many[inside]
            parts = []
            for a, b in steps(at, 1 << 20):
                own = np.flatnonzero((text >= a) & (text < b))
                piece = data[at[a] : at[b]]
                sums, sums2 = prefix(piece), prefix(piece ^ 0x55)
                t, f, m = text[own], first[own], many[own]
                s = anchor[own] + at[t] - at[a]
                g = stretch(sums, s, s + gram)
                is_hot = _admits(sent.value, g >> np.uint64(16))
                if is_hot.any():
                    one = np.repeat(np.arange(len(t)), np.where(is_hot, m, 1))
                    turn = np.arange(len(one)) - np.searchsorted(one, one)
                    t, f, m, g, is_hot = t[one], f[one] + turn, np.where(is_hot, 1, m)[one], g[one], is_hot[one]
                s = at[t] + f - at[a]
                body = stretch(sums, s, s + m + length - 1)
                g = np.where(is_hot, mix(body), g)
                parts.append((t, f, m, g, body, stretch(sums2, s, s + m + length - 1)))
            text, first, many, h, body, body2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            low = at[text] + first
            order = np.lexsort((first, th[text], doc[text], many, body2, body, h))
            keys = (h[order], body[order], body2[order], many[order])
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            t, f = text[order], first[order]
            itself = (doc[t] == doc[t[head]]) & (th[t] == th[t[head]]) & (f == f[head])
            gone = same & ~itself
            keep = ~same | gone
            order, gone = order[keep], gone[keep]
            raw = data.tobytes()
            content = [None if g else raw[x : x + m + length - 1] for g, x, m in zip(gone.tolist(), low[order].tolist(), many[order].tolist(), strict=True)]
            t = text[order]
            key = np.where(gone, mix(h[order] ^ mix(low[order].astype(np.uint64) ^ doc[t].view(np.uint64))), h[order]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[t]), pa.array(th[t]), pa.array(first[order]), pa.array(many[order].astype(np.int32)), pa.array(content, pa.binary())], ["key", "doc", "th", "first", "windows", "content"])

    return rows.mapInArrow(run, "key long, doc long, th long, first long, windows int, content binary")


def _admits(bits: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(key), bool)
    at = (key & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _removed(slices: DataFrame, length: int) -> DataFrame:
    """(doc, th, low, high): stretches of bytes that an earlier string covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 20_000):
            doc, th, first = (table[c].to_numpy() for c in ("doc", "th", "first"))
            many = table["windows"].to_numpy().astype(np.int64)
            has = table["content"].is_valid().to_numpy()
            own = np.flatnonzero(has)
            text, at = text_buffers(table["content"].chunk(0).filter(pa.array(has))) if len(own) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            row = np.repeat(np.arange(len(own)), many[own])
            turn = np.arange(len(row)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            rank = (doc[own][row], th[own][row], first[own][row] + turn)
            late = np.flatnonzero(later_occurrences(text, at[:-1][row] + turn, length, rank))
            r, s = row[late], first[own][row[late]] + turn[late]
            cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])) if len(r) else np.zeros(0, np.int64)
            end = s[np.append(cut[1:], len(s)) - 1] + length if len(r) else s
            gone = np.flatnonzero(~has)
            out = [np.concatenate(x) for x in ((doc[own][r[cut]], doc[gone]), (th[own][r[cut]], th[gone]), (s[cut], first[gone]), (end, first[gone] + many[gone] + length - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "th", "low", "high"])

    return slices.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, th long, low long, high long")


_RESULT = "id long, n_bytes long, spans array<struct<low:long,high:long>>, kept binary, kept_sha256 string"


def _cut(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            raw, ths = data.tobytes(), batch["th"].to_pylist()
            spans, kept = [], []
            for k, (is_first, marks) in enumerate(zip(batch["is_first"].to_pylist(), batch["marks"].to_pylist(), strict=True)):
                own = raw[at[k] : at[k + 1]]
                if not is_first:
                    found = [(0, len(own))] if len(own) >= length else []
                else:
                    found = []
                    for low, high in sorted((m["low"], m["high"]) for m in marks or () if m["th"] == ths[k]):
                        if found and low <= found[-1][1]:
                            found[-1] = (found[-1][0], max(found[-1][1], high))
                        else:
                            found.append((low, high))
                edges = [0, *(x for s in found for x in s), len(own)]
                spans.append([{"low": a, "high": b} for a, b in found])
                kept.append(b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.diff(at)), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["id", "n_bytes", "spans", "kept", "kept_sha256"])

    return rows.mapInArrow(run, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """Removes each byte that lies in a string of `length` bytes which also starts earlier.

    Returns (id_col, n_bytes, spans of removed bytes, kept bytes, kept_sha256) for each row. Earlier is a smaller
    id, or an earlier start in the same text; strings never cross texts and are judged on the input.
    1. Each window of `length` bytes has an anchor, the smallest gram in it; only anchors that occur twice can hold
    a repeated window. 2. The stretches around those anchors meet under the anchor's hash, equal ones of a batch
    as one. A line that very many texts hold between differing neighbours gathers its stretches under one anchor. With `hot`
    the windows of anchors with more stretches than that meet under their own hashes instead, so no key grows with such
    texts; that takes one more pass over the texts and a row for each such window. 3. Their suffixes are ordered by two-stage sorting, and neighbours with `length` bytes in common are
    one string, of which the earliest occurrence stays. Texts that equal an earlier text are removed whole.

    Null and empty texts have no bytes. Rows with one id and one text count as one document and have one result;
    texts that share an id are ordered by a hash. A row without an id comes before ids from -(2 ** 62) on, by its text's
    hash. Other columns are ignored.
    length is at most 254.
    """
    if not 8 <= length <= 254:
        raise ValueError("length must be from 8 to 254")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.coalesce("id", F.shiftrightunsigned(F.xxhash64("text"), 2) - F.lit(1 << 62) - F.lit(1 << 62)).alias("doc"), "text", F.xxhash64("text").alias("th"), F.unhex(F.md5("text")).alias("body"))
    hot_anchors = _hot_anchors(rows, length, hot) if hot is not None else None
    places = _repeated(_anchor_rows(rows.select("doc", "text"), length)).groupBy("doc").agg(F.collect_list("place").alias("places"))
    firsts = rows.select("doc", "body").groupBy("body").agg(F.min("doc").alias("doc")).groupBy("doc").agg(F.collect_list("body").alias("bodies"))
    facts = firsts.join(places, "doc", "left").select(F.col("doc").alias("f_doc"), "bodies", "places")
    texts = rows.select("id", "doc", "text", "th", "body")
    is_first = F.coalesce(F.array_contains("bodies", F.col("body")), F.lit(False))
    first = texts.join(facts, F.col("doc") == F.col("f_doc"), "left").where(is_first & F.col("places").isNotNull())
    marks = _removed(_slices(first.select("id", "doc", "text", "th", "body", "places"), length, hot_anchors), length)
    marks = marks.groupBy("doc").agg(F.collect_list(F.struct("th", "low", "high")).alias("marks"))
    facts = firsts.join(marks, "doc", "left").select(F.col("doc").alias("f_doc"), "bodies", "marks")
    out = texts.join(facts, F.col("doc") == F.col("f_doc"), "left").select("id", "text", "th", is_first.alias("is_first"), "marks")
    return _cut(out, length).withColumnRenamed("id", id_col)
