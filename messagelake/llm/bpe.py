"""BPE encoding and decoding by tree concatenation: halves of long texts are encoded apart and joined over re-encoded windows."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

#: Characters of text that are encoded in one go; longer texts are halved.
LEAF = 4096
#: Bytes of a text beyond which its pieces of so many characters are encoded by tasks of their own.
LONG, PIECE = 4 << 20, 1 << 18
#: Rows that a worker holds as Python objects at once.
ROWS = 256
#: Characters on either side of a join that are re-encoded first.
WINDOW = 32

#: Fixed value: how the vocabulary's pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("the vocabulary's ids must follow the order of its merges")
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.core = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {k: word for word, k in ranks.items()} | {k: s.encode() for s, k in special.items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for k, word in self.bytes_of.items():
            self.lengths[k] = len(word)

    # encoding

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """The ids of a whole text; a special token's string in it is that token."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        found = [np.array([self.special[p]], np.int64) if k % 2 else self._tree(p, leaf) for k, p in enumerate(parts) if p]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def pieces(self, text: str, size: int) -> list[str]:
        """A text cut every so many characters, but not inside a special token's string."""
        cuts, at = [0], size
        while at < len(text):
            for special in self.special:
                found = text.find(special, max(cuts[-1] + 1, at - len(special) + 1), at + len(special) - 1)
                at = found if 0 <= found < at else at
            cuts.append(at)
            at += size
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def join_pieces(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The ids of left + right from the ids of both; special tokens stand apart, so only what is between them joins."""
        marks = list(self.special.values())
        i, j = np.flatnonzero(np.isin(a, marks)), np.flatnonzero(np.isin(b, marks))
        i, j = int(i[-1]) + 1 if len(i) else 0, int(j[0]) if len(j) else len(b)
        if i:
            left = list(self.cut.finditer(left))[-1]
            left = left.string[left.end() :]
        if j < len(b):
            right = right[: self.cut.search(right).start()]
        if not left or not right:
            return np.concatenate([a, b])
        return np.concatenate([a[:i], self.join(left, a[i:], right, b[:j]), b[j:]])

    def leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_ordinary(text), np.int64)

    def _tree(self, text: str, leaf: int) -> np.ndarray:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(text[:half], self._tree(text[:half], leaf), text[half:], self._tree(text[half:], leaf))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The ids of left + right from the ids of both.

        A window around the join is encoded again. The window starts where a token of the left side starts and
        stops where one of the right side stops, and counts as agreed if its first and last tokens are those of
        the sides. It then grows and is encoded once more: only if the larger window has the smaller one's tokens
        inside, the ids outside are kept and the window's ids put between them. Else the window doubles, up to
        the whole text, which is right by itself.
        """
        ends_a, ends_b = np.cumsum(self.lengths[a]), np.cumsum(self.lengths[b])
        size = WINDOW
        before: tuple | None = None
        while size < max(len(left), len(right)):
            window = self._window(left, a, ends_a, right, b, ends_b, size)
            if window is None:
                before = None
            else:
                i, j, ids = window
                if before is not None and i <= before[0] and j >= before[1] and np.array_equal(ids, np.concatenate([a[i : before[0]], before[2], b[before[1] : j]])):
                    return np.concatenate([a[:i], ids, b[j:]])
                before = window
            size *= 2
        return self.leaf(left + right)

    def _window(self, left: str, a: np.ndarray, ends_a: np.ndarray, right: str, b: np.ndarray, ends_b: np.ndarray, size: int) -> tuple | None:
        """(first id of the left side inside, ids of the right side inside, the window's ids), or None where the sides don't agree."""
        cut_a, cut_b = max(0, len(left) - size), min(len(right), size)
        want_a, want_b = len(left[:cut_a].encode()), len(right[:cut_b].encode())
        i = int(np.searchsorted(ends_a, want_a)) + 1 if want_a else 0
        j = int(np.searchsorted(ends_b, want_b)) + 1 if cut_b < len(right) else len(b)
        tail, head = b"".join(map(self.bytes_of.get, a[i:].tolist())), b"".join(map(self.bytes_of.get, b[:j].tolist()))
        if i >= len(a) or j <= 0 or (i and not tail) or tail[:1] and 0x80 <= tail[0] < 0xC0:
            return None
        rest = right.encode()[len(head) : len(head) + 1]
        if rest and 0x80 <= rest[0] < 0xC0:
            return None
        ids = self.leaf((tail + head).decode())
        if len(ids) < 4 or (i and not np.array_equal(ids[:2], a[i : i + 2])) or (j < len(b) and not np.array_equal(ids[-2:], b[j - 2 : j])):
            return None
        return i, j, ids

    # decoding

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _ids(found: list[np.ndarray]) -> pa.ListArray:
    places = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32), pa.int32()))


def _dealt(texts: DataFrame, path: str, leaf: int, piece: int) -> DataFrame:
    """(id, th, ids) of texts (id, th, text), each of which many tasks encode: pieces apart, then neighbours joined level by
    level, each pair by any task."""
    kind = "id long, th long, k int, piece string, ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"].to_pylist()):
                parts = codec(path).pieces(text, piece)
                row = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["th"].take(row), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["id", "th", "k", "piece"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids([codec(path).encode(t, leaf) for t in batch["piece"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    def joined(pair: pa.Table) -> pa.Table:
        rows = sorted(pair.to_pylist(), key=lambda r: r["k"])
        text, ids = rows[0]["piece"], np.array(rows[0]["ids"], np.int64)
        for r in rows[1:]:
            ids = codec(path).join_pieces(text, ids, r["piece"], np.array(r["ids"], np.int64))
            text += r["piece"]
        return pa.table({"id": pa.array([rows[0]["id"]], pa.int64()), "th": pa.array([rows[0]["th"]], pa.int64()), "k": pa.array([rows[0]["k"] >> 1], pa.int32()), "piece": pa.array([text], pa.string()), "ids": _ids([ids])})

    parts = kept(texts.mapInArrow(cut, "id long, th long, k int, piece string"))
    size = parts.agg(F.max("k").alias("last"), F.count("*").alias("n")).first()
    now = kept(parts.repartition(max(1, size["n"] // 16), "id", "th", "k").mapInArrow(encoded, kind))
    for _ in range(int(size["last"] or 0).bit_length()):
        now = kept(now.groupBy("id", "th", F.shiftright("k", 1)).applyInArrow(joined, kind))
    return now.select("id", "th", "ids")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, carry: tuple[str, ...] = (), long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(id_col, text, ids array<int>, columns to carry) of every whole text; path names the vocabulary file on each executor.

    Texts longer than a leaf are halved down to leaves, which are encoded apart, and pairs of neighbours are
    joined upwards. Within a task that goes on in turn, as tasks already share the texts; a text of more than `long`
    bytes is cut into pieces that are encoded in parallel by tasks of their own, and joined in parallel level by level.
    Null and empty texts have no ids. Repeated rows are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                ids = _ids([codec(path).encode(t, leaf) if t else np.zeros(0, np.int64) for t in batch["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    found = rows.where(~is_long).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    large = rows.where(is_long).withColumn("th", F.xxhash64("text"))
    if not large.isEmpty():
        dealt = _dealt(large.select("id", "th", "text").dropDuplicates(["id", "th"]), path, leaf, piece).select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), "ids")
        found = found.union(large.join(dealt, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th"))).select(*rows.columns, "ids"))
    return found.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "ids", *(F.col("rest")[c].alias(c) for c in carry))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; bytes that are no UTF-8 become U+FFFD. Null ids are none."""

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        own = codec(path)
        few = (ids.slice(k, ROWS).to_pylist() for k in range(0, len(ids), ROWS))
        parts = [pa.array(["" if x is None else own.decode(x) for x in xs], pa.string()) for xs in few]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return encoded.withColumn(out_col, decoded(F.col(ids_col)))
