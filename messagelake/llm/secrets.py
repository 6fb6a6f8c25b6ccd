"""Secret scans: a trigram index over blocks of texts, Boolean trigram queries derived from the rules, verified candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffers

#: Texts in one block of the index: a posting is a word of so many bits.
BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, the least length, and whether case counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

# --- Boolean trigram queries. A query is True (no demand), ("and", parts) , ("or", parts) or a trigram.

_MANY = 64


def _both(a, b):
    parts = [p for x in (a, b) if x is not True for p in (x[1] if isinstance(x, tuple) and x[0] == "and" else [x])]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", list(dict.fromkeys(map(_frozen, parts))))


def _either(options: list):
    if any(x is True for x in options):
        return True
    options = list(dict.fromkeys(map(_frozen, options)))
    return options[0] if len(options) == 1 else ("or", options)


def _frozen(x):
    return (x[0], tuple(x[1])) if isinstance(x, tuple) else x


def _grams(text: str):
    """What a literal demands: all its trigrams."""
    query = True
    for k in range(len(text) - 2):
        query = _both(query, text[k : k + 3])
    return query


def trigram_query(pattern: str):
    """The trigrams that any match of the pattern must hold, as a Boolean query over case-folded trigrams; True if none.

    Walks the parsed pattern with the set of literal strings that the part read so far can end in; where that set
    gets large or open, its trigrams are added to the demand and it starts anew.
    """

    def walk(parts, tails: set[str] | None, query):
        for op, arg in parts:
            options: set[str] | None = None
            if op is sre.LITERAL and arg < 128:
                options = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                tails, query = walk(arg[3], tails, query)
                continue
            elif op is sre.BRANCH:
                branches = [walk(x, tails, True) for x in arg[1]]
                ends = [t for t, _ in branches]
                known = all(t is not None for t in ends) and len(set().union(*ends)) <= _MANY
                query = _both(query, _either([q if known or t is None else _both(q, _either([_grams(s) for s in t])) for t, q in branches]))
                tails = set().union(*ends) if known else None
                continue
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = arg
                if low == 0 and high == 1:
                    with_it, _ = walk(inner, tails, True)
                    if tails is not None and (with_it is None or len(tails | with_it) > _MANY):
                        query = _both(query, _either([_grams(s) for s in tails]))
                    tails = None if tails is None or with_it is None or len(tails | with_it) > _MANY else tails | with_it
                    continue
                for _ in range(min(low, 3)):
                    tails, query = walk(inner, tails, query)
                if high != low or low > 3:
                    query, tails = _both(query, True if tails is None else _either([_grams(s) for s in tails])), None
                continue
            if options is not None:
                tails = {s + o for s in (tails if tails is not None else {""}) for o in options}
            else:
                query, tails = _both(query, True if tails is None else _either([_grams(s) for s in tails])), None
        return tails, query

    tails, query = walk(list(parser.parse(pattern)), {""}, True)
    return query if tails is None else _both(query, _either([_grams(s) for s in tails]))


# --- the index of a block: for each trigram the bits of the texts that hold it

_CLASS = np.zeros(256, np.uint32)
for _c in range(256):
    _CLASS[_c] = ord(chr(_c).lower()) % 64 if _c < 128 else _c % 64


def _code(gram: str) -> int:
    a, b, c = (int(_CLASS[ord(x)]) for x in gram)
    return a << 12 | b << 6 | c


class Postings:
    """The inverted index of up to BLOCK texts. Characters are folded to 64 classes, so postings may hold more
    texts than they should and never fewer."""

    def __init__(self):
        self.bits = np.zeros(1 << 18, np.uint64)

    def fill(self, data: np.ndarray, at: np.ndarray) -> None:
        self.bits[:] = 0
        folded = _CLASS[data]
        codes = folded[:-2] << np.uint32(12) | folded[1:-1] << np.uint32(6) | folded[2:]
        for k in range(len(at) - 1):
            if at[k + 1] - at[k] > 2:
                self.bits[codes[at[k] : at[k + 1] - 2]] |= np.uint64(1 << k)

    def find(self, query) -> int:
        """The texts that a query admits, as bits: postings intersected and united."""
        if query is True:
            return (1 << BLOCK) - 1
        if isinstance(query, str):
            return int(self.bits[_code(query)])
        found = [self.find(x) for x in query[1]]
        out = found[0]
        for x in found[1:]:
            out = out & x if query[0] == "and" else out | x
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text.

    Returns (id_col, text, spans array<struct<first,kind,last>>) for each row: code points, the end exclusive,
    ordered by start and then by the rules' order. Texts are taken in blocks of 64; a block's trigrams are indexed,
    each rule's query intersects their postings, and the rule's pattern verifies the texts that remain. A rule
    whose pattern demands no trigram scans every text. Matches of a rule are leftmost and do not overlap; those
    that are too short are dropped after matching. Blocks are cut within a partition, so nothing is shuffled.

    Null and empty texts have no spans; repeated rows each get theirs; other columns are ignored.
    """
    plans = [(rule, trigram_query(rule.pattern)) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Postings()
        own = [(k, rule, query, rule.regex) for k, (rule, query) in enumerate(plans)]
        indexed = any(query is not True for _, _, query, _ in own)
        for batch in batches:
            texts = batch["text"].to_pylist()
            data, at = text_buffers(batch["text"])
            out: list[list] = [[] for _ in texts]
            for low in range(0, len(texts), BLOCK):
                high = min(low + BLOCK, len(texts))
                if indexed and at[high] - at[low] > 2:
                    index.fill(data[at[low] : at[high]], at[low : high + 1] - at[low])
                elif indexed:
                    index.bits[:] = 0
                for order, rule, query, regex in own:
                    admitted = index.find(query)
                    for k in range(low, high):
                        if admitted >> (k - low) & 1 and texts[k]:
                            out[k].extend((m.start(), order, rule.kind, m.end()) for m in regex.finditer(texts[k]) if len(m[rule.group]) >= rule.least)
            spans = [[{"first": s, "kind": kind, "last": e} for s, _, kind, e in sorted(x)] for x in out]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("kind", pa.string()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], pa.array(spans, kind)], ["id", "text", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "id long, text string, spans array<struct<first:int,kind:string,last:int>>")
    return found.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "spans")
