"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, steps, text_buffers
from .textscan import FOLD, LETTERS, mix, prefix, runs, stretch

#: Labelled rows that a model is fitted on, at most, of either label, by the smallest hashes of their ids; texts of any
#: length take part. Scoring has no bounds.
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 3500
#: Windows of a labelled text that the network is fitted on, at most: half of them those with most telling words, the
#: others by hash.
DRAWN = 8
#: Bytes of a word that the fit sees, at most, so that a window is bounded; scores take whole words.
_WORD_BYTES = 64
#: Words in a window, and from one window to the next: each word is in two.
WINDOW, STRIDE = 96, 48

GRAM_BUCKETS, EMBED, HIDDEN = 1 << 11, 12, 12
#: So many words, of those in three or more of the texts fitted on, have inputs of their own: the ones whose presence
#: goes with a label most (chi-square). All others are one word, and known by their characters.
KNOWN_WORDS = 300
#: Labelled texts below which each quarter of them is scored by a network of the others, to set the scores by.
FEW = 1500
FOLDS = 4
_PER_STEP = 2 << 20


def word_inputs(data: np.ndarray, at: np.ndarray) -> tuple:
    """The words of some texts: (text of each word, distinct word of each word, hash of each distinct word,
    character trigram buckets of the distinct words end to end, where each one's begin)."""
    data = FOLD[data]
    first, last, text = runs(data, at, LETTERS)
    if not len(first):
        return text, text, np.zeros(0, np.uint64), text, np.zeros(1, np.int64)
    hashes = stretch(prefix(data), first, last)
    own, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
    low, size = first[one], last[one] - first[one]
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(low - begin[:-1], size) + np.arange(begin[-1])
    chars = data[place].astype(np.int64)
    start = np.zeros(len(chars), bool)
    start[begin[:-1]] = True
    end = np.zeros(len(chars), bool)
    end[begin[1:] - 1] = True
    left = np.where(start, 0, np.roll(chars, 1))
    right = np.where(end, 0, np.roll(chars, -1))
    grams = ((left * 65_537 + chars * 257 + right) * 40_503 >> 4) % GRAM_BUCKETS
    return text, kind, own, grams, begin


def windows_of(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all windows: they overlap by half and reach a text's end; a text without words has none."""
    count = np.bincount(text, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    many = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)))
    owner = np.repeat(np.arange(n), many)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return begin[owner] + turn * STRIDE, np.minimum(WINDOW, count[owner] - turn * STRIDE), owner


def _summed(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by owner."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))
    out[owner[order][first]] = np.add.reduceat(rows[order], first)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class BiGRU:
    """The network. A step's gates take a word's input, projected once for each distinct word, and the state before."""

    def __init__(self, known: np.ndarray, seed: int = 7, lean: np.ndarray | None = None):
        r = np.random.default_rng(seed)
        new = lambda *shape, s=0.3: r.normal(0, s, shape).astype(np.float32)
        self.known = known  # hashes of words, ascending
        self.p = {"word": new(len(known) + 1, EMBED, s=0.1), "gram": new(GRAM_BUCKETS, EMBED, s=0.1)}
        if lean is not None and len(lean):  # a word's first input starts as its log odds of label 1
            self.p["word"][1:, 0] = lean
        for d in "fb":
            self.p |= {f"in_{d}": new(2 * EMBED, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"state_{d}": new(HIDDEN, 3 * HIDDEN)}
        self.p |= {"look": new(2 * HIDDEN, HIDDEN), "look_bias": np.zeros(HIDDEN, np.float32), "ask": new(HIDDEN), "out": new(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        self.scale = np.array([1.0, 0.0])

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        """0 for a word that isn't known, else its number."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, place + 1, 0)

    def inputs(self, buckets: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        size = np.diff(begin).astype(np.float32)[:, None]
        return np.concatenate([self.p["word"][buckets], np.add.reduceat(self.p["gram"][grams], begin[:-1]) / size], 1)

    def run(self, proj: dict[str, np.ndarray], kinds: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """The logit of each window. kinds: windows x steps of distinct words; mask: 1 where there is a word."""
        n, steps_ = kinds.shape
        states = np.zeros((steps_, n, 2 * HIDDEN), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for d, order in (("f", range(steps_)), ("b", range(steps_ - 1, -1, -1))):
            u, h, at = self.p[f"state_{d}"], np.zeros((n, HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            gates, last = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            for t in order:
                x = proj[d][kinds[:, t]]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ gates)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ last)
                m = mask[:, t : t + 1]
                new = h + m * z * (c - h)
                if keep:
                    trace[d].append((t, h, z, r, c))
                h = new
                states[t, :, at] = h
        look = np.tanh(states @ self.p["look"] + self.p["look_bias"])
        ask = np.where(mask.T > 0, look @ self.p["ask"], -1e9)
        ask = np.exp(ask - ask.max(0))
        share = ask / ask.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ self.p["out"] + self.p["out_bias"][0], (states, trace, look, share, pooled)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"}

    def slopes(self, x: np.ndarray, proj: dict, kinds: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Slopes of the mean log loss by parameter, and by the distinct words' inputs: back through time."""
        logit, (states, trace, look, share, pooled) = self.run(proj, kinds, mask, keep=True)
        p, g = self.p, {}
        d_logit = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ d_logit, np.array([d_logit.sum()])
        d_pooled = d_logit[:, None] * p["out"]
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("tnh,nh->tn", states, d_pooled)
        d_ask = share * (d_share - (share * d_share).sum(0))
        g["ask"] = np.einsum("tnk,tn->k", look, d_ask)
        d_look = d_ask[:, :, None] * p["ask"] * (1 - look**2)
        g["look"], g["look_bias"] = np.einsum("tnh,tnk->hk", states, d_look), d_look.sum((0, 1))
        d_states = d_states + d_look @ p["look"].T
        d_x = np.zeros_like(x)
        for d in "fb":
            u, at = p[f"state_{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            d_u, d_h = np.zeros_like(u), np.zeros((len(y), HIDDEN), np.float32)
            d_steps = np.zeros((kinds.shape[1], len(y), 3 * HIDDEN), np.float32)
            for t, h, z, r, c in reversed(trace[d]):
                m = mask[:, t : t + 1]
                d_h = d_h + d_states[t, :, at]
                d_c = d_h * m * z * (1 - c**2)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_zr = np.concatenate([d_h * m * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
                d_u[:, : 2 * HIDDEN] += h.T @ d_zr
                d_u[:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_steps[t, :, : 2 * HIDDEN], d_steps[t, :, 2 * HIDDEN :] = d_zr * m, d_c * m
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            d_proj = _summed(kinds.T.ravel(), d_steps.reshape(-1, 3 * HIDDEN), len(x))
            g[f"state_{d}"], g[f"in_{d}"], g[f"bias_{d}"] = d_u, x.T @ d_proj, d_proj.sum(0)
            d_x += d_proj @ p[f"in_{d}"].T
        return g, d_x

    def window_logits(self, kind: np.ndarray, buckets: np.ndarray, grams: np.ndarray, begin: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.float32)
        if not len(first):
            return out
        whole = self.project(self.inputs(buckets, grams, begin)) if begin[-1] <= 2 * _PER_STEP else None
        order = np.argsort(-size, kind="stable")
        for low in range(0, len(order), 2048):
            own = order[low : low + 2048]
            kinds, mask = gathered(kind, first[own], size[own])
            proj = whole
            if proj is None:  # many distinct words: only those of these windows
                used, kinds, sub_grams, sub = _used(kinds, grams, begin)
                proj = self.project(self.inputs(buckets[used], sub_grams, sub))
            out[own] = self.run(proj, kinds, mask)[0]
        return out

    def worst(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text: its worst window's logit; minus infinity without words."""
        text, kind, hashes, grams, begin = word_inputs(data, at)
        buckets = self.buckets(hashes)
        first, size, owner = windows_of(text, len(at) - 1)
        worst = np.full(len(at) - 1, -np.inf)
        np.maximum.at(worst, owner, self.window_logits(kind, buckets, grams, begin, first, size))
        return worst

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text: its worst window's score; 0 without words."""
        worst = self.worst(data, at)
        return np.where(np.isfinite(worst), _sigmoid(np.where(np.isfinite(worst), worst, 0) * self.scale[0] + self.scale[1]), 0.0)


def _used(kinds: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> tuple:
    """The distinct words of some windows, the windows in their numbers, and these words' trigrams."""
    used, local = np.unique(kinds, return_inverse=True)
    length = begin[used + 1] - begin[used]
    sub = np.concatenate([[0], np.cumsum(length)])
    return used, local.reshape(kinds.shape), grams[np.repeat(begin[used] - sub[:-1], length) + np.arange(sub[-1])], sub


def _all_words(texts: list[bytes]) -> tuple:
    """word_inputs() of many texts, in steps of bounded memory."""
    parts, n, step, size = [], 0, [], 0
    for k, t in enumerate(texts):
        step.append(t)
        size += len(step[-1])
        if size >= _PER_STEP or k == len(texts) - 1:
            at = np.concatenate([[0], np.cumsum([len(b) for b in step])]).astype(np.int64)
            text, kind, hashes, grams, begin = word_inputs(np.frombuffer(b"".join(step), np.uint8), at)
            parts.append((text + n, kind, hashes, grams, begin))
            n, step, size = k + 1, [], 0
    if not parts:
        return word_inputs(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    own, one, number = np.unique(np.concatenate([p[2] for p in parts]), return_index=True, return_inverse=True)
    base = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
    kind = np.concatenate([number[b + p[1]] if len(p[1]) else p[1] for b, p in zip(base[:-1], parts, strict=True)])
    grams = np.concatenate([p[3] for p in parts]).astype(np.int16)
    chars = np.concatenate([[0], np.cumsum([len(p[3]) for p in parts])])
    low = np.concatenate([c + p[4][:-1] for c, p in zip(chars[:-1], parts, strict=True)])
    length = np.concatenate([np.diff(p[4]) for p in parts])
    begin = np.concatenate([[0], np.cumsum(length[one])]).astype(np.int64)
    place = np.repeat(low[one] - begin[:-1], length[one]) + np.arange(begin[-1])
    return np.concatenate([p[0] for p in parts]), kind.astype(np.int64), own, grams[place.astype(np.int64)], begin


def gathered(kind: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of distinct words, as wide as the longest, and which places hold a word."""
    turn = np.arange(size.max())
    mask = turn < size[:, None]
    return kind[np.where(mask, first[:, None] + turn, first[:, None])], mask.astype(np.float32)


def fit_network(
    windows: list[bytes], owner: np.ndarray, y: np.ndarray, held: np.ndarray, known: np.ndarray, lean: np.ndarray, epochs: int = 12, rounds: int | None = None, batch: int = 256, rate: float = 0.02, decay: float = 0.3, blind: float = 0.2, seed: int = 7
) -> tuple[BiGRU, int]:
    """(network, epochs that it took) of windows; owner, ascending, names each one's text, y and held are by text.

    One window of each text and epoch: any at first, then in turn the one that scores worst, as the score takes the
    worst. Some words go unknown at random. Held texts only tell when to stop, and the weights of the best epoch
    stay; with `rounds` there are so many epochs instead. known: hashes of words, ascending, and their log odds.
    """
    r = np.random.default_rng(seed)
    net = BiGRU(known, seed, lean)
    if not len(windows) or len(set(y[~held].tolist())) < 2:
        net.p["out"][:] = 0
        return net, 0
    text, kind, hashes, grams, begin = _all_words(windows)
    first, size, one = windows_of(text, len(windows))
    owner = owner[one]
    buckets = net.buckets(hashes)
    weight_of = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    batch = 32 if len(y) < FEW else batch  # few texts: smaller steps, more rounds
    epochs = rounds or max(epochs, min(24, 20_000 // max(1, len(y))))
    turn, best, best_at, stays, since = 0, np.inf, 0, {k: v.copy() for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        noise = r.random(len(first))
        if epoch >= 2 and epoch % 2:  # the worst of a few windows of each text
            tried = np.flatnonzero((_turn(owner[np.argsort(noise)])[np.argsort(np.argsort(noise))] < 6) & ~held[owner])
            noise[:] = -np.inf
            noise[tried] = net.window_logits(kind, buckets, grams, begin, first[tried], size[tried])
        order = np.lexsort((noise, owner))
        picked = order[np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))]
        picked = picked[r.permutation(len(picked))]
        picked = picked[~held[owner[picked]]]
        for low in range(0, len(picked), batch):
            own = picked[low : low + batch]
            all_kinds, mask = gathered(kind, first[own], size[own])
            used, local, sub_grams, sub = _used(all_kinds, grams, begin)
            length = np.diff(sub)
            word = np.where(r.random(len(used)) < blind, 0, buckets[used])
            x = net.inputs(word, sub_grams, sub)
            g, d_x = net.slopes(x, net.project(x), local, mask, y[owner[own]].astype(np.float32), weight_of[owner[own]].astype(np.float32))
            g["word"] = _summed(word, d_x[:, :EMBED], len(net.p["word"]))
            g["gram"] = _summed(sub_grams, np.repeat(d_x[:, EMBED:] / length[:, None], length, 0), GRAM_BUCKETS)
            turn += 1
            for k, v in g.items():  # Adam, with weights that decay
                m1, m2 = memory[k]
                m1 *= 0.9
                m1 += 0.1 * v
                m2 *= 0.99
                m2 += 0.01 * v * v
                net.p[k] *= np.float32(1 - rate * decay * (k != "out_bias"))
                net.p[k] -= (rate * (1 - 0.7 * epoch / epochs) * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
        if rounds:
            continue
        judges = np.flatnonzero(held[owner]) if held.any() else np.arange(len(first))
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, owner[judges], net.window_logits(kind, buckets, grams, begin, first[judges], size[judges]))
        told = np.isfinite(worst)
        scale = _calibrated(worst[told], y[told], float(y.mean()))
        loss = _loss(worst[told] * scale[0] + scale[1], y[told])
        if loss < best - 1e-4:
            best, best_at, stays, since = loss, epoch + 1, {k: v.copy() for k, v in net.p.items()}, 0
        else:
            since += 1
            if since >= max(4, epochs // 5):
                break
    if not rounds:
        net.p = stays
    return net, rounds or best_at


def _turn(owner: np.ndarray) -> np.ndarray:
    """How many of the same owner come before."""
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]])) if len(owner) else np.zeros(0, np.int64)
    out = np.empty(len(owner), np.int64)
    out[order] = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return out


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit)))) if len(y) else 0.0


def _calibrated(logit: np.ndarray, y: np.ndarray, true_rate: float) -> np.ndarray:
    """A slope and an offset that make logits of the sample chances at the true rate of label 1."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, true_rate / rate, (1 - true_rate) / (1 - rate))
    a = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], 1)
    for _ in range(30):
        p = _sigmoid(x @ a)
        slope = x.T @ (weight * (p - y)) + 1e-2 * (a - [1.0, 0.0])
        a = a - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), slope)
    return a if np.isfinite(a).all() and a[0] > 0 else np.array([1.0, 0.0])


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, toxic, having): in how many of the texts (text, y) a word is; counted by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            labels = batch["y"].to_numpy()
            for low, high in steps(at, _PER_STEP):
                text, kind, hashes, _, _ = word_inputs(data[at[low] : at[high]], at[low : high + 1] - at[low])
                if len(text):
                    pairs = np.unique(text * len(hashes) + kind)
                    word, y = pairs % len(hashes), labels[low + pairs // len(hashes)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(word, y, len(hashes))), pa.array(np.bincount(word, minlength=len(hashes)))], ["word", "toxic", "having"])

    return texts.mapInArrow(run, "word long, toxic double, having long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("having").alias("having"))


def telling_words(texts: DataFrame, n: int, rate: float, most: int = KNOWN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words whose presence in a text goes with its label most, by chi-square over n texts: (hashes, ascending; log odds)."""
    expected = F.col("having") * rate
    chi = (F.col("toxic") - expected) ** 2 / (expected * (1 - rate)) / F.greatest(1 - F.col("having") / n, F.lit(1e-9))
    odds = F.log((F.col("toxic") + rate) / (F.col("having") - F.col("toxic") + 1 - rate)) - float(np.log(rate / (1 - rate)))
    found = _word_counts(texts).where("having >= 3").select("word", chi.alias("chi"), odds.alias("odds")).where("chi > 0").orderBy(F.desc("chi"), "word").limit(most).toPandas()
    hashes = found.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.clip(found.odds.to_numpy(float), -3, 3)[order].astype(np.float32)


def draw_windows(texts: DataFrame, known: np.ndarray, lean: np.ndarray, most: int = DRAWN) -> DataFrame:
    """(id, window): at most so many windows of each text (id, text), whole windows of texts of any length. Half of them
    have most of the words that tell of label 1, the others the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            for low, high in steps(at, _PER_STEP):
                piece, own = data[at[low] : at[high]], at[low : high + 1] - at[low]
                begin, end, text = runs(FOLD[piece], own, LETTERS)
                if not len(begin):
                    continue
                hashes = stretch(prefix(FOLD[piece]), begin, end)
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                weight = np.where(known[place] == hashes, np.maximum(lean[place], 0), 0) if len(known) else np.zeros(len(hashes))
                sums = np.concatenate([[0], np.cumsum(weight)])
                first, size, owner = windows_of(text, high - low)
                told = sums[first + size] - sums[first]
                chance = mix(hashes[first] ^ mix(first.astype(np.uint64)))
                best = np.lexsort((chance, -told, owner))
                rank = np.empty(len(first), np.int64)
                rank[best] = _turn(owner[best])
                rest = np.lexsort((chance, rank < most // 2, owner))  # the best ones come last
                turn = np.empty(len(first), np.int64)
                turn[rest] = _turn(owner[rest])
                drawn = np.flatnonzero((rank < most // 2) | (turn < most - most // 2))
                raw = piece.tobytes()
                words = [b" ".join(raw[a : min(b, a + _WORD_BYTES)] for a, b in zip(begin[f : f + n].tolist(), end[f : f + n].tolist(), strict=True)) for f, n in zip(first[drawn].tolist(), size[drawn].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(low + owner[drawn])), pa.array(words, pa.binary())], ["id", "window"])

    return texts.select("id", "text").mapInArrow(run, "id string, window binary")


def _worst_logits(texts: DataFrame, nets: dict[int, BiGRU]) -> DataFrame:
    """(y, logit): whole texts (text, y, fold), each by the network that wasn't fitted on its fold; without words none."""
    sent = texts.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch["fold"].to_numpy()
            for fold, net in sent.value.items():
                own = np.flatnonzero(folds == fold)
                data, at = text_buffers(batch["text"].take(pa.array(own)))
                found = [net.worst(data[at[low] : at[high]], at[low : high + 1] - at[low]) for low, high in steps(at, _PER_STEP)]
                logit = np.concatenate(found) if found else np.zeros(0)
                told = np.isfinite(logit)
                yield pa.RecordBatch.from_arrays([pa.array(batch["y"].to_numpy()[own][told]), pa.array(logit[told])], ["y", "logit"])

    return texts.select("text", "y", "fold").mapInArrow(run, "y double, logit double")


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, drawn: int = DRAWN, few: int = FEW, **options) -> BiGRU:
    """A network fitted on labelled texts of any length: at most so many of either label, chosen by the smallest
    hashes of their ids, and at most `drawn` windows of each, cut where the texts are; only these reach the driver.

    Every fourth text is held out; scores are set by the held texts' worst windows, all windows of whole texts, to the
    share of label 1 among all labelled rows. With fewer than `few` texts each quarter is held out in turn, and the
    network that stays is fitted on all for as many epochs as those took. Of rows that share an id one text is used.
    Null labels, ids and texts are left out; with no rows, or one label alone, the score is that share (0.5 without rows).
    """
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    rate = known.agg(F.avg("y")).first()[0]
    part = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = part(1, toxic).union(part(0, clean))
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = kept(texts.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int")))
    facts = texts.select("id", "y", "fold").orderBy("id", "y").toPandas()
    y = facts.y.to_numpy(float)
    if not len(y) or len(set(y.tolist())) < 2:
        net = BiGRU(np.zeros(0, np.uint64))
        rate = 0.5 if rate is None else float(rate)
        net.p["out"][:], net.scale = 0, np.array([0.0, np.log((rate + 1e-6) / (1 - rate + 1e-6))])
        return net
    words, lean = telling_words(texts, len(y), float(y.mean()))
    found = draw_windows(texts, words, lean, drawn).orderBy("id", "window").toPandas()
    owner = np.searchsorted(facts.id.to_numpy(str), found.id.to_numpy(str))
    folds = facts.fold.to_numpy()
    fit = lambda held, **more: fit_network(found.window.tolist(), owner, y, held, words, lean, **(options | more))
    parts = {k: fit(folds == k) for k in range(FOLDS if len(y) < few else 1)}
    net = parts[0][0]
    if len(parts) > 1:
        net, _ = fit(np.zeros(len(y), bool), rounds=max(1, round(float(np.mean([n for _, n in parts.values()])))))
    told = _worst_logits(texts, {k: n for k, (n, _) in parts.items()}).toPandas()
    net.scale = _calibrated(told.logit.to_numpy(float), told.y.to_numpy(float), float(rate))
    return net


def score_toxicity(docs: DataFrame, model: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, score): the worst of all overlapping windows of the whole text.

    Null and empty texts, and texts without words, score 0. Equal texts have equal scores; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            scores = [sent.value.score(data[at[low] : at[high]], at[low : high + 1] - at[low]) for low, high in steps(at, _PER_STEP)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], ["id", "text", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, text string, score double").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "score")

