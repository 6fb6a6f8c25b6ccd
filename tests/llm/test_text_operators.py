"""Secrets, line dedup, decontamination and BPE against plain versions, with nulls, repeats and odd columns."""

import random
import re

import pytest

pytest.importorskip("messagelake.llm.common")
from messagelake.llm import bpe, common, decontaminate, line_dedup, secrets  # noqa: E402
from messagelake.llm.queries import vocabulary  # noqa: E402

COLUMNS = "doc_id long, text string, id long, th string, lines string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(k, t, 7, "x", "y") for k, t in zip(ids or range(len(texts)), texts)], COLUMNS)


def some_texts(seed, n=60):
    r = random.Random(seed)
    bits = ["password = ", "Secret:", "api_key='", "apikey=", "token", "AKIA", "ABCDEF0123456789ZZ", "deadbeef" * 3, "ſecret=abcdefghijklmnop", "é", "\n", " ", '"', "x" * 14, "=", "a-b_c/d+e.f==", "TOKEN:\"", "paſsword", "0123456789abcdef"]
    return [None, "", "\n\n"] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 12))) for _ in range(n)]


def test_secrets_equal_a_full_scan(spark):
    texts = some_texts(1, 200)
    rows = secrets.find_secrets(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text, want = texts[row.doc_id] or "", []
        for order, rule in enumerate(secrets.RULES):
            want += [(m.start(), order, rule.kind, m.end()) for m in rule.regex.finditer(text) if len(m[rule.group]) >= rule.least]
        assert [(s.first, s.kind, s.last) for s in row.spans] == [(a, k, b) for a, _, k, b in sorted(want)]


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") is True
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ["aki", "kia"])
    kind, options = secrets.trigram_query(secrets.RULES[0].pattern)
    assert kind == "or" and len(options) == 6 and all(o[0] == "and" for o in options)


def test_empty_tables(spark):
    none = frame(spark, [])
    path = vocabulary()
    assert secrets.find_secrets(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(none, path), path).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    assert [r.n_hit for r in decontaminate.decontaminate(frame(spark, ["a b", None]), items).collect()] == [0, 0]


def test_line_dedup(spark):
    common = "This line is in many documents"
    texts = [f"one\n {common} \nlast", f"{common.upper()}\n", f"\t{common}\r\n{common}\nshort", "short\nshort", None, "", f"one\n {common} \nlast"]
    ids = [0, 1, 2, 3, 4, 5, 0]
    rows = line_dedup.line_dedup(frame(spark, texts, ids)).collect()
    got = {r.doc_id: (len(r.lines), r.dropped, r.kept) for r in rows}
    assert len(rows) == 7
    assert got[0] == (3, [1], "one\nlast") and got[1] == (2, [0], "")
    assert got[2] == (3, [], texts[2]) and got[3] == (2, [], texts[3])
    assert got[4] == (1, [], "") and got[5] == (1, [], "")


def test_a_line_that_many_rows_hold_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(line_dedup, "spread_join", lambda *x: common.spread_join(*x, least=5))
    r = random.Random(7)
    lines = ["This line is nearly everywhere", *(f"Line {k} is in a few documents" for k in range(30))]
    texts = ["\n".join([lines[0], *(r.choice(lines) for _ in range(4))]) for _ in range(80)]
    last = {line: max(k for k, t in enumerate(texts) if line in t.split("\n")) for line in lines if any(line in t.split("\n") for t in texts)}
    many = {line for line in last if sum(line in t.split("\n") for t in texts) >= 3}
    for row in line_dedup.line_dedup(frame(spark, texts)).collect():
        assert row.kept == "\n".join(x for x in texts[row.doc_id].split("\n") if x not in many or last[x] == row.doc_id)


def brute_hits(text, items, n):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        w = split(item)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit.update(range(i, i + m))
                    names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [1 << 20, 0])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(3)
    vocab = ["a", "b", "C", "é", "d1", "E"]
    texts = [None, ""] + [" ".join(r.choice(vocab) + r.choice(["", ",", "."]) for _ in range(r.randrange(1, 40))) for _ in range(80)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 9)))) for k in range(30)] + [(99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(frame(spark, texts), bench, n=5, block_bytes=block).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words, hit, names = brute_hits(texts[row.doc_id], [(str(k), t) for k, t in items], 5)
        assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (words, hit, names, hit > 0)
        assert (row.cleaned is None) == (hit == 0) and (hit == 0 or brute_hits(row.cleaned, [], 5)[0] == words - hit)
    again = decontaminate.decontaminate(frame(spark, [texts[5]] * 3 + ["c"], [1, 1, None, None]), bench, n=5, block_bytes=block).collect()
    assert len(again) == 4 and len({r.n_hit for r in again if r.text == texts[5]}) == 1


def test_a_set_of_windows_is_compact():
    r = random.Random(9)
    items = [(str(k), " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(1500))) for k in range(250)]
    size = sum(len(t) for _, t in items)
    assert size > 2_000_000 and decontaminate.NgramSet(items, 10).nbytes() < 10 * size


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    library = Tokenizer.from_file(path)
    r = random.Random(5)
    bits = ["a", "aaa", "the ", " the", "  ", "\n", "\n\n ", "'s", "'", "!!", "é", "漢字", "1234", "🎉", "<|endoftext|>", "<|endo", " ", " ", "ß", "Ünder", "don't", "\t", "\r\n", "́"]
    texts = [None, ""] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 300))) for _ in range(150)] + ["a" * 5000, "ab" * 3333, "é" * 2001, " " * 3000, "the cat " * 2000, "漢" * 999]
    for leaf in (16, 50, 4096):
        rows = bpe.bpe_decode(bpe.bpe_encode(frame(spark, texts), path, leaf=leaf), path).collect()
        for row in rows:
            want = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
            assert row.ids == want, (leaf, texts[row.doc_id][:80])
            assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_long_texts_are_encoded_by_many_tasks(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary()
    library = Tokenizer.from_file(path)
    r = random.Random(6)
    bits = ["a", "the ", " the", "  ", "\n", "'s", "!!", "é", "漢字", "1234", "<|endoftext|>", "<|endo", "don't"]
    texts = [None, "short", "".join(r.choice(bits) for _ in range(9000)), "<|endoftext|>" * 400, "x" * 9000, "the cat " * 900, "the cat " * 900]
    ids = [0, 1, 2, 3, 4, 5, None]
    rows = bpe.bpe_encode(frame(spark, texts, ids), path, leaf=64, long=2000, piece=700).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids, (row.text or "")[:60]
    cut = bpe.codec(path).pieces(texts[3], 700)
    assert "".join(cut) == texts[3] and len(cut) > 6 and all(len(c) % 13 == 0 for c in cut)


def test_every_character_is_split_as_by_the_library():
    from tokenizers import Tokenizer

    path = vocabulary()
    own, library = bpe.Codec(path), Tokenizer.from_file(path)
    places = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in places[k : k + 512]) for k in range(0, len(places), 512)]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == want.ids
