"""The stored index against scans of the messages as they are after each batch."""

import random

import pytest

from messagelake.operators import reads as R
from messagelake.operators.textindex import TextIndex

WORDS = ["of", "the", "Éa", "ea", "thing", "thin", "t", "x1", "naïve", "of-the"]
LITERALS = ["of the", "thing", "Ea", "of-the thin", "nothing here", "", "...", "x1 of"]
TERMS = [{"all_of": ["of", "the"]}, {"any_of": ["x1", "thin"], "none_of": ["EA"]}, {"phrase": "of the", "prefix": "th"}, {"prefix": "t"}, {"none_of": ["of"]}, {"all_of": ["missing"]}]


def text(r):
    return r.choice([None, "", "!!", " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 12)))])


@pytest.mark.parametrize("seed", range(2))
def test_searches_equal_scans_after_edits_and_removals(spark, tmp_path, seed):
    r = random.Random(seed)
    index, model = TextIndex(spark, f"{tmp_path}/i", groups=3, spread=2), {}
    for number in range(3):
        changed = {f"m{r.randrange(40)}": text(r) for _ in range(25)}
        gone = r.sample(sorted(model), min(6, len(model)))
        for _ in range(2 if number == 1 else 1):  # a batch that comes again changes nothing
            index.update(spark.createDataFrame(list(changed.items()), "key string, text string"), spark.createDataFrame([(g,) for g in gone], "key string"), number)
        model = {k: v for k, v in model.items() if k not in gone} | changed
        if number == 1:
            index.compact(0)
    now = spark.createDataFrame(list(model.items()), "key string, text string").cache()
    keys = lambda df: sorted(x.key for x in df.collect())
    for q in LITERALS:
        assert keys(index.literal(q)) == keys(now.where(R.literal("text", q)))
    for q in TERMS:
        assert keys(index.terms(**q)) == keys(now.where(R.search_terms("text", **q)))
    want = {(w, k, tuple(p)) for w, k, p in R.token_index(now, "key").collect()}
    assert {(w, k, tuple(p)) for w, k, p in index.postings.read().select("token", "key", "positions").collect()} == want
    index.compact(0)
    assert {x.token for x in index.dictionary.read().collect()} == {w for w, *_ in want}


def test_a_search_reads_the_buckets_of_its_words_only(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", key_type="long", groups=16, spread=2)
    index.update(spark.createDataFrame([(k, f"word{k} common word{k + 1}") for k in range(200)], "key long, text string"))
    assert [x.key for x in index.phrase(["word7", "common"]).collect()] == [7]
    read, every = set(index.of(["word7"]).inputFiles()), set(index.postings.read().inputFiles())
    assert read and len(read) <= 2 < len(every)
    assert len(set(index.of(["common"]).inputFiles())) >= 2  # a word of all messages is in several buckets
    assert len(index.with_prefix("word19").inputFiles()) == 1 and index.with_prefix("word19").count() == 11
    assert index.update(spark.createDataFrame([(7, "other")], "key long, text string")) is None
    assert index.phrase(["word7", "common"]).count() == 0
