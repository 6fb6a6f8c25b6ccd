"""An inverted index that stays: postings by token in buckets, merged with new, edited and removed messages, searched by bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.mergeable import MergeTable
from ..plans.state import kept
from .reads import indexed_phrase, query_phrases

#: Characters of a token that its place in the dictionary depends on: a prefix of so many is sought in one bucket.
HEAD = 2


class TextIndex:
    """Postings (token, key, positions) of messages (key, text), beside a dictionary of tokens and the tokens of each message.

    Postings are bucketed by a hash of the token and then of the key, so a search lists and reads only the files of its own
    tokens, and the postings of a token that a third of all messages hold are in `spread` buckets, each read by
    several tasks. update() writes what changed: postings of new and edited messages, and removals of those tokens that an
    edited message no longer has, which its stored tokens tell. Prefixes are looked up in the dictionary, bucketed by the
    first characters and sorted by token, so row groups beyond the prefix are skipped. Words are folded as S.tokens does.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", groups: int = 16, spread: int = 4):
        self.spark, self.groups, self.spread = spark, groups, spread
        by_token = lambda token: F.pmod(F.xxhash64(token), F.lit(groups)) * spread
        self._of_token = by_token
        place = (by_token(F.col("token")) + F.pmod(F.xxhash64("key", F.lit(1)), F.lit(spread))).cast("int")
        self.postings = MergeTable(spark, f"{path}/postings", f"token string, key {key_type}, positions array<int>", ["token", "key"], groups * spread, place)
        self.dictionary = MergeTable(spark, f"{path}/dictionary", "token string", ["token"], groups, F.pmod(F.xxhash64(F.substring("token", 1, HEAD)), F.lit(groups)).cast("int"))
        self.messages = MergeTable(spark, f"{path}/messages", f"key {key_type}, tokens array<string>", ["key"], groups)

    # --- writing

    def update(self, changed: DataFrame, gone: DataFrame | None = None, number: int | None = None) -> None:
        """Takes in messages (key, text), one row for each key, new or edited, and drops the keys in gone. A batch that has a number
        is taken in once; one that failed halfway is taken in again by the tables that miss it."""
        new = kept(changed.select("key", S.tokens("text").alias("all")).withColumn("tokens", F.array_sort(F.array_distinct("all"))))
        out = kept(changed.limit(0).select("key") if gone is None else gone.select("key").distinct().join(new.select("key"), "key", "left_anti"))
        touched = new.select("key").unionByName(out)
        stored = kept(self.messages.read(buckets=self.messages.touched(touched)).join(touched, "key", "left_semi").withColumnRenamed("tokens", "had"))
        lost = stored.join(new.select("key", "tokens"), "key", "left").select("key", F.explode(F.array_except("had", F.coalesce("tokens", F.array().cast("array<string>")))).alias("token"))
        spread = new.select("key", F.posexplode("all").alias("pos", "token"))
        postings = spread.groupBy("token", "key").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
        told = {"consumer": "update", "number": number} if number is not None else {}
        self.postings.merge(postings, lost.select("token", "key"), **told)
        words = new.select(F.explode("tokens").alias("token")).distinct()
        known = self.dictionary.read(buckets=self.dictionary.touched(words))
        self.dictionary.merge(words.join(known, "token", "left_anti"), **told)
        self.messages.merge(new.select("key", "tokens"), out, **told)  # last: until then the tokens that messages had are known

    def compact(self, most_deltas: int = 8) -> None:
        """Rewrites buckets with many deltas, and drops words from the dictionary that no message holds any more."""
        for t in (self.postings, self.messages):
            t.compact(most_deltas)
        unused = kept(self.dictionary.read().join(self.postings.read().select("token").distinct(), "token", "left_anti"))
        if not unused.isEmpty():
            self.dictionary.merge(unused.limit(0), unused)
        self.dictionary.compact(most_deltas)

    # --- searching

    def of(self, words: Sequence[str]) -> DataFrame:
        """The postings of some words, from their buckets alone."""
        words = sorted({S.fold_text(w) for w in words})
        row = self.spark.range(1).select(*(self._of_token(F.lit(w)).alias(f"b{k}") for k, w in enumerate(words))).first() if words else []
        buckets = {int(b) + k for b in row for k in range(self.spread)}
        return self.postings.read(buckets=sorted(buckets)).where(F.col("token").isin(words))

    def with_prefix(self, prefix: str) -> DataFrame:
        """(token) of the dictionary that begin so."""
        prefix = S.fold_text(prefix)
        buckets = None
        if len(prefix) >= HEAD:
            buckets = [self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(prefix[:HEAD])), F.lit(self.groups))).first()[0]]
        return self.dictionary.read(buckets=buckets).where(F.col("token").startswith(prefix))

    def phrase(self, words: Sequence[str]) -> DataFrame:
        """Keys of messages that hold the words one after the other."""
        return indexed_phrase(self.of(words), words, "key")

    def literal(self, query: str) -> DataFrame:
        """Keys of messages in which every white-space separated part of a query is a phrase, as reads.literal finds them."""
        found = None
        for words in query_phrases(query):
            one = self.phrase(words)
            found = one if found is None else found.join(one, "key", "left_semi")
        return self.postings.read(buckets=[]).select("key") if found is None else found

    def terms(self, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (), phrase: str | None = None, prefix: str | None = None) -> DataFrame:
        """Keys by a Boolean combination of tokens, a phrase and a token's beginning, as reads.search_terms finds them."""
        sets = [self.of([w]).select("key") for w in all_of]
        if any_of:
            sets.append(self.of(any_of).select("key").distinct())
        if phrase:
            sets.append(self.phrase(phrase.split()))
        if prefix:
            words = self.with_prefix(prefix)
            tokens = words.select(self._of_token(F.col("token")).alias("b")).distinct().collect()  # as many numbers as buckets at most
            buckets = sorted({int(r[0]) + k for r in tokens for k in range(self.spread)})
            sets.append(self.postings.read(buckets=buckets).join(words, "token", "left_semi").select("key").distinct())
        found = sets[0] if sets else self.messages.read().select("key")
        for s in sets[1:]:
            found = found.join(s, "key", "left_semi")
        return found.join(self.of(none_of).select("key").distinct(), "key", "left_anti") if none_of else found
