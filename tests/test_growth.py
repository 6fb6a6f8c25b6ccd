"""Work that must follow the rows: what joins put out, how large expressions get, how many rows a window holds."""

import pytest
from pyspark.sql import functions as F

from messagelake.operators import archive as A
from messagelake.operators import extract_b as B
from messagelake.operators import intervals as I
from messagelake.operators import routing as W
from messagelake.operators import schemas as J
from messagelake.operators import store as U


def join_rows(df):
    """The rows that each join of a query put out."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        inner = p.executedPlan() if name == "AdaptiveSparkPlan" else p.plan() if "QueryStage" in name else None
        if inner is not None:
            yield from walk(inner)
        if "Join" in name and p.metrics().contains("numOutputRows"):
            yield p.metrics().get("numOutputRows").get().value()
        for k in range(p.children().size()):
            yield from walk(p.children().apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_chats_that_share_an_identifier_are_not_joined_one_by_one(spark):
    chat = spark.range(1, 501).select(F.col("id").alias("ROWID"), F.lit("x").alias("chat_identifier"), F.when(F.col("id") % 2 == 0, "SMS").when(F.col("id") % 3 == 0, "RCS").alias("service_name"))
    message = spark.range(300).select(F.col("id").alias("ROWID"), F.when(F.col("id") % 3 == 0, "SMS").when(F.col("id") % 3 == 1, "other").alias("service"), F.when(F.col("id") < 290, "SMS;-;x").otherwise("SMS;-;y").alias("ck_chat_id"))
    found = B.infer_chat(message, spark.createDataFrame([(7, 5)], "chat_id long, message_id long"), chat)
    assert max(join_rows(found)) <= 300
    assert {r.message_id: r.chat_id for r in found.collect()} == {k: 2 if k % 3 == 0 else 1 for k in range(290) if k != 5}


def test_a_schema_reads_the_fields_of_each_level_once(spark):
    schema, value = {"type": "integer", "minimum": 5}, "1"
    for _ in range(6):
        schema, value = {"type": "object", "required": ["a"], "properties": {"a": schema}, "additionalProperties": False}, f'{{"a":{value}}}'
    found = J.check_schema(spark.createDataFrame([(value,), (value.replace("1", "7"),)], "raw string"), schema)
    assert [r.problems for r in found.collect()] == [["$" + ".a" * 6 + ": minimum 5"]]
    plan = found._jdf.queryExecution().optimizedPlan()
    seen = sum("as map<string,variant>" in x for x in plan.toString().replace("cast(", "\ncast(").split("\n"))
    assert seen <= 6 + 1, "a cast for each object and one for the value"


def test_archives_are_read_once(spark):
    """Each type of a manifest's field was told four times, a record was cast for each of its keys, and events were written as text and parsed again."""
    from messagelake.operators import verify as V

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(1, "m", 1, "{}")], "archive_id int, member string, line int, raw string")
    assert 0 < plan(V.manifest_problems(rows.select("archive_id", "raw"))).count("schemaOfVariant") < 40
    v = spark.createDataFrame([('{"b":1,"a":{"x":2},"iso":3}',)], "raw string").select(F.try_parse_json("raw").alias("v"))
    body = v.select(V.json_body(F.col("v")).alias("b"))
    assert body.first()["b"] == '{"a":{"x":2},"b":1}' and body._jdf.queryExecution().analyzed().toString().count("map<string,variant>") == 1
    raw = ['{"seq":1,"operation":"record","data":%s}' % d for d in ('{"entity_id":1}', '"{\\"entity_id\\":1}"', '"x"', "5", "null")] + [" \n[1]", "null"]
    got = V.checked_rows(spark.createDataFrame([(1, "records/changes.jsonl", k, r) for k, r in enumerate(raw)], rows.schema))
    assert [r.problem for r in got.orderBy("line").collect()] == ["record of no known kind"] * 2 + ["data is no object"] * 3 + ["row is no object"] * 2


def test_observations_and_events_are_parsed_once(spark):
    rows = spark.createDataFrame([('{"entity_urn":"nothing"}',), ("{broken",)], "raw string")
    found = A.check_observations(rows)
    assert {r.problem for r in found.collect()} == {"no JSON", "observation field source missing or no string"}
    events = spark.createDataFrame([(1, "record", "{}"), (0, "record", "{}"), (3, "none", "x")], "seq long, operation string, data string")
    bad = U.validate_events(events)
    assert {(r.seq, r.problem) for r in bad.collect()} == {(0, "bad sequence"), (1, "record of no known kind"), (3, "data is no object")}
    for df in (found, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def windows(df):
    return df._jdf.queryExecution().analyzed().toString().count("Window [")


def test_plans_over_intervals_do_not_multiply(spark):
    ids = spark.range(1, 60).select((F.col("id") % 2).alias("k"), "id")
    spans, holes = I.islands(ids.where("id % 5 != 0"), ["k"]), I.islands(ids.where("id % 3 = 0 and id % 5 != 0"), ["k"])
    mapping = I.affine_map(ids.select("k", F.col("id").alias("producer_id"), (F.col("id") + 100).alias("local_id"), (F.col("id") % 3 != 0).alias("eligible")), ["k"])
    local, rest = I.translate(spans, mapping, ["k"])[0], I.subtract_spans(spans, holes, ["k"])
    again = I.merge_spans(I.subtract_spans(I.merge_spans(rest, ["k"]), holes, ["k"]), ["k"])
    assert max(windows(df) for df in (local, rest, again)) <= 12
    for df, more in ((local, 100), (rest, 0), (again, 0)):
        found = [x for r in df.collect() for x in range(r.lo - more, r.hi - more + 1)]
        assert sorted(found) == [x for x in range(1, 60) if x % 5 and x % 3]


def test_a_window_over_dense_ids_holds_a_block_of_them(spark):
    ids = spark.range(1 << 20)
    assert ids.groupBy(I._block(F.col("id"), I.BITS)).count().agg(F.max("count")).first()[0] <= 1 << 18
    assert [tuple(r) for r in I.islands(ids.withColumn("k", F.lit(1)), ["k"]).collect()] == [(1, 0, (1 << 20) - 1)]


def test_retained_and_what_lies_outside_come_from_one_count(spark):
    span = lambda *rows: spark.createDataFrame(rows, "kind string, lo long, hi long")
    counted = []
    was, I._counted = I._counted, lambda *a: counted.append(1) or was(*a)
    try:
        assert sorted(map(tuple, W.retained(span(("a", 1, 9), ("b", 4, 4)), span(("a", 3, 4))).collect())) == [("a", 1, 2), ("a", 5, 9), ("b", 4, 4)]
    finally:
        I._counted = was
    assert len(counted) == 1
    with pytest.raises(ValueError):
        W.retained(span(("a", 1, 9)), span(("a", 9, 10)))


def test_coverage_alone_leaves_out_what_is_absent(spark):
    span = lambda *rows: spark.createDataFrame(rows, "kind string, lo long, hi long")
    prior, gone, staged = span(("a", 1, 20)), span(("a", 5, 9)), span(("a", 8, 8), ("a", 30, 31))
    out = W.finish_coverage(prior, gone, staged, absent=False)
    assert sorted(out) == ["coverage", "retained"]
    assert sorted(map(tuple, out["coverage"].collect())) == [("a", 1, 4), ("a", 8, 8), ("a", 10, 20), ("a", 30, 31)]
    assert sorted(map(tuple, W.finish_coverage(prior, gone, staged)["absent"].collect())) == [("a", 5, 7), ("a", 9, 9)]


def test_rows_are_worked_out_once_to_be_numbered(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = U.sequenced(spark.range(1000).mapInArrow(look, "id long"), ["id"])
    assert [r.seq - r.id for r in out.collect()] == [1] * 1000 and seen.value == 1000


def test_captured_events_are_checked_by_one_job(spark):
    from messagelake.plans import registry  # noqa: F401  # loads the plans in their order
    from messagelake.plans.q_feed import _numbered

    good = spark.createDataFrame([("identity_metadata", None, '{"scopes":{},"scope_mappings":[]}')], "operation string, urn string, data string")
    assert [r.seq for r in _numbered([good]).collect()] == [1]
    with pytest.raises(ValueError, match="2 captured events are not valid"):
        _numbered([good, good.withColumn("data", F.lit("{}")), good.withColumn("operation", F.lit("none"))])
