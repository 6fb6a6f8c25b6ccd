"""One query for each operator, with the parameters of production, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, line_dedup, merkle, near_dedup, neighbours, quality, quotes, secrets, suffix_dedup, topk, toxicity
from .common import LOWER, UPPER, ascii_lower, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, 'assign' AS kind, 0 AS ord, string_split_regex(t, '{ASSIGN}') AS ps, regexp_extract_all(t, '{ASSIGN}') AS ms, list_transform(regexp_extract_all(t, '{ASSIGN}', 2), lambda x: length(x) >= 12) AS ok FROM d
  UNION ALL SELECT doc_id, 'access', 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), list_transform(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18) FROM d
  UNION ALL SELECT doc_id, 'hex', 2, string_split_regex(t, '[0-9a-f]{{16,}}'), regexp_extract_all(t, '[0-9a-f]{{16,}}'), list_transform(regexp_extract_all(t, '[0-9a-f]{{16,}}'), lambda x: true) FROM d),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
s AS (SELECT doc_id, kind, ord, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(ms[i]) AS n FROM i WHERE ok[i]),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


@query("op1_secret_scan", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    kinds = [rule.kind for rule in secrets.RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    return found.select("doc_id", *map(count, kinds), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def fold(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(5) != 0)
    out = quality.score_quality(docs, quality.train_quality(docs, learn))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id < g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    out = bpe.bpe_decode(bpe.bpe_encode(documents(spark, sf_dir), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM bw WHERE len(ws) > 0),
bp AS (SELECT item_id, ws, m, unnest(range(1, (len(ws) - m + 2)::BIGINT)) AS i FROM bi),
b AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM bp),
ms AS (SELECT DISTINCT m FROM b),
dp AS (SELECT doc_id, ws, m, unnest(range(1, (len(ws) - m + 2)::BIGINT)) AS i FROM dw, ms WHERE len(ws) >= m),
h AS (SELECT dp.doc_id, dp.i, dp.m, b.item_id FROM dp JOIN b ON b.m = dp.m AND array_to_string(dp.ws[dp.i:dp.i + dp.m - 1], ' ') = b.gram),
hp AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h),
hn AS (SELECT doc_id, count(*) AS n_hit FROM hp GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hn ON hn.doc_id = dw.doc_id LEFT JOIN hi ON hi.doc_id = dw.doc_id
"""


@query("op8_decontaminate", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(3) != 1)
    out = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, learn))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=4).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE base AS (SELECT conv_id AS conv, turn, role, coalesce(text, '') AS text FROM conversations),
ln AS (SELECT conv, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT conv, turn, string_split_regex(text, '\r?\n') AS ls FROM base)),
lv AS (SELECT *, length(m) - length(replace(m, '>', '')) AS level, trim(regexp_replace(lower(substr(line, length(m) + 1)), '\s+', ' ', 'g')) AS said,
  regexp_matches(line, '(?i)^\s*(on\b.*\bwrote|.*\b(schrieb|a écrit|escribió)\b.*)\s*:\s*$') AS intro FROM (SELECT *, regexp_extract(line, '^[ \t]?(?:>[ \t]?)+') AS m FROM ln)),
rn AS (SELECT *, sum(step) OVER (PARTITION BY conv, turn ORDER BY pos) AS run FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv, turn ORDER BY pos) THEN 0 ELSE 1 END AS step FROM lv WHERE said <> '' AND NOT intro)),
ps AS (SELECT conv, turn, level, run, min(pos) AS lo, string_agg(said, ' ' ORDER BY pos) AS said FROM rn WHERE level > 0 GROUP BY conv, turn, level, run),
own AS (SELECT conv, turn, string_agg(line, chr(10) ORDER BY pos) AS body FROM lv WHERE level = 0 AND NOT intro GROUP BY conv, turn),
un AS (SELECT DISTINCT conv, turn, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS unit FROM (SELECT conv, turn, unnest(list_concat(string_split(body, chr(10)), list_concat(string_split_regex(body, '\n[ \t]*\n'), [body]))) AS raw FROM own)),
sr AS (SELECT ps.conv, ps.turn, ps.level, ps.lo, max(un.turn) AS source FROM ps LEFT JOIN un ON un.conv = ps.conv AND un.turn < ps.turn AND un.unit = ps.said GROUP BY ps.conv, ps.turn, ps.level, ps.run, ps.lo),
q AS (SELECT conv, turn, count(*) AS n_quotes, count(source) AS n_linked, arg_max(source, lo) FILTER (level = 1 AND source IS NOT NULL) AS parent_turn FROM sr GROUP BY conv, turn),
pt AS (SELECT b.conv, b.turn, [b.turn] AS path FROM base b LEFT JOIN q ON q.conv = b.conv AND q.turn = b.turn WHERE parent_turn IS NULL
  UNION ALL SELECT q.conv, q.turn, list_append(pt.path, q.turn) FROM pt JOIN q ON q.conv = pt.conv AND q.parent_turn = pt.turn)
SELECT b.conv AS conv_id, b.turn, b.role, row_number() OVER (PARTITION BY b.conv ORDER BY path) AS position, CAST(len(path) - 1 AS INTEGER) AS depth, parent_turn,
  coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, sha256(regexp_replace(coalesce(body, ''), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g')) AS body_sha256
FROM base b JOIN pt ON pt.conv = b.conv AND pt.turn = b.turn LEFT JOIN q ON q.conv = b.conv AND q.turn = b.turn LEFT JOIN own ON own.conv = b.conv AND own.turn = b.turn
"""


@query("op2_quotes", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", "position", "depth", "parent_turn", "n_quotes", "n_linked", F.sha2("body", 256).alias("body_sha256"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["high"] - s["low"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: Levels that the SQL of the trees goes up: 8**9 leaves of a language, 8**3 languages.
SQL_LEVELS, SQL_TOP_LEVELS = 9, 3


def _merkle_sql() -> str:
    """The trees level by level; a level changes trees of more than one node only."""

    def levels(n: str, first: str, count: int) -> list[str]:
        out = [f"{n}0 AS ({first})"]
        for k in range(count):
            out.append(f"{n}{k + 1} AS (SELECT t, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {n}{k} WHERE n > 1 GROUP BY t, pos // 8, n UNION ALL SELECT t, pos, n, h FROM {n}{k} WHERE n = 1)")
            out.append(f"{n}s{k} AS (SELECT a.t, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM {n}{k} a JOIN {n}{k} b ON a.t = b.t AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.t, a.pos)")
        return out

    value = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    step = lambda c: f"xor({c} >> 1, ({c} & 1) * 3988292384)"  # noqa: E731  # the polynomial of CRC-32
    parts = [
        "crc AS (SELECT list(c8 ORDER BY i) AS t FROM (SELECT i, " + ", ".join(f"{step(f'c{k}')} AS c{k + 1}" for k in range(8)) + " FROM (SELECT i, i AS c0 FROM range(256) r(i))))",
        f"d AS (SELECT doc_id, coalesce(':' || lang, '-') AS t, {leaf('text')} AS leaf, CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS forged FROM documents, crc)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM d)",
        *levels("a", "SELECT t, pos, n, leaf AS h FROM p", SQL_LEVELS),
        f"subs AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS pos FROM a{SQL_LEVELS})",
        *levels("b", "SELECT 1 AS t, pos, count(*) OVER () AS n, h FROM subs", SQL_TOP_LEVELS),
    ]
    joins, folds, proof = "", ["p.forged AS f0"], []
    for k in range(SQL_LEVELS + SQL_TOP_LEVELS):
        j, name = (k, "a") if k < SQL_LEVELS else (k - SQL_LEVELS, "b")
        here = f"{name}s{j}"
        joins += f" LEFT JOIN {here} ON {here}.pos = {'p' if name == 'a' else 'subs'}.pos // {8**j}" + (f" AND {here}.t = p.t" if name == "a" else "")
        folds.append(f"CASE WHEN {here}.l IS NULL THEN f{k} ELSE sha256({here}.l || f{k} || {here}.r) END AS f{k + 1}")
        proof.append(f"coalesce({here}.l || {here}.r, '')")
    last = f"f{SQL_LEVELS + SQL_TOP_LEVELS}"
    parts.append(f"o AS (SELECT p.doc_id, p.leaf, subs.h AS subroot, (SELECT h FROM b{SQL_TOP_LEVELS}) AS root, sha256({' || '.join(proof)}) AS proof_sha256, {', '.join(folds)} FROM p JOIN subs ON subs.t = p.t{joins})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM o"


OP11_SQL = _merkle_sql()


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    forged = merkle.leaf_digest(*(F.col(c) for c in fields[:-1]), ascii_lower(F.col("text")))
    docs = docs.withColumn("forged", F.when(fold(3) == 0, F.unhex(forged)))
    out = merkle.merkle_manifest(docs, fields, "lang", "doc_id", carry=("forged",))
    end = merkle.folded(F.coalesce(F.lower(F.hex("forged")), F.col("leaf")), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), end.alias("folded_root"), (end == F.col("root")).alias("verified"))


def _centroid_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    far = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT".format(d=dims)
    parts = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.r, c.j, {far} AS d FROM v, c{n} c) GROUP BY r)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT a.j, i, sum(v.x[i]) AS s, count(*) AS n FROM v JOIN a{n} a USING (r), range(1, {dims + 1}) t(i) GROUP BY a.j, i) GROUP BY j)")
            parts.append(f"c{n + 1} AS (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (j))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.j AS INTEGER) AS "cluster", a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.j = a.j"""


OP12_SQL = _centroid_sql()


@query("op12_centroid_clusters", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op13_exact_top_k", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
