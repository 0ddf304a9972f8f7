"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.llm import chat, decontaminate, licenses, mixing, neardup, quality, sharding, tokencount, topk, toxicity, turnrepair, warc, whitening
from loamframe.storage import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_offending"), "sentences")


def op3_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    warc.archive(table(spark, sf_dir, "pages"), path)
    found = warc.read_archive(spark, path)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


OP3_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31)::INT, 1)), '') AS payload_digest
  FROM hashed),
held AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM held
"""


def shard_digest(docs: DataFrame) -> DataFrame:
    placed = sharding.shard_documents(docs, shards=8, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Similarity(width=3, percent=85))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a),
c AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents")).drop("failed_rule")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS x FROM l WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) s(k) WHERE n > 1 GROUP BY doc_id),
o AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM l) GROUP BY ALL) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(lines) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
    len(regexp_extract_all(t, '[!?]')) AS shouts, len(regexp_extract_all(t, '[0-9]')) AS digits, coalesce(top, 0) AS top
  FROM l LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words OR (n_dup_lines >= 3 AND n_dup_lines > 0.3::DOUBLE * n_lines) OR n_repeat_words > 0.45::DOUBLE * n_words OR upper > 0.4::DOUBLE * letters
    OR shouts > 0.3::DOUBLE * n_words OR digits > 0.3::DOUBLE * word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR top > 0.25::DOUBLE * n_words) AS kept
FROM b
"""


def op8_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


EXTRA_CONVERSATION = -7


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's marks."""
    said = "\\### Assistant: </turn> ok"
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.digests(chat.format_windows(found.unionByName(extra), budget=512, history_turns=2, history_budget=128))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS pos, 2 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
    length(role) + len(regexp_extract_all(role, '[\\<\n]')) + length(text) + len(regexp_extract_all(text, '[\\<]')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, pos = 1 AND role = 'system' AS lead,
    max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id) AS st,
    max(CASE WHEN pos = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS sc FROM o),
p AS (SELECT *, sum(CASE WHEN lead THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos) AS e, greatest(1, 512 - 128 - coalesce(st, 0)) AS step FROM s),
k AS (SELECT *, floor((e - tokens) / step) AS low, floor((e - 1) / step) AS high FROM p),
g AS (
  SELECT *, coalesce(pos > 1 AND NOT lag(lead) OVER w AND (low <> lag(low) OVER w OR high <> lag(high) OVER w), false) AS cut,
    CASE WHEN NOT lag(lead) OVER w THEN lag(tokens) OVER w END AS t1, lag(chars) OVER w AS c1,
    CASE WHEN NOT lag(lead, 2) OVER w THEN lag(tokens, 2) OVER w END AS t2, lag(chars, 2) OVER w AS c2
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + chars) + coalesce(sum(coalesce(17 + sc, 0) + CASE WHEN t1 <= 128 THEN 17 + c1 + CASE WHEN t1 + t2 <= 128 THEN 17 + c2 ELSE 0 END ELSE 0 END) FILTER (cut), 0) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    quoted = lambda text: text.replace("'", "''")
    values = ", ".join(f"('{name}', {k}, '{quoted(text)}')" for name, texts in licenses.TEMPLATES.items() for k, text in enumerate(texts))
    words = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    bigrams = "CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    spdx = " ".join(f"WHEN {f"starts_with(name, '{k}')" if k.endswith('-') else f"name = '{k}'"} THEN '{v}'" for k, v in licenses.SPDX.items())
    t = licenses.THRESHOLD
    return rf"""
WITH t AS (SELECT license, k, {words.format("notice")} AS w FROM (VALUES {values}) v(license, k, notice)),
tb AS (SELECT license, k, {bigrams} AS b FROM t),
te AS (SELECT license, k, len(b) AS m, unnest(b) AS b FROM tb),
tt AS (
  SELECT *, CASE WHEN alone THEN 1 ELSE 0 END AS told, b = replace(regexp_extract(license, '-([0-9]+\.[0-9]+)$', 1), '.', ' ') AS ver
  FROM (SELECT te.*, one.n = 1 AS alone FROM te JOIN (SELECT b, count(DISTINCT license) AS n FROM te GROUP BY b) one USING (b))),
e AS (
  SELECT *, ceil(m * {2 - t} / {t} - 1e-9) AS width, ceil(sum(told) OVER (PARTITION BY license, k) / 2) AS half, bool_or(ver) OVER (PARTITION BY license, k) AS versioned FROM tt),
d0 AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL),
sp AS (SELECT doc_id, unnest(regexp_extract_all(text, '{licenses.SPDX_LINE}', 1)) AS unit FROM d0),
sn AS (SELECT doc_id, unit, unnest(regexp_split_to_array(lower(unit), '{licenses.SPDX_BETWEEN}')) AS name FROM sp),
s1 AS (SELECT DISTINCT doc_id, unit, CASE {spdx} END AS license FROM sn),
d AS (SELECT row, doc_id, regexp_replace(text, '{licenses.SPDX_LINE}', '', 'g') AS text FROM d0),
u AS (
  SELECT doc_id, unnest(list_concat(string_split(text, chr(10)),
    CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_split_to_array(text, '\n\s*\n') ELSE [] END, [text])) AS unit FROM d),
uw AS (SELECT DISTINCT doc_id, {words.format("unit")} AS w FROM u),
ub AS (SELECT doc_id, array_to_string(w, ' ') AS unit, {bigrams} AS b FROM uw WHERE len(w) > 0),
um AS (SELECT doc_id, unit, len(b) AS n, unnest(b) AS b FROM ub),
n AS (
  SELECT doc_id, unit, license, 2.0 * count(*) / (n + m) AS dice FROM um JOIN e USING (b)
  WHERE n BETWEEN m * {t} / {2 - t} - 1e-9 AND m * {2 - t} / {t} + 1e-9
  GROUP BY doc_id, unit, license, k, n, m, half, versioned HAVING 2.0 * count(*) / (n + m) >= {t} AND sum(told) >= half AND bool_or(ver) >= versioned),
nb AS (SELECT doc_id, unit, license, dice FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1
  UNION ALL SELECT doc_id, 'spdx ' || unit, license, 1.0 FROM s1 WHERE license IS NOT NULL),
whole AS (SELECT doc_id, license, max(dice) AS dice, count(DISTINCT unit) AS n_units FROM nb GROUP BY doc_id, license),
w AS (SELECT row, doc_id, {words.format("text")} AS w FROM d),
p AS (SELECT row, doc_id, unnest(range(len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
h AS (
  SELECT row, doc_id, license, k, m, half, versioned, width, p, b, told, ver, count(*) OVER (PARTITION BY row, license, k ORDER BY p RANGE BETWEEN CURRENT ROW AND 1000 FOLLOWING) AS ahead
  FROM p JOIN e USING (b) WHERE contains(b, ' ')),
a AS (SELECT row, license, k, p, m, half, versioned, width FROM h WHERE ahead >= m * {t} / {2 - t} - 1e-9),
f AS (SELECT a.*, b.b, b.p AS q, b.told, b.ver FROM a JOIN h b USING (row, license, k) WHERE b.p >= a.p AND b.p < a.p + a.width),
o AS (
  SELECT a.row, a.license, a.k, a.m, a.half, a.versioned, a.p, b.q, x.b, any_value(x.told) AS told, any_value(x.ver) AS ver, min(x.q) AS seen_at, count(*) AS c
  FROM a JOIN f b USING (row, license, k, p) JOIN f x ON x.row = a.row AND x.license = a.license AND x.k = a.k AND x.p = a.p AND x.q <= b.q GROUP BY ALL),
s AS (
  SELECT row, license, k, m, half, versioned, p, q, sum(c) AS c, count(*) AS d, sum(told) AS told, bool_or(ver) AS ver, string_agg(b, '|' ORDER BY seen_at) AS seen FROM o GROUP BY ALL),
g AS (
  SELECT row, license, p, q, seen, 2.0 * d / (q - p + 1 - c + d + m) AS dice FROM s WHERE told >= half AND ver >= versioned
  QUALIFY row_number() OVER (PARTITION BY row, license, k, p ORDER BY 2.0 * d / (q - p + 1 - c + d + m) DESC, q) = 1),
gb AS (SELECT * FROM g WHERE dice >= {t}),
gk AS (
  SELECT * FROM gb x WHERE NOT EXISTS (SELECT 1 FROM gb y WHERE y.row = x.row AND y.license <> x.license AND y.p <= x.q AND y.q >= x.p AND (y.dice > x.dice OR (y.dice = x.dice AND y.license < x.license)))),
i AS (SELECT doc_id, license, dice, count(DISTINCT seen) AS n_units FROM gk JOIN (SELECT row, doc_id FROM d) USING (row) GROUP BY ALL),
inner_ AS (SELECT doc_id, license, max(dice) AS dice, arg_max(n_units, dice) AS n_units FROM i GROUP BY ALL)
SELECT * FROM whole UNION ALL SELECT i.* FROM inner_ i LEFT JOIN whole w ON w.doc_id IS NOT DISTINCT FROM i.doc_id AND w.license = i.license WHERE w.license IS NULL
"""


def op11_turn_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations")
    return turnrepair.digests(found, turnrepair.repair(turnrepair.damaged(found)))


def _op11_sql() -> str:
    """The same by dynamic programming: per turn and state the least (cost, audit) as one string of nine digits and letters."""
    edit = lambda key, cost, letter: f"(lpad(CAST(CAST(left({key}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"
    keep = lambda key, initial: f"CASE WHEN ini = '{initial}' AND NOT must THEN {edit(key, 'cut', 'K')} END"
    role = lambda key: f"CASE WHEN NOT must THEN {edit(key, '2 + cut', 'R')} END"
    drop = lambda key: edit(key, 3, "D")
    asked = f"least(k2, {edit('k0', 2, 'I')}, {edit('k1', 2, 'I')}, {edit('k3', 2, 'I')})"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
f AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS f FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again FROM f WHERE f <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
k AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM o),
t AS (SELECT *, blank OR again AS must, CASE WHEN open THEN 1 ELSE 0 END AS cut FROM k),
n AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT must) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3 FROM t
  UNION ALL
  SELECT conv_id, pos, {drop('k0')}, least({drop('k1')}, {keep('k0', 's')}),
    least({drop('j2')}, {', '.join(keep(x, 'u') + ', ' + role(x) for x in ('k0', 'k1', 'j3'))}), least({drop('j3')}, {keep('j2', 'a')}, {role('j2')})
  FROM (SELECT *, least(k3, {edit('j2', 2, 'I')}) AS j3 FROM (
    SELECT s.conv_id, t.pos, k0, k1, k2, k3, ini, must, cut, {asked} AS j2 FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.pos = s.pos + 1))),
e AS (SELECT conv_id, arg_max(least(k0, k3, {edit('j2', 2, 'I')}), pos) AS best FROM (SELECT *, {asked} AS j2 FROM s) GROUP BY conv_id),
a AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM e),
x AS (SELECT conv_id, i, substr(audit, CAST(i AS INT), 1) AS letter FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS i FROM a)),
y AS (
  SELECT *, CASE WHEN letter <> 'I' THEN count(*) FILTER (letter <> 'I') OVER w END AS pos, count(*) FILTER (letter <> 'D') OVER w AS nth FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
z AS (SELECT y.*, t.role, t.text, max(CASE WHEN nth = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS led FROM y LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM y.conv_id AND t.pos = y.pos),
r AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS said
  FROM z WHERE letter <> 'D' GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.scaled(F.col("embedding"), 1024).alias("v"))
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(64) * c.cast("double")).cast("long") + 1_000_000)
    found = whitening.whiten(vectors.select("vec_id", whole.alias("x")), components=16)
    found = found.select("*", F.posexplode("whitened").alias("pos", "one"))
    return found.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), F.col("one").alias("whitened"), F.get("explained", "pos").alias("explained"), "identity_error"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_web_archive": OP3_SQL, "op6_near_duplicates": OP6_SQL, "op7_quality_rules": OP7_SQL, "op9_chat_windows": OP9_SQL, "op10_license_scan": _op10_sql(), "op11_turn_repairs": _op11_sql(), "op12_top_products": OP12_SQL}
