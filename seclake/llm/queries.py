"""The numbered queries over the whole ``documents`` table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclake.llm import (
    attention, byte_repeats, contamination, conversations, licences, lines, mixing, near_copies,
    negatives, passages, repetition, secrets, toxicity,
)
from seclake.llm.blocks import read_table
from seclake.llm.registry import query

TOXIC_FROM = 0.7
GOOD_FROM = 0.3

_OP1 = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS at_line
  FROM documents),
lines AS (
  SELECT *, len(words) AS n, array_to_string(words, ' ') AS s FROM (
    SELECT doc_id, line, at_line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM raw)),
firsts AS (
  SELECT s, arg_min(words, (doc_id, at_line)) AS words, any_value(n) AS n,
         min((doc_id, at_line)) AS place FROM lines WHERE n > 0 GROUP BY s),
spots AS (
  SELECT s, n, place, words, unnest(range(1, n + 1)) AS pos FROM firsts
  WHERE n >= {lines.LEAST_WORDS}),
less AS (
  SELECT s, n, place, pos,
         md5(array_to_string(words[:pos - 1] || words[pos + 1:], ' ')) AS h FROM spots),
replaced AS (
  SELECT s FROM (SELECT s, place, min(place) OVER (PARTITION BY h, pos, n) AS first FROM less)
  WHERE first < place),
whole AS (SELECT s, place, md5(s) AS h FROM firsts WHERE n >= {lines.LEAST_WORDS}),
apart AS (
  SELECT CASE WHEN w.place < l.place THEN l.s ELSE w.s END AS s
  FROM less l JOIN whole w ON w.h = l.h),
short AS (
  SELECT s, place, length(s) AS len FROM firsts
  WHERE n < {lines.LEAST_WORDS} AND length(s) >= {lines.CHARS_AN_EDIT}),
cut AS (
  SELECT s, place, len, pos, substr(s, 1, pos - 1) || substr(s, pos + 1) AS v FROM (
    SELECT *, CAST(unnest(range(1, len + 1)) AS INT) AS pos FROM short)),
one_off AS (
  SELECT s FROM (SELECT s, place, min(place) OVER (PARTITION BY v, pos, len) AS first FROM cut)
  WHERE first < place
  UNION SELECT CASE WHEN w.place < c.place THEN c.s ELSE w.s END FROM cut c JOIN short w ON w.s = c.v),
stay AS (
  SELECT s, place FROM firsts
  WHERE s NOT IN (SELECT s FROM replaced UNION SELECT s FROM apart UNION SELECT s FROM one_off)),
marked AS (
  SELECT l.*, y.s IS NOT NULL AS stays FROM lines l
  LEFT JOIN stay y ON y.s = l.s AND y.place = (l.doc_id, l.at_line))
SELECT doc_id, CAST(count(*) FILTER (n > 0) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (n > 0 AND NOT stays) AS BIGINT) AS n_removed,
       sha256(CASE WHEN count(*) FILTER (n > 0) > 0 AND count(*) FILTER (stays) = 0 THEN ''
         ELSE coalesce(string_agg(line, chr(10) ORDER BY at_line) FILTER (stays OR n = 0), '')
         END) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(read_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP2 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
            || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1
            AS INT)] AS w
  FROM sized GROUP BY source),
level AS (
  SELECT 0 AS step, 0.0::DOUBLE AS each
  UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size)
            FILTER (2.0 * source_size <= w * each), 0)) / sum(w) FILTER (2.0 * source_size > w * each)
         FROM sources)
  FROM level WHERE step < 30),
targets AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size, w * (SELECT max(each) FROM level)) AS target
  FROM sources),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
rows_ AS (
  SELECT s.*, p.source_size, p.target, floor(ratio) AS whole, ratio - floor(ratio) AS p,
         target - floor(ratio) * p.source_size AS need
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
ranked AS (
  SELECT *, row_number() OVER w AS k, sum(size) OVER w AS ends FROM (
    SELECT *, u / (1 - u) / (p / (1 - p)) AS odds FROM rows_ WHERE p > 0 AND size > 0)
  WINDOW w AS (PARTITION BY source ORDER BY odds / (1 + odds), u, doc_id)),
plan_need AS (SELECT DISTINCT source, need FROM rows_ WHERE p > 0),
stops AS (
  SELECT source, need, 0 AS k, 0.0::DOUBLE AS ends FROM plan_need
  UNION ALL SELECT source, need, k, ends FROM ranked),
best AS (
  SELECT source, arg_min(k, (abs(ends - need), ends)) AS k,
         arg_min(need - ends, (abs(ends - need), ends)) AS gap
  FROM stops GROUP BY source),
fill1 AS (
  SELECT r.source, arg_max(r.k, (r.size, -r.k)) AS k, max(r.size) AS size
  FROM ranked r JOIN best b ON r.source IS NOT DISTINCT FROM b.source
  WHERE r.k > b.k AND r.size <= b.gap GROUP BY r.source),
best2 AS (
  SELECT b.source, b.k, f.k AS k1, b.gap - coalesce(f.size, 0) AS gap
  FROM best b LEFT JOIN fill1 f ON b.source IS NOT DISTINCT FROM f.source),
fill2 AS (
  SELECT r.source, arg_max(r.k, (r.size, -r.k)) AS k
  FROM ranked r JOIN best2 b ON r.source IS NOT DISTINCT FROM b.source
  WHERE r.k > b.k AND r.k IS DISTINCT FROM b.k1 AND r.size <= b.gap GROUP BY r.source),
picks AS (
  SELECT r.doc_id FROM ranked r JOIN best2 b ON r.source IS NOT DISTINCT FROM b.source
  LEFT JOIN fill2 f ON r.source IS NOT DISTINCT FROM f.source
  WHERE r.k <= b.k OR r.k = b.k1 OR r.k = f.k)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST((r.whole + CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END) * r.size AS BIGINT) AS taken
FROM rows_ r LEFT JOIN picks p ON r.doc_id = p.doc_id
"""


@query("op2_mix_sources", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op3_licence_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(read_table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f.base)

    def number(kind):
        return F.size(F.filter(base, lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(
            spans, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secrets.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = toxicity.remainder(F.col("doc_id"), 3)
    scored = toxicity.toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), rest != 1)
    return scored.select(
        "doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


_LIMITS = repetition.RepetitionLimits()
_OP6 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
positions AS (
  SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS pos FROM w),
grams AS (
  SELECT doc_id, size, pos, count(*) OVER (PARTITION BY doc_id, size, gram) AS times FROM (
    SELECT doc_id, size, pos,
           array_to_string(words[pos:pos + size - 1], ' ') AS gram
    FROM positions, (VALUES (3), ({_LIMITS.least}), ({_LIMITS.longest + 1})) s(size)
    WHERE pos + size - 1 <= n)),
covered AS (
  SELECT doc_id, size, count(DISTINCT word) AS words FROM (
    SELECT doc_id, size, unnest(range(pos, pos + size)) AS word FROM grams WHERE times > 1)
  GROUP BY doc_id, size),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS again FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
           AS n_symbols,
         CAST(coalesce(again, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c3.words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(cm.words, 0) AS cov, coalesce(cl.words, 0) AS too_long
  FROM w LEFT JOIN lines USING (doc_id)
  LEFT JOIN covered c3 ON c3.doc_id = w.doc_id AND c3.size = 3
  LEFT JOIN covered cm ON cm.doc_id = w.doc_id AND cm.size = {_LIMITS.least}
  LEFT JOIN covered cl ON cl.doc_id = w.doc_id AND cl.size = {_LIMITS.longest + 1})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * cov <= {_LIMITS.covered_percent} * n_words AND too_long = 0 AS kept
FROM counts
"""


@query("op6_quality_rules", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(read_table(spark, sf_dir, "documents"), limits=_LIMITS).drop(
        "n_covered_words", "longest_repeat")


@query("op8_benchmark_matches")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.benchmark_matches(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = toxicity.remainder(F.col("doc_id"), 5)
    scored = attention.quality_scores(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), rest != 0)
    return scored.select(
        "doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


_OP7 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
positions AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM w WHERE len(words) >= 35),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY gram) AS times FROM (
    SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS gram FROM positions)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS word FROM windows WHERE times > 1),
lists AS (SELECT doc_id, list(word) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(
         list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN lists ON lists.doc_id = w.doc_id
"""


@query("op7_repeated_passages", _OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS gram FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM w
    WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common >= 85 * (s.n + t.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id,
       w.doc_id = min(b) AS kept
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id
GROUP BY w.doc_id, n
"""


@query("op10_near_copies", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(read_table(spark, sf_dir, "documents"), percent=85).drop("t")


_OP12 = r"""
WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
bytes AS (SELECT name, range AS i, ord(name[range]) AS b
  FROM (SELECT DISTINCT name FROM lots), range(1, 60) WHERE range <= len(name)),
crc AS (
  SELECT DISTINCT name, 0 AS i, 0 AS bit, 4294967295::BIGINT AS c FROM lots
  UNION ALL
  SELECT crc.name, CASE WHEN bit = 7 THEN crc.i + 1 ELSE crc.i END, (bit + 1) % 8,
    CASE WHEN (CASE WHEN bit = 0 THEN xor(c, b) ELSE c END) & 1 = 1
      THEN xor((CASE WHEN bit = 0 THEN xor(c, b) ELSE c END) >> 1, 3988292384)
      ELSE (CASE WHEN bit = 0 THEN xor(c, b) ELSE c END) >> 1 END
  FROM crc JOIN bytes ON bytes.name = crc.name AND bytes.i = crc.i + 1),
lot AS (SELECT name, xor(max_by(c, i * 8 + bit), 4294967295) % 20 AS lot FROM crc GROUP BY name),
harmed AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM lots JOIN lot USING (name), range(2) WHERE lot <> 0 AND (range = 0 OR lot = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM harmed),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
inserted(q, nq) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
ahead AS (
  SELECT q, q AS at, '' AS edits, 0 AS price, '' AS said FROM inserted
  UNION ALL SELECT q, nq, 'I', 2, CASE nq WHEN 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
  FROM inserted
  UNION ALL SELECT a.q, b.nq, 'II', 4, CASE a.nq WHEN 2 THEN chr(10) || 'user:' || chr(10) || 'assistant:'
    ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END
  FROM inserted a JOIN inserted b ON b.q = a.nq),
kept(q, letter, nq) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
way AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, 0 AS cost, '' AS audit, '' AS said FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n, nq, min(cost), arg_min(audit, (cost, audit)), arg_min(said, (cost, audit)) FROM (
    SELECT w.conv_id, j.n, CASE e.edit WHEN 'D' THEN a.at WHEN 'K' THEN k.nq ELSE i.nq END AS nq,
      w.cost + a.price + CASE e.edit WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END
        + CASE WHEN e.edit <> 'D' AND j.fault = 3 THEN 1 ELSE 0 END AS cost,
      w.audit || a.edits || e.edit AS audit,
      w.said || a.said || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text
        ELSE chr(10) || CASE i.nq WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text END AS said
    FROM way w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1
    JOIN ahead a ON a.q = w.q JOIN inserted i ON i.q = a.at
    CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(edit)
    LEFT JOIN kept k ON k.q = a.at AND k.letter = j.initial
    WHERE e.edit = 'D' OR (j.fault IN (0, 3) AND (e.edit = 'R' OR k.nq IS NOT NULL)))
  GROUP BY conv_id, n, nq),
ended AS (
  SELECT w.conv_id, min(w.cost + a.price) AS cost,
    arg_min(w.audit || a.edits, (w.cost + a.price, w.audit || a.edits)) AS audit,
    arg_min(w.said || a.said, (w.cost + a.price, w.audit || a.edits)) AS said
  FROM way w JOIN ahead a ON a.q = w.q
  LEFT JOIN (SELECT conv_id, max(n) AS n FROM judged GROUP BY conv_id) l
    ON l.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.n = coalesce(l.n, 0) AND a.at IN (0, 3) GROUP BY w.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(CASE WHEN said = '' THEN '' ELSE substr(said, 2) END) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op12_conversation_repair", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = conversations.damaged(read_table(spark, sf_dir, "conversations"))
    return conversations.conversation_report(rows, present)


_OP13 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op13_hard_negatives", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        rows.select(F.col("vec_id").alias("row_id"), label.alias("label"),
                    negatives.whole_numbers(F.col("embedding")).alias("vector"))
        .filter(negatives.usable(F.col("vector"))), F.col("row_id") % 100 == 0)


_OP11 = r"""
WITH bytes AS (
  SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b,
         generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), 1) AS pos
  FROM documents),
n1 AS (SELECT doc_id, pos, b, hash(b) AS v FROM bytes),
n2 AS (SELECT * REPLACE (hash(v, lead(v, 1) OVER w) AS v) FROM n1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n4 AS (SELECT * REPLACE (hash(v, lead(v, 2) OVER w) AS v) FROM n2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n8 AS (SELECT * REPLACE (hash(v, lead(v, 4) OVER w) AS v) FROM n4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n16 AS (SELECT * REPLACE (hash(v, lead(v, 8) OVER w) AS v) FROM n8 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n32 AS (SELECT * REPLACE (hash(v, lead(v, 16) OVER w) AS v) FROM n16 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n64 AS (SELECT * REPLACE (hash(v, lead(v, 32) OVER w) AS v) FROM n32 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n128 AS (SELECT * REPLACE (hash(v, lead(v, 64) OVER w) AS v) FROM n64 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n200 AS (SELECT doc_id, pos, b, CASE WHEN lead(pos, 199) OVER w IS NOT NULL
    THEN hash(v, lead(v, 72) OVER w) END AS v FROM n128 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
often AS (SELECT v FROM n200 WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1),
marked AS (SELECT doc_id, pos, b, max(CASE WHEN o.v IS NOT NULL THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
  FROM n200 LEFT JOIN often o USING (v)),
spans AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS first FROM marked),
told AS (SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (first) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""


@query("op11_suffix_array_dedup", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.without_repeated_bytes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
