"""Queries of quality rules, conversation repair and ranked search, with the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import quality, repair, search
from barloom.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):
    def put(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return put


def _quality_sql() -> str:
    rates = " UNION ALL ".join(
        f"SELECT r, lang, source, '{k}' AS rate, ({num} * {scale}) // greatest({den}, 1) AS v FROM m WHERE NOT base_failed"
        for k, (num, den, scale, *_) in quality.RATES.items())
    shift = "greatest(length(bin({v})) - 6, 0)"
    slack = "CASE rate " + " ".join(f"WHEN '{k}' THEN {x[3]}" for k, x in quality.RATES.items()) + " END"
    low = "rate IN (" + ", ".join(f"'{k}'" for k, x in quality.RATES.items() if x[4]) + ")"

    def fences(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""{name}_c AS (SELECT {keys}rate, b, count(*) AS n FROM v GROUP BY ALL),
 {name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}rate) AS total FROM {name}_c),
 {name}_q AS (SELECT {keys}rate, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN mid END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN mid END) AS q3
   FROM (SELECT *, (((b - 32 * s) << s) + ((1 << s) >> 1)) AS mid FROM (SELECT *, greatest(b // 32 - 1, 0) AS s FROM {name}_u)) GROUP BY ALL),
 {name}_f AS (SELECT {keys}rate, total, CASE WHEN {low} THEN q1 - greatest({slack}, {quality.SPREAD} * (q3 - q1)) END AS lo,
   q3 + greatest({slack}, {quality.SPREAD} * (q3 - q1)) AS hi FROM {name}_q)"""

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
 wins AS (SELECT r, i, list_slice(ws, i, i + {quality.WINDOW - 1}) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w WHERE len(ws) > {quality.WINDOW})),
 again AS (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM wins) WHERE k > 1),
 rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM again GROUP BY r),
 lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
   WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
 m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
   SELECT d.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
     CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
     CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
   FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r))),
 v AS (SELECT *, CAST({shift.format(v='v')} * 32 + (v >> {shift.format(v='v')}) AS BIGINT) AS b FROM ({rates})),
 {fences('own', 'lang, source')}, {fences('tongue', 'lang')}, {fences('whole', '')},
 lim AS (SELECT o.lang, o.source, o.rate, CASE WHEN o.total >= {quality.LEAST_ROWS} THEN o.lo WHEN t.total >= {quality.LEAST_ROWS} THEN t.lo ELSE a.lo END AS lo,
   CASE WHEN o.total >= {quality.LEAST_ROWS} THEN o.hi WHEN t.total >= {quality.LEAST_ROWS} THEN t.hi ELSE a.hi END AS hi
   FROM own_f o JOIN tongue_f t ON o.lang IS NOT DISTINCT FROM t.lang AND o.rate = t.rate JOIN whole_f a ON o.rate = a.rate),
 ok AS (SELECT v.r, bool_and(v >= coalesce(lo, v) AND v <= hi) AS ok
   FROM v JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source AND v.rate = lim.rate GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed, NOT base_failed AND ok AS kept
FROM m LEFT JOIN ok USING (r)"""


@query("op11_quality_rules", _quality_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents, and whether each passes the base rules and its group's limits."""
    return quality.judged(table(spark, sf_dir, "documents")).drop("lang", "source")


def _add(path: str, cost: str, edit: str) -> str:
    """A path text (seven digits of cost, a bar, the audit) with one more edit; 'x' stands for no path."""
    return f"CASE WHEN {path} = 'x' THEN 'x' ELSE concat(lpad(CAST(CAST({path}[1:7] AS BIGINT) + {cost} AS VARCHAR), 7, '0'), '|', {path}[9:], '{edit}') END"


OP12 = re.sub(r"\badd\(([\w.]+), ([^,]+), '(\w)'\)", lambda m: _add(*m.groups()), r"""
WITH RECURSIVE crc_steps AS (
  SELECT c AS entry, 0 AS k, CAST(c AS BIGINT) AS v FROM range(256) t(c)
  UNION ALL SELECT entry, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY entry) AS t FROM crc_steps WHERE k = 8),
raw AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
crc AS (SELECT key, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT key FROM raw)
  UNION ALL SELECT key, k + 1, xor((SELECT t FROM tab)[1 + (xor(v, ascii(key[k + 1])) & 255)], v >> 8) FROM crc WHERE k < length(key)),
hit AS (SELECT raw.*, xor(4294967295, v) % 20 AS fault FROM raw JOIN crc USING (key) WHERE k = length(key)),
dmg AS (SELECT r, conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE fault <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy) AS i,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dmg),
flt AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS last_initial, role[1] AS q FROM num),
f AS (SELECT *, NOT blank AND NOT dup AND bare[-1] NOT IN ('.', '!', '?') AS trunc FROM flt),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- Best cost and audit per state as one text, cost first, so that the least text is the least path; 'x' stands for no path.
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0000000|' AS n, 'x' AS s, '0000002|I' AS u, '0000004|II' AS a FROM ids
  UNION ALL
  SELECT conv_id, i, n, s, u2 AS u, least(a1, add(u2, 2, 'I')) AS a FROM (
    SELECT *, least(u1, add(n, 2, 'I'), add(s, 2, 'I'), add(a1, 2, 'I')) AS u2 FROM (
      SELECT w.conv_id, f.i, add(w.n, 3, 'D') AS n,
        CASE WHEN NOT gone AND q = 's' THEN least(add(w.s, 3, 'D'), add(w.n, t, 'K')) ELSE add(w.s, 3, 'D') END AS s,
        CASE WHEN gone THEN add(w.u, 3, 'D') ELSE least(add(w.u, 3, 'D'), add(w.n, 2 + t, 'R'), add(w.s, 2 + t, 'R'), add(w.a, 2 + t, 'R'),
          CASE WHEN q = 'u' THEN least(add(w.n, t, 'K'), add(w.s, t, 'K'), add(w.a, t, 'K')) ELSE 'x' END) END AS u1,
        CASE WHEN gone THEN add(w.a, 3, 'D') ELSE least(add(w.a, 3, 'D'), add(w.u, 2 + t, 'R'), CASE WHEN q = 'a' THEN add(w.u, t, 'K') ELSE 'x' END) END AS a1
      FROM walk w JOIN (SELECT *, blank OR dup AS gone, CAST(trunc AS BIGINT) AS t FROM f) f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1))),
best AS (SELECT conv_id, arg_max(least(n, a), i) AS z FROM walk GROUP BY conv_id),
got AS (SELECT conv_id, CAST(z[1:7] AS BIGINT) AS cost, z[9:] AS audit FROM best),
ops AS (SELECT conv_id, audit, j, audit[j] AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM got)),
placed AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i,
  sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS o FROM ops),
res AS (SELECT placed.*, f.role, f.text, max(CASE WHEN o = 1 AND e = 'K' AND f.q = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id) AS sys
  FROM placed LEFT JOIN f ON placed.conv_id IS NOT DISTINCT FROM f.conv_id AND placed.i = f.i AND e <> 'I'),
out AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
  FROM res WHERE e <> 'D' GROUP BY conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (i > 1 AND last_initial || q NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN cnt ON ids.conv_id IS NOT DISTINCT FROM cnt.conv_id LEFT JOIN got ON ids.conv_id IS NOT DISTINCT FROM got.conv_id
LEFT JOIN out ON ids.conv_id IS NOT DISTINCT FROM out.conv_id""")


@query("op12_conversation_repair", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, with their faults, the least edits and the digest of what they repair to."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    bad = repair.damaged(turns)
    found = repair.summaries(bad).withColumnRenamed("conv_id", "conv_s")
    holes = repair.gaps(bad).withColumnRenamed("conv_id", "conv_g")
    all_ = turns.select("conv_id").distinct()
    j = (all_.join(holes, F.col("conv_id").eqNullSafe(F.col("conv_g")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("conv_s")), "left"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13 = r"""
WITH words AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM (SELECT row_number() OVER () AS r, * FROM documents) WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (SELECT i, item_id, term, count(*) AS k FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, tot GROUP BY term, nn),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) AS v FROM tf JOIN w USING (term), tot),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(k * v) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20"""


@query("op13_ranked_search", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
