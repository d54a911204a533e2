"""Queries over opinion documents. The driver's prose is invented, so term lists are passed as parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import json_object_text
from barloom.operators import opinions as o
from barloom.plans.catalog import query
from barloom.plans.q_market import NAMED, named_boards
from barloom.sources import views as v

MT, ST, RT = ("the", "und", "les", "que"), ("of", "ein", "con", "par"), ("The", "In", "Et", "La")
URLS = "concat('http://h', CAST(doc_id % 3 AS VARCHAR), '.org/', CAST(doc_id // 2 AS VARCHAR))"


def docs(spark, sf):
    d = v.table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(F.col("doc_id").alias("position"), F.concat(F.lit("http://h"), (k % 3).cast("string"), F.lit(".org/"), F.floor(k / 2).cast("string")).alias("url"),
                    F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 5).cast("int")).alias("article_day"))


def _cnt(terms, c="text"):
    return " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms)


@query("document_quality", f"""SELECT doc_id, ({_cnt(MT)}) AS market_hits, array_to_string(list_filter([CASE WHEN length(text) < 600 THEN '正文少于600字' END,
  CASE WHEN ({_cnt(RT, "split_part(text, chr(10), 1)")}) = 0 AND ({_cnt(MT)}) < 2 THEN '缺少市场复盘主题' END, CASE WHEN ({_cnt(MT)}) < 2 THEN '市场维度不足' END,
  CASE WHEN ({_cnt(ST)}) < 2 THEN '板块/周期维度不足' END], lambda x: x IS NOT NULL), '|') AS reasons FROM documents""")
def _(spark, sf):
    z = o.quality_gate(docs(spark, sf), MT, ST, RT)
    return z.select(F.col("position").alias("doc_id"), "market_hits", F.array_join("reasons", "|").alias("reasons"))


IDS = f"""d0 AS (SELECT {URLS} AS url, sha256(text) AS h, left(sha256(text), 16) AS id, CAST(DATE '2024-01-01' + CAST(doc_id % 5 AS INT) AS DATE) AS article_day, doc_id AS position FROM documents),
 d1 AS (SELECT * FROM d0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1), d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY url) = 1)"""


def ident(spark, sf):
    return o.doc_identity(docs(spark, sf))


@query("document_identity", f"WITH {IDS} SELECT url, id AS doc_id, h AS body_sha256 FROM d2")
def _(spark, sf):
    return ident(spark, sf).select("url", "doc_id", "body_sha256")


def mined(spark, sf):
    d = ident(spark, sf)
    return d.select("doc_id", F.when(F.col("doc_id") < "4", F.array(F.lit("疑似单股为主"))).otherwise(F.array(F.lit("ok"))).alias("flags"))


@query("document_flag_filter", f"WITH {IDS} SELECT id AS doc_id FROM d2 WHERE id >= '4'")
def _(spark, sf):
    return o.flag_filter(ident(spark, sf), mined(spark, sf)).select("doc_id")


@query("documents_merged", f"WITH {IDS} SELECT id AS doc_id, CASE WHEN position % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM d2 WHERE id >= '4'")
def _(spark, sf):
    d = ident(spark, sf)
    return o.merge_staged(d.withColumn("version", F.lit("old")), d.filter("position % 2 = 0").withColumn("version", F.lit("new")), mined(spark, sf).filter("doc_id >= '4'")).select("doc_id", "version")


@query("documents_without_mined", f"WITH {IDS} SELECT id AS doc_id FROM d2 WHERE id < '4'")
def _(spark, sf):
    return o.missing_mined(ident(spark, sf), mined(spark, sf).filter("doc_id >= '4'"))


@query("new_documents", f"WITH {IDS} SELECT url FROM d1 WHERE position % 3 > 0")
def _(spark, sf):
    d = docs(spark, sf).withColumn("doc_id", F.substring(F.sha2("body", 256), 1, 16))
    d = d.groupBy("url").agg(F.min_by("position", "doc_id").alias("position"))
    out = None
    for i in range(3):
        p = o.new_documents(d, d.filter("position % 3 = 0"), i, 3).select("url")
        out = p if out is None else out.unionByName(p)
    return out


@query("source_fingerprint", f"""WITH {IDS}, f AS (SELECT article_day, count(*) AS n, sha256('[' || string_agg('"' || url || '"', ', ' ORDER BY url) || ']') AS fingerprint FROM d2 GROUP BY 1)
  SELECT article_day, n, fingerprint, dayofmonth(article_day) % 4 <= 1 AS delivered FROM f""")
def _(spark, sf):
    f = o.source_fingerprint(ident(spark, sf))
    # Receipts: accepted for this set; accepted before sets were named; failed; accepted for another set.
    k = F.dayofmonth("article_day") % 4
    r = f.select("article_day", F.when(k == 2, "failed").otherwise("delivered").alias("status"), "n_sources",
                 F.when(k == 1, "").when(k == 3, "0").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return o.already_delivered(f, r).select("article_day", F.col("n_sources").alias("n"), "fingerprint", "delivered")


@query("top_links", """SELECT u AS url, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS place FROM (SELECT doc_id, concat('http://h', CAST(doc_id % 3 AS VARCHAR), '.org/', CAST(doc_id // 2 AS VARCHAR)) AS u FROM documents) QUALIFY place <= 30 AND u NOT LIKE 'http://h2%'""")
def _(spark, sf):
    return o.top_links(docs(spark, sf), ("http://h0.org/", "http://h1.org/")).select("url", "place")


@query("finalise_gate", """WITH d AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, max(ts + INTERVAL 8 HOUR) AS now, count(*) AS n FROM events GROUP BY 1) SELECT day AS article_day, n >= 15 AND hour(now) >= 22 AS release, CASE WHEN hour(now) < 22 THEN 'collect_until_22'
  WHEN n >= 15 THEN 'deadline_minimum_met' ELSE 'minimum_quality_articles_not_met' END AS release_reason FROM d""")
def _(spark, sf):
    d = v.table(spark, sf, "events").groupBy(F.to_date(F.expr("ts + INTERVAL 8 HOUR")).alias("article_day")).agg(F.max("ts").alias("now"), F.count(F.lit(1)).alias("n_docs"))
    return o.finalise_gate(d).select("article_day", "release", "release_reason")


@query("opinion_index", "SELECT CAST(ts AS DATE) AS trade_date, CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-20' THEN 1 ELSE 0 END AS revised FROM events GROUP BY 1, 2 ORDER BY 1 DESC LIMIT 25")
def _(spark, sf):
    d = v.table(spark, sf, "events").select(F.to_date("ts").alias("trade_date")).distinct()
    return o.opinion_index(d.withColumn("revised", F.lit(0)), d.filter("trade_date >= DATE '2024-01-20'").withColumn("revised", F.lit(1)))


FEED_SCORE = "CAST(2 + CASE WHEN contains(p_name, 'red') THEN 4 ELSE 0 END + CAST(v >= 100 AS INT) + CAST(v >= 500 AS INT) + CAST(v >= 1000 AS INT) + CAST(v >= 3000 AS INT) AS INT)"
FEED = f"""fd AS (SELECT concat('http://x/a/', CAST(p_partkey AS VARCHAR)) AS url, {FEED_SCORE} AS score, v AS reads, p_partkey FROM (SELECT *, p_partkey * 13 % 4000 AS v FROM part)
  WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND length(p_name) >= 6)"""


def feed(spark, sf):
    k = F.col("p_partkey")
    item = F.struct(F.when(k % 3 == 0, "2023-12-31 10:00").when(k % 2 == 0, "1704160800000").otherwise("1704160800").alias("postTime"), F.when(k % 4 == 0, "r").otherwise("A").alias("topicType"),
                    k.cast("string").alias("newTopicID"), F.col("p_name").alias("subject"), (k * 13 % 4000).cast("string").alias("viewNum"))
    pages = v.table(spark, sf, "part").select((k % 50).alias("page_no"), item.alias("i")).groupBy("page_no").agg(F.to_json(F.collect_list("i")).alias("items"))
    return o.feed_candidates(pages, "2024-01-02", "http://x/a/", ("red",))


@query("feed_candidates", f"WITH {FEED} SELECT url, score, reads FROM fd")
def _(spark, sf):
    return feed(spark, sf).select("url", "score", "reads")


@query("ranked_candidates", f"WITH {FEED} SELECT url, score, CAST(row_number() OVER (ORDER BY score DESC, reads DESC, url) AS INT) AS place FROM fd QUALIFY place <= 30")
def _(spark, sf):
    f = feed(spark, sf)
    return o.rank_candidates(f, f.withColumn("score", F.lit(3))).select("url", "score", "place")


@query("title_dates", "SELECT event_id, dayofmonth(ts) = 2 OR event_id % 3 = 0 AS ok FROM events")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("title", F.when(F.col("event_id") % 3 == 0, "明日策略9.4").otherwise(F.concat(F.lit("2024.1."), F.dayofmonth("ts").cast("string"), F.lit(" 每日复盘"))))
    return e.select("event_id", o.title_date_ok("title", "2024-01-02").alias("ok"))


_STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s*\n\s*', chr(10), 'g'), '[ \t　]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"""


def _tags(c):
    return f"regexp_replace(regexp_replace({c}, '(?is)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"


_CLEAN = "html"
for _t in ("script", "style", "nav", "footer", "form", "noscript"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', ' ', 'g')"


@query("extracted_articles", f"""WITH c AS (SELECT page_id, {_CLEAN} AS h FROM pages), x AS (SELECT page_id, {_STRIP.format(_tags("regexp_extract(h, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"))} AS title,
  {_STRIP.format(_tags("regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"))} AS art, {_STRIP.format(_tags('h'))} AS alltext FROM c)
  SELECT page_id, title, CAST(length(body) AS INT) AS body_chars, body FROM (SELECT page_id, title, CASE WHEN length(art) >= 600 THEN art ELSE alltext END AS body FROM x)
  UNION ALL SELECT -1 - page_id, title, CAST(length(concat('Anfang', chr(10), alltext)) AS INT), concat('Anfang', chr(10), alltext) FROM x WHERE page_id % 3 = 0 AND length(alltext) >= 600""")
def _(spark, sf):
    p = v.table(spark, sf, "pages").select("page_id", "html")
    # The same pages inside a single-quoted block with nested blocks, on the day asked for, on another day, and under a title of another day.
    day = F.when(F.col("page_id") % 3 == 0, "2024-09-04 10:00").otherwise("2024-09-03 10:00")
    old = F.when(F.col("page_id") % 3 == 1, "<h1>9.3复盘</h1>").otherwise("")
    n = p.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit("<html><head><meta content='"), day, F.lit("' name='pubdate'></head><body>"), old,
                 F.lit("<div id=a class='x article_content'><div>Anfang</div>"), "html", F.lit("</div></body></html>")).alias("html"))
    nested = o.extract_articles(n, day="2024-09-04").filter("body_chars >= 607")
    return o.extract_articles(p).unionByName(nested).select("page_id", "title", "body_chars", "body")


# A document mentions the boards whose name is one of its words; a full stop or a comma behind it gives the stance.
CONS = NAMED + """, mm AS (SELECT doc_id, board AS sector, CASE WHEN contains(text, concat(called, '.')) THEN '退潮' WHEN contains(text, concat(called, ',')) THEN '分歧' ELSE '加强' END AS stance
   FROM documents d JOIN nm ON list_contains(regexp_extract_all(text, '[A-Za-z]+'), called)),
 co AS (SELECT sector, count(DISTINCT doc_id) AS mention_count FROM mm GROUP BY 1), md AS (SELECT sector, stance, count(*) AS n FROM mm GROUP BY 1, 2),
 cs AS (SELECT co.*, (SELECT arg_max(stance, (n, stance)) FROM md WHERE md.sector = co.sector) AS stance FROM co)"""


def mined_sectors(spark, sf):
    names, d = named_boards(spark, sf), v.table(spark, sf, "documents").select("doc_id", "text")
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("called"))
    x = words.join(names, "called").join(d, "doc_id")
    follows = lambda sign: F.contains("text", F.concat("called", F.lit(sign)))
    stance = F.when(follows("."), "退潮").when(follows(","), "分歧").otherwise("加强")
    return x.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("board").alias("name"), stance.alias("stance"))).alias("sectors"))


@query("opinion_consensus", f"WITH {CONS} SELECT * FROM cs")
def _(spark, sf):
    return o.consensus(mined_sectors(spark, sf))


@query("stock_consensus", f"WITH {CONS} SELECT sector AS stock, count(DISTINCT doc_id) AS mention_count, array_to_string(list_sort(list(DISTINCT stance)), '|') AS roles FROM mm GROUP BY 1")
def _(spark, sf):
    m = mined_sectors(spark, sf).select("doc_id", F.transform("sectors", lambda x: F.struct(x["name"].alias("name"), x["stance"].alias("role"))).alias("stocks"))
    return o.stock_consensus(m).withColumn("roles", F.array_join("roles", "|"))


@query("stance_groups", f"WITH {CONS} SELECT sector, CASE stance WHEN '退潮' THEN '退潮或走弱' WHEN '加强' THEN '观点偏强或加强' ELSE '活跃但分化' END AS \"group\" FROM (SELECT * FROM cs ORDER BY mention_count DESC, sector LIMIT 10)")
def _(spark, sf):
    return o.stance_groups(o.consensus(mined_sectors(spark, sf))).select("sector", "group")


@query("json_answers", """SELECT p_partkey, CASE WHEN p_partkey % 7 < 4 THEN p_name END AS name, CASE WHEN p_partkey % 7 < 4 THEN p_size END AS size FROM part""")
def _(spark, sf):
    """Answers as models write them: plain, fenced, between words, with braces of their own; a list, an open brace, and words alone are none."""
    k, j = F.col("p_partkey") % 7, F.to_json(F.struct("p_name", "p_size"))
    text = (F.when(k == 0, j).when(k == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), j, F.lit(" done.")))
            .when(k == 3, F.concat(F.lit("  ```\n"), j, F.lit("```  "))).when(k == 4, F.concat(F.lit("["), j, F.lit("]"), F.lit(","), j)).when(k == 5, F.concat(F.lit("open {"), F.substring(j, 2, 5))).otherwise(F.col("p_name")))
    x = v.table(spark, sf, "part").select("p_partkey", F.from_json(json_object_text(text), "p_name string, p_size int").alias("o"))
    return x.select("p_partkey", F.col("o.p_name").alias("name"), F.col("o.p_size").alias("size"))
