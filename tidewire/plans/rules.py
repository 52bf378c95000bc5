"""Functions, ingest rules and state updates over the test tables, with the same queries as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import keywords as K
from tidewire.functions import text as T
from tidewire.functions import urls as U
from tidewire.operators import ingest as I
from tidewire.operators import listing as L
from tidewire.operators import state as S
from tidewire.plans.registry import query
from tidewire.plans.stand_ins import NOW, STORIES, articles, sources, table
from tidewire.sources.apis import json_field as json_field_of
from tidewire.streaming import jobs as stream

TOPICS = [
    K.Topic("ing", "Ing", ("the", "ing*", "ntion*"), min_score=4),
    K.Topic("der", "Der", ("der", "und", "ein*"), min_score=3),
    K.Topic("la", "La", ("la", "de la", "que"), min_score=3),
    K.Topic("en", "en", ("nothing here",)),
    K.Topic("rest", "Rest", ("zzz",), fallback=True),
    K.Topic("given", "Given"),
]


def _score_sql(topic: K.Topic) -> str:
    terms = []
    for k in topic.keywords:
        p = K.pattern(k).replace("'", "''")
        terms.append(f"CASE WHEN regexp_matches(t, '{p}') THEN 3 WHEN regexp_matches(s, '{p}') THEN 2 WHEN regexp_matches(i, '{p}') THEN 1 ELSE 0 END")
    return " + ".join(terms)


_FOLD = "replace(strip_accents(lower(coalesce({}, ''))), 'ß', 's')"
_TEXTS = f"SELECT id, {_FOLD.format('title')} AS t, {_FOLD.format('intro')} AS i, section || ' ' || replace(source_id || '', '-', ' ') AS s0, section || '  src' || source_id || ' ' || id AS s FROM articles"


@query("keyword_score", f"{STORIES}, x AS ({_TEXTS}) SELECT id, {', '.join(f'CAST({_score_sql(t)} AS INT) AS {t.slug}_score' for t in TOPICS[:3])} FROM x")
def keyword_score(spark, d):
    a = articles(spark, d)
    scores = a.select("id", K.topic_scores(TOPICS[:3], F.col("title"), F.concat_ws(" ", "section", U.url_words(F.col("url"))), F.col("intro")).alias("n"))
    return scores.select("id", *(F.col("n")[k].alias(f"{t.slug}_score") for k, t in enumerate(TOPICS[:3])))


#: Words of a rule's own making, some with any ending, some in two parts: as many keywords as a site's whole configuration has.
MANY = [K.Topic(f"t{t}", f"T{t}", tuple(f"{a}{b}{'*' * (k % 4 == 0)}" if k % 5 else f"{b} {a}" for k, (a, b) in enumerate((x, y) for x in ("th", "in", "er", "an", "on", "de", "la") for y in ("", "e", "es", "tion", "at", "ha", "nd", "er")))) for t in range(7)]


@query("keyword_totals", f"""{STORIES}, k AS (SELECT DISTINCT a, b, k FROM (VALUES {", ".join(f"('{a}', '{b}', {k})" for k, (a, b) in enumerate((x, y) for x in ("th", "in", "er", "an", "on", "de", "la") for y in ("", "e", "es", "tion", "at", "ha", "nd", "er")))}) AS v(a, b, k)),
p AS (SELECT k, CASE WHEN k % 5 > 0 THEN '\\b' || a || b || CASE WHEN k % 4 = 0 THEN '[a-z0-9_]*' ELSE '\\b' END WHEN b = '' THEN '\\b' || a || '\\b' ELSE '\\b' || b || '[ \\t-]+' || a || '\\b' END AS re FROM k),
x AS (SELECT id, {_FOLD.format("title")} AS t, {_FOLD.format("intro")} AS i FROM articles WHERE regexp_full_match(coalesce(title, '') || coalesce(intro, ''), '[\\x00-\\x7f]*'))
SELECT id, CAST(7 * sum(CASE WHEN regexp_matches(t, re) THEN 3 WHEN regexp_matches(i, re) THEN 1 ELSE 0 END) AS BIGINT) AS total FROM x, p GROUP BY id""")
def keyword_totals(spark, d):
    """Nearly four hundred keywords over the titles and intros of stories in plain letters, found in one pass."""
    plain = articles(spark, d).where(F.concat(F.coalesce("title", F.lit("")), F.coalesce("intro", F.lit(""))).rlike(r"^[\x00-\x7f]*$"))
    scores = K.topic_scores(MANY, F.col("title"), F.lit(None).cast("string"), F.col("intro"))
    return plain.select("id", F.aggregate(scores, F.lit(0).cast("long"), lambda a, n: a + n).alias("total"))


@query(
    "classify",
    f"""{STORIES}, x AS ({_TEXTS}), y AS (SELECT id, list_filter([CASE WHEN {_score_sql(TOPICS[0])} >= 4 THEN 'ing' END, CASE WHEN {_score_sql(TOPICS[1])} >= 3 THEN 'der' END, CASE WHEN {_score_sql(TOPICS[2])} >= 3 THEN 'la' END,
CASE WHEN regexp_matches(s, '\\ben\\b') THEN 'en' END], lambda c: c IS NOT NULL) AS found FROM x) SELECT id, CASE WHEN len(found) = 0 THEN 'rest' ELSE array_to_string(found, ',') END AS topics FROM y""",
)
def classify(spark, d):
    topics = K.classify(TOPICS, F.col("title"), F.col("intro"), F.col("section"), F.lit(None).cast("string"), F.col("url"))
    return articles(spark, d).select("id", F.array_join(topics, ",").alias("topics"))


@query("accent_fold", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def accent_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("unaccent_like", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'ence')")
def unaccent_like(spark, d):
    return table(spark, d, "documents").where(T.contains_plain(F.col("text"), "énce")).select("doc_id")


@query("like_escape", r"SELECT doc_id, replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM documents")
def like_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.like_escape(F.col("text")).alias("escaped"))


@query(
    "truncate",
    """WITH h AS (SELECT doc_id, text, text[:120] AS head FROM documents WHERE length(text) > 0), e AS (SELECT *, greatest(CASE WHEN contains(head, '. ') THEN 120 - strpos(reverse(head), ' .') ELSE 0 END, CASE WHEN contains(head, '." ') THEN 119 - strpos(reverse(head), ' ".') ELSE 0 END, CASE WHEN contains(head, '? ') THEN 120 - strpos(reverse(head), ' ?') ELSE 0 END, CASE WHEN contains(head, '! ') THEN 120 - strpos(reverse(head), ' !') ELSE 0 END) AS fin FROM h)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN fin - 1 >= 72 THEN rtrim(head[:fin]) ELSE rtrim(CASE WHEN contains(head, ' ') THEN head[:120 - strpos(reverse(head), ' ')] ELSE head END, ' ,;:-–—') || '…' END AS short FROM e""",
)
def truncate(spark, d):
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", T.truncate(F.col("text"), 120).alias("short"))


@query("url_host", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '[^.]+\.[^.]+$') AS site FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", U.host_of(F.col("url")).alias("host"), U.site_of(F.col("url")).alias("site"))


@query(
    "url_normalize",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT regexp_matches(lower(x), '^(fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref_src|cmpid|ocid|amp|outputtype|_ga|s_cid)='))) AS kept FROM p)
SELECT page_id, scheme || '://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/{2,}', '/', 'g') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k""",
)
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query("url_match_key", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '/+(\?|$)', '\1') AS key FROM pages")
def url_match_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.match_key(F.col("url")).alias("key"))


@query("first_wins_dedupe", f"{STORIES} SELECT title, min(id) AS id FROM articles GROUP BY 1")
def first_wins_dedupe(spark, d):
    from tidewire.sources.pages import merged_candidates

    found = articles(spark, d).select(F.col("title").alias("key"), "id", F.col("id").alias("pos"), "url", "title", F.lit("feed").alias("via"))
    return merged_candidates(found).select(F.col("key").alias("title"), "id")


@query("per_source_cap", f"{STORIES} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN id % 4 > 0 THEN published_at END DESC NULLS LAST, id) AS k FROM articles) WHERE k <= 10")
def per_source_cap(spark, d):
    found = articles(spark, d).select("id", "source_id", F.col("id").alias("pos"), F.col("url").alias("key"), F.when(F.col("id") % 4 > 0, F.col("published_at")).alias("published_at"))
    return I.capped(found, 10)[0].select("id")


_SEEN = "SELECT 'u' || event_id AS url, CASE WHEN event_id % 5 = 0 THEN 'rejected' ELSE 'failed' END AS status, CAST(1 + event_id % 6 AS INT) AS attempts, ts AS last_attempt_at FROM events"


def _seen(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select(F.concat(F.lit("u"), k.cast("string")).alias("url"), F.lit(1).alias("source_id"), F.when(k % 5 == 0, "rejected").otherwise("failed").alias("status"), F.lit("why").alias("reason"), (1 + k % 6).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("first_seen_at"), F.col("ts").cast("timestamp").alias("last_attempt_at"))


_CLOCK = "(SELECT max(ts) FROM events)"


def _clock(spark, d) -> dt.datetime:
    return table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).first()["t"]


@query("backoff_due", f"WITH s AS ({_SEEN}) SELECT url FROM s WHERE status = 'failed' AND attempts < 5 AND last_attempt_at + to_hours(CAST(2 ** (attempts - 1) AS INT)) <= {_CLOCK}")
def backoff_due(spark, d):
    return I.retries(_seen(spark, d), _clock(spark, d)).select("url")


@query("filter_new", f"WITH s AS ({_SEEN}), w AS (SELECT url FROM s WHERE status = 'rejected' OR attempts >= 5 OR last_attempt_at + to_hours(CAST(2 ** (attempts - 1) AS INT)) > {_CLOCK}) SELECT 'u' || doc_id AS key FROM documents WHERE doc_id % 3 > 0 AND 'u' || doc_id NOT IN (SELECT url FROM w)")
def filter_new(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("key"), F.col("doc_id").alias("pos"))
    known = docs.where("pos % 3 = 0").select(F.col("key").alias("url"), F.lit(None).cast("string").alias("discovered_url"))
    return I.filter_new(docs, known, _seen(spark, d), _clock(spark, d)).select("key")


@query(
    "remembered",
    f"""WITH s AS ({_SEEN}), e AS (SELECT 'u' || doc_id * 2 AS url, ['ok', 'failed', 'rejected', 'throttled'][1 + doc_id % 4] AS status FROM documents UNION ALL SELECT 'u' || doc_id * 2, 'rejected' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'u' || doc_id * 2, 'failed' FROM documents WHERE doc_id % 3 = 0),
o AS (SELECT url, max(CASE status WHEN 'rejected' THEN 2 WHEN 'throttled' THEN 0 ELSE 1 END) AS w, sum(CASE WHEN status = 'throttled' THEN 0 ELSE 1 END) AS k, bool_or(status = 'ok') AS stored FROM e GROUP BY 1)
SELECT coalesce(s.url, o.url) AS url, CASE w WHEN 2 THEN 'rejected' WHEN 1 THEN 'failed' ELSE s.status END AS status, CAST(coalesce(s.attempts, 0) + coalesce(k, 0) AS INT) AS attempts FROM s FULL JOIN o ON s.url = o.url WHERE NOT coalesce(stored, false) AND (s.url IS NOT NULL OR k > 0)""",
)
def remembered(spark, d):
    k = F.col("doc_id")
    out = table(spark, d, "documents").select(F.concat(F.lit("u"), (k * 2).cast("string")).alias("url"), F.lit(1).alias("source_id"), F.get(F.array(F.lit("ok"), F.lit("failed"), F.lit("rejected"), F.lit("throttled")), (k % 4).cast("int")).alias("status"), F.lit("why").alias("reason"))
    more = out.where("cast(substring(url, 2) as long) % 8 = 0").withColumn("status", F.lit("rejected")).unionByName(out.where("cast(substring(url, 2) as long) % 6 = 0").withColumn("status", F.lit("failed")))
    return S.remembered(_seen(spark, d), out.unionByName(more), NOW).select("url", "status", "attempts")


@query("retention", f"WITH s AS ({_SEEN}) SELECT url FROM s WHERE last_attempt_at >= {_CLOCK} - INTERVAL 9 DAY")
def retention(spark, d):
    seen = _seen(spark, d)
    return S.retained(seen.withColumn("started_at", F.col("last_attempt_at")), seen, _clock(spark, d), seen_days=9)[1].select("url")


@query(
    "reused_images",
    f"""{STORIES}, n AS (SELECT source_id, image_url, count(*) AS k FROM articles WHERE id % 4 = 0 AND image_url IS NOT NULL GROUP BY 1, 2), o AS (SELECT source_id, image_url, count(*) AS c FROM articles WHERE id % 4 > 0 AND published_at >= TIMESTAMP '2023-12-03 12:00:00' GROUP BY 1, 2)
SELECT n.source_id, n.image_url FROM n LEFT JOIN o ON n.source_id = o.source_id AND n.image_url = o.image_url WHERE coalesce(c, 0) + k - 1 >= 2""",
)
def reused_images(spark, d):
    a = articles(spark, d)
    none = spark.createDataFrame([], "url string, source_id int, created_at timestamp")
    return I.reused_images(a.where("id % 4 > 0"), a.where("id % 4 = 0"), none, NOW)


@query("running_image_rule", f"{STORIES} SELECT id, count(*) OVER (PARTITION BY source_id, image_url ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM articles WHERE image_url IS NOT NULL")
def running_image_rule(spark, d):
    return I.earlier_uses(articles(spark, d)).select("id", "earlier")


@query("upsert", "SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 'last ' || n_chars ELSE 'old' END AS value FROM documents WHERE doc_id % 3 > 0 OR doc_id % 2 = 0")
def upsert(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("key"), F.lit("old").alias("value"))
    new = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.concat(F.lit("last "), F.col("n_chars").cast("string")).alias("value"), F.lit(2).alias("at"))
    return S.upserted(old, new.withColumns({"value": F.lit("first"), "at": F.lit(1)}).union(new).union(new), "key", F.col("at"))


@query("config_sync", f"{STORIES} SELECT slug, CASE WHEN id % 3 = 0 THEN name ELSE name || '!' END AS name, id % 3 > 0 AND enabled AS enabled FROM sources WHERE slug <> 'silent'")
def config_sync(spark, d):
    stored = sources(spark, d).where("slug <> 'silent'").select("id", "slug", "name", "enabled")
    return S.synced(stored, stored.where("id % 3 > 0").select("slug", F.concat("name", F.lit("!")).alias("name"), "enabled")).select("slug", "name", "enabled")


@query("changed_pages", "SELECT page_id, sha256(html) AS content_hash FROM pages WHERE page_id % 4 > 0")
def changed_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.col("html").alias("content"), F.when(F.col("page_id") % 8 == 0, 304).otherwise(200).alias("http_status"))
    keyed = pages.withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    cached = pages.where("page_id % 4 = 0").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.sha2("content", 256).alias("content_hash"))
    return S.changed_pages(keyed, cached).select("page_id", "content_hash")


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string('{\"a\": ' || props || '}', '$.a.k') AS deep FROM events")
def json_field(spark, d):
    nested = F.concat(F.lit('{"a": '), F.col("props"), F.lit("}"))
    return table(spark, d, "events").select("event_id", json_field_of(F.col("props"), "$.k").alias("k"), json_field_of(nested, "$.a.k").alias("deep"))


@query("tumbling_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return stream.tumbling_counts(table(spark, d, "events"))


@query(
    "sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("archive_rollup", "SELECT CAST(y AS VARCHAR) AS y, CAST(m AS VARCHAR) AS m, count(*) AS n, max(ts) AS newest FROM (SELECT year(ts + INTERVAL 10 HOUR) AS y, month(ts + INTERVAL 10 HOUR) AS m, ts FROM events) GROUP BY ROLLUP (y, m)")
def archive_rollup(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return L.archive_rollup(e, "ts").withColumns({"y": F.col("y").cast("string"), "m": F.col("m").cast("string")})
