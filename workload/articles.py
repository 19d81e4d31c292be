"""Sources, cleaning, prices and alignment over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerpress import schemas
from tickerpress.functions import dates as dt
from tickerpress.functions import text as tx
from tickerpress.operators import alignment as al
from tickerpress.operators import cleaning as cl
from tickerpress.operators import extraction as ex
from tickerpress.operators import near_duplicates as nd
from tickerpress.operators import prices as pr
from tickerpress.plans import harvest as hv
from tickerpress.session import scratch_path
from tickerpress.sources import hits as hs
from tickerpress.sources import tables as tb
from workload import views as v

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


# -- sources and sinks ---------------------------------------------------------

@query("s1_read_table", "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate "
                        "FROM orders")
def s1(spark, d):
    typed = tb.read_table(spark, f"{d}/orders.parquet",
                          "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz")
    return typed.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("s1_csv_round_trip", v.ctes("rate") + "SELECT series_id, obs_date, level FROM rate")
def s1_csv(spark, d):
    path = scratch_path(spark, "rate-csv")
    tb.write_table(v.rate(spark, d), path, "csv", sort_by=["obs_date"])
    return tb.read_table(spark, path, schemas.RATE, "csv")


@query("s2_write_table", v.ctes("rate_multi") + "SELECT series_id, obs_date, level FROM rate_multi")
def s2(spark, d):
    path = scratch_path(spark, "rate-by-series")
    tb.write_table(v.rate_multi(spark, d).withColumn("part", F.col("series_id")), path,
                   partition_by=["part"], sort_by=["obs_date"])
    return tb.read_table(spark, path, schemas.RATE, "parquet").drop("part")


def _hit_pages(spark, d):
    e = v.table(spark, d, "events")
    page = F.concat(
        F.lit('{"results":[{"datePublished":"'), F.date_format("ts", "yyyy-MM-dd"),
        F.lit('","cn:type":"'), F.col("event_type"), F.lit('","cn:title":"t'),
        F.col("event_id").cast("string"), F.lit('","url":"u'),
        (F.col("event_id") % 900).cast("string"), F.lit('"},'), F.col("props"), F.lit("]}"))
    return e.select("event_id", page.alias("page"))


_HITS = """
    SELECT event_id, 0 AS position, strftime(ts, '%Y-%m-%d') AS published,
           event_type AS media_type, 't' || event_id AS title, 'u' || (event_id % 900) AS url
    FROM events
    UNION ALL
    SELECT event_id, 1, coalesce(json_extract_string(props, '$.datePublished'), ''),
           coalesce(json_extract_string(props, '$.type'), ''),
           coalesce(json_extract_string(props, '$.title'), ''),
           coalesce(json_extract_string(props, '$.url'), '') FROM events"""


@query("s3_flatten_hits", _HITS)
def s3(spark, d):
    return hs.flatten_hits(_hit_pages(spark, d), "page", keep=["event_id"])


@query("s4_write_json", v.ctes("rate_multi") + f"""
    SELECT series_id, count(*) AS n, {v.r('max(level)', 2)} AS top FROM rate_multi GROUP BY 1""")
def s4(spark, d):
    path = scratch_path(spark, "params-json")
    top = v.rate_multi(spark, d).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("level").alias("top"))
    tb.write_json(top, path)
    return tb.read_table(spark, path, "series_id string, n bigint, top double", "json")


@query("s5_hand_off", v.ctes("aligned") + """
    SELECT coalesce(adjusted_date, obs_date) AS adjusted_date, ingest_id, level
    FROM aligned FULL JOIN rate ON adjusted_date = obs_date""")
def s5(spark, d):
    path = scratch_path(spark, "hand-off")
    rates = v.rate(spark, d)
    calendar = al.trading_calendar(rates)
    aligned = al.align_to_calendar(v.news(spark, d), calendar).select("ingest_id", "adjusted_date")
    tb.hand_off(aligned, rates.select("obs_date", "level"), path)
    articles, back = tb.read_hand_off(spark, path, "ingest_id bigint, adjusted_date date", "obs_date date, level double")
    return articles.join(back.withColumnRenamed("obs_date", "adjusted_date"), "adjusted_date", "full")


# -- cleaning ------------------------------------------------------------------

@query("c1_date_floor", v.ctes("news") + "SELECT ingest_id, published_at FROM news "
                        "WHERE published_at >= TIMESTAMP '1997-06-01'")
def c1(spark, d):
    return cl.date_floor(v.news(spark, d), "published_at", "1997-06-01").select(
        "ingest_id", "published_at")


@query("c2_exclude_types", v.ctes("news_dirty") + """
    SELECT ingest_id, media_type FROM news_dirty
    WHERE NOT regexp_matches(lower(media_type), 'video|live')""")
def c2(spark, d):
    return cl.exclude_types(v.news_dirty(spark, d), "media_type").select("ingest_id", "media_type")


@query("c3_merge_hits", f"""
    WITH kinds AS (SELECT * FROM (VALUES ('error', 0), ('click', 1), ('', 2)) k(kind, query_no)),
    hits AS (SELECT query_no, event_id AS ingest_id, 'u' || (event_id % 900) AS url, event_type
             FROM events JOIN kinds ON (kind = event_type)
                  OR (kind = '' AND event_type NOT IN ('error', 'click')))
    SELECT ingest_id, url, event_type, query_no, 'wire' AS source FROM hits
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_no, ingest_id) = 1""")
def c3(spark, d):
    e = v.table(spark, d, "events").select(
        F.col("event_id").alias("ingest_id"), "event_type",
        F.concat(F.lit("u"), (F.col("event_id") % 900).cast("string")).alias("url"))
    kind = F.col("event_type")
    searches = [e.where(kind == "error"), e.where(kind == "click"),
                e.where(~kind.isin("error", "click"))]
    return cl.merge_hits(searches, "url", ["ingest_id"], source="wire")


_BODIES = """cut AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article', 1) AS a,
                        regexp_matches(html, '(?i)<article') AS has_body FROM pages),
    plain AS (SELECT page_id, has_body, regexp_replace(regexp_replace(a,
                '(?is)<script.*?</script\\s*>|<style.*?</style\\s*>|<!--.*?-->', '', 'g'),
                '(?i)<p(\\s[^>]*)?>', chr(1), 'g') AS a FROM cut),
    pars AS (SELECT page_id, has_body, list_transform(string_split(a, chr(1))[2:], lambda p:
        regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
            regexp_replace(regexp_replace(p, '(?is)</p\\s*>.*', ''), '(?s)<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''),
            '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
        '^\\s+|\\s+$', '', 'g')) AS ps FROM plain)"""


@query("c4_extract_body", f"""
    WITH {_BODIES}
    SELECT page_id, CASE WHEN has_body THEN array_to_string(ps, ' ')
                    ELSE 'No full text available (Video/Live Blog)' END AS full_text FROM pars""")
def c4(spark, d):
    pages = tb.spread(v.table(spark, d, "pages").select("page_id", "html"), "page_id")
    return ex.extract_body(pages, "html", tag="article", css_class=None)


@query("c5_drop_missing", v.ctes("news_dirty") + """
    SELECT ingest_id, url FROM news_dirty WHERE full_text IS NOT NULL AND title IS NOT NULL""")
def c5(spark, d):
    return cl.drop_missing(v.news_dirty(spark, d), ["title", "full_text"]).select("ingest_id", "url")


_DEDUPED = """deduped AS (SELECT * FROM news_dirty WHERE full_text IS NOT NULL AND full_text <> ''
    QUALIFY row_number() OVER (PARTITION BY full_text ORDER BY ingest_id) = 1)"""
_STRIPPED = """stripped AS (SELECT * EXCLUDE (full_text), regexp_replace(regexp_replace(full_text,
    '^In this article\\s*', ''), '^\\s+|\\s+$', '', 'g') AS full_text FROM deduped)"""


@query("c6_exact_dedupe", v.ctes("news_dirty", tail=_DEDUPED) + "SELECT ingest_id, url FROM deduped")
def c6(spark, d):
    kept = cl.drop_missing(v.news_dirty(spark, d), ["full_text"], empty_is_missing=True)
    return cl.exact_dedupe(kept, "full_text", "ingest_id").select("ingest_id", "url")


@query("c7_strip_boilerplate", v.ctes("news_dirty") + """
    SELECT ingest_id, regexp_replace(regexp_replace(full_text, '^In this article\\s*', ''),
           '^\\s+|\\s+$', '', 'g') AS full_text FROM news_dirty""")
def c7(spark, d):
    return cl.strip_boilerplate(v.news_dirty(spark, d).select("ingest_id", "full_text"), "full_text")


@query("c8_min_words", v.ctes("news_dirty") + """
    SELECT ingest_id, len(regexp_extract_all(full_text, '\\S+')) AS n_words FROM news_dirty
    WHERE len(regexp_extract_all(full_text, '\\S+')) >= 30""")
def c8(spark, d):
    kept = cl.min_words(v.news_dirty(spark, d), "full_text")
    return kept.select("ingest_id", tx.word_count(F.col("full_text")).cast("bigint").alias("n_words"))


def near_dup_ctes(stop_words, max_features, threshold, documents="documents"):
    """``near(j)``: the later ids of all near pairs of ``documents`` (doc_id, text)."""
    return f"""
    tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))
                 AS term FROM {documents}),
    cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({v.sql_list(stop_words)})
            GROUP BY 1, 2),
    voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM cnt GROUP BY 1
            ORDER BY total DESC, term LIMIT {max_features}),
    raw AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM {documents}))
                / (1.0 + df)) + 1) AS w FROM cnt JOIN voc USING (term)),
    wts AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
    near AS (SELECT DISTINCT j FROM (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS c
        FROM wts a JOIN wts b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
        WHERE c > CAST({threshold} AS DOUBLE))"""


@query("c9_near_duplicates", "WITH " + near_dup_ctes(v.STOP_WORDS, 5000, 0.9) + """
    SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT j FROM near)""")
def c9(spark, d):
    docs = tb.spread(v.table(spark, d, "documents"), "doc_id")
    return nd.drop_near_duplicates(docs, "doc_id", "text", stop_words=v.STOP_WORDS).select(
        "doc_id", "n_chars")


@query("c10_strip_links", v.ctes("news_dirty") + """
    SELECT ingest_id, trim(regexp_replace(regexp_replace(full_text,
        'https?://\\S+|www\\.\\S+', '', 'g'), '\\s+', ' ', 'g')) AS full_text FROM news_dirty""")
def c10(spark, d):
    return cl.strip_links(v.news_dirty(spark, d).select("ingest_id", "full_text"), "full_text")


@query("c11_cleaning_report", v.ctes("news_dirty", tail=_DEDUPED + ", " + _STRIPPED) + """
    SELECT 1 AS step_no, 'start' AS step, (SELECT count(*) FROM news_dirty) AS n_rows
    UNION ALL SELECT 2, 'drop_missing', (SELECT count(*) FROM news_dirty WHERE full_text <> '')
    UNION ALL SELECT 3, 'exact_dedupe', (SELECT count(*) FROM deduped)
    UNION ALL SELECT 4, 'min_words', (SELECT count(*) FROM stripped
        WHERE len(regexp_extract_all(full_text, '\\S+')) >= 30)""")
def c11(spark, d):
    return cl.cleaning_report(v.news_dirty(spark, d), "full_text")


@query("c11_report_with_near_step", v.ctes("news_dirty", tail=_DEDUPED + ", " + _STRIPPED + """,
    long_enough AS (SELECT ingest_id AS doc_id, full_text AS text FROM stripped
                    WHERE len(regexp_extract_all(full_text, '\\S+')) >= 30), """
    + near_dup_ctes(v.STOP_WORDS, 5000, 0.9, "long_enough")) + """
    SELECT 1 AS step_no, 'start' AS step, (SELECT count(*) FROM news_dirty) AS n_rows
    UNION ALL SELECT 2, 'drop_missing', (SELECT count(*) FROM news_dirty WHERE full_text <> '')
    UNION ALL SELECT 3, 'exact_dedupe', (SELECT count(*) FROM deduped)
    UNION ALL SELECT 4, 'min_words', (SELECT count(*) FROM long_enough)
    UNION ALL SELECT 5, 'near_duplicates', (SELECT count(*) FROM long_enough
        WHERE doc_id NOT IN (SELECT j FROM near))""")
def c11_near(spark, d):
    return cl.cleaning_report(v.news_dirty(spark, d), "full_text", near_order="ingest_id", stop_words=v.STOP_WORDS)


@query("clean_articles", v.ctes("news_dirty", tail=_DEDUPED + ", " + _STRIPPED) + """
    SELECT ingest_id, full_text FROM stripped
    WHERE len(regexp_extract_all(full_text, '\\S+')) >= 30""")
def clean(spark, d):
    return cl.clean_articles(v.news_dirty(spark, d), "full_text", "ingest_id").select(
        "ingest_id", "full_text")


# -- prices --------------------------------------------------------------------

@query("r1_project_rename", "SELECT o_orderdate AS obs_date, o_totalprice AS level FROM orders")
def r1(spark, d):
    return pr.project_rename(v.table(spark, d, "orders"),
                             {"o_orderdate": "obs_date", "o_totalprice": "level"})


def _mixed_dates(spark, d):
    o = v.table(spark, d, "orders")
    day, i = F.col("o_orderdate"), F.col("o_orderkey")
    text = (F.when(i % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
            .when(i % 4 == 1, F.date_format(day, "M/d/yyyy h:mm:ss a"))
            .when(i % 4 == 2, F.date_format(day, "dd/MM/yyyy")).otherwise("not a date"))
    return o.select("o_orderkey", text.alias("Tanggal"), "o_totalprice")


@query("r2_parse_dates", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS obs_date
    FROM orders""")
def r2(spark, d):
    named = pr.project_rename(_mixed_dates(spark, d),
                              {"o_orderkey": "o_orderkey", "Tanggal": "obs_date"})
    return pr.normalise_dates(named, "obs_date")


@query("r3_sort_by_date", v.ctes("rate") + "SELECT obs_date, level FROM rate ORDER BY obs_date")
def r3(spark, d):
    return pr.sort_by_date(v.rate(spark, d).select("obs_date", "level"), "obs_date")


@query("normalise_rates", """
    SELECT CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS obs_date,
           o_totalprice AS level FROM orders""")
def rates(spark, d):
    return pr.normalise_rates(_mixed_dates(spark, d),
                              {"Tanggal": "obs_date", "o_totalprice": "level"})


# -- alignment -----------------------------------------------------------------

def aligned(spark, d):
    return al.align_to_calendar(v.news(spark, d), al.trading_calendar(v.rate(spark, d)))


@query("t1_trading_calendar", v.ctes("rate") + "SELECT DISTINCT obs_date AS session FROM rate")
def t1(spark, d):
    return al.trading_calendar(v.rate(spark, d))


@query("t2_market_time", v.ctes("news") + f"""
    SELECT ingest_id, published_at + {v.ZONE_SHIFT} AS local_time FROM news""")
def t2(spark, d):
    n = v.news(spark, d)
    return n.select("ingest_id", dt.to_market_time(n, "published_at").alias("local_time"))


@query("t3_after_close", v.ctes("news") + f"""
    SELECT ingest_id, CAST(published_at + {v.ZONE_SHIFT} AS DATE)
        + (CASE WHEN hour(published_at + {v.ZONE_SHIFT}) >= 15 THEN 1 ELSE 0 END) AS news_day
    FROM news""")
def t3(spark, d):
    n = v.news(spark, d)
    local = dt.to_market_time(n, "published_at")
    return n.select("ingest_id", dt.shift_after_close(local).alias("news_day"))


@query("t4_forward_asof", v.ctes("rate") + """
    , calendar AS (SELECT DISTINCT obs_date AS session FROM rate
                   WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
    days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS news_day FROM orders)
    SELECT o_orderkey, news_day, coalesce(session, news_day + (CASE dayofweek(news_day)
        WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END)) AS adjusted_date
    FROM days ASOF LEFT JOIN calendar ON news_day <= session""")
def t4(spark, d):
    days = v.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("news_day"))
    calendar = al.trading_calendar(v.rate(spark, d)).where(
        "session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
    return al.forward_asof(days, "news_day", calendar)


@query("t5_weekend_roll", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) + (CASE dayofweek(o_orderdate)
        WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END) AS rolled FROM orders""")
def t5(spark, d):
    return v.table(spark, d, "orders").select(
        "o_orderkey", dt.roll_weekend(F.to_date("o_orderdate")).alias("rolled"))


@query("t6_align_to_calendar", v.ctes("aligned") + """
    SELECT ingest_id, source, title, url, published_at, full_text, adjusted_date FROM aligned""")
def t6(spark, d):
    return aligned(spark, d)


@query("t7_publication_hours", v.ctes("news") + f"""
    , h AS (SELECT hour(published_at + {v.ZONE_SHIFT})
                   + minute(published_at + {v.ZONE_SHIFT}) / CAST(60 AS DOUBLE) AS x FROM news),
    e AS (SELECT min(x) AS lo, max(x) AS hi FROM h)
    SELECT CAST(least(floor((x - lo) / ((hi - lo) / CAST(48 AS DOUBLE))), 47) AS INTEGER) AS bin,
           count(*) AS n_articles FROM h, e GROUP BY 1""")
def t7(spark, d):
    return al.publication_hours(v.news(spark, d), "published_at")


@query("t8_hour_band_share", v.ctes("news") + f"""
    SELECT {v.r(f'avg(CASE WHEN hour(published_at + {v.ZONE_SHIFT}) BETWEEN 9 AND 14 THEN 1.0 ELSE 0.0 END)')}
           AS share FROM news""")
def t8(spark, d):
    return v.rounded(al.hour_band_share(v.news(spark, d), "published_at"))


# -- harvest -------------------------------------------------------------------

def _searches(spark, d):
    """Two searches over the pages, one hit a page; every third page is found by both."""
    pages = v.table(spark, d, "pages").select(F.col("page_id").alias("page_no"), "url")
    dates = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_no"), "o_orderdate")
    i = F.col("page_no")
    seconds = (i * 7919 % 86400).cast("int")
    at = F.date_format(F.col("o_orderdate") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.when(i % 2 == 0, "+0700").otherwise("Z")

    def search(number, rows):
        kind = F.when(i % 10 == 0, "Video").otherwise("article")
        return rows.select("page_no", F.to_json(F.struct(F.array(F.struct(
            F.concat(at, offset).alias("datePublished"), kind.alias("cn:type"),
            F.concat(F.lit(f"search {number} page "), i.cast("string")).alias("cn:title"), "url")).alias("results"))
            ).alias("page"))

    found = pages.join(dates, "page_no")
    return [search(0, found.where(i % 3 > 0)), search(1, found.where(i % 3 < 2))]


@query("harvest_to_articles", v.ctes("rate") + f"""
    , hits AS (
        SELECT page_id, url, q, o_orderdate + to_seconds(page_id * 7919 % 86400)
               - (CASE WHEN page_id % 2 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END) AS published_at,
               strftime(o_orderdate + to_seconds(page_id * 7919 % 86400), '%Y-%m-%dT%H:%M:%S') AS published
        FROM pages JOIN orders ON o_orderkey = page_id, (VALUES (0), (1)) s(q)
        WHERE page_id % 10 <> 0 AND (CASE WHEN q = 0 THEN page_id % 3 > 0 ELSE page_id % 3 < 2 END)),
    kept AS (SELECT * FROM hits WHERE published >= '1996-03-01'
             QUALIFY row_number() OVER (PARTITION BY url ORDER BY q, page_id) = 1),
    first_page AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
    {_BODIES},
    texts AS (SELECT kept.*, array_to_string(ps, ' ') AS raw FROM kept JOIN first_page USING (url)
              JOIN pars ON pars.page_id = first_page.page_id WHERE has_body),
    one AS (SELECT *, regexp_replace(regexp_replace(raw, '^In this article\\s*', ''), '^\\s+|\\s+$', '', 'g')
            AS full_text FROM texts WHERE raw <> ''
            QUALIFY row_number() OVER (PARTITION BY raw ORDER BY q, page_id) = 1),
    news AS (SELECT *, CAST(published_at + {v.ZONE_SHIFT} AS DATE)
             + (CASE WHEN hour(published_at + {v.ZONE_SHIFT}) >= 15 THEN 1 ELSE 0 END) AS news_day
             FROM one WHERE len(regexp_extract_all(full_text, '\\S+')) >= 30),
    calendar AS (SELECT DISTINCT obs_date AS session FROM rate)
    SELECT url, 'search ' || q || ' page ' || page_id AS title, published_at, full_text,
           coalesce(session, news_day + (CASE dayofweek(news_day) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END))
           AS adjusted_date
    FROM news ASOF LEFT JOIN calendar ON news_day <= session""")
def harvest(spark, d):
    out = hv.harvest_articles(_searches(spark, d), v.table(spark, d, "pages"), v.rate(spark, d),
                              floor="1996-03-01", tag="article", css_class=None)
    return out.select("url", "title", "published_at", "full_text", "adjusted_date")
