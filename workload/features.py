"""Scores, daily blocks, text vectors and panels over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerpress.functions import text as tx
from tickerpress.operators import alignment as al
from tickerpress.operators import daily as da
from tickerpress.operators import panel as pn
from tickerpress.operators import scoring as sc
from tickerpress.operators import vectors as vc
from tickerpress.session import write_through
from workload import views as v
from workload.articles import aligned

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


# -- lexicon scores ------------------------------------------------------------

CLEAN = "lower(regexp_replace(coalesce({c}, ''), '[^a-zA-Z\\s]', ' ', 'g'))"


def tokens_sql(column: str, source: str = "news", prefix: str = "") -> str:
    """CTE with the lexicon scores of one text column, in relational form."""
    w = v.WORDS
    return f"""
    {prefix}tok AS (SELECT ingest_id, unnest(regexp_extract_all({CLEAN.format(c=column)}, '[a-z]+'))
                    AS t FROM {source}),
    {prefix}cnt AS (SELECT s.ingest_id, count(t) AS n,
        count(CASE WHEN t IN ({v.sql_list(w['positive'])}) THEN 1 END) AS pos,
        count(CASE WHEN t IN ({v.sql_list(w['negative'])}) THEN 1 END) AS neg,
        count(CASE WHEN t IN ({v.sql_list(w['uncertainty'])}) THEN 1 END) AS unc
        FROM {source} s LEFT JOIN {prefix}tok k ON k.ingest_id = s.ingest_id GROUP BY 1),
    {prefix}lm AS (SELECT ingest_id, CAST(pos AS INTEGER) AS {prefix}lm_pos,
        CAST(neg AS INTEGER) AS {prefix}lm_neg, CAST(unc AS INTEGER) AS {prefix}lm_unc,
        CASE WHEN pos + neg > 0 THEN (pos - neg) / CAST(pos + neg AS DOUBLE) ELSE CAST(0 AS DOUBLE)
             END AS {prefix}lm_polarity,
        unc / CAST(greatest(n, 1) AS DOUBLE) AS {prefix}lm_unc_ratio,
        CAST(pos + neg > 0 AS INTEGER) AS {prefix}lm_hit FROM {prefix}cnt)"""


def valence_sql(column: str, source: str = "news", prefix: str = "", context: bool = True) -> str:
    """CTE with the valence scores of one text column, by windows over its tokens."""
    values = ", ".join(f"('{t}', {x})" for t, x in v.VALENCE.items())
    punct = "[.!?,;:''\"-]|!!|!!!|[?][?]|[?][?][?]|[?]![?]|![?]!|[?]![?]!|![?]![?]"
    bare = "[^!-/:-@\\[-`{-~]{2,}"
    up = "t = upper(t) AND t <> lower(t)"

    def step(k, fade, src):
        low = f"lower(w{k})"
        between = " OR ".join(f"coalesce(lower(w{i}) IN ('so', 'this'), false)" for i in range(1, k))
        never = (f"WHEN {low} = 'never' AND ({between}) THEN b{k} * {1.5 if k == 2 else 1.25}"
                 if k > 1 else "")
        return f"""
    {prefix}b{k} AS (SELECT *, CASE WHEN v{k - 1} = 0 THEN 0 ELSE v{k - 1} + CAST({fade} AS DOUBLE)
          * (CASE WHEN {low} IN ({v.sql_list(v.BOOSTERS)}) THEN CAST(0.293 AS DOUBLE)
                  WHEN {low} IN ({v.sql_list(v.DAMPENERS)}) THEN CAST(-0.293 AS DOUBLE) END
             * (CASE WHEN v{k - 1} < 0 THEN -1 ELSE 1 END)
             + CASE WHEN caps AND w{k} = upper(w{k}) AND w{k} <> lower(w{k})
                    THEN (CASE WHEN v{k - 1} > 0 THEN 1 ELSE -1 END) * CAST(0.733 AS DOUBLE)
                    ELSE 0 END) END AS b_ FROM {src}),
    {prefix}s{k} AS (SELECT * EXCLUDE (b{k}, b_), CASE
          WHEN w{k} IS NULL OR v{k - 1} = 0 OR {low} IN (SELECT term FROM {prefix}lex) THEN v{k - 1}
          {never}
          WHEN {low} IN ({v.sql_list(v.NEGATIONS)}) OR contains({low}, 'n''t')
               THEN b{k} * CAST(-0.74 AS DOUBLE) ELSE b{k} END AS v{k}
          FROM (SELECT *, coalesce(b_, v{k - 1}) AS b{k} FROM {prefix}b{k}))"""

    if context:
        skipped = v.sql_list([*v.BOOSTERS, *v.DAMPENERS])
        chain = step(1, 1.0, f"{prefix}s0") + "," + step(2, 0.95, f"{prefix}s1") + "," + \
            step(3, 0.9, f"{prefix}s2")
        final = f"""v3 * (CASE WHEN lower(w1) = 'least' AND lower(w1) NOT IN (SELECT term FROM {prefix}lex)
                 AND NOT coalesce(lower(w2) IN ('at', 'very'), false) THEN CAST(-0.74 AS DOUBLE)
                 ELSE CAST(1 AS DOUBLE) END)
             * (CASE WHEN turn IS NULL OR i = turn THEN 1 WHEN i < turn THEN 0.5 ELSE 1.5 END)"""
        start = f"""CASE WHEN lower(t) IN ({skipped}) OR (lower(t) = 'kind' AND
                 coalesce(lower(next) = 'of', false)) THEN CAST(0 AS DOUBLE)
             ELSE coalesce(CAST(x AS DOUBLE), 0) + (CASE WHEN caps AND {up}
                 THEN sign(coalesce(x, 0)) * CAST(0.733 AS DOUBLE) ELSE 0 END) END"""
        marks = f"""least(length({column}) - length(replace({column}, '!', '')), 4)
                * CAST(0.292 AS DOUBLE) + (CASE
            WHEN length({column}) - length(replace({column}, '?', '')) > 3 THEN CAST(0.96 AS DOUBLE)
            WHEN length({column}) - length(replace({column}, '?', '')) > 1 THEN CAST(0.18 AS DOUBLE)
                 * (length({column}) - length(replace({column}, '?', ''))) ELSE 0 END)"""
        last = "s3"
    else:
        chain, final, marks, last = "", "v0", "CAST(0 AS DOUBLE)", "s0"
        start = "coalesce(CAST(x AS DOUBLE), 0)"
    chain = chain + "," if chain else ""
    return f"""
    {prefix}lex AS (SELECT * FROM (VALUES {values}) l(term, x)),
    {prefix}parts AS (SELECT ingest_id, list_filter(string_split_regex(coalesce({column}, ''), '\\s+'),
                lambda p: length(p) > 1) AS ps FROM {source}),
    {prefix}raw AS (SELECT ingest_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
                FROM {prefix}parts),
    {prefix}words AS (SELECT ingest_id, i, regexp_replace(regexp_replace(p, '^({bare})({punct})$',
                '\\1'), '^({punct})({bare})$', '\\2') AS t FROM {prefix}raw),
    {prefix}seen AS (SELECT *, lag(t, 1) OVER w AS w1, lag(t, 2) OVER w AS w2, lag(t, 3) OVER w AS w3,
                lead(t, 1) OVER w AS next,
                min(CASE WHEN lower(t) = 'as' THEN i END) OVER d AS turn,
                count(CASE WHEN {up} THEN 1 END) OVER d BETWEEN 1 AND count(*) OVER d - 1 AS caps
                FROM {prefix}words
                WINDOW w AS (PARTITION BY ingest_id ORDER BY i), d AS (PARTITION BY ingest_id)),
    {prefix}s0 AS (SELECT e.*, {start} AS v0 FROM {prefix}seen e LEFT JOIN {prefix}lex l
                ON l.term = lower(t)),
    {chain}
    {prefix}heard AS (SELECT ingest_id, i, {final} AS val FROM {prefix}{last}),
    {prefix}sums AS (SELECT ingest_id, sum(val) AS s, sum(CASE WHEN val > 0 THEN val + 1 ELSE 0 END) AS up,
                -sum(CASE WHEN val < 0 THEN val - 1 ELSE 0 END) AS down,
                count(CASE WHEN val = 0 THEN 1 END) AS neu FROM {prefix}heard GROUP BY 1),
    {prefix}amp AS (SELECT n.ingest_id, coalesce(s, 0) + sign(coalesce(s, 0)) * ({marks}) AS s,
                coalesce(up, 0) + (CASE WHEN up > down THEN {marks} ELSE 0 END) AS up,
                coalesce(down, 0) + (CASE WHEN up < down THEN {marks} ELSE 0 END) AS down,
                coalesce(neu, 0) AS neu FROM {source} n LEFT JOIN {prefix}sums u
                ON u.ingest_id = n.ingest_id),
    {prefix}val AS (SELECT ingest_id,
                {v.r('coalesce(down / nullif(up + down + neu, 0), 0)', 3)} AS {prefix}vader_neg,
                {v.r('coalesce(neu / nullif(up + down + neu, 0), 0)', 3)} AS {prefix}vader_neu,
                {v.r('coalesce(up / nullif(up + down + neu, 0), 0)', 3)} AS {prefix}vader_pos,
                {v.r('s / sqrt(s * s + 15)', 4)} AS {prefix}vader_compound FROM {prefix}amp)"""


@query("l1_clean_text", v.ctes("news") + f"SELECT ingest_id, {CLEAN.format(c='full_text')} AS cleaned "
                        "FROM news")
def l1(spark, d):
    return v.news(spark, d).select("ingest_id", tx.clean_ascii(F.col("full_text")).alias("cleaned"))


def _parts(spark, d) -> int:
    """Shuffle partitions for terms of whole texts: in proportion to the scan, so that none grows with the input."""
    return 16 * v.table(spark, d, "documents").rdd.getNumPartitions()


@query("l2_tokens", v.ctes("news", tail=f"""tok AS (SELECT ingest_id,
    unnest(regexp_extract_all({CLEAN.format(c='full_text')}, '[a-z]+')) AS t FROM news)""")
    + "SELECT ingest_id, t AS token, count(*) AS n FROM tok GROUP BY 1, 2")
def l2(spark, d):
    counts = tx.unnest(v.news(spark, d), ["ingest_id"], tx.term_counts(tx.alpha_tokens(F.col("full_text"))), "t")
    # Counted inside the row, so only repeated ids are left to add up: no partial sums ahead of the shuffle.
    return (counts.select("ingest_id", F.col("t.term").alias("token"), "t.n")
            .repartition(_parts(spark, d), "ingest_id", "token")
            .groupBy("ingest_id", "token").agg(F.sum("n").alias("n")))


_COUNTS = """SELECT ingest_id, CAST(n AS INTEGER) AS n_tokens, CAST(pos AS INTEGER) AS lm_pos,
    CAST(neg AS INTEGER) AS lm_neg, CAST(unc AS INTEGER) AS lm_unc FROM cnt"""


@query("l3_lexicon_counts", v.ctes("news", tail=tokens_sql("full_text")) + _COUNTS)
def l3(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    return sc.lexicon_counts(texts, "full_text", lexicon=v.LEXICON).drop("full_text")


@query("l3_lexicon_join", v.ctes("news", tail=tokens_sql("full_text")) + """
    SELECT ingest_id, 'positive' AS category, pos AS hits FROM cnt WHERE pos > 0
    UNION ALL SELECT ingest_id, 'negative', neg FROM cnt WHERE neg > 0
    UNION ALL SELECT ingest_id, 'uncertainty', unc FROM cnt WHERE unc > 0""")
def l3_join(spark, d):
    rows = [(w, c) for c, words in v.WORDS.items() for w in words]
    lexicon = spark.createDataFrame(rows, "term string, category string")
    return sc.lexicon_hits_by_join(v.news(spark, d), "ingest_id", "full_text", lexicon)


def _default_words_sql() -> str:
    lx = sc.Lexicon()
    sql = tokens_sql("full_text")
    for name in v.WORDS:
        sql = sql.replace(f"t IN ({v.sql_list(v.WORDS[name])})", f"t IN ({v.sql_list(getattr(lx, name))})")
    return sql


@query("l3_default_lexicon", v.ctes("news", tail=_default_words_sql()) + _COUNTS)
def l3_default(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    return sc.lexicon_counts(texts, "full_text").drop("full_text")


@query("l4_polarity", v.ctes("news", tail=tokens_sql("full_text")) +
       f"SELECT ingest_id, {v.r('lm_polarity')} AS lm_polarity FROM lm")
def l4(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    scored = sc.score_lexicon(texts, "full_text", lexicon=v.LEXICON)
    return v.rounded(scored.select("ingest_id", "lm_polarity"))


@query("l5_uncertainty", v.ctes("news", tail=tokens_sql("full_text")) +
       f"SELECT ingest_id, {v.r('lm_unc_ratio')} AS lm_unc_ratio, lm_hit FROM lm")
def l5(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    scored = sc.score_lexicon(texts, "full_text", lexicon=v.LEXICON)
    return v.rounded(scored.select("ingest_id", "lm_unc_ratio", "lm_hit"))


@query("l6_valence_base", v.ctes("news", tail=valence_sql("full_text", context=False)) +
       "SELECT * FROM val")
def l6_base(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    return sc.score_valence(texts, "full_text", v.VALENCE, rules=v.PLAIN_RULES).drop("full_text")


@query("l6_valence_rules", v.ctes("news", tail=valence_sql("full_text")) + "SELECT * FROM val")
def l6(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    return sc.score_valence(texts, "full_text", v.VALENCE, rules=v.RULES).drop("full_text")


def scored(spark, d, source=None):
    """Aligned articles with lexicon and valence scores of title and body."""
    articles = aligned(spark, d) if source is None else source
    return sc.score_texts(articles, {"title": "title_", "full_text": "text_"}, v.LEXICON, v.VALENCE,
                          v.RULES)


SCORES = sc.score_columns(["title_", "text_"])
_SCORE_TAIL = ",".join([tokens_sql("title", prefix="title_"), tokens_sql("full_text", prefix="text_"),
                        valence_sql("title", prefix="title_"),
                        valence_sql("full_text", prefix="text_")])
_SCORED = f"""scored AS (SELECT ingest_id, adjusted_date, {', '.join(SCORES)} FROM aligned
    JOIN title_lm USING (ingest_id) JOIN text_lm USING (ingest_id)
    JOIN title_val USING (ingest_id) JOIN text_val USING (ingest_id))"""
SCORED_SQL = v.ctes("aligned", tail=_SCORE_TAIL + "," + _SCORED)
_RATIOS = [c for c in SCORES if c.endswith(("polarity", "ratio"))]


@query("l7_score_texts", SCORED_SQL + "SELECT ingest_id, " + ", ".join(
    f"{v.r(c)} AS {c}" if c in _RATIOS else c for c in SCORES) + " FROM scored")
def l7(spark, d):
    return v.rounded(scored(spark, d).select("ingest_id", *SCORES), *_RATIOS)


# -- daily blocks --------------------------------------------------------------

DAILY = [f"{c}_{s}" for c in SCORES for s in da.STATISTICS]
_TAKE = {"mean": "avg({c})", "std": "coalesce(stddev_samp({c}), 0)", "min": "min({c})",
         "max": "max({c})"}
_DAILY_SELECT = ", ".join(f"CAST({_TAKE[s].format(c=c)} AS DOUBLE) AS {c}_{s}"
                          for c in SCORES for s in da.STATISTICS)
DAILY_CTE = f"""daily AS (SELECT adjusted_date AS obs_date, {_DAILY_SELECT}, count(*) AS news_count
    FROM scored GROUP BY 1)"""
DAILY_SQL = SCORED_SQL.rstrip() + ",\n" + DAILY_CTE + "\n"


def daily(spark, d):
    return da.aggregate_daily(scored(spark, d), "adjusted_date", SCORES)


@query("a1_daily_statistics", DAILY_SQL + "SELECT obs_date, " +
       ", ".join(f"{v.r(c)} AS {c}" for c in DAILY) + " FROM daily")
def a1(spark, d):
    return v.rounded(daily(spark, d).drop("news_count"))


@query("a2_news_count", v.ctes("aligned") + """
    SELECT adjusted_date AS obs_date, count(*) AS news_count FROM aligned GROUP BY 1""")
def a2(spark, d):
    return da.aggregate_daily(aligned(spark, d), "adjusted_date", [])


@query("a3_fill_singletons", f"""
    SELECT CAST(o_orderdate AS DATE) AS obs_date, {v.r('avg(o_totalprice)')} AS o_totalprice_mean,
           {v.r('coalesce(stddev_samp(o_totalprice), 0)')} AS o_totalprice_std,
           min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max,
           count(*) AS news_count FROM orders GROUP BY 1""")
def a3(spark, d):
    out = da.aggregate_daily(v.table(spark, d, "orders"), "o_orderdate", ["o_totalprice"])
    return v.rounded(out, "o_totalprice_mean", "o_totalprice_std")


_VECTOR_SIZE = 64


@query("a4_daily_vector_mean", "SELECT CAST(o_orderdate AS DATE) AS obs_date, " + ", ".join(
    f"{v.r(f'avg(CAST(embedding[{i + 1}] AS DOUBLE))')} AS e_svd_{i}" for i in range(_VECTOR_SIZE))
    + " FROM embeddings JOIN orders ON o_orderkey = vec_id GROUP BY 1")
def a4(spark, d):
    dated = v.table(spark, d, "embeddings").join(
        v.table(spark, d, "orders").select(F.col("o_orderkey").alias("vec_id"), "o_orderdate"), "vec_id")
    return v.rounded(da.daily_vector_mean(dated, "o_orderdate", "embedding", _VECTOR_SIZE, "e_"))


_A5_COLUMNS = ["title_lm_pos_mean", "text_lm_neg_max", "text_vader_compound_mean"]


@query("a5_assemble_daily", DAILY_SQL + f"""
    , vec AS (SELECT CAST(o_orderdate AS DATE) AS obs_date,
                     avg(CAST(embedding[1] AS DOUBLE)) AS e_svd_0
              FROM embeddings JOIN orders ON o_orderkey = vec_id GROUP BY 1),
      ord AS (SELECT CAST(o_orderdate AS DATE) AS obs_date, count(*) AS n_orders
              FROM orders GROUP BY 1)
    SELECT obs_date, news_count, {', '.join(f'{v.r(c)} AS {c}' for c in _A5_COLUMNS)},
           {v.r('e_svd_0')} AS e_svd_0, n_orders
    FROM daily LEFT JOIN vec USING (obs_date) LEFT JOIN ord USING (obs_date)""")
def a5(spark, d):
    orders = v.table(spark, d, "orders")
    dated = v.table(spark, d, "embeddings").join(
        orders.select(F.col("o_orderkey").alias("vec_id"), "o_orderdate"), "vec_id")
    vec = da.daily_vector_mean(dated, "o_orderdate", "embedding", 1, "e_")
    counts = orders.groupBy(F.to_date("o_orderdate").alias("obs_date")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    block = daily(spark, d).select("obs_date", "news_count", *_A5_COLUMNS)
    return v.rounded(da.assemble_daily(block, vec, counts))


# -- text vectors --------------------------------------------------------------

def terms_sql(source: str = "news", column: str = "full_text", where: str = "") -> str:
    """CTE ``trm(ingest_id, term)``: words without stop words, then neighbours."""
    return f"""
    kept AS (SELECT ingest_id, list_filter(regexp_extract_all(lower(coalesce({column}, '')),
        '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({v.sql_list(v.STOP_WORDS)})) AS ts
        FROM {source} {where}),
    trm AS (SELECT ingest_id, unnest(list_concat(ts, list_transform(
        list_zip(ts[:-2], ts[2:]), lambda z: z[1] || ' ' || z[2]))) AS term FROM kept)"""


def weights_sql(source: str, column: str, max_features: int, min_df: int, train: str = "") -> str:
    """CTEs ``voc`` fitted on the rows of ``train`` and ``wts`` over all rows."""
    return terms_sql(source, column) + f""",
    fit AS (SELECT ingest_id FROM {source} {train}),
    cnt AS (SELECT ingest_id, term, count(*) AS tf FROM trm GROUP BY 1, 2),
    voc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM cnt
            WHERE ingest_id IN (SELECT ingest_id FROM fit) GROUP BY 1 HAVING count(*) >= {min_df}
            ORDER BY 2 DESC, 1 LIMIT {max_features}),
    idf AS (SELECT term, tf, df, ln((1.0 + (SELECT count(*) FROM fit)) / (1.0 + df)) + 1 AS idf
            FROM voc),
    raw AS (SELECT ingest_id, term, cnt.tf * idf AS w FROM cnt JOIN idf USING (term)),
    wts AS (SELECT ingest_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY ingest_id)) AS weight
            FROM raw)"""


@query("v1_term_stream", v.ctes("news", tail=terms_sql()) +
       "SELECT ingest_id, term, count(*) AS n FROM trm GROUP BY 1, 2")
def v1(spark, d):
    texts = v.news(spark, d).select("ingest_id", "full_text")
    return vc.term_counts(texts, "ingest_id", "full_text", v.STOP_WORDS, partitions=_parts(spark, d))


@query("v2_vocabulary", v.ctes("news", tail=weights_sql("news", "full_text", 3000, 5)) +
       "SELECT term, tf, df FROM voc")
def v2(spark, d):
    return vc.vocabulary(v.news(spark, d), "full_text", v.STOP_WORDS, vc.BODY_TERMS)


@query("v3_tfidf_weights", v.ctes("news", tail=weights_sql("news", "full_text", 3000, 5)) +
       f"SELECT ingest_id, term, {v.r('weight')} AS weight FROM wts")
def v3(spark, d):
    articles = v.news(spark, d).select("ingest_id", "full_text")
    model = vc.fit_tfidf(articles, "full_text", vc.BODY_TERMS, stop_words=v.STOP_WORDS)
    return v.rounded(vc.long_weights(model.transform(articles, "full_text"), ["ingest_id"], model))


CUTOFF_SQL = ("(SELECT min(obs_date) FROM (SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1"
              " AS i, count(*) OVER () AS n FROM rate) WHERE i = CAST(floor(n * CAST(0.7 AS DOUBLE))"
              " AS BIGINT))")


def train_articles(spark, d):
    """Aligned articles strictly before the date at 70% of the calendar."""
    cutoff = pn.cutoff_date(v.rate(spark, d)).select("cutoff").scalar()
    return vc.before_cutoff(aligned(spark, d), "adjusted_date", cutoff)


@query("v4_leak_free_fit", v.ctes("aligned", tail=weights_sql(
    "aligned", "full_text", 3000, 5, f"WHERE adjusted_date < {CUTOFF_SQL}")) +
    f"""SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx,
               {v.r('idf')} AS idf FROM idf""")
def v4(spark, d):
    train = train_articles(spark, d).select("full_text")
    model = vc.fit_tfidf(train, "full_text", vc.BODY_TERMS, stop_words=v.STOP_WORDS)
    return v.rounded(model.frame(spark))


@query("v5_transform", v.ctes("aligned", tail=weights_sql(
    "aligned", "title", 1000, 5, f"WHERE adjusted_date < {CUTOFF_SQL}")) +
    f"SELECT ingest_id, term, {v.r('weight')} AS weight FROM wts")
def v5(spark, d):
    model = vc.fit_tfidf(train_articles(spark, d).select("title"), "title", vc.TITLE_TERMS,
                         stop_words=v.STOP_WORDS)
    articles = aligned(spark, d).select("ingest_id", "title")
    return v.rounded(vc.long_weights(model.transform(articles, "title"), ["ingest_id"], model))


#: Vocabulary size and rank of each field, and its prefix in the daily table.
_FIELDS = {"title": (vc.TITLE_TERMS, vc.TITLE_RANK, "title_"), "full_text": (vc.BODY_TERMS, vc.BODY_RANK, "text_")}


@query("v5_transform_bodies", v.ctes("aligned", tail=weights_sql(
    "aligned", "full_text", 3000, 5, f"WHERE adjusted_date < {CUTOFF_SQL}")) +
    f"SELECT ingest_id, term, {v.r('weight')} AS weight FROM wts")
def v5_bodies(spark, d):
    model = vc.fit_tfidf(train_articles(spark, d).select("full_text"), "full_text", vc.BODY_TERMS,
                         stop_words=v.STOP_WORDS)
    articles = aligned(spark, d).select("ingest_id", "full_text")
    return v.rounded(vc.long_weights(model.transform(articles, "full_text"), ["ingest_id"], model))


def _texts(spark, d, column):
    """Aligned texts of one field, written once for the passes that read them, and those before the cutoff."""
    texts = write_through(aligned(spark, d).select("ingest_id", "adjusted_date", column), "texts")
    cutoff = pn.cutoff_date(v.rate(spark, d)).select("cutoff").scalar()
    return texts, vc.before_cutoff(texts, "adjusted_date", cutoff)


def _models(train, column):
    terms, rank, _ = _FIELDS[column]
    return vc.fit_tfidf_svd(train, column, terms, rank, stop_words=v.STOP_WORDS)


def _singular_values(spark, d, column):
    _, svd = _models(_texts(spark, d, column)[1], column)
    rows = [(i, float(s)) for i, s in enumerate(svd.singular_values)]
    return v.rounded(spark.createDataFrame(rows, "component int, singular_value double"))


def _projected(spark, d, column):
    texts, train = _texts(spark, d, column)
    tfidf, svd = _models(train, column)
    vectors = tfidf.transform(texts.select("ingest_id", column), column)
    placed = svd.project(vectors).select("ingest_id", "svd")
    return v.rounded(vc.component_columns(placed, "svd", svd.rank, _FIELDS[column][2]))


def _projected_daily(spark, d, column):
    texts, train = _texts(spark, d, column)
    tfidf, svd = _models(train, column)
    return v.rounded(vc.transform_daily(texts, "adjusted_date", column, tfidf, svd, _FIELDS[column][2]))


@query("v6_truncated_svd")
def v6(spark, d):
    return _singular_values(spark, d, "title")


@query("v6_truncated_svd_bodies")
def v6_bodies(spark, d):
    return _singular_values(spark, d, "full_text")


@query("v6_components")
def v6_components(spark, d):
    """Loadings of every term on every component, of titles and bodies."""
    def field(column):
        tfidf, svd = _models(_texts(spark, d, column)[1], column)
        return svd.frame(spark, tfidf.terms).withColumn("field", F.lit(column))

    return v.rounded(field("title").unionByName(field("full_text")))


def _svd_checks_sql(column: str) -> str:
    """What must hold of singular vectors, but for the total, which is a figure of the texts."""
    terms, rank, _ = _FIELDS[column]
    return v.ctes("aligned", tail=weights_sql(
        "aligned", column, terms, 5, f"WHERE adjusted_date < {CUTOFF_SQL}") + f""",
        ks AS (SELECT CAST(k AS INTEGER) AS k FROM range({rank}) r(k)
               WHERE k < greatest(1, (SELECT count(*) FROM voc) - 1))""") + """
        SELECT 'product' AS item, a.k AS component, b.k AS other,
               CAST(CASE WHEN a.k = b.k THEN 1 ELSE 0 END AS DOUBLE) AS value FROM ks a JOIN ks b ON a.k <= b.k
        UNION ALL SELECT 'residual', k, k, CAST(0 AS DOUBLE) FROM ks
        UNION ALL SELECT 'length', k, k, CAST(0 AS DOUBLE) FROM ks
        UNION ALL SELECT 'total', 0, 0, CAST(count(DISTINCT ingest_id) AS DOUBLE)
        FROM wts JOIN fit USING (ingest_id)"""


def _svd_checks(spark, d, column):
    """Products of components, residuals of the singular pairs on the training texts, lengths
    of the projected texts less singular values, and the total squared weight."""
    terms, rank, _ = _FIELDS[column]
    train = _texts(spark, d, column)[1].select("ingest_id", column)
    tfidf, svd = vc.fit_tfidf_svd(train, column, terms, rank, stop_words=v.STOP_WORDS)
    vectors = write_through(tfidf.transform(train, column).select("ingest_id", "tfidf"), "vectors")
    weights = vc.long_weights(vectors, ["ingest_id"], tfidf)
    loadings = svd.frame(spark, tfidf.terms)
    sizes = spark.createDataFrame([(i, float(s * s)) for i, s in enumerate(svd.singular_values)],
                                  "component int, size double")
    placed = write_through(svd.project(vectors).select("ingest_id", "svd"), "placed")
    names = [f"s{i}" for i in range(svd.rank)]

    def sums(factor):
        """A sum per component, not a row per component and weight."""
        return [F.sum(factor(i) * F.get("svd", F.lit(i))).alias(n) for i, n in enumerate(names)]

    products = (loadings.join(loadings.toDF("other", "term", "b"), "term").where("component <= other")
                .groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("b")).alias("value")))
    back = (weights.join(placed, "ingest_id").groupBy("term").agg(*sums(lambda i: F.col("weight")))
            .select("term", F.posexplode(F.array(*names)).alias("component", "y")))
    off = F.abs(F.coalesce("y", F.lit(0.0)) - F.col("size") * F.col("loading"))
    residual = (loadings.join(back, ["component", "term"], "left").join(sizes, "component")
                .groupBy("component").agg(F.max(off).alias("value")))
    length = (placed.agg(*sums(lambda i: F.get("svd", F.lit(i)))).select(F.posexplode(F.array(*names)).alias("component", "squares"))
              .join(sizes, "component").select("component", (F.col("squares") - F.col("size")).alias("value")))
    total = weights.agg(F.sum(F.col("weight") * F.col("weight")).alias("value"))

    def rows(item, df, component="component", other="component"):
        number = [F.lit(0) if c is None else F.col(c) for c in (component, other)]
        return df.select(F.lit(item).alias("item"), number[0].alias("component"), number[1].alias("other"), "value")

    out = (rows("product", products, other="other").unionByName(rows("residual", residual))
           .unionByName(rows("length", length)).unionByName(rows("total", total, None, None)))
    return v.rounded(out)


@query("v6_svd_checks", _svd_checks_sql("title"))
def v6_checks(spark, d):
    return _svd_checks(spark, d, "title")


@query("v6_svd_checks_bodies", _svd_checks_sql("full_text"))
def v6_checks_bodies(spark, d):
    return _svd_checks(spark, d, "full_text")


@query("v7_project")
def v7(spark, d):
    return _projected(spark, d, "title")


@query("v7_project_bodies")
def v7_bodies(spark, d):
    return _projected(spark, d, "full_text")


@query("v8_transform_daily")
def v8(spark, d):
    return _projected_daily(spark, d, "title")


@query("v8_transform_daily_bodies")
def v8_bodies(spark, d):
    return _projected_daily(spark, d, "full_text")


@query("v9_top_terms", v.ctes("aligned", tail=weights_sql(
    "(SELECT * FROM aligned WHERE adjusted_date <= last_train.d) x", "full_text", 3000, 5)).replace(
    "WITH ", "WITH ", 1).replace("(SELECT * FROM aligned WHERE adjusted_date <= last_train.d) x",
                                 "trainset").replace(
    "kept AS", f"trainset AS (SELECT * FROM aligned WHERE adjusted_date < {CUTOFF_SQL}), kept AS", 1)
    + f"""SELECT term, {v.r('sum(weight) / (SELECT count(*) FROM fit)')} AS mean_weight FROM wts
          GROUP BY 1 ORDER BY sum(weight) DESC, term LIMIT 25""")
def v9(spark, d):
    train = train_articles(spark, d).select("full_text")
    return v.rounded(vc.top_terms(train, "full_text", stop_words=v.STOP_WORDS))


# -- panel ---------------------------------------------------------------------

FEATURES = ["text_lm_polarity_mean", "text_lm_unc_ratio_mean", "text_vader_compound_mean",
            "title_lm_polarity_mean", "title_vader_compound_mean"]
#: Daily counts that need no scoring: a light feature block for panel-only queries.
LIGHT_CTE = """
    feats AS (SELECT adjusted_date AS obs_date, count(*) AS news_count,
                     avg(CAST(length(full_text) AS DOUBLE)) AS n_chars_mean,
                     max(CAST(length(full_text) AS DOUBLE)) AS n_chars_max FROM aligned GROUP BY 1)"""
LIGHT = ["news_count", "n_chars_mean", "n_chars_max"]


def light_features(spark, d):
    return aligned(spark, d).select("adjusted_date", F.length("full_text").cast("double").alias("n")) \
        .groupBy(F.col("adjusted_date").alias("obs_date")).agg(
            F.count(F.lit(1)).alias("news_count"), F.avg("n").alias("n_chars_mean"),
            F.max("n").alias("n_chars_max"))


def panel_cte(rates: str = "rate_multi", feats: str = "feats", names=LIGHT) -> str:
    lagged = ", ".join(f"coalesce(lag({c}) OVER w, 0) AS {c}" for c in names)
    cols = ", ".join(names)
    return f"""
    joined AS (SELECT r.*, {cols} FROM {rates} r LEFT JOIN {feats} USING (obs_date)),
    changed AS (SELECT series_id, obs_date, level, level - lag(level) OVER w AS diff, {lagged}
                FROM joined WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)),
    lagged AS (SELECT *, lag(diff) OVER (PARTITION BY series_id ORDER BY obs_date) AS diff_lag1
               FROM changed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS i,
                      count(*) OVER (PARTITION BY series_id) AS n
               FROM lagged WHERE diff IS NOT NULL AND diff_lag1 IS NOT NULL),
    panel AS (SELECT * EXCLUDE (i, n), CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                     WHEN i < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
              FROM placed)"""


PANEL_SQL = v.ctes("aligned", "rate_multi", tail=LIGHT_CTE + "," + panel_cte())
_SERIES_W = "(PARTITION BY series_id ORDER BY obs_date)"


def panel(spark, d):
    """Five price series with the light features."""
    return pn.build_panel(v.rate_multi(spark, d), light_features(spark, d))


def light_round(df):
    return v.rounded(df, *[c for c in ("diff", "diff_lag1", "n_chars_mean") if c in df.columns])


@query("p1_join_features", v.ctes("aligned", "rate_multi", tail=LIGHT_CTE) + f"""
    SELECT series_id, obs_date, r.level, news_count, {v.r('n_chars_mean')} AS n_chars_mean,
           n_chars_max FROM rate_multi r LEFT JOIN feats USING (obs_date)""")
def p1(spark, d):
    stray = light_features(spark, d).withColumn("level", F.lit(0.0))
    return light_round(pn.join_features(v.rate_multi(spark, d), stray))


@query("p2_difference", v.ctes("rate_multi") + f"""
    SELECT *, {v.r(f'level - lag(level) OVER {_SERIES_W}')} AS diff FROM rate_multi""")
def p2(spark, d):
    return light_round(pn.difference(v.rate_multi(spark, d)))


@query("p3_lag_target", v.ctes("rate_multi", tail=f"""
    ch AS (SELECT *, level - lag(level) OVER {_SERIES_W} AS diff FROM rate_multi)""") + f"""
    SELECT series_id, obs_date, level, {v.r('diff')} AS diff,
           {v.r(f'lag(diff) OVER {_SERIES_W}')} AS diff_lag1 FROM ch""")
def p3(spark, d):
    return light_round(pn.lag_target(pn.difference(v.rate_multi(spark, d))))


_P45 = v.ctes("aligned", "rate_multi", tail=LIGHT_CTE + """,
    joined AS (SELECT r.*, news_count, n_chars_mean, n_chars_max
               FROM rate_multi r LEFT JOIN feats USING (obs_date))""")


@query("p4_lag_features", _P45 + f"""
    SELECT series_id, obs_date, level, lag(news_count) OVER w AS news_count,
           {v.r('lag(n_chars_mean) OVER w')} AS n_chars_mean, lag(n_chars_max) OVER w AS n_chars_max
    FROM joined WINDOW w AS {_SERIES_W}""")
def p4(spark, d):
    joined = pn.join_features(v.rate_multi(spark, d), light_features(spark, d))
    return light_round(pn.lag_features(joined, LIGHT))


@query("p5_neutral_fill", _P45 + f"""
    SELECT series_id, obs_date, level, coalesce(news_count, 0) AS news_count,
           {v.r('coalesce(n_chars_mean, 0)')} AS n_chars_mean,
           coalesce(n_chars_max, 0) AS n_chars_max FROM joined""")
def p5(spark, d):
    joined = pn.join_features(v.rate_multi(spark, d), light_features(spark, d))
    return light_round(pn.neutral_fill(joined, LIGHT))


@query("p6_drop_incomplete", v.ctes("rate_multi", tail=f"""
    ch AS (SELECT *, level - lag(level) OVER {_SERIES_W} AS diff FROM rate_multi),
    lg AS (SELECT *, lag(diff) OVER {_SERIES_W} AS diff_lag1 FROM ch)""") + f"""
    SELECT series_id, obs_date, level, {v.r('diff')} AS diff, {v.r('diff_lag1')} AS diff_lag1
    FROM lg WHERE diff IS NOT NULL AND diff_lag1 IS NOT NULL""")
def p6(spark, d):
    return light_round(pn.drop_incomplete(pn.lag_target(pn.difference(v.rate_multi(spark, d)))))


@query("p7_split_rows", v.ctes("rate_multi") + f"""
    SELECT series_id, obs_date, level, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
           WHEN i < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER {_SERIES_W} - 1 AS i,
                 count(*) OVER (PARTITION BY series_id) AS n FROM rate_multi)""")
def p7(spark, d):
    return pn.split_rows(v.rate_multi(spark, d))


@query("p8_cutoff_date", v.ctes("rate_multi") + f"""
    SELECT series_id, obs_date AS cutoff FROM (SELECT *, row_number() OVER {_SERIES_W} - 1 AS i,
        count(*) OVER (PARTITION BY series_id) AS n FROM rate_multi)
    WHERE i = floor(n * CAST(0.7 AS DOUBLE))""")
def p8(spark, d):
    return pn.cutoff_date(v.rate_multi(spark, d))


@query("p9_union_splits", PANEL_SQL + f"""
    SELECT series_id, obs_date, {v.r('diff')} AS diff, split FROM panel WHERE split <> 'test'""")
def p9(spark, d):
    whole = panel(spark, d).select("series_id", "obs_date", "diff", "split")
    parts = [(s, pn.only_splits(whole, s).drop("split")) for s in ("train", "val")]
    return light_round(pn.union_splits(*parts))


@query("p10_feature_columns", PANEL_SQL + f"""
    SELECT obs_date, series_id, {v.r('diff_lag1')} AS diff_lag1, {v.r('n_chars_mean')} AS n_chars_mean,
           n_chars_max FROM panel""")
def p10(spark, d):
    whole = panel(spark, d)
    names = pn.model_columns(whole.columns)
    return light_round(whole.select("obs_date", "series_id", *names))


@query("p11_level_forecast", PANEL_SQL + f"""
    SELECT series_id, obs_date, {v.r('level - diff')} AS level_before,
           {v.r('level - diff + diff_lag1')} AS level_hat FROM panel""")
def p11(spark, d):
    out = pn.level_forecast(panel(spark, d).withColumn("y_hat", F.col("diff_lag1")))
    return v.rounded(out.select("series_id", "obs_date", "level_before", "level_hat"))


@query("build_panel", PANEL_SQL + f"""
    SELECT series_id, obs_date, level, {v.r('diff')} AS diff, {v.r('diff_lag1')} AS diff_lag1,
           news_count, {v.r('n_chars_mean')} AS n_chars_mean, n_chars_max, split FROM panel""")
def whole_panel(spark, d):
    return light_round(panel(spark, d))


# -- panel with scored text ----------------------------------------------------

SCORED_PANEL_SQL = DAILY_SQL.rstrip() + "," + panel_cte("rate", "daily", [*DAILY, "news_count"]) + "\n"


def scored_panel(spark, d):
    """One price series with all lexicon and valence statistics."""
    return pn.build_panel(v.rate(spark, d), daily(spark, d))


@query("scored_panel", SCORED_PANEL_SQL + f"""
    SELECT obs_date, split, level, {v.r('diff')} AS diff, news_count,
           {', '.join(f'{v.r(c)} AS {c}' for c in FEATURES)} FROM panel""")
def scored_panel_query(spark, d):
    whole = scored_panel(spark, d)
    return v.rounded(whole.select("obs_date", "split", "level", "diff", "news_count", *FEATURES),
                     "diff", *FEATURES)
