"""The analyzers as queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import details, graph, movement, scoring, series
from .operators.scoring import EXPECTED_CTR, EXPECTED_CTR_BEYOND, INTENT_PREFIXES, STOP_WORDS
from .sources import facts

Query = Callable[[SparkSession, str], DataFrame]

WHOLE = ("1995-01-01", "2001-12-31")
NOW, BEFORE = ("1998-01-01", "1998-12-31"), ("1997-01-01", "1997-12-31")
HALF_YEAR = ("1998-01-05", "1998-07-19")
MONTH = ("2024-01-01", "2024-01-31")
PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of a sum doesn't show."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tidy(sql: str, doubles: str) -> str:
    """The SQL twin of ``rounded``."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {PLACES}) + 0.0 AS {c}' for c in doubles.split())}) FROM ({sql})"


DENSE = """dense AS (
  SELECT '/' || event_type AS url, 'q' || CAST(user_id % 8 AS VARCHAR) AS query, CAST(ts AS DATE) AS date,
         count(*) FILTER (WHERE value >= 12) AS clicks, 10 * count(*) AS impressions,
         sum((CAST(json_extract(props, '$.k') AS INTEGER) % 20) * 10.0) AS sum_position
  FROM events GROUP BY ALL)"""
LINES = """lines AS (
  SELECT '/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) AS url, p_name AS query, CAST(l_shipdate AS DATE) AS date,
         CAST(floor(l_quantity * l_discount) AS BIGINT) AS clicks, CAST(l_quantity AS BIGINT) AS impressions,
         ((l_partkey + 7 * l_linenumber) % 30) * l_quantity AS sum_position, p_size, p_type, l_orderkey, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SPARSE = LINES + """, sparse AS (
  SELECT url, query, date, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(sum_position) AS sum_position FROM lines GROUP BY ALL)"""
LONG = LINES + """, long AS (
  SELECT url, CASE p_size % 5 WHEN 0 THEN 'how to ' WHEN 1 THEN 'best ' ELSE '' END || query || ' ' || lower(p_type) AS query, date,
         sum(clicks) AS clicks, sum(impressions) AS impressions, sum(sum_position) AS sum_position FROM lines GROUP BY ALL)"""
FOUR = """CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(impressions) AS DOUBLE) AS impressions,
         CAST(sum(clicks) AS DOUBLE) / nullif(sum(impressions), 0) AS ctr, sum(sum_position) / nullif(sum(impressions), 0) + 1 AS position"""


def inside(p: tuple[str, str], column: str = "date") -> str:
    return f"{column} BETWEEN DATE '{p[0]}' AND DATE '{p[1]}'"


def pair_sql(source: str, period, least: float) -> str:
    return f"SELECT query, url, {FOUR} FROM {source} WHERE {inside(period)} GROUP BY query, url HAVING sum(impressions) >= {least}"


def table_sql(source: str, key: str) -> str:
    keys = f"{key}, date" if key else "date"
    return f"SELECT {keys}, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(sum_position) AS sum_position FROM {source} GROUP BY {keys}"


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, made: Query, sql: str | None, doubles: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(made(spark, d))
    if sql:
        SQL[name] = tidy(sql, doubles) if doubles else sql


SHORT = ("1998-01-01", "1999-12-31")

add(
    "striking_distance", lambda s, d: scoring.striking_distance(facts.sparse(s, d), WHOLE),
    f"""WITH {SPARSE}, p AS ({pair_sql('sparse', WHOLE, 100)})
    SELECT *, round(impressions * 0.15) AS potential_clicks FROM p WHERE position BETWEEN 4 AND 20 AND ctr <= 0.05""",
    "ctr position",
)

WANT = "CASE " + " ".join(f"WHEN r = {i + 1} THEN {v}" for i, v in enumerate(EXPECTED_CTR)) + f" ELSE {EXPECTED_CTR_BEYOND} END"
add(
    "opportunity", lambda s, d: scoring.opportunity(facts.sparse(s, d), WHOLE),
    f"""WITH {SPARSE}, p AS ({pair_sql('sparse', WHOLE, 100)}),
    w AS (SELECT *, CAST(round(greatest(least(position, 10.0), 1.0)) AS INTEGER) AS r, CAST(round(greatest(least(position, 3.0), 1.0)) AS INTEGER) AS r3 FROM p),
    g AS (SELECT query, url, clicks, impressions, ctr, position,
            CASE WHEN position <= 3 THEN 0.2 WHEN position > 50 THEN 0.1 ELSE greatest(0.0, 1 - abs(position - 11) / 15) END AS position_score,
            least(log10(impressions) / 5, 1.0) AS impression_score, {WANT} AS want, r3 FROM w),
    h AS (SELECT *, CASE WHEN ctr >= want THEN 0.0 ELSE least((want - ctr) / want, 1.0) END AS ctr_gap_score FROM g)
    SELECT query, url, clicks, impressions, ctr, position, position_score, impression_score, ctr_gap_score,
           round(power(position_score * impression_score * ctr_gap_score, 1 / 3.0) * 100) AS opportunity_score,
           round(impressions * CASE r3 WHEN 1 THEN 0.30 WHEN 2 THEN 0.15 ELSE 0.10 END) AS potential_clicks FROM h""",
    "ctr position position_score impression_score ctr_gap_score",
)
add(
    "zero_click", lambda s, d: scoring.zero_click(facts.sparse(s, d), WHOLE, least=500, below_ctr=0.035),
    f"""WITH {SPARSE}, p AS ({pair_sql('sparse', WHOLE, 500)})
    SELECT *, greatest(0.0, round(impressions * CASE WHEN position <= 1 THEN 0.3 WHEN position <= 3 THEN 0.15 WHEN position <= 5 THEN 0.08 ELSE 0.04 END) - clicks) AS missed_clicks
    FROM p WHERE position <= 10 AND ctr < 0.035""",
    "ctr position missed_clicks",
)
add(
    "brand", lambda s, d: scoring.brand(facts.sparse(s, d), WHOLE, ["red", "Green."]),
    f"""WITH {SPARSE}, p AS ({pair_sql('sparse', WHOLE, 10)}),
    b AS (SELECT *, CASE WHEN contains(lower(query), 'red') OR contains(lower(query), 'green.') THEN 'brand' ELSE 'non-brand' END AS segment FROM p),
    t AS (SELECT sum(CASE segment WHEN 'brand' THEN clicks ELSE 0 END) AS brand_clicks, sum(CASE segment WHEN 'brand' THEN 0 ELSE clicks END) AS non_brand_clicks,
            sum(CASE segment WHEN 'brand' THEN impressions ELSE 0 END) AS brand_impressions, sum(CASE segment WHEN 'brand' THEN 0 ELSE impressions END) AS non_brand_impressions FROM b)
    SELECT * FROM b, t""",
    "ctr position brand_clicks",
)

CANNIBAL = f"""WITH {SPARSE}, p AS ({pair_sql('sparse', WHOLE, 50)}),
    t AS (SELECT query, sum(impressions) AS total_impressions, sum(clicks) AS total_clicks, count(*) AS competitors FROM p WHERE query <> '' AND url <> '' GROUP BY query
          HAVING count(*) >= 2 AND sum(impressions) >= 100),
    l AS (SELECT query, url AS leader_url, ctr AS leader_ctr, position AS leader_position FROM (
            SELECT *, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, clicks DESC, url) AS n FROM p) WHERE n = 1)"""
add(
    "cannibalization", lambda s, d: scoring.cannibalization(facts.sparse(s, d), WHOLE),
    CANNIBAL + """, e AS (SELECT query, total_impressions, total_clicks, competitors, leader_url, leader_ctr, leader_position,
            sum(power(100 * impressions / total_impressions, 2)) AS hhi,
            sum(CASE WHEN url <> leader_url AND leader_ctr > ctr THEN (leader_ctr - ctr) * impressions ELSE 0 END) AS stolen_clicks
          FROM p JOIN t USING (query) JOIN l USING (query) GROUP BY ALL)
    SELECT *, greatest(0.0, 1 - hhi / 10000) AS fragmentation,
           round(least(100.0, 100 * power(greatest(0.0, 1 - hhi / 10000) * least(stolen_clicks / greatest(total_clicks + stolen_clicks, 1), 1.0)
             * least(log10(greatest(total_impressions, 10)) / 5, 1.0), 1 / 3.0))) AS severity FROM e""",
    "leader_ctr leader_position hhi stolen_clicks fragmentation",
)
add(
    "cannibalization_edges", lambda s, d: scoring.competitor_edges(facts.sparse(s, d), WHOLE),
    CANNIBAL + """ SELECT a.url AS source, b.url AS target, count(*) AS queries, sum(least(a.impressions, b.impressions)) AS weight
    FROM p a JOIN p b ON a.query = b.query AND a.url < b.url JOIN t ON a.query = t.query GROUP BY ALL""",
    "weight",
)
add(
    "clustering", lambda s, d: scoring.clustering(facts.long(s, d), WHOLE),
    f"""WITH {LONG}, q AS (SELECT query, {FOUR} FROM long WHERE {inside(WHOLE)} GROUP BY query HAVING sum(impressions) >= 10),
    k AS (SELECT *, nullif(regexp_extract(lower(query), '^({'|'.join(INTENT_PREFIXES)})(\\s|$)', 1), '') AS intent, string_split_regex(lower(query), '\\s+') AS w FROM q),
    n AS (SELECT *, coalesce(intent, CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] END) AS cluster FROM k)
    SELECT cluster, min(CASE WHEN intent IS NULL THEN 'prefix' ELSE 'intent' END) AS cluster_type, count(*) AS keyword_count, sum(clicks) AS total_clicks,
           sum(impressions) AS total_impressions, sum((position - 1) * impressions) / sum(impressions) + 1 AS avg_position
    FROM n WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) >= 2""",
    "avg_position",
)
for dim, key in (("pages", "url"), ("keywords", "query")):
    add(
        f"concentration_{dim}", lambda s, d, dim=dim: scoring.concentration(facts.sparse(s, d), SHORT, dim),
        f"""WITH {SPARSE}, i AS (SELECT {key} AS k, CAST(sum(clicks) AS DOUBLE) AS c FROM sparse WHERE {inside(SHORT)} GROUP BY k HAVING sum(clicks) > 0),
        r AS (SELECT c, sum(c) OVER () AS t, count(*) OVER () AS n, row_number() OVER (ORDER BY c, k) AS up, row_number() OVER (ORDER BY c DESC, k) AS down FROM i),
        v AS (SELECT coalesce(sum((2 * up - n - 1) * c) / nullif(max(n) * max(t), 0), 0) AS gini, coalesce(sum(power(100 * c / t, 2)), 0) AS hhi,
                coalesce(sum(c) FILTER (WHERE down <= 10) / nullif(max(t), 0), 0) AS top_share, coalesce(max(n), 0) AS total_items, coalesce(max(t), 0) AS total_clicks FROM r)
        SELECT *, CASE WHEN hhi > 2500 THEN 'high' WHEN hhi > 1500 THEN 'medium' ELSE 'low' END AS risk FROM v""",
        "gini hhi top_share",
    )
add(
    "long_tail", lambda s, d: scoring.long_tail(facts.long(s, d), WHOLE, fewest=4),
    f"""WITH {LONG}, p AS ({pair_sql('long', WHOLE, 5)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY impressions DESC, query) AS rank FROM p WHERE query <> '' AND url <> ''),
    f AS (SELECT url, count(*) AS query_count, sum(impressions) AS total_impressions, sum(clicks) AS total_clicks, regr_slope(ln(impressions), ln(rank)) AS slope,
            regr_intercept(ln(impressions), ln(rank)) AS intercept, regr_r2(ln(impressions), ln(rank)) AS r2, max(impressions) AS head_impressions FROM r GROUP BY url HAVING count(*) >= 4)
    SELECT *, head_impressions / total_impressions AS head_share, CASE WHEN slope > -0.6 THEN 'flat-tail' WHEN slope > -1.2 THEN 'balanced' ELSE 'head-heavy' END AS fingerprint FROM f""",
    "slope intercept r2 head_share",
)
add(
    "intent_atlas", lambda s, d: scoring.intent_atlas(facts.long(s, d), WHOLE),
    f"""WITH {LONG}, q AS (SELECT query, {FOUR} FROM long WHERE {inside(WHOLE)} AND query <> '' GROUP BY query HAVING sum(impressions) >= 20),
    t AS (SELECT query, impressions, unnest(string_split_regex(lower(query), '\\s+')) AS token FROM q),
    k AS (SELECT * FROM t WHERE length(token) >= 3 AND token NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
    w AS (SELECT token, sum(impressions) AS weight FROM k GROUP BY token HAVING sum(impressions) >= 50),
    o AS (SELECT query, token, row_number() OVER (PARTITION BY query ORDER BY weight DESC, token) AS n FROM k JOIN w USING (token)),
    c AS (SELECT query, string_agg(token, ' + ' ORDER BY token) AS cluster FROM o WHERE n <= 2 GROUP BY query HAVING count(*) >= 2)
    SELECT cluster, count(*) AS keyword_count, sum(impressions) AS total_impressions, sum(clicks) AS total_clicks, sum(clicks) / sum(impressions) AS ctr,
           sum((position - 1) * impressions) / sum(impressions) + 1 AS avg_position FROM q JOIN c USING (query) GROUP BY cluster HAVING count(*) >= 3""",
    "ctr avg_position",
)
add(
    "bayesian_ctr", lambda s, d: scoring.bayesian_ctr(facts.sparse(s, d), WHOLE),
    f"""WITH {SPARSE}, p AS (SELECT *, CAST(round(least(position, 30)) AS INTEGER) AS bucket FROM ({pair_sql('sparse', WHOLE, 50)}) WHERE position <= 30 AND query <> '' AND url <> ''),
    m AS (SELECT bucket, count(*) AS n, sum(ctr * impressions) / sum(impressions) AS mu FROM p GROUP BY bucket),
    v AS (SELECT bucket, n, mu, greatest(sum(impressions * power(ctr - mu, 2)) / sum(impressions), 1e-9) AS v FROM p JOIN m USING (bucket) GROUP BY bucket, n, mu),
    k AS (SELECT *, mu * (1 - mu) / v - 1 AS w, n >= 5 AND mu > 0 AND mu < 1 AND mu * (1 - mu) / v - 1 > 0 AS fits FROM v),
    b AS (SELECT bucket, CASE WHEN fits THEN greatest(0.5, mu * w) ELSE 2.0 END AS prior_alpha, CASE WHEN fits THEN greatest(0.5, (1 - mu) * w) ELSE 48.0 END AS prior_beta FROM k),
    x AS (SELECT p.*, prior_alpha, prior_beta, prior_alpha + clicks AS a, prior_beta + impressions - clicks AS c FROM p JOIN b USING (bucket)),
    y AS (SELECT *, a / (a + c) AS posterior_mean, sqrt(a * c / (power(a + c, 2) * (a + c + 1))) AS posterior_sd FROM x),
    z AS (SELECT *, greatest(0.0, posterior_mean - 1.96 * posterior_sd) AS ci_low, least(1.0, posterior_mean + 1.96 * posterior_sd) AS ci_high FROM y)
    SELECT query, url, clicks, impressions, ctr, position, bucket, prior_alpha, prior_beta, posterior_mean, posterior_sd, ci_low, ci_high,
           (posterior_mean - ctr) * impressions AS expected_clicks_delta, abs(ctr - posterior_mean) / nullif(posterior_sd, 0) AS significance,
           CASE WHEN ctr > ci_high THEN 'overperforming' WHEN ctr < ci_low THEN 'underperforming' ELSE 'expected' END AS classification FROM z""",
    "ctr position prior_alpha prior_beta posterior_mean posterior_sd ci_low ci_high expected_clicks_delta significance",
)
add(
    "position_distribution", lambda s, d: scoring.position_distribution(facts.sparse(s, d), WHOLE),
    f"""WITH {SPARSE}, q AS ({table_sql('sparse', 'query')}), r AS (SELECT date, sum_position / impressions + 1 AS p FROM q WHERE impressions > 0 AND {inside(WHOLE)})
    SELECT date, count(*) FILTER (WHERE p <= 3) AS pos_1_3, count(*) FILTER (WHERE p > 3 AND p <= 10) AS pos_4_10, count(*) FILTER (WHERE p > 10 AND p <= 20) AS pos_11_20,
           count(*) FILTER (WHERE p > 20) AS pos_20_plus, count(*) AS total FROM r GROUP BY date""",
)
add(
    "ctr_curve", lambda s, d: scoring.ctr_curve(facts.sparse(s, d), WHOLE),
    f"""WITH {SPARSE}, q AS ({table_sql('sparse', 'query')}), r AS (SELECT *, sum_position / impressions + 1 AS p FROM q WHERE impressions > 0 AND {inside(WHOLE)})
    SELECT CASE WHEN p <= 1.5 THEN '1' WHEN p <= 2.5 THEN '2' WHEN p <= 3.5 THEN '3' WHEN p <= 5.5 THEN '4-5' WHEN p <= 10.5 THEN '6-10' WHEN p <= 20.5 THEN '11-20' ELSE '20+' END AS bucket,
           avg(clicks / impressions) AS avg_ctr, sum(sum_position) / sum(impressions) + 1 AS median_position, count(DISTINCT query) AS keyword_count,
           CAST(sum(clicks) AS DOUBLE) AS total_clicks, CAST(sum(impressions) AS DOUBLE) AS total_impressions FROM r GROUP BY 1""",
    "avg_ctr median_position",
)
add(
    "ctr_outliers", lambda s, d: scoring.ctr_outliers(facts.long(s, d), WHOLE),
    f"""WITH {LONG}, q AS (SELECT query, {FOUR} FROM long WHERE impressions > 0 AND {inside(WHOLE)} GROUP BY query HAVING sum(impressions) >= 20),
    b AS (SELECT *, CASE WHEN position <= 3.5 THEN 'top3' WHEN position <= 10.5 THEN 'page1' WHEN position <= 20.5 THEN 'page2' ELSE 'deep' END AS band FROM q),
    m AS (SELECT band, avg(ctr) AS expected_ctr FROM b GROUP BY band)
    SELECT band, query, clicks, impressions, ctr, position, expected_ctr, ctr - expected_ctr AS ctr_diff FROM b JOIN m USING (band) ORDER BY round(abs(ctr - expected_ctr), 9) DESC, query LIMIT 50""",
    "ctr position expected_ctr ctr_diff",
)


def partly_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against the pairs seen thirty times or more a day, as a search console withholds rare queries."""
    whole = facts.sparse(spark, sf_dir)
    known = whole.page_queries.where("impressions >= 30")

    class Split:
        pages, page_queries = whole.pages, known

    return scoring.dark_traffic(Split, SHORT)


add(
    "dark_traffic", partly_dark,
    f"""WITH {SPARSE}, w AS (SELECT url, CAST(sum(clicks) AS DOUBLE) AS total_clicks FROM sparse WHERE {inside(SHORT)} GROUP BY url HAVING sum(clicks) > 0),
    k AS (SELECT url, CAST(sum(clicks) AS DOUBLE) AS c, count(DISTINCT query) AS n FROM sparse WHERE impressions >= 30 AND {inside(SHORT)} GROUP BY url)
    SELECT url, total_clicks, coalesce(c, 0.0) AS attributed_clicks, total_clicks - coalesce(c, 0) AS dark_clicks, (total_clicks - coalesce(c, 0)) / total_clicks AS dark_percent,
           coalesce(n, 0) AS keyword_count FROM w LEFT JOIN k USING (url) WHERE total_clicks - coalesce(c, 0) > 0""",
    "dark_percent",
)

BREADTH = f"""WITH {SPARSE}, b AS (SELECT url, count(DISTINCT query) AS keyword_count, CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(impressions) AS DOUBLE) AS impressions
      FROM sparse WHERE impressions > 0 AND {inside(SHORT)} GROUP BY url),
    c AS (SELECT *, CASE WHEN keyword_count = 1 THEN '1' WHEN keyword_count <= 5 THEN '2-5' WHEN keyword_count <= 15 THEN '6-15' WHEN keyword_count <= 50 THEN '16-50' ELSE '50+' END AS bucket FROM b)"""
add(
    "keyword_breadth", lambda s, d: scoring.keyword_breadth(facts.sparse(s, d), SHORT),
    BREADTH + " SELECT *, keyword_count <= 2 AND clicks >= 5 AS fragile, keyword_count >= 20 AS authority FROM c",
)
add(
    "keyword_breadth_summary", lambda s, d: scoring.keyword_breadth_summary(facts.sparse(s, d), SHORT),
    BREADTH + " SELECT bucket, count(*) AS page_count, min(keyword_count) AS sort_key FROM c GROUP BY bucket",
)


def compared_sql(source: str, keys: str, now, before) -> str:
    cols = ", ".join(
        f"coalesce(CAST(sum(clicks) FILTER (WHERE {inside(p)}) AS DOUBLE), 0) AS {n}_clicks, coalesce(CAST(sum(impressions) FILTER (WHERE {inside(p)}) AS DOUBLE), 0) AS {n}_impressions, "
        f"sum(sum_position) FILTER (WHERE {inside(p)}) / nullif(sum(impressions) FILTER (WHERE {inside(p)}), 0) + 1 AS {n}_position"
        for n, p in (("now", now), ("before", before))
    )
    return f"SELECT {keys}, {cols} FROM {source} WHERE {inside(now)} OR {inside(before)} GROUP BY {keys}"


def pct_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 100.0 ELSE 0.0 END ELSE ({a} - {b}) * 100 / {b} END"


MOVERS = f"""WITH {SPARSE}, j AS (SELECT * FROM ({compared_sql('sparse', 'query, url', NOW, BEFORE)}) WHERE greatest(now_impressions, before_impressions) >= 50),
    m AS (SELECT *, now_clicks - before_clicks AS clicks_change, {pct_sql('now_clicks', 'before_clicks')} AS clicks_change_percent, now_impressions - before_impressions AS impressions_change,
            {pct_sql('now_impressions', 'before_impressions')} AS impressions_change_percent, now_position - before_position AS position_change FROM j),
    d AS (SELECT *, CASE WHEN clicks_change_percent >= 20 THEN 'rising' WHEN clicks_change_percent <= -20 THEN 'declining' ELSE 'stable' END AS direction FROM m)"""
add("movers", lambda s, d: movement.movers(facts.sparse(s, d), NOW, BEFORE), MOVERS + " SELECT * FROM d", "now_position before_position clicks_change_percent impressions_change_percent position_change")
add(
    "movers_series",
    lambda s, d: (lambda f: movement.weekly_series(f, movement.movers_top(f, NOW, BEFORE), NOW, BEFORE))(facts.sparse(s, d)),
    MOVERS + f""", top AS (SELECT query, url FROM d WHERE direction <> 'stable' ORDER BY abs(clicks_change) DESC, query, url LIMIT 2000)
    SELECT query, url, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(impressions) AS DOUBLE) AS impressions
    FROM sparse JOIN top USING (query, url) WHERE {inside(NOW)} OR {inside(BEFORE)} GROUP BY ALL""",
)
add(
    "decay", lambda s, d: movement.decay(facts.sparse(s, d), NOW, BEFORE),
    f"""WITH {SPARSE}, j AS ({compared_sql('sparse', 'url', NOW, BEFORE)})
    SELECT url, now_clicks, before_clicks, before_clicks - now_clicks AS lost_clicks, (before_clicks - now_clicks) / before_clicks AS decline_percent, now_position, before_position,
           now_position - before_position AS position_drop FROM j WHERE before_clicks >= 50 AND before_clicks - now_clicks > 0 AND (before_clicks - now_clicks) / before_clicks >= 0.2""",
    "decline_percent now_position before_position position_drop",
)
add(
    "trends", lambda s, d: movement.trends(facts.sparse(s, d), HALF_YEAR),
    f"""WITH {SPARSE}, w AS (SELECT url AS entity, CAST(date_trunc('week', date) AS DATE) AS week, sum(clicks) AS c, sum(impressions) AS m, sum(sum_position) AS sp FROM sparse WHERE {inside(HALF_YEAR)} GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM w),
    a AS (SELECT entity, CAST(sum(c) AS DOUBLE) AS total_clicks, CAST(sum(m) AS DOUBLE) AS total_impressions, max(n) AS weeks, coalesce(regr_slope(c, i), 0) AS slope,
            sum(CASE WHEN i < n / 2 THEN c ELSE 0 END) AS early, sum(CASE WHEN i < n / 2 THEN 0 ELSE c END) AS late, sum(sp) / sum(m) + 1 AS avg_position
          FROM i GROUP BY entity HAVING sum(m) >= 100 AND max(n) >= 7),
    g AS (SELECT entity, total_clicks, total_impressions, weeks, slope, CASE WHEN early = 0 THEN CASE WHEN late > 0 THEN 10.0 ELSE 1.0 END ELSE late / early END AS growth_ratio, avg_position FROM a)
    SELECT *, CASE WHEN growth_ratio >= 1.5 AND slope > 0 THEN 'accelerating' WHEN growth_ratio >= 1.1 AND slope >= 0 THEN 'growing' WHEN growth_ratio < 0.5 THEN 'cratering'
           WHEN growth_ratio < 0.9 AND slope < 0 THEN 'declining' ELSE 'steady' END AS trend FROM g""",
    "slope growth_ratio avg_position",
)
add(
    "query_migration", lambda s, d: movement.query_migration(facts.sparse(s, d), NOW, BEFORE),
    f"""WITH {SPARSE}, c AS ({pair_sql('sparse', NOW, 20)}), p AS ({pair_sql('sparse', BEFORE, 20)}),
    l AS (SELECT * FROM p ANTI JOIN c USING (query, url)), g AS (SELECT * FROM c ANTI JOIN p USING (query, url))
    SELECT l.url AS source, g.url AS target, sum(least(l.impressions, g.impressions)) AS weight, count(*) AS query_count, count(*) FILTER (WHERE l.query = g.query) AS exact_count
    FROM l JOIN g ON l.url <> g.url AND levenshtein(l.query, g.query) <= 2 GROUP BY ALL""",
)
add(
    "content_velocity", lambda s, d: movement.content_velocity(facts.long(s, d), SHORT),
    f"""WITH {LONG}, q AS (SELECT DISTINCT query, date FROM long WHERE impressions > 0 AND {inside(SHORT)}), f AS (SELECT query, min(date) AS date FROM q GROUP BY query),
    t AS (SELECT strftime(date, '%G-W%V') AS week, count(DISTINCT query) AS total_keywords FROM q GROUP BY 1), n AS (SELECT strftime(date, '%G-W%V') AS week, count(*) AS n FROM f GROUP BY 1)
    SELECT week, coalesce(n, 0) AS new_keywords, total_keywords FROM t LEFT JOIN n USING (week)""",
)
add(
    "seasonality", lambda s, d: series.seasonality(facts.sparse(s, d), WHOLE),
    f"""WITH {SPARSE}, m AS (SELECT strftime(date, '%Y-%m') AS month, CAST(sum(clicks) AS DOUBLE) AS value FROM sparse WHERE {inside(WHOLE)} GROUP BY 1),
    s AS (SELECT avg(value) AS a, stddev_pop(value) AS sd, count(*) AS month_count FROM m)
    SELECT month, value, value / a AS vs_average, value / a > 1.5 AS is_peak, value / a < 0.5 AS is_trough, least(sd / a, 1.0) AS strength, month_count FROM m, s""",
    "vs_average strength",
)

DAYS = f"SELECT query, url, date, {FOUR} FROM dense WHERE {inside(MONTH)} AND query <> '' AND url <> '' GROUP BY query, url, date"
BREACH = f"""WITH {DENSE}, d AS (SELECT * FROM ({DAYS}) WHERE impressions >= 5),
    r AS (SELECT *, avg(ctr) OVER w AS rolling_ctr, stddev_pop(ctr) OVER w AS rolling_sd, sum(position * impressions) OVER w / sum(impressions) OVER w AS rolling_position, count(*) OVER w AS rolling_n
          FROM d WINDOW w AS (PARTITION BY query, url ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, CASE WHEN rolling_n >= 14 AND rolling_sd > 0 THEN (ctr - rolling_ctr) / rolling_sd ELSE 0.0 END AS z, coalesce(abs(position - rolling_position), 0.0) AS shift FROM r),
    b AS (SELECT *, rolling_n >= 14 AND abs(z) >= 2 AND shift <= 1.5 AS breach FROM z)"""
add("ctr_breaches", lambda s, d: series.ctr_breaches(facts.dense(s, d), MONTH), BREACH + " SELECT * FROM b", "ctr position rolling_ctr rolling_sd rolling_position z shift")
add(
    "ctr_anomaly", lambda s, d: series.ctr_anomaly(facts.dense(s, d), MONTH, days=1),
    BREACH + """ SELECT query, url, count(*) FILTER (WHERE breach AND z < 0) AS breach_days_down, count(*) FILTER (WHERE breach AND z > 0) AS breach_days_up,
           round(sum(CASE WHEN breach AND z < 0 THEN (rolling_ctr - ctr) * impressions ELSE 0 END)) AS clicks_lost, sum(CASE WHEN breach AND z < 0 THEN abs(z) * impressions ELSE 0 END) AS severity,
           max(CASE WHEN breach THEN abs(z) ELSE 0 END) AS max_z, avg(rolling_ctr) FILTER (WHERE rolling_n >= 14) AS baseline_ctr,
           sum(rolling_position * impressions) FILTER (WHERE rolling_n >= 14) / sum(impressions) FILTER (WHERE rolling_n >= 14) AS baseline_position,
           sum(impressions) AS total_impressions, sum(clicks) AS total_clicks FROM b GROUP BY query, url HAVING count(*) FILTER (WHERE breach AND z < 0) >= 1""",
    "severity max_z baseline_ctr baseline_position",
)
add(
    "position_volatility", lambda s, d: series.position_volatility(facts.dense(s, d), MONTH),
    f"""WITH {DENSE}, q AS (SELECT * FROM ({DAYS}) WHERE impressions >= 1),
    d AS (SELECT url, date, count(*) AS query_count, sum(impressions) AS day_impressions, sum(position * impressions) / sum(impressions) AS avg_position, stddev_pop(position) AS pos_sd,
            min(position) AS best_position, max(position) AS worst_position FROM q GROUP BY url, date HAVING sum(impressions) >= 10),
    s AS (SELECT *, coalesce(abs(avg_position - lag(avg_position) OVER (PARTITION BY url ORDER BY date)), 0) AS shift FROM d), v AS (SELECT *, pos_sd + shift AS volatility FROM s),
    t AS (SELECT url, avg(volatility) AS page_volatility, max(volatility) AS page_peak, sum(day_impressions) AS page_impressions FROM v GROUP BY url HAVING count(*) >= 7 ORDER BY round(avg(volatility), 9) DESC, url LIMIT 30)
    SELECT * FROM v JOIN t USING (url)""",
    "avg_position pos_sd best_position worst_position shift volatility page_volatility page_peak",
)
STL = f"""WITH {DENSE}, d AS ({DAYS}), k AS (SELECT *, clicks AS observed FROM d QUALIFY count(*) OVER (PARTITION BY query, url) >= 21 AND sum(impressions) OVER (PARTITION BY query, url) >= 100),
    t AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(observed) OVER w END AS trend FROM k WINDOW w AS (PARTITION BY query, url ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    e AS (SELECT *, observed - trend AS detrended FROM t), s AS (SELECT *, avg(detrended) OVER (PARTITION BY query, url, dayofweek(date)) AS raw FROM e),
    c AS (SELECT * EXCLUDE (raw), raw - avg(raw) OVER (PARTITION BY query, url) AS seasonal FROM s), r AS (SELECT *, observed - trend - seasonal AS residual FROM c),
    a AS (SELECT *, coalesce(stddev_pop(residual) OVER (PARTITION BY query, url) > 0 AND abs(residual) > 2 * stddev_pop(residual) OVER (PARTITION BY query, url), false) AS anomaly FROM r)"""
add("stl_days", lambda s, d: series.stl_days(facts.dense(s, d), MONTH), STL + " SELECT * FROM a", "ctr position trend detrended seasonal residual")
add(
    "stl_decompose", lambda s, d: series.stl_decompose(facts.dense(s, d), MONTH),
    STL + """, g AS (SELECT query, url, sum(impressions) AS total_impressions, count(*) AS days, var_pop(detrended) AS vd, var_pop(seasonal) AS vs, var_pop(residual) AS vr,
            count(*) FILTER (WHERE anomaly) AS residual_anomalies, regr_slope(observed, date_diff('day', DATE '1970-01-01', date)) AS slope FROM a GROUP BY query, url)
    SELECT query, url, total_impressions, days, CASE WHEN coalesce(vd, 0) = 0 THEN 0.0 ELSE least(vs / vd, 1.0) END AS seasonal_strength,
           CASE WHEN coalesce(vd, 0) = 0 THEN 0.0 ELSE greatest(0.0, 1 - vr / vd) END AS trend_strength, residual_anomalies, coalesce(slope, 0) AS trend_slope FROM g""",
    "seasonal_strength trend_strength trend_slope",
)
for metric, (x, w) in {"position": ("position", "impressions"), "clicks": ("clicks", "1.0")}.items():
    add(
        f"change_point_{metric}", lambda s, d, metric=metric: series.change_point(facts.dense(s, d), MONTH, metric, threshold=2.0),
        f"""WITH {DENSE}, d AS (SELECT query, url, date, impressions, {x} AS x, {w} AS w FROM ({DAYS}) WHERE impressions >= 1),
        c AS (SELECT query, url, date, sum(impressions) OVER e AS total_impressions, count(*) OVER e AS n, sum(w) OVER e AS wa, sum(x * w) OVER e AS sa, sum(x * x * w) OVER e AS qa,
                count(*) OVER l AS nl, sum(w) OVER l AS wl, sum(x * w) OVER l AS sl, sum(x * x * w) OVER l AS ql
              FROM d WINDOW e AS (PARTITION BY query, url), l AS (PARTITION BY query, url ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        v AS (SELECT *, sl / wl AS ml, (sa - sl) / nullif(wa - wl, 0) AS mr, greatest(qa / wa - (sa / wa) * (sa / wa), 1e-9) AS va, greatest(ql / wl - (sl / wl) * (sl / wl), 1e-9) AS vl,
                greatest((qa - ql) / nullif(wa - wl, 0) - ((sa - sl) / nullif(wa - wl, 0)) * ((sa - sl) / nullif(wa - wl, 0)), 1e-9) AS vr
              FROM c WHERE n >= 21 AND total_impressions >= 100 AND nl >= 7 AND n - nl >= 7),
        r AS (SELECT *, round(n * ln(va) - nl * ln(vl) - (n - nl) * ln(vr), 6) AS llr FROM v),
        b AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY llr DESC, date) AS place FROM r)
        SELECT query, url, n AS total_days, total_impressions, date AS change_date, llr, ml AS left_mean, mr AS right_mean, sqrt(vl) AS left_sd, sqrt(vr) AS right_sd FROM b WHERE place = 1 AND llr > 2""",
        "left_mean right_mean left_sd right_sd",
    )
STAYS = f"""WITH {DENSE}, d AS (SELECT *, position <= 10 AS inside FROM ({DAYS}) WHERE impressions >= 5),
    e AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY query, url ORDER BY date), false) THEN 1 ELSE 0 END AS entry FROM d),
    r AS (SELECT *, sum(entry) OVER (PARTITION BY query, url ORDER BY date) AS run FROM e WHERE inside),
    s AS (SELECT query, url, min(date) AS entry_date, max(date) AS exit_date, date_diff('day', min(date), max(date)) + 1 AS tenure, max(date) >= (SELECT max(date) - 2 FROM d) AS censored,
            coalesce(nullif(split_part(url, '/', 2), ''), 'home') AS cohort FROM r GROUP BY query, url, run)"""
add("survival_episodes", lambda s, d: series.episodes(facts.dense(s, d), MONTH), STAYS + " SELECT * FROM s")
add(
    "survival", lambda s, d: series.survival(facts.dense(s, d), MONTH),
    STAYS + """, a AS (SELECT tenure, censored, cohort FROM s UNION ALL SELECT tenure, censored, '__all__' FROM s),
    t AS (SELECT cohort, tenure, count(*) FILTER (WHERE NOT censored) AS events, count(*) AS n FROM a GROUP BY ALL),
    k AS (SELECT cohort, tenure, events, CAST(sum(n) OVER (PARTITION BY cohort ORDER BY tenure DESC) AS BIGINT) AS at_risk FROM t)
    SELECT *, exp(sum(ln(greatest(1 - events / at_risk, 1e-9))) OVER (PARTITION BY cohort ORDER BY tenure)) AS survival FROM k""",
    "survival",
)

DEVICE = LINES + ", dv AS (SELECT date, CASE l_returnflag WHEN 'A' THEN 'DESKTOP' WHEN 'N' THEN 'MOBILE' ELSE 'TABLET' END AS device, " + FOUR + f" FROM lines WHERE {inside(SHORT)} GROUP BY ALL)"
add(
    "device_gap", lambda s, d: series.device_gap(facts.device_dates(s, d), SHORT),
    f"""WITH {DEVICE}, g AS (SELECT date, device FROM (SELECT DISTINCT date FROM dv), (VALUES ('DESKTOP'), ('MOBILE'), ('TABLET')) v(device))
    SELECT date, device, coalesce(clicks, 0.0) AS clicks, coalesce(impressions, 0.0) AS impressions, ctr, position FROM g LEFT JOIN dv USING (date, device)""",
    "ctr position",
)
add(
    "device_gap_days", lambda s, d: series.device_gap_days(facts.device_dates(s, d), SHORT),
    f"""WITH {DEVICE} SELECT date, coalesce(max(ctr) FILTER (WHERE device = 'DESKTOP'), 0) - coalesce(max(ctr) FILTER (WHERE device = 'MOBILE'), 0) AS ctr_gap,
           coalesce(max(position) FILTER (WHERE device = 'MOBILE'), 0) - coalesce(max(position) FILTER (WHERE device = 'DESKTOP'), 0) AS position_gap FROM dv GROUP BY date""",
    "ctr_gap position_gap",
)
TRACK = ("1996-01-01", "1997-03-31")
ROLL = f"""WITH {SPARSE}, k AS (SELECT date, CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(impressions) AS DOUBLE) AS impressions FROM sparse WHERE {inside(TRACK)} GROUP BY date),
    f AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM k),
    d AS (SELECT date, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, row_number() OVER (ORDER BY date) - 1 AS i FROM f LEFT JOIN k USING (date)),
    c AS (SELECT *, least(clicks, greatest(3 * median(clicks) OVER w, 3)) AS clicks_cut, least(impressions, greatest(3 * median(impressions) OVER w, 3)) AS impressions_cut
          FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
    r AS (SELECT *, CASE WHEN i >= 6 THEN sum(clicks) OVER w END AS clicks_week, CASE WHEN i >= 6 THEN sum(clicks_cut) OVER w END AS clicks_cut_week,
            CASE WHEN i >= 6 THEN sum(impressions) OVER w END AS impressions_week, CASE WHEN i >= 6 THEN sum(impressions_cut) OVER w END AS impressions_cut_week
          FROM c WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
add(
    "trajectory_weeks", lambda s, d: series.rolling_weeks(scoring.during(facts.sparse(s, d).page_queries, TRACK)), ROLL + " SELECT * FROM r",
    "clicks_cut impressions_cut clicks_week clicks_cut_week impressions_week impressions_cut_week",
)
add("trajectory", lambda s, d: series.trajectory(scoring.during(facts.sparse(s, d).page_queries, TRACK)), None)


def pagerank_sql(rounds: int = graph.ROUNDS) -> str:
    steps = "".join(
        f""", r{k + 1} AS (SELECT f.to_kind AS kind, f.t AS node, {1 - graph.DAMPING} / max(n) + {graph.DAMPING} * sum(share * rank) AS rank
        FROM flow f JOIN r{k} r ON r.kind = f.kind AND r.node = f.node GROUP BY f.to_kind, f.t)"""
        for k in range(rounds)
    )
    return f"""WITH {SPARSE}, e AS MATERIALIZED (SELECT query AS q, url AS u, CAST(sum(impressions) AS DOUBLE) AS w FROM sparse WHERE {inside(WHOLE)} GROUP BY ALL HAVING sum(impressions) >= 50),
    b AS (SELECT 'query' AS kind, q AS node, 'url' AS to_kind, u AS t, w FROM e UNION ALL SELECT 'url', u, 'query', q, w FROM e),
    n AS MATERIALIZED (SELECT kind, node, sum(w) AS total, count(*) AS degree FROM b GROUP BY ALL), c AS (SELECT kind, count(*) AS n FROM n GROUP BY kind),
    flow AS MATERIALIZED (SELECT b.kind, b.node, b.to_kind, b.t, w / total AS share, c.n FROM b JOIN n USING (kind, node) JOIN c ON c.kind = b.to_kind),
    r0 AS (SELECT kind, node, 1.0 / c.n AS rank FROM n JOIN c USING (kind)){steps.replace('AS (SELECT f.to_kind', 'AS MATERIALIZED (SELECT f.to_kind')},
    s AS (SELECT kind, node, count(*) FILTER (WHERE share >= {graph.STRONG}) AS strong FROM flow GROUP BY ALL)
    SELECT kind, node, rank, total, degree, strong FROM n JOIN r{rounds} USING (kind, node) JOIN s USING (kind, node)"""


add("bipartite_pagerank", lambda s, d: graph.bipartite_pagerank(facts.sparse(s, d), WHOLE), pagerank_sql(), "rank")

# What stands behind the rows of an analyzer.
add(
    "cluster_members", lambda s, d: details.cluster_members(facts.long(s, d), WHOLE),
    f"""WITH {LONG}, q AS (SELECT query, {FOUR} FROM long WHERE {inside(WHOLE)} GROUP BY query HAVING sum(impressions) >= 10),
    k AS (SELECT *, nullif(regexp_extract(lower(query), '^({'|'.join(INTENT_PREFIXES)})(\\s|$)', 1), '') AS intent, string_split_regex(lower(query), '\\s+') AS w FROM q),
    n AS (SELECT *, coalesce(intent, CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] END) AS cluster FROM k)
    SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY impressions DESC, query) AS INTEGER) AS rank, query, impressions, clicks, position FROM n
    WHERE cluster IS NOT NULL QUALIFY count(*) OVER (PARTITION BY cluster) >= 2""",
    "position",
)
add(
    "atlas_members", lambda s, d: details.atlas_members(facts.long(s, d), WHOLE),
    f"""WITH {LONG}, q AS (SELECT query, {FOUR} FROM long WHERE {inside(WHOLE)} AND query <> '' GROUP BY query HAVING sum(impressions) >= 20),
    t AS (SELECT query, impressions, unnest(string_split_regex(lower(query), '\\s+')) AS token FROM q),
    k AS (SELECT * FROM t WHERE length(token) >= 3 AND token NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
    w AS (SELECT token, sum(impressions) AS weight FROM k GROUP BY token HAVING sum(impressions) >= 50),
    o AS (SELECT query, token, row_number() OVER (PARTITION BY query ORDER BY weight DESC, token) AS n FROM k JOIN w USING (token)),
    c AS (SELECT query, string_agg(token, ' + ' ORDER BY token) AS cluster FROM o WHERE n <= 2 GROUP BY query HAVING count(*) >= 2),
    r AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY impressions DESC, query) AS INTEGER) AS rank, query, impressions, clicks, position, count(*) OVER (PARTITION BY cluster) AS n FROM q JOIN c USING (query))
    SELECT cluster, rank, query, impressions, clicks, position FROM r WHERE n >= 3 AND rank <= 25""",
    "position",
)
add(
    "long_tail_points", lambda s, d: details.long_tail_points(facts.long(s, d), WHOLE, least=1, fewest=4),
    f"""WITH RECURSIVE {LONG}, g AS (SELECT 1 AS k, CAST(11 AS BIGINT) AS rank UNION ALL SELECT k + 1, greatest(rank + 1, CAST(ceil(power(1.15, k + 1)) AS BIGINT)) FROM g WHERE rank < 100000),
    p AS ({pair_sql('long', WHOLE, 1)}), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY impressions DESC, query) AS rank, count(*) OVER (PARTITION BY url) AS n FROM p WHERE query <> '' AND url <> '')
    SELECT url, CAST(rank AS INTEGER) AS rank, query, impressions, clicks FROM r WHERE n >= 4 AND (n <= 80 OR rank <= 10 OR rank IN (SELECT rank FROM g))""",
)
add(
    "decay_series", lambda s, d: details.decay_series(facts.sparse(s, d), NOW, BEFORE),
    f"""WITH {SPARSE}, j AS ({compared_sql('sparse', 'url', NOW, BEFORE)}), k AS (SELECT url FROM j WHERE before_clicks >= 50 AND before_clicks - now_clicks > 0 AND (before_clicks - now_clicks) / before_clicks >= 0.2)
    SELECT url, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(clicks) AS DOUBLE) AS clicks, CAST(sum(impressions) AS DOUBLE) AS impressions
    FROM sparse JOIN k USING (url) WHERE {inside(NOW)} OR {inside(BEFORE)} GROUP BY ALL""",
)
add(
    "ctr_anomaly_series", lambda s, d: details.ctr_anomaly_series(facts.dense(s, d), MONTH, days=1),
    BREACH + """, a AS (SELECT query, url FROM b GROUP BY query, url HAVING count(*) FILTER (WHERE breach AND z < 0) >= 1)
    SELECT query, url, date, ctr, position, impressions, rolling_ctr, rolling_sd, z, breach AND z < 0 AS breach FROM b JOIN a USING (query, url)""",
    "ctr position rolling_ctr rolling_sd z",
)
add(
    "ctr_sides", lambda s, d: details.ctr_sides(facts.long(s, d), WHOLE),
    f"""SELECT *, CASE WHEN ctr_diff > 0 THEN 'over' ELSE 'under' END AS side, CAST(row_number() OVER (PARTITION BY ctr_diff > 0 ORDER BY abs(ctr_diff) DESC, query) AS INTEGER) AS rank
    FROM ({SQL['ctr_outliers'].replace('round(ctr_diff, 6) + 0.0 AS ctr_diff', 'round(ctr_diff, 9) AS ctr_diff')}) WHERE ctr_diff <> 0 QUALIFY rank <= 25""",
    "ctr_diff",
)
add(
    "breadth_lists", lambda s, d: details.breadth_lists(facts.sparse(s, d), SHORT),
    BREADTH + """ SELECT * FROM (SELECT 'fragile' AS list, CAST(row_number() OVER (ORDER BY clicks DESC, url) AS INTEGER) AS rank, url, keyword_count, clicks, impressions FROM c WHERE keyword_count <= 2 AND clicks >= 5) WHERE rank <= 20
    UNION ALL SELECT * FROM (SELECT 'authority', CAST(row_number() OVER (ORDER BY keyword_count DESC, url) AS INTEGER) AS rank, url, keyword_count, clicks, impressions FROM c WHERE keyword_count >= 20) WHERE rank <= 20""",
)
add(
    "breadth_stats", lambda s, d: details.breadth_stats(facts.sparse(s, d), SHORT),
    BREADTH + " SELECT count(*) AS total_pages, avg(keyword_count) AS avg_keywords, count(*) FILTER (WHERE keyword_count <= 2) AS fragile_count, count(*) FILTER (WHERE keyword_count >= 20) AS authority_count FROM c",
    "avg_keywords",
)
add(
    "movers_page", lambda s, d: details.sorted_page(movement.movers(facts.sparse(s, d), NOW, BEFORE), ("clicks_change", "now_impressions"), ("clicks_change", "desc"), "now_impressions", "desc", 50, 10, ("query", "url")),
    MOVERS + " SELECT * FROM d ORDER BY now_impressions DESC, query, url LIMIT 50 OFFSET 10", "now_position before_position clicks_change_percent impressions_change_percent position_change",
)
add(
    "pagerank_deltas", lambda s, d: graph.pagerank_deltas(facts.sparse(s, d), WHOLE),
    pagerank_sql().split(""",
    s AS (SELECT""")[0] + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k + 1} AS step, sum(abs(b.rank - a.rank)) AS l1 FROM r{k} a JOIN r{k + 1} b USING (kind, node)" for k in range(graph.ROUNDS)) + ")",
    "l1",
)
