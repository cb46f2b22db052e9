"""Builder, comparison and archetype reads as queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analyzer_queries import BEFORE, FOUR, LINES, LONG, NOW, SHORT, SPARSE, Query, inside, rounded, table_sql, tidy
from .functions.text import query_dim
from .plans import archetypes as A
from .plans import compare as C
from .plans import planner as P
from .plans.spec import between, contains, eq, gte, in_array, like, lte, not_, or_, regex, select, top_level
from .sources import facts

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RATIOS = "ctr position"


def lake(spark: SparkSession, sf_dir: str) -> P.Lake:
    f = facts.sparse(spark, sf_dir)
    words = F.regexp_replace(F.col("query"), "e", "")  # a canonical form that SQL can give too
    dim = f.page_queries.select("query").distinct().withColumn("query_canonical", F.split(words, " ")[0])
    tables = {
        "page_queries": f.page_queries, "queries": f.queries, "pages": f.pages, "dates": facts.device_dates(spark, sf_dir),
        "countries": facts.countries(spark, sf_dir), "search_appearance": facts.search_appearance(spark, sf_dir),
    }
    return P.Lake(tables, dim)


DIM = "dim AS (SELECT DISTINCT query, split_part(replace(query, 'e', ''), ' ', 1) AS query_canonical FROM sparse)"


def add(name: str, made, sql: str | None, doubles: str = RATIOS) -> None:
    QUERIES[name] = lambda spark, d: rounded(made(lake(spark, d)))
    if sql:
        SQL[name] = tidy(sql, doubles) if doubles else sql


during = lambda p: between("date", *p)

add(
    "plan_breakdown",
    lambda k: P.run(k, select("page", "query").where(during(SHORT), gte("impressions", 40), lte("position", 16.5), contains("page", "brand-1")).order_by("impressions").limit(300).spec),
    f"""WITH {SPARSE} SELECT url AS page, query, {FOUR} FROM sparse WHERE {inside(SHORT)} AND contains(url, 'brand-1') GROUP BY url, query
    HAVING sum(impressions) >= 40 AND sum(sum_position) / sum(impressions) + 1 <= 16.5 ORDER BY impressions DESC, page, query LIMIT 300""",
)
add(
    "plan_filter_tree",
    lambda k: P.run(
        k, select("query", "clicks", "ctr").where(during(SHORT), or_(contains("query", "red"), regex("query", "^b.*e")), not_(eq("query", "blue"))).prefilter(gte("impressions", 10)).order_by("position", "asc").limit(40).spec
    ),
    f"""WITH {SPARSE}, q AS ({table_sql('sparse', 'query')}), a AS (SELECT query, {FOUR} FROM q WHERE {inside(SHORT)} AND (contains(query, 'red') OR regexp_matches(query, '^b.*e')) AND query <> 'blue'
      AND impressions >= 10 GROUP BY query) SELECT query, clicks, ctr FROM a ORDER BY position, query LIMIT 40""",
    "ctr",
)
add(
    "plan_paged_days", lambda k: P.run(k, select("date").where(during(SHORT)).order_by("clicks").limit(50).offset(25).spec),
    f"WITH {LINES} SELECT date, {FOUR} FROM lines WHERE {inside(SHORT)} GROUP BY date ORDER BY clicks DESC, date LIMIT 50 OFFSET 25",
)
add(
    "plan_countries", lambda k: P.run(k, select("country").where(during(SHORT), in_array("country", ["nation_3", "nation_7", "nation_19"])).spec),
    f"""WITH {LINES} SELECT lower(n_name) AS country, {FOUR} FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE {inside(SHORT)} AND lower(n_name) IN ('nation_3', 'nation_7', 'nation_19') GROUP BY 1""",
)
add(
    "plan_search_appearance", lambda k: P.run(k, select("searchAppearance").where(during(SHORT)).spec),
    f"WITH {LINES} SELECT o_orderpriority AS searchAppearance, {FOUR} FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE {inside(SHORT)} GROUP BY 1",
)
add(
    "plan_like_and_top_level", lambda k: P.run(k, select("page").where(during(SHORT), like("page", "st%rd_")).limit(200).spec).unionAll(P.run(k, select("page").where(during(SHORT), top_level()).spec)),
    f"WITH {SPARSE} SELECT url AS page, {FOUR} FROM sparse WHERE {inside(SHORT)} AND regexp_matches(url, 'st.*rd.') GROUP BY url ORDER BY clicks DESC, page LIMIT 200",
)
add(
    "plan_with_totals", lambda k: P.with_totals(k, select("query").where(during(SHORT), gte("clicks", 5)).limit(30).spec),
    f"""WITH {SPARSE}, g AS (SELECT query, {FOUR}, sum(sum_position) AS sp FROM sparse WHERE {inside(SHORT)} GROUP BY query HAVING sum(clicks) >= 5),
    t AS (SELECT sum(clicks) AS total_clicks, sum(impressions) AS total_impressions, sum(clicks) / sum(impressions) AS total_ctr, sum(sp) / sum(impressions) + 1 AS total_position, count(*) AS total_count FROM g)
    SELECT query, clicks, impressions, ctr, position, t.* FROM g, t ORDER BY clicks DESC, query LIMIT 30""",
    "ctr position total_ctr total_position",
)
add(
    "plan_canonical", lambda k: P.run(k, select("queryCanonical").where(during(SHORT)).limit(60).spec),
    f"""WITH {SPARSE}, {DIM} SELECT query_canonical AS queryCanonical, {FOUR} FROM sparse JOIN dim USING (query) WHERE {inside(SHORT)} GROUP BY 1 ORDER BY clicks DESC, 1 LIMIT 60""",
)
add(
    "plan_canonical_variants", lambda k: P.canonical_variants(k, select("queryCanonical").where(during(SHORT)).limit(60).spec),
    f"""WITH {SPARSE}, {DIM}, v AS (SELECT query_canonical AS queryCanonical, query, sum(clicks) AS c, sum(impressions) AS i, sum(sum_position) / sum(impressions) + 1 AS p FROM sparse JOIN dim USING (query) WHERE {inside(SHORT)} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY queryCanonical ORDER BY c DESC, query) AS rn FROM v)
    SELECT queryCanonical, CAST(count(*) AS INTEGER) AS variant_count, (array_agg(query ORDER BY rn))[1] AS canonical_name,
      string_agg(query || ':::' || CAST(CAST(c AS BIGINT) AS VARCHAR) || ':::' || CAST(CAST(i AS BIGINT) AS VARCHAR) || ':::' || CAST(round(p, 1) AS VARCHAR), '||' ORDER BY rn) FILTER (WHERE rn <= 10) AS variants
    FROM r GROUP BY 1""",
    "",
)
TYPED = "typed AS (SELECT *, CASE WHEN length(url) % 3 = 0 THEN 'image' ELSE 'web' END AS search_type FROM sparse)"


def typed(k: P.Lake) -> P.Lake:
    """The lake with a search type for each address."""
    pq = k.tables["page_queries"].withColumn("search_type", F.when(F.length("url") % 3 == 0, "image").otherwise("web"))
    sums = [F.sum(m).alias(m) for m in ("clicks", "impressions", "sum_position")]
    return P.Lake({"page_queries": pq, "pages": pq, "queries": pq.groupBy("query", "date", "search_type").agg(*sums)}, k.query_dim)


add(
    "plan_search_type", lambda k: P.run(typed(k), select("page").where(during(SHORT), eq("searchType", "image")).limit(200).spec),
    f"WITH {SPARSE}, {TYPED} SELECT url AS page, {FOUR} FROM typed WHERE {inside(SHORT)} AND search_type = 'image' GROUP BY url ORDER BY clicks DESC, page LIMIT 200",
)
add(
    "plan_canonical_of_search_type", lambda k: P.canonical_variants(typed(k), select("queryCanonical").where(during(SHORT), eq("searchType", "web")).limit(60).spec).drop("variants"),
    f"""WITH {SPARSE}, {TYPED}, {DIM}, v AS (SELECT query_canonical AS queryCanonical, query, sum(clicks) AS c FROM typed JOIN dim USING (query) WHERE {inside(SHORT)} AND search_type = 'web' GROUP BY ALL)
    SELECT queryCanonical, CAST(count(*) AS INTEGER) AS variant_count, (array_agg(query ORDER BY c DESC, query))[1] AS canonical_name FROM v GROUP BY 1""",
    "",
)
add(
    "plan_or_of_groups", lambda k: P.run(k, select("page", "query").where(during(SHORT), or_(gte("clicks", 9), lte("position", 9.5))).limit(5000).spec),
    f"""WITH {SPARSE} SELECT url AS page, query, {FOUR} FROM sparse WHERE {inside(SHORT)} GROUP BY url, query
    HAVING sum(clicks) >= 9 OR sum(sum_position) / sum(impressions) + 1 <= 9.5 ORDER BY clicks DESC, page, query LIMIT 5000""",
)
add(
    "plan_detail_padded", lambda k: P.detail(k, select().where(during(("1997-01-01", "1997-06-30")), contains("query", "red")).spec),
    f"""WITH {SPARSE}, d AS (SELECT date, {FOUR} FROM sparse WHERE {inside(('1997-01-01', '1997-06-30'))} AND contains(query, 'red') GROUP BY date),
    c AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-06-30', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT date, coalesce(clicks, 0.0) AS clicks, coalesce(impressions, 0.0) AS impressions, coalesce(ctr, 0.0) AS ctr, coalesce(position, 0.0) AS position FROM c LEFT JOIN d USING (date)""",
)

ALL_BOTH = ", ".join(f"coalesce(c.{m}, 0) AS {m}" for m in ("clicks", "impressions", "ctr", "position")) + ", " + ", ".join(f"coalesce(p.{m}, 0) AS prev{m.title()}" for m in ("clicks", "impressions", "ctr", "position"))


def both_sql(source: str, key: str, name: str, where: str = "true", having: str = "", now: tuple[str, str] = NOW, before: tuple[str, str] = BEFORE) -> str:
    side = lambda p, h: f"SELECT {key} AS k, {FOUR} FROM {source} WHERE {inside(p)} AND {where} GROUP BY 1 {h}"
    return f"SELECT coalesce(c.k, p.k) AS {name}, {ALL_BOTH} FROM ({side(now, having)}) c FULL JOIN ({side(before, '')}) p ON c.k = p.k"


TWO = "ctr position prevCtr prevPosition"
now_spec, before_spec = select("query").where(during(NOW), gte("clicks", 60)).limit(40).spec, select("query").where(during(BEFORE)).spec
add("plan_comparison", lambda k: C.comparison(k, now_spec, before_spec), f"WITH {SPARSE} {both_sql('sparse', 'query', 'query', having='HAVING sum(clicks) >= 60')} ORDER BY clicks DESC, query LIMIT 40", TWO)
add(
    "plan_comparison_declining", lambda k: C.comparison(k, select("page").where(during(NOW)).limit(30).spec, select("page").where(during(BEFORE)).spec, "declining", "asc"),
    f"WITH {SPARSE}, b AS ({both_sql('sparse', 'url', 'page')}) SELECT *, clicks - prevClicks AS clicksChange FROM b WHERE clicks < prevClicks AND prevClicks > 0 ORDER BY clicksChange, page LIMIT 30", TWO,
)
for kind, where in {"new": "prevImpressions = 0 AND impressions > 0", "lost": "prevImpressions > 0 AND impressions = 0", "improving": "clicks > prevClicks"}.items():
    add(
        f"plan_comparison_{kind}_count", lambda k, kind=kind: C.comparison_count(k, select("page", "query").where(during(NOW)).spec, select("page", "query").where(during(BEFORE)).spec, kind),
        f"WITH {SPARSE}, b AS ({both_sql('sparse', '(url, query)', 'pair')}) SELECT count(*) AS total FROM b WHERE {where}", "",
    )
OVERLAP = ("1997-07-01", "1998-06-30")
add(
    "plan_comparison_totals", lambda k: C.comparison_totals(k, select("page").where(during(NOW)).spec, select("page").where(during(OVERLAP)).spec),
    f"WITH {SPARSE} SELECT " + ", ".join(
        f"CAST(sum(clicks) FILTER (WHERE {inside(p)}) AS DOUBLE) AS {n}Clicks, CAST(sum(impressions) FILTER (WHERE {inside(p)}) AS DOUBLE) AS {n}Impressions, "
        f"sum(clicks) FILTER (WHERE {inside(p)}) / sum(impressions) FILTER (WHERE {inside(p)}) AS {n}Ctr, sum(sum_position) FILTER (WHERE {inside(p)}) / sum(impressions) FILTER (WHERE {inside(p)}) + 1 AS {n}Position"
        for n, p in (("total", NOW), ("prevTotal", OVERLAP))
    ) + " FROM sparse", "totalCtr totalPosition prevTotalCtr prevTotalPosition",
)

add("arch_site_daily", lambda k: A.site_daily_timeseries(k, SHORT), f"WITH {LINES} SELECT date, {FOUR} FROM lines WHERE {inside(SHORT)} GROUP BY date")
add(
    "arch_site_daily_facet", lambda k: A.site_daily_timeseries(k, SHORT, ("clicks", "position"), (A.Facet("query", "regex", "red|blue"),)),
    f"WITH {SPARSE}, a AS (SELECT date, {FOUR} FROM sparse WHERE {inside(SHORT)} AND regexp_matches(lower(query), 'red|blue') GROUP BY date) SELECT date, clicks, position FROM a", "position",
)
add(
    "arch_entity_daily", lambda k: A.entity_daily_timeseries(k, SHORT, "page", "/economy/brand-11"),
    f"WITH {SPARSE} SELECT date, {FOUR} FROM sparse WHERE {inside(SHORT)} AND url = '/economy/brand-11' GROUP BY date",
)
add(
    "arch_sparkline", lambda k: A.entity_daily_sparkline(k, SHORT, "country", ["nation_3", "nation_7"], "position"),
    f"""WITH {LINES} SELECT lower(n_name) AS entity, date, sum(sum_position) / sum(impressions) + 1 AS position FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE {inside(SHORT)} AND lower(n_name) IN ('nation_3', 'nation_7') GROUP BY ALL""", "position",
)
add(
    "arch_top_n", lambda k: A.top_n_breakdown(k, SHORT, "page", ("impressions", "desc"), 25, 5, total=True),
    f"WITH {SPARSE}, g AS (SELECT url AS page, {FOUR} FROM sparse WHERE {inside(SHORT)} GROUP BY url) SELECT *, (SELECT count(*) FROM g) AS total FROM g ORDER BY impressions DESC, page LIMIT 25 OFFSET 5",
)
#: Two spans of days in which some pages show and others don't.
DAYS_NOW, DAYS_BEFORE = ("1998-03-04", "1998-03-06"), ("1998-03-01", "1998-03-03")
for mode, (where, order) in {
    "improving": ("clicks > prevClicks", "clicks - prevClicks DESC"), "declining": ("clicks < prevClicks", "clicks - prevClicks"),
    "new": ("prevImpressions = 0 AND impressions > 0", "clicks DESC, impressions DESC"), "lost": ("impressions = 0 AND prevImpressions > 0", "prevImpressions DESC"),
}.items():
    if mode in ("new", "lost"):
        add(
            f"arch_movers_{mode}", lambda k, mode=mode: A.top_n_breakdown(k, DAYS_NOW, "page", limit=20, compare=DAYS_BEFORE, movers=mode),
            f"WITH {SPARSE}, b AS ({both_sql('sparse', 'url', 'page', now=DAYS_NOW, before=DAYS_BEFORE)}) SELECT * FROM b WHERE {where} ORDER BY {order}, page LIMIT 20", TWO,
        )
        continue
    add(
        f"arch_movers_{mode}", lambda k, mode=mode: A.top_n_breakdown(k, NOW, "query", limit=20, compare=BEFORE, movers=mode),
        f"WITH {SPARSE}, b AS ({both_sql('sparse', 'query', 'query')}) SELECT * FROM b WHERE {where} ORDER BY {order}, query LIMIT 20", TWO,
    )
add(
    "arch_top_canonical", lambda k: A.top_n_breakdown(k, SHORT, "queryCanonical", limit=20),
    f"WITH {SPARSE}, {DIM} SELECT query_canonical AS queryCanonical, {FOUR}, count(DISTINCT query) AS variantCount FROM sparse JOIN dim USING (query) WHERE {inside(SHORT)} GROUP BY 1 ORDER BY clicks DESC, 1 LIMIT 20",
)
DEV = "CASE l_returnflag WHEN 'A' THEN 'desktop' WHEN 'N' THEN 'mobile' ELSE 'tablet' END"
add("arch_top_devices", lambda k: A.top_n_breakdown(k, NOW, "device", compare=BEFORE), f"WITH {LINES} {both_sql('lines', DEV, 'device')}", TWO)
add(
    "arch_lookup", lambda k: A.single_row_lookup(k, SHORT, {"page": "/economy/brand-11"}),
    f"WITH {SPARSE}, a AS (SELECT {FOUR} FROM sparse WHERE {inside(SHORT)} AND url = '/economy/brand-11') SELECT clicks, impressions, coalesce(ctr, 0) AS ctr, position FROM a",
)
add(
    "arch_stacked_devices", lambda k: A.multi_series_stacked_daily(k, SHORT, "device", "clicks"),
    f"""WITH {LINES}, d AS (SELECT DISTINCT date FROM lines WHERE {inside(SHORT)}), s AS (SELECT date, {DEV} AS series, CAST(sum(clicks) AS DOUBLE) AS clicks FROM lines GROUP BY ALL)
    SELECT date, series, coalesce(clicks, 0.0) AS clicks FROM (SELECT date, series FROM d, (VALUES ('desktop'), ('mobile'), ('tablet')) v(series)) LEFT JOIN s USING (date, series)""", "",
)
add(
    "arch_two_dimension_detail", lambda k: A.two_dimension_detail(k, SHORT, page="/economy/brand-11"),
    f"WITH {SPARSE} SELECT url AS page, query, {FOUR} FROM sparse WHERE {inside(SHORT)} AND url = '/economy/brand-11' GROUP BY ALL",
)
add(
    "arch_sql", lambda k: A.arbitrary_sql(k, "SELECT page, count(DISTINCT query) AS n FROM page_queries WHERE date >= :since GROUP BY page", since="1999-01-01"),
    f"WITH {SPARSE} SELECT url AS page, count(DISTINCT query) AS n FROM sparse WHERE date >= DATE '1999-01-01' GROUP BY url", "",
)
add(
    "arch_sql_position", lambda k: A.arbitrary_sql(k, "SELECT query, sum(clicks) AS clicks, gsc_position(sum(sum_position), sum(impressions)) AS position FROM page_queries GROUP BY query"),
    f"WITH {SPARSE} SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, sum(sum_position) / nullif(sum(impressions), 0) + 1 AS position FROM sparse GROUP BY query", "position",
)


def query_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_dim(facts.long(spark, sf_dir).queries)


QUERIES["query_dimension"] = query_dimension
QUERIES["query_intent"] = lambda s, d: query_dimension(s, d).groupBy("intent_code").agg(F.count("*").alias("n"))
SQL["query_intent"] = f"""WITH {LONG}, q AS (SELECT DISTINCT query FROM long)
SELECT CASE WHEN starts_with(query, 'how to ') THEN 5 WHEN starts_with(query, 'best ') THEN 2 ELSE 0 END AS intent_code, count(*) AS n FROM q GROUP BY 1"""
