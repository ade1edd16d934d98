"""Event summary queries."""

from garderobe.plans import events as E
from garderobe.sources import tables as T
from workload.bindings import sql
from workload.registry import query

NOW = T.EVENTS_NOW_MS


@query("event_counts", sql("SELECT win, event_type, count(*) AS n FROM windowed GROUP BY ALL", "windowed"))
def _(spark, d):
    return E.event_counts(T.analytics_events(spark, d), NOW)


@query("distinct_actors",
       sql("SELECT win, event_type, count(DISTINCT actor) AS actors FROM windowed GROUP BY ALL", "windowed"))
def _(spark, d):
    return E.distinct_actors(T.analytics_events(spark, d), NOW)


@query("quiz_step_actors", sql("SELECT win, step, count(DISTINCT actor) AS actors FROM windowed "
                               "WHERE event_type = 'quiz_step_completed' GROUP BY ALL", "windowed"))
def _(spark, d):
    return E.step_actors(T.analytics_events(spark, d), NOW)


@query("quiz_median_duration", sql("SELECT win, CAST(floor(median(duration_ms) + 0.5) AS BIGINT) AS median_ms FROM windowed "
                                   "WHERE duration_ms IS NOT NULL GROUP BY ALL", "windowed"))
def _(spark, d):
    return E.median_duration(T.analytics_events(spark, d), NOW)


FUNNEL = """
SELECT w.win, count(DISTINCT CASE WHEN event_type = 'quiz_started' THEN actor END) AS started,
  count(DISTINCT CASE WHEN event_type = 'quiz_completed' THEN actor END) AS completed,
  count(DISTINCT CASE WHEN event_type = 'deck_completed' THEN actor END) AS decks,
  count(DISTINCT CASE WHEN event_type = 'feed_viewed' THEN actor END) AS feed_viewers,
  CAST(floor(median(duration_ms) + 0.5) AS BIGINT) AS median_ms,
  CASE WHEN count(DISTINCT CASE WHEN event_type = 'quiz_started' THEN actor END) > 0 THEN
    count(DISTINCT CASE WHEN event_type = 'quiz_completed' THEN actor END)::DOUBLE
    / count(DISTINCT CASE WHEN event_type = 'quiz_started' THEN actor END) END AS completion_rate
FROM windows w LEFT JOIN windowed a ON a.win = w.win GROUP BY w.win"""


@query("funnel", sql(FUNNEL, "windows", "windowed"))
def _(spark, d):
    return E.funnel(T.analytics_events(spark, d), NOW)


SEARCHES = """
SELECT win, query, n, zero_results, coalesce(most, 0) = 0 AS always_zero, coalesce(last_rc, 0) AS last_results FROM
 (SELECT win, query, count(*) AS n, count(*) FILTER (result_count = 0) AS zero_results, max(result_count) AS most,
    arg_max(result_count, created_ms * 100000000 + id) AS last_rc,
    row_number() OVER (PARTITION BY win ORDER BY count(*) DESC, query ASC NULLS FIRST) AS rank
  FROM windowed WHERE event_type = 'search_submitted' GROUP BY win, query)
WHERE rank <= 20 AND query <> ''"""


@query("top_searches", sql(SEARCHES.replace("created_ms * 100000000 + id",
                                            "CAST(created_ms AS HUGEINT) * 100000000 + id"), "windowed"))
def _(spark, d):
    return E.top_searches(T.analytics_events(spark, d), NOW)


@query("filter_usage", sql("SELECT win, kind, count(*) AS n FROM windowed WHERE event_type = 'filter_applied' "
                           "AND kind IS NOT NULL GROUP BY ALL", "windowed"))
def _(spark, d):
    return E.filter_usage(T.analytics_events(spark, d), NOW)


MIX = """
SELECT win, count(*) FILTER (verdict = 'like') AS likes, count(*) FILTER (verdict = 'save') AS saves,
  count(*) FILTER (verdict = 'dislike') AS dislikes, count(*) FILTER (verdict = 'skip') AS skips, count(*) AS total,
  count(*) FILTER (verdict IN ('like', 'save'))::DOUBLE / count(*) AS like_rate
FROM windowed WHERE verdict IS NOT NULL GROUP BY win"""


@query("swipe_mix", sql(MIX, "windowed"))
def _(spark, d):
    return E.swipe_mix(T.analytics_events(spark, d), NOW)


SUMMARY = f"""
SELECT win, 'event_counts' AS section, event_type AS key, count(*)::DOUBLE AS value FROM windowed GROUP BY ALL
UNION ALL SELECT win, 'step_actors', CAST(step AS VARCHAR), count(DISTINCT actor)::DOUBLE FROM windowed
  WHERE event_type = 'quiz_step_completed' GROUP BY win, step
UNION ALL SELECT win, 'top_searches', query, n::DOUBLE FROM searches
UNION ALL SELECT win, 'filter_usage', kind, count(*)::DOUBLE FROM windowed WHERE kind IS NOT NULL GROUP BY win, kind
UNION ALL SELECT win, 'funnel', k, v FROM (SELECT win, unnest(['started', 'completed', 'decks', 'feed_viewers',
  'median_ms', 'completion_rate']) AS k, unnest([started::DOUBLE, completed::DOUBLE, decks::DOUBLE, feed_viewers::DOUBLE,
  median_ms::DOUBLE, completion_rate]) AS v FROM funnel)
UNION ALL SELECT win, 'swipes', k, v FROM (SELECT win, unnest(['likes', 'saves', 'dislikes', 'skips', 'total',
  'like_rate']) AS k, unnest([likes::DOUBLE, saves::DOUBLE, dislikes::DOUBLE, skips::DOUBLE, total::DOUBLE, like_rate])
  AS v FROM mix)"""


@query("event_summary", sql(SUMMARY, "windows", "windowed",
                            searches=SEARCHES.replace("created_ms * 100000000 + id",
                                                      "CAST(created_ms AS HUGEINT) * 100000000 + id"),
                            funnel=FUNNEL, mix=MIX))
def _(spark, d):
    return E.summary(T.analytics_events(spark, d), NOW)
