"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

STORIES = r"""stories AS (
  SELECT d.doc_id AS id, d.text AS title, coalesce(CAST(floor(e.value) AS INTEGER), 0) AS score,
         coalesce(CAST(json_extract_string(e.props, '$.k') AS BIGINT), 0) AS descendants, e.ts AS time, coalesce(p.url, '') AS url
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)"""
TOKENS = STORIES + r""", tok AS (
  SELECT id, token FROM (SELECT id, unnest(string_split_regex(lower(title), '[^\p{L}0-9]+')) AS token FROM stories) WHERE token <> '')"""
SCORED = TOKENS + """, total AS (
  SELECT id, CAST(sum((length(token) + ascii(token)) % 9 - 4) AS DOUBLE) AS s FROM tok GROUP BY id
), scored AS (
  SELECT *, CASE WHEN sentiment_score > 0.05 THEN 'Positive' WHEN sentiment_score < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
  FROM (SELECT st.*, coalesce(round(s / sqrt(s * s + 15), 4), 0.0) AS sentiment_score FROM stories st LEFT JOIN total USING (id)))"""
TOPICS = """, lab AS (
  SELECT st.id, coalesce(CAST(v.label AS INTEGER), -1) AS topic_id FROM stories st LEFT JOIN embeddings v ON v.vec_id = st.id
), term AS (
  SELECT topic_id, token, count(*) AS n FROM tok JOIN lab USING (id) WHERE topic_id <> -1 GROUP BY topic_id, token
), size AS (SELECT topic_id, sum(n) AS size FROM term GROUP BY topic_id
), freq AS (SELECT token, sum(n) AS f FROM term GROUP BY token
), weight AS (
  SELECT topic_id, token, round(CAST(n AS DOUBLE) / size * ln(1 + (SELECT avg(size) FROM size) / f), 9) AS w FROM term JOIN size USING (topic_id) JOIN freq USING (token)
), best AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY w DESC, token) AS r FROM weight
), keyword AS (SELECT topic_id, string_agg(token, '_' ORDER BY r) AS topic_keyword FROM best WHERE r <= 3 GROUP BY topic_id)"""
ENRICHED = SCORED + TOPICS + """, enriched AS (
  SELECT sc.*, lab.topic_id, coalesce(k.topic_keyword, CASE WHEN lab.topic_id = -1 THEN 'Outlier/No Topic' ELSE 'Topic_' || lab.topic_id END) AS topic_keyword
  FROM scored sc JOIN lab USING (id) LEFT JOIN keyword k ON k.topic_id = lab.topic_id)"""
INDEXED = """, indexed AS (
  SELECT e.*, row_number() OVER (ORDER BY e.score DESC, e.id) - 1 AS idx, v.embedding FROM {of} e JOIN embeddings v ON v.vec_id = e.id
), doc AS (SELECT *, 'story_' || idx || '_' || substring(md5(title), 1, 10) AS doc_id FROM indexed)"""
QUERIES = """, asked AS (
  SELECT v.vec_id AS query_id, v.embedding AS q FROM embeddings v WHERE v.vec_id % 50 = 0)"""
COSINE = "round(1 - list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9)"
MANIFESTS = """m AS (
  SELECT CAST(ts AS DATE) AS day, event_type AS analysis_type, count(*) AS stories_count, CAST(floor(epoch(max(ts))) AS DOUBLE) AS timestamp,
         CAST(day(CAST(ts AS DATE)) AS INTEGER) AS "limit" FROM events GROUP BY ALL
), last AS (SELECT floor(epoch(max(ts))) + 1.0 AS now FROM events)"""


def _display(column: str) -> str:
    """Words of a keyword capitalised, as SQL."""
    return f"array_to_string(list_transform(string_split(replace({column}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _digest(value: str) -> str:
    return f"""SELECT md5(count(*) || ':' || coalesce(sum(CAST('0x' || substring(g, 1, 15) AS HUGEINT)), 0) || ':' || coalesce(sum(CAST('0x' || substring(g, 16, 15) AS HUGEINT)), 0)) AS fingerprint
FROM (SELECT md5({value}) AS g FROM stories)"""


def oracle_sql() -> dict[str, str]:
    s, t, e = f"WITH {STORIES} ", f"WITH {SCORED} ", f"WITH {ENRICHED} "
    labels = f"WITH {TOKENS}{TOPICS} "
    index_of = lambda of: INDEXED.replace("{of}", of)
    ranked = "SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM stories"
    hit = f"""{e[5:]}{index_of("enriched")}{QUERIES}, near AS (
  SELECT query_id, doc_id AS id, score, {COSINE} AS distance FROM asked, doc <where>
), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS pos FROM near), kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM top WHERE pos <= 10 <keep>) """
    nearest = """WITH near AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {distance} AS distance FROM (SELECT vec_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) a, embeddings b
), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM near) """
    kpi_mood = "CASE WHEN average_sentiment > 0.05 THEN 'Positive' WHEN average_sentiment < -0.05 THEN 'Negative' WHEN average_sentiment IS NOT NULL THEN 'Neutral' END AS mood"
    top_topic = "coalesce((SELECT topic_keyword FROM enriched WHERE topic_id <> -1 GROUP BY topic_keyword ORDER BY count(*) DESC, topic_keyword LIMIT 1), 'No topics') AS top_topic"
    components = f"""WITH RECURSIVE {TOKENS}, edge AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE 1 - {COSINE.replace("(q AS", "(a.embedding AS").replace("(embedding AS", "(b.embedding AS")} >= 0.4
    AND a.vec_id IN (SELECT id FROM stories) AND b.vec_id IN (SELECT id FROM stories)
), both_ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge
), reach AS (SELECT a AS node, a AS low FROM both_ways UNION SELECT w.b, r.low FROM reach r JOIN both_ways w ON w.a = r.node
), comp AS (SELECT node, min(low) AS c FROM reach GROUP BY node
), num AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS topic_id FROM comp GROUP BY c
), lab AS (SELECT st.id, coalesce(CAST(num.topic_id AS INTEGER), -1) AS topic_id FROM stories st LEFT JOIN comp ON comp.node = st.id LEFT JOIN num USING (c)
{TOPICS[TOPICS.index("), term AS"):]} """
    return {
        "s1_ranked_ids": f"{s}SELECT id, CAST(rank AS INTEGER) AS rank FROM ({ranked})",
        "s2_first_ranked": f"{s}SELECT id, CAST(rank AS INTEGER) AS rank FROM ({ranked}) WHERE rank < 100",
        "s3_story_details": f"{s}SELECT id, title, score, descendants, date_trunc('second', coalesce(time, TIMESTAMP '1970-01-01')) AS time, url FROM stories JOIN ({ranked}) USING (id) WHERE rank < 30",
        "s4_s5_snapshot": f"{s}SELECT * FROM stories",
        "s6_export_csv": f"{s}SELECT id, score, descendants FROM stories",
        "s7_export_json": f"{s}SELECT id, title, score, strftime(time, '%Y-%m-%dT%H:%M:%S') AS time FROM stories",
        "s8_index_documents": f"{s}{index_of('stories')} SELECT doc_id AS id, title AS document, CAST(len(embedding) AS INTEGER) AS dims, score, descendants, url, CAST(idx AS INTEGER) AS index FROM doc",
        "s8_duplicate_ids": f"{s}SELECT md5(title) AS id, count(*) AS n FROM stories GROUP BY 1 HAVING count(*) > 1",
        "s9_default_metadata": f"{s}{index_of('stories')} SELECT doc_id AS id, substring(title, 1, 100) AS text FROM doc",
        "p1_extract": f"{s}SELECT id, title, coalesce(score, 0) AS score, coalesce(descendants, 0) AS descendants, date_trunc('second', coalesce(time, TIMESTAMP '1970-01-01')) AS time, url FROM stories WHERE title IS NOT NULL",
        "p2_p3_sentiment_labels": f"""{t}SELECT id, sentiment_label AS label, CASE WHEN sentiment_score > 0.5 THEN 'Very Positive' WHEN sentiment_score > 0.05 THEN 'Positive'
            WHEN sentiment_score > -0.05 THEN 'Neutral' WHEN sentiment_score > -0.5 THEN 'Negative' ELSE 'Very Negative' END AS band FROM scored""",
        "p4_document_ids": f"{s}SELECT id AS story_id, 'story_' || (row_number() OVER (ORDER BY score DESC, id) - 1) || '_' || substring(md5(title), 1, 10) AS document_id FROM stories",
        "p5_time_formats": f"{s}SELECT id, strftime(time, '%Y-%m-%d %H:%M') AS minute, strftime(time, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(time, '%H:%M:%S') AS clock FROM stories",
        "p6_links": f"{s}SELECT id, CASE WHEN url <> '' THEN '[' || title || '](' || url || ')' ELSE title END AS link FROM stories",
        "p7_short_titles": f"{s}SELECT id, CASE WHEN length(title) > 40 THEN substring(title, 1, 40) || '...' ELSE title END AS short FROM stories",
        "p8_topic_labels": f"{labels}SELECT topic_id, {_display('topic_keyword')} AS label FROM keyword",
        "p11_display_columns": f"{s}SELECT title, score, url FROM stories",
        "p14_search_cards": f"{e}SELECT id, coalesce(score, 0) AS score, coalesce(descendants, 0) AS comments, sentiment_label AS sentiment, {_display('topic_keyword')} AS topic FROM enriched",
        "f1_titled": f"{s}SELECT id FROM stories WHERE title IS NOT NULL",
        "f3_with_topic": f"{labels}SELECT id, topic_id FROM lab WHERE topic_id <> -1",
        "f4_sentiment_filter": f"{t}SELECT id, sentiment_label FROM scored WHERE sentiment_label IN ('Positive', 'Neutral')",
        "f6_metadata_filter": f"{s}SELECT id, score, descendants FROM stories WHERE ((score >= 50 AND score < 150) OR url <> '') AND descendants NOT IN (1, 2)",
        "f7_valid_queries": f"{s}SELECT id AS query_id FROM stories WHERE length(trim(title)) >= 3 AND length(title) <= 100",
        "f9_multi_filter": f"{labels}SELECT id, topic_id, score FROM stories JOIN lab USING (id) WHERE time >= TIMESTAMP '2024-01-02 00:00:00' AND topic_id IN (1, 2, 3) AND score > 20",
        "a1_mean_sentiment": f"{t}SELECT round(avg(sentiment_score), 6) AS average_sentiment FROM scored",
        "a2_total_comments": f"{s}SELECT CAST(coalesce(sum(descendants), 0) AS BIGINT) AS total_comments FROM stories",
        "a3_top_topic": f"{e}SELECT {top_topic}",
        "a4_kpis": f"""{e}SELECT stories, average_sentiment, {kpi_mood}, total_comments, top_topic FROM (SELECT count(*) AS stories, round(avg(sentiment_score), 6) AS average_sentiment,
            CAST(coalesce(sum(descendants), 0) AS BIGINT) AS total_comments, {top_topic} FROM enriched)""",
        "a5_sentiment_distribution": f"{t}SELECT sentiment_label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM scored GROUP BY sentiment_label",
        "a6_topic_distribution": f"""{e}, c AS (SELECT topic_id, min(topic_keyword) AS topic_keyword, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM enriched GROUP BY topic_id
            ) SELECT * FROM (SELECT * FROM c WHERE topic_id <> -1 ORDER BY n DESC, topic_id LIMIT 5) UNION ALL SELECT * FROM c WHERE topic_id = -1""",
        "a7_topic_count": f"{labels}SELECT count(DISTINCT topic_id) AS topics FROM lab WHERE topic_id <> -1",
        "a8_trending_topics": f"{e}SELECT topic_keyword, count(*) AS n FROM enriched WHERE topic_id <> -1 GROUP BY topic_keyword ORDER BY n DESC, topic_keyword LIMIT 7",
        "a9_collection_stats": "SELECT count(*) AS documents, 'stories' AS name, 'supplied' AS model FROM embeddings",
        "a10_topic_keywords": f"{labels}SELECT topic_id, topic_keyword FROM keyword",
        "a11_topic_info": f"{e}SELECT topic_id, count(*) AS n, topic_id || '_' || min(topic_keyword) AS name FROM enriched GROUP BY topic_id",
        "a12_fingerprint": s + _digest("coalesce(trim(title), '') || '|' || coalesce(CAST(score AS VARCHAR), '') || '|' || coalesce(strftime(time, '%Y-%m-%d %H:%M:%S'), '')"),
        "a13_text_fingerprint": s + _digest("coalesce(trim(title), '')"),
        "w2_story_index": f"{s}SELECT id, rank AS index FROM ({ranked})",
        "t1_ranked_stories": f"{s}SELECT id, title, score FROM stories ORDER BY score DESC, id",
        "t2_top_stories": f"{s}SELECT id, score, descendants FROM stories ORDER BY score DESC, id LIMIT 50",
        "x1_sentiment": f"{t}SELECT id, sentiment_score, sentiment_label FROM scored",
        "x2_topics": f"{components}SELECT lab.id, lab.topic_id, coalesce(topic_keyword, CASE WHEN lab.topic_id = -1 THEN 'Outlier/No Topic' ELSE 'Topic_' || lab.topic_id END) AS topic_keyword FROM lab LEFT JOIN keyword USING (topic_id)",
        "j5_near_pairs": f"SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT a.vec_id AS a, b.vec_id AS b, 1 - {COSINE.replace('(q AS', '(a.embedding AS').replace('(embedding AS', '(b.embedding AS')} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE similarity >= 0.4",
        "x6_index": f"{e}SELECT topic_keyword, count(*) AS n, CAST(max(idx) AS INTEGER) AS last_index FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS idx FROM enriched) GROUP BY topic_keyword",
        "x6_incremental": f"{s}SELECT id, CAST(CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, md5(title) AS text_md5, CAST(64 AS INTEGER) AS dims FROM stories WHERE id % 11 <> 0",
        "t4_nearest": nearest.format(distance=COSINE) + "SELECT query_id, id, round(distance, 6) AS distance, CAST(position AS INTEGER) AS position FROM top WHERE position <= 10",
        "x7_semantic_search": "WITH " + hit.replace("<where>", "").replace("<keep>", "AND 1 - distance >= 0.33") + """SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round_even(1 - distance, 3) AS similarity_score, round_even(distance, 3) AS distance,
            'Similarity: ' || printf('%.1f', round_even(round_even(1 - distance, 3) * 100, 1)) || '%' AS explanation FROM kept""",
        "x8_engine_search": "WITH " + hit.replace("<where>", "WHERE score >= 20").replace("<keep>", "") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round_even(1 - distance, 3) AS similarity_score FROM kept",
        "x9_inner_product": nearest.format(distance="round(1 - list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9)") + "SELECT query_id, id, CAST(position AS INTEGER) AS position FROM top WHERE position <= 5",
        "g3_g6_catalogue": f"""WITH {MANIFESTS} SELECT "limit", analysis_type, stories_count, now - timestamp < 604800 AS valid, round((now - timestamp) / 3600, 6) AS age_hours FROM m, last""",
        "g4_index_validity": """WITH e AS (SELECT *, CAST(ts AS DATE) AS day, strftime(ts, '%H:%M') < '23:30' AS early, floor(epoch(ts)) AS sec FROM events
            ) SELECT day, event_type AS analysis_type, coalesce(max(sec) - max(sec) FILTER (early) <= 3600 AND md5(count(*) FILTER (early) || ':' || coalesce(sum(event_id) FILTER (early), 0)) = md5(count(*) || ':' || sum(event_id)), false) AS valid FROM e GROUP BY ALL""",
        "g5_snapshot_keys": f"""WITH {MANIFESTS} SELECT day, analysis_type, md5("limit" || '_' || analysis_type) AS cache_key FROM m""",
        "g7_versions": f"WITH {MANIFESTS} SELECT day, analysis_type, CAST(row_number() OVER (PARTITION BY analysis_type ORDER BY day) AS INTEGER) AS version FROM m",
        "g1_refresh": f"{s}SELECT CAST(coalesce(sum(descendants), 0) AS BIGINT) AS total_comments FROM stories",
        "g1_totals": f"""{t}, whole AS (SELECT sc.*, coalesce(CAST(v.label AS INTEGER), -1) AS topic_id FROM scored sc LEFT JOIN embeddings v ON v.vec_id = sc.id)
            SELECT 'stories' AS measure, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM whole UNION ALL SELECT 'sentiment', 'all', round(sum(sentiment_score), 4) FROM whole
            UNION ALL SELECT 'comments', 'all', CAST(sum(descendants) AS DOUBLE) FROM whole UNION ALL SELECT 'label', sentiment_label, CAST(count(*) AS DOUBLE) FROM whole GROUP BY 2
            UNION ALL SELECT 'topic', CAST(topic_id AS VARCHAR), CAST(count(*) AS DOUBLE) FROM whole GROUP BY 2""",
        "g10_closing_windows": """WITH e AS (SELECT *, event_id % 3 AS arrival, date_trunc('day', ts) AS window_start FROM events), mark AS (
              SELECT a.i AS arrival, (SELECT max(ts) - INTERVAL 10 MINUTE FROM e WHERE e.arrival < a.i) AS w FROM (SELECT unnest([0, 1, 2]) AS i) a)
            SELECT window_start, event_type, count(*) FILTER (NOT passed) AS n, count(*) FILTER (passed) AS n_late
            FROM (SELECT e.*, coalesce(window_start + INTERVAL 1 DAY <= w, false) AS passed FROM e JOIN mark USING (arrival)) GROUP BY ALL""",
        "g10_windowed_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "g11_stream_dedup": "SELECT DISTINCT user_id || ':' || event_type || ':' || CAST(ts AS DATE) AS key FROM events",
        "v1_virality_features": f"{t}SELECT id, CAST(length(title) AS INTEGER) AS title_length, CAST(hour(time) AS INTEGER) AS hour, sentiment_score, CASE WHEN score > 100 THEN 1 ELSE 0 END AS viral FROM scored",
        "v4_briefing": f"{e}SELECT id, title, url, score, (SELECT max(CAST(time AS DATE)) FROM enriched) AS date, (SELECT round(avg(sentiment_score), 6) FROM enriched) AS average_sentiment, {top_topic} FROM enriched ORDER BY score DESC, id LIMIT 5",
        "v5_history_insert": f"{e}SELECT id, CASE WHEN id % 2 = 0 THEN 'stored' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN -1 ELSE score END AS score, sentiment_score, topic_keyword, time AS timestamp FROM enriched",
        "v6_latest": f"{s}SELECT id, time AS timestamp FROM stories ORDER BY time DESC, id LIMIT 1000",
        "v7_sentiment_trend": f"{t}SELECT date_trunc('day', time) AS period, count(*) AS n, round(avg(sentiment_score), 6) AS average_sentiment FROM scored GROUP BY 1",
        "v8_all_time_top": f"{s}SELECT id, score FROM stories ORDER BY score DESC, id LIMIT 50",
        "v9_sentiment_by_topic": f"""{e}SELECT topic_keyword, count(*) FILTER (sentiment_label = 'Positive') AS positive, count(*) FILTER (sentiment_label = 'Neutral') AS neutral,
            count(*) FILTER (sentiment_label = 'Negative') AS negative, round(avg(sentiment_score), 6) AS average_sentiment FROM enriched GROUP BY topic_keyword""",
        "v10_topic_timeline": f"{e}SELECT date_trunc('day', time) AS period, topic_keyword, count(*) AS n FROM enriched WHERE topic_id <> -1 GROUP BY 1, 2",
        "v11_engagement": f"{t}SELECT id, score, descendants, sentiment_score, sentiment_label FROM scored ORDER BY score DESC, id LIMIT 50",
        "v12_period_over_period": f"{s}, p AS (SELECT date_trunc('day', time) AS period, count(*) AS n FROM stories GROUP BY 1) SELECT period, n, lag(n) OVER (ORDER BY period) AS n_before, n - lag(n) OVER (ORDER BY period) AS change FROM p",
        "v13_keyword_cloud": f"WITH {TOKENS} SELECT token AS word, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, word LIMIT 50",
        "v14_topic_network": """WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
            m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
            SELECT CAST(a.label AS INTEGER) AS topic_a, CAST(b.label AS INTEGER) AS topic_b, round(sum(a.m / na.norm * b.m / nb.norm), 6) AS similarity
            FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2""",
        "v15_pages": f"{s}SELECT id, score FROM stories ORDER BY score DESC, id LIMIT 25 OFFSET 25",
    }
