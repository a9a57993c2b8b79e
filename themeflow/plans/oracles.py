"""The same queries as DuckDB SQL over the given tables, written from the definitions."""

from __future__ import annotations

from themeflow.constants import NEGATIONS, NEGATIVE_WORDS, STOPWORDS


def _quoted(words) -> str:
    return ", ".join(f"'{word}'" for word in words)


BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
TS = "%Y-%m-%d %H:%M:%S.%f"


def iso(expression: str) -> str:
    return f"strftime({expression}, '{TS}')"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def rounded(expression: str, digits: int = 4) -> str:
    """Rounding of the exact binary value, as the formatter does it."""
    return f"(CAST(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)) AS DOUBLE) + 0.0)"


def plain(html: str) -> str:
    return strip(f"regexp_replace(regexp_replace({html}, '<[^>]+>', ' ', 'g'), '[{BLANK}]+', ' ', 'g')")


LIKES = "CASE WHEN d.doc_id % 10 = 0 THEN -5 ELSE CAST(floor(e.value) AS BIGINT) END"
TAGS = (
    "CASE WHEN d.doc_id % 15 = 0 THEN [upper(d.source), upper(d.lang)] "
    "WHEN d.doc_id % 3 = 0 THEN [upper(d.source)] ELSE CAST([] AS VARCHAR[]) END"
)
TAGGED = "d.text || ' $' || upper(d.lang) || ' #' || d.source || ' https://example.com/' || d.doc_id"

POSTS = f"""
posts AS (
    SELECT 'doc_' || d.doc_id AS id,
        CASE d.doc_id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' WHEN 2 THEN 'news' ELSE 'podcast' END AS platform,
        'user_' || e.user_id AS author_id, d.text, e.ts AS created_at, {LIKES} AS likes,
        d.doc_id % 11 AS replies, d.doc_id % 3 AS reposts, d.lang AS language, {TAGS} AS cashtags,
        d.doc_id % 5 = 0 AS processed, d.doc_id, d.source, e.event_type, e.value, {TAGGED} AS tagged
    FROM documents d JOIN events e ON e.event_id = d.doc_id
)"""

WORDS = f"""
words AS (
    SELECT id, list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_]{{2,}}', 0),
        lambda w: w NOT IN ({_quoted(STOPWORDS)})) AS tokens
    FROM posts
),
tokens AS (
    SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM words
)"""

KEYS = f"""{POSTS},{WORDS},
counts AS (SELECT id, token, count(*) AS n, min(pos) AS first FROM tokens GROUP BY ALL),
best AS (
    SELECT id, token FROM counts
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) = 1
),
keyed AS (
    SELECT p.*, CASE WHEN len(cashtags) > 0
        THEN 'tag:' || array_to_string(list_sort(list_distinct(cashtags)), '+')
        ELSE 'kw:' || coalesce(b.token, 'misc') END AS key,
        substr(sha1(p.id), 1, 9) AS tie
    FROM posts p LEFT JOIN best b USING (id)
)"""

RANKED_WORDS = """
word_counts AS (
    SELECT key, token AS item, count(*) AS n, min((-epoch_us(created_at), tie, pos)) AS first
    FROM keyed JOIN tokens USING (id) GROUP BY ALL
),
ranked_words AS (
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY n DESC, first, item) AS rank, item, n FROM word_counts
    QUALIFY rank <= 8
)"""

RANKED_TAGS = """
tags AS (
    SELECT key, created_at, tie, unnest(cashtags) AS item, generate_subscripts(cashtags, 1) AS pos FROM keyed
),
tag_counts AS (
    SELECT key, item, count(*) AS n, min((-epoch_us(created_at), tie, pos)) AS first FROM tags GROUP BY ALL
),
ranked_tags AS (
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY n DESC, first, item) AS rank, item, n FROM tag_counts
    QUALIFY rank <= 5
)"""

# The SHA-1 of the number of members and of the sums of their digests, in four parts.
DIGEST = "sha1(concat_ws('|', count(*), {}))".format(
    ", ".join(f"sum(CAST('0x' || substr(sha1(id), {1 + 10 * i}, 10) AS BIGINT))" for i in range(4))
)

CLUSTERS = f"""{KEYS},{RANKED_WORDS},{RANKED_TAGS},
sized AS (
    SELECT key, count(*) AS n_posts, min(created_at) AS first_seen,
        (SELECT max(created_at) FROM posts) AS last_seen,
        'nar_' || substr({DIGEST}, 1, 12) AS id,
        string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms
    FROM keyed GROUP BY key HAVING count(*) >= 2
),
clusters AS (
    SELECT s.*, {rounded('least(1.0, 0.45::DOUBLE + 0.1::DOUBLE * n_posts)', 3)} AS confidence,
        coalesce((SELECT list(item ORDER BY rank) FROM ranked_words w WHERE w.key = s.key), []) AS keywords,
        coalesce((SELECT list(item ORDER BY rank) FROM ranked_tags t WHERE t.key = s.key), []) AS cashtags
    FROM sized s
),
members AS (SELECT c.id AS narrative_id, k.id AS post_id FROM clusters c JOIN keyed k USING (key))"""

_TITLE = """array_to_string(list_transform(range(1, len(word) + 1), lambda i:
    CASE WHEN i = 1 OR NOT regexp_matches(word[i - 1], '[a-z]') THEN upper(word[i]) ELSE word[i] END), '')"""

LABELS = f"""{CLUSTERS},
titled AS (SELECT *, coalesce(keywords[1], 'market') AS word FROM clusters),
labels AS (
    SELECT *, CASE WHEN len(cashtags) > 0 THEN '$' || array_to_string(cashtags[1:2], ', $') || ' narrative momentum'
            ELSE {_TITLE} || ' discussion cluster' END AS name,
        'Cluster of ' || n_posts || ' posts across ' || replace(platforms, ',', ', ') || ' focused on ' ||
            CASE WHEN len(keywords) > 0 THEN array_to_string(keywords[1:4], ', ')
            ELSE 'broad market chatter' END || '.' AS description
    FROM titled
)"""

PROSE_POSITIVE = ("the", "for", "with", "die", "que", "los")
PROSE_NEGATIVE = ("and", "was", "des", "from", "den")


def sentiment(positive, negative) -> str:
    return f"""
hit_words AS (SELECT id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{1,}}', 0), lambda w: lower(w)) AS ws FROM posts),
hit_rows AS (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM hit_words),
hit_signs AS (
    SELECT id, token, pos,
        CASE WHEN token IN ({_quoted(positive)}) THEN 1 WHEN token IN ({_quoted(negative)}) THEN -1 ELSE 0 END *
        CASE WHEN lag(token) OVER (PARTITION BY id ORDER BY pos) IN ({_quoted(NEGATIONS)}) THEN -1 ELSE 1 END AS sign
    FROM hit_rows
),
hit_counts AS (
    SELECT p.id, count(*) FILTER (sign = 1) AS positive_hits, count(*) FILTER (sign = -1) AS negative_hits
    FROM posts p LEFT JOIN hit_signs h USING (id) GROUP BY p.id
),
scored AS (
    SELECT *, CASE WHEN positive_hits + negative_hits = 0 THEN 0.0::DOUBLE ELSE
        {rounded('(positive_hits - negative_hits) / (positive_hits + negative_hits) * least(1.0::DOUBLE, (positive_hits + negative_hits) / 3)')} END AS score
    FROM hit_counts
)"""


LABEL = "CASE WHEN score > 0.2 THEN 'bullish' WHEN score < -0.2 THEN 'bearish' ELSE 'neutral' END"
PROSE = sentiment(PROSE_POSITIVE, PROSE_NEGATIVE)

THEME_SENTIMENT = f"""
theme_sentiment AS (
    SELECT m.narrative_id, {rounded('sum(s.score * w) / sum(w)')} AS score, count(*) AS sample_size
    FROM members m JOIN scored s ON s.id = m.post_id
    JOIN (SELECT id, 1 + least(2.0::DOUBLE, (greatest(0, likes) + greatest(0, replies) + greatest(0, reposts)) / 100) AS w FROM posts) p
        ON p.id = m.post_id
    GROUP BY 1
)"""

THEME_SCORES = f"""
velocity AS (
    SELECT c.id, CASE WHEN count(p.id) = 0 THEN 0.0::DOUBLE ELSE {rounded(
        '0.6::DOUBLE * least(1.0::DOUBLE, count(p.id) / 24 / 10) + 0.4::DOUBLE * least(1.0::DOUBLE, sum(likes + replies + reposts) / count(p.id) / 500)'
    )} END AS velocity_score
    FROM clusters c JOIN members m ON m.narrative_id = c.id
    LEFT JOIN posts p ON p.id = m.post_id
        AND p.created_at > (SELECT max(created_at) FROM posts) - INTERVAL 24 HOUR
    GROUP BY c.id
),
saturation AS (
    SELECT c.id, {rounded(
        '0.7::DOUBLE * least(1.0::DOUBLE, count(*) / (SELECT count(*) FROM posts) / 0.05::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, count(DISTINCT author_id) / 50)'
    )} AS saturation_score
    FROM clusters c JOIN members m ON m.narrative_id = c.id JOIN posts p ON p.id = m.post_id
    GROUP BY c.id
)"""

OVERALL = f"""
overall AS (
    SELECT c.*, t.score AS sentiment_score, velocity_score, saturation_score,
        {rounded('t.score * 0.4::DOUBLE + velocity_score * 0.35::DOUBLE + saturation_score * 0.25::DOUBLE')} AS overall_score
    FROM labels c JOIN theme_sentiment t ON t.narrative_id = c.id
    JOIN velocity v ON v.id = c.id JOIN saturation s ON s.id = c.id
)"""

SUBMISSIONS = f"""
submissions AS (
    SELECT d.doc_id, d.source AS subreddit, {LIKES} AS score, d.doc_id % 11 AS num_comments,
        CASE WHEN e.event_type <> 'error' THEN 'user_' || e.user_id ELSE 'deleted' END AS author,
        d.source || ' ' || d.lang AS title,
        CASE WHEN e.event_type <> 'click' THEN {TAGGED} END AS selftext,
        date_trunc('second', e.ts) AS created_at, d.doc_id % 3 = 0 AS is_self
    FROM documents d JOIN events e ON e.event_id = d.doc_id
)"""

FORUM = f"""{SUBMISSIONS},
forum AS (
    SELECT *, title || CASE WHEN selftext IS NULL THEN '' ELSE chr(10) || chr(10) || selftext END AS body,
        list_sort(list_distinct(list_concat(
            CASE WHEN is_self THEN CAST([] AS VARCHAR[]) ELSE ['https://example.org/' || doc_id] END,
            coalesce(regexp_extract_all(selftext, 'https?://[^{BLANK})]+', 0), CAST([] AS VARCHAR[]))))) AS links
    FROM submissions
)"""

TWEETS = f"""
tweets AS (
    SELECT d.*, e.*, {LIKES} AS likes, {TAGS} AS tags, CAST(floor(e.value) AS BIGINT) AS impressions,
        d.doc_id % 3 AS reposts, d.doc_id % 11 AS replies, e.event_type = 'error' AS anonymous
    FROM documents d JOIN events e ON e.event_id = d.doc_id
)"""

NEWS = f"""
raw_news AS (
    SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
        regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS lang
    FROM pages p JOIN events e ON e.event_id = p.page_id
    WHERE e.event_type <> 'error' AND url <> ''
),
titled_news AS (
    SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' $' || upper(lang) || ' #' || lang AS title
    FROM raw_news
),
news AS (
    SELECT *, 'news_' || substr(sha1(url), 1, 16) AS id, date_trunc('second', ts) AS created_at,
        CASE WHEN event_type = 'view' THEN 'wire' END AS source_id,
        CASE WHEN event_type <> 'click' THEN '  about ' || host || ' ' END AS description,
        substr({strip('title')} || CASE WHEN event_type <> 'click' THEN chr(10) || chr(10) || 'about ' || host ELSE '' END ||
            CASE WHEN html <> '' THEN chr(10) || chr(10) || {strip('html')} ELSE '' END, 1, 4000) AS text
    FROM titled_news
)"""

PODCAST = f"""
raw_pods AS (
    SELECT d.*, e.ts, e.event_type AS kind, {TAGGED} AS tagged,
        CASE WHEN kind <> 'error' THEN 'https://pod.example.com/' || d.doc_id END AS link,
        CASE WHEN kind = 'view' THEN 'guid-' || d.doc_id ELSE link END AS guid,
        'https://feeds.example.com/' || d.source AS feed_url,
        CASE WHEN d.lang <> 'es' THEN d.source ELSE 'unknown' END AS show_name,
        CASE WHEN kind = 'view' THEN 'https://cdn.example.com/' || d.doc_id || '.mp3' END AS audio_url,
        CASE WHEN kind <> 'click' THEN 'Episode ' || d.doc_id ELSE 'Untitled Episode' END AS episode_title,
        CASE kind WHEN 'view' THEN date_trunc('second', ts)
            WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            WHEN 'purchase' THEN date_trunc('second', ts)
            ELSE TIMESTAMP '2024-02-01 00:00:00' END AS created_at
    FROM documents d JOIN events e ON e.event_id = d.doc_id
),
pods AS (
    SELECT *, 'podcast_' || substr(sha1(feed_url || ':' || guid), 1, 16) AS id,
        {plain("'<p>' || tagged || '</p>'")} AS from_content, {plain('tagged')} AS from_description,
        CASE WHEN from_content = from_description THEN from_content
            ELSE from_content || chr(10) || chr(10) || from_description END AS full_text
    FROM raw_pods WHERE guid IS NOT NULL
)"""


#: The same episodes as landed XML: even ones in RSS feeds, odd ones in Atom feeds, each with one title per feed.
FEEDS = f"""{PODCAST},
raw_feeds AS (
    SELECT doc_id, doc_id % 2 = 0 AS rss, kind, tagged, link, guid, audio_url, episode_title,
        'https://feeds.example.com/' || source || CASE WHEN rss THEN '/rss' ELSE '/atom' END AS feed_url,
        'Show & ' || source AS show_name,
        CASE WHEN rss THEN created_at WHEN kind IN ('view', 'click') THEN date_trunc('second', ts)
            ELSE TIMESTAMP '2024-02-01 00:00:00' END AS created_at
    FROM raw_pods
),
feeds AS (
    SELECT *, 'podcast_' || substr(sha1(feed_url || ':' || guid), 1, 16) AS id,
        {plain("'<p>' || tagged || '</p>'")} AS from_content, {plain('tagged')} AS from_description,
        CASE WHEN NOT rss OR from_content = from_description THEN from_content
            ELSE from_content || chr(10) || chr(10) || from_description END AS full_text
    FROM raw_feeds WHERE guid IS NOT NULL
)"""


def tag_list(text: str, pattern: str, separator: str = ",") -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern}', 1))), '{separator}')"


CASHTAG, HASHTAG = r"\$([A-Za-z]{1,10})", r"#([\p{L}\p{N}_]+)"

LOAD = f"""{POSTS},
incoming AS (
    SELECT *, doc_id AS arrival FROM posts
    UNION ALL BY NAME
    SELECT * REPLACE ('copy of ' || text AS text), doc_id + 1000000000000 AS arrival FROM posts WHERE doc_id % 7 = 0
),
fresh AS (
    SELECT * FROM incoming WHERE id NOT IN (SELECT id FROM posts WHERE processed)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1
)"""

REPORT = f"""{LOAD},
report AS (
    SELECT i.platform AS source, any_value(coalesce(f.n, 0)) AS posts_stored,
        count(*) - any_value(coalesce(f.n, 0)) AS duplicates_skipped, 0::BIGINT AS rejected
    FROM incoming i LEFT JOIN (SELECT platform, count(*) AS n FROM fresh GROUP BY 1) f USING (platform)
    GROUP BY 1
)"""

# One theme per author and slice; member sets are compared as sorted lists.
THEMES = f"""{POSTS},
bounds AS (SELECT min(epoch_us(created_at)) AS low, max(epoch_us(created_at)) AS high FROM posts),
sliced AS (
    SELECT *, CAST(least(floor((epoch_us(created_at) - low) * 3 / (high - low)), 2) AS BIGINT) AS slice
    FROM posts, bounds
),
themes AS (
    SELECT slice, 'nar_' || author_id AS id, author_id, count(*) AS n, list(sliced.id ORDER BY sliced.id) AS members,
        min(created_at) AS first_seen, max(created_at) AS last_seen,
        round(sum(likes) / count(*) / 1000, 4) AS sentiment_score,
        {rounded('least(1.0, 0.45::DOUBLE + 0.1::DOUBLE * count(*))', 3)} AS confidence
    FROM sliced GROUP BY slice, author_id
),
clocks AS (SELECT slice, max(created_at) AS clock FROM sliced GROUP BY 1)"""

_CHANGED = (
    "(o.members <> n.members OR abs(o.sentiment_score - n.sentiment_score) > 1e-6 "
    "OR abs(o.overall_score - n.overall_score) > 1e-6 OR abs(o.confidence - n.confidence) > 1e-6)"
)


def _step(run: int, slice_: int) -> str:
    before = f"state{run - 1}"
    return f"""
batch{run} AS (SELECT *, round(sentiment_score * 0.4, 4) AS overall_score FROM themes WHERE slice = {slice_}),
joined{run} AS (
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.author_id, o.author_id) AS author_id,
        CASE WHEN o.id IS NULL THEN 'created'
            WHEN n.id IS NOT NULL AND NOT o.is_active THEN 'reactivated'
            WHEN n.id IS NOT NULL AND {_CHANGED} THEN 'updated'
            WHEN n.id IS NOT NULL THEN 'unchanged'
            WHEN o.is_active AND o.last_seen < c.clock - INTERVAL 12 HOUR THEN 'deactivated' END AS event,
        coalesce(o.version, 0) AS previous_version, n.id IS NOT NULL AS arrived, o.is_active AS was_active,
        coalesce(n.members, o.members) AS members, coalesce(n.n, o.n) AS n,
        coalesce(n.first_seen, o.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen,
        coalesce(n.sentiment_score, o.sentiment_score) AS sentiment_score,
        coalesce(n.overall_score, o.overall_score) AS overall_score,
        coalesce(n.confidence, o.confidence) AS confidence, o.updated_at AS was_updated, c.clock
    FROM {before} o FULL JOIN batch{run} n ON o.id = n.id
    CROSS JOIN (SELECT clock FROM clocks WHERE slice = {slice_}) c
),
versions{run} AS (
    SELECT *, previous_version + CASE WHEN event IS NULL OR event = 'unchanged' THEN 0 ELSE 1 END AS version,
        arrived OR (was_active AND event IS DISTINCT FROM 'deactivated') AS is_active,
        CASE WHEN event IS NULL THEN was_updated ELSE clock END AS updated_at, {run}::BIGINT AS run
    FROM joined{run}
),
state{run} AS (SELECT * FROM versions{run})"""


_EMPTY = """
state0 AS (
    SELECT *, 0.0::DOUBLE AS overall_score, 0::BIGINT AS version, true AS is_active, clock AS updated_at
    FROM themes JOIN clocks USING (slice) WHERE false
)"""

LIFECYCLE = ",".join([THEMES, _EMPTY, _step(1, 0), _step(2, 1), _step(3, 1), _step(4, 2)]) + """,
history AS (
    SELECT run, id AS narrative_id, author_id, event, previous_version, version AS new_version, clock FROM versions1
    UNION ALL SELECT run, id, author_id, event, previous_version, version, clock FROM versions2
    UNION ALL SELECT run, id, author_id, event, previous_version, version, clock FROM versions3
    UNION ALL SELECT run, id, author_id, event, previous_version, version, clock FROM versions4
),
events_seen AS (SELECT * FROM history WHERE event IS NOT NULL)"""

STREAM_LIFECYCLE = ",".join([THEMES, _EMPTY, _step(1, 0), _step(2, 1), _step(3, 2)])

CLOCK = "TIMESTAMP '2024-02-01 00:00:00'"

ORACLES: dict[str, str] = {
    "norm_twitter": f"""WITH {TWEETS}
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN anonymous THEN '' ELSE 'u' || user_id END AS author_id,
            CASE WHEN anonymous THEN 'unknown' ELSE 'name_' || user_id END AS author_username,
            sha1(text) AS text_sha1, {iso('ts')} AS created_at, likes, replies, reposts, lang AS language,
            array_to_string(tags, ',') AS cashtags, '' AS hashtags, '' AS urls, impressions,
            0::BIGINT AS quote_tweets, 0::BIGINT AS bookmarks,
            CASE WHEN impressions > 0 THEN round((likes + reposts + replies) / impressions, 6) END AS engagement_rate,
            event_type = 'click' AS is_reply, event_type = 'view' AS is_retweet
        FROM tweets""",
    "engagement_filter": f"""WITH {POSTS} SELECT id, likes, reposts, replies FROM posts
        WHERE likes >= 10 AND reposts >= 1 AND replies >= 2""",
    "search_capped": f"""WITH {POSTS}
        SELECT source AS query, id, {iso('created_at')} AS created_at, likes FROM posts
        WHERE likes >= 10 AND created_at >= (SELECT max(created_at) FROM posts) - INTERVAL 36 HOUR
            AND created_at <= (SELECT max(created_at) FROM posts) - INTERVAL 6 HOUR
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5""",
    "norm_reddit": f"""WITH {FORUM}
        SELECT 'reddit_' || doc_id AS id, author AS author_id, author AS author_username,
            sha1(substr(body, 1, 4000)) AS text_sha1, length(substr(body, 1, 4000)) AS chars,
            {iso('created_at')} AS created_at, score AS likes, num_comments AS replies, 0::BIGINT AS reposts,
            subreddit, title, {tag_list('body', CASHTAG)} AS cashtags, {tag_list('body', HASHTAG)} AS hashtags,
            array_to_string(links, ' ') AS urls, score AS upvotes, doc_id % 2 AS downvotes, 0::BIGINT AS awards,
            is_self, 'https://reddit.com/r/' || subreddit || '/' || doc_id AS permalink
        FROM forum""",
    "subreddit_search": f"""WITH {SUBMISSIONS},
        listed AS (
            SELECT *, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY subreddit
                ORDER BY created_at DESC, CAST(doc_id AS VARCHAR)) AS listing_rank FROM submissions
        ),
        found AS (
            SELECT * FROM listed WHERE listing_rank <= 16
                AND created_at >= (SELECT max(created_at) FROM submissions) - INTERVAL 24 HOUR
                AND (contains(lower(title || ' ' || coalesce(selftext, '')), 'the')
                    OR contains(lower(title || ' ' || coalesce(selftext, '')), 'que'))
                AND score >= 5 AND num_comments >= 1
        )
        SELECT subreddit, id, listing_rank, score, num_comments FROM found
        QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY listing_rank) <= 8""",
    "listing_order": f"""WITH {SUBMISSIONS}
        SELECT subreddit, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY subreddit
            ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS listing_rank, score
        FROM submissions WHERE created_at >= (SELECT max(created_at) FROM submissions) - INTERVAL 24 HOUR
        QUALIFY listing_rank <= 10""",
    "norm_news": f"""WITH {NEWS}
        SELECT id, coalesce(source_id, host) AS author_id, host AS author_username, sha1(text) AS text_sha1,
            length(text) AS chars, {iso('created_at')} AS created_at, {tag_list('text', CASHTAG)} AS cashtags,
            {tag_list('text', HASHTAG)} AS hashtags, url AS urls, host AS source_name, source_id, title,
            description, url AS article_url
        FROM news""",
    "news_window": f"""WITH {NEWS}
        SELECT lang AS query, id, {iso('created_at')} AS created_at FROM news
        WHERE created_at >= (SELECT max(created_at) FROM news) - INTERVAL 24 HOUR
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY created_at DESC, id) <= 10""",
    "norm_podcast": f"""WITH {PODCAST}
        SELECT id, show_name AS author_id, sha1(substr(full_text, 1, 8000)) AS text_sha1,
            length(substr(full_text, 1, 8000)) AS chars, {iso('created_at')} AS created_at,
            {tag_list('full_text', CASHTAG)} AS cashtags, {tag_list('full_text', HASHTAG)} AS hashtags,
            concat_ws(' ', link, audio_url) AS urls, show_name, episode_title, link AS episode_url, audio_url,
            'https://cdn.example.com/' || doc_id || '.vtt' AS transcript_source
        FROM pods""",
    "feed_xml": f"""WITH {FEEDS}
        SELECT feed_url, id, show_name AS author_id, sha1(substr(full_text, 1, 8000)) AS text_sha1,
            length(substr(full_text, 1, 8000)) AS chars, {iso('created_at')} AS created_at,
            {tag_list('full_text', CASHTAG)} AS cashtags, {tag_list('full_text', HASHTAG)} AS hashtags,
            concat_ws(' ', link, audio_url) AS urls, show_name, episode_title, link AS episode_url, audio_url,
            'https://cdn.example.com/' || doc_id || '.vtt' AS transcript_source
        FROM feeds""",
    "feed_xml_first": f"""WITH {FEEDS},
        firsts AS (SELECT doc_id FROM raw_feeds QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY doc_id) <= 5)
        SELECT feed_url, id, show_name, episode_title FROM feeds JOIN firsts USING (doc_id)
        WHERE contains(lower(episode_title || chr(10) || substr(full_text, 1, 8000)), '$en')
            OR contains(lower(episode_title || chr(10) || substr(full_text, 1, 8000)), '$fr')""",
    "html_text": f"SELECT page_id, {plain('html')} AS text FROM pages",
    "podcast_dates": f"""WITH {PODCAST} SELECT doc_id AS position, {iso('created_at')} AS created_at FROM raw_pods""",
    "feed_search": f"""WITH {PODCAST},
        firsts AS (
            SELECT doc_id FROM raw_pods QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY doc_id) <= 20
        )
        SELECT feed_url, id, episode_title FROM pods JOIN firsts USING (doc_id)
        WHERE contains(lower(episode_title || chr(10) || substr(full_text, 1, 8000)), '$en')
            OR contains(lower(episode_title || chr(10) || substr(full_text, 1, 8000)), 'episode 1')""",
    "posts_unified": f"""WITH {TWEETS},{FORUM},{NEWS},{PODCAST}
        SELECT CAST(doc_id AS VARCHAR) AS id, 'twitter' AS platform,
            CASE WHEN anonymous THEN '' ELSE 'u' || user_id END AS author_id, {iso('ts')} AS created_at,
            likes, replies, reposts, NULL AS title, NULL AS subreddit, NULL AS show_name, impressions,
            length(text) AS chars FROM tweets
        UNION ALL SELECT 'reddit_' || doc_id, 'reddit', author, {iso('created_at')}, score, num_comments, 0,
            title, subreddit, NULL, NULL, length(substr(body, 1, 4000)) FROM forum
        UNION ALL SELECT id, 'news', coalesce(source_id, host), {iso('created_at')}, 0, 0, 0, title, NULL, NULL,
            NULL, length(text) FROM news
        UNION ALL SELECT id, 'podcast', show_name, {iso('created_at')}, 0, 0, 0, NULL, NULL, show_name, NULL,
            length(substr(full_text, 1, 8000)) FROM pods""",
    "news_domains": f"""WITH {NEWS}
        SELECT id, {iso('created_at')} AS created_at, host AS source_name FROM news
        WHERE created_at >= (SELECT max(created_at) FROM news) - INTERVAL 24 HOUR AND length(host) % 2 = 0
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY created_at DESC, id) <= 10""",
    "ingest_run": f"""WITH {SUBMISSIONS},{PODCAST},{TWEETS},{NEWS},
        clock AS (SELECT max(ts) AS t FROM events JOIN documents ON event_id = doc_id),
        listed AS (
            SELECT *, row_number() OVER (PARTITION BY subreddit
                ORDER BY created_at DESC, CAST(doc_id AS VARCHAR)) AS r FROM submissions
        ),
        forum_posts AS (
            SELECT * FROM listed WHERE r <= 12 AND score >= 0
                AND created_at >= (SELECT t FROM clock) - INTERVAL 24 HOUR
            QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY r) <= 6
        ),
        firsts AS (
            SELECT doc_id FROM raw_pods QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY doc_id) <= 4
        )
        SELECT 'reddit' AS platform, 'reddit_' || doc_id AS id, author AS author_id, score AS likes FROM forum_posts
        UNION ALL SELECT 'podcast', id, show_name, 0 FROM pods JOIN firsts USING (doc_id)
        UNION ALL SELECT 'twitter', CAST(doc_id AS VARCHAR), CASE WHEN anonymous THEN '' ELSE 'u' || user_id END, likes
            FROM tweets WHERE likes >= 10 AND ts >= (SELECT t FROM clock) - INTERVAL 24 HOUR
        UNION ALL SELECT 'news', id, author_id, 0 FROM (
            SELECT id, coalesce(source_id, host) AS author_id, lang, created_at FROM news
            WHERE created_at >= (SELECT t FROM clock) - INTERVAL 24 HOUR
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY created_at DESC, id) <= 10)""",
    "cashtags": f"""WITH {POSTS} SELECT id, array_to_string(regexp_extract_all(tagged, '{CASHTAG}', 1), ',') AS tags FROM posts""",
    "hashtags": f"""WITH {POSTS} SELECT id, array_to_string(regexp_extract_all(tagged, '{HASHTAG}', 1), ',') AS tags FROM posts""",
    "urls": f"""WITH {POSTS} SELECT id, array_to_string(regexp_extract_all(tagged, 'https?://[^{BLANK})]+', 0), ',') AS links FROM posts""",
    "stable_ids": "SELECT page_id, 'news_' || substr(sha1(url), 1, 16) AS stable_id FROM pages",
    "engagement_rate": f"""WITH {POSTS} SELECT id, CASE WHEN floor(value) > 0
        THEN round((likes + replies + reposts) / floor(value), 6) END AS engagement_rate FROM posts""",
    "keyword_tokens": f"WITH {POSTS},{WORDS} SELECT id, array_to_string(tokens, ' ') AS tokens FROM words",
    "sentiment_tokens": f"""WITH {POSTS}
        SELECT id, lower(array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{1,}}', 0), ' ')) AS tokens FROM posts""",
    "conversation_tokens": f"""WITH split AS (
            SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_]{{2,}}', 0),
                lambda w: w NOT IN ({_quoted(STOPWORDS)})) AS kept,
                len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{1,}}', 0)) AS words
            FROM conversations
        ),
        counted AS (
            SELECT conv_id, turn, w, count(*) AS n, min(pos) AS first FROM (
                SELECT conv_id, turn, unnest(kept) AS w, generate_subscripts(kept, 1) AS pos FROM split)
            GROUP BY ALL
        ),
        best AS (
            SELECT conv_id, turn, w FROM counted
            QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) = 1
        )
        SELECT conv_id, turn, len(kept) AS keywords, words, w AS dominant FROM split LEFT JOIN best USING (conv_id, turn)""",
    "sentiment_label": f"WITH {POSTS},{PROSE} SELECT {LABEL} AS label, count(*) AS n FROM scored GROUP BY 1",
    "date_parse": f"""SELECT event_id, {iso('ts')} AS from_iso, {iso("date_trunc('second', ts)")} AS from_seconds,
        {iso("date_trunc('second', ts) - INTERVAL 90 MINUTE")} AS from_mail,
        {iso("date_trunc('second', ts)")} AS from_short_year, {iso("date_trunc('second', ts)")} AS from_asctime,
        {iso("date_trunc('second', ts)")} AS from_basic, {iso("date_trunc('hour', ts)")} AS from_week, true AS junk_is_null FROM events""",
    "word_count": f"WITH {POSTS} SELECT id, len(regexp_extract_all(text, '[^{BLANK}]+', 0)) AS words FROM posts",
    "json_roundtrip": f"""WITH {POSTS} SELECT id, CAST(to_json(cashtags) AS VARCHAR) AS encoded, len(cashtags) AS n,
        array_to_string(cashtags, '+') AS decoded FROM posts""",
    "keyword_any": f"""WITH {POSTS} SELECT id, contains(lower(text), 'ing the') OR contains(lower(text), 'nicht') AS found FROM posts""",
    "dedup_first": f"WITH {LOAD} SELECT id, platform, sha1(text) AS text_sha1, arrival FROM fresh",
    "dedup_indexed": f"WITH {LOAD} SELECT id, platform, sha1(text) AS text_sha1, arrival FROM fresh",
    "ingest_report": f"""WITH {REPORT} SELECT source, posts_stored, duplicates_skipped, rejected, '' AS errors, true AS success,
        '2024-02-01 00:00:00.000000' AS started_at, '2024-02-01 00:01:30.000000' AS completed_at FROM report""",
    "ingest_run_report": """WITH docs AS (
            SELECT doc_id, event_type AS kind FROM documents JOIN events ON doc_id = event_id
        ), articles AS (
            SELECT page_id, url, event_type <> 'error' AS linked, page_id % 11 <> 0 AS dated FROM pages JOIN events ON page_id = event_id
        ), broken AS (SELECT count(*) AS unreadable FROM documents WHERE doc_id % 50 = 0
        ), sources AS (
            SELECT 'twitter' AS source, count(*) FILTER (doc_id % 13 <> 0) AS arrived,
                count(*) FILTER (doc_id % 13 <> 0 AND doc_id % 5 <> 0) AS stored,
                count(DISTINCT doc_id // 100) AS lines, 0 AS unnamed, count(*) FILTER (doc_id % 13 = 0) AS undated FROM docs
            UNION ALL SELECT 'reddit', count(*) FILTER (doc_id % 17 <> 0), count(*) FILTER (doc_id % 17 <> 0), count(*), 0,
                count(*) FILTER (doc_id % 17 = 0) FROM docs
            UNION ALL SELECT 'news', count(*) FILTER (linked AND dated), count(DISTINCT url) FILTER (linked AND dated), count(*),
                count(*) FILTER (NOT linked), count(*) FILTER (linked AND NOT dated) FROM articles
            UNION ALL SELECT 'podcast', count(*) FILTER (named), count(*) FILTER (named), count(*), count(*) FILTER (NOT named), 0
            FROM (SELECT doc_id % 19 <> 0 AND kind <> 'error' AS named FROM docs)
        )
        SELECT source, stored AS posts_stored, stored AS written, arrived - stored AS duplicates_skipped, 0::BIGINT AS rejected,
            concat_ws('; ', CASE WHEN unreadable > 0 THEN unreadable || ' unreadable lines' END,
                CASE WHEN unnamed > 0 THEN unnamed || ' records without ' || CASE source WHEN 'news' THEN 'url' ELSE 'identifier' END END,
                CASE WHEN undated > 0 THEN undated || ' records without date' END) AS errors,
            true AS success, '2024-02-01 00:00:00.000000' AS started_at, '2024-02-01 00:01:30.000000' AS completed_at,
            lines + unreadable AS landed, unreadable, unnamed + undated AS dropped
        FROM sources, broken""",
    "ingest_summary": f"""WITH {REPORT},
        spans AS (SELECT platform AS source, min(created_at) AS started_at, max(created_at) AS completed_at FROM incoming GROUP BY 1),
        broken AS (SELECT platform, count(*) AS n, min(created_at) AS low, max(created_at) AS high
            FROM posts WHERE doc_id % 11 = 0 GROUP BY 1),
        names(source) AS (VALUES ('twitter'), ('reddit'), ('news'), ('podcast'), ('letters'))
        SELECT source, true AS success,
            round((epoch_us(greatest(completed_at, high)) - epoch_us(least(started_at, low))) / 1000000, 1) AS duration_seconds,
            coalesce(posts_stored, 0) AS posts_stored, coalesce(duplicates_skipped, 0) AS duplicates_skipped,
            CASE WHEN b.n > 0 THEN 1 ELSE 0 END::BIGINT AS error_count,
            coalesce(CAST(b.n AS VARCHAR) || ' rows without author_id', '') AS first_errors,
            (SELECT count(*) FROM posts) AS total_posts,
            (SELECT count(*) FROM posts WHERE platform = 'twitter') AS twitter,
            (SELECT count(*) FROM posts WHERE platform = 'reddit') AS reddit,
            (SELECT count(*) FROM posts WHERE platform = 'news') AS news,
            (SELECT count(*) FROM posts WHERE platform = 'podcast') AS podcast,
            (SELECT count(*) FROM posts WHERE NOT processed) AS unprocessed
        FROM names LEFT JOIN report USING (source) LEFT JOIN spans USING (source) LEFT JOIN broken b ON b.platform = source""",
    "post_by_id": f"""WITH {POSTS} SELECT id, platform, author_id, sha1(text) AS text_sha1,
        {iso('created_at')} AS created_at, likes FROM posts WHERE id = 'doc_7'""",
    "unprocessed_topk": f"""WITH {POSTS}, newest AS (
            SELECT * FROM posts WHERE NOT processed ORDER BY posts.created_at DESC, id LIMIT 100
        )
        SELECT id, platform, {iso('created_at')} AS created_at FROM newest""",
    "mark_processed": f"WITH {POSTS} SELECT id, processed OR platform = 'news' AS processed FROM posts",
    "count_marked": f"WITH {POSTS} SELECT count(*) AS marked FROM posts WHERE platform = 'news'",
    "store_stats": f"""WITH {POSTS} SELECT count(*) AS total_posts, count(*) FILTER (platform = 'twitter') AS total_tweets,
        count(*) FILTER (NOT processed) AS unprocessed, count(*) FILTER (processed) AS processed,
        count(*) FILTER (platform = 'twitter') AS twitter, count(*) FILTER (platform = 'reddit') AS reddit,
        count(*) FILTER (platform = 'news') AS news, count(*) FILTER (platform = 'podcast') AS podcast FROM posts""",
    "posts_wide": f"""WITH {POSTS}, known AS (
            SELECT *, event_type <> 'error' AS k, platform = 'twitter' AS t, platform = 'reddit' AS r,
                platform = 'news' AS n, platform = 'podcast' AS p FROM posts
        )
        SELECT id, platform,
            CASE WHEN t THEN CASE WHEN k THEN doc_id ELSE 0 END END AS impressions,
            CASE WHEN t THEN CASE WHEN k THEN 1 ELSE 0 END END::BIGINT AS quote_tweets,
            CASE WHEN t THEN CASE WHEN k THEN 2 ELSE 0 END END::BIGINT AS bookmarks,
            CASE WHEN t AND k THEN 0.5 END::DOUBLE AS engagement_rate,
            CASE WHEN t THEN k END AS is_reply, CASE WHEN t THEN false END AS is_retweet,
            CASE WHEN r THEN CASE WHEN k THEN source ELSE '' END END AS subreddit,
            CASE WHEN r THEN CASE WHEN k THEN likes ELSE 0 END END AS upvotes,
            CASE WHEN r THEN CASE WHEN k THEN 1 ELSE 0 END END::BIGINT AS downvotes,
            CASE WHEN r THEN CASE WHEN k THEN 3 ELSE 0 END END::BIGINT AS awards,
            CASE WHEN r THEN NOT k END AS is_self, CASE WHEN r AND k THEN '/r/x' END AS permalink,
            CASE WHEN n THEN CASE WHEN k THEN source ELSE 'unknown' END END AS source_name,
            CASE WHEN n AND k THEN 'wire' END AS source_id,
            CASE WHEN n THEN CASE WHEN k THEN 'https://example.com/' || doc_id ELSE '' END END AS article_url,
            CASE WHEN p THEN CASE WHEN k THEN source ELSE 'unknown' END END AS show_name,
            CASE WHEN p THEN CASE WHEN k THEN 'e' || doc_id ELSE substr(text, 1, 120) END END AS episode_title,
            CASE WHEN p AND k THEN 'https://pod.example.com' END AS episode_url,
            CASE WHEN p AND k THEN 'rss:description' END AS transcript_source,
            CASE WHEN r AND k THEN 'r' || doc_id WHEN n THEN CASE WHEN k THEN 'n' || doc_id ELSE substr(text, 1, 120) END END AS title
        FROM known""",
    "group_key": f"WITH {KEYS} SELECT id, key FROM keyed",
    "top_keywords": f"WITH {KEYS},{RANKED_WORDS} SELECT key, rank, item, n FROM ranked_words",
    "top_cashtags": f"WITH {KEYS},{RANKED_TAGS} SELECT key, rank, item, n FROM ranked_tags",
    "clusters": f"""WITH {CLUSTERS} SELECT key, id, n_posts, {iso('first_seen')} AS first_seen,
        {iso('last_seen')} AS last_seen, confidence, array_to_string(cashtags, ',') AS cashtags,
        array_to_string(keywords, ',') AS keywords, platforms FROM clusters""",
    "membership": f"WITH {CLUSTERS} SELECT narrative_id, post_id FROM members",
    "narrative_labels": f"WITH {LABELS} SELECT id, name, description FROM labels",
    "labeler_hook": f"""WITH {LABELS} SELECT id,
        CASE WHEN len(cashtags) > 0 THEN cashtags[1] || ' in ' || least(3, n_posts) || ' samples' ELSE name END AS name,
        CASE WHEN len(cashtags) > 0 THEN upper(keywords[1]) ELSE description END AS description,
        array_to_string(CASE WHEN len(cashtags) > 0 THEN keywords[1:2] ELSE keywords END, ',') AS keywords,
        array_to_string(cashtags, ',') AS cashtags FROM labels""",
    "labeler_all_texts": f"""WITH {LABELS},
        seen AS (SELECT narrative_id AS id, count(*) AS texts, sum(length(text)) AS chars
            FROM members JOIN posts ON posts.id = post_id GROUP BY 1)
        SELECT id, CASE WHEN len(keywords) > 0 THEN keywords[1] || ': ' || texts || ' posts' ELSE name END AS name,
            CASE WHEN len(keywords) > 0 THEN CAST(chars AS VARCHAR) ELSE description END AS description,
            array_to_string(keywords[1:1], ',') AS keywords, array_to_string(cashtags, ',') AS cashtags
        FROM labels JOIN seen USING (id)""",
    "clusters_json": f"""WITH {LABELS} SELECT id, 'theme' AS kind, NULL AS post_id, name, n_posts FROM labels
        UNION ALL SELECT narrative_id, 'member', post_id, NULL, NULL FROM members""",
    "cluster_rank": f"""WITH {CLUSTERS},
        met AS (SELECT key, min((-epoch_us(created_at), tie)) AS first_post FROM keyed GROUP BY 1)
        SELECT id, n_posts, confidence, row_number() OVER (ORDER BY confidence DESC, n_posts DESC, first_post, key) AS rank
        FROM clusters JOIN met USING (key)""",
    "unprocessed_after_marks": f"""WITH {POSTS} SELECT id, platform FROM posts WHERE NOT processed AND platform <> 'news'""",
    "track_run": f"""WITH {CLUSTERS.replace("FROM posts p LEFT JOIN best", "FROM (SELECT * FROM posts WHERE NOT processed) p LEFT JOIN best")}
        SELECT id AS narrative_id, 'created' AS event, 1::BIGINT AS version, n_posts AS members,
            0::BIGINT AS left_unprocessed FROM clusters""",
    "store_roundtrip": f"""WITH {POSTS} SELECT id, platform, sha1(text) AS text_sha1, {iso('created_at')} AS created_at, likes,
        CASE WHEN platform = 'reddit' THEN source END AS subreddit FROM posts""",
    "sentiment_hits": f"WITH {POSTS},{PROSE} SELECT id, positive_hits, negative_hits FROM hit_counts",
    "post_sentiment": f"WITH {POSTS},{PROSE} SELECT id, score, {LABEL} AS label FROM scored",
    "custom_lexicon": f"""WITH {POSTS},{sentiment(('the', 'que', 'der'), NEGATIVE_WORDS)}
        SELECT id, positive_hits, negative_hits, score FROM scored""",
    "lexicon_table": f"""WITH {POSTS},
        first_words AS (
            SELECT regexp_extract(text, '([A-Za-z]{{3,}})', 1) AS word, lang = 'en' AS up, count(*) AS n FROM documents GROUP BY 1, 2
        ),
        lexicon AS (SELECT DISTINCT lower(word) AS word, up FROM first_words WHERE word <> '' AND n > 1),{
        sentiment(('+',), ('-',)).replace("'+'", "SELECT word FROM lexicon WHERE up").replace("'-'", "SELECT word FROM lexicon WHERE NOT up")}
        SELECT id, positive_hits, negative_hits, score FROM scored""",
    "top_terms": f"""WITH {POSTS},{PROSE},
        term_counts AS (
            SELECT sign, token, count(*) AS n, min((-epoch_us(created_at), substr(sha1(id), 1, 9), pos)) AS first
            FROM hit_signs JOIN posts USING (id) WHERE sign <> 0 GROUP BY sign, token
        )
        SELECT CASE sign WHEN 1 THEN 'positive' ELSE 'negative' END AS side,
            row_number() OVER (PARTITION BY sign ORDER BY n DESC, first, token) AS rank, token, n
        FROM term_counts QUALIFY rank <= 8""",
    "narrative_sentiment": f"""WITH {CLUSTERS},{PROSE},{THEME_SENTIMENT}
        SELECT narrative_id, score, {LABEL} AS label, sample_size FROM theme_sentiment""",
    "velocity": f"WITH {CLUSTERS},{THEME_SCORES} SELECT id, velocity_score FROM velocity",
    "saturation": f"WITH {CLUSTERS},{THEME_SCORES} SELECT id, saturation_score FROM saturation",
    "narrative_scores": f"""WITH {CLUSTERS},{THEME_SCORES}
        SELECT id, velocity_score, saturation_score FROM velocity JOIN saturation USING (id)""",
    "narrative_overall": f"""WITH {LABELS},{PROSE},{THEME_SENTIMENT},{THEME_SCORES},{OVERALL}
        SELECT id, sentiment_score, overall_score FROM overall""",
    "sentiment_report": f"""WITH {LABELS},{PROSE},{THEME_SENTIMENT},{THEME_SCORES},{OVERALL}
        SELECT id, name, upper(CASE WHEN sentiment_score > 0.2 THEN 'bullish' WHEN sentiment_score < -0.2 THEN 'bearish'
                ELSE 'neutral' END) AS label, sentiment_score, n_posts,
            CASE WHEN len(cashtags) > 0 THEN array_to_string(cashtags, ', ') ELSE 'N/A' END AS cashtags,
            CASE WHEN len(keywords) > 0 THEN array_to_string(keywords[1:6], ', ') ELSE 'N/A' END AS keywords,
            overall_score
        FROM overall""",
    "lifecycle_events": f"""WITH {LIFECYCLE}
        SELECT narrative_id, event, previous_version, new_version, run FROM events_seen""",
    "event_log": f"""WITH {LIFECYCLE}
        SELECT run, narrative_id, event AS event_type, previous_version, new_version, {iso('clock')} AS occurred_at,
            CASE WHEN event = 'deactivated' THEN '{{}}' ELSE '{{"name":"' || author_id || ' momentum"}}' END AS details
        FROM events_seen WHERE event <> 'unchanged'""",
    "event_summary": f"WITH {LIFECYCLE} SELECT event, count(*) AS n FROM events_seen GROUP BY 1 ORDER BY 1",
    "active_narratives": f"""WITH {LIFECYCLE}
        SELECT id, {iso('first_seen')} AS first_seen, {iso('last_seen')} AS last_seen, n AS n_posts, version,
            {iso('updated_at')} AS updated_at, overall_score, confidence, 'etf,flows' AS keywords
        FROM versions4 WHERE is_active""",
    "material_change": f"""WITH {THEMES}, full_themes AS (SELECT *, round(sentiment_score * 0.4, 4) AS overall_score FROM themes)
        SELECT n.slice AS slice, o.id, {_CHANGED} AS changed FROM full_themes o JOIN full_themes n ON o.id = n.id
        WHERE o.slice = n.slice - 1""",
    "stale_narratives": f"""WITH {THEMES}
        SELECT slice + 1 AS slice, id, 1::BIGINT AS version, {iso('last_seen')} AS last_seen FROM themes t
        WHERE slice < 2 AND NOT EXISTS (SELECT 1 FROM themes n WHERE n.slice = t.slice + 1 AND n.id = t.id)
            AND last_seen < (SELECT clock FROM clocks c WHERE c.slice = t.slice + 1) - INTERVAL 12 HOUR""",
    "corpus_summary": f"""WITH parts AS (
            SELECT doc_id // 100 AS part, string_agg(source, ', ' ORDER BY doc_id) AS titles, count(*) AS n,
                sum(len(regexp_extract_all(text, '[^{BLANK}]+', 0))) AS words
            FROM documents GROUP BY 1
        )
        SELECT min(part) - 1 AS part, 'Narratives (' || CAST(sum(n) AS VARCHAR) || ' items): ' AS text FROM parts
        UNION ALL SELECT part, CASE WHEN part > (SELECT min(part) FROM parts) THEN ', ' ELSE '' END || titles FROM parts
        UNION ALL SELECT max(part) + 1, '. Total word count: ' || CAST(sum(words) AS VARCHAR) || '.' FROM parts""",
    "stream_ingest_first_write": f"""WITH {LOAD}
        SELECT id, platform, sha1(text) AS text_sha1, arrival FROM incoming
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1""",
    "stream_windowed_velocity": f"""WITH {KEYS},
        windows AS (
            SELECT key, to_timestamp((((epoch_us(created_at) - 1) // 21600000000) - k) * 21600)::TIMESTAMP AS start,
                likes + replies + reposts AS engagement
            FROM keyed, range(4) r(k)
        )
        SELECT key, {iso('start')} AS window_start, {iso('start + INTERVAL 24 HOUR')} AS window_end, count(*) AS posts,
            {rounded('0.6::DOUBLE * least(1.0::DOUBLE, count(*) / 24 / 10) + 0.4::DOUBLE * least(1.0::DOUBLE, sum(engagement) / count(*) / 500)')} AS velocity_score
        FROM windows GROUP BY key, start""",
    "stream_lifecycle_events": f"""WITH {STREAM_LIFECYCLE},
        logged AS (
            SELECT * FROM versions1 UNION ALL BY NAME SELECT * FROM versions2 UNION ALL BY NAME SELECT * FROM versions3
        )
        SELECT id AS narrative_id, event AS event_type, previous_version, version AS new_version,
            {iso('clock')} AS occurred_at
        FROM logged WHERE event IS NOT NULL AND event <> 'unchanged'""",
}

# The same words as a table give the same terms.
ORACLES["lexicon_table_terms"] = ORACLES["top_terms"]
ORACLES["unprocessed_newest"] = ORACLES["unprocessed_topk"]
ORACLES["stream_bounded_dedup"] = f"WITH {POSTS} SELECT id, platform, {iso('created_at')} AS created_at FROM posts"
ORACLES["news_by_position"] = f"""WITH {NEWS}
    SELECT lang AS query, id, page_id AS position FROM news
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY page_id, id) <= 7"""
ORACLES["top_keywords_summarised"] = ORACLES["top_keywords"]
