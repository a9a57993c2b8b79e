"""Table schemas.  Every reader uses one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
FLAG, TIME = T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(STRING)


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def required(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, f.dataType, f.nullable and f.name not in names) for f in schema]
    )


REQUIRED_POST_COLUMNS = ["id", "platform", "author_id", "author_username", "text", "created_at"]
POSTS = required(
    struct(
        id=STRING, platform=STRING, author_id=STRING, author_username=STRING, text=STRING,
        created_at=TIME, likes=LONG, replies=LONG, reposts=LONG, language=STRING,
        cashtags=STRINGS, hashtags=STRINGS, urls=STRINGS, collected_at=TIME, processed=FLAG,
    ),
    *REQUIRED_POST_COLUMNS,
)
POST_COLUMNS = POSTS.fieldNames()

EXTENSIONS = {
    "twitter": struct(
        post_id=STRING, impressions=LONG, quote_tweets=LONG, bookmarks=LONG,
        engagement_rate=DOUBLE, is_reply=FLAG, is_retweet=FLAG,
    ),
    "reddit": struct(
        post_id=STRING, subreddit=STRING, title=STRING, upvotes=LONG, downvotes=LONG, awards=LONG,
        is_self=FLAG, permalink=STRING,
    ),
    "news": struct(
        post_id=STRING, source_name=STRING, source_id=STRING, title=STRING, description=STRING,
        article_url=STRING, image_url=STRING,
    ),
    "podcast": struct(
        post_id=STRING, show_name=STRING, episode_title=STRING, episode_url=STRING,
        audio_url=STRING, transcript_source=STRING,
    ),
}

# Post ids of a theme live in MEMBERSHIP, one row each: a theme may hold any share of all posts,
# so no row carries the whole list.
NARRATIVES = struct(
    id=STRING, name=STRING, description=STRING, first_seen=TIME, last_seen=TIME, n_posts=LONG,
    members_digest=STRING, cashtags=STRINGS, keywords=STRINGS,
    sentiment_score=DOUBLE, velocity_score=DOUBLE, saturation_score=DOUBLE, overall_score=DOUBLE,
    is_active=FLAG, confidence=DOUBLE,
)
MEMBERSHIP = struct(narrative_id=STRING, post_id=STRING)
STATE = T.StructType([*NARRATIVES.fields, *struct(version=LONG, updated_at=TIME).fields])
EVENTS = struct(
    narrative_id=STRING, event_type=STRING, previous_version=LONG, new_version=LONG,
    occurred_at=TIME, details=STRING,
)

# Landed raw payloads.
USERS = T.ArrayType(struct(id=STRING, username=STRING))
TWEET_PAGE = struct(
    query=STRING,
    page=LONG,
    data=T.ArrayType(
        struct(
            id=STRING, text=STRING, author_id=STRING, created_at=STRING, lang=STRING,
            in_reply_to_user_id=STRING,
            public_metrics=struct(
                like_count=LONG, retweet_count=LONG, reply_count=LONG, quote_count=LONG,
                bookmark_count=LONG, impression_count=LONG,
            ),
            entities=struct(
                cashtags=T.ArrayType(struct(tag=STRING)),
                hashtags=T.ArrayType(struct(tag=STRING)),
                urls=T.ArrayType(struct(expanded_url=STRING)),
            ),
            referenced_tweets=T.ArrayType(struct(type=STRING, id=STRING)),
        )
    ),
    includes=struct(users=USERS),
)
SUBMISSION = struct(
    id=STRING, author=STRING, title=STRING, selftext=STRING, created_utc=DOUBLE, score=LONG,
    num_comments=LONG, subreddit=STRING, is_self=FLAG, url=STRING, downs=LONG,
    total_awards_received=LONG, permalink=STRING, rank=LONG,
)
ARTICLE = struct(
    query=STRING, position=LONG, source=struct(id=STRING, name=STRING), title=STRING,
    description=STRING, content=STRING, url=STRING, urlToImage=STRING, publishedAt=STRING,
    language=STRING,
)
LINKS = T.ArrayType(struct(href=STRING, rel=STRING, type=STRING))
EPISODE = struct(
    feed_url=STRING, show_name=STRING, position=LONG, id=STRING, guid=STRING, link=STRING,
    title=STRING, published=STRING, published_parsed=TIME, updated_parsed=TIME,
    content=T.ArrayType(struct(value=STRING)), summary=STRING, description=STRING, links=LINKS,
)

# One <item> of an RSS file; attributes carry an underscore.
_TAGS = T.ArrayType(struct(_url=STRING, _type=STRING))
FEED_ITEM = struct(
    guid=STRING, link=STRING, title=STRING, pubDate=STRING, description=STRING,
    **{"itunes:summary": STRING, "content:encoded": STRING, "dc:date": STRING},
    enclosure=_TAGS,
    **{"podcast:transcript": _TAGS},
    feed_url=STRING,
)

# What is kept of the element around them, <channel> or <feed>.
FEED_HEADER = struct(title=STRING)

# One <entry> of an Atom file.
ATOM_ENTRY = struct(
    id=STRING, title=STRING, published=STRING, updated=STRING, summary=STRING, content=STRING,
    link=T.ArrayType(struct(_href=STRING, _rel=STRING, _type=STRING)), feed_url=STRING,
)
