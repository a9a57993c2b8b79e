"""Posts and raw payloads made from the documents, events and pages tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow import schemas
from themeflow.operators.sentiment import Lexicon

# The default lexicon hardly occurs in invented prose.
PROSE_LEXICON = Lexicon(
    positive=("the", "for", "with", "die", "que", "los"),
    negative=("and", "was", "des", "from", "den"),
)
TWEETS_PER_PAGE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table of fewer splits than cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def documents_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").drop("n_chars"))
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return documents.join(events, F.col("doc_id") == F.col("event_id"))


def _likes() -> Column:
    return (
        F.when(F.col("doc_id") % 10 == 0, F.lit(-5)).otherwise(F.floor("value")).cast("long")
    )


def _cashtags() -> Column:
    source, lang = F.upper("source"), F.upper("lang")
    return (
        F.when(F.col("doc_id") % 15 == 0, F.array(source, lang))
        .when(F.col("doc_id") % 3 == 0, F.array(source))
        .otherwise(F.array().cast("array<string>"))
    )


def tagged_text() -> Column:
    """Text with a cashtag, a hashtag and a link, which the prose itself lacks."""
    return F.concat(
        "text", F.lit(" $"), F.upper("lang"), F.lit(" #"), "source",
        F.lit(" https://example.com/"), "doc_id",
    )


def posts(spark: SparkSession, sf_dir: str, *extra: Column | str) -> DataFrame:
    doc = F.col("doc_id")
    none = F.array().cast("array<string>")
    return documents_with_events(spark, sf_dir).select(
        F.concat(F.lit("doc_"), doc).alias("id"),
        F.element_at(
            F.array(*[F.lit(name) for name in ("twitter", "reddit", "news", "podcast")]),
            (doc % 4 + 1).cast("int"),
        ).alias("platform"),
        F.concat(F.lit("user_"), "user_id").alias("author_id"),
        F.concat(F.lit("user_"), "user_id").alias("author_username"),
        "text",
        F.col("ts").alias("created_at"),
        _likes().alias("likes"),
        (doc % 11).alias("replies"),
        (doc % 3).alias("reposts"),
        F.col("lang").alias("language"),
        _cashtags().alias("cashtags"),
        none.alias("hashtags"),
        none.alias("urls"),
        F.col("ts").alias("collected_at"),
        (doc % 5 == 0).alias("processed"),
        *extra,
    )


def latest(posts: DataFrame) -> Column:
    """Time of the newest post, the clock of every query here."""
    return posts.agg(F.max("created_at")).scalar()


def with_copies(posts: DataFrame) -> DataFrame:
    """Posts with an ``arrival`` number and later copies of some of them."""
    first = posts.withColumn("arrival", F.col("doc_id"))
    copies = first.filter(F.col("doc_id") % 7 == 0).withColumns(
        {
            "text": F.concat(F.lit("copy of "), "text"),
            "arrival": F.col("doc_id") + F.lit(1_000_000_000_000),
        }
    )
    return first.unionByName(copies)


def _through_json(df: DataFrame, schema) -> DataFrame:
    """Write each row as a JSON line and read it with the schema of the landed files."""
    lines = df.select(F.to_json(F.struct("*")).alias("line"))
    return lines.select(F.from_json("line", schema).alias("row")).select("row.*")


def tweet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages of up to 100 tweets with the users they mention."""
    kind = F.col("event_type")
    author = F.when(kind != "error", F.concat(F.lit("u"), "user_id"))
    tweet = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        author.alias("author_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        F.col("lang").alias("lang"),
        F.when(kind == "click", F.lit("1")).alias("in_reply_to_user_id"),
        F.struct(
            _likes().alias("like_count"),
            (F.col("doc_id") % 3).alias("retweet_count"),
            (F.col("doc_id") % 11).alias("reply_count"),
            F.floor("value").alias("impression_count"),
        ).alias("public_metrics"),
        F.struct(
            F.transform(_cashtags(), lambda tag: F.struct(tag.alias("tag"))).alias("cashtags")
        ).alias("entities"),
        F.when(kind == "view", F.array(F.struct(F.lit("retweeted").alias("type")))).alias(
            "referenced_tweets"
        ),
    )
    user = F.struct(author.alias("id"), F.concat(F.lit("name_"), "user_id").alias("username"))
    raw = documents_with_events(spark, sf_dir).select(
        F.lit("q").alias("query"),
        F.floor(F.col("doc_id") / TWEETS_PER_PAGE).alias("page"),
        tweet.alias("tweet"),
        F.when(author.isNotNull(), user).alias("user"),
    )
    pages = raw.groupBy("query", "page").agg(
        F.collect_list("tweet").alias("data"),
        F.struct(F.collect_set("user").alias("users")).alias("includes"),
    )
    return _through_json(pages, schemas.TWEET_PAGE)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = documents_with_events(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(kind != "error", F.concat(F.lit("user_"), "user_id")).alias("author"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.when(kind != "click", tagged_text()).alias("selftext"),
        F.unix_seconds("ts").cast("double").alias("created_utc"),
        _likes().alias("score"),
        (F.col("doc_id") % 11).alias("num_comments"),
        F.col("source").alias("subreddit"),
        (F.col("doc_id") % 3 == 0).alias("is_self"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("url"),
        (F.col("doc_id") % 2).alias("downs"),
        F.concat(F.lit("/r/"), "source", F.lit("/"), "doc_id").alias("permalink"),
        F.col("doc_id").alias("rank"),
    )
    return _through_json(raw, schemas.SUBMISSION)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    pages = spread(table(spark, sf_dir, "pages"))
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1)
    title = F.concat(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1),
        F.lit(" $"), F.upper(lang), F.lit(" #"), lang,
    )
    raw = pages.join(events, F.col("page_id") == F.col("event_id")).select(
        lang.alias("query"),
        F.col("page_id").alias("position"),
        F.struct(
            F.when(F.col("event_type") == "view", F.lit("wire")).alias("id"), host.alias("name")
        ).alias("source"),
        title.alias("title"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("  about "), host, F.lit(" "))).alias("description"),
        F.col("html").alias("content"),
        F.when(F.col("event_type") != "error", F.col("url")).alias("url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
    )
    return _through_json(raw, schemas.ARTICLE)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, doc = F.col("event_type"), F.col("doc_id")
    day = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    link = F.concat(F.lit("https://pod.example.com/"), doc)
    html = F.concat(F.lit("<p>"), tagged_text(), F.lit("</p>"))
    sound = F.struct(
        F.concat(F.lit("https://cdn.example.com/"), doc, F.lit(".mp3")).alias("href"),
        F.lit("Enclosure").alias("rel"),
        F.lit("audio/mpeg").alias("type"),
    )
    script = F.struct(
        F.concat(F.lit("https://cdn.example.com/"), doc, F.lit(".vtt")).alias("href"),
        F.lit("transcript").alias("rel"),
        F.lit("text/vtt").alias("type"),
    )
    raw = documents_with_events(spark, sf_dir).select(
        F.concat(F.lit("https://feeds.example.com/"), "source").alias("feed_url"),
        F.when(F.col("lang") != "es", F.col("source")).alias("show_name"),
        doc.alias("position"),
        F.when(kind == "view", F.concat(F.lit("guid-"), doc)).alias("id"),
        F.when(kind != "error", link).alias("link"),
        F.when(kind != "click", F.concat(F.lit(" Episode "), doc, F.lit(" "))).alias("title"),
        F.when(kind == "view", F.concat(day, F.lit(" GMT")))
        .when(kind == "click", F.concat(day, F.lit(" +0200")))
        .alias("published"),
        F.when(kind == "purchase", F.date_trunc("second", "ts")).alias("published_parsed"),
        F.array(F.struct(html.alias("value"))).alias("content"),
        F.lit("  ").alias("summary"),
        tagged_text().alias("description"),
        F.when(kind == "view", F.array(sound, script)).otherwise(F.array(script)).alias("links"),
    )
    return _through_json(raw, schemas.EPISODE)


#: Documents per landed file of a feed.
FEED_PAGE = 500


def _page_width(rows: DataFrame) -> int:
    """How many document numbers a page spans, so that a file of the fullest feed holds ``FEED_PAGE`` documents.

    Pages of so many numbers over all feeds would be a file for a few documents of each, and the files,
    each created, committed and listed by itself, would take longer than the texts.
    """
    feeds = rows.groupBy("source", F.col("doc_id") % 2).agg(
        F.count("*").alias("n"), (F.max("doc_id") - F.min("doc_id") + 1).alias("span")
    )
    widths = feeds.agg(F.min(F.floor(F.col("span") * FEED_PAGE / F.col("n")))).first()[0]
    return max(1, widths or FEED_PAGE)


def _escaped(value: Column) -> Column:
    """Text of an XML element; signs that XML can't hold become blanks."""
    value = F.regexp_replace(value, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\uFFFE\uFFFF]", " ")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def _element(name: str, value: Column) -> Column:
    """``<name>value</name>``, nothing for null."""
    return _wrapped(name, _escaped(value))


def _wrapped(name: str, escaped: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), escaped, F.lit(f"</{name}>")), F.lit(""))


def _link(rel: str, kind: str, value: Column, tag: str, attribute: str) -> Column:
    rel_text = f' rel="{rel}"' if rel else ""
    return F.coalesce(
        F.concat(F.lit(f"<{tag}{rel_text} type=\"{kind}\" {attribute}=\""), _escaped(value), F.lit('"/>')), F.lit("")
    )


def land_feeds(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Feeds as XML files: even documents as RSS under ``path``/rss, odd ones as Atom under ``path``/atom.

    Each line of a file is one element; a feed of many documents has several files.
    """
    kind, doc = F.col("event_type"), F.col("doc_id")
    rows = documents_with_events(spark, sf_dir)
    width = _page_width(rows)
    # Escaped once per document, for both elements that hold it.
    rows = rows.withColumn("body", _escaped(tagged_text()))
    day, instant = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    page = F.when(kind != "error", F.concat(F.lit("https://pod.example.com/"), doc))
    sound = F.when(kind == "view", F.concat(F.lit("https://cdn.example.com/"), doc, F.lit(".mp3")))
    script = F.concat(F.lit("https://cdn.example.com/"), doc, F.lit(".vtt"))
    name = F.when(kind == "view", F.concat(F.lit("guid-"), doc))
    title = F.when(kind != "click", F.concat(F.lit(" Episode "), doc, F.lit(" ")))
    html = F.concat(F.lit("&lt;p&gt;"), "body", F.lit("&lt;/p&gt;"))
    rss = F.concat(
        F.lit("<item>"), _element("guid", name), _element("title", title), _element("link", page),
        _element("pubDate", F.when(kind == "view", F.concat(day, F.lit(" GMT"))).when(kind == "click", F.concat(day, F.lit(" +0200")))),
        _element("dc:date", F.when(kind == "purchase", instant)), _wrapped("content:encoded", html),
        _wrapped("description", F.col("body")), _link("", "audio/mpeg", sound, "enclosure", "url"),
        _link("", "text/vtt", script, "podcast:transcript", "url"), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), _element("id", name), _element("title", title), _link("alternate", "text/html", page, "link", "href"),
        _link("enclosure", "audio/mpeg", sound, "link", "href"), _link("transcript", "text/vtt", script, "link", "href"),
        _element("published", F.when(kind == "view", instant)), _element("updated", F.when(kind == "click", instant)),
        _wrapped("content", html), F.lit("</entry>"),
    )
    show = F.concat(F.lit("Show & "), "source")
    spaces = "".join(f' xmlns:{x}="https://example.com/{x}"' for x in ("dc", "content", "podcast"))
    forms = {
        "rss": (0, rss, f"<rss{spaces}><channel><link>https://example.com</link>", "</channel></rss>"),
        "atom": (1, atom, "<feed>", "</feed>"),
    }
    for form, (parity, entry, head, tail) in forms.items():
        feed = F.concat(F.lit("https://feeds.example.com/"), "source", F.lit(f"/{form}"))
        mine = rows.filter(doc % 2 == parity).select(
            F.coalesce(feed, F.lit("none")).alias("feed_url"), F.floor(doc / width).alias("page"), "doc_id",
            show.alias("show"), entry.alias("line"),
        )
        ends = mine.groupBy("feed_url", "page").agg(F.min("show").alias("show"))
        first = F.concat(F.lit(head), _element("title", F.col("show")))
        lines = (
            mine.select("feed_url", "page", F.lit(1).alias("part"), "doc_id", "line")
            .unionByName(ends.select("feed_url", "page", F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), first.alias("line")))
            .unionByName(ends.select("feed_url", "page", F.lit(2).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(tail).alias("line")))
            .withColumn("page", F.coalesce(F.lpad(F.col("page").cast("string"), 12, "0"), F.lit("none")))
        )
        ordered = lines.repartition("feed_url", "page").sortWithinPartitions("feed_url", "page", "part", "doc_id")
        ordered.select("feed_url", "page", "line").write.partitionBy("feed_url", "page").text(f"{path}/{form}")
