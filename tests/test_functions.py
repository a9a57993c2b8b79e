import random
import re

import pytest
from pyspark.sql import functions as F

from themeflow.functions import dates, text
from themeflow.functions.core import exact_round, let, order_in_post, post_order, strip


def values(spark, rows, column, schema="text string"):
    df = spark.createDataFrame([(row,) for row in rows], schema)
    return [row[0] for row in df.select(column).collect()]


def test_tags_and_urls(spark):
    rows = ["$BTC and $toolongticker $1 #über #a_b #½ (see https://x.example/a?b=1) http://y.example z"]
    assert values(spark, rows, text.cashtags("text")) == [["BTC", "toolongtic"]]
    assert values(spark, rows, text.hashtags("text")) == [["über", "a_b", "½"]]
    assert values(spark, rows, text.urls("text")) == [["https://x.example/a?b=1", "http://y.example"]]


def test_tokens(spark):
    rows = ["The ETF of a2 would RISE_up, isn't 9lives"]
    assert values(spark, rows, text.keyword_tokens("text")) == [["the", "etf", "rise_up", "isn", "lives"]]
    assert values(spark, rows, text.sentiment_tokens("text")) == [
        ["the", "etf", "of", "a2", "would", "rise_up", "isn", "lives"]
    ]


def test_letters_that_lower_to_latin_ones_split_sentiment_words_only(spark):
    rows = ["ta\u212aen b\u0130gger"]
    sentiment = [t.lower() for t in re.findall("[A-Za-z][A-Za-z0-9_]{1,}", rows[0])]
    keywords = re.findall("[A-Za-z][A-Za-z0-9_]{2,}", rows[0].lower())
    assert values(spark, rows, text.sentiment_tokens("text")) == [sentiment]
    assert values(spark, rows, text.keyword_tokens("text")) == [keywords]


@pytest.mark.parametrize("seed", range(3))
def test_dominant_word_is_the_most_common_then_the_first(spark, seed):
    rng = random.Random(seed)
    rows = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))] for _ in range(60)]

    def expected(words):
        return max(words, key=lambda w: (words.count(w), -words.index(w)), default=None)

    found = values(spark, rows, text.dominant_word(F.col("text")), "text array<string>")
    assert found == [expected(words) for words in rows]


def test_title_case(spark):
    rows = ["etf2inflow", "a_b", "market"]
    assert values(spark, rows, text.title_case("text")) == [row.title() for row in rows]


def test_blanks(spark):
    rows = ["  a b\n", "", " \t"]
    assert values(spark, rows, strip("text")) == [row.strip() for row in rows]
    assert values(spark, rows, text.word_count("text")) == [len(row.split()) for row in rows]


def test_markup(spark):
    rows = ["<p>Hello <b>big</b>\n world</p>", "<br>"]
    assert values(spark, rows, text.markup_to_text("text")) == ["Hello big world", ""]


def test_paragraphs_keep_the_place_of_blank_parts(spark):
    rows = [["A ", "  ", None, "", "b"]]
    assert values(spark, rows, text.join_paragraphs(F.col("text")), "text array<string>") == ["A\n\n\n\nb"]


def test_any_keyword(spark):
    rows = ["Spot ETF", "macro"]
    assert values(spark, rows, text.contains_any("text", ["etf", "x"])) == [True, False]
    assert values(spark, rows, text.contains_any("text", [])) == [True, True]


def test_rounding_equals_round_half_even_on_binary_values(spark):
    rng = random.Random(5)
    rows = [0.33335, 0.03125, -0.03125, -0.00001, 1.0, 2.5e-5, 0.285, 1.005]
    rows += [rng.randrange(-99999, 99999) / 100000 for _ in range(300)]
    rows += [k / 32 for k in range(-40, 40)]
    for digits in (3, 4):
        found = values(spark, rows, exact_round(F.col("text"), digits), "text double")
        assert found == [round(row, digits) + 0.0 for row in rows]


def test_let_binds_once(spark):
    assert values(spark, ["ab"], let(F.upper("text"), lambda t: F.concat(t, t))) == ["ABAB"]


def test_iso_dates(spark):
    rows = ["2026-03-04T12:00:00Z", "2026-03-04T12:00:00.5+02:00", "2026-03-04", "2026-03", "soon", None,
            "2026-13-40T00:00:00Z"]
    found = values(spark, rows, F.date_format(dates.parse_iso("text"), "yyyy-MM-dd HH:mm:ss.S"))
    assert found == ["2026-03-04 12:00:00.0", "2026-03-04 10:00:00.5", "2026-03-04 00:00:00.0", None, None, None, None]


def test_mail_dates(spark):
    rows = ["Thu, 05 Mar 2026 15:00:00 GMT", "5 Mar 2026 15:00 +0200", "Thu, 05 Mar 2026 15:00:00 EST",
            "Thu, 05 Mar 2026 15:00:00", "yesterday", None]
    found = values(spark, rows, F.date_format(dates.parse_rfc2822("text"), "yyyy-MM-dd HH:mm:ss"))
    assert found == ["2026-03-05 15:00:00", "2026-03-05 13:00:00", "2026-03-05 20:00:00",
                     "2026-03-05 15:00:00", None, None]


def test_reading_order(spark, make_posts):
    posts = make_posts(
        {"id": "old", "minutes_ago": 5}, {"id": "new"}, {"id": "older", "minutes_ago": 6}
    )
    found = posts.select("id", order_in_post(post_order(), F.lit(7)).alias("o")).orderBy("o").collect()
    assert [row.id for row in found] == ["new", "old", "older"]
    assert all(int(row.o) % 10**8 == 7 for row in found)


def test_dates_as_the_standard_parsers_read_them(spark):
    from datetime import datetime

    iso = {
        "20260304T120000Z": datetime(2026, 3, 4, 12), "2026-03-04T12Z": datetime(2026, 3, 4, 12),
        "2026-W10-3": datetime(2026, 3, 4), "2026W103T0630": datetime(2026, 3, 4, 6, 30),
        "20260304": datetime(2026, 3, 4), "2026-03-04T12:30+01:00": datetime(2026, 3, 4, 11, 30),
        "2026-W54": None, "2026-13-01": None, "soon": None, "": None,
    }
    assert dict(zip(iso, values(spark, list(iso), dates.parse_iso("text")))) == iso
    mail = {
        "Thu, 05 Mar 26 15:00:00 GMT": datetime(2026, 3, 5, 15), "5 Mar 1999 01:02:03 +0130": datetime(1999, 3, 4, 23, 32, 3),
        "Fri, 05 Mar 99 15:00 EST": datetime(1999, 3, 5, 20), "Thu Mar  5 15:00:00 2026": datetime(2026, 3, 5, 15),
        "Thu Mar 35 15:00:00 2026": None, "later": None,
    }
    assert dict(zip(mail, values(spark, list(mail), dates.parse_rfc2822("text")))) == mail


def test_order_of_posts_before_the_epoch(spark):
    rows = spark.sql(
        "select id, cast(created_at as timestamp) created_at from values "
        "('a', '1931-01-01'), ('b', '1969-12-31'), ('c', '2026-01-01'), ('d', '9999-12-31'), ('e', '0001-01-01') t(id, created_at)"
    )
    order = [r.id for r in rows.orderBy(post_order()).select("id").collect()]
    assert order == ["d", "c", "b", "a", "e"]
    far = rows.select(order_in_post(post_order(), F.lit(10**10)).alias("o")).collect()
    assert all(r.o is not None for r in far)
