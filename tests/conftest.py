from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

from themeflow import schemas

NOW = datetime(2026, 3, 10, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("themeflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def post(id, text="", cashtags=(), minutes_ago=0, platform="twitter", author=None, likes=0,
         replies=0, reposts=0, processed=False):
    created = NOW - timedelta(minutes=minutes_ago)
    name = author or f"user-{id}"
    return (
        id, platform, name, name, text, created, likes, replies, reposts, None, list(cashtags), [],
        [], created, processed,
    )


@pytest.fixture
def make_posts(spark):
    return lambda *rows: spark.createDataFrame([post(**row) for row in rows], schemas.POSTS)
