"""The index of stored ids against plain sets, and what it reads."""

import pytest
from pyspark.sql import functions as F

from themeflow.operators import id_index, staging, store
from themeflow.operators.id_index import IdIndex


def ids_of(spark, numbers):
    return spark.createDataFrame([(f"post-{n}" if n is not None else None,) for n in numbers], "id string")


def names(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    found = IdIndex(str(tmp_path / "ids"), ids_per_bucket=16)
    found.add(ids_of(spark, [*range(0, 400), 5, 5, None]), 0)
    found.add(ids_of(spark, range(400, 430)), 1)
    found.add(ids_of(spark, []), 2)
    return found


def test_known_ids(spark, index):
    asked = ids_of(spark, [3, 3, None, 410, 399, 1000, 1001])
    assert names(index.known(asked)) == ["post-3", "post-399", "post-410"]
    assert names(index.known(asked, before=1)) == ["post-3", "post-399"]
    assert names(index.known(ids_of(spark, []))) == []
    everything = index.known(ids_of(spark, range(0, 2000)))
    assert names(everything) == sorted(f"post-{n}" for n in range(430))


def test_an_index_without_segments_knows_nothing(spark, tmp_path):
    empty = IdIndex(str(tmp_path / "none"))
    assert empty.known(ids_of(spark, [1])).count() == 0
    empty.add(ids_of(spark, []), 0)
    assert empty.known(ids_of(spark, [1])).count() == 0


def test_a_segment_added_again_replaces_itself(spark, index):
    index.add(ids_of(spark, [900]), 1)
    assert names(index.known(ids_of(spark, [410, 900]))) == ["post-900"]


def test_filters_rule_out_nearly_all_absent_ids(spark, index):
    absent = ids_of(spark, range(10_000, 14_000))
    wrong = index.candidates(absent).count()
    assert wrong < 4000 * 2 * 0.05
    # Every stored id passes its own filter.
    assert index.candidates(ids_of(spark, range(430))).select("id").distinct().count() == 430


def test_filters_stay_where_they_are(spark, index, monkeypatch):
    # The words of a filter aren't copied for each id that is asked; ids come in lists of bounded length.
    monkeypatch.setattr(id_index, "IDS_PER_LIST", 4)
    asked = ids_of(spark, [*range(390, 600), None])
    found = index.candidates(asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generated = [line.split("Generate", 1)[1] for line in plan.splitlines() if "Generate" in line]
    assert generated and not any("words" in line for line in generated)
    assert {r.id for r in found.collect()} >= {f"post-{n}" for n in range(390, 430)}
    assert names(index.known(asked)) == sorted(f"post-{n}" for n in range(390, 430))


def test_wrong_candidates_are_compared_exactly(spark, tmp_path):
    tight = IdIndex(str(tmp_path / "ids"), ids_per_bucket=64, bits_per_id=1, probes=1)
    tight.add(ids_of(spark, range(300)), 0)
    asked = ids_of(spark, range(200, 1500))
    assert tight.candidates(asked).count() > 150
    assert names(tight.known(asked)) == sorted(f"post-{n}" for n in range(200, 300))


def test_a_batch_reads_only_buckets_that_may_hold_its_ids(spark, index):
    folders = {r.bucket for r in index.read(spark).filter("segment = 0").select("bucket").distinct().collect()}
    assert len(folders) == 32
    asked = ids_of(spark, [7])
    found = [(r.segment, r.bucket) for r in index.candidates(asked).collect()]
    assert (0, index.read(spark).filter("id = 'post-7'").first().bucket) in found and len(found) <= 2
    read = index.read(spark, found)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({r.f for r in read.select(F.input_file_name().alias("f")).collect()}) == len(found)
    assert index.read(spark, []).count() == 0


def test_compaction(spark, index, tmp_path):
    merged = index.compacted(str(tmp_path / "merged"), spark, before=2)
    assert [r.segment for r in merged.filters(spark).select("segment").distinct().collect()] == [1]
    assert names(merged.known(ids_of(spark, range(0, 600)))) == sorted(f"post-{n}" for n in range(430))
    assert index.known(ids_of(spark, [410])).count() == 1


def test_new_posts_by_index_and_by_table_are_the_same(spark, make_posts, tmp_path):
    stored = make_posts(*[{"id": str(i)} for i in range(0, 60, 2)])
    batch = make_posts(*[{"id": str(i % 50)} for i in range(90)]).withColumn("arrival", F.monotonically_increasing_id())
    index = IdIndex(str(tmp_path / "ids"), ids_per_bucket=4)
    index.add(stored, 0)
    one, other = (sorted(store.new_posts(batch, x, "arrival").collect()) for x in (stored, index))
    assert one == other and len(one) == 25


def test_folders_staged_by_a_batch_go_with_it(spark):
    before = staging.stage(spark.range(2), "kept")
    with staging.staged_within(spark):
        inner = staging.stage(spark.range(3), "gone")
        path = inner.inputFiles()[0]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    assert before.count() == 2
