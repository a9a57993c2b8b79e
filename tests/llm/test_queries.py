"""Every query of the package on the smallest tables: its columns, and a row for each document."""

import os

import pytest
from pyspark.sql import functions as F

from themeflow.llm.oracles import ORACLES
from themeflow.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": None,
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_maxent_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
    "op7_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op12_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_other_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    ids = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id")
    if COLUMNS[name]:
        assert found.columns == COLUMNS[name]
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in ids.collect())
        assert found.select([F.count_if(F.col(c).isNull()).alias(c) for c in found.columns]).first().count(0) == len(found.columns)
    else:
        assert found.select("doc_id").distinct().count() == ids.count()
