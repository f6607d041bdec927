"""Registered queries read the whole of their input."""

import datetime as dt

from fiscora.operators import suppliers
from fiscora.plans import catalogue


def test_path_token_of_whole_texts(spark, tmp_path):
    long = " ".join(f"Palabra{i}" for i in range(40))
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", "La Casa S.A.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["turn"]: r["token"] for r in catalogue.q_path_token(spark, str(tmp_path)).collect()}
    assert found == {0: long.upper().replace(" ", "_"), 1: "LA_CASA_S_A"}


def test_occasional_outside_of_catalogue(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("30-00000001-1", "A", f"k{d}", "F", at(d)) for d in (1, 2, 3, 3)] + [("30-00000002-2", "B", f"k{d}", "F", at(d)) for d in (1, 2)] + [("30-00000003-3", "C", "k", "F", at(1)), ("12", "D", "k", "F", at(1))]
    seen = spark.createDataFrame(rows, "tax_id string, name string, document_key string, folder string, seen_at timestamp")
    known = spark.createDataFrame([("30000000033",), (None,)], "tax_id string")
    found = {r["name"]: (r["occurrences"], r["review"]) for r in suppliers.occasional(seen, known).collect()}
    assert found == {"A": (3, True), "B": (2, False)}
