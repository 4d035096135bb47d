import pytest
from pyspark.sql import functions as F

from pairlens.operators import hygiene as H

COLS = "g_id long, text string, generation string, failed boolean, base_direction string, target_direction string"


def _ids(df):
    return sorted(r.g_id for r in df.select("g_id").collect())


def test_drop_unsuccessful(spark):
    df = spark.createDataFrame([(1, "t", "x", True, "a", "b"), (2, "t", None, False, "a", "b"),
                                (3, "t", "", False, "a", "b"), (4, "t", "ok", False, "a", "b")], COLS)
    assert _ids(H.drop_unsuccessful(df)) == [4]


def test_drop_no_change_keeps_null_text(spark):
    df = spark.createDataFrame([(1, "same", "same", False, "a", "b"), (2, "t", "other", False, "a", "b"),
                                (3, None, "x", False, "a", "b")], COLS)
    assert _ids(H.drop_no_change(df)) == [2, 3]


def test_first_per_key(spark):
    df = spark.createDataFrame([(5, "t", "g", False, "a", "b"), (2, "t", "g", False, "a", "b"),
                                (3, "t", "g", False, "a", "c"), (7, "t", None, False, "a", "b"),
                                (8, "t", None, False, "a", "b")], COLS)
    assert _ids(H.first_per_key(df)) == [2, 3, 7]


def test_fault_words_substring_and_case(spark):
    df = spark.createDataFrame([(1, "t", "a preview", False, "a", "b"), (2, "t", "REVIEW x", False, "a", "b"),
                                (3, "t", "exchange", False, "a", "b"), (4, "t", None, False, "a", "b"),
                                (5, "t", "fine food", False, "a", "b")], COLS)
    assert _ids(H.drop_fault_words(df)) == [4, 5]


def test_fault_endings(spark):
    df = spark.createDataFrame([(1, "t", "great pizza", False, "a", "b"), (2, "t", "see the.", False, "a", "b"),
                                (3, "t", "good, however,", False, "a", "b"), (4, "t", "the ", False, "a", "b"),
                                (5, "t", "the\n", False, "a", "b")], COLS)
    assert _ids(H.drop_fault_endings(df)) == [2, 4, 5]


def test_decode_and_treatment_filter(spark):
    rows = [(1, "food", "Positive", 2, "0", "tensor(1)", "Negative"),
            (2, "food", "Negative", 2, "0", "tensor(1)", "Negative")]
    df = spark.createDataFrame(rows, "g_id long, intervention_aspect string, target_direction string, "
                                     "food_predictions_generation int, ambiance_predictions_generation string, "
                                     "service_predictions_generation string, noise_predictions_generation string")
    d = H.decode_predictions(df)
    got = {r.g_id: (r.food_predictions_generation, r.ambiance_predictions_generation,
                    r.service_predictions_generation) for r in d.collect()}
    assert got[1] == ("Positive", "unknown", "Negative")
    assert _ids(H.keep_treatment_consistent(d)) == [1]


def test_decode_unknown_code_raises(spark):
    df = spark.createDataFrame([(3,)], "x int")
    with pytest.raises(Exception):
        df.select(__import__("pairlens.functions.labels", fromlist=["x"]).decode_aspect_prediction(F.col("x"))).collect()


def test_dry_clean_idempotent(spark):
    df = spark.createDataFrame([(1, "t", "fine.", False, "a", "b"), (2, "t", "fine.", False, "a", "b"),
                                (3, "t", "pizza", False, "a", "b")], COLS)
    once = H.dry_clean(df)
    assert _ids(once) == [1]
    assert _ids(H.dry_clean(once)) == [1]


def test_faults_lower_a_text_once(spark):
    for faults in (H.ok_fault_words(), H.ok_fault_endings()):
        assert str(faults).count("lower(") == 1


def test_faults_at_once_as_one_by_one(spark):
    texts = ["a preview", "fine food", None, "great pizza", "good, however,", "the ", "the\n", "Mention", "", "CHANGE but", "İ the"]
    df = spark.createDataFrame([(i, "t", x, False, "a", "b") for i, x in enumerate(texts)], COLS)
    assert _ids(H.drop_faults(df)) == _ids(H.drop_fault_endings(H.drop_fault_words(df))) == [1, 2, 5, 6, 8]
    assert H.dry_clean(df)._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
