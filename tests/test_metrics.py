from pairlens.operators import metrics as M


def test_macro_mean_of_rounded_cells(spark):
    rows = [("e", "test", "food", "Negative", "Positive", 0.125), ("e", "test", "food", "Negative", "Positive", 0.125),
            ("e", "test", "food", "Positive", "Negative", 0.5), ("e", "test", "food", "unknown", "Negative", None)]
    errs = spark.createDataFrame(rows, "explainer string, split string, concept string, base_direction string, "
                                       "target_direction string, icace_error double")
    cells = M.score_cells(errs)
    byc = M.score_by_concept(cells).collect()[0]
    # cells: 0.125 -> 0.12 (half-even), 0.5, null (skipped): macro mean (0.12 + 0.5) / 2, pooled would differ
    assert abs(byc.average - 0.31) < 1e-12 and byc.n_cells == 2
    cov = M.coverage(errs).collect()[0]
    assert (cov.n_optional, cov.n_valid) == (4, 3)
