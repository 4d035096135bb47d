from pairlens.operators.pairs import mine_pairs

SCHEMA = ("id long, original_id long, is_original boolean, edit_type string, description string, "
          "review_majority string, food_aspect_majority string, ambiance_aspect_majority string, "
          "service_aspect_majority string, noise_aspect_majority string")


def _r(i, o, orig, et, food="Negative", amb="Negative"):
    return (i, o, orig, et, f"text {i}", "3", food, amb, "unknown", "unknown")


def test_pair_counts_per_original(spark):
    rows = [_r(0, 0, True, None), _r(1, 0, False, "food", food="Positive"), _r(2, 0, False, "food", food="unknown"),
            _r(3, 0, False, "ambiance", amb="Positive"),
            _r(10, 1, True, None),                        # original alone -> no pair
            _r(20, 2, False, "food", food="Positive"), _r(21, 2, False, "food")]  # edits without original
    df = spark.createDataFrame(rows, SCHEMA)
    p = mine_pairs(df, drop_unchanged=False)
    by = {}
    for r in p.collect():
        by.setdefault(r.original_id_base, []).append((r.kind, r.id_base, r.id_counterfactual))
    assert len(by[0]) == 3 + 3 + 2
    assert 1 not in by
    assert sorted(x[0] for x in by[2]) == ["edit_edit", "edit_edit"]
    # symmetric: every (a, b) has (b, a)
    s = {(a, b) for v in by.values() for _, a, b in v}
    assert all((b, a) in s for a, b in s)


def test_intervention_annotation_and_drop(spark):
    rows = [_r(0, 0, True, None, food="Negative"), _r(1, 0, False, "food", food="Negative"),
            _r(2, 0, False, "food", food=None)]
    p = mine_pairs(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.id_base, r.id_counterfactual, r.intervention_type) for r in p.collect())
    # (0,1) and (1,0) have the same label -> dropped; pairs with a null label side are kept
    assert got == [(0, 2, "food"), (1, 2, "food"), (2, 0, "food"), (2, 1, "food")]
