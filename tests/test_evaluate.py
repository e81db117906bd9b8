"""Metric operators against hand-computed values."""

from lakejoin.operators import evaluate as E


def test_metrics_a(spark):
    preds = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("r", "z", 1)],
                                  "query_id string, cand_id string, rank int")
    run = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    truth = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "b", 2), ("s", "c", 0)],
                                  "query_id string, cand_id string, pos int")
    tq = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    m = {r.query_id: r for r in E.metrics_a(preds, run, truth, tq, 4).collect()}
    # q: hits at 1 and 3, precisions 1, 1/2, 2/3 -> AP = (1 + .5 + 2/3) / 4
    assert m["q"].hits == 2 and m["q"].gold_size == 2
    assert abs(m["q"].p_at_k - 0.5) < 1e-12 and abs(m["q"].r_at_k - 1.0) < 1e-12
    assert abs(m["q"].ap_at_k - (1 + 0.5 + 2 / 3) / 4) < 1e-12
    # r: empty truth entry still counted with zeros; s: no prediction -> zeros
    assert m["r"].gold_size == 0 and m["r"].r_at_k == 0.0 and m["s"].hits == 0
    o = E.overall_a(E.metrics_a(preds, run, truth, tq, 4), 4).first()
    assert o.num_queries == 3 and o.total_hits == 2 and o.total_gold == 3
    assert abs(o.micro_p - 2 / 12) < 1e-12 and abs(o.weighted_map - m["q"].ap_at_k * 2 / 3) < 1e-12


def test_metrics_b_multi_k(spark):
    ranking = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, cand_id string, rank int")
    run = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    truth = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2), ("r", "a", 0)],
                                  "query_id string, cand_id string, pos int")
    m = {(r.query_id, r.k): r for r in E.metrics_b(ranking, run, truth, [1, 2, 10]).collect()}
    assert set(m) == {("q", 1), ("q", 2), ("q", 10), ("r", 1), ("r", 2), ("r", 10)}  # s has no gold
    assert m[("q", 1)].p_at_k == 0.0 and m[("q", 1)].mrr_at_k == 0.0
    assert abs(m[("q", 2)].p_at_k - 0.5) < 1e-12 and abs(m[("q", 2)].mrr_at_k - 0.5) < 1e-12
    # K_eff = 3 for K = 10: precisions 0, 1/2, 2/3
    assert abs(m[("q", 10)].map_at_k - (0 + 0.5 + 2 / 3) / 3) < 1e-12
    assert abs(m[("q", 10)].r_at_k - 2 / 3) < 1e-12
    assert m[("r", 10)].p_at_k == 0.0  # no predictions -> zeros, still counted
    avg = {r.k: r for r in E.average_b(E.metrics_b(ranking, run, truth, [1, 2, 10])).collect()}
    assert avg[10].num_queries == 2
