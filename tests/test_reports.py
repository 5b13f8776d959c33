from lexarium.plans import reports


def test_reports_by_kind(spark):
    scores = spark.createDataFrame([("basic", "a", "fact", 1, 1.0, None), ("basic", "b", "idea", None, 0.0, None), ("drift", "a", "fact", 2, 0.5, "fallback"), ("drift", "b", "idea", None, 0.0, "community_missed")], "label string, qid string, kind string, rank int, rr double, diagnosis string")
    coverage = spark.createDataFrame([("chosen", 0.5, 0.25, 2.0)], "strategy string, coverage double, selectivity double, lift double")
    modes = reports.modes_report(scores, coverage)
    assert "| basic | 2 | 0.500 | 0.500 | - |" in modes and "| drift | 2 | 0.500 | 0.250 | community_missed 1, fallback 1 |" in modes
    assert "| chosen | 0.500 | 0.250 | 2.000 |" in modes and reports.COVERAGE_NOTE in modes and reports.COVERAGE_NOTE not in reports.modes_report(scores)
    asked = spark.createDataFrame([("a", "Who?"), ("b", "What?")], "qid string, query string")
    one = reports.questions_report(scores.filter("label = 'basic'"), asked)
    assert "| a | fact | 1 | 1.000 | Who? |" in one and "| all | 2 | 0.500 | 0.500 |" in one and one.index("| idea | 1 |") < one.index("| all | 2 |")


def test_multihop_and_router(spark):
    scores = spark.createDataFrame([("graph", "c", "cited 3-4", 1, 1.0, "neighbor"), ("graph", "d", "cited 10+", None, 0.0, None)], "level string, qid string, kind string, rank int, rr double, component string")
    bounds = spark.createDataFrame([("p", True, True, False, False), ("q", False, True, True, True)], "paper_id string, no_references boolean, no_title_key boolean, no_identifier_key boolean, unreachable boolean")
    text = reports.multihop_report(scores, bounds=bounds)
    assert "| graph | 2 | 0.500 | 0.500 | neighbor 1 |" in text and "| graph | cited 10+ | 1 | 0.000 |" in text and "| 2 | 1 | 2 | 1 | 1 |" in text
    routed = spark.createDataFrame([("x", "local", "strong"), ("y", "basic", "none")], "query_id string, mode string, confidence string")
    gold = spark.createDataFrame([("x", "k", ["local"]), ("y", "k", ["drift", "global"])], "query_id string, kind string, expected_modes array<string>")
    text = reports.router_report(routed, gold)
    assert "| k | 2 | 0.500 |" in text and "| y | k | drift|global | basic | none |" in text


def test_comparison(spark):
    changes = spark.createDataFrame([("l", "a", 1, 2, "worse"), ("l", "b", 1, None, "regression")], "label string, qid string, before int, after int, severity string")
    text = reports.comparison_report({"k": 1}, {"k": 1}, changes)
    assert text.index("| regression | l | b | 1 | - |") < text.index("| worse | l | a | 1 | 2 |")
    assert reports.comparison_report({"k": 1}, {"k": 2}, changes).startswith("# Not comparable")
