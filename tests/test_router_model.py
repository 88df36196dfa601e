"""A router model takes each text apart once, however many classifiers it has."""

import pytest

from routelake import catalogue
from routelake.operators import scoring


def test_one_pass_over_the_texts(spark):
    prompts = spark.createDataFrame([(1, "write code"), (2, ""), (3, None), (None, "debug the data")], "id long, text string")
    found = scoring.predict_with_model(prompts, "id", "text", catalogue.router_model())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == plan.count("regexp_extract_all") == 1
    got = {r["id"]: r for r in found.collect()}
    assert set(got) == {1, 2, 3, None} and all(r["difficulty_label"] and r["privacy_confidence"] > 0 for r in got.values())
    assert got[2]["task_type_coverage"] == 0 and got[2]["difficulty_margin"] is None


def test_labels_of_one_classifier_alone(spark):
    """Labels that only centroids or only naive Bayes know take part with what they have."""
    model = {"targets": ["t"], "classifiers": {"t": {"labels": ["b", "a"], "classes": {n: {"log_prior": -1.0, "unknown_log_likelihood": -5.0, "token_log_likelihoods": {}} for n in "ab"}}}, "centroid_classifiers": {"t": {"labels": ["c", "a"], "idf": {"write": 1.0}, "classes": {"a": {"centroid": {}}, "c": {"centroid": {"write": 0.18}}}}}}
    row = scoring.predict_with_model(spark.createDataFrame([(1, "write")], "id long, text string"), "id", "text", model).first()
    assert row["t_label"] == "c" and row["t_confidence"] == pytest.approx(1 / (1 + 2.718281828459045**-1)) and row["t_alternatives"] == ["a", "b"]
