import json

import pytest

from plumbline.operators import analysis

SF = "/root/testdata/sf0.001"


def test_analysis_of_two_models(spark, tmp_path):
    from plumbline.plans import views as V

    models = {"one": V.predictions(spark, SF, 0), "two": V.predictions(spark, SF, 1)}
    found = analysis.analyze(models, str(tmp_path / "o"), "one")
    n = models["one"].count()
    assert found["models"]["one"]["metrics"]["total"] == n and sum(found["comparisons"]["two"].values()) == n
    assert json.loads((tmp_path / "o/metrics.json").read_text())["comparisons"] == found["comparisons"]
    text = (tmp_path / "o/report.md").read_text()
    assert "## Against one" in text and "| two |" in text
    wrong = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "o/errors/two")).count()
    assert wrong == sum(v for k, v in found["comparisons"]["two"].items() if k in ("regressed", "both_wrong"))
    outcomes = spark.read.json(str(tmp_path / "o/outcomes/one_vs_two"))
    assert {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()} == found["comparisons"]["two"]
    with pytest.raises(ValueError, match="no model"):
        analysis.analyze(models, base="three")
    with pytest.raises(Exception, match="only one model"):
        analysis.analyze({"one": models["one"], "two": models["two"].limit(3)}, base="one")


def test_arguments():
    assert analysis.parse_model("a=/x/y.jsonl") == ("a", "/x/y.jsonl") and analysis.parse_model("/x/y.jsonl") == ("y", "/x/y.jsonl")
    assert analysis.split_list(" a, ,b,") == ["a", "b"]
    with pytest.raises(ValueError):
        analysis.parse_model("=x")
