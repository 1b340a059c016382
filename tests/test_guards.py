import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as X
from plumbline.operators import label_metrics, leakage, predict, structured
from plumbline.sources import readers


def test_skip_invalid_reads_only_records(spark, tmp_path):
    lines = ['{"a":1}', '[{"a":2},{"a":3}]', '{"a":4} {"a":5}', "nope", "", '{"a":7}] [{"a":8}', '{"a":9}} {', '{"a":10},{"a":11}', '{"a":12},"b":1', '{"a":6, "b":"x"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), skip_invalid=True)
    assert sorted(tuple(r[c] for c in ("a", "b")) for r in got.collect()) == [(1, None), (6, "x")]
    with pytest.raises(readers.BadRecord):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"))


def test_rows_without_a_partner_raise(spark):
    gold = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "id long, x int, y int")
    same = label_metrics.confusion(gold, gold, ["id"], ["x", "y"]).collect()
    assert [(r.label_idx, r.label, r.tp, r.fp, r.fn, r.tn) for r in same] == [(0, "x", 2, 0, 0, 1), (1, "y", 1, 0, 0, 2)]
    for a, b in ((gold, gold.limit(1)), (gold.limit(1), gold)):
        with pytest.raises(Exception, match="without a partner"):
            label_metrics.confusion(a, b, ["id"], ["x", "y"]).collect()
    assert label_metrics.confusion(gold.limit(0), gold.limit(0), ["id"], ["x"]).count() == 0
    a, b = (spark.createDataFrame(rows, "row_idx long, joint_ok boolean") for rows in ([(1, True), (2, False)], [(1, False), (2, True)]))
    assert {r.row_idx: r.outcome for r in structured.compare(a, b).collect()} == {1: "regressed", 2: "corrected"}
    with pytest.raises(Exception, match="only one model"):
        structured.compare(a, b.where("row_idx = 1")).collect()
    with pytest.raises(Exception, match="only one model"):
        structured.compare(a.where("row_idx = 1"), b).collect()


def test_row_numbers(spark):
    df = spark.range(100).repartition(7).sortWithinPartitions("id")
    assert sorted(r.row_idx for r in readers.with_row_index(df).collect()) == list(range(100))
    assert readers.with_row_index(df.limit(0)).columns == ["id", "row_idx"]


def test_chat_aliases_and_labels(spark):
    df = spark.createDataFrame([([{"role": None, "from": "human", "content": "", "value": "hi"}, {"role": "gpt", "from": "x", "content": "yes", "value": "no"}],)], "m array<struct<role: string, `from`: string, content: string, value: string>>")
    names = X.message_names(df.schema["m"].dataType)
    assert df.select(X.chat_text(F.col("m"), *names)).first()[0] == "human: hi\ngpt: yes"
    with pytest.raises(Exception, match="no known label: 7"):
        spark.range(1).select(X.required_label(F.lit(None).cast("string"), F.lit(7))).collect()


def test_extraction_slice_and_replies(spark):
    reports = spark.createDataFrame([(i, f"report {i}") for i in range(6)], "id long, report string")
    got = predict.extract_labels(reports, lambda: lambda p: "1", ["id"], labels=("A", "B"), start=2, limit=3, raw=True).collect()
    assert sorted(r.id for r in got) == [2, 3, 4] and all(r.raw == {"A": "1", "B": "1"} and r.A == 1 for r in got)


def test_leakage_verdict():
    none = {"overlaps": [{"field": "sample_id", "a": "train", "b": "val", "n": 0}]}
    some = {"overlaps": [{"field": "input_hash", "a": "train", "b": "test", "n": 3}]}
    assert leakage.verdict(none)[-1].startswith("OK") and leakage.verdict(some) == ["train and test share 3 input texts.", "LEAKAGE: the splits are not apart."]
