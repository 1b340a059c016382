from pyspark.sql import functions as F

from plumbline.functions import scalars as X
from plumbline.functions import text as Y
from plumbline.functions.jsonx import payload, schema_valid
from plumbline.operators import label_metrics, leakage, predict, structured
from plumbline.streaming.metrics import rolling_metrics

GOOD = '{"correctness":"correct","error_type":"none"}'
BAD = '{"correctness":"incorrect","error_type":"false_positive"}'


def test_payload(spark):
    cases = {GOOD: (True, True), f"so: {GOOD}.": (True, True), f"{GOOD} {GOOD}": (False, False), "{}": (True, False), "[1]": (True, False), "no": (False, False), '{"correctness":"correct","error_type":"false_positive"}': (True, False), '{"error_type": 1}': (True, False), '{"a":{"b":1},"correctness":"incorrect","error_type":"false_negative"}': (True, True)}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").withColumn("p", payload(F.col("t")))
    got = {r.t: (r.v, r.s) for r in df.select("t", F.col("p.valid").alias("v"), schema_valid(F.col("p")).alias("s")).collect()}
    assert got == cases


def test_two_conventions(spark):
    rows = [(0, GOOD, GOOD), (1, "x", BAD), (2, GOOD, BAD), (3, '{"correctness":"incorrect","error_type":"none"}', GOOD)]
    j = structured.judged(spark.createDataFrame(rows, "row_idx int, predict string, label string"))
    a, b = structured.parsable_metrics(j).first(), structured.every_metrics(j).first()
    assert (a.total, a.valid_json, a.joint_accuracy, a.missed_error_rate, a.false_alarm_rate) == (4, 75.0, 25.0, 100.0, 0.0)
    assert (b.missed_error_rate, b.false_alarm_rate, b.invalid_error_types) == (50.0, 50.0, 0)
    outcomes = {r.outcome: r.n for r in structured.outcome_counts(structured.compare(j, j)).collect()}
    assert outcomes == {"both_right": 1, "both_wrong": 3}
    assert {r.gold: r.n for r in structured.by_gold(j).collect()} == {"none": 2, "false_positive": 2, "false_negative": 0}


def test_label_metrics_identity(spark):
    gold = spark.createDataFrame([("1", "1", "0", "abc"), ("2", "2", "-1", None)], ["id", "calcification(lung and mediastinal)", "B", "C"])
    counts = label_metrics.confusion(gold, gold, ["id"], ["calcification(lung and mediastinal)", "B", "C"])
    s = label_metrics.summary(counts).first()
    assert (s.n_reports, s.n_labels, s.micro_f1, round(s.macro_f1, 6)) == (2, 3, 1.0, 0.333333)


def test_leakage(spark):
    rows = [("a", "1", "Same  TEXT", "train"), ("b", "1", "same text", "test"), ("c", "", "other", "val")]
    k = leakage.record_keys(spark.createDataFrame(rows, "sample_id string, study_id string, text string, _split string"))
    n = {(r.field, r.a, r.b): r.n for r in leakage.overlap_counts(k).collect()}
    assert n["input_hash", "train", "test"] == n["study_id", "train", "test"] == 1 and sum(n.values()) == 3
    assert leakage.report(k)["leak"]


def test_scalars(spark):
    df = spark.createDataFrame([("Label 0/1", "FP", "fx"), ("none", "2.0", "")], "r string, l string, x string")
    got = [tuple(r) for r in df.select(X.parse_binary(F.col("r")), X.normalize_error_label(F.col("l")), X.coerce_binary(F.col("x"))).collect()]
    assert got == [(0, "false_positive", 0), (0, "false_negative", 0)]
    loss = spark.range(1).select(X.preference_loss(F.lit(2.0), F.lit(1.0), F.lit(0.5), beta=1.0)).first()[0]
    assert round(loss, 9) == round(0.4740769841801067, 9)


def test_text(spark):
    t = spark.createDataFrame([("FINAL REPORT\nFINDINGS: Heart is normal.Lungs are clear! ok.",)], "t string")
    assert t.select(Y.sentences(F.col("t"))).first()[0] == ["Heart is normal", "Lungs are clear!"]
    assert t.select(Y.tokens(F.lit("A b-c 1x ab é"))).first()[0] == ["b-c", "ab"]
    assert t.select(Y.clean_rationale(F.lit(" The report states that  lungs—clear"))).first()[0] == "Lungs, clear"


def test_models_fail_without_losing_rows(spark):
    reports = spark.createDataFrame([("1", "fluid"), ("2", "boom")], "study_id string, report string")

    def factory():
        def ask(prompt):
            if "boom" in prompt:
                raise TimeoutError("late")
            return "1" if "[Target Condition] Edema" in prompt else "no, 0"

        return ask

    got = {r.study_id: r for r in predict.extract_labels(reports, factory, ["study_id"], labels=("Edema", "No Finding", "Fracture")).collect()}
    assert (got["1"]["Edema"], got["1"]["Fracture"], got["1"]["No Finding"], got["1"].error) == (1, 0, 0, None)
    assert got["2"]["Edema"] is None and "TimeoutError" in got["2"].error
    assert predict.extract_labels(reports, factory, ["study_id"], labels=("Edema", "Fracture"), done=reports.limit(1)).count() == 1


def test_rationales_retry(spark):
    audit = spark.createDataFrame([("s1", "1", "train", "clear", "Edema", "fluid", "positive", "0", "0", "negative_to_positive")], "sample_id string, study_id string, split string, report string, finding_category string, finding_definition string, assigned_label_text string, reference_label string, audit_label string, corruption_type string")

    def factory():
        return lambda prompt: '{"rationale":"Clear lungs leave the positive label unsupported in this case."}' if "previous draft" in prompt else '{"rationale":"short"}'

    r = predict.generate_rationales(audit, factory, wait=0).collect()
    assert [(x.status, x.attempts) for x in r] == [("ok", 2)]
    assert predict.generate_rationales(audit, lambda: lambda p: "x", wait=0, attempts=2).first().status == "failed"


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", GOOD, GOOD), ("2024-01-01 00:20:00", "x", GOOD)]
    spark.createDataFrame(rows, "ts string, predict string, label string").select(F.col("ts").cast("timestamp").alias("ts"), "predict", "label").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, predict string, label string").parquet(str(tmp_path / "in"))
    q = rolling_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("rolling").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.total, r.valid_json) for r in spark.sql("select * from rolling").collect()] == [(2, 50.0)]
