import pytest
from pyspark.sql import functions as F

from plumbline import schemas as S
from plumbline.operators import preference, validate

#: Made-up rows whose expected scores were worked out by hand from the formulas.
ROWS = [
    ("t1", "1", "train", "FINDINGS: No pneumothorax is seen. Heart is big.", "Pneumothorax", "air in the pleural space", "negative", "0", "1", "none"),
    ("t2", "1", "train", "The lungs are clear without effusion.", "Pleural effusion", "fluid", "positive", "0", "0", "negative_to_positive"),
    ("t3", "2", "val", "Cardiac silhouette is enlarged.", "Cardiomegaly", "enlarged cardiac silhouette", "negative", "1", "0", "positive_to_negative"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return preference.enriched(spark.createDataFrame(ROWS, S.AUDIT), fallback="template")


def test_risk_signals(rows):
    found = {r.sample_id: r for r in rows.select("sample_id", "s_neg", "s_imp", "risk").collect()}
    # "no" next to the anchor: 1 - exp(-1/2); one of the words no, pneumothorax, is, seen; anchors pneumothorax, pleural, space
    assert found["t1"].s_neg == 0.393469
    assert found["t1"].s_imp == round(1 / (4 * 3) ** 0.5, 6)
    # "without" is 1 from effusion, "clear" 2: 1 - exp(-(1/2 + 1/3))
    assert found["t2"].s_neg == 0.565402
    assert found["t3"].s_neg == 0.0
    assert found["t3"].risk.imp_evidence == "Cardiac silhouette is enlarged"


def test_records(rows):
    assert rows.count() == preference.sft(rows).count() == 3
    pairs = preference.dpo(rows).collect()
    assert sorted((p.sample_id, p.rejected_type) for p in pairs) == [("t1", "false_alarm"), ("t2", "decision_flip"), ("t2", "error_type_confusion"), ("t3", "decision_flip"), ("t3", "error_type_confusion")]
    assert next(p.rejected for p in pairs if p.sample_id == "t1") == '{"correctness":"incorrect","error_type":"false_negative"}'
    assert preference.dpo(rows, True, True).where("rejected_type = 'rationale_mismatch'").count() == 3
    assert validate.violations(preference.dpo(rows), "dpo").where("violation is not null").count() == 0
    assert validate.violations(preference.sft(rows), "sft", require_rationale=True).where("violation is not null").count() == 0
    with pytest.raises(validate.Violation):
        validate.require_valid(preference.sft(rows).withColumn("output", F.lit("{} x")), "sft")


def test_unknown_corruption_raises(spark):
    bad = spark.createDataFrame([(*ROWS[0][:9], "other")], S.AUDIT)
    with pytest.raises(Exception, match="unknown corruption_type"):
        preference.enriched(bad).select("gold_error_type").collect()


def test_margins(rows):
    pairs = preference.dpo(rows)
    by = {r.sample_id: r.margin for r in preference.margins(pairs, **preference.PRESETS["selected"]).collect()}
    assert by["t1"] == 0.1202
    assert all(0 <= m <= 0.7819 for m in by.values())
    assert {r.margin for r in preference.margins(pairs, mode="fixed", fixed_margin=0.4).collect()} == {0.4}
    assert preference.margin_stats(pairs.where("false")).first().s_neg_hi == 1.0
    named = preference.margins(pairs, prefix="x_")
    assert "x_margin" in named.columns


@pytest.mark.parametrize(("text", "side", "correct", "kind", "reason"), [
    ("Too short.", "positive", "correct", "none", "rationale is too short"),
    ("word " * 36, "positive", "correct", "none", "rationale is too long"),
    ("A clear opacity supports the 'positive' label here.", "positive", "correct", "none", "rationale contains quotation marks"),
    ("This assigned label of positive is fully supported today.", "positive", "correct", "none", "template-like rationale opening"),
    ("A clear opacity supports the label in this case.", "positive", "correct", "none", "rationale does not mention assigned label polarity"),
    ("A textbook opacity makes the positive label supported.", "positive", "correct", "none", "generic disease-definition phrase detected"),
    ("Clear lungs contradict the positive label given here.", "positive", "incorrect", "false_positive", "banned contradiction-style wording"),
    ("Clear lungs leave the negative label unsupported in this case.", "negative", "correct", "none", "correct negative label described as unsupported"),
    ("Clear lungs seem to support the positive label here.", "positive", "incorrect", "false_positive", "false positive rationale may imply positive support"),
    ("A large opacity shows the negative label is correct.", "negative", "incorrect", "false_negative", "false negative rationale says negative label is correct"),
    ("Clear lungs leave the positive label unsupported in this case.", "positive", "incorrect", "false_positive", "ok"),
])
def test_rationale_rules(spark, text, side, correct, kind, reason):
    df = spark.createDataFrame([(text, side, correct, kind)], "r string, a string, c string, k string")
    assert df.select(validate.rationale_reason(F.col("r"), F.col("a"), F.col("c"), F.col("k"))).first()[0] == reason
