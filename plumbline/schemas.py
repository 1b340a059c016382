"""Record schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# The label vocabulary in output order, enumerations, cues, stop words, headers, patterns and phrases.
LABELS = (
    "Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Enlarged Cardiomediastinum", "Fracture", "Lung Lesion", "No Finding",
    "Pleural Effusion", "Pleural Other", "Lung Opacity", "Pneumonia", "Pneumothorax", "Support Devices", "emphysema",
    "interstitial lung disease", "calcification(lung and mediastinal)", "Trachea and bronchus", "cavity and cyst", "mediastinal other",
    "pulmonary vascular abnormal",
)
NO_FINDING = "No Finding"
CORRECTNESS = ("correct", "incorrect")
ERROR_TYPES = ("none", "false_positive", "false_negative")
ERROR_TYPE_OF = {"none": "none", "negative_to_positive": "false_positive", "positive_to_negative": "false_negative"}
ERROR_MODE_OF = {"none": "None", "negative_to_positive": "FP", "positive_to_negative": "FN"}
CUES = ("no evidence of", "negative for", "not seen", "without", "no", "absent", "free of", "no acute", "clear", "normal", "unremarkable")
STOP_WORDS = ("a", "an", "and", "are", "as", "be", "between", "by", "for", "from", "in", "is", "of", "or", "other", "the", "to", "with", "within")
HEADERS = ("FINAL REPORT", "EXAMINATION", "INDICATION", "COMPARISON", "FINDINGS", "IMPRESSION", "HISTORY", "TECHNIQUE", "CHEST RADIOGRAPH", "PORTABLE CHEST", "PA AND LATERAL CHEST")
BARE_HEADERS = ("FINAL REPORT", "EXAMINATION", "FINDINGS", "IMPRESSION")
UNCERTAINTY = (r"\bcould be\b", r"\bmay reflect\b", r"\bmay represent\b", r"\bpossibly\b", r"\bpossible\b", r"\bcannot exclude\b", r"\bdifferential\b", r"\bversus\b", r"\bvs\.?\b")
INSTRUCTION = "You are a radiology label auditor. Given a radiology report, a candidate finding, its definition, and an assigned label, determine whether the assigned label is consistent with the report. Return JSON only."
LABEL_ALIASES = {
    "0": "none", "1": "false_positive", "2": "false_negative", "normal": "none", "correct": "none", "none": "none", "no_error": "none",
    "false_positive": "false_positive", "fp": "false_positive", "false_pos": "false_positive", "false_negative": "false_negative",
    "fn": "false_negative", "false_neg": "false_negative",
}
BANNED_STARTS = ("the assigned label", "this assigned label", "assigned label", "the report", "this report", "the label is", "there is", "there are")
GENERIC_PHRASES = ("typically manifest", "classic radiographic signs", "required for", "defined as", "textbook", "disease features", "features suggestive of", "features supporting", "features required")
BANNED_TERMS = (r"\bcontradict(?:s|ed|ing|ion|ory)?\b", r"\bconflict(?:s|ed|ing)?\b", r"\bnegat(?:es|ed|ing|ion|ions)\b")
NEGATIVE_UNSUPPORTED = (
    "negative label unsupported", "negative label is unsupported", "negative label remains unsupported", "negative edema label unsupported",
    "negative atelectasis label unsupported", "leave the negative label unsupported", "leaves the negative label unsupported", "leaving the negative label unsupported",
)
REPAIRS = (("—", ", "), ("–", ", "), ("鈥攎", ", m"), ("鈥攕", ", s"), ("鈥攆", ", f"), ("鈥攁", ", a"), ("鈥攖", ", t"), ("鈥?", ", "))
RATIONALE_PREFIXES = (
    r"^The report (?:explicitly )?(?:states|says|describes|notes|mentions|shows|identifies)\s+(?:that\s+)?",
    r"^This report (?:explicitly )?(?:states|says|describes|notes|mentions|shows|identifies)\s+(?:that\s+)?",
    r"""^The assigned label ['"]?(?:positive|negative)['"]?(?: for [^ ]+)? is (?:incorrect|correct) because\s+""",
    r"^The label is (?:incorrect|correct) because\s+",
    r"^There (?:is|are)\s+",
)
TEXT_KEYS = ("text", "input_text", "source", "prompt", "input", "query")
LABEL_KEYS = ("label", "labels", "error_type", "gold_error_type", "target", "answer")
TITLED_KEYS = (
    ("Report", ("report", "radiology_report", "findings_text", "findings", "impression")),
    ("Finding", ("finding", "finding_name", "finding_category")),
    ("Definition", ("definition", "finding_definition", "label_definition")),
    ("Assigned label", ("assigned_label", "assigned_label_text", "candidate_label")),
)
SPLIT_ALIASES = {"train": ("train",), "val": ("val", "valid", "validation", "dev"), "test": ("test",)}

AUDIT = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "study_id", "split", "report", "finding_category", "finding_definition", "assigned_label_text", "reference_label", "audit_label", "corruption_type")])
COMMON_KEYS = ("instruction", "input", "sample_id", "study_id", "finding_category", "assigned_label_text", "reference_label_text", "gold_correctness", "gold_error_type", "error_mode", "s_neg", "s_imp", "split")
SFT_KEYS = (*COMMON_KEYS, "output")
DPO_KEYS = (*COMMON_KEYS, "chosen", "rejected", "rejected_type")
