"""Column functions: labels, payloads, coalescing chains, statistics and losses. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def some(c: Column | str) -> Column:
    """The value, null if it is an empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("string"), F.lit(""))


def first_of(columns: Iterable[str], have: Iterable[str]) -> Column:
    """The first value that isn't null or empty among those of the columns that exist; null if there is none."""
    have = set(have)
    found = [some(F.col(f"`{c}`")) for c in columns if c in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def lookup(values: Mapping[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def strict_lookup(values: Mapping[str, str], key: Column, what: str) -> Column:
    """As lookup; a key that isn't known raises."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("null")))).cast("string"))


def label_text(c: Column) -> Column:
    return F.when(F.trim(c.cast("string")) == "1", "positive").otherwise("negative")


def correctness(audit_label: Column) -> Column:
    return F.when(F.trim(audit_label.cast("string")) == "1", "correct").otherwise("incorrect")


def error_type(corruption: Column) -> Column:
    return strict_lookup(S.ERROR_TYPE_OF, corruption, "corruption_type")


def error_mode(corruption: Column) -> Column:
    return strict_lookup(S.ERROR_MODE_OF, corruption, "corruption_type")


def expected_correctness(kind: Column) -> Column:
    return F.when(kind == "none", "correct").when(kind.isin("false_positive", "false_negative"), "incorrect")


def input_text(report: Column, finding: Column, definition: Column, assigned: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Report: "), blank(report), F.lit("\nFinding: "), blank(finding), F.lit("\nDefinition: "), blank(definition), F.lit("\nAssigned label: "), blank(assigned))


def audit_json(correct: Column, kind: Column, rationale: Column | None = None) -> Column:
    """Compact JSON in fixed order; the rationale only if there is one."""
    fields = [correct.alias("correctness"), kind.alias("error_type")]
    if rationale is not None:
        fields.append(some(rationale).alias("rationale"))
    return F.to_json(F.struct(*fields))


def template_rationale(finding: Column, assigned: Column, reference: Column, correct: Column) -> Column:
    yes, no = F.concat(F.lit("The report provides evidence compatible with "), finding), F.concat(F.lit("The report does not provide evidence of "), finding)
    right = correct == "correct"
    return (
        F.when(right & (assigned == "positive"), F.concat(yes, F.lit(", so the positive assigned label is consistent.")))
        .when(right & (assigned == "negative"), F.concat(no, F.lit(", so the negative assigned label is consistent.")))
        .when((reference == "negative") & (assigned == "positive"), F.concat(no, F.lit(", so the positive assigned label is inconsistent.")))
        .otherwise(F.concat(yes, F.lit(", so the negative assigned label is inconsistent.")))
    )


def pct(n: Column, d: Column, digits: int = 2) -> Column:
    """Percentage, 0 for an empty denominator."""
    return F.coalesce(F.round(F.try_divide(n * F.lit(100.0), d), digits), F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0))


def coerce_binary(c: Column) -> Column:
    """Number or 0, truncated, held to 0 and 1."""
    x = F.nanvl(F.coalesce(F.expr("double(null)"), c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(1), F.greatest(F.lit(-1.0), F.least(F.lit(2.0), x)).cast("int")))


def parse_binary(c: Column) -> Column:
    """The first 0 or 1 anywhere, else 0."""
    return F.coalesce(F.regexp_extract(c, "([01])", 1).try_cast("int"), F.lit(0))


def rounded(v: Column, digits: int) -> Column:
    """v times 10 ** digits, rounded half away from 0, over 10 ** digits, all in doubles as SQL engines do: 0.27595 to four places is 0.2759. F.round goes by the shortest decimal instead."""
    return F.round(v * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def min_max(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def gate(a: Column, b: Column, tau: float) -> Column:
    """Softmax of a against b, in the form that doesn't overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((b - a) / F.lit(max(tau, 1e-6))))


def preference_loss(policy: Column, reference: Column, margin: Column, beta: float = 0.1, smoothing: float = 0.0, sft: Column | None = None, sft_weight: float = 0.0) -> Column:
    """Sigmoid preference loss of log ratios, shifted by a margin; plus weighted SFT loss."""
    x = F.lit(beta) * (policy - reference - margin)
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # noqa: E731  softplus
    loss = F.lit(1.0 - smoothing) * soft(-x) + F.lit(smoothing) * soft(x)
    return loss + F.lit(sft_weight) * sft if sft is not None else loss


def normalize_error_label(c: Column) -> Column:
    """An error type from a number, an alias or a spelling of it; null if it is none."""
    s = F.lower(F.trim(c.cast("string")))
    s = F.when(s.rlike(r"^[0-9]+\.0+$"), F.regexp_extract(s, r"^([0-9]+)", 1)).otherwise(s)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in S.LABEL_ALIASES.items() for x in kv]), F.translate(s, "- ", "__"))


def chat_text(messages: Column, role: str | tuple[str, ...] = "role", content: str | tuple[str, ...] = "content") -> Column:
    """`role: content` lines of messages that have content. Several names are tried in order, message by message, as ("role", "from") and ("content", "value")."""
    roles, contents = ((x,) if isinstance(x, str) else tuple(x) for x in (role, content))
    first = lambda m, names: F.coalesce(*[some(m[n]) for n in names], F.lit(""))
    kept = F.filter(messages, lambda m: first(m, contents) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.coalesce(some(first(m, roles)), F.lit("message")), F.lit(": "), first(m, contents))), "\n")


def message_names(kind) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Of an array of messages' type the names that there are for roles and for contents, in the order in which they count."""
    have = kind.elementType.names
    return tuple(n for n in ("role", "from") if n in have), tuple(n for n in ("content", "value") if n in have)


def required_label(label: Column, *shown: Column) -> Column:
    """label, or an error that names the record where it is none."""
    return F.coalesce(label, F.raise_error(F.concat_ws(" ", F.lit("a record has no known label:"), *(c.cast("string") for c in shown))).cast("string"))


def record_text(columns: list[str], field: str | None = None, message_columns: tuple[str, ...] = ("messages", "conversations")) -> Column:
    """A record's text: a named field; else the first text key; else its messages; else its titled fields."""
    if field is not None:
        if field not in columns:
            raise KeyError(f"there is no column {field!r}")
        return F.col(f"`{field}`").cast("string")
    chain = [first_of(S.TEXT_KEYS, columns), *(some(chat_text(F.col(c))) for c in message_columns if c in columns)]
    titled = [F.concat(F.lit(f"{title}: "), first_of(keys, columns)) for title, keys in S.TITLED_KEYS]
    return F.coalesce(*chain, some(F.concat_ws("\n", *titled)))


def record_label(columns: list[str], field: str | None = None) -> Column:
    """A record's error type from its label keys, JSON outputs, or correctness; null if it has none."""

    def read(c: Column) -> Column:
        c = c.cast("string")
        return F.when(F.ltrim(c).rlike(r"^[\[{]"), normalize_error_label(F.get_json_object(c, "$.error_type"))).otherwise(normalize_error_label(c))

    if field is not None:
        return read(F.col(f"`{field}`"))
    found = [read(F.col(f"`{k}`")) for k in S.LABEL_KEYS if k in columns]
    for k in ("output", "response", "completion", "target_text"):
        if k in columns:
            c = F.col(f"`{k}`").cast("string")
            found += [read(c), F.when(F.get_json_object(c, "$.correctness") == "correct", "none")]
    if "correctness" in columns:
        found.append(F.when(F.col("correctness") == "correct", "none"))
    return F.coalesce(*found) if found else F.lit(None).cast("string")
