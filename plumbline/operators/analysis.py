"""Error analysis of several models: metrics, confusions, error rows and outcomes against a base, as files and one report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.sinks import markdown_table, write_csv, write_json, write_text
from . import structured as M


def parse_model(argument: str) -> tuple[str, str]:
    """(name, path) of `name=path`; a path alone names the model by its file, without the suffix."""
    name, mark, path = argument.partition("=")
    if not mark:
        name, path = argument.rstrip("/").rpartition("/")[2].rpartition(".")[0] or argument, argument
    if not name or not path:
        raise ValueError(f"not a name and a path: {argument!r}")
    return name, path


def split_list(text: str) -> list[str]:
    """The parts between commas, without spaces around them and without empty ones."""
    return [p for x in text.split(",") if (p := x.strip())]


def analyze(models: dict[str, DataFrame], out: str | None = None, base: str | None = None, *, key: str = "row_idx", k: int = 20, snippet: int = 500) -> dict:
    """Everything about the models' rows, each a frame with predictions and gold under the same keys; base is held against every other one.

    Returns the report's numbers. With out, writes there: report.md and metrics.json, for each model errors/NAME (CSV, the wrong rows),
    and for each other model outcomes/BASE_vs_NAME (JSON lines, a folder for each outcome). A row that only one of two compared models has raises.
    Small results alone come to the driver.
    """
    if not models:
        raise ValueError("there are no models")
    if base is not None and base not in models:
        raise ValueError(f"there is no model {base!r}")
    spark = next(iter(models.values())).sparkSession
    judged = {name: M.judged(df) for name, df in models.items()}
    rows = lambda df: [r.asDict() for r in df.collect()]
    found: dict = {"models": {}, "comparisons": {}}
    for name, j in judged.items():
        found["models"][name] = {"metrics": rows(M.every_metrics(j))[0], "confusion": rows(M.confusion(j).orderBy("gold", "predicted")), "by_gold": rows(M.by_gold(j).orderBy("gold"))}
        if "finding_category" in j.columns:
            found["models"][name]["worst"] = rows(M.worst(j, k=k))
        if "assigned_label_text" in j.columns:
            found["models"][name]["by_assigned"] = rows(M.by_assigned(j))
        if out:
            write_csv(M.error_rows(j, snippet), f"{out.rstrip('/')}/errors/{name}")
    for name, j in judged.items():
        if base is None or name == base:
            continue
        compared = M.compare(judged[base], j, key)
        found["comparisons"][name] = {r["outcome"]: r["n"] for r in rows(M.outcome_counts(compared))}
        if out:
            flat = compared.select(key, "outcome", "pred_text", "base_ok", "other_ok")
            flat.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("outcome").json(f"{out.rstrip('/')}/outcomes/{base}_vs_{name}")
    if out:
        write_json(spark, f"{out.rstrip('/')}/metrics.json", found)
        write_text(spark, f"{out.rstrip('/')}/report.md", markdown(found, base))
    return found


def markdown(found: dict, base: str | None = None) -> str:
    """The report of analyze()'s numbers."""
    parts = ["# Error analysis", "## Models", markdown_table([{"model": n} | m["metrics"] for n, m in found["models"].items()])]
    for name, m in found["models"].items():
        parts += [f"## {name}", "Gold and predicted error types", markdown_table(m["confusion"], ["gold", "predicted", "n"]), "By gold error type", markdown_table(m["by_gold"], ["gold", "n", "joint_accuracy"])]
        for title, part in (("Findings with the most errors", "worst"), ("By assigned label", "by_assigned")):
            if m.get(part):
                parts += [title, markdown_table(m[part])]
    if found["comparisons"]:
        columns = ["both_right", "corrected", "regressed", "both_wrong"]
        parts += [f"## Against {base}", markdown_table([{"model": n} | {c: v.get(c, 0) for c in columns} for n, v in found["comparisons"].items()], ["model", *columns])]
    return "\n\n".join(parts) + "\n"
