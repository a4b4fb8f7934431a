"""Reports of a scored run, from a few collected summary rows: Markdown and self-contained HTML."""

from __future__ import annotations

import html
import os

from brightloom.core.canonical import exact_keys, stable_hash, validate_id, write_atomic
from brightloom.core.errors import SchemaError

SECTIONS = ("Metadata", "Intent", "Slot F1", "Joint turns", "Intent confusion", "Bootstrap CI", "Slices", "Limitations")
LIMITS = "Scores describe the given records only; intervals assume that records are independent."


KEYS = {"schema", "schema_version", "run_id", "record_count", "intent", "slot_strict", "slot_partial", "turn", "confusion", "slices", "metadata", "bootstrap"}


def summarise(rows, run_id: str, metadata: dict | None = None, slices: str | None = None, bootstrap: dict | None = None) -> dict:
    """The envelope of a run, from one table of scored records (see scoring.scored); it is read once per summary, so cache it.

    ``bootstrap``: key, seed, and maybe statistic, replicates and confidence.
    """
    from brightloom.operators import scoring

    one = lambda df: df.first().asDict()
    pairs = rows.selectExpr("gold_intent AS gold", "pred_intent AS pred")
    intent = one(scoring.accuracy(rows, "intent_ok"))
    return {
        "schema": "brightloom.run", "schema_version": 1, "run_id": validate_id(run_id, "run_id"), "record_count": intent["total"],
        "metadata": dict(sorted((metadata or {}).items())), "intent": intent,
        "slot_strict": one(scoring.micro(rows, "strict")), "slot_partial": one(scoring.micro(rows, "partial")), "turn": one(scoring.accuracy(rows, "turn_ok")),
        "confusion": [r.asDict() for r in scoring.confusion(pairs).orderBy("gold", "pred").collect()],
        "slices": [r.asDict() for r in scoring.slice_summary(rows, slices).orderBy("kind", "value").collect()] if slices else [],
        "bootstrap": scoring.bootstrap_statistic(rows, **({"name": "intent"} | bootstrap)) if bootstrap else None,
    }


def check_run(value) -> dict:
    """An envelope read from a file: its keys, version, counts and ratios."""
    run = exact_keys(value, KEYS, "run")
    if run["schema"] != "brightloom.run" or run["schema_version"] is True or run["schema_version"] != 1:
        raise SchemaError("unknown schema or version")
    validate_id(run["run_id"], "run_id")
    for part in ("intent", "turn"):
        p = exact_keys(run[part], {"correct", "total", "accuracy"}, part)
        if type(p["correct"]) is not int or not 0 <= p["correct"] <= p["total"] == run["record_count"] > 0:
            raise SchemaError(f"{part}: counts don't fit")
    for part in ("slot_strict", "slot_partial"):
        p = exact_keys(run[part], {"gold", "pred", "credit", "precision", "recall", "f1"}, part)
        if not 0 <= p["credit"] <= min(p["gold"], p["pred"]) or not all(0 <= p[k] <= 1 for k in ("precision", "recall", "f1")):
            raise SchemaError(f"{part}: counts don't fit")
    if sum(exact_keys(c, {"gold", "pred", "n"}, "confusion")["n"] for c in run["confusion"]) != run["record_count"]:
        raise SchemaError("the confusion matrix doesn't count all records")
    if run["bootstrap"] is not None and not run["bootstrap"]["low"] <= run["bootstrap"]["high"]:
        raise SchemaError("the interval is out of order")
    return run


def run_hash(summary: dict) -> str:
    return stable_hash(summary)


def _tables(s: dict) -> list[tuple[str, list[str], list[list]]]:
    """Sections as (title, header, rows), for both formats."""
    number = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    line = lambda d, keys: [number(d[k]) for k in keys]
    acc, prf = ["correct", "total", "accuracy"], ["gold", "pred", "precision", "recall", "f1"]
    ci = ["statistic", "estimate", "low", "high", "replicates", "confidence", "seed"]
    sl = ["kind", "value", "records", "intent_accuracy", "slot_strict", "slot_partial"]
    bodies = [
        (["key", "value"], [[k, str(v)] for k, v in s["metadata"].items()]), (acc, [line(s["intent"], acc)]),
        (["policy", *prf], [["strict", *line(s["slot_strict"], prf)], ["partial", *line(s["slot_partial"], prf)]]), (acc, [line(s["turn"], acc)]),
        (["gold", "pred", "n"], [line(r, ["gold", "pred", "n"]) for r in s["confusion"]]), (ci, [line(s["bootstrap"], ci)] if s["bootstrap"] else []),
        (sl, [line(r, sl) for r in s["slices"]]), (["note"], [[LIMITS]]),
    ]
    return [(t, h, r) for t, (h, r) in zip(SECTIONS, bodies, strict=True)]


def markdown(summary: dict) -> str:
    cell = lambda v: v.replace("|", "\\|").replace("\n", " ")
    out = [f"# Run {cell(summary['run_id'])}"]
    for title, header, rows in _tables(summary):
        out += ["", f"## {title}", ""]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in (header, ["---"] * len(header), *rows)] if rows else ["none"]
    return "\n".join(out) + "\n"


def html_page(summary: dict) -> str:
    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    body = "".join(
        f"<h2>{t}</h2>" + (f"<table>{row('th', h)}{''.join(row('td', r) for r in rows)}</table>" if rows else "<p>none</p>") for t, h, rows in _tables(summary)
    )
    name = html.escape(summary["run_id"])
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{name}</title></head><body><h1>Run {name}</h1>{body}</body></html>\n'


def write(summary: dict, folder: str, overwrite: bool = False) -> None:
    """report.md, then report.html, which completes the report."""
    if not overwrite and os.path.exists(f"{folder}/report.html"):
        raise FileExistsError(f"{folder} has a report")
    write_atomic(f"{folder}/report.md", markdown(summary))
    write_atomic(f"{folder}/report.html", html_page(summary))
