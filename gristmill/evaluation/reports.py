"""Reports: JSON, traces and Markdown beside one another, named by the time of the run. A report is small; tables of results stay in Spark."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from gristmill.sinks.files import write_atomic, write_json

TIERS = ("required", "preferred", "mentioned")
LEVELS = ("strong", "partial", "weak", "none")
STAMP = "%Y-%m-%dT%H-%M-%SZ"


def pct(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def number(x) -> str:
    """A whole number, or a dash."""
    return "–" if x is None else str(x)


def cell(text: str) -> str:
    """Text that keeps to its cell of a table."""
    return text.replace("|", "\\|").replace("\n", " ")


def quoted(items: list[str]) -> str:
    return ", ".join(f"`{x}`" for x in items) or "none"


def clip(text: str, most: int = 90) -> str:
    return text if len(text) <= most else text[:most] + "…"


def table(head: tuple[str, ...], rows: list[tuple]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(map(str, r)) + " |" for r in rows)]) + "\n"


def write(report: dict, markdown: str, folder: str | Path, started: datetime, traces: dict[str, dict] | None = None, rescored_from: str = "") -> Path:
    """<time>.json, <time>.md and <time>-traces/<id>.json; a rescored run is named after its source. The path of the Markdown."""
    base = Path(folder) / (started.strftime(STAMP) + ("-rescored" if rescored_from else ""))
    write_json(base.with_name(base.name + ".json"), report)
    for name, trace in (traces or {}).items():
        write_json(base.with_name(base.name + "-traces") / f"{name}.json", trace)
    path = base.with_name(base.name + ".md")
    write_atomic(path, markdown.encode())
    return path


def extraction_markdown(totals: dict, tiers: dict[str, dict], stages: dict[str, int], fixtures: list[dict], title: str) -> str:
    """Metric table, misses by stage, fixtures, misses and extras."""
    t = totals
    rows = [("Recall (strict)", pct(t["recall_strict"])), ("Recall (loose)", pct(t["recall_loose"])), ("Precision (loose)", pct(t["precision_loose"])), ("F1 (loose)", pct(t["f1_loose"])), ("Expected / predicted", f"{t['expected']} / {t['predicted']}"), ("Filler extracted", t["filler"]), ("Acceptable (not scored)", t["acceptable"]), ("Duplicates (not scored)", t["duplicate"])]
    for tier in TIERS:
        s = tiers.get(tier, {"loose": 0, "expected": 0})
        rows.append((f"Recall, {tier}", f"{pct(s['loose'] / s['expected'] if s['expected'] else 0)} ({s['loose']}/{s['expected']})"))
    rows += [(f"Tier accuracy, {k}", f"{pct(s['tier_correct'] / s['tier_checked'])} ({s['tier_correct']}/{s['tier_checked']})") for k in TIERS if (s := tiers.get(k, {})).get("tier_checked")]
    rows += [("Importance tier order", pct(t.get("tier_order"))), ("Alternative group F1", pct(t.get("group_f1")))]
    out = [f"# {title}\n", table(("Metric", "Value"), rows)]
    if stages:
        out += ["## Misses by stage\n", table(("Stage", "Misses"), sorted(stages.items()))]
    out += ["## Fixtures\n", table(("Fixture", "Recall (loose)", "Expected", "Predicted", "Filler"), [(cell(f["title"]), f"error: {cell(f['error'])}" if f.get("error") else pct(f["loose"] / f["expected"] if f["expected"] else 0), f["expected"], f.get("predicted", ""), f.get("filler", "")) for f in fixtures])]
    out.append("## Misses and extras\n")
    for f in (x for x in fixtures if not x.get("error")):
        out.append(f"### {f['title']}\n")
        out.append(f"- **Missed ({len(f['misses'])}):**" + ("\n" + "\n".join(f"  - `{m['value']}` ({m['stage']})" for m in f["misses"]) if f["misses"] else " none"))
        out.append(f"- **Extra ({len(f['extras'])}):** {quoted(f['extras'])}\n")
    return "\n".join(out) + "\n"


def checker_markdown(totals: dict, matrix: dict[str, dict[str, int]], pairs: list[dict], notes: list[dict], title: str, baseline: str = "") -> str:
    """Metric table, the other arm if it ran, the confusion of coverage, pairs, disagreements."""
    t = totals
    rows = [("**Coverage accuracy**", f"**{pct(t['coverage_exact'])}**"), ("Covered vs none agreement", pct(t["coverage_covered"])), ("Fit Score error, mean / max (points)", f"{t['fit_error']:.1f} / {t['fit_error_max']}"), ("Retrieval recall (all labels)", pct(t["retrieval_recall"])), ("Retrieval recall (strong + partial)", pct(t["retrieval_recall_strong_partial"])), ("Link precision", pct(t["link_precision"])), ("Link recall", pct(t["link_recall"])), ("Link F1", pct(t["link_f1"])), ("Strength exact / within one", f"{pct(t['strength_exact'])} / {pct(t['strength_near'])}")]
    out = [f"# {title}\n", table(("Metric", "Value"), rows), baseline, "## Coverage confusion (rows: label, columns: predicted)\n", table(("", *LEVELS), [(w, *(matrix.get(w, {}).get(g, 0) for g in LEVELS)) for w in LEVELS])]
    out += ["## Pairs\n", table(("Pair", "Resume", "Coverage", "Fit (predicted / labeled)"), [(cell(p["title"]), p["resume"], f"error: {cell(p['error'])}" if p.get("error") else pct(p["exact"] / p["total"] if p["total"] else 0), f"{number(p.get('fit_got'))} / {number(p.get('fit_want'))}") for p in pairs])]
    out.append("## Disagreements\n")
    for p in (x for x in pairs if not x.get("error")):
        mine = [n for n in notes if n["pair_id"] == p["pair_id"]]
        out.append(f"### {p['resume']} × {p['title']}\n")
        out += [f"- `{n['value']}`" + (f" ← {n['unit_id']} \"{clip(n.get('text') or '')}\"" if n.get("unit_id") else "") + f": want {n['want']}, got {n['got']}" for n in mine]
    return "\n".join(out) + "\n"


def baseline_markdown(model: str, pairs: list[dict], totals: dict) -> str:
    """Both arms against the Fit Score of the labels. pairs: title, resume, want, got, score, gaps_want, gaps, error."""
    t = totals
    money = lambda x: "–" if x is None else f"${x:.4f}"
    rows = [("Fit error vs labeled, mean / max", f"{t['fit_error']:.1f} / {t['fit_error_max']}", f"{t['baseline_error']:.1f} / {t['baseline_error_max']}"), ("Fit bias", f"{t['fit_bias']:+.1f}", f"{t['baseline_bias']:+.1f}"), ("Cost per pair", money(t.get("cost")), money(t.get("baseline_cost"))), ("Failed", f"{t['failed']}/{t['pairs']}", f"{t['baseline_failed']}/{t['baseline_ran']}")]
    each = [(cell(p["title"]), p["resume"], number(p["want"]), number(p["got"]), "error" if p.get("error") else number(p["score"]), cell("; ".join(p["gaps_want"])), cell(p.get("error") or "; ".join(p["gaps"]))) for p in pairs]
    return f"## Generative baseline (`{model}`)\n\n" + table(("", "Classifier", "Generative"), rows) + "\n" + table(("Pair", "Resume", "Labeled", "Classifier", "Generative", "Labeled gaps", "Generative gaps"), each)


def pairs_markdown(totals: dict, pairs: list[dict], title: str) -> str:
    """Agreement, and every pair in the order of `place`."""
    t = totals
    rows = [("**Match Score MAE vs reference**", f"**{t['mae'] or 0:.1f}** ({t['n']} pairs)"), ("Bias (match - reference)", f"{t['bias'] or 0:+.1f}"), ("Within ±5 / ±10", f"{100 * (t['within_5'] or 0):.0f}% / {100 * (t['within_10'] or 0):.0f}%"), ("Max error", f"{t['worst'] or 0:.0f}"), ("Pearson / Kendall τ-b vs reference", f"{t['pearson'] or 0:.2f} / {t['tau_b'] or 0:.2f}")]
    if t.get("fit_n"):
        rows.append(("Fit Score MAE / bias / τ-b", f"{t['fit_mae']:.1f} / {t['fit_bias']:+.1f} / {t['fit_tau_b'] or 0:.2f} ({t['fit_n']} pairs)"))
    two = lambda x: "–" if x is None else f"{x:.2f}"
    each = [(cell(p["title"] or p["pair_id"]), f"error: {cell(p['error'])}" if p.get("error") else number(p["match"]), "–" if p["reference"] is None else f"{p['reference']:.0f}", number(p.get("saved")), two(p.get("role_match")), two(p.get("experience_short")), two(p.get("blocker")), number(p.get("fit"))) for p in sorted(pairs, key=lambda p: p["place"])]
    return "\n".join([f"# {title}\n", table(("Metric", "Value"), rows), table(("Pair", "Match", "Reference", "Saved", "Role match", "Experience short", "Blocker", "Fit"), each)]) + "\n"


def labels_hash(records: list[tuple[str, dict]]) -> str:
    """Twelve hexadecimal digits over ids and labels in order."""
    import hashlib

    h = hashlib.sha256()
    for name, labels in records:
        h.update(f"{name}\n{json.dumps(labels, sort_keys=True, ensure_ascii=False)}\n".encode())
    return h.hexdigest()[:12]
