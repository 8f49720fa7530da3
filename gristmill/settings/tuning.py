"""The tuning file: every prompt and every weight. YAML or JSON text; unknown keys and missing values are reported together.

The wording below is this package's own default; weights fitted on another wording belong to a file with that wording.
"""

from __future__ import annotations

import copy
import hashlib
import json
import math
from pathlib import Path

from gristmill.functions import lexicon as X

VERSION = 1
SECTIONS = ("required", "preferred", "responsibilities", "company", "benefits", "other")
STRENGTHS = ("strong", "partial", "weak", "none")

DEFAULT: dict = {
    "version": VERSION,
    "match_score": dict(zip(("intercept", "role_match", "experience_short"), X.MATCH_WEIGHTS, strict=True)),
    "fit_score": {"credit": {k: v for k, v in X.CREDIT.items() if k != "none"}, "tier_weight": dict(X.TIER_WEIGHT)},
    "holistic": {
        "role_match": {"question": "How near is the candidate's usual kind of work to the kind of work offered?", "levels": ["another profession", "a neighbouring specialty", "one field, another focus", "one role, another stack", "one role and one stack"]},
        "experience_short": {"question": "Has the candidate clearly less experience than is asked for?", "if_true": "clearly less", "if_false": "as much, or nearly"},
        "blocker": {"question": "Does the posting name a status condition that the candidate fails?", "if_true": "a named condition fails", "if_false": "none is named, or none fails"},
    },
    "extractor": {
        "section": {
            "question": "To which part of the posting does the sentence belong, given the heading above it?",
            "options": {"required": "what a candidate must have", "preferred": "what is welcome but optional", "responsibilities": "what the person will do", "company": "about the employer", "benefits": "pay and perks", "other": "anything else"},
        },
        "job_summary": {"system_prompt": "Say in two or three plain sentences what the job is."},
        "validation": {"question": "Which option names the skill or qualification in the chunk in full, without padding; or what is it instead?", "reject_options": {"trait": "a personal trait", "context": "people, teams or products", "action": "a vague activity", "condition": "a condition of the job"}},
        "refinement": {
            "filler": {"question": "What is the requirement?", "keep": "something specific that a resume can show", "reasons": {"vague": "too broad to check", "trait": "a personal trait", "internal": "known only inside the company", "condition": "a condition of the job"}},
            "duplicate": {"question": "Which option is another name of the same thing?", "reasons": {"different": "none is", "broader_or_narrower": "the nearest is wider or narrower", "related": "the nearest only goes with it"}},
            "alternative": {"question": "Which option would the employer take instead of the requirement?", "reasons": {"together": "they are asked for together", "unrelated": "none would do instead"}},
            "importance": {"question": "How much does the requirement matter to the employer?", "levels": ["in passing", "part of the work", "welcome", "asked for", "stressed"]},
        },
    },
    "checker": {
        "retrieval": {"question": "For which requirement is the statement the most direct evidence?", "context_prefix": "From the posting: ", "none": "for none of them"},
        "gate": {"task": "Is the statement evidence for the requirement?", "if_true": "it shows or names it", "if_false": "it only resembles it"},
        "strength": {"task": "How strongly does the statement show the requirement?", "options": {"strong": {"what": "work with the requirement itself"}, "partial": {"what": "work with a part of it or around it"}, "weak": {"what": "the requirement is only named"}, "none": {"what": "nothing to do with it"}, "other_tool": {"what": "another tool of the same kind"}}},
    },
}

#: Tables whose keys the file chooses.
FREE = {"extractor.section.options", "extractor.validation.reject_options", "extractor.refinement.filler.reasons", "extractor.refinement.duplicate.reasons", "extractor.refinement.alternative.reasons", "checker.strength.options", "fit_score.credit", "fit_score.tier_weight"}


def _unknown(given: dict, known: dict, at: str = "") -> list[str]:
    out = []
    for k, v in given.items():
        path = f"{at}{k}"
        if k not in known:
            out.append(f"{path}: unknown key")
        elif isinstance(v, dict) and isinstance(known[k], dict) and path not in FREE:
            out += _unknown(v, known[k], f"{path}.")
    return out


def problems(t: dict) -> list[str]:
    """Everything wrong with a tuning table."""
    out = _unknown(t, DEFAULT)

    def at(path: str):
        value = t
        for k in path.split("."):
            value = value.get(k) if isinstance(value, dict) else None
        return value

    def need(path: str) -> None:
        if not isinstance(at(path), str) or not at(path).strip():
            out.append(f"{path} is empty")

    def number(path: str, value, least: float | None = None) -> None:
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            out.append(f"{path} is not a finite number")
        elif least is not None and value < least:
            out.append(f"{path} is negative")

    def options(path: str, fixed: tuple[str, ...] = (), only: bool = False) -> None:
        table = at(path) if isinstance(at(path), dict) else {}
        if not table:
            out.append(f"{path}: no options")
        for k, v in table.items():
            if not isinstance(v, str) or not v.strip():
                out.append(f"{path}.{k} is empty")
        out.extend(f"{path}: missing fixed option {k!r}" for k in fixed if k not in table)
        if only and len(table) != len(fixed):
            out.append(f"{path}: {len(table)} options, want exactly {len(fixed)}")

    if t.get("version") != VERSION:
        out.append(f"version {t.get('version')}, want {VERSION}")
    for k in DEFAULT["match_score"]:
        number(f"match_score.{k}", at(f"match_score.{k}"))
    for path, keys in (("fit_score.credit", STRENGTHS[:3]), ("fit_score.tier_weight", tuple(X.TIER_WEIGHT))):
        table = at(path) if isinstance(at(path), dict) else {}
        out.extend(f"{path}: missing {k!r}" for k in keys if k not in table)
        out.extend(f"{path}: unknown key {k!r}" for k in table if k not in keys)
        for k, v in table.items():
            number(f"{path}.{k}", v, 0)
            if path.endswith("tier_weight") and v == 0:
                out.append(f"{path}.{k}: must be positive")
    for path in ("holistic.role_match", "extractor.refinement.importance"):
        need(f"{path}.question")
        levels = at(f"{path}.levels") if isinstance(at(f"{path}.levels"), list) else []
        if len(levels) < 2:
            out.append(f"{path}.levels: {len(levels)} levels, want at least 2")
        out.extend(f"{path}.levels[{i}] is empty" for i, v in enumerate(levels) if not isinstance(v, str) or not v.strip())
    for path in ("holistic.experience_short", "holistic.blocker"):
        for k in ("question", "if_true", "if_false"):
            need(f"{path}.{k}")
    options("extractor.section.options", SECTIONS, only=True)
    options("extractor.validation.reject_options")
    for k in ("filler", "duplicate", "alternative"):
        options(f"extractor.refinement.{k}.reasons")
        need(f"extractor.refinement.{k}.question")
    for path in ("extractor.section.question", "extractor.job_summary.system_prompt", "extractor.validation.question", "extractor.refinement.filler.keep", "checker.retrieval.question", "checker.retrieval.none", "checker.gate.task", "checker.gate.if_true", "checker.gate.if_false", "checker.strength.task"):
        need(path)
    strengths = at("checker.strength.options") if isinstance(at("checker.strength.options"), dict) else {}
    out.extend(f"checker.strength.options: missing fixed option {k!r}" for k in STRENGTHS if k not in strengths)
    out.extend(f"checker.strength.options.{k}.what is empty" for k, v in strengths.items() if not (isinstance(v, dict) and str(v.get("what") or "").strip()))
    return out


class Tuning(dict):
    """A valid table with the first twelve hexadecimal digits of its text's SHA-256."""

    hash: str = ""
    source: str = "default"


def parse(raw: bytes, source: str) -> Tuning:
    """Raises ValueError with every problem."""
    text = raw.decode()
    if source.endswith(".json"):
        table = json.loads(text)
    else:
        import yaml  # not needed for JSON

        table = yaml.safe_load(text)
    wrong = problems(table) if isinstance(table, dict) else ["not a table"]
    if wrong:
        raise ValueError(f"tuning {source}: " + "; ".join(wrong))
    out = Tuning(table)
    out.source, out.hash = source, hashlib.sha256(raw).hexdigest()[:12]
    return out


def load(path: str | None = None) -> Tuning:
    """The file at path, or the default."""
    if path:
        return parse(Path(path).read_bytes(), path)
    return parse(json.dumps(copy.deepcopy(DEFAULT)).encode(), "default.json")
