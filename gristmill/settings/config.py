"""Runtime settings from the environment: typed, all bounds checked together."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from gristmill.functions import lexicon as X


@dataclass(frozen=True)
class Settings:
    """Each field's environment name is in its metadata."""

    api_key: str = field(default="", metadata={"env": "CLASSIFIER_API_KEY"})
    base_url: str = field(default="", metadata={"env": "CLASSIFIER_BASE_URL"})
    model: str = field(default="", metadata={"env": "CLASSIFIER_MODEL"})
    max_concurrency: int = field(default=8, metadata={"env": "CLASSIFIER_MAX_CONCURRENCY", "least": 1})
    max_retries: int = field(default=4, metadata={"env": "CLASSIFIER_MAX_RETRIES", "least": 0})
    timeout: float = field(default=30.0, metadata={"env": "CLASSIFIER_TIMEOUT", "positive": True})
    replay_file: str = field(default="", metadata={"env": "CLASSIFIER_REPLAY"})
    record_file: str = field(default="", metadata={"env": "CLASSIFIER_RECORD"})
    generator_url: str = field(default="", metadata={"env": "GENERATOR_BASE_URL"})
    generator_key: str = field(default="", metadata={"env": "GENERATOR_API_KEY"})
    generator_model: str = field(default="", metadata={"env": "GENERATOR_MODEL"})
    generator_concurrency: int = field(default=1, metadata={"env": "GENERATOR_MAX_CONCURRENCY", "least": 1})
    generator_timeout: float = field(default=60.0, metadata={"env": "GENERATOR_TIMEOUT", "positive": True})
    max_window_words: int = field(default=X.MAX_WINDOW, metadata={"env": "PIPELINE_MAX_WINDOW_WORDS", "least": 1})
    section_batch: int = field(default=X.SECTION_BATCH, metadata={"env": "PIPELINE_SECTION_BATCH", "least": 1})
    requirement_mass: float = field(default=X.REQUIREMENT_MASS, metadata={"env": "PIPELINE_MIN_REQUIREMENT_MASS", "share": True})
    skip_importance: bool = field(default=False, metadata={"env": "PIPELINE_SKIP_IMPORTANCE"})
    skip_responsibilities: bool = field(default=False, metadata={"env": "PIPELINE_SKIP_RESPONSIBILITIES"})
    retrieval_k: int = field(default=X.RETRIEVE_K, metadata={"env": "CHECKER_RETRIEVAL_K", "least": 1})
    retrieval_floor: float = field(default=X.RETRIEVE_FLOOR, metadata={"env": "CHECKER_RETRIEVAL_FLOOR", "share": True})
    evidence_mass: float = field(default=0.5, metadata={"env": "CHECKER_MIN_EVIDENCE_MASS", "share": True})
    narrow_sizes: tuple[int, ...] = field(default=(X.NARROW,), metadata={"env": "CHECKER_NARROW_SIZES"})
    gate_threshold: float = field(default=0.5, metadata={"env": "CHECKER_GATE_THRESHOLD", "share": True})
    skip_capped_grading: bool = field(default=True, metadata={"env": "CHECKER_SKIP_CAPPED_GRADING"})
    gate_first: bool = field(default=True, metadata={"env": "CHECKER_GATE_FIRST"})
    skip_mentioned: bool = field(default=False, metadata={"env": "CHECKER_SKIP_MENTIONED"})
    deadline: float = field(default=120.0, metadata={"env": "RUN_DEADLINE", "positive": True})
    tuning_file: str = field(default="", metadata={"env": "TUNING_FILE"})
    log_level: str = field(default="INFO", metadata={"env": "LOG_LEVEL"})


#: Settings of former versions: set, they are an error and not silently without effect.
REMOVED = ("PIPELINE_TOP_P", "CHECKER_RETRIEVAL_ROUNDS")
_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str) -> float:
    """'90', '1.5s', '2m' or '1h30m' in seconds."""
    if re.fullmatch(r"[0-9.]+", text):
        return float(text)
    parts = re.findall(r"([0-9.]+)(ms|s|m|h)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def _read(kind: str, text: str, name: str):
    if kind == "int":
        return int(text)
    if kind == "float":
        return seconds(text) if name.endswith(("TIMEOUT", "DEADLINE")) else float(text)
    if kind == "bool":
        if text.lower() not in ("1", "t", "true", "0", "f", "false"):
            raise ValueError(f"not a truth value: {text!r}")
        return text.lower() in ("1", "t", "true")
    if kind.startswith("tuple"):
        return tuple(int(x) for x in text.split(",") if x.strip())
    return text


def problems(s: Settings) -> list[str]:
    """Every bound that is broken."""
    out = []
    for f in fields(s):
        v, name, rule = getattr(s, f.name), f.metadata["env"], f.metadata
        if "least" in rule and v < rule["least"]:
            out.append(f"{name} must be at least {rule['least']}, got {v}")
        if rule.get("positive") and not v > 0:
            out.append(f"{name} must be positive, got {v}")
        if rule.get("share") and (math.isnan(v) or not 0 <= v <= 1):
            out.append(f"{name} must be in [0, 1], got {v}")
    if (s.skip_capped_grading or s.gate_first) and s.gate_threshold <= 0:
        out.append("CHECKER_SKIP_CAPPED_GRADING and CHECKER_GATE_FIRST need CHECKER_GATE_THRESHOLD > 0")
    if s.replay_file and s.record_file:
        out.append("CLASSIFIER_REPLAY and CLASSIFIER_RECORD cannot both be set")
    return out


def load(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from the environment; the first value that can't be read, a removed setting or all broken bounds raise ValueError."""
    env = os.environ if env is None else env
    given = {}
    for f in fields(Settings):
        if text := env.get(f.metadata["env"], ""):
            try:
                given[f.name] = _read(str(f.type), text, f.metadata["env"])
            except ValueError as e:
                raise ValueError(f"config: {f.metadata['env']}: {e}") from e
    for name in REMOVED:
        if env.get(name):
            raise ValueError(f"config: {name} was removed; unset it")
    s = Settings(**given)
    if wrong := problems(s):
        raise ValueError("config: " + "; ".join(wrong))
    return s


def read_env(path: str, required: tuple[str, ...] = (), env: Mapping[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file, overridden by the environment; a required name that neither has raises KeyError."""
    env = os.environ if env is None else env
    out = {}
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                name, _, value = line.partition("=")
                out[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    out |= {k: v for k, v in env.items() if k in out or k in required}
    if missing := [k for k in required if not out.get(k)]:
        raise KeyError(f"missing settings: {', '.join(missing)}")
    return out
