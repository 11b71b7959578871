"""Layered settings: defaults < config file < environment < overrides."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from .operators.constraints import BLOCK, RULES, WARN
from .schemas import TASKS


class _Sentinel:
    def __init__(self, name: str) -> None:
        self.name = name

    def __repr__(self) -> str:
        return self.name

    def __bool__(self) -> bool:
        raise TypeError(f"{self.name} has no truth value")


#: Not given: the next layer counts.
UNSET = _Sentinel("UNSET")
#: Take the value of the enclosing scope.
INHERIT = _Sentinel("INHERIT")


class SettingsError(ValueError):
    pass


def load_yaml(path: str | os.PathLike) -> dict:
    """A mapping from a YAML file; an empty file is an empty mapping, another root an error."""
    try:
        import yaml
    except ImportError as e:
        raise SettingsError("reading YAML needs PyYAML; pass a mapping instead") from e
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise SettingsError(f"{path}: the root must be a mapping")
    return value


def deep_merge(low: dict, high: dict) -> dict:
    """high wins; mappings merge; UNSET values don't count."""
    out = dict(low)
    for k, v in high.items():
        if v is UNSET:
            continue
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deep_merge({}, v) if isinstance(v, dict) else v
    return out


def environment(prefix: str, env: dict[str, str] | None = None) -> dict:
    """PREFIX_A__B=x gives {a: {b: x}}."""
    out: dict = {}
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(f"{prefix}_"):
            at, *_ = [out]
            *path, last = k[len(prefix) + 1 :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = v
    return out


def resolve(cls: type, config: dict | str | None = None, overrides: dict | None = None, env: dict[str, str] | None = None, prefix: str = "ATTESTRY") -> Any:
    """Build cls from all layers. Unknown names are errors; text from the environment takes the default's type."""
    file = load_yaml(config) if isinstance(config, (str, os.PathLike)) else config or {}
    return _build(cls, deep_merge(deep_merge(file, environment(prefix, env)), overrides or {}))


def _build(cls: type, values: dict) -> Any:
    known = {f.name: f for f in fields(cls)}
    if extra := sorted(set(values) - set(known)):
        raise SettingsError(f"unknown settings {extra}")
    args = {}
    default = cls()
    for k, v in values.items():
        now = getattr(default, k)
        if is_dataclass(now) and isinstance(v, dict):
            v = _build(type(now), v)
        elif isinstance(v, str) and isinstance(now, bool):
            v = v.strip().lower() in ("1", "true", "yes")
        elif isinstance(v, str) and isinstance(now, (int, float)):
            v = type(now)(v)
        args[k] = v
    return cls(**args)


@dataclass(frozen=True)
class EvalScoreSettings:
    n_resamples: int = 1000
    ci: float = 0.95
    seed: int = 0
    notes: str = ""

    def __post_init__(self) -> None:
        if not 0 < self.ci < 1:
            raise SettingsError("ci must be between 0 and 1")
        if self.n_resamples < 1:
            raise SettingsError("n_resamples must be positive")


@dataclass(frozen=True)
class EvalTrainSettings:
    """What a classifier is trained with; train_kwargs go to it as they are."""

    target_name: str = ""
    checkpoint: str = ""
    proxy_checkpoint: str = ""
    scale_learning_rate: bool = True
    sequence_length: int = 1024
    train_kwargs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.sequence_length < 1:
            raise SettingsError("sequence_length must be positive")

    def options(self, task: str) -> dict[str, Any]:
        """Options for a task, with its default name; checkpoints that aren't set are the classifier's choice."""
        out = {"target_name": self.target_name or f"{task.capitalize()} evaluation", "scale_learning_rate": self.scale_learning_rate, "sequence_length": self.sequence_length}
        out |= {k: v for k, v in (("checkpoint", self.checkpoint), ("proxy_checkpoint", self.proxy_checkpoint)) if v}
        if taken := sorted(set(out) & set(self.train_kwargs)):
            raise SettingsError(f"train_kwargs {taken} are settings of their own")
        return out | self.train_kwargs


@dataclass(frozen=True)
class EvalPredictSettings:
    """evaluator_run_id: empty for the latest of the task; predict_kwargs go to the classifier as they are."""

    evaluator_run_id: str = ""
    predict_kwargs: dict = field(default_factory=dict)


@dataclass(frozen=True)
class UserSpec:
    """An annotator's account as a store may provision it."""

    username: str
    role: str
    workspaces: list = field(default_factory=list)
    password: str | None = None

    def __post_init__(self) -> None:
        if self.role not in ("owner", "annotator"):
            raise SettingsError(f"role {self.role!r} is neither owner nor annotator")
        if not self.username.strip():
            raise SettingsError("a user has a name")


def load_users(path: str | os.PathLike | None) -> list[UserSpec] | None:
    """Users from a JSON list of objects; no path, no users. Unknown names are errors."""
    if path is None:
        return None
    rows = json.loads(Path(path).expanduser().read_text(encoding="utf-8"))
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise SettingsError(f"{path}: a list of objects is needed")
    known = {f.name for f in fields(UserSpec)}
    if extra := sorted({k for r in rows for k in r} - known):
        raise SettingsError(f"{path}: unknown names {extra}")
    return [UserSpec(**r) for r in rows]


@dataclass(frozen=True)
class QueryGenSettings:
    n_queries: int = 50
    batch_size: int = 25
    near_duplicate_tolerance: float = 0.95
    requests_per_second: float = 1.0

    def __post_init__(self) -> None:
        if self.n_queries < 1 or self.batch_size < 1:
            raise SettingsError("n_queries and batch_size must be positive")
        if not 0 < self.near_duplicate_tolerance <= 1:
            raise SettingsError("near_duplicate_tolerance must be in (0, 1]")


@dataclass(frozen=True)
class TaskSettings:
    calibration_fraction: Any = INHERIT
    production_min_submitted: Any = INHERIT
    calibration_min_submitted: Any = INHERIT


@dataclass(frozen=True)
class WorkspaceSettings(TaskSettings):
    tasks: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AnnotationSettings:
    """Deployment, its workspaces, and their tasks; a task's value is the first given from task to workspace to deployment."""

    dataset_id: str = ""
    calibration_fraction: float = 0.1
    production_min_submitted: int = 1
    calibration_min_submitted: int = 3
    calibration_enabled: bool = True
    partition_seed: int = 0
    workspaces: dict = field(default_factory=lambda: {"retrieval": {"tasks": {"retrieval": {}}}, "grounding": {"tasks": {"grounding": {}}}, "generation": {"tasks": {"generation": {}}}})
    constraint_severity: dict = field(default_factory=lambda: {r.constraint_id: WARN if r.constraint_id == "evidence_excludes_misleading" else BLOCK for r in RULES})

    def __post_init__(self) -> None:
        safe_segment(self.dataset_id, empty=True)
        if not 0 <= self.calibration_fraction <= 1:
            raise SettingsError("calibration_fraction must be in [0, 1]")
        seen: dict[str, str] = {}
        for ws, conf in self.workspaces.items():
            for task in conf.get("tasks", {}):
                if task not in TASKS:
                    raise SettingsError(f"unknown task {task}")
                if task in seen:
                    raise SettingsError(f"task {task} is in workspaces {seen[task]} and {ws}")
                seen[task] = ws
        ids = {r.constraint_id for r in RULES}
        if set(self.constraint_severity) != ids:
            raise SettingsError(f"constraint_severity must name exactly {sorted(ids)}")
        if bad := [k for k, v in self.constraint_severity.items() if v not in (WARN, BLOCK)]:
            raise SettingsError(f"severity of {bad} is neither {WARN} nor {BLOCK}")
        if not self.calibration_enabled and any(self.value(t, "calibration_fraction") > 0 for t in seen):
            raise SettingsError("calibration is disabled but a task has a calibration_fraction over 0")

    @property
    def tasks(self) -> list[str]:
        return [t for t in TASKS if any(t in w.get("tasks", {}) for w in self.workspaces.values())]

    def workspace_of(self, task: str) -> str:
        return next(ws for ws, conf in self.workspaces.items() if task in conf.get("tasks", {}))

    def value(self, task: str, name: str) -> Any:
        conf = next((c for c in self.workspaces.values() if task in c.get("tasks", {})), {})
        for scope in (conf.get("tasks", {}).get(task) or {}, conf):
            v = scope.get(name, INHERIT)
            if v is not INHERIT:
                return v
        return getattr(self, name)

    def fractions(self) -> dict[str, float]:
        return {t: float(self.value(t, "calibration_fraction")) for t in self.tasks}


def safe_segment(name: str, empty: bool = False) -> str:
    """A name that is one path segment: no white space around it, no separators, no `..`."""
    if not name:
        if empty:
            return name
        raise SettingsError("a name is empty")
    if name != name.strip() or "/" in name or "\\" in name or ".." in name:
        raise SettingsError(f"{name!r} is not a safe name")
    return name
