"""Where a workspace keeps what the plans write."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from .settings import safe_segment


@dataclass(frozen=True)
class Workspace:
    root: Path

    def __init__(self, root: str | Path = ".") -> None:
        object.__setattr__(self, "root", Path(root))

    def imports(self, dataset_id: str = "") -> Path:
        return self.root / "annotation" / "imports" / (safe_segment(dataset_id, True) or "default")

    def export(self, export_id: str) -> Path:
        return self.root / "annotation" / "exports" / safe_segment(export_id)

    def scores(self, run_id: str) -> Path:
        return self.root / "eval" / "scores" / safe_segment(run_id)

    def training(self, run_id: str) -> Path:
        return self.root / "eval" / "train_outputs" / safe_segment(run_id)

    def queries(self, run_id: str) -> Path:
        return self.root / "querygen" / "runs" / safe_segment(run_id)

    def shown(self, path: str | Path) -> str:
        """Relative to the workspace, if it lies there."""
        try:
            return str(Path(path).resolve().relative_to(self.root.resolve()))
        except ValueError:
            return str(Path(path).resolve())

    def latest(self, kind: str, task: str | None = None, meta: str = "meta.json") -> Path | None:
        """The folder under annotation/exports, eval/train_outputs or eval/scores whose sidecar has the largest (created_at, id).

        A sidecar counts for a task that it names; of an export the task's CSV must be there too."""
        found = []
        for side in (self.root / kind).glob(f"*/{meta}"):
            m = json.loads(side.read_text(encoding="utf-8"))
            if task is None or task == m.get("task") or task in m.get("tasks", []) and (side.parent / f"{task}.csv").is_file():
                found.append((m.get("created_at", ""), side.parent.name, side.parent))
        return max(found)[2] if found else None

    def labelled_csv(self, task: str, path: str | Path | None = None, export: str | None = None) -> tuple[Path, dict]:
        """The CSV that a path, an export id or, with neither, the latest export with the task names, and where it comes from."""
        if path is not None and export is not None:
            raise ValueError("give one of path and export")
        if path is not None:
            file = Path(path).expanduser().resolve()
            if not file.exists():
                raise FileNotFoundError(f"{path} does not exist")
            return file, {"kind": "direct_path", "ref": str(path), "resolved_path": self.shown(file)}
        folder = self.export(export) if export else self.latest("annotation/exports", task)
        if folder is None:
            raise FileNotFoundError(f"no export under {self.root / 'annotation' / 'exports'} has {task}.csv")
        for file in (folder / "meta.json", folder / f"{task}.csv"):
            if not file.is_file():
                raise FileNotFoundError(f"export {folder.name!r} lacks {file.name}")
        return folder / f"{task}.csv", {"kind": "annotation_export", "ref": folder.name, "resolved_path": self.shown(folder / f"{task}.csv")}

    def evaluator(self, task: str, run_id: str | None = None) -> str:
        """The id of a training run for the task: the one named, or the latest."""
        if run_id is None:
            folder = self.latest("eval/train_outputs", task)
            if folder is None:
                raise FileNotFoundError(f"no training run for {task} under {self.root / 'eval' / 'train_outputs'}")
            return folder.name
        side = self.training(run_id) / "meta.json"
        if not side.is_file():
            raise FileNotFoundError(f"training run {run_id!r} has no {side}")
        if (found := json.loads(side.read_text(encoding="utf-8"))["task"]) != task:
            raise ValueError(f"training run {run_id!r} is for {found}, not {task}")
        return run_id
