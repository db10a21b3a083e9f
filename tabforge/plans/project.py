"""Projects on disk: creating them, their evaluation sets, and saved versions to go back to."""

from __future__ import annotations

import os
import shutil

from tabforge.config import Eval, Project
from tabforge.sources.tables import load_project, save_project

CONFIG = "project.json"


def create(path: str, name: str, template: Project | None = None) -> Project:
    """A new project folder with a configuration, copied from a template if one is given."""
    if os.path.exists(os.path.join(path, CONFIG)):
        raise FileExistsError(path)
    os.makedirs(path, exist_ok=True)
    p = Project.from_json(template.to_json()) if template else Project()
    p.name = name
    save_project(p, os.path.join(path, CONFIG))
    return p


def opened(path: str) -> Project:
    return load_project(os.path.join(path, CONFIG))


def add_eval(path: str, e: Eval) -> None:
    p = opened(path)
    if any(x.name == e.name for x in p.evals):
        raise ValueError(f"evaluation set {e.name} is there already")
    p.evals.append(e)
    save_project(p, os.path.join(path, CONFIG))


def evals(path: str) -> list[str]:
    return [e.name for e in opened(path).evals]


def delete_eval(path: str, name: str) -> None:
    p = opened(path)
    p.evals = [e for e in p.evals if e.name != name]
    save_project(p, os.path.join(path, CONFIG))


def _versions(path: str) -> str:
    return os.path.join(path, ".versions")


def save_version(path: str, name: str) -> None:
    """Keeps the project's files as they are under a name."""
    target = os.path.join(_versions(path), name)
    shutil.rmtree(target, ignore_errors=True)
    shutil.copytree(path, target, ignore=shutil.ignore_patterns(".versions"))


def versions(path: str) -> list[str]:
    return sorted(os.listdir(_versions(path))) if os.path.isdir(_versions(path)) else []


def switch_version(path: str, name: str) -> None:
    """Puts back the files of a saved version; files that are only in the present one go."""
    source = os.path.join(_versions(path), name)
    if not os.path.isdir(source):
        raise FileNotFoundError(name)
    for x in os.listdir(path):
        if x != ".versions":
            full = os.path.join(path, x)
            shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)
    shutil.copytree(source, path, dirs_exist_ok=True)
