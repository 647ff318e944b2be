"""Paths that must stay in their place."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from plumbline.errors import SecurityError


def inside(path: Path, root: Path) -> bool:
    """Whether path, links resolved, is root or in it."""
    path, root = path.resolve(), root.resolve()
    return path == root or root in path.parents


def joined(root: Path, relative: str) -> Path:
    """A path under root; raises if it leads out of it."""
    path = root / relative
    if "\0" in relative or not inside(path, root):
        raise SecurityError(f"{relative!r} leads out of {root}")
    return path


def dataset_path(path: str, allowed: list[str] | None = None) -> Path | str:
    """An existing folder, within one of the allowed ones if there are any; a URI of another file system is only held against these."""
    if not path or "\0" in path:
        raise SecurityError("the path is empty or has a null character")
    if "://" in path and not path.startswith("file:"):
        if ".." in path.split("/") or allowed and not any(path.startswith(f"{a.rstrip('/')}/") for a in allowed):
            raise SecurityError(f"{path} isn't in an allowed folder")
        return path
    path = re.sub(r"^file:/+", "/", path)
    found = Path(path).expanduser()
    if not found.exists():
        raise SecurityError(f"there is no {path}")
    if not found.is_dir():
        raise SecurityError(f"{path} is no folder")
    found = found.resolve()
    if allowed and not any(inside(found, Path(a)) for a in allowed):
        raise SecurityError(f"{path} isn't in an allowed folder")
    return found


@dataclass
class ZipLimits:
    files: int = 200_000
    total_bytes: int = 20 * 1024**3
    member_bytes: int = 2 * 1024**3
    ratio: int = 200


def member(name: str) -> PurePosixPath:
    """The path of an archive's member; raises if it leads out."""
    path = PurePosixPath(name.replace("\\", "/"))
    if not name or "\0" in name or path.is_absolute() or ".." in path.parts or (len(name) > 1 and name[1] == ":"):
        raise SecurityError(f"the archive has a member {name!r}")
    return path


def unwrapped(root: Path, most: int = 4) -> Path:
    """The folder below up to four that hold nothing but one folder."""
    for _ in range(most):
        own = [p for p in root.iterdir() if not p.name.startswith((".", "__MACOSX"))]
        if len(own) != 1 or not own[0].is_dir() or own[0].name in ("images", "labels"):
            break
        root = own[0]
    return root


def remove_tree(path: Path, root: Path) -> None:
    """Deletes a folder that lies within root."""
    if inside(path, root) and path.resolve() != root.resolve():
        shutil.rmtree(path, ignore_errors=True)


def home(env: dict | None = None) -> Path:
    """Where audits are kept: PLUMBLINE_HOME, or a folder in the user's home."""
    return Path((os.environ if env is None else env).get("PLUMBLINE_HOME") or Path.home() / ".plumbline")
