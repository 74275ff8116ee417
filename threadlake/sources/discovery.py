"""Finding candidate files below the configured roots, and their fingerprints."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonl import open_regular

HEAD = 4096
#: The name patterns of each provider's files.
NAMES = {
    "claude": r"[^/]*\.jsonl$",
    "codex": r"rollout-[^/]*\.jsonl$",
    "gemini": r"chats/session-[^/]*\.(json|jsonl)$",
}


def source_format(path: Column, agent: Column) -> Column:
    """``jsonl``, ``snapshot`` or null for a path that is no source of its provider; extensions in any case."""
    low = F.lower(path)
    good = F.lit(False)
    for name, pattern in NAMES.items():
        good = good | ((agent == name) & low.rlike("(^|/)" + pattern))
    return F.when(good, F.when(low.endswith(".json"), "snapshot").otherwise("jsonl"))


class Found(NamedTuple):
    files: list[dict]
    failures: list[tuple[str, str]]


def discover(agent: str, root: str, scopes: Iterable[str] = ()) -> Found:
    """Files of one root, or only those at and below ``scopes``.  Failures are gathered, not raised.

    Hidden entries are skipped.  A scope that is or holds the root widens to the
    root; a root that is missing or no folder fails; a missing scope is simply empty.
    """
    root = root.rstrip("/") or "/"
    pattern = re.compile("(^|/)" + NAMES[agent], re.I)
    files: list[dict] = []
    failures: list[tuple[str, str]] = []
    if not os.path.lexists(root):
        return Found([], [(root, "missing root")])
    if not os.path.isdir(root):
        return Found([], [(root, "not a directory")])
    wanted = [s.rstrip("/") for s in scopes]
    if not wanted or any(s == root or root.startswith(s + "/") for s in wanted):
        wanted = [root]
    wanted = [s for s in wanted if (s == root or s.startswith(root + "/")) and not any(s != o and s.startswith(o + "/") for o in wanted)]
    for scope in sorted(set(wanted)):
        if not os.path.lexists(scope):
            continue
        if os.path.isfile(scope):
            walk: Iterable = [(os.path.dirname(scope), [], [os.path.basename(scope)])]
        else:
            walk = os.walk(scope, onerror=lambda e: failures.append((e.filename, e.strerror or "unreadable")))
        for folder, below, names in walk:
            below[:] = sorted(d for d in below if not d.startswith("."))
            for n in sorted(names):
                path = os.path.join(folder, n)
                if not n.startswith(".") and pattern.search(path.lower()):
                    try:
                        files.append({"agent": agent, "path": path, **fingerprint(path)})
                    except OSError as e:
                        failures.append((path, e.strerror or str(e)))
    return Found(sorted(files, key=lambda f: (f["agent"], f["path"])), failures)


def candidates(agent: str, root: str) -> list[str]:
    """Paths alone, by the same rules; what cannot be listed is left out."""
    pattern = re.compile("(^|/)" + NAMES[agent], re.I)
    out = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if not d.startswith("."))
        out += [os.path.join(folder, n) for n in sorted(names) if not n.startswith(".") and pattern.search(os.path.join(folder, n).lower())]
    return out


def fingerprint(path: str, head: int = HEAD) -> dict:
    with open_regular(path) as f:
        st = os.fstat(f.fileno())
        start = f.read(head)
    return {"dev": st.st_dev, "inode": st.st_ino, "size": st.st_size, "mtime_ns": st.st_mtime_ns, "head_hash": hashlib.sha256(start).hexdigest(), "head_length": len(start)}


def project_root_file(path: str) -> str:
    """Working directory of a chat file: the side file ``.project_root`` two folders up, else that folder."""
    project = os.path.dirname(os.path.dirname(path))
    side = os.path.join(project, ".project_root")
    if os.path.isfile(side):
        with open(side, encoding="utf-8") as f:
            return f.read().strip() or project
    return project


def canonical_directories(cwds: Iterable[str]) -> dict[str, str]:
    """Project root of each distinct working directory: the nearest folder above with ``.git``; of a linked work tree, its main one."""
    out = {}
    for cwd in set(cwds):
        real = os.path.realpath(os.path.expanduser(cwd))
        at = real
        while at != os.path.dirname(at) and not os.path.lexists(os.path.join(at, ".git")):
            at = os.path.dirname(at)
        dot = os.path.join(at, ".git")
        if os.path.isdir(dot):
            out[cwd] = at
        elif os.path.isfile(dot):
            with open(dot, encoding="utf-8") as f:
                line = f.read().strip()
            git = os.path.normpath(os.path.join(at, line.removeprefix("gitdir:").strip()))
            common = os.path.join(git, "commondir")
            if os.path.isfile(common):
                with open(common, encoding="utf-8") as f:
                    git = os.path.normpath(os.path.join(git, f.read().strip()))
            out[cwd] = os.path.dirname(git) if os.path.basename(git) == ".git" else at
        else:
            out[cwd] = real
    return out
