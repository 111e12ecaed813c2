"""Run folders: manifest, checkpoint and events of a run; a resumed run must have the same module and configuration."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import sys
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.files import Folder

ROOT = Path(__file__).resolve().parents[2]


def config_hash(config: dict) -> str:
    """Keys that begin with an underscore do not count."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if not k.startswith("_")}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load_config(path: str) -> dict:
    """YAML with environment variables; values of keys that end in _path, _root or _roots are relative to the file, or to the
    project above a folder named configs. A file that holds no mapping is refused."""
    import yaml

    own = Path(path).expanduser().resolve()
    base = own.parent.parent if own.parent.name == "configs" else own.parent

    def walk(x, key=""):
        if isinstance(x, dict):
            return {k: walk(v, str(k)) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, key) for v in x]
        if not isinstance(x, str):
            return x
        x = os.path.expanduser(os.path.expandvars(x))
        return str((base / x).resolve()) if key.endswith(("_path", "_root", "_roots")) and "://" not in x else x

    found = yaml.safe_load(own.read_text())
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return walk(found)


def lineage(root: Path = ROOT) -> dict:
    """The hash of the package's sources, the commit, whether files differ from it, and the versions that ran."""
    digest = hashlib.sha256()
    for p in sorted((root / "tidemark").rglob("*.py")):
        digest.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes() + b"\0")

    def git(*words: str) -> str | None:
        try:
            return subprocess.run(["git", *words], cwd=root, capture_output=True, text=True, timeout=5, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    changed = git("status", "--porcelain", "--untracked-files=no")
    return {"source_tree_sha256": digest.hexdigest(), "git_commit": git("rev-parse", "HEAD"), "git_dirty": None if changed is None else bool(changed), "python": sys.version.split()[0], "platform": platform.platform()}


class Run:
    """One run of a module. Its folder lies wherever Spark can write, so another driver can resume it."""

    def __init__(self, spark: SparkSession, root: str, module: str, config: dict, resume: str | None = None):
        self.folder = Folder(spark, resume or f"{root.rstrip('/')}/{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}")
        now = {"module": module, "config_sha256": config_hash(config)}
        if resume:
            self.manifest = self.folder.read_json("manifest.json")
            if {k: self.manifest[k] for k in now} != now:
                raise ValueError("the run to resume has another module or configuration")
        else:
            self.folder.make()
            self.manifest = now | {"run_id": self.folder.path.rpartition("/")[2], "lineage": lineage()}
        self._set("running")

    @property
    def path(self) -> str:
        return self.folder.path

    def _set(self, status: str, **more) -> None:
        self.manifest |= {"status": status, **more}
        self.folder.write_json("manifest.json", self.manifest)
        self.event(status, **more)

    def event(self, name: str, **more) -> None:
        self.folder.append("events.jsonl", {"event": name, "time": time.time(), **more})

    def progress(self, **state) -> None:
        self.manifest["progress"] = state
        self.folder.write_json("manifest.json", self.manifest)

    def checkpoint(self, **state) -> None:
        self.folder.write_json("checkpoint.json", state)

    def last_checkpoint(self) -> dict:
        return self.folder.read_json("checkpoint.json") if self.folder.exists("checkpoint.json") else {}

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, _trace) -> None:
        """A run that ends by an error is failed or interrupted, and can be resumed."""
        if error is None:
            return
        if isinstance(error, KeyboardInterrupt):
            self.interrupt()
        else:
            self.fail(error)

    def complete(self, **summary) -> None:
        self._set("completed", **summary)

    def interrupt(self) -> None:
        self._set("interrupted")

    def fail(self, error: BaseException) -> None:
        self._set("failed", error=f"{type(error).__name__}: {error}"[:2000])
