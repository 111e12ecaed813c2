"""Whether the project's files, the packages it needs and the paths of its configs are there."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

from .runs import ROOT, load_config

FILES = ("README.md", "__spark_entry__.py", "bench.py", "tidemark/__init__.py")
PACKAGES = ("pyspark", "pyarrow", "numpy", "pandas", "yaml")
#: Paths that a run makes: their parents have to exist.
OUTPUTS = ("runs_root", "artifact_root")


def _check(name: str, ok: bool, detail) -> dict:
    return {"name": name, "passed": bool(ok), "detail": str(detail)}


def _paths(value, name: str = "", key: str = ""):
    """(name, key, path) of every path in a config."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not str(k).startswith("_"):
                yield from _paths(v, f"{name}.{k}" if name else str(k), str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _paths(v, f"{name}[{i}]", key)
    elif isinstance(value, str) and key.endswith(("_path", "_root", "_roots")) and "://" not in value:
        yield name, key, Path(value)


def inspect(root: str | Path = ROOT, configs: tuple[str, ...] = ()) -> dict:
    root = Path(root).expanduser().resolve()
    checks = [_check("project", root.is_dir(), root), *(_check(f"file:{f}", (root / f).is_file(), root / f) for f in FILES)]
    for name in PACKAGES:
        try:
            checks.append(_check(f"package:{name}", True, getattr(importlib.import_module(name), "__version__", "unknown")))
        except ImportError as e:
            checks.append(_check(f"package:{name}", False, e))
    for c in configs:
        where = Path(c) if Path(c).is_absolute() else root / c
        try:
            found = load_config(str(where))
        except (OSError, ValueError) as e:
            checks.append(_check(f"config:{where.name}", False, e))
            continue
        checks.append(_check(f"config:{where.name}", True, where))
        checks += [_check(f"config:{where.name}:{name}", (p.parent if key.endswith(OUTPUTS) else p).exists(), p) for name, key, p in _paths(found)]
    return {"python": sys.version.split()[0], "root": str(root), "passed": all(c["passed"] for c in checks), "checks": checks}
