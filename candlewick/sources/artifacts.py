"""Small JSON artifacts on the driver: no-clobber, versioned and atomic writes, and immutable run identities."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from pathlib import Path


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def identity(value) -> str:
    """SHA-256 of a recipe's canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_new(path: str | Path, value) -> None:
    """Fails if the path exists."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=1))


def write_versioned(path: str | Path, value) -> Path | None:
    """Replaces a file at once and keeps what was there under a time's name."""
    path, backup = Path(path), None
    if path.exists():
        backup = path.with_name(f"{path.name}.{time.time_ns()}.bak")
        os.link(path, backup)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=1))
    os.replace(f.name, path)
    return backup


def write_folder(path: str | Path, files: dict[str, str]) -> None:
    """A folder that appears whole or not at all; names may not leave it."""
    path = Path(path)
    if any(Path(n).is_absolute() or ".." in Path(n).parts for n in files):
        raise ValueError("a file's name leaves the folder")
    if path.exists():
        raise FileExistsError(path)
    made = Path(tempfile.mkdtemp(dir=path.parent))
    for name, text in files.items():
        (made / name).parent.mkdir(parents=True, exist_ok=True)
        (made / name).write_text(text, encoding="utf-8")
    os.rename(made, path)


class Vault:
    """Certified entries that are never overwritten, sealed tests that open once, and a budget of openings for each plan."""

    def __init__(self, root: str | Path, openings: int = 20) -> None:
        self.root, self.openings = Path(root), openings
        for name in ("entries", "claims"):
            (self.root / name).mkdir(parents=True, exist_ok=True)

    def add(self, fingerprint: str, entry: dict) -> None:
        write_new(self.root / "entries" / f"{fingerprint}.json", entry)

    def open_sealed(self, plan: str, fingerprint: str) -> None:
        used = sum(1 for p in (self.root / "claims").glob(f"{plan}-*.json"))
        if used >= self.openings:
            raise PermissionError(f"plan {plan} has used its {self.openings} openings")
        write_new(self.root / "claims" / f"{plan}-{fingerprint}.json", {"plan": plan, "fingerprint": fingerprint})
