"""Small files that change in one step: write aside, sync, rename, sync the folder."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path

from vecloom.types import EngineError

Fault = Callable[[str], None]


def sync_folder(folder: Path) -> None:
    fd = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def seal(payload: dict) -> bytes:
    raw = json.dumps(payload, sort_keys=True).encode()
    return json.dumps({"payload": base64.b64encode(raw).decode(), "digest": hashlib.sha256(raw).hexdigest()}).encode()


def unseal(data: bytes) -> dict:
    try:
        box = json.loads(data)
        raw = base64.b64decode(box["payload"], validate=True)
        if hashlib.sha256(raw).hexdigest() != box["digest"]:
            raise EngineError("corrupt", "digest")
        return json.loads(raw)
    except (ValueError, KeyError, TypeError) as e:
        if isinstance(e, EngineError):
            raise
        raise EngineError("corrupt", "document") from None


def replace(path: Path, data: bytes, fault: Fault, names: tuple[str, str, str]) -> None:
    """Swap a file's content; ``names`` are the boundaries after write, rename and folder sync."""
    aside = path.with_suffix(path.suffix + ".tmp")
    with aside.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    fault(names[0])
    os.replace(aside, path)
    fault(names[1])
    sync_folder(path.parent)
    fault(names[2])
