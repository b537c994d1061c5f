"""Model contracts: validation, identity, artifacts, registry."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass, fields
from pathlib import Path

from vecloom.types import EngineError

SCALARS = ("float16", "float32")


@dataclass(frozen=True)
class ModelSpec:
    """What an index and a query must share. Fields in the order of the identity."""

    model_id: str
    revision: str
    image_model: str
    text_model: str
    image_input: str
    image_input_type: str
    image_output: str
    image_output_type: str
    text_input: str
    text_input_type: str
    text_output: str
    text_output_type: str
    image_size: int
    resize_filter: str
    pixel_format: str
    aspect_mode: str
    fingerprint: str
    dimension: int
    tokenizer_kind: str
    context_length: int
    vocabulary_size: int | None
    normalization: str
    storage: str
    tokenizer_assets: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        """Broken rules of the contract, by name."""
        found = []
        named = ["model_id", "revision", "image_model", "text_model", "image_input", "image_output", "text_input", "text_output", "resize_filter", "pixel_format", "aspect_mode", "fingerprint"]
        found += [f"blank {n}" for n in named if not str(getattr(self, n)).strip()]
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.model_id):
            found.append("bad model_id")
        for n in ("image_model", "text_model"):
            v = getattr(self, n)
            if "/" in v or v in (".", ".."):
                found.append(f"{n} is not a file name")
        found += [f"{n} must be positive" for n in ("image_size", "dimension", "context_length") if getattr(self, n) <= 0]
        if not self.tokenizer_assets or any(not a.strip() or "/" in a or a in (".", "..") for a in self.tokenizer_assets):
            found.append("bad tokenizer_assets")
        if self.vocabulary_size is not None and self.vocabulary_size <= 0:
            found.append("vocabulary_size must be positive")
        if self.image_input_type != "image":
            found.append("image input must be an image")
        found += [f"{n} must be a multi-array" for n in ("image_output_type", "text_input_type", "text_output_type") if not getattr(self, n).startswith("multiArray")]
        if self.storage not in SCALARS:
            found.append("bad storage scalar")
        if self.tokenizer_kind == "clipBPE" and (len(self.tokenizer_assets) != 2 or self.vocabulary_size is None):
            found.append("clipBPE needs two assets and a vocabulary size")
        return found

    def checked(self) -> ModelSpec:
        if found := self.problems():
            raise EngineError("invalidContract", "; ".join(found))
        return self

    def components(self) -> list[str]:
        values = [getattr(self, f.name) for f in fields(self) if f.name != "tokenizer_assets"]
        return ["" if v is None else str(v) for v in values] + list(self.tokenizer_assets)

    @property
    def identity(self) -> str:
        joined = "".join(f"{len(c.encode())}:{c}" for c in self.components())
        return hashlib.sha256(joined.encode()).hexdigest()

    def artifacts(self) -> list[str]:
        return [self.image_model, self.text_model, *self.tokenizer_assets]

    def missing_artifacts(self, folder: str) -> list[str]:
        return [a for a in self.artifacts() if not (Path(folder) / a).exists()]

    def checkpoint_hash(self, folder: str) -> str:
        """SHA-256 of the identity and, file by file in order of path, of the path below ``folder`` and the content."""
        base, files = Path(folder), []
        for name in self.artifacts():
            place = base / name
            if not place.exists():
                raise EngineError("missingArtifact", name)
            inside = [f for f in place.rglob("*") if f.is_file() and not any(p.startswith(".") for p in f.relative_to(place).parts)] if place.is_dir() else [place]
            if not inside:
                raise EngineError("unreadableArtifact", name)
            files += inside
        h = hashlib.sha256(self.identity.encode())
        for f in sorted(files, key=str):
            h.update(str(f)[len(str(base)) :].encode())
            with f.open("rb") as r:
                while chunk := r.read(1 << 20):
                    h.update(chunk)
        return h.hexdigest()

    def adoption_id(self, checkpoint: str) -> str:
        """The generation that adopts an older store: always the same for model and checkpoint."""
        return str(uuid.UUID(bytes=hashlib.sha256((self.model_id + checkpoint).encode()).digest()[:16]))


#: The published contracts.
_COMMON = dict(image_input="colorImage", image_input_type="image", image_output="embOutput", image_output_type="multiArrayFloat32", text_output="text_embeddings", text_output_type="multiArrayFloat32", image_size=256, resize_filter="CILanczosScaleTransform", pixel_format="32ARGB", aspect_mode="stretch", fingerprint="ci-lanczos-argb-256-v1", tokenizer_kind="clipBPE", context_length=77, vocabulary_size=49408, normalization="l2", storage="float32", tokenizer_assets=("vocab.json", "merges.txt"))
S2 = ModelSpec(model_id="mobileclip-s2", revision="mobileclip-s2-v1", image_model="ImageEncoder_mobileCLIP_s2.mlmodelc", text_model="TextEncoder_mobileCLIP_s2.mlmodelc", text_input="input_ids", text_input_type="multiArrayFloat32", dimension=512, **_COMMON)
S4 = ModelSpec(model_id="mobileclip2-s4", revision="mobileclip2-s4-v1", image_model="ImageEncoder_mobileCLIP2_s4.mlmodelc", text_model="TextEncoder_mobileCLIP2_s4.mlmodelc", text_input="input_tokens", text_input_type="multiArrayInt32", dimension=768, **_COMMON)


class Registry:
    """Models by id and revision."""

    def __init__(self):
        self._specs: list[ModelSpec] = []

    def register(self, spec: ModelSpec, folder: str | None = None) -> ModelSpec:
        spec.checked()
        if any((s.model_id, s.revision) == (spec.model_id, spec.revision) for s in self._specs):
            raise EngineError("duplicateModel", spec.model_id)
        if folder is not None and (gone := spec.missing_artifacts(folder)):
            raise EngineError("missingArtifact", ", ".join(gone))
        self._specs.append(spec)
        return spec

    def find(self, model_id: str, revision: str | None = None) -> ModelSpec | None:
        return next((s for s in self._specs if s.model_id == model_id and revision in (None, s.revision)), None)
