"""Sentence vectors: the seam that propositional repetition asks for, a model behind it, and a double for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

#: Texts of a batch and tokens of a text.
BATCH, MOST_TOKENS = 16, 512


def sha256_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass(frozen=True)
class ModelFiles:
    """A folder with pinned files: name -> SHA-256 in hex, or None where any content will do."""

    folder: Path
    pinned: dict[str, str | None] = field(default_factory=dict)

    def problems(self) -> tuple[list[str], list[str]]:
        """Files that are missing, which nothing can be done without, and those whose hash differs, which are warnings."""
        missing = [n for n in self.pinned if not (self.folder / n).is_file()]
        odd = [n for n, h in self.pinned.items() if h and n not in missing and sha256_of(self.folder / n) != h.lower()]
        return [f"model file {n} is missing in {self.folder}" for n in missing], [f"model file {n} doesn't have its pinned SHA-256" for n in odd]


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors: each text's mean over its tokens of (texts, tokens, dimensions), without the padding."""
    weight = mask[:, :, None].astype(np.float32)
    mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


class Model:
    """encode(texts) gives (ids, mask) of a batch, padded to its longest; forward(ids, mask) the states of its tokens.

    It is pickled into the scan's closure as these two functions, and opens what they need on the executors.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], forward: Callable[[np.ndarray, np.ndarray], np.ndarray], batch: int = BATCH):
        self.encode, self.forward, self.batch = encode, forward, batch

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        parts = []
        for k in range(0, len(texts), self.batch):
            ids, mask = self.encode(list(texts[k : k + self.batch]))
            parts.append(pooled(self.forward(ids, mask), mask))
        return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


def padded(ids: list[list[int]], most: int = MOST_TOKENS, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids cut to the most tokens and padded to the longest, and the mask of those that aren't padding."""
    ids = [x[:most] for x in ids]
    width = max(map(len, ids), default=0)
    return np.array([x + [pad] * (width - len(x)) for x in ids], np.int64).reshape(len(ids), width), np.array([[1] * len(x) + [0] * (width - len(x)) for x in ids], np.int64).reshape(len(ids), width)


def onnx_model(folder: str | Path, weights: str = "model.onnx", tokens: str = "tokenizer.json") -> Model:
    """An exported encoder beside its tokenizer, opened when first asked."""
    opened: dict[str, object] = {}

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if "tokenizer" not in opened:
            from tokenizers import Tokenizer

            opened["tokenizer"] = Tokenizer.from_file(str(Path(folder) / tokens))
        return padded([e.ids for e in opened["tokenizer"].encode_batch(texts)])

    def forward(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if "session" not in opened:
            import onnxruntime

            opened["session"] = onnxruntime.InferenceSession(str(Path(folder) / weights))
        session = opened["session"]
        known = {i.name for i in session.get_inputs()}
        values = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return session.run(None, {k: v for k, v in values.items() if k in known})[0]

    return Model(encode, forward)


def double(vectors: dict[str, Sequence[float]], dimensions: int) -> Callable[[Sequence[str]], np.ndarray]:
    """A stand-in by text; texts that aren't listed get zeros."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        return np.array([vectors.get(t, [0.0] * dimensions) for t in texts], np.float32).reshape(len(texts), dimensions)

    return embed
