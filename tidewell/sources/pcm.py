"""Raw PCM bytes between formats: byte order, width, layout."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Full scale of the whole-number formats.
SCALE = {"int16": 32768.0, "int32": 2147483648.0}


@dataclass(frozen=True)
class Format:
    """int16, int32 or float32 samples, interleaved or by channel, little- or big-endian."""

    kind: str
    channels: int
    planar: bool = False
    big_endian: bool = False

    @property
    def dtype(self) -> np.dtype:
        letters = {"int16": "i2", "int32": "i4", "float32": "f4"}
        return np.dtype((">" if self.big_endian else "<") + letters[self.kind])


def pack(samples: Iterable[float], to: Format) -> bytes:
    return np.asarray(list(samples)).astype(to.dtype).tobytes()


def unpack(data: bytes, of: Format) -> list:
    """Samples in the order of the bytes; a cut last frame is left out."""
    whole = len(data) // (of.dtype.itemsize * of.channels) * of.channels
    return np.frombuffer(data, of.dtype, whole).tolist()


def _widths(x: np.ndarray, source: str, target: str) -> np.ndarray:
    if source == target:
        return x
    if target == "float32":
        return (x / SCALE[source]).astype(np.float32)
    if source == "float32":
        top = SCALE[target] - 1
        return np.trunc(np.clip(x.astype(np.float64), -1.0, 1.0) * top).astype(np.int64).astype(target)
    return x.astype(np.int32) << 16 if target == "int32" else (x >> 16).astype(np.int16)


def convert(data: bytes, source: Format, target: Format) -> bytes:
    """Native byte order first, then the samples' format, the layout, and the byte order asked for. The
    sample rate and the number of channels stay."""
    x = np.asarray(unpack(data, source), np.float32 if source.kind == "float32" else np.int64)
    x = _widths(x if source.kind == "float32" else x.astype(source.kind), source.kind, target.kind)
    if source.planar != target.planar:
        x = x.reshape(-1, source.channels).T.ravel() if target.planar else x.reshape(source.channels, -1).T.ravel()
    return pack(x, target)
