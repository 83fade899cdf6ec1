"""WAV files by ranges of frames: the header is read once, samples where they are wanted."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: (kind, bytes of a sample) that can be read: integers of kind 1, floats of kind 3.
KINDS = {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)}


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file lie and what they are."""

    kind: int
    width: int
    channels: int
    rate: int
    at: int
    frames: int

    @property
    def frame(self) -> int:
        return self.width * self.channels


def read_layout(f: BinaryIO) -> Layout:
    """The layout of a RIFF or RF64 file, of whose chunks the first of each name counts. Samples that end too early are what there is of them."""
    end = f.seek(0, 2)
    f.seek(0)
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, long_size, fmt, data = 12, None, None, None
    while at + 8 <= end and (fmt is None or data is None):
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"ds64" and long_size is None and size >= 16:
            long_size = struct.unpack("<8xQ", f.read(16))[0]
        elif name == b"fmt " and fmt is None:
            fmt = f.read(min(size, 64))
        elif name == b"data" and data is None:
            size = long_size if size == 0xFFFFFFFF and long_size is not None else size
            data = at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2
    if fmt is None or len(fmt) < 16:
        raise ValueError("the WAV file has no format")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if kind == 0xFFFE and len(fmt) >= 26:
        kind = struct.unpack_from("<H", fmt, 24)[0]
    width = bits // 8
    if not channels or not rate or (kind, width) not in KINDS:
        raise ValueError(f"WAV samples of kind {kind} and {bits} bits are not supported")
    start, size = data or (end, 0)
    return Layout(kind, width, channels, rate, start, size // (width * channels))


def mono(raw: bytes, layout: Layout) -> np.ndarray:
    """float32 samples of whole frames, their channels averaged to one."""
    width = layout.width
    if layout.kind == 3:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 2**23
    else:
        x = (np.frombuffer(raw, f"<i{width}").astype(np.float64) / 2 ** (8 * width - 1)).astype(np.float32)
    return x.reshape(-1, layout.channels).mean(axis=1, dtype=np.float32)


def float_header(frames: int, rate: int) -> bytes:
    """The head of a mono file of float32 samples."""
    size = 4 * frames
    fmt = struct.pack("<HHIIHH", 3, 1, rate, 4 * rate, 4, 32)
    return b"RIFF" + struct.pack("<I", min(size + 36, 0xFFFFFFFF)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", min(size, 0xFFFFFFFF))


def read_frames(f: BinaryIO, layout: Layout, start: int, stop: int) -> np.ndarray:
    """Mono samples of a range of frames. A file that has become shorter is an error."""
    f.seek(layout.at + start * layout.frame)
    want = max(0, stop - start) * layout.frame
    raw = f.read(want)
    if len(raw) < want:
        raise ValueError("the WAV file ends before its samples")
    return mono(raw, layout)
