"""Options of a transcription run and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class GenerationConfig:
    """What a recogniser is asked for."""

    language: str = "<|ko|>"
    task: str = "transcribe"
    return_timestamps: bool = True
    num_beams: int = 1
    num_beam_groups: int = 1
    num_return_sequences: int = 1
    do_sample: bool = False
    hotwords: str = ""
    initial_prompt: str = ""


@dataclass(frozen=True)
class Variant:
    """A model to run: its label, folder, suffix of results, and the files that make it complete."""

    label: str
    model_dir: str = ""
    suffix: str = ""


#: Two precisions of one model, run on the same recordings.
VARIANTS = (Variant("INT8", "models/int8", "_INT8"), Variant("FP16", "models/fp16", "_FP16"))
MODEL_FILES = ("openvino_encoder_model.xml", "openvino_decoder_model.xml", "generation_config.json")
DEVICES_WITH_CACHE = ("NPU", "GPU")


@dataclass(frozen=True)
class RunOptions:
    """Options of one run. Raises ValueError where a value makes no sense; windows and overlaps must be finite."""

    window_seconds: float = 120.0
    overlap_seconds: float = 4.0
    beams: int = 1
    language: str = "<|ko|>"
    device: str = "NPU"
    output_suffix: str = ""
    hotwords: str = ""
    initial_prompt: str = ""
    variants: tuple[Variant, ...] = field(default=(Variant(""),))

    def __post_init__(self):
        if self.beams < 1:
            raise ValueError("beams must be at least 1")
        if not math.isfinite(self.window_seconds) or self.window_seconds < 30:
            raise ValueError("window_seconds must be a finite number of at least 30")
        if not math.isfinite(self.overlap_seconds) or not 0 <= self.overlap_seconds < self.window_seconds / 2:
            raise ValueError("overlap_seconds must be at least 0 and below half a window")

    def generation(self) -> GenerationConfig:
        return GenerationConfig(language=self.language, num_beams=self.beams, hotwords=self.hotwords, initial_prompt=self.initial_prompt)

    def cache_name(self, label: str) -> str | None:
        """Name of the compiled-model cache of a variant, None on devices without one."""
        device = self.device.upper()
        return f"cache_{(label or 'model').lower()}_{device.replace('.', '_')}" if device.startswith(DEVICES_WITH_CACHE) else None


def model_complete(folder: str) -> bool:
    """Whether all files of a model are there."""
    return all((Path(folder) / name).is_file() for name in MODEL_FILES)


def require_device(device: str, available: list[str]) -> str:
    """The first available device of that name, or of that kind with a number; ValueError if there is none."""
    wanted = device.upper()
    for d in available:
        if d.upper() == wanted or d.upper().startswith(wanted + "."):
            return d
    raise ValueError(f"no device {device} among {available}")
