"""Command line: ``python -m larkspool INPUT --model-dir DIR``. Exit codes: 0 done, 1 error, 2 bad argument or input, 3 no model folder, 130 interrupted."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.recognise import device_profile
from .plans.options import VARIANTS, RunOptions, Variant, model_complete, require_device
from .plans.transcribe import transcribe_files
from .sources.config import optional_entries


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("larkspool")
    p.add_argument("input", help="a recording, or a folder or pattern of recordings")
    p.add_argument("--model-dir", required=True)
    p.add_argument("--model-label", default="")
    p.add_argument("--compare", action="store_true", help="run all known variants, their folders below the model folder")
    p.add_argument("--recogniser", default="larkspool.operators.recognise:loudness_stub", help="module:function that loads a model")
    p.add_argument("--device", default="NPU")
    p.add_argument("--devices-per-executor", type=int, default=0, help="ask Spark for so many of the device on each executor, one for each task of recognition")
    p.add_argument("--beams", type=int, default=1)
    p.add_argument("--language", default="<|ko|>")
    p.add_argument("--window-seconds", type=float, default=120.0)
    p.add_argument("--overlap-seconds", type=float, default=4.0)
    p.add_argument("--output-suffix", default="")
    p.add_argument("--output-dir", help="the input's folder if not given")
    p.add_argument("--metrics-dir", help="a folder of Parquet that the run's metrics are added to")
    p.add_argument("--mounted", action="store_true", help="the output folder is a local path that all executors have mounted")
    p.add_argument("--hotwords-file", default="hotwords.txt")
    p.add_argument("--initial-prompt-file", default="initial_prompt.txt")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    variants = tuple(Variant(v.label, f"{args.model_dir}/{Path(v.model_dir).name}", v.suffix) for v in VARIANTS) if args.compare else (Variant(args.model_label, args.model_dir),)
    if args.devices_per_executor < 0:
        print("error: devices-per-executor must not be negative", file=sys.stderr)
        return 2
    checks = {"beams": args.beams, "language": args.language, "device": args.device, "window_seconds": args.window_seconds, "overlap_seconds": args.overlap_seconds, "output_suffix": args.output_suffix, "variants": variants}
    try:
        RunOptions(**checks)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    local = "://" not in args.input
    if local and not any(Path("/").glob(str(Path(args.input).resolve()).lstrip("/"))):
        print(f"error: no input {args.input}", file=sys.stderr)
        return 2
    if not Path(args.model_dir).exists():
        print(f"error: no model folder {args.model_dir}", file=sys.stderr)
        return 3
    try:
        spark = spark or SparkSession.builder.appName("larkspool").getOrCreate()
        options = RunOptions(**checks, hotwords=optional_entries(spark, args.hotwords_file), initial_prompt=optional_entries(spark, args.initial_prompt_file))
        module, _, name = args.recogniser.partition(":")
        recogniser = importlib.import_module(module)
        if hasattr(recogniser, "available_devices"):  # a recogniser that needs a device says which there are
            require_device(args.device, recogniser.available_devices())
        for v in variants:
            if getattr(recogniser, "NEEDS_MODEL_FILES", False) and not model_complete(v.model_dir):
                raise ValueError(f"the model in {v.model_dir} is not complete")
        folder = Path(args.input).is_dir() if local else False
        out = args.output_dir or (args.input if folder else args.input.rpartition("/")[0] or ".")
        out = str(Path(out).resolve()) if "://" not in out else out
        profile = device_profile(args.device, args.devices_per_executor) if args.devices_per_executor else None
        found = transcribe_files(spark, args.input, out, getattr(recogniser, name), options, only_media=folder, metrics=args.metrics_dir, profile=profile, show=lambda line: print(line, file=sys.stderr), mounted=args.mounted)
        print(f"transcripts: {found.transcripts}, audio: {found.duration:.1f} s, recognition: {found.elapsed:.1f} s, real-time factor: {found.elapsed / found.duration if found.duration > 0 else 0.0:.2f}")
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the command line turns every error into a message and a code
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
