"""Hooks for external models (stem separation, transcription, chord detection): none is part of this engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

HOOKS: dict[str, Callable[[bytes], list[tuple]]] = {}
OUTPUT = {
    "separate_stems": "stem string, content binary",
    "transcribe_harmonic": "pitch int, velocity int, start_us bigint, end_us bigint",
    "transcribe_drums": "onset_us bigint, pitch int",
    "detect_chords": "onset double, offset double, pitch double",
}


def apply_model(files: DataFrame, name: str) -> DataFrame:
    """Rows of a registered model for each (path, content); a failing file gives one row with its error."""
    if name not in OUTPUT:
        raise KeyError(f"unknown model hook {name}")
    hook, columns = HOOKS.get(name), [c.split()[0] for c in OUTPUT[name].split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if hook is None:
                        raise RuntimeError(f"no model is registered for {name}")
                    out += [(path, *row, None) for row in hook(content)]
                except Exception as e:  # noqa: BLE001 - isolation by file is the contract
                    out.append((path, *[None] * len(columns), str(e)))
            yield pd.DataFrame(out, columns=["path", *columns, "error"]).astype({c: "Int64" for c in columns if c.endswith(("_us", "pitch", "velocity")) and name != "detect_chords"})

    return files.select("path", "content").mapInPandas(rows, f"path string, {OUTPUT[name]}, error string")
