"""Options of a run, checked when made."""

from __future__ import annotations

import os
from dataclasses import dataclass

MODES = ("pipe", "parallel")
LOG_LEVELS = ("debug", "info", "warning", "error", "none")


@dataclass(frozen=True)
class Settings:
    preserve_metadata: bool = True
    verify_checksums: bool = True
    dry_run: bool = False
    recursive: bool = False
    mode: str = "pipe"
    output: str | None = None
    report: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    log_level: str = "error"
    max_depth: int = 64
    #: Files that a task holds at once.
    batch_files: int = 16
    #: Bytes of files that a task should read.
    task_bytes: int = 256 << 20
    max_bytes: int = 1 << 31
    partitions: int | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.log_level not in LOG_LEVELS:
            raise ValueError(f"log_level must be one of {', '.join(LOG_LEVELS)}")
        if self.max_depth < 0 or self.max_bytes <= 0 or (self.partitions is not None and self.partitions <= 0):
            raise ValueError("depth, bytes and partitions must be positive")

    def check_stdin(self, inputs: list[str]) -> None:
        if "-" in inputs:
            if len(inputs) > 1:
                raise ValueError("standard input must be the only input")
            if not self.output or os.path.isdir(self.output):
                raise ValueError("standard input needs an output file")
