"""Run settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from epochlens.operators.scan import ScanConfig
from epochlens.operators.trust import TRUST_MODES


def parse_formats(text: str | None) -> tuple[str, ...]:
    """Comma-separated output formats; blank or ``none`` means none."""
    names = tuple(sorted({x.strip().lower() for x in (text or "").split(",") if x.strip()}))
    if names in ((), ("none",)):
        return ()
    unknown = set(names) - {"parquet", "csv"}
    if unknown:
        raise ValueError(f"unknown output formats: {sorted(unknown)}")
    return names


@dataclass(frozen=True)
class DetectConfig:
    start_epoch: int
    end_epoch: int
    block_size: int = 512
    extent_size: int = 4096
    cluster_size: int = 4096
    partition_offset_blocks: int = 0
    scan: ScanConfig = field(default_factory=lambda: ScanConfig(stride=4, min_expansions=2, max_chi2_var=75.0))
    # Files for which a handler reached no decision are kept; off drops them as soon as any other
    # file has range decisions.
    undecided_kept: bool = True
    # How media parts of packages are looked up in a manifest: by hash, by hash and then path, or by container.
    media_trust: str = "sha_only"

    @property
    def blocks_per_extent(self) -> int:
        return self.extent_size // self.block_size

    def validate(self) -> "DetectConfig":
        if not 1 <= self.start_epoch <= self.end_epoch:
            raise ValueError("epochs must satisfy 1 <= start <= end")
        if self.block_size <= 0 or self.extent_size % self.block_size:
            raise ValueError("extent size must be a multiple of the block size")
        if self.cluster_size % self.block_size:
            raise ValueError("cluster size must be a multiple of the block size")
        if self.media_trust not in TRUST_MODES:
            raise ValueError(f"media trust is one of {', '.join(TRUST_MODES)}")
        if self.scan.block_size != self.block_size:
            raise ValueError("scan and device block sizes differ")
        return self


def check_inputs(snapshot: str, start_epoch: int, end_epoch: int, manifest: str | None, mount: str | None) -> None:
    """Fail before any job starts when an input is missing."""
    for epoch in {start_epoch, end_epoch}:
        path = os.path.join(snapshot, f"mutation_{epoch}.parquet")
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    if manifest and not os.path.exists(manifest):
        raise FileNotFoundError(manifest)
    if manifest and not mount:
        raise ValueError("a trusted manifest needs a mount to hash files under")
    if mount and not os.path.isdir(mount):
        raise NotADirectoryError(mount)
