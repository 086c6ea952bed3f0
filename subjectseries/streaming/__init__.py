"""Streaming twins of batch operators. Each equals its batch twin on the same data."""

from subjectseries.streaming.jobs import (
    maintain_rollup,
    maintain_segments,
    rollup_so_far,
    run_available,
    segments_so_far,
    stream_ingest,
    stream_rollup,
    stream_segments,
)

__all__ = [
    "maintain_rollup",
    "maintain_segments",
    "rollup_so_far",
    "run_available",
    "segments_so_far",
    "stream_ingest",
    "stream_rollup",
    "stream_segments",
]
