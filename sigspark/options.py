"""Options of the six jobs with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from sigspark.operators import quality


@dataclass(frozen=True)
class Options:
    min_mapq: int = 20
    secondary: bool = False
    skip_unreadable: bool = True
    ultra_threshold: int | None = None      # side output of longer reads when set
    region: str | None = None               # contig:beg-end
    rna: bool = False
    min_events_to_rescale: int = quality.MIN_EVENTS_TO_RESCALE
    call_version: int = 2                   # layout of the call table
    read_names: bool = False                # event rows carry read names instead of indices
    scale_events: bool = False              # events to the model instead of the model to the read
    signal_index: bool = False
    samples: bool = False
    collapse: bool = False
    call_threshold: float = 2.5
    split_groups: bool = False
    prefilter: bool = False                 # few reads are wanted: a filter of their ids goes ahead of the signal shuffle (a region implies it)
    colocated: bool = False                 # inputs are bucketed by read_id already
    reference_tile: int = 1 << 16
    max_broadcast_bytes: int = 64 << 20
