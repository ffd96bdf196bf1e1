"""Parameters of the jobs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AlignParams:
    phase_correlate: bool = False
    phase_threshold: float = 0.5
    threshold: float = 0.02
    smallest_fraction: float = 0.8
    max_iters: int = 64
    min_width: int = 20
    min_height: int = 20
    max_displacement: float = 10.0
    #: The seed of phase correlation as it ought to be (right scale and sign), rather than as it is known to be used.
    fix_phase_seed: bool = False


@dataclass(frozen=True)
class StabParams:
    align: AlignParams = field(default_factory=AlignParams)
    lag: int = 10
    memory: int = 5
    lam: float = 4.0
    smooth: bool = True
    crop: int = 32
    min_disp: float = 48.0
    max_disp: float = 64.0
    min_decay: float = 0.9
    max_decay: float = 0.7
    iterations: int = 100
    #: Frame k takes the smoothed motion of frame k itself, rather than of frame k + lag - memory.
    align_smoothed: bool = False
