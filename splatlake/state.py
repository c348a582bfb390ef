"""In which domain the columns of a frame are. Immutable; kept beside the DataFrame, so no query asks the data."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

LOG, LINEAR, SH, RGB = "log", "linear", "sh", "rgb"


@dataclass(frozen=True)
class FormatState:
    """Scales log or linear, opacities logit (``log``) or linear, colours SH or RGB, and the SH degree."""

    scales: str = LOG
    opacities: str = LOG
    colours: str = SH
    degree: int = 0

    def __post_init__(self) -> None:
        if self.scales not in (LOG, LINEAR) or self.opacities not in (LOG, LINEAR) or self.colours not in (SH, RGB) or self.degree not in range(4):
            raise ValueError(f"not a format: {self.scales}, {self.opacities}, {self.colours}, {self.degree}")

    @classmethod
    def ply(cls, degree: int = 0) -> FormatState:
        """What files hold: log scales, logit opacities."""
        return cls(LOG, LOG, SH, degree)

    @classmethod
    def linear(cls, degree: int = 0) -> FormatState:
        """What rasterisers take: plain scales, opacities in [0, 1]."""
        return cls(LINEAR, LINEAR, SH, degree)

    def with_format(self, **changes: object) -> FormatState:
        """A copy with some values changed; an unknown name is a ValueError."""
        if unknown := set(changes) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown format keys: {sorted(unknown)}")
        return replace(self, **changes)

    is_scales_ply = property(lambda self: self.scales == LOG)
    is_scales_linear = property(lambda self: self.scales == LINEAR)
    is_opacities_ply = property(lambda self: self.opacities == LOG)
    is_opacities_linear = property(lambda self: self.opacities == LINEAR)
    is_sh0_sh = property(lambda self: self.colours == SH)
    is_sh0_rgb = property(lambda self: self.colours == RGB)
    is_sh_order_0 = property(lambda self: self.degree == 0)
    is_sh_order_1 = property(lambda self: self.degree == 1)
    is_sh_order_2 = property(lambda self: self.degree == 2)
    is_sh_order_3 = property(lambda self: self.degree == 3)

    def to_metadata(self) -> dict:
        """For a StructField's metadata."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def from_metadata(cls, found: dict) -> FormatState:
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
