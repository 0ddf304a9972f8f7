"""Immutable descriptions of seasons, intervals and feature options."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

PICKS = 6
STATISTICS = ("p25", "p50", "p75", "sd", *(f"t{k}" for k in range(PICKS)))


@dataclass(frozen=True)
class Intervals:
    """Overlapping windows over `days` days: window k is [k * step, k * step + step + overlap), if it ends before the last day."""

    days: int
    step: int
    overlap: int
    reducer: str = "median"

    @property
    def width(self) -> int:
        return self.step + self.overlap

    @property
    def count(self) -> int:
        return max(0, -(-(self.days - self.width) // self.step))

    def bounds(self, start: date) -> list[tuple[date, date]]:
        return [(start + timedelta(days=k * self.step), start + timedelta(days=k * self.step + self.width)) for k in range(self.count)]

    @property
    def picks(self) -> tuple[int, ...]:
        """Indices of the windows that stand for the season's course."""
        n = self.days // self.step
        apart = n // PICKS
        first = int(apart / 2 + (n % PICKS) / 2)
        return tuple(first + apart * i for i in range(PICKS))


@dataclass(frozen=True)
class Season:
    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days

    @classmethod
    def crops(cls, year: int) -> Season:
        return cls(date(year, 3, 15), date(year, 10, 31))

    @classmethod
    def land_use(cls, year: int = 2018) -> Season:
        return cls(date(year, 3, 1), date(year, 10, 31))

    def optical(self) -> Intervals:
        return Intervals(self.days, 10, 10, "median")

    def radar(self) -> Intervals:
        return Intervals(self.days, 12, 6, "mean")


@dataclass(frozen=True)
class FeatureOptions:
    """What a feature cube is made of; nothing in it is changed while it is used."""

    season: Season
    optical_bands: tuple[str, ...] = ("B06", "B12")
    indices: tuple[str, ...] = ("NDVI", "NDMI", "NDGI", "NDRE1", "NDRE2", "NDRE5")
    angle: bool = True
    scene_band: str = "SCL"
    #: Scene classes that are clear (vegetation and bare soil); fixed values.
    clear_classes: tuple[int, ...] = (4, 5)
    dilation: int = 0
    cloud_cover: float | None = 80.0
    #: Land-cover classes that stay (grassland and cropland); fixed values.
    cropland_classes: tuple[int, ...] = (30, 40)
    radar_predicates: dict[str, str] = field(default_factory=dict)

    @property
    def optical_features(self) -> tuple[str, ...]:
        return self.optical_bands + self.indices + (("ANIR",) if self.angle else ())

    @property
    def radar_features(self) -> tuple[str, ...]:
        return ("ratio", "VV", "VH")


def feature_names(bands: tuple[str, ...]) -> list[str]:
    """All band and statistic pairs, as {band}_{statistic}."""
    return [f"{band}_{stat}" for band in bands for stat in STATISTICS]
