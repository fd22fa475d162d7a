"""Options of the document plan; they become literals of the query."""

from __future__ import annotations

import dataclasses
import datetime as dt
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

TRUE = {"1", "true", "yes", "on"}


def from_environment(kind, prefix: str, environment: Mapping[str, str] | None = None):
    """Options of a kind, each from the variable of its name in capitals after the prefix, if that is set.

    A switch is on for 1, true, yes and on, off for anything else. A number that does not read, or is blank,
    leaves the default.
    """
    environment = os.environ if environment is None else environment
    found = {}
    for f in dataclasses.fields(kind):
        said = environment.get(f"{prefix}{f.name.upper()}")
        if said is None:
            continue
        if f.type == "bool":
            found[f.name] = said.strip().lower() in TRUE
        else:
            try:
                found[f.name] = {"int": int, "float": float, "dt.date": dt.date.fromisoformat}[f.type](said.strip())
            except ValueError:
                continue
    return kind(**found)


@dataclass(frozen=True)
class Options:
    min_document_score: float = 0.35
    low_field_confidence: float = 0.70
    low_page_confidence: float = 0.75
    substitute_digits: bool = False
    number_without_label: bool = True
    max_address_lines: int = 6
    include_raw: bool = False
    max_upload_bytes: int = 10 * 1024 * 1024
    two_digit_year_max: int = 2049
    today: dt.date = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).date())

    def __post_init__(self) -> None:
        for name in ("min_document_score", "low_field_confidence", "low_page_confidence"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} lies between 0 and 1")
        if self.max_address_lines < 0 or self.max_upload_bytes <= 0:
            raise ValueError("line and byte limits are positive")


@dataclass(frozen=True)
class ImageOptions:
    """How pages become images, and how these are prepared."""

    max_pages: int = 5
    dpi: int = 220
    max_pixels: int = 40_000_000
    max_side: int = 1600
    deskew: bool = True
    most_skew: float = 8.0
    contrast: bool = True
    grayscale: bool = False
    threshold: bool = False

    def __post_init__(self) -> None:
        if min(self.max_pages, self.dpi, self.max_pixels) <= 0 or self.most_skew < 0:
            raise ValueError("limits of pages, resolution and pixels are positive")
