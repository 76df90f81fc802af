"""Settings of an extraction; only what is read."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of thresholds and locale hints."""

    decimal_separator: str = "auto"
    date_order: str = "none"
    default_country: str = ""
    default_currency: str = ""
    today: str | None = None
    absolute_tolerance: float = 0.05
    relative_tolerance: float = 0.01
    confidence_threshold: float = 0.85
    low_ocr_confidence: float = 0.60
    review_field_threshold: float = 0.55
    llm_threshold: float = 0.75
    weight_ocr: float = 0.45
    weight_extraction: float = 0.55
    validation_penalty: float = 0.65
    include_raw_text: bool = True
    redact: bool = True
    redact_first: bool = False
    languages: tuple[str, ...] = ("eng",)
    production: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "default_currency", self.default_currency.strip().upper())
        object.__setattr__(self, "default_country", self.default_country.strip().upper())

    def weights(self) -> tuple[float, float]:
        """Weights of recognition and extraction that add up to one; equal ones where both are none."""
        total = self.weight_ocr + self.weight_extraction
        return (self.weight_ocr / total, self.weight_extraction / total) if total > 0 else (0.5, 0.5)

    @classmethod
    def from_environment(cls, values: Mapping[str, str] | None = None, prefix: str = "PARCHMINT_") -> Settings:
        """Settings with what the environment says under prefix and a field's upper-cased name; lists are parted by commas."""
        values = os.environ if values is None else values
        told = {}
        for f in fields(cls):
            if (text := values.get(prefix + f.name.upper())) is not None:
                told[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else float(text) if isinstance(f.default, float) else tuple(x.strip() for x in text.split(",") if x.strip()) if isinstance(f.default, tuple) else text
        return cls(**told)
