"""What scoring can be told, with the defaults of the service."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class ScoringConfig:
    mandatory_weight: float = 0.7
    preferred_weight: float = 0.3
    skill_weight: float = 0.8
    experience_weight: float = 0.2
    #: Added to the final score times the availability score; 0 leaves availability out of it.
    availability_weight: float = 0.0
    #: A member with this allocation or more, in per cent, is not available.
    threshold: float = 80.0
    high: float = 0.75
    medium: float = 0.50
    days_per_month: int = 30
    default_months: int = 6
    #: What takes the place of a missing start date; None means today.
    as_of: date | None = None
    #: Whether skills marked as deleted count; they do in the service.
    include_deleted_skills: bool = True


DEFAULT = ScoringConfig()
