"""The registry of the core queries and their SQL."""

from __future__ import annotations

from cantus.plans import alignment, correction, evaluation, harmony, misc, sequences, windows  # noqa: F401 - registration
from cantus.plans.registry import ORACLE, QUERIES  # noqa: F401
