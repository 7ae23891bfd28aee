"""Dimension tables: thresholds, weights and word lists that are data, not code.

Fixed values: they must equal the published defaults for results to agree.
"""
from __future__ import annotations

SCORE_PRESETS = {
    "default": {"d": 0.28, "a": 0.32, "l": 0.18, "r": 0.12, "o": 0.10},
    "asr_focused": {"d": 0.20, "a": 0.45, "l": 0.20, "r": 0.10, "o": 0.05},
    "diarization_focused": {"d": 0.45, "a": 0.25, "l": 0.15, "r": 0.10, "o": 0.05},
    "linguistic_focused": {"d": 0.20, "a": 0.25, "l": 0.35, "r": 0.15, "o": 0.05},
}
CONSENSUS_WEIGHTS = {"d": 0.25, "a": 0.30, "l": 0.20, "r": 0.15, "o": 0.10}
DIMENSIONS = ("d", "a", "l", "r", "o")

# dimension: (low, high) of the absolute calibration range
CALIBRATION_RANGES = {"d": (0.15, 0.95), "a": (0.25, 0.98), "l": (0.30, 0.92), "r": (0.40, 0.90), "o": (0.35, 0.88)}

DOMAIN_FACTORS = {
    "meeting": {"d": 1.05, "a": 0.95, "l": 1.10, "r": 1.08, "o": 0.90},
    "interview": {"d": 1.02, "a": 1.05, "l": 1.05, "r": 0.95, "o": 1.15},
    "lecture": {"d": 0.95, "a": 1.08, "l": 1.15, "r": 0.90, "o": 0.85},
    "general": {"d": 1.0, "a": 1.0, "l": 1.0, "r": 1.0, "o": 1.0},
}
