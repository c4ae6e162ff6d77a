"""A Kalman filter of box motion, over many boxes at once.

A box is its centre, its ratio of width to height and its height; the state adds
their speeds per frame. Uncertainty grows with the height, as published for
appearance-free tracking (Wojke et al., 2017; Zhang et al., 2022).
"""

from __future__ import annotations

import numpy as np

#: Standard deviations of places and of speeds in heights, and those of the ratio: first, in motion, when measured, of its speed.
PLACE, SPEED = 1 / 20, 1 / 160
RATIO, RATIO_MEASURED, RATIO_SPEED = 1e-2, 1e-1, 1e-5
#: The motion of one frame, and what is measured of a state.
MOTION = np.eye(8) + np.eye(8, k=4)
MEASURED = np.eye(4, 8)


def to_measure(boxes: np.ndarray) -> np.ndarray:
    """Boxes (x1, y1, x2, y2) of some area as (centre x, centre y, ratio, height)."""
    sides = boxes[:, 2:] - boxes[:, :2]
    return np.column_stack([(boxes[:, :2] + boxes[:, 2:]) / 2, sides[:, 0] / sides[:, 1], sides[:, 1]])


def to_boxes(means: np.ndarray) -> np.ndarray:
    """The boxes (x1, y1, x2, y2) of states."""
    half = np.column_stack([means[:, 2] * means[:, 3], means[:, 3]]) / 2
    return np.concatenate([means[:, :2] - half, means[:, :2] + half], 1)


def _spread(height: np.ndarray, place: float, ratio: float, speed: float, ratio_speed: float) -> np.ndarray:
    """Diagonal covariances of places and speeds."""
    one = np.ones_like(height)
    deviations = [place * height, place * height, ratio * one, place * height, speed * height, speed * height, ratio_speed * one, speed * height]
    return np.stack(deviations, 1)[:, :, None] ** 2 * np.eye(8)


def start(measures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of boxes seen once: no speed, and little known of it."""
    return np.concatenate([measures, np.zeros_like(measures)], 1), _spread(measures[:, 3], 2 * PLACE, RATIO, 10 * SPEED, RATIO_SPEED)


def predict(means: np.ndarray, covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States one frame on."""
    noise = _spread(means[:, 3], PLACE, RATIO, SPEED, RATIO_SPEED)
    return means @ MOTION.T, MOTION @ covariances @ MOTION.T + noise


def update(means: np.ndarray, covariances: np.ndarray, measures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States corrected by what was measured."""
    height = means[:, 3]
    deviations = np.stack([PLACE * height, PLACE * height, RATIO_MEASURED * np.ones_like(height), PLACE * height], 1)
    seen = MEASURED @ covariances @ MEASURED.T + deviations[:, :, None] ** 2 * np.eye(4)
    gain = np.linalg.solve(seen, MEASURED @ covariances).transpose(0, 2, 1)
    off = measures - means @ MEASURED.T
    return means + (gain @ off[:, :, None])[:, :, 0], covariances - gain @ seen @ gain.transpose(0, 2, 1)
