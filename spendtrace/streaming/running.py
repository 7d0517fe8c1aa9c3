"""What a customer has done so far, moved on by many rows at once.

The sums of a stretch of rows are prefix sums around the mean before it, merged
with the moments held, so a value that never changes keeps a spread of exactly
zero and the work on a row is a few steps of compiled loops.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from spendtrace import contract as C
from spendtrace.operators.features import SECOND

WIDTH = len(C.FEATURES)
HOURS = 24
# Rows that are taken in one go: bounds what is held beside the rows themselves.
STRETCH = 4096
NEAR = C.VELOCITY_SECONDS * SECOND


@dataclass
class Past:
    """Everything of bounded size that is kept of a customer."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    last: int = -(1 << 62)
    hours: np.ndarray = field(default_factory=lambda: np.zeros(HOURS, dtype=np.int64))
    recent: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH)))
    f_mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    f_m2: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))

    @classmethod
    def of(cls, held) -> Past:
        """From the fields in their order, as `values` gives them."""
        n, mean, m2, last, hours, recent, steps, f_mean, f_m2 = held
        return cls(int(n), float(mean), float(m2), int(last), np.array(hours, dtype=np.int64),
                   np.sort(np.array(recent, dtype=np.int64)),
                   np.array([list(s) for s in steps], dtype=float).reshape(-1, WIDTH),
                   np.array(f_mean, dtype=float), np.array(f_m2, dtype=float))

    def values(self) -> tuple:
        return (self.n, self.mean, self.m2, self.last, self.hours.tolist(), self.recent.tolist(),
                self.steps.tolist(), self.f_mean.tolist(), self.f_m2.tolist())

    def to_bytes(self) -> bytes:
        whole = np.concatenate([
            (self.n, self.last, len(self.recent), len(self.steps)), self.hours, self.recent]).astype("<i8")
        real = np.concatenate([(self.mean, self.m2), self.f_mean, self.f_m2, self.steps.ravel()]).astype("<f8")
        return whole.tobytes() + real.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Past:
        n, last, n_recent, n_steps = (int(v) for v in np.frombuffer(data, "<i8", 4))
        whole = np.frombuffer(data, "<i8", HOURS + n_recent, 32).copy()
        real = np.frombuffer(data, "<f8", 2 + WIDTH * (2 + n_steps), 8 * (4 + HOURS + n_recent)).copy()
        at = 2 + WIDTH
        return cls(n, float(real[0]), float(real[1]), last, whole[:HOURS], whole[HOURS:],
                   real[at + WIDTH:].reshape(n_steps, WIDTH), real[2:at], real[at:at + WIDTH])

    def take(self, at: np.ndarray, amount: np.ndarray, of_hour: np.ndarray, hour: np.ndarray,
             foreign: np.ndarray, logins: np.ndarray, of_category: np.ndarray,
             new_device: np.ndarray, new_location: np.ndarray) -> dict[str, np.ndarray]:
        """What stood before each row, and the state moved on behind the last of them.

        Rows come in event order. `of_hour` and `of_category` are the numbers of
        earlier rows in the same hour of day and category.
        """
        rows = len(at)
        n = self.n + np.arange(rows)
        some, known = n > 0, np.maximum(n, 1)
        mean, m2 = _moments(self.n, self.mean, self.m2, amount)
        center = np.where(some, mean[:-1], amount)
        spread = np.where(n > 1, np.sqrt(m2[:-1] / known), np.maximum(0.3 * center, 1.0))
        spread = np.maximum(np.maximum(spread, 0.1 * center), 1.0)
        features = np.empty((rows, WIDTH))
        features[:, 0] = np.clip((amount - center) / spread, -C.ZSCORE_LIMIT, C.ZSCORE_LIMIT)
        features[:, 1] = some & (of_hour / known < C.UNUSUAL_FREQUENCY)
        features[:, 2] = new_device
        features[:, 3] = new_location
        features[:, 4] = foreign
        features[:, 5] = logins
        features[:, 6] = ~some | (of_category / known < C.UNUSUAL_FREQUENCY)
        features[:, 7] = self._near(at)
        features[:, 8] = np.clip(amount / np.maximum(center, 1e-6) * 100, 0.0, C.PCT_LIMIT)
        f_mean, f_m2 = _moments(self.n, self.f_mean, self.f_m2, features)
        out = {"means": f_mean[:-1], "stds": np.where((n > 1)[:, None], np.sqrt(f_m2[:-1] / known[:, None]), 1.0),
               "is_late": at < self.last, "n_prior": n, "features": features, "lead": self.steps}
        self.n += rows
        self.mean, self.m2, self.f_mean, self.f_m2 = float(mean[-1]), float(m2[-1]), f_mean[-1].copy(), f_m2[-1].copy()
        self.hours = self.hours + np.bincount(hour, minlength=HOURS)
        self.last = max(self.last, int(at[-1]))
        recent = np.concatenate([self.recent, at])
        if out["is_late"][0]:
            recent = np.sort(recent)
        self.recent = recent[np.searchsorted(recent, self.last - NEAR):]
        self.steps = np.concatenate([self.steps, features[-C.SEQUENCE_LENGTH:]])[-C.SEQUENCE_LENGTH:]
        return out

    def _near(self, at: np.ndarray) -> np.ndarray:
        """Kept times within the hour around each row.

        Times are kept for an hour before the latest row, which matters to rows
        older than that one.
        """
        latest = np.maximum(np.concatenate([[self.last], at[:-1]]), self.last)
        since = np.maximum(at, latest) - NEAR
        held = np.searchsorted(self.recent, at + NEAR, "right") - np.searchsorted(self.recent, since)
        own = np.arange(len(at)) - np.searchsorted(at, since)
        return np.maximum(held, 0) + np.maximum(own, 0)


def _moments(n: int, mean, m2, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squares around it before each value and behind the last one."""
    base = mean if n else values[0]
    count = n + np.arange(len(values) + 1)
    known = np.maximum(count, 1).reshape(-1, *[1] * (values.ndim - 1))
    gaps = np.zeros((len(values) + 1, *values.shape[1:]))
    with np.errstate(invalid="ignore", over="ignore"):
        np.subtract(values, base, out=gaps[1:])
        total, squares = np.cumsum(gaps, axis=0), np.cumsum(gaps * gaps, axis=0)
    if not np.isfinite(squares[-1]).all():
        return _one_by_one(n, mean, m2, values)
    means, sums = base + total / known, m2 + np.maximum(squares - total * (total / known), 0.0)
    if not n:
        means[0] = 0.0
    return means, sums


def _one_by_one(n: int, mean, m2, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_moments` where a value is infinite, which differences from a base would not survive."""
    means, sums = np.empty((2, len(values) + 1, *values.shape[1:]))
    means[0], sums[0] = mean, m2
    with np.errstate(invalid="ignore", over="ignore"):
        for i, value in enumerate(values):
            gap = value - means[i]
            means[i + 1] = means[i] + gap / (n + i + 1)
            sums[i + 1] = sums[i] + gap * (value - means[i + 1])
    return means, sums


def earlier(codes: np.ndarray) -> np.ndarray:
    """For each place the number of equal codes before it."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(codes)]]))
    out = np.empty(len(codes), dtype=np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(starts, lengths)
    return out
