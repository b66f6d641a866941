"""Gaze geometry: projection, axis changes, crop boxes, frame positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: camera and eye geometry ---------------------------------------------------------
NATIVE_FOCAL_PX = 611.0
NATIVE_WIDTH = 1408
HALF_BASELINE_M = 0.0315
OFF_CENTER_RADIUS = 0.3 * math.sqrt(0.5)
# --------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def focal_length(width: int, hfov_degrees: float | None = None) -> float:
    if hfov_degrees is None:
        return NATIVE_FOCAL_PX * width / NATIVE_WIDTH
    return (width / 2) / math.tan(math.radians(hfov_degrees) / 2)


def project(yaw: Column | str, pitch: Column | str, width: int, height: int, focal: float,
            model: str = "pinhole") -> tuple[Column, Column]:
    """Normalized image point of a viewing direction."""
    vx, vy = F.tan(_col(yaw)), F.tan(_col(pitch))
    if model == "pinhole":
        return F.lit(0.5) + vx * focal / width, F.lit(0.5) + vy * focal / height
    cosine = F.lit(1.0) / F.sqrt(vx * vx + vy * vy + 1.0)
    r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * focal
    rho = F.hypot(vx, vy)
    rho = F.when(rho == 0, F.lit(1e-9)).otherwise(rho)
    return F.lit(0.5) + r * vx / rho / width, F.lit(0.5) + r * vy / rho / height


def combine_eyes(left_yaw: Column | str, right_yaw: Column | str) -> tuple[Column, Column]:
    """Yaw through the mean of the two tangents, and vergence depth (null if not in front)."""
    tl, tr = F.tan(_col(left_yaw)), F.tan(_col(right_yaw))
    depth = F.when(F.abs(tr - tl) > 1e-9, F.lit(2 * HALF_BASELINE_M) / (tr - tl))
    return F.atan((tl + tr) / 2), F.when(depth > 0, depth)


def shift_origin(yaw: Column, pitch: Column, depth: Column, offset: tuple[float, float, float]
                 ) -> tuple[Column, Column]:
    """Direction of the gazed point from another origin; null when it would lie behind."""
    z = depth - offset[2]
    ahead = z > 1e-6
    return (F.when(ahead, F.atan((depth * F.tan(yaw) - offset[0]) / z)),
            F.when(ahead, F.atan((depth * F.tan(pitch) - offset[1]) / z)))


def turn(x: Column | str, y: Column | str, ops: str) -> tuple[Column, Column]:
    """Apply `rot90cw`, `rot90ccw`, `flipx`, `flipy` joined by `+`, left to right."""
    x, y = _col(x), _col(y)
    one = F.lit(1.0)
    steps = {"none": lambda a, b: (a, b), "": lambda a, b: (a, b),
             "rot90cw": lambda a, b: (one - b, a), "rot90ccw": lambda a, b: (b, one - a),
             "flipx": lambda a, b: (one - a, b), "flipy": lambda a, b: (a, one - b)}
    for op in ops.split("+"):
        if op.strip() not in steps:
            raise ValueError(f"unknown axis change {op!r}")
        x, y = steps[op.strip()](x, y)
    return x, y


def clamp01(v: Column | str) -> Column:
    return F.least(F.greatest(_col(v), F.lit(0.0)), F.lit(1.0))


def crop_box(width: int, height: int, x: Column | str, y: Column | str, ratio: float) -> dict[str, Column]:
    """Square of side round(min(w, h) * ratio) around a point, moved inside the frame (half to even)."""
    side = max(1, round(min(width, height) * ratio))

    def edge(center: Column, size: int) -> Column:
        return F.bround(F.least(F.greatest(center - side / 2, F.lit(0.0)), F.lit(float(size - side)))).cast("bigint")

    x0, y0 = edge(_col(x) * width, width), edge(_col(y) * height, height)
    return {"x0": x0, "y0": y0, "x1": x0 + side, "y1": y0 + side}


def center_distance(x: Column | str, y: Column | str) -> Column:
    dx, dy = _col(x) - 0.5, _col(y) - 0.5
    return F.sqrt(dx * dx + dy * dy)


def linspace_indices(total: Column | str, n: int | Column) -> Column:
    """Indices 0..total-1 when total <= n, else n evenly spaced ones, truncated, both ends kept."""
    total = _col(total).cast("bigint")
    count = F.lit(n) if isinstance(n, int) else n
    count = count.cast("bigint")
    last = F.greatest(total - 1, F.lit(0))
    step = last / F.greatest(count - 1, F.lit(1))
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0))),
                         lambda i: F.when((i == count - 1) & (count > 1), last)
                         .otherwise(F.floor(i * step)))
    every = F.sequence(F.lit(0).cast("bigint"), last)
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total <= count, every).otherwise(spread)


def frame_grid(start: Column | str, end: Column | str, video_seconds: Column | str, fps: float,
               target_fps: float, cap: int) -> Column:
    """Frame numbers between two seconds at a target rate; evenly spaced ones above the cap."""
    length = _col(video_seconds)
    total = F.floor(length * fps)
    lo = F.greatest(F.lit(0.0), F.least(_col(start), length))
    hi = F.greatest(lo, F.least(_col(end), length))
    first = F.floor(lo * fps).cast("bigint")
    last = F.least(F.floor(hi * fps), total - 1).cast("bigint")
    every = max(1, int(fps / target_fps) if target_fps > 0 else int(fps))
    grid = F.sequence(first, F.greatest(first, last), F.lit(every).cast("bigint"))
    step = (last - first) / (cap - 1)
    thin = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(cap - 1).cast("bigint")),
                       lambda i: F.when(i == cap - 1, last).otherwise(F.floor(i * step + first)))
    return (F.when(first >= last, F.array().cast("array<bigint>"))
            .when(F.size(grid) > cap, thin).otherwise(grid))
