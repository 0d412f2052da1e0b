"""Expressions over frames, boxes, face quality and media descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def position_id(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A face's name by the middle of its box."""
    return F.concat_ws("_", F.floor((x1 + x2) / 2).cast("string"), F.floor((y1 + y2) / 2).cast("string"))


def margin(size: Column, by_model: bool = True) -> Column:
    return ((44 * size / 160) if by_model else size * 0.2).cast("int")


def clamp(v: Column, most: Column | int) -> Column:
    """Into 0..most; a null stays null."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(v.isNotNull() & most.isNotNull(), F.greatest(F.lit(0), F.least(v, most)))


def shifted(ms: Column, offset_s: float) -> Column:
    return ms + int(offset_s * 1000)


def frame_of(ms: Column, fps: float) -> Column:
    """The nearest frame; halves go to the even one."""
    return F.rint(ms / 1000 * fps).cast("long")


def ms_of(frame: Column, fps: float) -> Column:
    return (frame / fps * 1000).cast("long")


def face_quality(sharpness: Column, contrast: Column, symmetry: Column, size: Column) -> Column:
    """0.3, 0.2, 0.4 and 0.1 of the four, each cut at 1; size is an area in relation to 160 * 160."""
    one = F.lit(1.0)
    return 0.3 * F.least(sharpness, one) + 0.2 * F.least(contrast, one) + 0.4 * F.least(symmetry, one) + 0.1 * F.least(size / (160 * 160), one)


def retrieval_quality(sharpness: Column, contrast: Column, size: Column) -> Column:
    """1.2 times (0.35, 0.35 and 0.3 of the three), cut at 1; size is an area in relation to 112 * 112."""
    one = F.lit(1.0)
    return F.least(one, 1.2 * (0.35 * F.least(sharpness, one) + 0.35 * F.least(contrast, one) + 0.3 * F.least(size / (112 * 112), one)))


def colour(i: Column, n: Column) -> Column:
    """Blue, green, red (0 to 255) of hue i / n at saturation 0.8 and value 0.9; gray outside 0..n-1."""
    hue, v, s = i / n * 6, 0.9, 0.8
    sector, part = F.floor(hue), hue - F.floor(hue)
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * part), v * (1 - s * (1 - part))
    level = F.lit(v)
    rgb = [(level, t, p), (q, level, p), (p, level, t), (p, q, level), (t, p, level), (level, p, q)]
    out = F.array(*(F.lit(128) for _ in range(3)))
    for k, (r, g, b) in enumerate(rgb):
        out = F.when((i >= 0) & (i < n) & (sector == k), F.array(*((x * 255).cast("int") for x in (b, g, r)))).otherwise(out)
    return out


def speaking_threshold(given: float) -> float:
    """Thresholds above 0.2 are of another scale and become 0.05."""
    return 0.05 if given > 0.2 else given


def duration_of(report: Column) -> Column:
    """Seconds after `Duration: HH:MM:SS.ff` in a media tool's output; null without."""
    part = [F.regexp_extract(report, r"Duration: (\d+):(\d+):(\d+(?:\.\d+)?)", i) for i in (1, 2, 3)]
    return F.when(part[0] != "", part[0].try_cast("int") * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("double"))


def resolution_of(report: Column) -> Column:
    """`WxH` in a media tool's output; null without."""
    return F.nullif(F.regexp_extract(report, r"(?:^|[ ,])(\d{2,5}x\d{2,5})(?:[ ,\[]|$)", 1), F.lit(""))


def frame_rate_of(report: Column) -> Column:
    return F.nullif(F.regexp_extract(report, r"(\d+(?:\.\d+)?) fps", 1), F.lit("")).try_cast("double")


def area_of(resolution: Column) -> Column:
    side = F.split(resolution, "x")
    return side[0].cast("long") * side[1].cast("long")
