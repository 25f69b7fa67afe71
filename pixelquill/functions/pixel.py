"""Per-pixel math as Column expressions; everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def linear(v: Column, exponent: float = 2.4) -> Column:
    """Signed power law: negative samples keep their sign."""
    return F.signum(v) * F.pow(F.abs(v), F.lit(exponent))


def mix(rows, *channels: Column) -> list[Column]:
    """A small matrix times the channels; a row may end with a bias."""
    out = []
    for row in rows:
        total = sum((F.lit(w) * c for w, c in zip(row[1:], channels[1:], strict=False)), F.lit(row[0]) * channels[0])
        out.append(total + F.lit(row[len(channels)]) if len(row) > len(channels) else total)
    return out


def positive_xyb(r: Column, g: Column, b: Column) -> list[Column]:
    """Linear RGB to the shifted opponent space of the structural score."""
    l, m, s = (F.cbrt(F.greatest(c, F.lit(0.0))) + F.lit(K.STRUCTURAL_CUBE_BIAS) for c in mix(K.STRUCTURAL_OPSIN, r, g, b))
    x = F.lit(0.5) * (l - m)
    y = x + m
    return [x * 14.0 + 0.42, y + 0.01, (s - y) + 0.55]


def absorbance(r: Column, g: Column, b: Column, clamp: bool = False) -> list[Column]:
    out = mix(K.PSYCHO_OPSIN, r, g, b)
    return [F.greatest(c, F.lit(row[3])) for c, row in zip(out, K.PSYCHO_OPSIN, strict=True)] if clamp else out


def log_gamma(v: Column) -> Column:
    return F.lit(K.RESPONSE_SCALE) * F.ln(v + K.RESPONSE_SHIFT) - K.RESPONSE_OFFSET


def adapted_xyb(rgb: list[Column], blurred: list[Column], intensity: float = 203.0) -> list[Column]:
    """Absorbance scaled by the eye's sensitivity to the blurred surroundings."""
    around = [F.greatest(c, F.lit(1e-4)) for c in absorbance(*(c * intensity for c in blurred), clamp=True)]
    sensitivity = [F.greatest(log_gamma(c) / c, F.lit(1e-4)) for c in around]
    l, m, s = (F.greatest(c * k, F.lit(row[3])) for c, k, row in zip(absorbance(*(c * intensity for c in rgb)), sensitivity, K.PSYCHO_OPSIN, strict=True))
    return [l - m, l + m, s]


def low_to_values(x: Column, y: Column, b: Column) -> list[Column]:
    return [x * K.LOW_X, y * K.LOW_Y, (b + F.lit(-K.LOW_B_FROM_Y) * y) * K.LOW_B]


def shrink_near_zero(v: Column, w: float) -> Column:
    return F.when(v > w, v - w).when(v < -w, v + w).otherwise(F.lit(0.0))


def stretch_near_zero(v: Column, w: float) -> Column:
    return F.when(v > w, v + w).when(v < -w, v - w).otherwise(v * 2.0)


def soft_clamp(v: Column, most: float, slope: float = K.SOFT_SLOPE) -> Column:
    return F.when(v >= most, (v - most) * slope + most).when(v < -most, (v + most) * slope - most).otherwise(v)


def suppress_by(x: Column, y: Column, yw: float = 46.0, s: float = K.SUPPRESSION) -> Column:
    return x * (F.lit(s) + F.lit(yw * (1 - s)) / (F.lit(yw) + y * y))


def split_high(hf: Column, unblurred: Column) -> tuple[Column, Column]:
    """High and ultra-high band of the luma channel."""
    high = soft_clamp(hf, K.HF_MOST)
    ultra = soft_clamp(unblurred - high, K.UHF_MOST) * K.UHF_GAIN
    return stretch_near_zero(high * 2.155, 0.132), ultra


def squared(a: Column, b: Column, w: float) -> Column:
    d = a - b
    return F.lit(w) * d * d


def _outside(a: Column, b: Column, low: float, high: float) -> Column:
    """How far b lies outside [low |a|, high |a|] on a's side of zero."""
    size = F.abs(a)
    below, above = F.when(a < 0, b + size * low).otherwise(size * low - b), F.when(a < 0, -b - size * high).otherwise(b - size * high)
    return F.greatest(below, above, F.lit(0.0))


def squared_asymmetric(a: Column, b: Column, w_more: float, w_less: float) -> Column:
    """Squared difference plus a half-open penalty; both weights are damped by 0.8."""
    d, v = a - b, _outside(a, b, 0.4, 1.0)
    return F.lit(w_more * 0.8) * d * d + F.lit(w_less * 0.8) * v * v


def oriented_difference(a: Column, b: Column, lines: str, weight: float, exponent: float, norm: float) -> Column:
    """The scaled difference that the oriented line sums run over."""
    w_more, w_less = weight * K.ASYMMETRY**exponent, weight / K.ASYMMETRY**exponent
    per = K.LINE_SCALE[lines] / (K.LINE_LENGTH * 2 + 1)
    more, less = per * math.sqrt(0.5 * w_more) * norm, per * math.sqrt(0.33 * w_less) * norm
    size = F.lit(norm) + F.lit(0.5) * F.abs(a) + F.lit(0.5) * F.abs(b)
    d = a - b
    impact = _outside(a, b, 0.55, 1.05) * (F.lit(less) / size)
    return d * (F.lit(more) / size) + F.when(d < 0, -impact).otherwise(impact)


def mask_input(hf_x: Column, uhf_x: Column, hf_y: Column, uhf_y: Column) -> Column:
    x, y = (uhf_x + hf_x) * 2.5, uhf_y * 0.4 + hf_y * 0.4
    return F.sqrt(x * x + y * y)


def mask_compress(v: Column, mul: float = K.COMPRESS_GAIN, bias: float = K.COMPRESS_BIAS) -> Column:
    return F.sqrt(F.lit(mul) * F.abs(v) + mul * bias) - math.sqrt(mul * bias)


def _mask_gain(v: Column, offset: float, scaler: float, mul: float) -> Column:
    r = (F.lit(1.0) + F.lit(mul) / (F.lit(scaler) * v + offset)) * (1.0 / K.GAIN_DIVISOR)
    return r * r


def combined_difference(mask: Column, ac: Column, dc: Column) -> Column:
    fine, coarse = _mask_gain(mask, *K.FINE_GAIN), _mask_gain(mask, *K.COARSE_GAIN)
    return F.sqrt(fine * ac + coarse * dc)


def structure_loss(m1: Column, m2: Column, s11: Column, s22: Column, s12: Column, c: float = 0.0009) -> Column:
    d = m1 - m2
    return F.greatest(F.lit(1.0) - (F.lit(1.0) - d * d) * (F.lit(2.0) * (s12 - m1 * m2) + c) / ((s11 - m1 * m1) + (s22 - m2 * m2) + c), F.lit(0.0))


def edge_change(a: Column, mean_a: Column, b: Column, mean_b: Column) -> tuple[Column, Column]:
    """Added edges and lost detail."""
    v = (F.abs(b - mean_b) + 1.0) / (F.abs(a - mean_a) + 1.0) - 1.0
    return F.greatest(v, F.lit(0.0)), F.greatest(-v, F.lit(0.0))


def structural_value(total: Column) -> Column:
    """The weighted sum as a score of at most 100."""
    s = total * 0.9562382616834844
    s = s * s * s * 6.248496625763138e-5 + s * 2.326765642916932 - s * s * 0.020884521182843837
    return F.when(s > 0, F.pow(s, F.lit(0.6276336467831387)) * -10.0 + 100.0).otherwise(F.lit(100.0))


def luminance(v: Column, eotf: str, peak: float, black: float, gamma: float = 2.2) -> Column:
    """Display light in cd/m2 of an encoded sample."""
    v = F.greatest(v, F.lit(0.0))
    if eotf == "PQ":
        p = F.pow(v, F.lit(1 / 78.84375))
        light = F.pow(F.greatest(p - 0.8359375, F.lit(0.0)) / F.greatest(F.lit(18.8515625) - p * 18.6875, F.lit(1e-10)), F.lit(1 / 0.1593017578125)) * 10000.0
        return F.greatest(light, F.lit(black))
    if eotf == "HLG":
        y = F.when(v <= 0.5, v * v / 3.0).otherwise((F.exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12.0)
        return F.greatest(y * peak, F.lit(black))
    if eotf == "sRGB":
        v = F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    elif eotf == "gamma":
        v = F.pow(v, F.lit(gamma))
    return F.lit(black) + F.lit(peak - black) * v


def opponent(r: Column, g: Column, b: Column, rgb_to_xyz) -> list[Column]:
    """Linear RGB to the cone-opponent channels."""
    return mix(K.LMS_TO_DKL, *mix(K.XYZ_TO_LMS, *mix(rgb_to_xyz, r, g, b)))


def weber(lap: Column, background: Column) -> Column:
    return F.least(lap / F.greatest(background, F.lit(0.01)), F.lit(1000.0))


def mutual(t: Column, r: Column) -> Column:
    return F.least(F.abs(t), F.abs(r))


def across_channels(mutuals: list[Column], weights=K.DISPLAY_PARAMETERS["xcm_weights"]) -> list[Column]:
    """Every channel's mask from all channels' masks."""
    n = len(mutuals)
    return [sum((m * 2.0 ** weights[s * 4 + d] for s, m in enumerate(mutuals[1:], 1)), mutuals[0] * 2.0 ** weights[d]) for d in range(n)]


def power(v: Column, p: float, tiny: float = 1e-5) -> Column:
    """A power that is finite at zero."""
    return F.pow(v + tiny, F.lit(p)) - tiny**p


def masked(t: Column, r: Column, mask: Column, q: float, p: float = K.DISPLAY_PARAMETERS["mask_p"], kind: str = "soft", d_max: float = K.DISPLAY_PARAMETERS["d_max"]) -> Column:
    v = power(F.abs(t - r), p) / (F.lit(1.0) + power(F.greatest(mask, F.lit(0.0)), q))
    most = 10.0**d_max
    return {"soft": v * most / (v + most), "hard": F.least(v, F.lit(most)), "none": v}[kind]


def quality_units(q: Column, a: float = K.DISPLAY_PARAMETERS["jod_a"], e: float = K.DISPLAY_PARAMETERS["jod_exp"]) -> Column:
    """Pooled difference to quality units of 0 to 10, linear below 0.1."""
    v = F.when(q <= 0.1, F.lit(10.0) - q * (a * 0.1 ** (e - 1))).otherwise(F.lit(10.0) - F.lit(a) * F.pow(q, F.lit(e)))
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(10.0))


def pixels_per_degree(width: Column, height: Column, diagonal_inches: Column, distance_m: Column) -> Column:
    w, h = F.greatest(width, F.lit(1)).cast("double"), F.greatest(height, F.lit(1)).cast("double")
    wide = F.greatest(diagonal_inches, F.lit(0.01)) * 0.0254 * (w / F.sqrt(w * w + h * h))
    return w / F.greatest(F.degrees(F.lit(2.0) * F.atan(wide * 0.5 / F.greatest(distance_m, F.lit(1e-6)))), F.lit(1e-12))


def black_level(peak: Column, contrast: Column, ambient: Column) -> Column:
    return F.when(contrast > 0, peak / contrast).otherwise(F.lit(0.0)) + F.when(ambient > 0, ambient * (0.005 / math.pi)).otherwise(F.lit(0.0))


def decode(sample: Column, kind: str) -> Column:
    """A stored sample of 0..full scale as 0..1; float samples stay."""
    top = {"uint8": 255.0, "uint16": 65535.0, "half": 1.0, "float": 1.0}[kind]
    return sample.cast("double") / F.lit(top)


def yuv_to_rgb(y: Column, cb: Column, cr: Column, depth: int = 8, full: bool = False, lines: int = 1080) -> list[Column]:
    """Sample values to RGB of 0..1; matrix 709 above 650 lines, else 601."""
    kr, kb = (0.2126, 0.0722) if lines > 650 else (0.299, 0.114)
    top, unit, half = float((1 << depth) - 1), 1 << (depth - 8), float(1 << (depth - 1))
    luma = y / top if full else (y - 16.0 * unit) / (219.0 * unit)
    blue, red = ((c - half) / (top if full else 224.0 * unit) for c in (cb, cr))
    r, b = luma + red * (2 * (1 - kr)), luma + blue * (2 * (1 - kb))
    return [r, (luma - r * kr - b * kb) / (1 - kr - kb), b]


def interval_place(v: Column, axis: list[float]) -> Column:
    """Fractional place of v on an ascending axis: the first interval that holds it, 0 outside."""
    out = F.lit(0.0)
    for i in reversed(range(len(axis) - 1)):
        out = F.when(v.between(axis[i], axis[i + 1]), (v - axis[i]) / (axis[i + 1] - axis[i]) + i).otherwise(out)
    return out


def bilinear(table: list[list[float]], x: Column, y: Column) -> Column:
    """table[y][x] at fractional places, clamped to the table; the table is a literal."""
    h, w = len(table), len(table[0])
    flat = F.array(*(F.lit(float(v)) for row in table for v in row))
    x, y = F.least(F.greatest(x, F.lit(0.0)), F.lit(w - 1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(h - 1.0))
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(w - 1)), F.least(y0 + 1, F.lit(h - 1))
    at = lambda r, c: F.get(flat, r * w + c)
    upper, lower = (at(r, x0) * (F.lit(1.0) - (x - x0)) + at(r, x1) * (x - x0) for r in (y0, y1))
    return upper * (F.lit(1.0) - (y - y0)) + lower * (y - y0)


def sensitivity(log_background: Column, log_frequency: Column, backgrounds: list[float], frequencies: list[float], table: list[list[float]], gain: float = 1.0) -> Column:
    """Contrast sensitivity from a table of log10 values over log10 axes."""
    log_s = bilinear(table, interval_place(log_frequency, frequencies), interval_place(log_background, backgrounds))
    return F.pow(F.lit(10.0), log_s + K.DISPLAY_PARAMETERS["sensitivity_correction"] / 20) * gain


def base_difference(t: Column, r: Column, s: Column) -> Column:
    """The base band's difference: weighted, not masked."""
    return F.abs(t - r) * s


def band_frequency(ppd: float) -> Column:
    """Cycles per degree of `band` of `bands`."""
    lower = F.lit(0.3228 * ppd / 2) * F.pow(F.lit(2.0), 1 - F.col("band"))
    return F.when(F.col("band") == F.col("bands") - 1, F.lit(K.BASE_FREQUENCY)).when(F.col("band") == 0, F.lit(ppd / 2)).otherwise(lower)


def bands_of(width: Column, height: Column, ppd: Column) -> Column:
    """An array of (band, width, height, frequency), the base band last; sizes are halved downwards."""
    n = F.greatest(F.lit(1), F.length(F.bin(F.least(width, height))) - 2)

    def band(i: Column) -> Column:
        half = lambda v: F.greatest(F.lit(1), F.floor(v / F.pow(F.lit(2.0), i))).cast("long")
        frequency = F.when(i == n - 1, F.lit(K.BASE_FREQUENCY)).when(i == 0, ppd / 2).otherwise(F.lit(0.3228) * F.pow(F.lit(2.0), -(i - 1)) * ppd / 2)
        return F.struct(i.cast("long").alias("band"), half(width).alias("width"), half(height).alias("height"), frequency.alias("frequency"))

    return F.transform(F.sequence(F.lit(0), n - 1), band)
