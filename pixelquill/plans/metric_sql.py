"""The whole metrics written down in SQL, stage by stage, for comparison.

Kernels are formed inside the SQL; only the fixed values are shared with the library.
"""

from __future__ import annotations

from ..functions import constants as K

#: Frames in linear light, a row per sample: both sizes of a pair share these columns.
KEYS = ("part", "frame", "side", "c")


def _mix(row, *names: str) -> str:
    return "(" + " + ".join(f"{w!r} * {n}" for w, n in zip(row, names, strict=False)) + (f" + {row[len(names)]!r}" if len(row) > len(names) else "") + ")"


def _blur(source: str, out: str, sigma: float, radius: int, keys=KEYS) -> str:
    """Two passes, renormalised at the borders."""

    def one(src: str, name: str, axis: str, other: str) -> str:
        same = " AND ".join(f"a.{k} = b.{k}" for k in (*keys, other))
        w = f"exp(-(b.{axis} - a.{axis}) * (b.{axis} - a.{axis}) / {2 * sigma * sigma!r})"
        own = ", ".join(f"a.{k}" for k in (*keys, "y", "x"))
        return f"{name} AS (SELECT {own}, sum(b.v * {w}) / sum({w}) AS v FROM {src} a JOIN {src} b ON {same} AND abs(b.{axis} - a.{axis}) <= {radius} GROUP BY ALL)"

    return f"{one(source, out + '_x', 'x', 'y')}, {one(out + '_x', out, 'y', 'x')}"


def _linear(colour: str) -> str:
    """lin0: both sides of the colour frames in linear light."""
    side = lambda s, e: " UNION ALL ".join(f"SELECT 0 AS part, frame, {s} AS side, {c} AS c, y, x, CAST(CAST({e.format(n)} AS FLOAT) AS DOUBLE) AS v FROM rgb" for c, n in enumerate("rgb"))
    return f"WITH {colour}, enc AS ({side(0, '{}')} UNION ALL {side(1, 'floor({} * 16) / 16.0')}), lin0 AS (SELECT part, frame, side, c, y, x, sign(v) * pow(abs(v), 2.4) AS v FROM enc)"


def _halved(n: int) -> str:
    return f"lin{n} AS (SELECT {n} AS part, frame, side, c, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM lin{n - 1} GROUP BY ALL)"


def _wide(source: str, keys: str, names: str = "rgb") -> str:
    return f"SELECT {keys}, y, x, " + ", ".join(f"max(v) FILTER (c = {k}) AS {n}" for k, n in enumerate(names)) + f" FROM {source} GROUP BY ALL"


def structural(colour: str) -> str:
    lms = [f"(cbrt(greatest({_mix(row, 'r', 'g', 'b')}, 0.0)) + {K.STRUCTURAL_CUBE_BIAS!r})" for row in K.STRUCTURAL_OPSIN]
    kinds = {"m1": "a", "m2": "b", "s11": "a * a", "s22": "b * b", "s12": "a * b"}
    order = [(p, s, n, m) for p in range(3) for s in range(K.STRUCTURAL_SCALES) for n in ("mean", "norm4") for m in ("structure", "artifact", "detail")]
    weights = ", ".join(f"({p}, {s}, '{n}', '{m}', {w!r})" for (p, s, n, m), w in zip(order, K.STRUCTURAL_WEIGHTS, strict=True))
    scales = range(K.STRUCTURAL_SCALES)
    v = "(total * 0.9562382616834844)"
    poly = f"({v} * 2.326765642916932 - {v} * {v} * 0.020884521182843837 + {v} * {v} * {v} * 6.248496625763138e-5)"
    return f"""{_linear(colour)}, {", ".join(_halved(n) for n in scales[1:])},
wide AS ({_wide("(" + " UNION ALL ".join(f"SELECT * FROM lin{n}" for n in scales) + ")", "part, frame, side")}),
lms AS (SELECT part, frame, side, y, x, {lms[0]} AS l, {lms[1]} AS m, {lms[2]} AS s FROM wide),
xyb AS (SELECT part, frame, side, 0 AS c, y, x, 0.5 * (l - m) * 14 + 0.42 AS v FROM lms UNION ALL SELECT part, frame, side, 1, y, x, 0.5 * (l - m) + m + 0.01 FROM lms UNION ALL SELECT part, frame, side, 2, y, x, s - (0.5 * (l - m) + m) + 0.55 FROM lms),
ab AS (SELECT part, frame, c, y, x, max(v) FILTER (side = 0) AS a, max(v) FILTER (side = 1) AS b FROM xyb GROUP BY ALL),
prod AS ({" UNION ALL ".join(f"SELECT part, frame, '{k}' AS side, c, y, x, {e} AS v FROM ab" for k, e in kinds.items())}),
{_blur("prod", "soft", K.STRUCTURAL_SIGMA, K.STRUCTURAL_RADIUS)},
st AS (SELECT part, frame, c, y, x, {", ".join(f"max(v) FILTER (side = '{k}') AS {k}" for k in kinds)} FROM soft GROUP BY ALL),
maps AS (SELECT part, frame, c, greatest(1 - (1 - (m1 - m2) * (m1 - m2)) * (2 * (s12 - m1 * m2) + 0.0009) / ((s11 - m1 * m1) + (s22 - m2 * m2) + 0.0009), 0.0) AS structure, (abs(b - m2) + 1) / (abs(a - m1) + 1) - 1 AS d FROM ab JOIN st USING (part, frame, c, y, x)),
pooled AS (SELECT part, frame, c, avg(structure) AS sm, pow(avg(pow(structure, 4)), 0.25) AS s4, avg(greatest(d, 0.0)) AS am, pow(avg(pow(greatest(d, 0.0), 4)), 0.25) AS a4, avg(greatest(-d, 0.0)) AS dm, pow(avg(pow(greatest(-d, 0.0), 4)), 0.25) AS d4 FROM maps GROUP BY ALL),
long AS ({" UNION ALL ".join(f"SELECT part, frame, c, '{n}' AS kind, '{m}' AS map, {col} AS v FROM pooled" for n, m, col in (("mean", "structure", "sm"), ("norm4", "structure", "s4"), ("mean", "artifact", "am"), ("norm4", "artifact", "a4"), ("mean", "detail", "dm"), ("norm4", "detail", "d4")))}),
w(c, part, kind, map, w) AS (VALUES {weights}),
t AS (SELECT frame, sum(v * w) AS total FROM long JOIN w USING (c, part, kind, map) GROUP BY frame)
SELECT 'colour' AS pair_id, CAST(frame AS INTEGER) AS ord, round(CASE WHEN {poly} > 0 THEN 100.0 - 10.0 * pow({poly}, 0.6276336467831387) ELSE 100.0 END, 6) + 0.0 AS score FROM t"""


def _shrink(v: str, w: float) -> str:
    return f"(sign({v}) * greatest(abs({v}) - {w!r}, 0.0))"


def _stretch(v: str, w: float) -> str:
    return f"(CASE WHEN abs({v}) > {w!r} THEN {v} + sign({v}) * {w!r} ELSE 2.0 * {v} END)"


def _clamp(v: str, most: float) -> str:
    return f"(CASE WHEN abs({v}) > {most!r} THEN sign({v}) * ((abs({v}) - {most!r}) * {K.SOFT_SLOPE!r} + {most!r}) ELSE {v} END)"


def _outside(low: float, high: float) -> str:
    side = "(CASE WHEN a < 0 THEN -1.0 ELSE 1.0 END)"
    return f"greatest(abs(a) * {low!r} - {side} * b, {side} * b - abs(a) * {high!r}, 0.0)"


def psychovisual(colour: str, intensity: float = 203.0) -> str:
    radius = {n: max(int(s * 3), 8) for n, s in K.PSYCHO_SIGMAS.items()}
    blur = lambda src, out, name: _blur(src, out, K.PSYCHO_SIGMAS[name], radius[name])
    lit = lambda p: [f"({p}{n} * {intensity!r})" for n in "rgb"]
    around = [f"greatest({_mix(row, *lit('s'))}, {row[3]!r}, 1e-4)" for row in K.PSYCHO_OPSIN]
    sense = [f"greatest(({K.RESPONSE_SCALE!r} * ln({e} + {K.RESPONSE_SHIFT!r}) - {K.RESPONSE_OFFSET!r}) / {e}, 1e-4)" for e in around]
    lms = [f"greatest({_mix(row, *lit(''))} * {s}, {row[3]!r})" for row, s in zip(K.PSYCHO_OPSIN, sense, strict=True)]
    by_channel = lambda src, names: " UNION ALL ".join(f"SELECT part, frame, side, {k} AS c, y, x, {n} AS v FROM {src}" for k, n in enumerate(names))
    names = ["lf0", "lf1", "lf2", "mf0", "mf1", "mf2", "hf0", "hf1", "uhf0", "uhf1"]
    place = {n: k for k, n in enumerate(names)}
    lines = ", ".join(f"('{kind}', {k}, {dx}, {dy})" for kind, table in (("high", K.LINES_HIGH), ("low", K.LINES_LOW)) for k, taps in enumerate(table) for dx, dy in taps)
    fields = []
    for i, (band, channel, kind, weight, exponent, norm) in enumerate(K.ORIENTED):
        per = f"({K.LINE_SCALE[kind] / (K.LINE_LENGTH * 2 + 1) * norm!r} / ({norm!r} + 0.5 * abs(a) + 0.5 * abs(b)))"
        more, less = (0.5 * weight * K.ASYMMETRY**exponent) ** 0.5, (0.33 * weight / K.ASYMMETRY**exponent) ** 0.5
        fields.append(f"SELECT part, frame, {i} AS o, '{kind}' AS kind, y, x, {per} * ({more!r} * (a - b) + (CASE WHEN a < b THEN -1 ELSE 1 END) * {less!r} * {_outside(0.55, 1.05)}) AS v FROM ab WHERE c = {place[band + str('xy'.index(channel))]}")
    plain = [(place["hf" + str(c)], f"0.8 * {w * K.ASYMMETRY!r} * (a - b) * (a - b) + 0.8 * {w / K.ASYMMETRY!r} * pow({_outside(0.4, 1.0)}, 2)") for c, w in enumerate(K.HF_WEIGHTS)]
    plain += [(place["mf" + str(c)], f"{w!r} * (a - b) * (a - b)") for c, w in enumerate(K.MF_WEIGHTS)]
    low = [(place["lf" + str(c)], f"{w!r} * (a - b) * (a - b)") for c, w in enumerate(K.LF_WEIGHTS)]
    case = lambda terms: "CASE c " + " ".join(f"WHEN {c} THEN {e}" for c, e in terms) + " ELSE 0.0 END"
    gain = lambda offset, scaler, mul: f"pow((1 + {mul!r} / ({scaler!r} * m + {offset!r})) / {K.GAIN_DIVISOR!r}, 2)"
    compress = f"sqrt({K.COMPRESS_GAIN!r} * m + {K.COMPRESS_GAIN!r} * {K.COMPRESS_BIAS!r}) - sqrt({K.COMPRESS_GAIN!r} * {K.COMPRESS_BIAS!r})"
    near = ", ".join(f"({dy}, {dx})" for dy in (-3, 0, 3) for dx in (-3, 0, 3))
    return f"""{_linear(colour)}, {_halved(1)}, lin AS (SELECT * FROM lin0 UNION ALL SELECT * FROM lin1),
{blur("lin", "near", "opsin")},
seen AS (SELECT * FROM ({_wide("lin", "part, frame, side")}) JOIN (SELECT part, frame, side, y, x, r AS sr, g AS sg, b AS sb FROM ({_wide("near", "part, frame, side")})) USING (part, frame, side, y, x)),
lms AS (SELECT part, frame, side, y, x, {lms[0]} AS l, {lms[1]} AS m, {lms[2]} AS s FROM seen),
xyb AS ({by_channel("lms", ("l - m", "l + m", "s"))}),
{blur("xyb", "lf", "lf")},
rest AS (SELECT part, frame, side, c, y, x, a.v - b.v AS v FROM xyb a JOIN lf b USING (part, frame, side, c, y, x)),
{blur("rest", "mf", "mf")},
high AS (SELECT part, frame, side, c, y, x, a.v - b.v AS v FROM rest a JOIN mf b USING (part, frame, side, c, y, x) WHERE c < 2),
h0 AS (SELECT part, frame, side, y, x, max(v) FILTER (c = 0) AS hx, max(v) FILTER (c = 1) AS hy FROM high GROUP BY ALL),
h1 AS (SELECT part, frame, side, y, x, hx * ({K.SUPPRESSION!r} + 46.0 * (1 - {K.SUPPRESSION!r}) / (46.0 + hy * hy)) AS hx, hy FROM h0),
hl AS ({by_channel("h1", ("hx", "hy"))}),
{blur("hl", "hs", "hf")},
h2 AS (SELECT * FROM h1 JOIN (SELECT part, frame, side, y, x, max(v) FILTER (c = 0) AS sx, {_clamp("max(v) FILTER (c = 1)", K.HF_MOST)} AS cy FROM hs GROUP BY ALL) USING (part, frame, side, y, x)),
fine AS (SELECT part, frame, side, y, x, {_shrink("sx", 1.5)} AS hf0, {_stretch("(cy * 2.155)", 0.132)} AS hf1, {_shrink("(hx - sx)", 0.04)} AS uhf0, {_clamp("(hy - cy)", K.UHF_MOST)} * {K.UHF_GAIN!r} AS uhf1 FROM h2),
bands AS (SELECT part, frame, side, y, x, lw.lx * {K.LOW_X!r} AS lf0, lw.y_ * {K.LOW_Y!r} AS lf1, (lw.z - {K.LOW_B_FROM_Y!r} * lw.y_) * {K.LOW_B!r} AS lf2, mw.mf0, mw.mf1, mw.mf2, hf0, hf1, uhf0, uhf1
  FROM fine JOIN (SELECT part, frame, side, y, x, max(v) FILTER (c = 0) AS lx, max(v) FILTER (c = 1) AS y_, max(v) FILTER (c = 2) AS z FROM lf GROUP BY ALL) lw USING (part, frame, side, y, x)
  JOIN (SELECT part, frame, side, y, x, {_shrink("max(v) FILTER (c = 0)", 0.29)} AS mf0, {_stretch("max(v) FILTER (c = 1)", 0.1)} AS mf1, max(v) FILTER (c = 2) AS mf2 FROM mf GROUP BY ALL) mw USING (part, frame, side, y, x)),
named AS ({by_channel("bands", names)}),
ab AS (SELECT part, frame, c, y, x, max(v) FILTER (side = 0) AS a, max(v) FILTER (side = 1) AS b FROM named GROUP BY ALL),
field AS ({" UNION ALL ".join(fields)}),
lines(kind, k, dx, dy) AS (VALUES {lines}),
sent AS MATERIALIZED (SELECT part, frame, o, y, x, k, y + dy AS qy, x + dx AS qx FROM field JOIN lines USING (kind)),
sums AS (SELECT p.part, p.frame, p.o, p.y, p.x, p.k, sum(q.v) AS s FROM sent p JOIN field q ON q.part = p.part AND q.frame = p.frame AND q.o = p.o AND q.y = qy AND q.x = qx GROUP BY ALL),
oriented AS (SELECT part, frame, y, x, sum(s * s) AS e FROM sums GROUP BY ALL),
flat AS (SELECT part, frame, y, x, sum({case(plain)}) AS e, sum({case(low)}) AS dc FROM ab GROUP BY ALL),
min_ AS (SELECT part, frame, side, 0 AS c, y, x, sqrt(pow((uhf0 + hf0) * 2.5, 2) + pow(uhf1 * 0.4 + hf1 * 0.4, 2)) AS m FROM bands),
mc AS (SELECT part, frame, side, c, y, x, {compress} AS v FROM min_),
{blur("mc", "mask", "mask")},
masks AS (SELECT part, frame, y, x, max(v) FILTER (side = 0) AS v, max(v) FILTER (side = 1) AS w FROM mask GROUP BY ALL),
around(dy, dx) AS (VALUES {near}),
near_ AS MATERIALIZED (SELECT part, frame, y, x, y + dy AS qy, x + dx AS qx FROM masks, around),
cand AS (SELECT p.part, p.frame, p.y, p.x, q.v FROM near_ p JOIN masks q ON q.part = p.part AND q.frame = p.frame AND q.y = qy AND q.x = qx UNION ALL SELECT part, frame, y, x, 2 * v FROM masks UNION ALL SELECT part, frame, y, x, 2 * v FROM masks),
eroded AS (SELECT part, frame, y, x, 0.45 * l[1] + 0.3 * l[2] + 0.25 * l[3] AS m FROM (SELECT part, frame, y, x, list_sort(list(v)) AS l FROM cand GROUP BY ALL)),
d AS (SELECT part, frame, y, x, sqrt({gain(*K.FINE_GAIN)} * (o.e + f.e + {K.MASK_WEIGHT!r} * (v - w) * (v - w)) + {gain(*K.COARSE_GAIN)} * dc) AS d
  FROM oriented o JOIN flat f USING (part, frame, y, x) JOIN masks USING (part, frame, y, x) JOIN eroded USING (part, frame, y, x)),
full_ AS (SELECT a.frame, a.d * 0.85 + 0.5 * b.d AS d FROM d a JOIN d b ON a.part = 0 AND b.part = 1 AND a.frame = b.frame AND b.y = a.y // 2 AND b.x = a.x // 2)
SELECT 'colour' AS pair_id, CAST(frame AS INTEGER) AS ord, round(sqrt(avg(d * d)), 6) + 0.0 AS norm_q, round(pow(avg(d * d * d), 1.0 / 3), 6) + 0.0 AS norm_3, round(max(d), 6) + 0.0 AS norm_inf FROM full_ GROUP BY frame"""


def display(colour: str, shown, sensitivity: tuple[tuple[float, float], ...], digits: int = 4, bands: bool = False, p: dict = K.DISPLAY_PARAMETERS) -> str:
    """The display difference of 8 x 8 frames at 30 a second: two bands, a sensitivity given by
    (steepness, centre) per channel over 13 backgrounds (10^-2 to 10^4) and 15 frequencies (10^-1 to 10^1.8).

    bands: the statistics of every band and channel, instead of the scores."""
    import math

    import numpy as np

    n, reach = 9 if p["filter_len"] < 0 else p["filter_len"], 2 * p["pu_dilate"]
    half = n // 2
    matrix = (np.array(K.LMS_TO_DKL) @ np.array(K.XYZ_TO_LMS) @ np.array(shown.rgb_to_xyz)).tolist()
    mirror = "CASE WHEN 2 * o + k < 0 THEN -(2 * o + k) WHEN 2 * o + k > 7 THEN 14 - (2 * o + k) ELSE 2 * o + k END"
    down = lambda src, out, axis, other: f"{out} AS (SELECT frame, side, c, o AS {axis}, {other}, sum(w * v) AS v FROM range(4) r(o), five, {src} WHERE {src}.{axis} = {mirror} GROUP BY ALL)"
    up = lambda src, out, axis, other: f"{out} AS (SELECT frame, side, c, o AS {axis}, {other}, sum(2 * w * v) AS v FROM range(8) r(o), five, {src} WHERE (o - k) % 2 = 0 AND {src}.{axis} = least(greatest((o - k) // 2, 0), 3) GROUP BY ALL)"
    around = lambda src, out, axis, other: f"{out} AS (SELECT p.frame, p.c, p.y, p.x, sum(w * q.v) AS v FROM {src} p, wide13 JOIN {src} q ON q.frame = p.frame AND q.c = p.c AND q.{other} = p.{other} AND q.{axis} = least(greatest(p.{axis} + j, 0), 7) GROUP BY ALL)"

    def gain(band: int) -> str:
        """10 to the bilinear sensitivity at the band's frequency and the pixel's background `lb`, per channel."""
        f = math.log10(shown.ppd / 2) if band == 0 else -1.0
        place = min((f + 1) / 0.2, 14.0)
        low, part = int(place), place - int(place)
        py = "(CASE WHEN lb BETWEEN -2 AND 4 THEN (lb + 2) / 0.5 ELSE 0.0 END)"
        out = []
        for c, (steep, centre) in enumerate(sensitivity[:3]):
            at = lambda i, j: f"(1.5 + 0.25 * (-2 + 0.5 * {i}) - 0.08 * pow(-2 + 0.5 * {i}, 2) - {steep * (-1 + 0.2 * j - centre) ** 2!r})"  # noqa: E731, B023
            row = lambda i: f"({at(i, low)} * {1 - part!r} + {at(i, min(low + 1, 14))} * {part!r})"  # noqa: E731, B023
            under, over = f"floor({py})", f"least(floor({py}) + 1, 12)"
            out.append(f"WHEN {c} THEN pow(10.0, {row(under)} * (1 - ({py} - floor({py}))) + {row(over)} * ({py} - floor({py})) + {p['sensitivity_correction'] / 20!r}) * {K.CHANNEL_GAIN[c]!r}")
        return "CASE c " + " ".join(out) + " END"

    power = lambda v, e: f"(pow({v} + 1e-5, {e}) - pow(1e-5, {e}))"
    pick = lambda values: "CASE c " + " ".join(f"WHEN {c} THEN {v!r}" for c, v in enumerate(values)) + " END"
    across = ", ".join(f"({s}, {d}, {2.0 ** p['xcm_weights'][s * 4 + d]!r})" for s in range(4) for d in range(4))
    response = " UNION ALL ".join(f"SELECT {c} AS c, j, exp(-pow(j * {15.0 / half!r}, {p['beta_tf'][c]!r}) / {p['sigma_tf'][c]!r}) AS f FROM range({half + 1}) r(j)" for c in range(3))
    most = 10.0 ** p["d_max"]
    bounded = {"soft": f"{most!r} * d / ({most!r} + d)", "hard": f"least(d, {most!r})", "none": "d"}[p["dclamp_type"]]
    q = f"(q * CASE WHEN frame = 0 THEN {p['image_int']!r} ELSE 1.0 END)"
    rounded = ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in ("q", "minimum", "maximum", "mean"))
    last = f"SELECT 'colour' AS pair_id, CAST(frame AS INTEGER) AS ord, CAST(band AS INTEGER) AS band, CAST(c AS INTEGER) AS ch, {rounded}, pixels FROM detail"
    if not bands:
        last = f"SELECT 'colour' AS pair_id, CAST(frame AS INTEGER) AS ord, round(least(greatest(CASE WHEN {q} <= 0.1 THEN 10.0 - {q} * {p['jod_a'] * 0.1 ** (p['jod_exp'] - 1)!r} ELSE 10.0 - {p['jod_a']!r} * pow({q}, {p['jod_exp']!r}) END, 0.0), 10.0), {digits}) + 0.0 AS score FROM frames"
    return f"""{_linear(colour)},
five(k, w) AS (VALUES (-2, 0.05), (-1, 0.25), (0, 0.4), (1, 0.25), (2, 0.05)),
wide13 AS (SELECT j, exp(-j * j / {2.0 * p['pu_dilate'] ** 2!r}) / sum(exp(-j * j / {2.0 * p['pu_dilate'] ** 2!r})) OVER () AS w FROM range({-reach}, {reach + 1}) r(j)),
res AS ({response}), full_res AS (SELECT * FROM res UNION ALL SELECT 3, j, 1 - f FROM res WHERE c = 0),
taps AS (SELECT c, k, sum(CASE WHEN j = 0 THEN f ELSE 2 * f * cos(2 * pi() * j * ((k + {n - half}) % {n}) / {n}) END) AS w FROM full_res, range({n}) r(k) GROUP BY c, k),
lum AS (SELECT frame, side, c, y, x, {shown.black!r} + {shown.peak - shown.black!r} * CASE WHEN greatest(v, 0) <= 0.04045 THEN greatest(v, 0) / 12.92 ELSE pow((greatest(v, 0) + 0.055) / 1.055, 2.4) END AS v FROM enc),
lw AS ({_wide("lum", "frame, side")}),
l0 AS ({" UNION ALL ".join(f"SELECT frame, side, {c} AS c, y, x, {_mix(row, 'r', 'g', 'b')} AS v FROM lw" for c, row in enumerate(matrix))}),
{down("l0", "l1y", "y", "x")}, {down("l1y", "l1", "x", "y")}, {up("l1", "ey", "y", "x")}, {up("ey", "e0", "x", "y")},
back AS (SELECT 0 AS band, frame, side, y, x, greatest(v, 0.01) AS bk FROM l0 WHERE c = 0 UNION ALL SELECT 1, frame, side, y, x, greatest(v, 0.01) FROM l1 WHERE c = 0),
logs AS (SELECT band, frame, y, x, avg(log10(bk)) AS lb FROM back GROUP BY ALL),
raw AS (SELECT 0 AS band, frame, side, c, y, x, least((l0.v - e0.v) / bk, 1000.0) AS v FROM l0 JOIN e0 USING (frame, side, c, y, x) JOIN (SELECT * FROM back WHERE band = 0) USING (frame, side, y, x) UNION ALL SELECT 1, frame, side, c, y, x, v FROM l1),
con AS (SELECT band, frame, side, c, y, x, CAST(CAST(v * CASE WHEN band = 0 THEN {gain(0)} ELSE {gain(1)} END AS FLOAT) AS DOUBLE) AS v FROM raw JOIN logs USING (band, frame, y, x)),
fir AS (SELECT n.frame, side, t.c, y, x, sum(t.w * o.v) AS v FROM (SELECT DISTINCT frame FROM con) n, taps t JOIN con o ON o.band = 0 AND o.frame = greatest(n.frame - t.k, 0) AND o.c = t.c % 3 WHERE n.frame > 0 OR t.c < 3 GROUP BY ALL),
tr AS (SELECT frame, c, y, x, max(v) FILTER (side = 1) AS t, max(v) FILTER (side = 0) AS r FROM fir GROUP BY ALL),
mut AS (SELECT frame, c, y, x, least(abs(t), abs(r)) AS v FROM tr),
{around("mut", "m1", "x", "y")}, {around("m1", "m2", "y", "x")},
across(s, c, w) AS (VALUES {across}),
mask AS (SELECT frame, a.c, y, x, greatest(sum(a.w * m2.v * {10.0 ** p['mask_c']!r}), 0.0) AS m FROM m2 JOIN across a ON a.s = m2.c WHERE frame > 0 OR a.c < 3 GROUP BY ALL),
diff AS (SELECT frame, c, {power("abs(t - r)", repr(p['mask_p']))} / (1 + {power("m", pick(p['mask_q']))}) AS d FROM tr JOIN mask USING (frame, c, y, x)),
values_of AS (SELECT 0 AS band, frame, c, {bounded} AS d FROM diff
  UNION ALL SELECT 1, frame, c, abs(max(v) FILTER (side = 1) - max(v) FILTER (side = 0)) FROM con WHERE band = 1 GROUP BY frame, c, y, x),
detail AS (SELECT band, frame, c, pow(avg(pow(d, {p['beta']!r})), {1 / p['beta']!r}) AS q, min(d) AS minimum, max(d) AS maximum, avg(d) AS mean, count(*) AS pixels FROM values_of GROUP BY ALL),
pooled AS (SELECT band, frame, c, q * CASE WHEN band = 1 THEN {pick(p['baseband_weight'])} ELSE 1.0 END AS q FROM detail),
channel AS (SELECT frame, c, pow(sum(pow(q, {p['beta_sch']!r})), {1 / p['beta_sch']!r}) * CASE WHEN c = 3 THEN {p['ch_trans_w']!r} WHEN c > 0 THEN {p['ch_chrom_w']!r} ELSE 1.0 END AS q FROM pooled GROUP BY frame, c),
frames AS (SELECT frame, pow(sum(pow(q, {p['beta_tch']!r})), {1 / p['beta_tch']!r}) AS q FROM channel GROUP BY frame)
{last}"""
