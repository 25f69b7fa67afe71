"""Values that results depend on."""

from __future__ import annotations

# Weights of the structural score, plane by plane, scale by scale,
# the three means before the three 4-norms of (structure, artifact, detail loss).
STRUCTURAL_WEIGHTS = (
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0,
    0.0, 0.0004371155730107379, 0.0, 1.1041726426657346, 0.00066284834129271, 0.00015231632783718752,
    0.0, 0.0016406437456599754, 0.0, 1.8422455520539298, 11.441172603757666, 0.0,
    0.0007989109436015163, 0.000176816438078653, 0.0, 1.8787594979546387, 10.94906990605142, 0.0,
    0.0007289346991508072, 0.9677937080626833, 0.0, 0.00014003424285435884, 0.9981766977854967, 0.00031949755934435053,
    0.0004550992113792063, 0.0, 0.0, 0.0013648766163243398, 0.0, 0.0,
    0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262,
    0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.00037724407979611296, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985,
    176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408,
    0.0, 0.0, 0.0, 34.77906344483772, 44.835625328877896, 0.0,
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0008680556573291698, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0,
    0.0020827005846636437, 0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0,
    95.1080498811086, 0.9863978034400682, 0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379,
    0.0, 0.0, 0.0, 0.0005130064588990679, 0.0, 0.00010854057858411537,
)
STRUCTURAL_SCALES = 6
STRUCTURAL_SIGMA, STRUCTURAL_RADIUS = 1.5, 8

# Blurs of the psychovisual distance (opsin, ultra-high, mask, high, low).
PSYCHO_SIGMAS = {"opsin": 1.2, "hf": 1.56416327805, "mask": 2.7, "mf": 3.22489901262, "lf": 7.15593339443}

# Absorbance matrices, rows by output channel, last entry the bias.
STRUCTURAL_OPSIN = ((0.30, 0.622, 0.078, 0.0037930734), (0.23, 0.692, 0.078, 0.0037930734), (0.24342269, 0.20476745, 0.55180986, 0.0037930734))
STRUCTURAL_CUBE_BIAS = -0.1559542025327239
PSYCHO_OPSIN = (
    (0.29956550340058319, 0.63373087833825936, 0.077705617820981968, 1.7557483643287353),
    (0.22158691104574774, 0.69391388044116142, 0.0987313588422, 1.7557483643287353),
    (0.02, 0.02, 0.20480129041026129, 12.226454707163354),
)

# Line patterns of the oriented filters, (dx, dy) of their taps.
LINES_HIGH = (
    ((-4, 0), (-3, 0), (-2, 0), (-1, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 0)),
    ((0, -4), (0, -3), (0, -2), (0, -1), (0, 0), (0, 1), (0, 2), (0, 3), (0, 4)),
    ((-3, -3), (-2, -2), (-1, -1), (0, 0), (1, 1), (2, 2), (3, 3)),
    ((3, -3), (2, -2), (1, -1), (0, 0), (-1, 1), (-2, 2), (-3, 3)),
    ((1, -4), (1, -3), (1, -2), (0, -1), (0, 0), (0, 1), (-1, 2), (-1, 3), (-1, 4)),
    ((-1, -4), (-1, -3), (-1, -2), (0, -1), (0, 0), (0, 1), (1, 2), (1, 3), (1, 4)),
    ((-4, -1), (-3, -1), (-2, -1), (-1, 0), (0, 0), (1, 0), (2, 1), (3, 1), (4, 1)),
    ((-4, 1), (-3, 1), (-2, 1), (-1, 0), (0, 0), (1, 0), (2, -1), (3, -1), (4, -1)),
    ((-2, -3), (-1, -2), (-1, -1), (0, 0), (1, 1), (1, 2), (2, 3)),
    ((2, -3), (1, -2), (1, -1), (0, 0), (-1, 1), (-1, 2), (-2, 3)),
    ((-3, -2), (-2, -1), (-1, -1), (0, 0), (1, 1), (2, 1), (3, 2)),
    ((3, -2), (2, -1), (1, -1), (0, 0), (-1, 1), (-2, 1), (-3, 2)),
    ((-4, 2), (-3, 2), (-2, 1), (-1, 1), (0, 0), (1, 0), (2, -1), (3, -1)),
    ((-4, -2), (-3, -2), (-2, -1), (-1, -1), (0, 0), (1, 0), (2, 1), (3, 1)),
    ((-2, -4), (-2, -3), (-1, -2), (-1, -1), (0, 0), (0, 1), (1, 2), (1, 3)),
    ((2, -4), (2, -3), (1, -2), (1, -1), (0, 0), (0, 1), (-1, 2), (-1, 3)),
)
LINES_LOW = (
    ((-4, 0), (-2, 0), (0, 0), (2, 0), (4, 0)),
    ((0, -4), (0, -2), (0, 0), (0, 2), (0, 4)),
    ((-3, -3), (-2, -2), (0, 0), (2, 2), (3, 3)),
    ((3, -3), (2, -2), (0, 0), (-2, 2), (-3, 3)),
    ((1, -4), (1, -2), (0, 0), (-1, 2), (-1, 4)),
    ((-1, -4), (-1, -2), (0, 0), (1, 2), (1, 4)),
    ((-4, -1), (-2, -1), (0, 0), (2, 1), (4, 1)),
    ((-4, 1), (-2, 1), (0, 0), (2, -1), (4, -1)),
    ((-2, -3), (-1, -2), (0, 0), (1, 2), (2, 3)),
    ((2, -3), (1, -2), (0, 0), (-1, 2), (-2, 3)),
    ((-3, -2), (-2, -1), (0, 0), (2, 1), (3, 2)),
    ((3, -2), (2, -1), (0, 0), (-2, 1), (-3, 2)),
    ((-4, 2), (-2, 1), (0, 0), (2, -1), (4, -2)),
    ((-4, -2), (-2, -1), (0, 0), (2, 1), (4, 2)),
    ((-2, -4), (-1, -2), (0, 0), (1, 2), (2, 4)),
    ((2, -4), (1, -2), (0, 0), (-1, 2), (-2, 4)),
)
LINE_LENGTH = 3.75
LINE_SCALE = {"high": 0.39905817637, "low": 0.611612573796}

# The oriented differences (band, channel, lines, weight, exponent of the asymmetry, norm).
ASYMMETRY = 0.8
ORIENTED = (
    ("uhf", "y", "high", 1.10039032555, 1.0, 71.7800275169),
    ("uhf", "x", "high", 173.5, 1.0, 5.0),
    ("hf", "y", "low", 18.7237414387, 0.5, 4498534.45232),
    ("hf", "x", "low", 6923.99476109, 0.5, 8051.15833247),
    ("mf", "y", "low", 37.0819870399, 0.0, 130262059.556),
    ("mf", "x", "low", 8246.75321353, 0.0, 1009002.70582),
)
# Weights of the plain differences of x, y, b.
HF_WEIGHTS = (400.0, 1.50815703118)
MF_WEIGHTS = (2150.0, 10.6195433239, 16.2176043152)
LF_WEIGHTS = (29.2353797994, 0.844626970982, 0.703646627719)
MASK_WEIGHT = 10.0

# The psychovisual response to light: scale, shift inside the logarithm, offset.
RESPONSE_SCALE, RESPONSE_SHIFT, RESPONSE_OFFSET = 19.245013259874995, 9.9710635769299145, 23.16046239805755
# Low frequencies to values: x, y, and b after a share of y.
LOW_X, LOW_Y, LOW_B_FROM_Y, LOW_B = 33.832837186260, 14.458268100570, 0.362267051518, 49.87984651440
# Suppression of x by y, slope of the soft clamp, bounds and gain of high and ultra-high frequencies.
SUPPRESSION, SOFT_SLOPE, HF_MOST, UHF_MOST, UHF_GAIN = 0.653020556257, 0.688059627878, 28.4691806922, 5.19175294647, 2.69313763794
# Compression of the mask, and its gains (offset, scaler, mul) on fine and coarse differences with their common divisor.
COMPRESS_GAIN, COMPRESS_BIAS = 6.19424080439, 12.61050594197
FINE_GAIN, COARSE_GAIN = (0.829591754942, 0.451936922203, 2.5485944793), (0.20025578522, 3.87449418804, 0.505054525019)
GAIN_DIVISOR = 0.79079917404 * 17.83

# Display photometry, cone and opponent matrices.
XYZ_TO_LMS = ((0.187596268556126, 0.585168649077728, -0.026384263306304), (-0.133397430663221, 0.405505777260049, 0.034502127690364), (0.000244379021663, -0.000542995890619, 0.019406849066323))
LMS_TO_DKL = ((1.0, 1.0, 0.0), (1.0, -2.311130285, 0.0), (-1.0, -1.0, 50.9775696))
CHANNEL_GAIN = (1.0, 1.45, 1.0, 1.0)

# The parameters of the display-aware difference.
DISPLAY_PARAMETERS = {
    "mask_p": 2.264355182647705, "mask_c": -0.7954971194267273, "pu_dilate": 3, "beta": 2.0, "beta_tch": 4.0, "beta_sch": 4.0,
    "sensitivity_correction": -0.2797423303127289, "jod_a": 0.0439569391310215, "jod_exp": 0.9302042722702026,
    "mask_q": (1.302622675895691, 2.8885908126831055, 3.6807713508605957, 3.588787317276001), "filter_len": -1, "ch_chrom_w": 1.0, "ch_trans_w": 0.8081134557723999,
    "sigma_tf": (5.79336, 14.1255, 6.63661, 0.12314), "beta_tf": (1.3314, 1.1196, 0.947901, 0.1898),
    "xcm_weights": (
        -0.18950104713439941, -5.962151050567627, -4.31834602355957, -1.9321587085723877, 2.5655593872070312, 0.34406712651252747, -2.719646453857422, -0.4970424771308899,
        3.8118371963500977, -1.0051705837249756, -0.5193376541137695, -0.5653647780418396, -7.054771423339844, -5.527150630950928, -3.5106418132781982, -2.08804988861084,
    ),
    "baseband_weight": (0.0036334486212581396, 1.6627724170684814, 4.11874532699585, 25.25969886779785), "dclamp_type": "soft", "d_max": 2.5642454624176025, "image_int": 0.577918291091919,
    "contrast": "weber_g1", "csf": "weber_fixed_size",
}

#: Five taps of the pyramid.
PYRAMID_TAPS = (0.05, 0.25, 0.40, 0.25, 0.05)
BASE_FREQUENCY = 0.1
