"""Displays and colour spaces from JSON documents, through Spark's readers."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import ConfigurationError


@dataclass(frozen=True)
class Display:
    name: str = "default"
    width: int = 3840
    height: int = 2160
    distance_m: float = 0.7472
    diagonal_inches: float = 30.0
    peak: float = 200.0
    contrast: float = 1000.0
    ambient: float = 0.0
    eotf: str = "sRGB"
    gamma: float = 2.2
    rgb_to_xyz: tuple = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))

    @property
    def ppd(self) -> float:
        """Pixels per degree of horizontal sight."""
        w, h = max(1, self.width), max(1, self.height)
        wide = max(self.diagonal_inches, 0.01) * 0.0254 * w / math.hypot(w, h)
        return w / max(math.degrees(2 * math.atan(wide * 0.5 / max(self.distance_m, 1e-6))), 1e-12)

    @property
    def black(self) -> float:
        return (self.peak / self.contrast if self.contrast > 0 else 0.0) + (0.005 * self.ambient / math.pi if self.ambient > 0 else 0.0)


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON object; configuration files are small by nature."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ConfigurationError(f"{path} is not one document")
    try:
        found = json.loads(rows[0][0])
    except ValueError as e:
        raise ConfigurationError(f"{path} is not JSON") from e
    if not isinstance(found, dict):
        raise ConfigurationError(f"{path} has no object at its top")
    return found


def _number(entry: dict, key: str, default: float) -> float:
    value = entry.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ConfigurationError(f"{key} is not a number")
    return float(value)


def display_from(displays: dict, spaces: dict, name: str) -> Display:
    """A display and its colour space by name, with the defaults of what is left out."""
    if not isinstance(displays.get(name), dict):
        raise ConfigurationError(f"no display {name!r}")
    entry = displays[name]
    resolution = entry.get("resolution", [3840, 2160])
    width, height = (int(resolution[0]), int(resolution[1])) if len(resolution) >= 2 else (3840, 2160)
    distance = _number(entry, "viewing_distance_meters", 0.0) or _number(entry, "viewing_distance_inches", 0.0) * 0.0254
    diagonal = _number(entry, "diagonal_size_inches", 30.0)
    if distance <= 0:
        distance = diagonal / math.sqrt(1 + (width / max(height, 1)) ** 2) * 2 * 0.0254
    space_name = entry.get("colorspace", "BT.709")
    if not isinstance(spaces.get(space_name), dict):
        raise ConfigurationError(f"no colour space {space_name!r}")
    space = spaces[space_name]
    eotf, gamma = space.get("EOTF", "sRGB") or "sRGB", {"linear": 1.0, "HLG": 1.2}.get(space.get("EOTF"), 2.2)
    try:
        gamma, eotf = float(eotf), "gamma"
    except ValueError:
        pass
    if eotf not in ("sRGB", "linear", "PQ", "HLG", "gamma"):
        eotf, gamma = "sRGB", 2.2
    rows = tuple(tuple(space.get(k, ())) for k in ("RGB2X", "RGB2Y", "RGB2Z"))
    matrix = rows if all(len(r) == 3 for r in rows) else ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    return Display(name, width, height, distance, diagonal, _number(entry, "max_luminance", 200.0), _number(entry, "contrast", 1000.0), _number(entry, "E_ambient", 0.0), eotf, gamma, matrix)


def read_display(spark: SparkSession, folder: str, name: str, displays: str = "display_models.json", spaces: str = "color_spaces.json") -> Display:
    return display_from(read_document(spark, f"{folder}/{displays}"), read_document(spark, f"{folder}/{spaces}"), name)


#: The documents that a configuration folder holds at least; callers may ask for more.
DOCUMENTS = ("color_spaces.json", "display_models.json")


def find_folder(spark: SparkSession, candidates: list[str], documents: tuple[str, ...] = DOCUMENTS) -> str:
    """The first candidate that holds all documents; any file system that Spark reads."""
    missing = {}
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in dict.fromkeys(c.rstrip("/") for c in candidates if c):
        where = path(folder)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        missing[folder] = [d for d in documents if not store.exists(path(where, d))]
        if not missing[folder]:
            return folder
    raise ConfigurationError("no configuration folder: " + "; ".join(f"{k} lacks {', '.join(v)}" for k, v in missing.items()) if missing else "no configuration folder was named")


def table_of(document: dict, key: str, rows: int, columns: int) -> list[list[float]]:
    found = document.get(key)
    if not isinstance(found, list) or len(found) != rows:
        raise ConfigurationError(f"{key} needs {rows} rows")
    for i, row in enumerate(found):
        if not isinstance(row, list) or len(row) != columns:
            raise ConfigurationError(f"{key}, row {i}: {columns} numbers are needed")
        if any(isinstance(v, bool) or not isinstance(v, int | float) for v in row):
            raise ConfigurationError(f"{key}, row {i} has something else than numbers")
    return found


def read_sensitivity(spark: SparkSession, path: str):
    """The sensitivity table of a JSON document: axes L_bkg and rho, log10 tables o0_c1, o0_c2, o0_c3 and o5_c1."""
    from ..operators.visibility import Sensitivity

    document = read_document(spark, path)
    axes = []
    for key in ("L_bkg", "rho"):
        if not document.get(key):
            raise ConfigurationError(f"{key} is missing or empty")
        axes.append(table_of({key: [document[key]]}, key, 1, len(document[key]))[0])
    return Sensitivity.from_axes(*axes, [table_of(document, k, len(axes[0]), len(axes[1])) for k in ("o0_c1", "o0_c2", "o0_c3", "o5_c1")])


def check_parameters(spark: SparkSession, path: str, known: dict) -> dict:
    """The parameters document's values of the known names, each of the known one's form; names left out keep their value."""
    document, out = read_document(spark, path), dict(known)
    for key, have in known.items():
        if key not in document:
            continue
        value = document[key]
        if isinstance(have, tuple):
            table_of({key: [value]}, key, 1, len(have))
            out[key] = tuple(float(v) for v in value)
        elif isinstance(have, str):
            out[key] = str(value)
        else:
            out[key] = type(have)(_number(document, key, have))
    return out
