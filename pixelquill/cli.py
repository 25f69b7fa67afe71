"""Compare two videos from the command line.

    python -m pixelquill.cli --source a.y4m --encoded b.y4m --metric structural

A file named by --config-file holds further options on its first line.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, Row, SparkSession

from .functions.constants import DISPLAY_PARAMETERS
from .operators import pooling, sampling
from .operators.psychovisual import psychovisual_distance
from .operators.structural import structural_score
from .operators.visibility import display_difference
from .sources import config, frames, video
from .sources import scores as files


class Once(argparse.Action):
    """Stores a value, and refuses an option that is given again."""

    def __call__(self, parser, namespace, values, option_string=None):
        given = namespace.__dict__.setdefault("_given", set())
        if self.dest in given:
            parser.error(f"{option_string} is given more than once")
        given.add(self.dest)
        setattr(namespace, self.dest, values)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pixelquill")
    p.register("action", None, Once)
    p.add_argument("-s", "--source", required=True)
    p.add_argument("-e", "--encoded", required=True)
    p.add_argument("-m", "--metric", default="structural")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--end", type=int, default=-1)
    p.add_argument("--every", type=int, default=1)
    p.add_argument("--encoded-offset", type=int, default=0)
    p.add_argument("--source-indices", default="")
    p.add_argument("--encoded-indices", default="")
    p.add_argument("--intensity-target", type=float, default=203.0)
    p.add_argument("--qnorm", type=float, default=2.0)
    p.add_argument("--config-dir", help="folder of the display metric's documents")
    p.add_argument("--sensitivity", help="JSON document of the contrast sensitivity")
    p.add_argument("--parameters", help="JSON document of the display metric's parameters")
    p.add_argument("--display", default="standard_4k", help="a display of the configuration")
    p.add_argument("--fps", type=float, default=0.0, help="frames a second for the display metric; else the source's")
    p.add_argument("--json")
    p.add_argument("--config-file")
    for side in ("source", "encoded"):
        for edge in ("top", "bottom", "left", "right"):
            p.add_argument(f"--crop-{edge}-{side}", type=int, default=0)
    return p


def options(argv: list[str]) -> argparse.Namespace:
    p = parser()
    known, _ = p.parse_known_args(argv)
    if known.config_file:
        with open(known.config_file, encoding="utf-8") as f:
            argv = [*argv, *f.readline().split(" ")]
    return p.parse_args([a for a in argv if a.strip()])


def _one(spark: SparkSession, path: str) -> Row:
    """The index row of a path that is one file."""
    rows = video.file_index(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise SystemExit(f"{path} is not one file")
    return rows[0]


def compare(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """The scores of the chosen frames, and the names of their columns.

    Which frames meet is settled from the files' heads; then a task reads both frames of its pairs and no others,
    crops them and brings the encoded one to the source's size."""
    source, encoded = (_one(spark, p) for p in (o.source, o.encoded))
    rate = source.fps
    span = sampling.resolve(source.frames, encoded.frames, o.start, o.end, o.every, o.encoded_offset)
    lists = sampling.index_list(o.source_indices), sampling.index_list(o.encoded_indices)
    which = sampling.listed_pairs(span, source.frames, encoded.frames, *lists) if any(lists) else span
    crop = lambda side: tuple(getattr(o, f"crop_{e}_{side}") for e in ("top", "bottom", "left", "right"))
    both = frames.read_pairs(spark, frames.Side(source.path, crop=crop("source")), frames.Side(encoded.path, crop=crop("encoded")), which, f"{o.source}|{o.encoded}")
    if sampling.metric_name(o.metric) == "structural":
        return structural_score(both), ["score"]
    if sampling.metric_name(o.metric) == "psychovisual":
        return psychovisual_distance(both, o.qnorm, o.intensity_target), ["norm_q", "norm_3", "norm_inf"]
    folder = config.find_folder(spark, [o.config_dir or ""])
    shown = config.read_display(spark, folder, o.display)
    parameters = config.check_parameters(spark, o.parameters, DISPLAY_PARAMETERS) if o.parameters else DISPLAY_PARAMETERS
    if not o.sensitivity:
        raise SystemExit("the display metric needs a contrast sensitivity: --sensitivity FILE")
    table = config.read_sensitivity(spark, o.sensitivity)
    return display_difference(both, shown, table, o.fps or rate or 30.0, parameters=parameters), ["score"]


def main(argv: list[str] | None = None) -> int:
    o = options(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("pixelquill").getOrCreate()
    found, values = compare(spark, o)
    began = time.monotonic()
    found = found.persist()
    pairs = found.count()
    print(f"{pairs} frames, {pairs / max(time.monotonic() - began, 1e-9):.2f} a second", file=sys.stderr)
    if o.json:
        files.write_json(found, o.json, values)
    for v in values:
        print(files.report(pooling.summarize(found, v), f"{o.metric} {v}"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
