"""The whole scan as one lazy plan: route, detect, silence, calibrate, filter, subtract, fingerprint."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.rules import BUILTIN, Rule
from scanlode.operators import findings as fd
from scanlode.operators import plug_in
from scanlode.operators.one_pass import detect


@dataclass
class Options:
    severity: str = "LOW"
    confidence: str = "LOW"
    policy: str = "balanced"
    disabled: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    enforce: bool = False
    today: datetime.date = field(default_factory=datetime.date.today)
    rules: list[Rule] = field(default_factory=lambda: BUILTIN)
    #: Own detectors and their options.
    detectors: tuple[tuple[type[plug_in.Detector], dict], ...] = ()


def routed(files: DataFrame) -> DataFrame:
    """Adds tier and language by path; files without a language have none."""
    return files.withColumns({"tier": C.tier(F.col("file_path")), "language": C.language(F.col("file_path"))})


def admitted(files: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    out = files.where(F.col("language").isNotNull())
    for glob in excluded:
        out = out.where(~F.col("file_path").rlike(C.glob_regex(glob)))
    return out


def scan(files: DataFrame, options: Options | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Findings with fingerprints of ``files(file_path, content)``."""
    o = options or Options()
    own = admitted(routed(files), o.excluded)
    out = detect(own, o.rules)
    for detector, given in o.detectors:
        out = out.unionByName(plug_in.findings(plug_in.detect(own, detector, **given)))
    out = fd.calibrate(fd.unsuppressed(out, o.today, o.enforce, o.disabled))
    out = fd.with_fingerprints(fd.at_least(out, *fd.thresholds(o.policy, o.severity, o.confidence)))
    return out if baseline is None else fd.new_since(out, baseline)
