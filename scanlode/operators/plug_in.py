"""Own detectors: a class with one method, registered as a table function for SQL and for scans.

    class Marks(Detector):
        name, languages, options = "marks", frozenset({"python"}), {"word": str}
        def detect(self, path, text): ...

    register(spark, Marks)
    SELECT f.file_path, d.* FROM files f, LATERAL marks(f.file_path, f.content, f.language, word => 'todo') d

A detector's options are checked when the query is analysed, so a wrong name, a wrong type or a value
that is no constant is an error before anything runs. A detector is made once per task. What it raises
becomes a row with ``error`` and no rule: the other files go on, and no task fails. Only files of its languages
go to Python, in pickled batches: a call is a row, and Arrow would make a batch of each. Nothing is shuffled.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scanlode.functions import columns as C
from scanlode.functions.domains import CONFIDENCES, SEVERITIES
from scanlode.operators.findings import COLUMNS, no_evidence

COLUMNS_OF = ("rule_id", "rule_name", "severity", "line_number", "description", "fix", "confidence", "error")


@dataclass(frozen=True)
class Found:
    """What a detector reports; a severity or confidence outside its domain is an error of the detector."""

    rule_id: str
    line_number: int
    rule_name: str = ""
    severity: str = "MEDIUM"
    description: str = ""
    fix: str = ""
    confidence: str = "MEDIUM"


class Detector(ABC):
    #: The table function's name, the languages it looks at (none: all), and its options' types.
    name: str
    languages: frozenset[str] = frozenset()
    options: dict[str, type] = {}

    def __init__(self, **options: object):
        self.given = options

    @abstractmethod
    def detect(self, path: str, text: str) -> Iterable[Found]:
        """Findings of one file."""


@dataclass
class _Checked(AnalyzeResult):
    given: dict[str, object] = field(default_factory=dict)


def checked(detector: type[Detector], given: dict[str, AnalyzeArgument]) -> dict[str, object]:
    """Values of a detector's options."""
    out = {}
    for name, argument in given.items():
        kind = detector.options.get(name)
        if kind is None:
            raise ValueError(f"{detector.name} has no option {name}; it has {', '.join(sorted(detector.options)) or 'none'}")
        if not argument.isConstantExpression:
            raise ValueError(f"option {name} of {detector.name} must be a constant")
        if not isinstance(argument.value, kind) or (kind is int and isinstance(argument.value, bool)):
            raise ValueError(f"option {name} of {detector.name} must be of type {kind.__name__}")
        out[name] = argument.value
    return out


def schema() -> StructType:
    out = StructType()
    for name in COLUMNS_OF:
        out.add(name, IntegerType() if name == "line_number" else StringType())
    return out


def _row(x: Found) -> tuple:
    if x.severity not in SEVERITIES or x.confidence not in CONFIDENCES:
        raise ValueError(f"no severity or confidence: {x.severity}, {x.confidence}")
    return (x.rule_id, x.rule_name or x.rule_id, x.severity, int(x.line_number), x.description, x.fix, x.confidence, None)


def table_function(detector: type[Detector]) -> type:
    """The handler class of a detector's table function."""

    class Handler:
        def __init__(self, result: _Checked):
            self.given, self.own = result.given, None

        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, language: AnalyzeArgument, **given: AnalyzeArgument) -> _Checked:
            return _Checked(schema=schema(), given=checked(detector, given))

        def eval(self, path: str, content: str, language: str, **_: object) -> Iterator[tuple]:
            if content is None or (detector.languages and language not in detector.languages):
                return
            try:
                if self.own is None:
                    self.own = detector(**self.given)
                rows = [_row(x) for x in self.own.detect(path, content)]
            except Exception as e:  # a detector is someone else's code: its error is a result
                rows = [(None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:1000])]
            yield from rows

    return Handler


def register(spark: SparkSession, detector: type[Detector]) -> None:
    """Makes a detector a table function of this session."""
    spark.udtf.register(detector.name, F.udtf(table_function(detector), useArrow=False))


def _literal(value: object) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)


def detect(files: DataFrame, detector: type[Detector], **options: object) -> DataFrame:
    """file_path, content, language and ``COLUMNS_OF`` of ``files(file_path, content, language)``, errors included."""
    register(files.sparkSession, detector)
    given = "".join(f", {k} => {_literal(v)}" for k, v in options.items())
    text = f"SELECT f.file_path, f.content, f.language, d.* FROM {{files}} f, LATERAL {detector.name}(f.file_path, f.content, f.language{given}) d"
    own = files.select("file_path", "content", "language").where(F.col("language").isin(*detector.languages) if detector.languages else F.col("language").isNotNull())
    return files.sparkSession.sql(text, files=own)


def findings(detected: DataFrame) -> DataFrame:
    """What detectors report as findings, one per line and rule; errors are left out (see ``errors``)."""
    own = detected.where("error IS NULL").withColumns({"snippet": C.snippet(F.col("content"), F.col("line_number")), "evidence": no_evidence()})
    return own.select(*COLUMNS).dropDuplicates(["file_path", "line_number", "rule_id"])


def errors(detected: DataFrame) -> DataFrame:
    """file_path, error of the files that a detector failed on."""
    return detected.where("error IS NOT NULL").select("file_path", "error")
