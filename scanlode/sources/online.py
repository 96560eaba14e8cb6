"""Advisories from a service: batches of packages are posted by tasks, failures count and give nothing.

The service takes ``{"queries": [{"package": {"name", "ecosystem"}, "version"}]}`` and answers
``{"results": [{"vulns": [...]}]}``, a result for each query in order; a vulnerability is an advisory in the
public exchange schema or its id alone, whose text is then fetched from ``details``. Each distinct package is
asked for once, however many manifests name it, and each distinct id fetched once. A task has one request under way at a time.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.operators.dependencies import alias_of, severity_of
from scanlode.operators.findings import COLUMNS, no_evidence
from scanlode.plans.tables import cut

ANSWER = "ecosystem string, name string, version string, advisory string, error string"
TEXT = "id string, advisory string, error string"
#: The parts of an advisory that a finding needs.
SHAPE = "id string, aliases array<string>, summary string, severity array<struct<type: string, score: string>>, affected array<struct<ranges: array<struct<events: array<struct<fixed: string>>>>>>"


@dataclass(frozen=True)
class Service:
    """Where and how to ask: packages of a request, seconds to wait for an answer, how often to try again and how long to wait before that."""

    url: str
    details: str = ""
    size: int = 500
    timeout: float = 10.0
    retries: int = 2
    pause: float = 0.5


def _fetch(service: Service, request: urllib.request.Request) -> object:
    """A JSON answer. What may pass (no connection, no answer in time, an error of the server) is tried again, what is wrong with the request is not."""
    for left in range(service.retries, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=service.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or not left:
                raise
        except OSError:
            if not left:
                raise
        time.sleep(service.pause * 2 ** (service.retries - left))
    raise AssertionError("unreachable")


def _results(service: Service, packages: list[tuple[str, str, str]]) -> list[list[dict]]:
    """Vulnerabilities of each package."""
    queries = [{"package": {"name": name, "ecosystem": eco}} | ({"version": version} if version else {}) for eco, name, version in packages]
    request = urllib.request.Request(service.url, json.dumps({"queries": queries}).encode(), {"Content-Type": "application/json"}, method="POST")
    results = _fetch(service, request)["results"]
    if len(results) != len(packages):
        raise ValueError(f"{len(results)} results for {len(packages)} packages")
    return [r.get("vulns") or [] for r in results]


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


def ask(deps: DataFrame, service: Service) -> DataFrame:
    """``ANSWER``: a row per distinct package and advisory, and for each package of a request that failed one with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packages = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for at in range(0, len(packages), service.size):
                some = packages[at : at + service.size]
                try:
                    rows = [(*p, json.dumps(v), None) for p, vulns in zip(some, _results(service, some), strict=True) for v in vulns]
                except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
                    rows = [(*p, None, _told(e)) for p in some]
                if rows:
                    yield _batch(rows, ANSWER)

    packages = cut(deps.where(F.col("name") != "").select("ecosystem", "name", F.coalesce("version", F.lit("")).alias("version")).distinct())
    return packages.repartition(max(1, -(-packages.count() // service.size))).mapInArrow(run, ANSWER)


def texts(ids: DataFrame, service: Service) -> DataFrame:
    """``TEXT`` of each distinct id, from ``details``/id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                try:
                    rows.append((i, json.dumps(_fetch(service, urllib.request.Request(f"{service.details}/{urllib.parse.quote(i)}"))), None))
                except (OSError, ValueError) as e:
                    rows.append((i, None, _told(e)))
            if rows:
                yield _batch(rows, TEXT)

    ids = cut(ids.select("id").where("id IS NOT NULL").distinct())
    return ids.repartition(max(1, -(-ids.count() // service.size))).mapInArrow(run, TEXT)


def vulnerable(deps: DataFrame, service: Service) -> tuple[DataFrame, int]:
    """Findings of ``deps`` by what the service says, and for how many packages and advisories it gave nothing."""
    answers = cut(ask(deps, service))
    rows = answers.withColumn("a", F.from_json("advisory", SHAPE)).withColumn("id", F.col("a.id"))
    if service.details:
        full = cut(texts(rows.where("a IS NOT NULL AND a.affected IS NULL"), service)).select(F.col("id").alias("_id"), F.from_json("advisory", SHAPE).alias("full"), F.col("error").alias("missing"))
        rows = rows.join(full, (F.col("id") == F.col("_id")) & F.col("a.affected").isNull(), "left").withColumns({"a": F.coalesce("full", "a"), "error": F.coalesce("error", "missing")})
    failed = rows.where("error IS NOT NULL").count()
    rows = rows.where("a IS NOT NULL")
    told = rows.select(F.col("ecosystem").alias("_eco"), F.col("name").alias("_name"), F.col("version").alias("_version"), "a")
    # Manifests name the same packages over and over: the answers are the small side, if Spark finds them so.
    same = (F.col("ecosystem") == F.col("_eco")) & (F.col("name") == F.col("_name")) & (F.coalesce("version", F.lit("")) == F.col("_version"))
    events = F.flatten(F.flatten(F.transform("a.affected", lambda x: F.transform(x["ranges"], lambda r: r["events"]))))
    fixed = F.get(F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull()), 0)
    own = {
        "rule_id": F.concat(F.lit("SCA-"), alias_of(F.col("a.id"), F.col("a.aliases"))), "rule_name": F.concat(F.lit("Vulnerable dependency: "), "name"), "severity": severity_of(F.col("a.severity")), "line_number": F.col("line"),
        "snippet": F.concat_ws(" ", "name", "version"), "description": F.coalesce("a.summary", F.lit("")), "fix": F.coalesce(F.concat(F.lit("Upgrade to "), fixed, F.lit(" or later.")), F.lit("No fixed version is known.")),
        "language": F.lower("ecosystem"), "confidence": F.lit("HIGH"), "evidence": no_evidence(),
    }
    return deps.join(told, same).withColumns(own).select(*COLUMNS), failed
