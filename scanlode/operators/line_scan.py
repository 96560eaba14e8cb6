"""Detectors that read one line at a time: shell scripts and configuration files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.domains import FILL_IN, SECRET_PHRASES, SECRET_WORDS
from scanlode.functions.texts import first_lines
from scanlode.operators.findings import ARROW, COLUMNS, SCHEMA, no_evidence

_EXPANDED = r"\$[\w@*#!?{]"
#: Shell rules in order of priority; a line has one finding at most.
SHELL = (
    ("SH001", "Variable text evaluated", "HIGH", r"(?:^|[\s;&|(])eval\s[^;&|#]*?[$`]"),
    ("SH002", "Variable inside back-ticks", "HIGH", rf"`[^`$]*{_EXPANDED}[^`]*`"),
    ("SH003", "Variable inside a command substitution", "MEDIUM", rf"\$\((?:[^()$][^)$]*)?{_EXPANDED}"),
    ("SH004", "Unquoted variable handed to a risky command", "HIGH", r"(?:^|[\s;&|(/])(?:ba|z)?(?:sh|curl|wget|python3?|perl|ruby|php)\s+(?:-[\w-]+\s+){0,10}[^\s\"'$]*\$[\w{]"),
)
#: A key is a credential's if it ends in one of the words, in the singular or plural, or one of its parts does, or if it holds one of the phrases.
SECRET_KEY = rf"(?i)(?:{'|'.join(SECRET_WORDS)})s?(?:$|[^a-z])|{'|'.join(x.replace(' ', '[-_.]?') for x in SECRET_PHRASES)}"
#: Values that stand for a value to be filled in: a word of these that begins one of the value's parts, or signs that surround a name.
PLACEHOLDER = rf"(?i)(?:^|[^a-z])(?:{'|'.join(FILL_IN)})(?:$|[^a-z])|{'|'.join(FILL_IN[1:])}(?:me|this|it)\b|<[^>]*>|^\$\{{|x{{3}}|\*{{3}}"
#: KEY=value or KEY: value, the value in quotes of one kind or bare.
PAIR = r"^(?:export\s+)?([A-Za-z_][\w.-]*)\s*[:=]\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s\"'][^\"']*))"


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_path", "language", F.posexplode(C.lines(F.col("content"))).alias("i", "line")).withColumn("line_number", F.col("i") + 1)


def shell(files: DataFrame) -> DataFrame:
    rows = _lines(files.where(F.col("language") == "bash")).where(~F.col("line").rlike(r"^\s*#"))
    which = F.lit(None).cast("int")
    for i, (_, _, _, pattern) in reversed(list(enumerate(SHELL))):
        which = F.when(F.col("line").rlike(pattern), i).otherwise(which)
    meta = F.element_at(F.array(*[F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("rule_name"), F.lit(c).alias("severity")) for a, b, c, _ in SHELL]), F.col("which") + 1)
    rows = rows.withColumn("which", which).where(F.col("which").isNotNull()).withColumn("m", meta)
    text = ("Text from a variable is run or split by the shell.", "Quote the variable and avoid evaluating text.")
    rows = rows.select(F.col("m.rule_id").alias("rule_id"), F.col("m.rule_name").alias("rule_name"), F.col("m.severity").alias("severity"), "file_path", "line_number", C.stripped(F.col("line")).alias("snippet"), "language")
    return rows.withColumns({"description": F.lit(text[0]), "fix": F.lit(text[1]), "confidence": F.lit("HIGH"), "evidence": no_evidence()}).select(*COLUMNS)


def real_value(value: Column) -> Column:
    return (F.length(value) >= 6) & ~value.rlike(PLACEHOLDER)


def _value(t: Column) -> Column:
    return F.trim(F.coalesce(*[F.nullif(F.regexp_extract(t, PAIR, g), F.lit("")) for g in (2, 3, 4)]))


def holds_credential(t: Column) -> Column:
    """Whether a stripped line is no comment and gives a credential's key a real value."""
    key = F.regexp_extract(t, PAIR, 1)
    return F.coalesce((t != "") & ~t.rlike("^[#;]") & (key != "") & key.rlike(SECRET_KEY) & real_value(_value(t)), F.lit(False))


def _pairs(files: DataFrame, rule_id: str, name: str) -> DataFrame:
    rows = _lines(files).withColumn("t", C.stripped(F.col("line"))).where(holds_credential(F.col("t"))).withColumn("key", F.regexp_extract("t", PAIR, 1))
    own = {
        "rule_id": F.lit(rule_id), "rule_name": F.lit(name), "severity": F.lit("HIGH"), "snippet": F.col("t"), "confidence": F.lit("MEDIUM"), "evidence": no_evidence(),
        "description": F.concat(F.lit("The key "), "key", F.lit(" holds a credential in plain text.")), "fix": F.lit("Read it from the environment or a secret store."),
    }
    return rows.withColumns(own).select(*COLUMNS)


def config_pairs(files: DataFrame) -> DataFrame:
    """CFG001: key-value files."""
    return _pairs(files.where(F.col("language").isin("env", "ini", "toml", "conf")), "CFG001", "Credential in a configuration file")


def config_yaml(files: DataFrame) -> DataFrame:
    """CFG003: YAML read line by line."""
    return _pairs(files.where(F.col("language") == "yaml"), "CFG003", "Credential in a YAML file")


#: Levels of objects and lists below the root that are searched.
JSON_DEPTH = 10


def _members(value: object, depth: int = 0) -> Iterator[tuple[str, str]]:
    """String members of objects, outermost first in file order."""
    if depth > JSON_DEPTH:
        return
    for key, x in value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else ():
        if isinstance(x, str) and key is not None:
            yield key, x
        elif isinstance(x, (dict, list)):
            yield from _members(x, depth + 1)


_SECRET, _PLACEHOLDER = re.compile(SECRET_KEY), re.compile(PLACEHOLDER)


def json_findings(path: str, content: str | None) -> list[dict]:
    """CFG002 of one file; none if it is no valid JSON."""
    try:
        tree = json.loads(content or "")
    except (ValueError, RecursionError):
        return []
    found = [(k, v) for k, v in _members(tree) if _SECRET.search(k) and len(v) >= 6 and not _PLACEHOLDER.search(v)]
    lines, out = first_lines(content.lower(), {f'"{k.lower()}"' for k, _ in found if "\n" not in k}), []
    for key, value in found:
        line = lines.get(f'"{key.lower()}"', 1)
        said = f"The key {key} holds a credential in plain text."
        out.append({"rule_id": "CFG002", "rule_name": "Credential in a JSON file", "severity": "HIGH", "file_path": path, "line_number": line, "snippet": f'"{key}": "{"*" * min(len(value), 8)}..."', "description": said, "fix": "Read it from the environment or a secret store.", "language": "json", "confidence": "MEDIUM", "evidence": None})
    return out


def config_json(files: DataFrame) -> DataFrame:
    """CFG002: string members of parsed JSON under a credential's name, down to ``JSON_DEPTH`` levels.

    Levels of unknown number are a walk, not a join, so this one detector runs in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in json_findings(p, t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.where(F.col("language") == "json").select("file_path", "content").mapInArrow(run, SCHEMA)


def config(files: DataFrame) -> DataFrame:
    return config_pairs(files).unionByName(config_yaml(files)).unionByName(config_json(files))
