"""Detectors as a user would write them, for queries and tests."""

from __future__ import annotations

from collections.abc import Iterator

from scanlode.operators.plug_in import Detector, Found


class Marks(Detector):
    """Lines that hold a word."""

    name, options = "marks", {"word": str, "least_line": int}

    def detect(self, path: str, text: str) -> Iterator[Found]:
        word, least = self.given.get("word", "TODO"), self.given.get("least_line", 1)
        for i, line in enumerate(text.split("\n"), 1):
            if word in line and i >= least:
                yield Found("OWN2", i, "A marked line", "LOW")


class Strict(Detector):
    """Reports the first line of shell scripts and gives up on Ruby."""

    name, languages = "strict_heads", frozenset({"bash", "ruby"})

    def detect(self, path: str, text: str) -> list[Found]:
        if path.endswith((".rb", ".rake", ".erb", ".gemspec")):
            raise RuntimeError("no Ruby here")
        return [Found("OWN3", 1, severity="HIGH", confidence="HIGH")]
