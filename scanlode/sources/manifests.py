"""Generated dependency manifests, one per part, and a small advisory table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEMPLATES = (
    ("requirements.txt", "# pinned\nrequests==2.@K@.0\nflask>=1.0,<2.0\n-r base.txt\nnumpy\npkg[extra]==1.0\n"),
    ("package.json", '{"name": "p@K@", "dependencies": {"lodash": "^4.@K@.1", "left-pad": "1.0.0 || 2"}, "devDependencies": {"jest": "~29.0.1"}}'),
    ("go.mod", "module m@K@\n\ngo 1.20\n\nrequire (\n\tgithub.com/a/b v1.@K@.0\n\tgithub.com/c/d v0.3.0 // indirect\n)\nrequire github.com/e/f v2.0.0\n"),
    ("Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n    rails (6.@K@.1)\n      rack (>= 2.0)\n    rake (13.0.6)\n\nPLATFORMS\n  ruby\n"),
)

#: Made-up advisories in the public exchange schema.
ADVISORIES = [
    ("GHSA-0001", "PyPI", "requests", ["CVE-2020-0001"], [("CVSS_V3", "9.1")], "Header injection", [([("ECOSYSTEM", [("0", None, None), (None, "2.20.0", None)])], [])]),
    ("GHSA-0002", "npm", "lodash", [], [("CVSS_V3", "CVSS:3.1/AV:N"), ("SCORE", "7.5")], "Prototype pollution", [([("ECOSYSTEM", [("0", None, None), (None, "4.17.0", None)])], [])]),
    ("GHSA-0003", "Go", "github.com/c/d", ["CVE-2021-0003"], [("CVSS_V3", "3.0")], "Path traversal", [([("SEMVER", [("0", None, None)])], [])]),
    ("GHSA-0004", "RubyGems", "rails", ["X-1", "CVE-2019-0004"], [("SCORE", "5.0")], "Open redirect", [([("ECOSYSTEM", [("0", None, None), (None, "6.9.0", None)])], [])]),
    ("GHSA-0005", "PyPI", "numpy", [], [], "Overflow", [([("ECOSYSTEM", [("0", None, None), (None, "1.22.0", None)])], [])]),
]


def manifest_files(parts: DataFrame) -> DataFrame:
    """file_path, content."""
    key = F.col("p_partkey").cast("string")
    name, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (n, t) in enumerate(_TEMPLATES):
        own = F.col("p_partkey") % len(_TEMPLATES) == i
        name, code = F.when(own, n).otherwise(name), F.when(own, t).otherwise(code)
    return parts.select(F.concat(F.lit("deps/"), key, F.lit("/"), name).alias("file_path"), F.replace(code, F.lit("@K@"), key).alias("content"))


#: Advisories with branches, pre-releases, last affected and listed versions, made up in the same schema.
BRANCHED = [
    ("B-1", "PyPI", "Web_Frame", ["CVE-2024-1001"], [("SCORE", "9.8")], "SQL injection", [([("ECOSYSTEM", [("3.2", None, None), (None, "3.2.19", None), ("4.0a1", None, None), (None, "4.0.3", None)])], [])]),
    ("B-2", "PyPI", "web-frame", [], [], "Slow parsing", [([("GIT", [("0", None, None)]), ("ECOSYSTEM", [("0", None, None), (None, None, "3.2.0")])], ["4.1.dev2", "1!0.5"])]),
    ("B-3", "npm", "chain", ["CVE-2024-1003"], [("SCORE", "7.1")], "Prototype pollution", [([("SEMVER", [("1.0.0-beta.2", None, None), (None, "1.0.0-rc.1", None), ("2.0.0", None, None), (None, "2.3.1", None)])], [])]),
    ("B-4", "Go", "example.org/box", [], [], "Escape", [([("SEMVER", [("0", None, None), (None, "0.0.0-20230315120000-abcdefabcdef", None)]), ("SEMVER", [("1.0.0", None, None), (None, None, "1.2.3")])], [])]),
    ("B-5", "RubyGems", "net.http", ["CVE-2024-1005"], [("SCORE", "5.0")], "Header injection", [([("ECOSYSTEM", [("5.0.0.beta1", None, None), (None, "5.2.8.1", None), ("6.0", None, None), (None, "6.1.7", None)])], [])]),
]
#: package's ecosystem, name and version, and the answers by hand: the advisories that hold and their fixes.
BRANCH_CASES: list[tuple[str, str, str, tuple[tuple[str, str | None], ...]]] = [
    ("PyPI", "web-frame", "3.1.9", (("B-2", None),)),
    ("PyPI", "web.frame", "3.2", (("CVE-2024-1001", "3.2.19"), ("B-2", None))),
    ("PyPI", "Web-Frame", "3.2.0.0", (("CVE-2024-1001", "3.2.19"), ("B-2", None))),
    ("PyPI", "web-frame", "3.2.0.post1", (("CVE-2024-1001", "3.2.19"),)),
    ("PyPI", "web-frame", "3.2.18", (("CVE-2024-1001", "3.2.19"),)),
    ("PyPI", "web-frame", "3.2.19rc1", (("CVE-2024-1001", "3.2.19"),)),
    ("PyPI", "web-frame", "3.2.19", ()),
    ("PyPI", "web-frame", "3.10", ()),
    ("PyPI", "web-frame", "4.0.dev9", ()),
    ("PyPI", "web-frame", "4.0a1", (("CVE-2024-1001", "4.0.3"),)),
    ("PyPI", "web-frame", "4.0", (("CVE-2024-1001", "4.0.3"),)),
    ("PyPI", "web-frame", "4.0.3", ()),
    ("PyPI", "web-frame", "4.1.dev2", (("B-2", None),)),
    ("PyPI", "web-frame", "1!0.5", (("B-2", None),)),
    ("PyPI", "web-frame", "1!0.6", ()),
    ("npm", "chain", "1.0.0-beta.1", ()),
    ("npm", "chain", "1.0.0-beta.2", (("CVE-2024-1003", "1.0.0-rc.1"),)),
    ("npm", "chain", "1.0.0-beta.11", (("CVE-2024-1003", "1.0.0-rc.1"),)),
    ("npm", "chain", "1.0.0-rc.1", ()),
    ("npm", "chain", "1.9.9", ()),
    ("npm", "chain", "2.0.0-rc.1", ()),
    ("npm", "chain", "2.3.0+build.7", (("CVE-2024-1003", "2.3.1"),)),
    ("npm", "chain", "2.10.0", ()),
    ("Go", "example.org/box", "0.0.0-20230315115959-0123456789ab", (("B-4", "0.0.0-20230315120000-abcdefabcdef"),)),
    ("Go", "example.org/box", "0.0.0-20230315120001-0123456789ab", ()),
    ("Go", "example.org/box", "1.2.3", (("B-4", "0.0.0-20230315120000-abcdefabcdef"),)),
    ("Go", "example.org/box", "1.2.4-0.20240101000000-0123456789ab", ()),
    ("Go", "example.org/box", "1.2.3+incompatible", (("B-4", "0.0.0-20230315120000-abcdefabcdef"),)),
    ("RubyGems", "net.http", "5.0.0.alpha9", ()),
    ("RubyGems", "net.http", "5.0.0.beta1.1", (("CVE-2024-1005", "5.2.8.1"),)),
    ("RubyGems", "net.http", "5.2.8", (("CVE-2024-1005", "5.2.8.1"),)),
    ("RubyGems", "net.http", "5.2.8.1-x86_64-linux", ()),
    ("RubyGems", "net.http", "6.0.rc1", ()),
    ("RubyGems", "net.http", "6.0.0", (("CVE-2024-1005", "6.1.7"),)),
    ("RubyGems", "net.http", "6.1.7.0", ()),
]
#: A manifest of each ecosystem that names one package.
SINGLE = {"PyPI": ("requirements.txt", "# one\n@N@==@V@\n"), "npm": ("package.json", '{"dependencies": {"@N@": "^@V@"}}'), "Go": ("go.mod", "module m\n\nrequire @N@ v@V@\n"), "RubyGems": ("Gemfile.lock", "GEM\n  specs:\n    @N@ (@V@)\n      rack (>= 2)\n")}


def branch_files(parts: DataFrame) -> DataFrame:
    """file_path, content: a manifest per part that names the case of its number."""
    rows = [(i, *SINGLE[eco], name, version) for i, (eco, name, version, _) in enumerate(BRANCH_CASES)]
    cases = parts.sparkSession.createDataFrame(rows, "_i int, file string, code string, name string, version string")
    own = parts.select("p_partkey", (F.col("p_partkey") % len(BRANCH_CASES)).cast("int").alias("_i"))
    # A constant table of a few kilobytes.
    own = own.join(F.broadcast(cases), "_i")
    return own.select(F.concat(F.lit("branches/"), F.col("p_partkey").cast("string"), F.lit("/"), "file").alias("file_path"), F.replace(F.replace("code", F.lit("@N@"), F.col("name")), F.lit("@V@"), F.col("version")).alias("content"))


def templates() -> tuple[tuple[str, str], ...]:
    return _TEMPLATES
