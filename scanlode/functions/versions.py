"""Versions as text that sorts as each ecosystem orders them.

A key holds only characters whose order is that of their code points; numbers are
preceded by their length. A key ends with a sign lower than any that continues one, so
``after(key)`` lies just behind the version and before whatever is greater. A version
that its ecosystem's grammar doesn't know has no key (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammars: groups are the parts that order versions.
PEP440 = r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
SEMVER = r"^\s*[vV=]*\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+\S*)?\s*$"
GEM = r"^\s*(\d+(?:\.[0-9A-Za-z]+)*)(?:-.*)?\s*$"
#: Ends a key, and what stands behind every version of that key.
END, BEHIND = "!", "ÿ"


def _number(digits: Column) -> Column:
    """Digits, none standing for 0, with their length before them."""
    own = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(own).cast("string"), 3, "0"), own)


def _each(text: Column, pattern: str, spell) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spell), "")


def pep440(version: Column) -> Column:
    """Epoch, release without trailing zeros, pre-release (before it a development release of nothing else), post-release, development release, local label."""
    part = lambda g: F.regexp_extract(version, PEP440, g)
    pre, post, dev = F.lower(part(3)), (part(5) != "") | (part(6) != ""), part(8) != ""
    release = F.concat(_each(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\d+", lambda n: F.concat(F.lit("1"), _number(n))), F.lit("0"))
    kind = F.when(pre.startswith("a"), "1").when(pre.startswith("b"), "2").otherwise("3")
    before = F.when(pre != "", F.concat(kind, _number(part(4)))).when(dev & ~post, "0").otherwise("9")
    after = F.when(post, F.concat(F.lit("1"), _number(F.concat(part(5), part(7))))).otherwise("0")
    making = F.when(dev, F.concat(F.lit("0"), _number(part(9)))).otherwise("9")
    local = _each(F.lower(part(10)), r"\d+(?![a-z])(?<![a-z]\d{1,9})|[a-z0-9]+", lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("2"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" "))))
    return F.when(version.rlike(PEP440), F.concat(_number(part(1)), release, before, after, making, local, F.lit(END)))


def semver(version: Column) -> Column:
    """Up to four numbers, then the identifiers of a pre-release: numbers before words, fewer before more, all before none. Build labels don't count."""
    part = lambda g: F.regexp_extract(version, SEMVER, g)
    words = F.transform(F.split(part(5), r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" "))))
    before = F.when(part(5) == "", "~").otherwise(F.array_join(words, ""))
    return F.when(version.rlike(SEMVER), F.concat(*[_number(part(g)) for g in (1, 2, 3, 4)], before, F.lit(END)))


def gem(version: Column) -> Column:
    """Numbers and words in turn; a word comes before the end, a number behind it. A platform behind a hyphen doesn't count."""
    own = F.array_join(F.regexp_extract_all(F.regexp_extract(version, GEM, 1), F.lit(r"\d+|[A-Za-z]+"), F.lit(0)), ".")
    # Zeros that end the version or the numbers before its first word say nothing.
    own = F.regexp_replace(F.regexp_replace(own, r"(?:\.0+)+$", ""), r"^(\d+(?:\.\d+)*?)(?:\.0+)+(?=\.[A-Za-z])", "$1")
    spelt = _each(own, r"\d+|[A-Za-z]+", lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("3"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" "))))
    return F.when(version.rlike(GEM), F.concat(spelt, F.lit("2"), F.lit(END)))


def sort_key(ecosystem: Column, version: Column) -> Column:
    """The key of a version in its ecosystem; Go's pseudo-versions are pre-releases of semantic versions, and other ecosystems count as semantic."""
    return F.when(ecosystem == "PyPI", pep440(version)).when(ecosystem == "RubyGems", gem(version)).otherwise(semver(version))


def after(key: Column) -> Column:
    return F.concat(key, F.lit(BEHIND))


def package_name(ecosystem: Column, name: Column) -> Column:
    """The name by which an ecosystem knows a package: PyPI's don't tell case, hyphens, underscores and dots apart."""
    low = F.lower(name)
    return F.when(ecosystem == "PyPI", F.regexp_replace(low, r"[-_.]+", "-")).otherwise(low)
