"""Column expressions that the operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlode.functions.domains import CONFIDENCES, EXTENSIONS, LOW_RULES, MEDIUM_RULES, SEVERITIES, TAINT_RULES, UNKNOWN_RANK


def rank(value: Column, domain: dict[str, int]) -> Column:
    """Ordinal of a domain value; unknown values come last."""
    out = F.lit(UNKNOWN_RANK)
    for name, i in domain.items():
        out = F.when(value == name, i).otherwise(out)
    return out


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def confidence_rank(value: Column) -> Column:
    return rank(value, CONFIDENCES)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty for names like ``.env``."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def _route(path: Column, part: int) -> Column:
    name = F.lower(file_name(path))
    table = F.create_map(*[F.lit(x) for e, info in EXTENSIONS.items() for x in (e, info[part])])
    return F.when(name.isin(".env", ".envrc") | name.startswith(".env."), ("secrets", "env")[part]).otherwise(table[suffix(path)])


def tier(path: Column) -> Column:
    return _route(path, 0)


def language(path: Column) -> Column:
    return _route(path, 1)


def lines(content: Column) -> Column:
    return F.split(content, "\n")


def stripped(text: Column) -> Column:
    """Without white space (tabs included) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def snippet(content: Column, line: Column) -> Column:
    """A line without white space at its end; empty if there is no such line."""
    return F.coalesce(F.regexp_replace(F.try_element_at(lines(content), line), r"[\s]+$", ""), F.lit(""))


def _feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def lines_of(gaps: Column, matches: Column) -> Column:
    """Line, from 1, on which each match begins: one running total of the line feeds in the gaps and in the matches between them."""
    step = F.transform(matches, lambda m, i: F.struct(_feeds(F.get(gaps, i)).alias("before"), _feeds(m).alias("own")))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("lines"))
    run = lambda s, x: F.struct((s["line"] + x["before"] + x["own"]).alias("line"), F.array_append(s["lines"], s["line"] + x["before"]).alias("lines"))
    # Most rules match once in a file.
    return F.when(F.size(matches) == 1, F.array(1 + _feeds(F.get(gaps, F.lit(0))))).otherwise(F.aggregate(step, start, run)["lines"])


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; ``text`` is worked out once."""

    def bits(t: Column) -> Column:
        n = F.length(t)
        distinct = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
        share = F.transform(distinct, lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n)
        return F.aggregate(F.sort_array(share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.get(F.transform(F.array(text), bits), F.lit(0))


def fingerprint() -> Column:
    """SHA-1 over rule, path, line, snippet and language."""
    parts = ("rule_id", "file_path", F.col("line_number").cast("string"), F.trim("snippet"), F.trim("language"))
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]))


def calibrated() -> Column:
    """Confidence by rule and evidence."""
    rule = F.upper("rule_id")
    seen = F.coalesce(F.size("evidence.taint_sources") > 0, F.lit(False))
    out = F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence")).otherwise("HIGH")
    out = F.when(rule.isin(*TAINT_RULES), F.when(seen, "HIGH").otherwise("MEDIUM")).otherwise(out)
    return F.when(rule.isin(*LOW_RULES), "LOW").when(rule.isin(*MEDIUM_RULES), "MEDIUM").otherwise(out)


def masked(value: Column) -> Column:
    """As many stars as the value is long, eight at most."""
    return F.repeat(F.lit("*"), F.least(F.length(value), F.lit(8)))


def first_sentence(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", "No description.").otherwise(F.element_at(F.split(t, r"(?<=[.!?])\s+"), 1))


def first_line(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", "No fix given.").otherwise(F.element_at(F.split(t, "\n"), 1))


#: Named character references: fixed values, the ampersand last.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
NUMBERED = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def unescaped(html: Column) -> Column:
    """Text in which character references, named or numbered, are characters; a number that is no character is left out."""
    codes = F.regexp_extract_all(html, F.lit(NUMBERED), F.lit(0))
    digits = lambda c: F.regexp_extract(c, r"[0-9A-Fa-f]+", 0)
    number = lambda c: F.when(F.lower(c).startswith("&#x"), F.conv(digits(c), 16, 10).cast("long")).otherwise(digits(c).cast("long"))
    sign = lambda n: F.when(((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000)), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")
    out = F.array_join(F.zip_with(F.split(html, NUMBERED), codes, lambda gap, c: F.concat(gap, F.when(c.isNull(), "").otherwise(sign(number(c))))), "")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def glob_regex(glob: str) -> str:
    """A path glob relative to the scan root, with ``**`` for any number of folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r"\.^$+{}()|[]" else glob[i]), i + 1
    return f"^{out}$" if "/" in glob else f"^(?:.*/)?{out}$"
