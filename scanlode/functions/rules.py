"""The regular-expression rule catalogue as data, and loaders for rules of one's own.

Patterns keep to what Java, Python and RE2 read alike: no look-around and no
back-references. Where a rule has an exception, ``unless`` is a second pattern that
the matched text must not hold.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from scanlode.functions.domains import SCRIPT_NAMES, SCRIPT_OBJECTS

#: Flags of every rule: ignore case, line anchors.
FLAGS = "(?im)"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    severity: str
    cwe: int
    language: str
    pattern: str
    unless: str = ""
    gated: bool = False
    description: str = ""
    fix: str = ""
    confidence: str = "HIGH"
    references: tuple[str, ...] = ()
    #: Texts in lower case of which every match holds one whatever its case: a cheap test before the pattern. None: always matched.
    holds: tuple[str, ...] = ()


# A sink's arguments, from its bracket on. ``_ARGS`` runs over them and steps over quoted text and
# nested calls, so a sign found after it is code and not part of a literal; it repeats a bounded
# number of times, which keeps the matcher's stack flat on any input.
_ARGS = r"[^()\"'`;]*(?:(?:\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|\([^()\"'`;]*\))[^()\"'`;]*){0,12}?"
_NAME = r"[A-Za-z_$][\w$]*"
_TEMPLATE = r"`[^`]*\$\{[^}]*\}"


def _call(callee: str, holds: str, before: str = _ARGS) -> str:
    """A call of ``callee`` whose arguments hold ``holds`` after ``before``."""
    return rf"{callee}\s*\({before}(?:{holds})"


def _built(callee: str, ends: str) -> str:
    """A script call with joined text, a filled template, or nothing but a name up to ``ends``."""
    return _call(callee, rf"\+\s*[\w$.]*|{_TEMPLATE}") + rf"|{callee}\s*\(\s*{_NAME}\s*{ends}"


#: What a variable is called at its end that holds what visitors send, a command, a place on disk or an address: one vocabulary for all languages.
ENDINGS = {
    "input": ("Arg", "Body", "Data", "Form", "Input", "Param", "Payload", "Query"),
    "command": ("Cmd", "Command", "Script", "Shell"),
    "place": ("Dir", "File", "Filename", "Folder", "Page", "Path", "Template"),
    "address": ("Address", "Endpoint", "Host", "Link", "Uri", "Url"),
}


def _ending(*kinds: str) -> str:
    """The end of a name of these kinds, in the singular or plural."""
    return rf"\w(?:{'|'.join(w for k in kinds for w in ENDINGS[k])})s?\b"


# What visitors send, by language.
_JS_INPUT = rf"\b(?:{'|'.join((*SCRIPT_OBJECTS, 'ctx'))})\s*\.\s*[\w$]+|\b(?:{'|'.join(x.replace('.', r'[.]') for x in SCRIPT_NAMES)})\b|{_ending('input')}"
_JAVA_INPUT = rf"\b(?:req|request)\s*\.|\bget(?:Parameter|PathVariable|Header|QueryString)\b|{_ending('input')}"
_PHP_INPUT = r"\$_(?:GET|POST|REQUEST|COOKIE)\b"
_RUBY_CALL = r"[\s(]+[^\n]*?"
#: PHP functions that start a program, and those that open, move or make a file: the language's own.
PHP_PROGRAMS = ("exec", "passthru", "pcntl_exec", "popen", "proc_open", "shell_exec", "system")
PHP_FILES = ("copy", "file_get_contents", "file_put_contents", "fopen", "link", "mkdir", "move_uploaded_file", "parse_ini_file", "readfile", "rename", "rmdir", "scandir", "symlink", "touch", "unlink")


def _php(callee: str, *kinds: str) -> str:
    """A PHP call whose statement goes on to visitors' data or to a variable whose name is of one of ``kinds``."""
    return rf"\b(?:{callee})\s*\([^;]*?(?:{_PHP_INPUT}|\$\w*{_ending(*kinds)})"


def _params(callee: str) -> str:
    """A Ruby call, brackets or none, with request parameters on its line."""
    return rf"(?:{callee}){_RUBY_CALL}\bparams\b"


#: The rules; ids, severities and CWE numbers are fixed values.
_CATALOGUE: list[tuple] = [
    # id, name, severity, CWE, language, pattern[, unless]
    ("SQL101", "SQL statement built from dynamic text", "HIGH", 89, "javascript", _call(r"(?:\.\s*(?:query|execute|raw)|\bdb\s*\.\s*run)", rf"\+\s*[\w$.]*|{_TEMPLATE}")),
    ("CMD101", "Shell command from dynamic text in exec", "HIGH", 78, "javascript", _built(r"\bexec", "[,)]")),
    ("CMD102", "Shell command from dynamic text in execSync", "HIGH", 78, "javascript", _built(r"\bexecSync", "[,)]")),
    ("CMD103", "Process started from dynamic text in spawn", "HIGH", 78, "javascript", rf"\bspawn\s*\((?:{_ARGS}\+{_ARGS}|\s*(?:{_NAME}|{_TEMPLATE}[^`]*`)\s*),"),
    ("PRO101", "Prototype reached through a computed key", "HIGH", 1321, "javascript", r"(?:__proto__\s*\[?|\b(?:prototype|constructor)\s*\[)\s*[\"'][\w$-]+[\"']"),
    ("XSS101", "Request data assigned to innerHTML", "HIGH", 79, "javascript", rf"\.\s*innerHTML\s*\+?=[^=;][^;]*?(?:{_JS_INPUT})"),
    ("XSS102", "Request data written with document.write", "HIGH", 79, "javascript", rf"\bdocument\s*\.\s*write(?:ln)?\s*\([^;]*?(?:{_JS_INPUT})"),
    ("SSRF101", "Request to a dynamic address", "HIGH", 918, "javascript", _built(r"\b(?:fetch|axios(?:\s*\.\s*(?:get|post|request))?|https?\s*\.\s*(?:get|request))", "[,)]")),
    ("DSER101", "Object revived by a code-running serializer", "HIGH", 502, "javascript", r"\b(?:serializer?|node-serialize|serialize-to-js)[\"')\s]*\.\s*unserialize\s*\("),
    ("DSER104", "YAML loaded without a schema", "HIGH", 502, "javascript", r"\byaml\s*\.\s*load\s*\(\s*[^(),;]+(?:\([^(),;]*\))?\s*\)"),
    ("CRY101", "Weak hash algorithm", "HIGH", 327, "javascript", r"\bcreateHash\s*\(\s*[\"'`](?:md[245]|sha-?1)[\"'`]"),
    ("CRY102", "Predictable random numbers", "MEDIUM", 338, "javascript", r"\bMath\s*\.\s*random\s*\(\s*\)"),
    ("PATH101", "Request data in a file path", "HIGH", 22, "javascript", rf"\bfs(?:\s*\.\s*promises)?\s*\.\s*(?:(?:append|read|write)(?:File|Sync)|open|unlink|create(?:Read|Write)Stream)\s*\([^;]*?(?:{_JS_INPUT})"),
    ("SQL201", "SQL statement built by concatenation or formatting", "HIGH", 89, "java", _call(r"\.\s*(?:execute(?:Query|Update|LargeUpdate)?|addBatch|prepare(?:Statement|Call))", r"\+|\bString\s*\.\s*(?:format|valueOf|join)\b|\bStringBuilder\b")),
    ("SQL202", "Raw interpolation in a mapped query", "HIGH", 89, "java", r"\b(?:select|insert\s+into|update|delete|from|where|order\s+by)\b[^\"'\n]*?\$\{\s*[\w.]+\s*\}"),
    ("CMD201", "Runtime.exec with dynamic text", "HIGH", 78, "java", r"\bgetRuntime\s*\(\s*\)\s*\.\s*exec\s*\([^;\n]*?(?:\+|\bnew\s+String\b|" + _ending("command", "input") + ")"),
    ("CMD202", "ProcessBuilder with dynamic text", "HIGH", 78, "java", rf"\bnew\s+ProcessBuilder\s*\([^;)]*?(?:\+|{_JAVA_INPUT}|\bparams\s*\.|{_ending('command')})"),
    ("XXE201", "XML factory with external entities", "HIGH", 611, "java", r"\b(?:DocumentBuilder|SAXParser|Transformer|XMLInput)Factory\s*\.\s*new(?:Instance|Factory|DefaultInstance)\s*\("),
    ("DSER201", "Object revived from a stream", "HIGH", 502, "java", r"\bObjectInputStream\s*\(|\.\s*read(?:Object|Unshared)\s*\(\s*\)"),
    ("SSRF201", "Request to a dynamic address", "HIGH", 918, "java", r"\bnew\s+URL\s*\(\s*(?:[A-Za-z_]|\"[^\"\n]*\"\s*\+)[^;\n]*?\)\s*\.\s*open(?:Connection|Stream)\b|\b(?:HttpURLConnection|OkHttp\w*|RestTemplate)\b"),
    ("CRY201", "Weak hash algorithm", "HIGH", 327, "java", r"\bMessageDigest\s*\.\s*getInstance\s*\(\s*\"(?:MD[25]|SHA-?1?)\""),
    ("CRY202", "Predictable random numbers", "MEDIUM", 338, "java", r"\bnew\s+(?:[\w.]+\.)?Random\s*\("),
    ("PATH201", "Request data in a file path", "HIGH", 22, "java", rf"\bnew\s+(?:[\w.]+\.)?(?:RandomAccess)?File(?:(?:In|Out)putStream|Reader|Writer)?\s*\([^;)]*?(?:{_JAVA_INPUT}|{_ending('place')})"),
    ("CONF201", "Cross-site request protection switched off", "HIGH", 352, "java", r"\bcsrf\s*(?:\(\s*\)\s*)?\.\s*disable\b|\bcsrf\s*\(\s*\w+\s*(?:::|->\s*\w+\s*\.)\s*disable\b"),
    ("LOG201", "Request data in a log message", "MEDIUM", 117, "java", rf"\blog(?:ger)?\s*\.\s*(?:config|debug|error|fatal|fine|info|log|severe|trace|warn(?:ing)?)\s*\([^;)]*?(?:{_JAVA_INPUT})"),
    ("SQL301", "Request data in a query call", "HIGH", 89, "php", _php(r"(?:mysqli?_(?:multi_|real_|unbuffered_)?|odbc_|pg_|sqlsrv_)(?:exec|query)", "input")),
    ("SQL302", "Query without a prepared statement", "HIGH", 89, "php", r"\$(?:pdo|dbh?|mysqli|conn(?:ection)?)\s*->\s*(?:exec|query)\s*\([^;]*?(?:\$\w|[\"']\s*\.|\bsprintf\b)"),
    ("CMD301", "Request data in a shell command", "HIGH", 78, "php", _php("|".join(PHP_PROGRAMS), "command", "input")),
    ("CMD302", "Request data in back-ticks", "HIGH", 78, "php", rf"`[^`;]*(?:{_PHP_INPUT}|\$\w*{_ending('command', 'input')})[^`]*`"),
    ("LFI301", "Request data in an include", "HIGH", 98, "php", rf"\b(?:include|require)(?:_once)?\b[^;]*?(?:{_PHP_INPUT}|\$\w*{_ending('place')})"),
    ("XSS301", "Request data printed unescaped", "HIGH", 79, "php", rf"(?:\b(?:echo|print)\b|<\?=)[^;]*?(?:{_PHP_INPUT}|\$_SERVER\s*\[\s*[\"']HTTP_)", r"^(?:echo|print|<\?=)[\s(]*(?:html(?:specialchars|entities)|strip_tags|intval|urlencode)\b"),
    ("PATH301", "Request data in a file function", "HIGH", 22, "php", _php("|".join(PHP_FILES), "place")),
    ("SSRF301", "Request to a dynamic address", "HIGH", 918, "php", rf"(?:\bCURLOPT_URL\s*,|\b(?:curl_init|file_get_contents)\s*\()[^;]*?(?:{_PHP_INPUT}|\$\w*{_ending('address')})"),
    ("DSER301", "Request data unserialized", "HIGH", 502, "php", _php("unserialize|igbinary_unserialize|yaml_parse", "input")),
    ("CRY301", "Password hashed with a weak algorithm", "HIGH", 327, "php", r"\b(?:md5|sha1)\s*\(\s*\$\w*(?:pass|pwd|secret)"),
    ("CONF301", "Errors shown to visitors", "MEDIUM", 209, "php", r"\bini_set\s*\(\s*[\"']display_errors[\"']\s*,\s*[\"']?(?:1|on|true)\b|^\s*display_errors\s*=\s*(?:1|on)\b"),
    ("SQL401", "SQL text with interpolation", "HIGH", 89, "ruby", rf"\.\s*(?:where|select|execute|find_by_sql|joins)[\s(]+[\"'][^\n]*?#\{{[^}}\n]*\}}"),
    ("SQL402", "Request parameter orders or groups a query", "HIGH", 89, "ruby", _params(r"\.\s*(?:group|having|(?:re)?order)") + r"\s*\["),
    ("CMD401", "Shell command with interpolation", "HIGH", 78, "ruby", rf"(?:\b(?:exec|system|spawn|popen[23e]*|capture[23e]+){_RUBY_CALL}|`[^`\n]*?)#\{{[^}}\n]*\}}"),
    ("MASS401", "Model filled with unfiltered parameters", "HIGH", 915, "ruby", r"\.\s*(?:assign_attributes|build|create!?|new|update!?)[\s(]+params\s*(?:[,)]|$)"),
    ("XSS401", "Parameter marked as safe HTML", "HIGH", 79, "ruby", r"\bparams\b[^\s;]*\.html_safe\b|\braw[\s(]+params\b"),
    ("PATH401", "Parameter in a file path", "HIGH", 22, "ruby", _params(r"\b(?:File|IO)\s*\.\s*(?:open|read|write|delete)")),
    ("SSRF401", "Request to a parameter's address", "HIGH", 918, "ruby", _params(r"\b(?:URI\s*\.\s*open|HTTParty\s*\.\s*[a-z]+|Net::HTTP\s*\.\s*get(?:_response)?)")),
    ("DSER401", "Request data unmarshalled", "HIGH", 502, "ruby", rf"\bMarshal\s*\.\s*(?:load|restore){_RUBY_CALL}\b(?:body|cookies|params|request)\b"),
    ("CRY401", "Password hashed with a weak algorithm", "HIGH", 327, "ruby", rf"\bDigest::(?:MD5|SHA1)\s*\.\s*(?:base64|hex)?digest{_RUBY_CALL}(?:pass|secret|token)"),
    ("DYN401", "Parameter chooses the method", "HIGH", 470, "ruby", _params(r"\.\s*(?:public_)?send")),
    ("SQL005", "SQL statement built from dynamic text", "HIGH", 89, "go", _call(r"\b(?:db|tx)\s*\.\s*(?:Exec|Prepare|Query(?:Row)?)(?:Context)?", r"\bfmt\s*\.\s*Sprintf\b|\+\s*\w*")),
    ("CMD005", "Shell started with dynamic text", "HIGH", 78, "go", r"\bexec\s*\.\s*Command(?:Context)?\s*\((?:\s*\w+\s*,)?\s*[\"`](?:[\w/]*sh[\"`]\s*,\s*[\"`]-c|cmd(?:\.exe)?[\"`]\s*,\s*[\"`]/c)[\"`]\s*,\s*(?:[A-Za-z_]|[\"`][^\"`\n]*[\"`]\s*\+)[^)\n]*"),
    ("SSRF003", "Request to a dynamic address", "HIGH", 918, "go", r"\bhttp\s*\.\s*(?:Do|Get|Head|Post(?:Form)?)\s*\(\s*(?:fmt\s*\.\s*Sprintf\s*\(|[A-Za-z_]\w*(?:\.\w+(?:\(\s*\))?)?\s*[,)])"),
    ("PATH004", "Request data in a file path", "MEDIUM", 22, "go", r"\bos\s*\.\s*(?:Create|Open(?:File)?|ReadFile|WriteFile|Remove(?:All)?)\s*\([^)\n]*?(?:\b(?:c|ctx|r|req)\s*\.|\w*(?:body|input|param|query))"),
]
#: What every match of a rule holds, in lower case (see ``Rule.holds``).
_HOLDS: dict[str, tuple[str, ...]] = {
    "SQL101": ("query", "execute", "raw", "run"), "CMD101": ("exec",), "CMD102": ("execsync",), "CMD103": ("spawn",), "PRO101": ("__proto__", "prototype", "constructor"), "XSS101": ("innerhtml",), "XSS102": ("write",), "SSRF101": ("fetch", "axios", "http"),
    "DSER101": ("unserialize",), "DSER104": ("yaml",), "CRY101": ("createhash",), "CRY102": ("random",), "PATH101": ("fs",),
    "SQL201": ("execute", "addbatch", "prepare"), "SQL202": ("${",), "CMD201": ("getruntime",), "CMD202": ("processbuilder",), "XXE201": ("factory",), "DSER201": ("objectinputstream", "readobject", "readunshared"), "SSRF201": ("url", "okhttp", "resttemplate"),
    "CRY201": ("messagedigest",), "CRY202": ("random",), "PATH201": ("file",), "CONF201": ("csrf",), "LOG201": ("log",),
    "SQL301": ("_exec", "_query"), "SQL302": ("->",), "CMD301": ("exec", "passthru", "popen", "proc_open", "system"), "CMD302": ("`",), "LFI301": ("include", "require"), "XSS301": ("echo", "print", "<?="),
    "PATH301": ("copy", "file", "fopen", "link", "mkdir", "rename", "rmdir", "scandir", "touch"), "SSRF301": ("curlopt_url", "curl_init", "file_get_contents"), "DSER301": ("unserialize", "yaml_parse"), "CRY301": ("md5", "sha1"), "CONF301": ("display_errors",),
    "SQL401": ("#{",), "SQL402": ("params",), "CMD401": ("#{",), "MASS401": ("params",), "XSS401": ("params",), "PATH401": ("params",), "SSRF401": ("params",), "DSER401": ("marshal",), "CRY401": ("digest",), "DYN401": ("params",),
    "SQL005": ("exec", "prepare", "query"), "CMD005": ("command",), "SSRF003": ("http",), "PATH004": ("create", "open", "readfile", "writefile", "remove"),
}
#: Rules of scripts that need evidence of a tainted flow: fixed values.
_GATED = frozenset(("SQL101", "CMD101", "CMD102", "CMD103", "SSRF101", "XSS101", "XSS102", "PATH101"))
#: Languages whose findings are not reduced to one per line and rule.
REPEATING = ("go",)
#: Language of a file to language of its rules.
FAMILY = {"javascript": "javascript", "typescript": "javascript", "java": "java", "kotlin": "java", "php": "php", "ruby": "ruby", "go": "go"}

_ADVICE = {
    78: ("Text from outside reaches a command interpreter.", "Pass arguments as a list and check them against allowed values."),
    79: ("Text from outside reaches a page without escaping.", "Escape it for its place in the page."),
    89: ("A query is put together from text that may come from outside.", "Bind values as parameters."),
    22: ("A path is put together from text that may come from outside.", "Resolve the path and check that it stays within its folder."),
    918: ("An address that may come from outside is requested.", "Check scheme and host against allowed values."),
    502: ("Data from outside is turned into objects that may run code.", "Use a data-only format such as JSON."),
    327: ("The hash algorithm no longer resists collisions.", "Use SHA-256, or a password hash for passwords."),
    338: ("The generator's output can be predicted.", "Use the platform's secure generator."),
}


def _rule(rule_id: str, name: str, severity: str, cwe: int, language: str, pattern: str, unless: str = "") -> Rule:
    what, how = _ADVICE.get(cwe, ("The construct is known to be exploitable.", "Replace it or switch the protection on."))
    return Rule(rule_id, name, severity, cwe, language, pattern, unless, rule_id in _GATED, what, how, "HIGH", (f"https://cwe.mitre.org/data/definitions/{cwe}.html",), _HOLDS.get(rule_id, ()))


BUILTIN: list[Rule] = [_rule(*r) for r in _CATALOGUE]


def for_language(rules: list[Rule], language: str) -> list[Rule]:
    """Rules of a language, then those of any."""
    return [r for r in rules if r.language == language] + [r for r in rules if r.language == "any"]


def from_folder(folder: str) -> list[Rule]:
    """Rules from *.json and *.yaml files of a folder, in name order: a list, or an object with a ``rules`` list.

    A rule names ``languages`` (one row each) or ``language``, and a ``pattern`` or
    ``pattern: {regex: ...}``. Files and rules that can't be read, or whose pattern doesn't
    compile, are left out.
    """
    out = []
    for path in sorted(Path(folder).glob("*")):
        try:
            if path.suffix == ".json":
                data = json.loads(path.read_text())
            elif path.suffix in (".yaml", ".yml"):
                import yaml

                data = yaml.safe_load(path.read_text())
            else:
                continue
        except (ValueError, ImportError, OSError):
            continue
        except Exception as e:  # the YAML reader's own errors
            if type(e).__module__.split(".")[0] != "yaml":
                raise
            continue
        for x in data.get("rules", []) if isinstance(data, dict) else data if isinstance(data, list) else []:
            out += _own(x)
    return out


def _own(x: dict) -> list[Rule]:
    pattern = x.get("pattern")
    pattern = pattern.get("regex") if isinstance(pattern, dict) else pattern
    try:
        re.compile(FLAGS + re.sub(r"^\(\?[a-z]+\)", "", pattern))
    except (TypeError, re.error):
        return []
    cwe = re.sub(r"\D", "", str(x.get("cwe", ""))) or "0"
    made = {
        "rule_id": str(x.get("id", x.get("rule_id", ""))), "rule_name": str(x.get("name", x.get("rule_name", ""))), "severity": str(x.get("severity", "MEDIUM")).upper(), "cwe": int(cwe),
        "pattern": re.sub(r"^\(\?[a-z]+\)", "", pattern), "unless": str(x.get("unless", "")), "description": str(x.get("description", "")), "fix": str(x.get("fix", "")), "references": tuple(x.get("references", ())),
    }
    return [Rule(language=str(lang), **made) for lang in x.get("languages", [x.get("language", "any")])] if made["rule_id"] else []


def table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a small dimension table."""
    types = {"str": "string", "int": "int", "bool": "boolean", "tuple[str, ...]": "array<string>"}
    schema = ", ".join(f"{f.name} {types[f.type]}" for f in fields(Rule))
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(r).values()) for r in rules], schema)
