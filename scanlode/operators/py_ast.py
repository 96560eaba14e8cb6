"""Syntax-tree and taint analysis of Python files, as one Arrow pass per partition.

A file is a row and is analysed on its own, so nothing is shuffled. One walk over the
tree gives each node to its innermost function and keeps what binds, loops, returns,
tests and calls, outer things before inner ones. Taint is a map from a name to the
labels of where it came from, filled in one pass over a function and all that is
nested in it; what only a nested function's own parameters taint is known in that
function alone. What functions return is found first: after a round over all, only
those that call a name found in the round before are looked at again (five rounds
at most). Rules are entries of a table: a name, a test on a call, and whether the
test's argument must be tainted. Every call is tried once, in its innermost function,
or without taint outside of all; the first finding of a line and rule stays. The work
is linear in a file's nodes.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.operators.findings import ARROW, SCHEMA

#: Where outside data enters and what cleans it: fixed values.
CLEANERS = frozenset(("int", "float", "bool", "quote", "quote_plus", "escape", "literal_eval"))
PARAMETERS = frozenset(("request", "req", "event", "context", "environ", "params", "data", "payload", "body", "form"))
ATTRIBUTES = frozenset(("form", "args", "json", "data", "body", "values", "POST", "GET", "FILES"))
GETTERS = frozenset(("get", "get_json", "get_argument", "get_data"))
CONTAINERS = frozenset(("event", "environ", "params"))
SQL_WORDS = ("select", "insert", "update", "delete", "drop", "create", "alter", "exec", "execute", "merge", "replace", "call")
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "auth", "credential", "ssn", "credit_card", "cvv")
VERBS = frozenset(("get", "post", "put", "patch", "delete", "head", "request"))
RANDOMS = frozenset(("random", "randint", "choice", "choices", "sample", "randrange", "uniform", "getrandbits"))
LOGGERS = frozenset(("debug", "info", "warning", "error", "critical", "exception"))
PATH_TESTS = frozenset(("exists", "isfile", "isdir"))
ROUNDS = 5
#: Nodes that can be an outside source by themselves.
SOURCES = frozenset((ast.Call, ast.Attribute, ast.Subscript))


#: Fields that never hold a node but a text, a number, a mark or an alias.
PLAIN = frozenset(("arg", "attr", "asname", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "names", "op", "ops", "rest", "simple", "tag", "type_comment", "type_ignores"))


@cache
def fields(kind: type) -> tuple[str, ...]:
    """Fields of a kind of node that may hold nodes."""
    return () if kind in (ast.Name, ast.Constant) else tuple(x for x in kind._fields if x not in PLAIN)


def nodes(node: ast.AST) -> list[ast.AST]:
    """A node and all below it, but for marks and aliases."""
    todo = [node]
    for n in todo:  # grows
        for name in fields(type(n)):
            child = getattr(n, name, None)
            if isinstance(child, list):
                todo += [x for x in child if isinstance(x, ast.AST)]
            elif isinstance(child, ast.AST):
                todo.append(child)
    return todo


def chain(node: ast.AST) -> tuple[str, ...]:
    """('os', 'path', 'join') of a dotted name; the attributes alone where it starts at something else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return tuple(reversed(names))


def source_label(node: ast.AST) -> str | None:
    """What outside source an expression is by itself."""
    if type(node) not in SOURCES:
        return None
    if isinstance(node, ast.Call):
        name = chain(node.func)
        if name == ("input",) or name[-1:] == ("getenv",) or (isinstance(node.func, ast.Attribute) and node.func.attr in GETTERS):
            return "call:" + ".".join(name)
    elif isinstance(node, ast.Attribute) and node.attr in ATTRIBUTES:
        return f"attr:{node.attr}"
    elif isinstance(node, ast.Subscript):
        name = chain(node.value)
        if name[-1:] == ("argv",) or (name and (name[-1] in CONTAINERS or name[-1] in ATTRIBUTES)):
            return "subscript:taint_source"
    return None


class Scope:
    """Labels of the tainted names of a function, and behind them those of the functions around it."""

    def __init__(self, returns: set[str], outer: Scope | None = None, function: ast.AST | None = None):
        self.returns, self.outer, self.names = returns, outer, {}
        self.root: Scope = self if outer is None else outer.root
        if function is not None:
            for a in (*function.args.posonlyargs, *function.args.args):
                if a.arg in PARAMETERS:
                    self.names[a.arg] = {f"param:{a.arg}"}

    def get(self, name: str) -> set[str] | None:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.outer
        return None

    def take(self, node: ast.AST) -> None:
        """What a binding or a loop taints."""
        if isinstance(node, (ast.For, ast.AsyncFor)):
            if source_label(node.iter):
                self.root._add([node.target], {"loop:tainted_iter"})
        elif node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            # What the outermost function taints is seen by all in it, whichever binds it.
            for scope in (self.root, self) if self is not self.root else (self,):
                if scope.dirty(node.value):
                    scope._add(targets, scope.labels(node.value))
                    break

    def _add(self, targets: list[ast.expr], labels: set[str]) -> None:
        for t in targets:
            if isinstance(t, ast.Name):
                self.names.setdefault(t.id, set()).update(labels)

    def held(self, node: ast.AST) -> list[str]:
        """Tainted names anywhere in an expression."""
        return [n.id for n in nodes(node) if isinstance(n, ast.Name) and self.get(n.id) is not None]

    def dirty(self, node: ast.AST) -> bool:
        if source_label(node):
            return True
        if isinstance(node, ast.Name):
            return self.get(node.id) is not None
        if isinstance(node, ast.JoinedStr):
            return any(isinstance(v, ast.FormattedValue) and self.dirty(v.value) for v in node.values)
        if isinstance(node, (ast.BinOp, ast.BoolOp)):
            return any(self.get(n.id) is not None if isinstance(n, ast.Name) else source_label(n) for n in nodes(node))
        if isinstance(node, ast.Call):
            callee = chain(node.func)[-1:]
            if callee and callee[0] in CLEANERS:
                return False
            return bool(callee and callee[0] in self.returns) or any(self.dirty(a) for a in node.args)
        return False

    def labels(self, node: ast.AST) -> set[str]:
        out: set[str] = set()
        for n in nodes(node):
            if isinstance(n, ast.Name):
                out.update(self.get(n.id) or ())
            elif s := source_label(n):
                out.add(s)
        if not out and isinstance(node, ast.Call):
            out.add("call:" + ".".join(chain(node.func)))
        return out or {"unknown_source"}

    def dynamic(self, node: ast.AST) -> bool:
        """Text that is not fixed in the source."""
        if isinstance(node, ast.Name):
            return self.get(node.id) is not None
        if isinstance(node, ast.JoinedStr):
            return any(isinstance(v, ast.FormattedValue) for v in node.values)
        if isinstance(node, ast.BinOp):
            return isinstance(node.op, (ast.Add, ast.Mod)) and not (isinstance(node.left, ast.Constant) and isinstance(node.right, ast.Constant))
        return isinstance(node, (ast.Call, ast.Subscript))

    def risky(self, node: ast.AST) -> bool:
        return self.dynamic(node) and (self.dirty(node) or (not isinstance(node, ast.Call) and bool(self.held(node))))


BINDINGS = (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr, ast.For, ast.AsyncFor)


class Function:
    """A function and the one around it; an outermost one keeps, outer things first, what binds, returns and calls in it and all nested in it."""

    def __init__(self, node: ast.AST, outer: Function | None):
        self.node, self.outer = node, outer
        self.root: Function = self if outer is None else outer.root
        self.within = [self] if outer is None else None
        self.root.within.append(self) if outer is not None else None
        self.bindings: list[tuple[Function, ast.AST]] = []
        self.returned: list[tuple[Function, ast.expr]] = []
        self.calls: list[tuple[Function, ast.Call]] = []
        self.scope: Scope | None = None

    def fill(self, returns: set[str]) -> None:
        """Scopes of an outermost function and those in it."""
        for f in self.within:  # outer ones come first
            f.scope = Scope(returns, f.outer.scope if f.outer else None, f.node)
        for owner, node in self.bindings:
            with suppress(RecursionError):
                owner.scope.take(node)

    def returning(self) -> set[Function]:
        """Of an outermost function and those in it the ones that return outside data; a nested return counts for those around it too, but for what its own parameters taint."""
        out: set[Function] = set()
        for owner, value in self.returned:
            if owner in out and self in out:
                continue
            with suppress(RecursionError):
                if self.scope.dirty(value):
                    f: Function | None = owner
                    while f is not None and f not in out:
                        out.add(f)
                        f = f.outer
                    out.add(self)
                elif owner.scope.dirty(value):
                    out.add(owner)
        return out


@dataclass
class Outline:
    """What one walk over a module finds, outer things before inner ones."""

    functions: list[Function]
    calls: list[ast.Call]
    tests: list[ast.If]
    loose: list[ast.Call]

    @property
    def outermost(self) -> list[Function]:
        return [f for f in self.functions if f.outer is None]


#: Nodes that hold no other nodes, but for marks of reading and writing.
LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, ast.Pass, *ast.operator.__subclasses__(), *ast.cmpop.__subclasses__(), *ast.boolop.__subclasses__(), *ast.unaryop.__subclasses__()))


def outline(tree: ast.Module) -> Outline:
    out, todo, at = Outline([], [], [], []), [(tree, None)], 0
    while at < len(todo):
        node, owner = todo[at]
        todo[at] = None
        at += 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            owner = Function(node, owner)
            out.functions.append(owner)
        elif isinstance(node, ast.Call):
            out.calls.append(node)
            if owner is None:
                out.loose.append(node)
            else:
                owner.root.calls.append((owner, node))
        elif isinstance(node, ast.If):
            out.tests.append(node)
        elif owner is not None:
            if isinstance(node, BINDINGS):
                owner.root.bindings.append((owner, node))
            elif isinstance(node, ast.Return) and node.value is not None:
                owner.root.returned.append((owner, node.value))
        for name in fields(type(node)):
            child = getattr(node, name, None)
            if isinstance(child, list):
                todo.extend([(x, owner) for x in child if isinstance(x, ast.AST) and type(x) not in LEAVES])
            elif isinstance(child, ast.AST) and type(child) not in LEAVES:
                todo.append((child, owner))
    return out


def returning(module: Outline) -> set[str]:
    """Names of functions that return outside data; of equal names the last one counts. Scopes of all functions are filled with them."""
    last = {f.node.name: f for f in module.functions}
    callers: dict[str, set[Function]] = {}
    for f in module.outermost:
        for _, call in f.calls:
            for name in chain(call.func)[-1:]:
                if name in last:
                    callers.setdefault(name, set()).add(f)
    out: set[str] = set()
    due = dict.fromkeys(module.outermost)
    for _ in range(ROUNDS):
        known = frozenset(out)
        found = set()
        for f in due:
            f.fill(known)
            found.update(g.node.name for g in f.returning() if last[g.node.name] is g)
        if not found - out:
            break
        due = dict.fromkeys(f for name in found - out for f in callers.get(name, ()))
        out |= found
    else:
        for f in due:
            f.fill(out)
    return out


class Call:
    """A call with its name, its scope and quick ways to its arguments."""

    __slots__ = ("first", "method", "name", "node", "scope")

    def __init__(self, node: ast.Call, name: tuple[str, ...], scope: Scope):
        self.node, self.name, self.scope = node, name, scope
        self.first: ast.expr | None = node.args[0] if node.args else None
        self.method: str = node.func.attr if isinstance(node.func, ast.Attribute) else ""

    def key(self, name: str) -> ast.expr | None:
        return next((k.value for k in self.node.keywords if k.arg == name), None)

    def is_(self, name: str, value: object) -> bool:
        k = self.key(name)
        return isinstance(k, ast.Constant) and k.value is value


def _first_text(node: ast.AST) -> str:
    """Fixed text at the beginning of a dynamic text."""
    if isinstance(node, ast.JoinedStr) and node.values:
        node = node.values[0]
    while isinstance(node, ast.BinOp):
        node = node.left
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""


def _sql(c: Call) -> bool:
    if c.method not in ("execute", "executemany", "executescript", "raw", "query"):
        return False
    text = _first_text(c.first).strip().lower()
    return not text or text.startswith(SQL_WORDS)


def _weak_hash(c: Call) -> bool:
    weak = ("md5", "sha1", "sha")
    if c.name[:1] == ("hashlib",) and c.name[-1] == "new":
        return isinstance(c.first, ast.Constant) and str(c.first.value).lower() in weak
    return (c.name[:1] == ("hashlib",) and c.name[-1] in weak) or (len(c.name) == 1 and c.name[0] in ("md5", "sha1"))


def _unverified(c: Call) -> bool:
    if c.name and c.name[-1] in VERBS and c.is_("verify", False):
        return True
    mode = c.key("cert_reqs")
    return c.name[:1] == ("ssl",) and isinstance(mode, ast.Constant) and mode.value == "CERT_NONE"


def _logs_secret(c: Call) -> bool:
    if not c.name or c.name[-1] not in LOGGERS:
        return False
    names = [n.id for a in c.node.args for n in nodes(a) if isinstance(n, ast.Name)]
    return any(s in n.lower() for n in names for s in SENSITIVE)


def _model_fill(c: Call) -> bool:
    update = c.method == "update" and isinstance(c.node.func.value, ast.Attribute) and c.node.func.value.attr == "__dict__"
    return (update or c.method in ("create", "save")) and any(c.scope.dirty(a) for a in c.node.args)


#: id, name, severity, CWE, test, whether the first argument must be tainted, whether the finding shows its sources.
RULES: tuple[tuple[str, str, str, int, Callable[[Call], bool], bool, bool], ...] = (
    ("SQL001", "SQL statement built from outside text", "HIGH", 89, _sql, True, True),
    ("CMD001", "Shell command from outside text", "HIGH", 78, lambda c: c.name[:1] == ("os",) and c.name[-1] in ("system", "popen", "getoutput", "getstatusoutput"), True, True),
    ("CMD002", "Subprocess with a shell and outside text", "HIGH", 78, lambda c: c.name[:1] == ("subprocess",) and c.is_("shell", True), True, True),
    ("CMD003", "Text run as code", "HIGH", 95, lambda c: c.name in (("eval",), ("exec",), ("compile",)) and c.first is not None and not isinstance(c.first, ast.Constant), False, True),
    ("CRY001", "Weak hash algorithm", "HIGH", 327, _weak_hash, False, False),
    ("CRY002", "Certificates are not verified", "HIGH", 295, _unverified, False, False),
    ("CRY003", "Predictable random numbers", "MEDIUM", 338, lambda c: c.name[:1] == ("random",) and len(c.name) == 2 and c.name[1] in RANDOMS, False, False),
    ("SSRF001", "Request to an address from outside", "HIGH", 918, lambda c: (c.name[:1] in (("requests",), ("httpx",)) and c.name[-1] in VERBS) or c.name[-1:] in (("urlopen",), ("urlretrieve",)), True, True),
    ("DSER001", "Pickled data loaded", "HIGH", 502, lambda c: c.name[:1] in (("pickle",), ("_pickle",), ("cPickle",)) and c.name[-1] in ("load", "loads"), False, False),
    ("DSER002", "Marshalled data loaded", "HIGH", 502, lambda c: c.name[:1] == ("marshal",) and c.name[-1] in ("load", "loads"), False, False),
    ("DSER003", "Shelf opened by a dynamic name", "MEDIUM", 502, lambda c: c.name == ("shelve", "open") and c.first is not None and c.scope.dynamic(c.first), False, False),
    ("DSER004", "YAML loaded without a loader", "HIGH", 502, lambda c: c.name[:1] == ("yaml",) and c.name[-1] in ("load", "load_all") and c.key("Loader") is None, False, False),
    ("PATH001", "File opened by a name from outside", "HIGH", 22, lambda c: c.name == ("open",), True, True),
    ("PATH002", "File sent by a name from outside", "HIGH", 22, lambda c: c.name[-1:] == ("send_file",), True, True),
    ("SSTI001", "Template from outside text", "HIGH", 1336, lambda c: c.name[-1:] == ("render_template_string",) or c.method == "from_string", True, False),
    ("LOG001", "Secret written to a log", "MEDIUM", 532, _logs_secret, False, False),
    ("MASS001", "Model filled with outside data", "MEDIUM", 915, _model_fill, False, False),
    ("MASS002", "Outside data unpacked into arguments", "MEDIUM", 915, lambda c: any(k.arg is None and c.scope.dirty(k.value) for k in c.node.keywords), False, False),
    ("TEMP001", "Temporary name without a file", "MEDIUM", 377, lambda c: c.name in (("tempfile", "mktemp"), ("mktemp",)), False, False),
)
#: Names with which a call begins or ends where a rule can apply; a rule without any is tried on every call.
NAMES: dict[str, frozenset[str]] = {
    "SQL001": frozenset(("execute", "executemany", "executescript", "raw", "query")), "CMD001": frozenset(("os",)), "CMD002": frozenset(("subprocess",)), "CMD003": frozenset(("eval", "exec", "compile")), "CRY001": frozenset(("hashlib", "md5", "sha1")),
    "CRY002": VERBS | {"ssl"}, "CRY003": frozenset(("random",)), "SSRF001": frozenset(("requests", "httpx", "urlopen", "urlretrieve")), "DSER001": frozenset(("pickle", "_pickle", "cPickle")), "DSER002": frozenset(("marshal",)), "DSER003": frozenset(("shelve",)),
    "DSER004": frozenset(("yaml",)), "PATH001": frozenset(("open",)), "PATH002": frozenset(("send_file",)), "SSTI001": frozenset(("render_template_string", "from_string")), "LOG001": LOGGERS, "MASS001": frozenset(("update", "create", "save")), "TEMP001": frozenset(("tempfile", "mktemp")),
}


@lru_cache(1024)
def rules_for(first: str, last: str) -> tuple[tuple, ...]:
    """Rules that can apply to a call whose name begins and ends so."""
    return tuple(r for r in RULES if r[0] not in NAMES or first in NAMES[r[0]] or last in NAMES[r[0]])


RACE = ("RACE001", "File tested and then opened", "MEDIUM", 367)
ADVICE = {"SQL": "Bind values as parameters.", "CMD": "Pass arguments as a list, without a shell.", "CRY": "Use current algorithms and the secrets module.", "DSE": "Use a data-only format.", "PAT": "Resolve the path and check its folder.", "SSR": "Check the address against allowed hosts."}


def _tested_paths(test: ast.AST) -> list[tuple[str, int]]:
    return [(ast.dump(n.args[0]), n.lineno) for n in nodes(test) if isinstance(n, ast.Call) and n.args and chain(n.func)[-2:-1] == ("path",) and chain(n.func)[-1] in PATH_TESTS]


def analyse(path: str, content: str | None) -> list[dict]:
    """Findings of one file; none if it doesn't parse. What is nested too deep to be followed is left out, the rest is reported."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    text, found = (content or "").split("\n"), {}

    def emit(rule: tuple, line: int, confidence: str = "HIGH", evidence: dict | None = None) -> None:
        snippet = text[line - 1].rstrip() if 0 < line <= len(text) else ""
        made = {"rule_id": rule[0], "rule_name": rule[1], "severity": rule[2], "file_path": path, "line_number": line, "snippet": snippet, "description": f"{rule[1]}.", "fix": ADVICE.get(rule[0][:3], "Avoid the construct or check its input."), "language": "python", "confidence": confidence, "evidence": evidence}
        found.setdefault((line, rule[0]), made)

    def judge(rule: tuple, c: Call) -> None:
        rule_id, _, _, _, test, needs, shows = rule
        if needs and c.first is None or not test(c) or needs and not c.scope.risky(c.first):
            return
        sources = sorted(c.scope.labels(c.first)) if shows and c.first is not None and c.scope.dirty(c.first) else []
        proof = {"sink": ".".join(c.name), "sink_rule": None, "taint_sources": sources, "taint_path": f"{', '.join(sources)} -> {'.'.join(c.name)}"} if sources else None
        weaker = rule_id == "CMD003" and not sources
        emit((rule_id, rule[1], "MEDIUM") if weaker else rule, c.node.lineno, "MEDIUM" if weaker else "HIGH", proof)

    def check(node: ast.Call, scope: Scope) -> None:
        name = chain(node.func)
        c = Call(node, name, scope)
        for rule in rules_for(*(name[0], name[-1]) if name else ("", "")):
            try:
                judge(rule, c)
            except RecursionError:
                continue

    module = outline(tree)
    with suppress(RecursionError):
        returning(module)
    for f in module.outermost:
        for owner, node in f.calls:
            check(node, owner.scope)
    bare = Scope(set())
    for node in module.loose:
        check(node, bare)
    tested: dict[str, int] = {}
    for node in module.tests:
        with suppress(RecursionError):
            for dump, line in _tested_paths(node.test):
                tested[dump] = min(line, tested.get(dump, line))
    for node in module.calls if tested else ():
        if node.args and chain(node.func) == ("open",):
            with suppress(RecursionError):
                if tested.get(ast.dump(node.args[0]), node.lineno + 1) <= node.lineno:
                    emit(RACE, node.lineno)
    return list(found.values())


def python_findings(files: DataFrame) -> DataFrame:
    """Findings of the Python files of ``files(file_path, content, language)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in analyse(p, t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.where(F.col("language") == "python").select("file_path", "content").mapInArrow(run, SCHEMA)
