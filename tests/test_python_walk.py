"""The walk over syntax trees visits no leaves, and loses nothing by it."""

from __future__ import annotations

import ast

from scanlode.operators import py_ast

CODE = "import os\ndef f(request, *, k=1):\n    x = request.args\n    if os.path.exists(x) and not -k < 2:\n        return open(x + 'a')\n    for y in sorted(x): eval(y)\n    with open(x) as h, g(**x) as i:\n        i[h] = [os.system(z) for z in x if z]\n    return lambda q=os.popen(x): q\n"


def test_leaves_hold_no_nodes_but_marks():
    for kind in py_ast.LEAVES:
        assert not [f for f in kind._fields if f not in ("ctx", "id", "value", "kind", "name", "asname")]


def test_the_walk_keeps_what_the_whole_tree_holds(monkeypatch):
    visited = []
    monkeypatch.setattr(py_ast, "isinstance", lambda node, kind: (visited.append(node) if isinstance(kind, tuple) and ast.FunctionDef in kind else None) or isinstance(node, kind), raising=False)
    tree = ast.parse(CODE)
    module = py_ast.outline(tree)
    assert visited and not [n for n in visited if isinstance(n, (ast.Name, ast.Constant, ast.Load, ast.Store))]
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    assert module.calls == calls and module.tests == [n for n in ast.walk(tree) if isinstance(n, ast.If)]
    assert [(x["line_number"], x["rule_id"]) for x in sorted(py_ast.analyse("a.py", CODE), key=lambda x: (x["line_number"], x["rule_id"]))]
