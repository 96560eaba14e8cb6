"""Rules that a call's name leaves out would not apply, and a walk over nodes leaves out marks only."""

from __future__ import annotations

import ast
from itertools import product

from scanlode.operators import py_ast

SNIPPETS = "def f(request, *a, k: int = 1, **kw) -> str:\n    x = request.args[k]\n    match x:\n        case {'a': [b, *c], **d} if b.data: return f'{b!r:>{k}}'\n        case P(q=1) | None: pass\n    with open(x) as h, g(**x): del h[x:k]\n    global z\n    z = [await y async for y in x if not -k < y != 2]\n    try: x += yield (lambda v=os.popen(x): v)\n    except (E, e.F) as w: raise w from x\n    type T[U] = list[U]\n@d.e(form)\nclass C(B, m=event): import a.b as c\n"


def test_rules_left_out_by_name_would_not_apply():
    scope = py_ast.Scope(set())
    names = sorted(set().union(*py_ast.NAMES.values(), ("f", "", "path", "getRuntime", "__dict__")))
    for first, last in product(names, names):
        for text in (f"{first or 'f()[0]'}.{last or 'x'}(request.args, shell=True, verify=False, cert_reqs='CERT_NONE')", f"{last or 'f()'}('md5', password)"):
            node = ast.parse(text, mode="eval").body
            if not isinstance(node, ast.Call):
                continue
            c = py_ast.Call(node, py_ast.chain(node.func), scope)
            kept = py_ast.rules_for(c.name[0], c.name[-1]) if c.name else py_ast.rules_for("", "")
            assert not [r[0] for r in py_ast.RULES if r not in kept and r[4](c)], text


def test_nodes_leaves_out_marks_and_aliases_only():
    marks = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop, ast.alias, ast.type_ignore)
    tree = ast.parse(SNIPPETS)
    assert set(py_ast.nodes(tree)) == {n for n in ast.walk(tree) if not isinstance(n, marks)}
    held = {f for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) for f, t in getattr(kind, "_field_types", {}).items() if any(issubclass(x, ast.AST) and not issubclass(x, marks) for x in [t, *getattr(t, "__args__", ())] if isinstance(x, type))}
    assert not held & py_ast.PLAIN, held & py_ast.PLAIN
