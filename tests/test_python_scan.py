"""The Python analyser: positive and negative cases of every rule."""

from __future__ import annotations

import time

import pytest

from scanlode.operators.py_ast import analyse

CASES = [
    ('def f(request, c):\n    i = request.args.get("i")\n    c.execute("SELECT " + i)', {"SQL001"}),
    ('def f(request, c):\n    i = request.args.get("i")\n    c.execute(f"SELECT {i}")', {"SQL001"}),
    ('def f(request, c):\n    i = int(request.args.get("i"))\n    c.execute("SELECT %s" % i)', set()),
    ('def f(c, n):\n    c.execute("SELECT " + n)', set()),
    ('def f(request, c):\n    c.execute("hello " + request.data)', set()),
    ('import os\ndef f(request):\n    os.system("ls " + request.form["d"])', {"CMD001"}),
    ('import os\nos.system("ls")', set()),
    ('import subprocess\ndef f(data):\n    subprocess.run(data, shell=True)', {"CMD002"}),
    ('import subprocess\ndef f(data):\n    subprocess.run(data, shell=False)', set()),
    ("eval(x)", {"CMD003"}),
    ("eval('1')", set()),
    ("import hashlib\nhashlib.new('MD5')", {"CRY001"}),
    ("import hashlib\nhashlib.sha256(b'')", set()),
    ("import requests\nrequests.get('https://x', verify=False)", {"CRY002"}),
    ("import random\nrandom.choice([1])", {"CRY003"}),
    ("import secrets\nsecrets.choice([1])", set()),
    ("import urllib.request\ndef f(request):\n    u = request.GET['u']\n    urllib.request.urlopen(u)", {"SSRF001"}),
    ("import pickle\npickle.load(f)", {"DSER001"}),
    ("import marshal\nmarshal.loads(b)", {"DSER002"}),
    ("import shelve\nshelve.open(name())", {"DSER003"}),
    ("import yaml\nyaml.load(f)", {"DSER004"}),
    ("import yaml\nyaml.load(f, Loader=yaml.SafeLoader)", set()),
    ("def f(request):\n    n = request.args['n']\n    open(n)", {"PATH001"}),
    ("def f(request):\n    n = request.args['n']\n    send_file(n)", {"PATH002"}),
    ("def f(request):\n    t = request.form['t']\n    render_template_string(t)", {"SSTI001"}),
    ("import logging\nlogging.info('x %s', password)", {"LOG001"}),
    ("import logging\nlogging.info('password')", set()),
    ("def f(request):\n    User.create(request.json)", {"MASS001"}),
    ("def f(data):\n    User(**data)", {"MASS002"}),
    ("import os\nif os.path.exists(p):\n    open(p)", {"RACE001"}),
    ("import os\nopen(p)\nif os.path.exists(p):\n    pass", set()),
    ("import tempfile\ntempfile.mktemp()", {"TEMP001"}),
    ("def a(request):\n    return request.args.get('x')\ndef b(c):\n    v = a(1)\n    c.execute('SELECT ' + v)", {"SQL001"}),
    ("def f(:", set()),
    ("", set()),
]


@pytest.mark.parametrize("code, want", CASES)
def test_rule(code, want):
    assert {r["rule_id"] for r in analyse("a.py", code)} == want


def test_evidence_and_null():
    (r,) = analyse("a.py", 'def f(request, c):\n    i = request.args.get("i")\n    c.execute("SELECT " + i)')
    assert r["line_number"] == 3 and "param:request" in r["evidence"]["taint_sources"] and r["evidence"]["sink"] == "c.execute"
    assert analyse("a.py", None) == []


@pytest.mark.parametrize(
    "deep",
    ["open(" + "+".join(["a"] * 3000) + ")", "x" + ".f()" * 1500, "f(" * 80 + "x" + ")" * 80, "if os.path.exists(" + "+".join(["a"] * 3000) + "):\n    open(" + "+".join(["a"] * 3000) + ")", "def f(request):\n    return " + "+".join(["a"] * 3000), "x = " + "[" * 90 + "1" + "]" * 90],
)
def test_deep_code_keeps_the_other_findings(deep):
    assert {r["rule_id"] for r in analyse("a.py", f"import os, pickle\npickle.loads(b)\n{deep}\n")} >= {"DSER001"}


def test_code_too_deep_to_parse():
    assert analyse("a.py", "open(" + "+".join(["a"] * 100_000) + ")") == [] and analyse("a.py", "(" * 5000) == []


@pytest.mark.parametrize(
    "code",
    [
        "def f(x):\n" + "".join(f"    return {i}\n" for i in range(20_000)),
        "".join(" " * i + f"def g{i}(request):\n" for i in range(90)) + "".join(" " * 90 + f"x{k} = h{k % 50}(request, x{k - 1})\n" for k in range(4_000)),
        "".join(" " * i + f"def g{i}(request):\n" for i in range(90)) + "".join(" " * 90 + f"os.system(a + b{k})\n" for k in range(4_500)),
        "".join(f"def f{i}(data):\n    return f{i + 1}(data)\n" for i in range(9_000)),
        "import os\n" + "".join(f"os.system('x' + y{k})\n" for k in range(18_000)),
    ],
)
def test_large_files_take_linear_time(code):
    began = time.time()
    analyse("a.py", code)
    assert time.time() - began < 15


def lines_of(code):
    return sorted((r["line_number"], r["rule_id"]) for r in analyse("a.py", code))


def test_taint_reaches_nested_functions_and_back():
    assert lines_of("def f(request):\n    p = request.args['p']\n    def g():\n        open(p)\n") == [(4, "PATH001")]
    assert lines_of("def f():\n    def g(data):\n        x = data\n        open(x)\n    open(x)\n") == [(4, "PATH001")]
    assert lines_of("def f(request):\n    def g():\n        nonlocal q\n        q = request.args['p']\n    open(q)\n") == [(5, "PATH001")]
    assert lines_of("class A:\n    def f(self, request):\n        open(request)\n    def g(self):\n        open(request)\n") == [(3, "PATH001")]


def test_what_functions_return_is_followed_for_five_calls():
    hops = "def f0(request):\n    return request.args.get('x')\n" + "".join(f"def f{i + 1}():\n    return f{i}()\n" for i in range(8))
    use = lambda k: lines_of(hops + f"def z(c):\n    v = f{k}()\n    c.execute('select ' + v)\n")
    assert use(4) == [(21, "SQL001")] and use(5) == []
    nested = "def outer():\n    def inner(request):\n        return request.args.get('x')\n    return inner\ndef z(c):\n    v = outer()\n    c.execute('select ' + v)\n"
    assert lines_of(nested) == [(7, "SQL001")]
    assert lines_of("def a(request):\n    return request.json\ndef a():\n    return 1\ndef z(c):\n    v = a()\n    c.execute('select ' + v)\n") == []


def test_race_over_functions():
    assert lines_of("import os\ndef a():\n    if os.path.isfile(p):\n        pass\ndef b():\n    open(p)\n") == [(6, "RACE001")]
