"""Online advisories against a local service, and the report for terminals."""

from __future__ import annotations

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scanlode import cli
from scanlode.operators import reports
from scanlode.plans import scan as plan
from scanlode.sources import online

DEPS = "file_path string, ecosystem string, name string, version string, line int"
FULL = {"id": "G-1", "aliases": ["CVE-1"], "summary": "bad", "severity": [{"type": "S", "score": "9.8"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]}


@pytest.fixture
def service():
    state = {"posts": [], "gets": [], "fail": 0, "mode": "ok"}

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            state["posts"].append([(q["package"]["name"], q.get("version")) for q in body["queries"]])
            if state["fail"] > 0:
                state["fail"] -= 1
                self.send_error(state["mode"] if isinstance(state["mode"], int) else 503)
                return
            if state["mode"] == "slow":
                time.sleep(1.5)
            vulns = {"bad": [FULL], "short": [{"id": "G-2"}, {"id": "G-3"}]}
            text = b"{" if state["mode"] == "broken" else json.dumps({"results": [{"vulns": vulns[q["package"]["name"]]} if q["package"]["name"] in vulns else {} for q in body["queries"]]}).encode()
            self._say(text)

        def do_GET(self):
            state["gets"].append(self.path)
            self._say(json.dumps(FULL | {"id": "G-2", "aliases": [], "severity": []}).encode()) if self.path.endswith("G-2") else self.send_error(404)

        def _say(self, text):
            self.send_response(200)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def asked(spark, service, rows, **options):
    deps = spark.createDataFrame(rows, DEPS)
    found, failed = online.vulnerable(deps, online.Service(service["url"], pause=0.01, **options))
    out = sorted((r["file_path"], r["rule_id"], r["severity"], r["snippet"], r["fix"]) for r in found.collect())
    return out, failed


ROWS = [("a", "PyPI", "bad", "1.0", 1), ("b", "PyPI", "bad", "1.0", 2), ("c", "PyPI", "good", "", 1), ("d", "PyPI", "bad", None, 1)]


def test_each_package_is_asked_for_once(spark, service):
    out, failed = asked(spark, service, ROWS, size=2)
    told = ("SCA-CVE-1", "CRITICAL")
    assert failed == 0 and out == [("a", *told, "bad 1.0", "Upgrade to 2.0 or later."), ("b", *told, "bad 1.0", "Upgrade to 2.0 or later."), ("d", *told, "bad", "Upgrade to 2.0 or later.")]
    sent = [p for post in service["posts"] for p in post]
    assert sorted(sent, key=str) == [("bad", "1.0"), ("bad", None), ("good", None)] and all(len(p) <= 2 for p in service["posts"])


def test_texts_of_ids_are_fetched(spark, service):
    out, failed = asked(spark, service, [("a", "npm", "short", "1", 1), ("b", "npm", "short", "2", 1)], details=service["url"] + "/vulns")
    assert sorted(service["gets"]) == ["/vulns/G-2", "/vulns/G-3"] and {x[1] for x in out} == {"SCA-G-2", "SCA-G-3"} and failed == 2
    assert {x[4] for x in out if x[1] == "SCA-G-2"} == {"Upgrade to 2.0 or later."}


@pytest.mark.parametrize("mode, fail, retries, gives", [("ok", 2, 2, True), ("ok", 9, 1, False), (400, 1, 5, False), ("broken", 0, 0, False), ("slow", 0, 0, False)])
def test_what_fails_gives_nothing_and_is_counted(spark, service, mode, fail, retries, gives):
    service |= {"mode": mode, "fail": fail}
    out, failed = asked(spark, service, ROWS[:1], retries=retries, timeout=0.7)
    assert (len(out), failed) == ((1, 0) if gives else (0, 1)) and len(service["posts"]) == (3 if gives else 2 if fail == 9 else 1)


def test_deps_command_online(spark, service, tmp_path, capsys):
    (tmp_path / "requirements.txt").write_text("bad==1.0\n")
    assert cli.main(["deps", str(tmp_path), "--online", service["url"]], spark) == 1 and "SCA-CVE-1" in capsys.readouterr().out
    assert cli.main(["deps", str(tmp_path), "--online", "http://127.0.0.1:9", "--timeout", "0.2"], spark) == 0
    assert "nothing for 1 packages" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["deps", str(tmp_path)], spark)


def test_terminal_report(spark):
    files = [("b.py", "import pickle\npickle.loads(" + "b" * 200 + ")\n"), ("a.py", 'def f(request, c):\n    i = request.args.get("i")\n    c.execute("SELECT " + i)\n')]
    found = plan.scan(spark.createDataFrame(files, "file_path string, content string"))
    lines = list(reports.terminal(found, verbose=True, color=False, width=80))
    heads = [x for x in lines if x.endswith("─")]
    assert [h.split()[0] for h in heads] == ["a.py", "b.py"] and any("flow: " in x for x in lines) and any("fix: " in x for x in lines) and all(len(x) <= 80 for x in lines)
    assert any(x.startswith("HIGH 2") for x in lines) and any("line 3, confidence HIGH" in x for x in lines)
    painted = list(reports.terminal(found, color=True, width=80))
    assert [re.sub("\x1b\\[[0-9;]*m", "", x) for x in painted] == list(reports.terminal(found, color=False, width=80)) and "\x1b[1;91m HIGH " in "\n".join(painted)
    assert list(reports.terminal(found.limit(0), color=False)) == ["", "No findings."]
