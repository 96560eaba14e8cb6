"""Native detectors against labelled code and against Python's own matcher."""

from __future__ import annotations

import datetime
import random
import re

import pytest

from scanlode.functions import columns as C
from scanlode.functions import rules as R
from scanlode.operators import findings as fd
from scanlode.operators import js_flow, line_scan, regex_scan, secrets
from scanlode.plans import scan as plan
from scanlode.sources import corpus

TODAY = datetime.date(2025, 1, 1)


def found(spark, *files, options=None):
    rows = plan.scan(spark.createDataFrame(list(files), "file_path string, content string"), options or plan.Options(today=TODAY)).collect()
    return {(r["file_path"], r["line_number"], r["rule_id"]) for r in rows}


@pytest.fixture(scope="module")
def templates(spark):
    files = spark.createDataFrame([(f"src/{n}/f7{e}", c.replace("@K@", "7")) for n, e, _, c in corpus.TEMPLATES], "file_path string, content string")
    rows = plan.scan(files, plan.Options(today=TODAY)).collect()
    out = {}
    for r in rows:
        out.setdefault(r["file_path"].split("/")[1], set()).add(r["rule_id"])
    return out


@pytest.mark.parametrize("name, ext, expected, code", corpus.TEMPLATES, ids=[t[0] for t in corpus.TEMPLATES])
def test_template(templates, name, ext, expected, code):
    got = templates.get(name, set())
    if expected is None:
        assert got <= {"SEC013"} if ext in (".json", ".md") else not got
    else:
        assert expected in got


def test_every_rule_has_a_template():
    assert {r.rule_id for r in R.BUILTIN} <= {t[2] for t in corpus.TEMPLATES}


#: Code on which a rule must be silent or speak: path, rule, whether it speaks, code.
CASES = [
    ("a.js", "SQL101", True, "const q = req.query.q;\nconn.execute(\n  `SELECT ${q}`);"), ("a.js", "SQL101", True, "const q = req.query.q;\ndb.query('SELECT f(x) WHERE a=' + q);"), ("a.js", "SQL101", False, "const q = req.query.q;\ndb.query('a + b', [q]);"),
    ("a.js", "CMD101", False, "const c = req.body.c;\nconst s = encodeURIComponent(c);\nexec(s);"), ("a.js", "CMD101", True, "const c = req.body.c;\nexec(c);"), ("a.js", "CMD101", False, "myexec(req.body);"),
    ("a.js", "CMD103", True, "const t: string = req.query.t\nspawn('a' + t, [])"), ("a.js", "CMD103", False, "const t = req.query.t;\nspawn('ls', [t])"),
    ("a.js", "XSS101", False, "const n = req.query.n;\nconst s = DOMPurify.sanitize(n);\nelem.innerHTML = s;"), ("a.js", "XSS101", False, "if (a.innerHTML == req.query.x) {}"),
    ("a.js", "SSRF101", True, "const u = req.query.url;\nfetch(u);"), ("a.js", "SSRF101", False, "const u = 'https://example.com/ping';\nfetch(u);"), ("a.js", "SSRF101", True, "axios.get('http://' + req.query.h)"),
    ("a.js", "PRO101", False, "x.constructor(a)"), ("a.js", "PRO101", True, "o.constructor['prototype']"), ("a.js", "DSER101", True, "require('node-serialize').unserialize(x)"), ("a.js", "DSER104", False, "yaml.load(x, { schema: s })"), ("a.js", "DSER104", True, "yaml.load(fs.readFileSync(f))"),
    ("a.js", "CRY101", False, "createHash('sha256')"), ("a.js", "PATH101", False, "fs.readFile('/etc/x', done)"),
    ("A.java", "SQL201", True, 'stmt.executeQuery(sql + " AND active=1");'), ("A.java", "SQL201", False, 'conn.prepareStatement("SELECT a + b FROM t WHERE id = ?");'), ("A.java", "SQL201", True, 'st.executeUpdate(String.format("DELETE %s", t));'),
    ("A.java", "CMD201", True, 'Runtime.getRuntime().exec(cmd + " -c 4");'), ("A.java", "CMD201", False, 'Runtime.getRuntime().exec("ls");'), ("A.java", "CMD202", False, 'new ProcessBuilder("ls");'),
    ("A.java", "SSRF201", False, 'new URL("https://example.com").openConnection();'), ("A.java", "CRY201", False, 'MessageDigest.getInstance("SHA-256")'), ("A.java", "CRY202", False, "new SecureRandom(); new java.security.SecureRandom();"), ("A.java", "CONF201", True, "http.csrf().disable()\n    .authorizeRequests()"),
    ("A.kt", "CONF201", True, "http.csrf(AbstractHttpConfigurer::disable)"), ("A.java", "DSER201", True, "Object o = ois.readObject();"), ("A.java", "LOG201", False, 'logger.info("started");'), ("A.java", "PATH201", False, 'new File("a.txt");'), ("A.java", "SQL202", False, 'String s = "from" + x;'),
    ("a.php", "SQL301", True, "<?php $r = mysql_query('SELECT f(a) WHERE id=' . $_GET['id']); ?>"), ("a.php", "SQL301", False, "<?php mysql_query('SELECT 1'); $x = $_GET['id'];"), ("a.php", "SQL302", False, "<?php $pdo->query('SELECT 1');"),
    ("a.php", "CMD301", False, "<?php curl_exec($_GET['x']);"), ("a.php", "CMD301", True, "<?php exec('ping ' . $_POST['host']); ?>"), ("a.php", "CMD302", True, "<?php $out = `ls {$_GET['dir']}`; ?>"), ("a.php", "CMD302", False, "<?php $out = `ls`; $x = $_GET['d'];"),
    ("a.php", "LFI301", True, "<?php include($_GET['page'] . '.php'); ?>"), ("a.php", "LFI301", False, "<?php include 'a.php'; $p = $_GET['page'];"), ("a.php", "XSS301", False, "<?php echo htmlspecialchars($_GET['name'], ENT_QUOTES, 'UTF-8'); ?>"), ("a.php", "XSS301", True, "<?= $_GET['name'] ?>"),
    ("a.php", "PATH301", True, "<?php $c = file_get_contents($_GET['file']); ?>"), ("a.php", "SSRF301", True, "<?php curl_setopt($c, CURLOPT_URL, $_GET['u']);"), ("a.php", "DSER301", False, "<?php unserialize('a:0:{}');"), ("a.php", "CRY301", False, "<?php md5($body);"), ("a.php", "CRY301", True, "<?php sha1($user_password);"), ("a.php", "CONF301", False, "<?php ini_set('display_errors', '0');"),
    ("a.rb", "SQL401", True, "User.where(\"name = '#{params[:name]}'\")"), ("a.rb", "SQL401", False, "User.where(name: params[:name])"), ("a.rb", "SQL402", False, "User.order(:name)"), ("a.rb", "SQL402", True, "User.reorder params[:s]"), ("a.rb", "CMD401", True, "output = `ls #{params[:dir]}`"), ("a.rb", "CMD401", False, "system('ls')"),
    ("a.rb", "MASS401", False, "User.create(params.require(:user))"), ("a.rb", "MASS401", True, "user.update params\n"), ("a.rb", "XSS401", False, "h(params[:q])"), ("a.rb", "PATH401", False, "File.read('a')"), ("a.rb", "DSER401", True, "data = Marshal.load(request.body.read)"), ("a.rb", "DSER401", False, "Marshal.load(cached)"),
    ("a.rb", "CRY401", False, "Digest::SHA256.hexdigest(password)"), ("a.rb", "DYN401", True, "user.send(params[:method])"), ("a.rb", "DYN401", False, "user.send(:name)"), ("a.rb", "SSRF401", False, "URI.open('https://a')"),
    ("a.go", "SQL005", False, 'db.Query("SELECT a + b FROM t WHERE id = $1", id)'), ("a.go", "CMD005", False, 'exec.Command("ls", "-l")'), ("a.go", "CMD005", True, 'exec.CommandContext(ctx, "/bin/bash", "-c", "ls " + dir)'), ("a.go", "SSRF003", False, 'http.Get("https://a")'), ("a.go", "PATH004", False, 'os.Open("a.txt")'), ("a.go", "PATH004", True, "os.Remove(filepath.Join(dir, req.Name))"),
    ("a.sh", "SH001", False, "evaluate $x"), ("a.sh", "SH001", False, "eval 'ls'"), ("a.sh", "SH002", False, "x=`ls`"), ("a.sh", "SH002", True, "x=`ls ${D}`"), ("a.sh", "SH003", False, "x=$((1+$y))"), ("a.sh", "SH003", True, 'x=$(cat "$f")'), ("a.sh", "SH004", False, 'curl "$URL"'), ("a.sh", "SH004", True, "curl -s -L $URL"), ("a.sh", "SH004", False, "fish $X"),
    ("a.env", "CFG001", False, "DB_PASSWORD=your_password"), ("a.env", "CFG001", True, "export DB_PASSWORD=SuperSecret123"), ("a.env", "CFG001", False, "TOKENIZER=wordpiece"), ("a.ini", "CFG001", False, "; password = abcdefgh"), ("a.ini", "CFG001", False, "password = abc"), ("a.yaml", "CFG003", True, "client_secret: SuperSecretABC123"), ("a.yaml", "CFG003", False, "client_secret: your_secret"), ("a.yaml", "CFG003", False, "max_tokens: 4096"),
    ("a.json", "CFG002", True, '{"api_key": "prod_live_secret_12345"}'), ("a.json", "CFG002", False, '{"api_key": "example"}'), ("a.py", "SEC002", False, 'token = "YOUR_GITHUB_TOKEN"'), ("a.js", "SEC013", False, "const api_key = process.env.API_KEY;"),
]


def test_where_rules_speak_and_where_they_are_silent(spark):
    got = {}
    for path, _, rule in found(spark, *((f"{i}/{p}", code) for i, (p, _, _, code) in enumerate(CASES))):
        got.setdefault(int(path.split("/")[0]), set()).add(rule)
    assert [c for i, c in enumerate(CASES) if (c[1] in got.get(i, ())) is not c[2]] == []


#: Openings that patterns begin with, repeated without what ends them.
OPENINGS = ("db.query(", "exec(a+", "fetch(x.", "fs.readFile(", "echo $", "mysql_query(", "`$(", "#{`", "db.Query(", 'exec.Command("sh", "-c", ', "require ", "import a, ", "x = ", "password = '", "eyJhbGciOiJI.", "a://b:", "(", "\"", "`", "SELECT ", "new URL(", "log.info(")


@pytest.mark.parametrize("ext", [".js", ".java", ".php", ".rb", ".go", ".sh", ".env", ".yaml", ".json", ".py"])
def test_long_inputs_neither_crash_nor_stall(spark, ext):
    assert found(spark, *((f"{i}{ext}", opening * (20_000 // len(opening))) for i, opening in enumerate(OPENINGS))) is not None


def test_matches_equal_the_finder_of_python(spark):
    rng = random.Random(5)
    rows = [(f"f{i}.js", "".join(rng.choice(["Math.random()", "\n", " ", "x", "Math.random(\n)", ".createHash('md5')", "é"]) for _ in range(40)), "javascript") for i in range(60)]
    got = {(r["file_path"], r["rule_id"], r["at"], r["line_number"], r["text"]) for r in regex_scan.matches(spark.createDataFrame(rows, "file_path string, content string, language string")).collect()}
    want = set()
    for path, text, _ in rows:
        for rule in R.for_language(R.BUILTIN, "javascript"):
            for i, m in enumerate(re.finditer(R.FLAGS + rule.pattern, text)):
                want.add((path, rule.rule_id, i, 1 + text.count("\n", 0, m.start()), m[0]))
    assert got == want


def test_flow_gate_needs_request_data_and_respects_cleaning(spark):
    files = [
        ("a.js", "const a = req.query.a;\nconst b = a;\nexec(b, f);\n", "javascript"),
        ("b.js", "const a = 'fixed';\nexec(a, f);\n", "javascript"),
        ("c.js", "const a = escapeHtml(req.query.a);\nexec(a, f);\n", "javascript"),
        ("d.js", "exec(req.body, f);\n", "javascript"),
    ]
    rows = js_flow.gated(spark.createDataFrame(files, "file_path string, content string, language string")).where("rule_id = 'CMD101'").collect()
    assert {(r["file_path"], tuple(r["evidence"]["taint_sources"])) for r in rows} == {("a.js", ("b",))}


def test_one_shell_finding_a_line_by_priority(spark):
    rows = [("a.sh", 'eval "$X" `ls $1`\n# eval "$X"\nout=$(ls $X)\n', "bash")]
    got = [(r["line_number"], r["rule_id"]) for r in line_scan.shell(spark.createDataFrame(rows, "file_path string, content string, language string")).collect()]
    assert sorted(got) == [(1, "SH001"), (3, "SH003")]


def test_json_depth_line_and_mask(spark):
    deep = '{"a":' * 12 + '{"token": "abcdefgh"}' + "}" * 12
    rows = [("a.json", '{\n "x": [\n  {"Api_Key": "abcdef123"}]}', "json"), ("b.json", deep, "json"), ("c.json", "", "json"), ("d.json", None, "json"), ("e.json", "[1, 2", "json")]
    got = line_scan.config_json(spark.createDataFrame(rows, "file_path string, content string, language string")).collect()
    assert [(r["file_path"], r["line_number"], r["snippet"]) for r in got] == [("a.json", 3, '"Api_Key": "********..."')]


def test_entropy_stands_back_for_known_forms(spark):
    rows = [("a.py", 'T = "ghp_Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0UvWx"\nS = "q8Zr2Lx9Wv4Kt7Yp1Nb6Hc3Jd5Mf0Gs"\nE = "aaaaaaaaaaaaaaaaaaaaaaaa1"\n', "python")]
    got = [(r["line_number"], r["rule_id"]) for r in secrets.secrets(spark.createDataFrame(rows, "file_path string, content string, language string")).collect()]
    assert sorted(got) == [(1, "SEC002"), (2, "SEC014")]


@pytest.mark.parametrize(
    "line, rule, enforce, want",
    [
        ("x // scanlode: ignore", "A1", False, True),
        ("x", "A1", False, False),
        ("x // scanlode: ignore[A1, B2]", "B2", False, True),
        ("x // scanlode: ignore[A1]", "B2", False, False),
        ("x // scanlode: ignore until=2024-01-01", "A1", False, False),
        ("x // scanlode: ignore until=2025-01-01", "A1", False, True),
        ("x // scanlode: ignore until=2025-13-45", "A1", False, False),
        ("x // scanlode: ignore", "A1", True, False),
        ("x // scanlode: ignore reason=old until=2099-01-01", "A1", True, True),
        ("x // scanlode: ignore reason= until=2099-01-01", "A1", True, True),
    ],
)
def test_suppression(spark, line, rule, enforce, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(fd.suppressed(F.lit(line), F.lit(rule), TODAY, enforce)).first()[0] is want


def test_policy_thresholds():
    assert fd.thresholds() == ("LOW", "LOW")
    assert fd.thresholds("strict") == ("MEDIUM", "MEDIUM")
    assert fd.thresholds("strict", "HIGH", "LOW") == ("HIGH", "MEDIUM")


def test_empty_files_and_nulls(spark):
    assert found(spark, ("a.js", ""), ("b.py", None), ("c.unknown", "eval"), (None, "x")) == set()


@pytest.mark.parametrize("glob, path, want", [("tests/**", "tests/a/b.py", True), ("tests/**", "src/tests/a.py", False), ("*.min.js", "a/b/x.min.js", True), ("a/*/c.py", "a/b/c.py", True), ("a/*/c.py", "a/b/d/c.py", False), ("**/gen/*.go", "gen/x.go", True)])
def test_globs(glob, path, want):
    assert bool(re.search(C.glob_regex(glob), path)) is want


def test_own_rules_from_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rules": [{"id": "OWN1", "name": "n", "severity": "low", "languages": ["ruby", "go"], "pattern": {"regex": "(?ix)dangerous"}}, {"id": "BAD", "pattern": "("}]}')
    (tmp_path / "b.json").write_text("{")
    own = R.from_folder(str(tmp_path))
    assert [(r.rule_id, r.language, r.severity) for r in own] == [("OWN1", "ruby", "LOW"), ("OWN1", "go", "LOW")]
    assert R.table(spark, own).count() == 2
    assert ("x.go", 1, "OWN1") in found(spark, ("x.go", "dangerous"), options=plan.Options(today=TODAY, rules=own))


ENDING_CASES = [
    ("php", "<?php mysqli_query($db, $userPayload);\n", {"SQL301"}),
    ("php", "<?php pg_query($db, $searchArgs);\n", {"SQL301"}),
    ("php", "<?php pg_query($db, $fixed);\n", set()),
    ("php", "<?php passthru($nextCommand);\n", {"CMD301"}),
    ("php", "<?php include $oldTemplate;\n", {"LFI301"}),
    ("php", "<?php scandir($uploadFolders);\n", {"PATH301"}),
    ("php", "<?php curl_init($targetHost);\n", {"SSRF301"}),
    ("php", "<?php curl_init($handle);\n", set()),
    ("php", "<?php unserialize($rawBody);\n", {"DSER301"}),
    ("java", "Runtime.getRuntime().exec(buildScript);\n", {"CMD201"}),
    ("java", "new File(exportFolder);\n", {"PATH201"}),
    ("java", "logger.severe(rawQuery);\n", {"LOG201"}),
    ("java", "logger.severe(message);\n", set()),
]


def test_names_of_one_vocabulary_in_all_languages(spark):
    rows = [(f"f{i}.{ext}", code) for i, (ext, code, _) in enumerate(ENDING_CASES)]
    found = plan.scan(spark.createDataFrame(rows, "file_path string, content string")).collect()
    got = {p: {r["rule_id"] for r in found if r["file_path"] == p} for p, _ in rows}
    assert got == {f"f{i}.{ext}": want for i, (ext, _, want) in enumerate(ENDING_CASES)}
