"""Small repositories with the findings they must or must not give."""

import ast

from pyspark.sql import functions as F

from riskloom.operators import context as C
from riskloom.operators import detect as D
from riskloom.operators import findings as R
from riskloom.operators import packages as PK
from riskloom.operators import plugins as PL
from riskloom.operators import pyfacts
from riskloom.plans import scan as S


def found(files, tree, keys=None):
    rows = D.candidates(files(tree), keys).collect()
    return sorted((r.category, r.path, r.line_number, r.severity, r.status) for r in rows)


def result(files, tree, **kw):
    return [r.asDict(recursive=True) for r in S.scan(files(tree), **kw).collect()]


FIXTURE = {
    "vuln_sql.py": 'import sqlite3\n\ndef get_user(username: str):\n    conn = sqlite3.connect("db")\n    cursor = conn.cursor()\n'
    "    cursor.execute(f\"SELECT * FROM users WHERE username = '{username}'\")\n    return cursor.fetchone()\n",
    "vuln_auth.py": 'from fastapi import FastAPI\napp = FastAPI()\n\n@app.get("/api/admin/users")\ndef list_all(): return []\n\n'
    '@app.delete("/api/admin/user/{id}")\ndef drop(id: int): pass\n\n@app.get("/api/public/info")\ndef info(): return {}\n',
    "vuln_cors.py": "from fastapi.middleware.cors import CORSMiddleware\n\napp.add_middleware(\n    CORSMiddleware,\n    allow_origins=[\"*\"],\n"
    "    allow_credentials=True,\n    allow_methods=[\"*\"],\n)\n",
    "package.json": '{\n  "dependencies": {\n    "react": "^18.0.0",\n    "next": "^15.0.0",\n    "react-auth-superhelper-lib": "^1.0.0"\n  }\n}\n',
    "supabase_migration.sql": "CREATE TABLE users (id UUID PRIMARY KEY);\nCREATE TABLE payments (id UUID PRIMARY KEY);\n",
}


def test_fixture_repository(files):
    rows = result(files, FIXTURE)
    got = sorted((r["category"], r["severity"], r["status"], r["line_number"], round(r["confidence"], 4)) for r in rows)
    assert got == [
        ("cors_wildcard_credentials", "critical", "candidate", 3, 0.92),
        ("missing_auth", "critical", "candidate", 5, 0.866),
        ("missing_auth", "critical", "candidate", 8, 0.866),
        ("rls_disabled", "high", "candidate", 1, 0.86),
        ("rls_disabled", "high", "candidate", 2, 0.86),
        ("sql_injection", "critical", "confirmed", 6, 0.896),
    ]
    sql = next(r for r in rows if r["category"] == "sql_injection")
    assert sql["cvss_score"] == 9.3 and "vuln_sql.py:6" in sql["attack_chain"]
    score = S.repository_scores(S.scan(files(FIXTURE))).collect()[0]
    assert (score.risk_score, score.verdict, score.n_findings) == (74, "CRITICAL", 6)


def test_fixture_packages(files):
    rows = PK.extract_packages(files(FIXTURE)).collect()
    assert sorted((r.package, r.line_number) for r in rows) == [("next", 4), ("react", 3), ("react-auth-superhelper-lib", 5)]


def test_package_verdict_becomes_a_finding(spark, files):
    verdicts = spark.createDataFrame(
        [("npm", "react-auth-superhelper-lib", "not_found", 0.98, "unknown"), ("npm", "react", "ok", 0.9, "")],
        "registry string, package string, verdict string, confidence double, reason string",
    )
    rows = PK.audit_findings(PK.extract_packages(files(FIXTURE)), verdicts).collect()
    assert [(r.category, r.status, r.severity, r.line_number) for r in rows] == [("slopsquatting", "confirmed", "critical", 5)]


def test_clean_repository_scores_nothing(files):
    assert result(files, {"main.py": "def add(a, b):\n    return a + b\n"}) == []


QUIET = [
        ("db.py", 'cursor.execute("SELECT * FROM t WHERE id = ?", (uid,))\n'),
        ("log.py", 'logger.info("started")\nlogger.info("record saved")\n'),
        ("a.js", "fs.readFile(path.join(base, req.query.file), cb)\n"),
        ("b.js", 'db.query("SELECT * FROM t WHERE id = $1", [id])\n'),
        ("safe.py", 'KEY = os.environ.get("OPENAI_API_KEY")\n'),
        ("keys.py", 'API_KEY = "your-openai-api-key-here"\nSECRET = "replace-me"\nTOKEN = "changeme"\n'),
        ("schema.sql", "CREATE TABLE a (id INT);\nCREATE TABLE b (id INT);\n"),
        (".env", "API_HOST=http://localhost:3000\nAPI_PORT=8080\nDEBUG=true\nFEATURE_LOGIN_V2=false\n"),
        ("app.py", "from fastapi import Depends\n@app.get(\"/api/admin/users\")\ndef list_users(current_user=Depends(get_current_user)): pass\n"),
        ("limits.py", 'from slowapi import Limiter\n@limiter.limit("5/minute")\n@app.post("/api/auth/login")\ndef login(): pass\n'),
        ("vendor/unsafe.ts", "router.post('/login', handler)\n"),
        ("generated/agent.py", "prompt = request.body\nresponse = client.responses.create(input=prompt)\n"),
    ]


def test_no_findings(files):
    """One repository per case, so that one scan covers them all."""
    tree = {f"case{i}": {path: text} for i, (path, text) in enumerate(QUIET)}
    rows = D.candidates(files(tree)).collect()
    # a limited route may still lack authentication
    rows = [r for r in rows if not (r.path == "limits.py" and r.category == "missing_auth")]
    assert [(r.path, r.category) for r in rows] == []


LOUD = [
        ("a.js", "exec(`ls ${dir}`)\n", ("command_injection", "critical", "candidate")),
        ("a.ts", "fs.readFile(req.query.file, cb)\n", ("path_traversal", "high", "candidate")),
        ("a.js", "db.query(`SELECT * FROM t WHERE id = ${id}`)\n", ("sql_injection", "critical", "candidate")),
        ("a.py", "logger.info(f\"user {request.body['username']}\")\n", ("log_injection", "high", "needs_review")),
        (".env.production", "JWT_SECRET=supersecretvalue\n", ("committed_env_file", "critical", "candidate")),
        (".env", "OPENAI_API_KEY=sk-proj-test\n", ("committed_env_file", "critical", "candidate")),
        ("k.py", 'KEY = "sk-proj-abcdefgh12345678"\n', ("hardcoded_secret", "critical", "candidate")),
        ("a.js", "jwt.sign(p, 'abc')\n", ("weak_jwt", "high", "candidate")),
        ("l.py", '@app.post("/api/auth/login")\ndef login(): pass\n', ("missing_rate_limit", "medium", "needs_review")),
        ("firestore.rules", "allow read: if true;\n", ("firebase_public", "high", "candidate")),
        ("mcp.json", '{"mcpServers": {\n"x": {"command": "npx"}}}\n', ("mcp_untrusted_server", "high", "candidate")),
        ("app/api/admin/x/route.ts", "export async function DELETE(req) {\n}\n", ("missing_auth", "critical", "needs_review")),
    ]


def test_one_finding_each(files):
    tree = {f"case{i:02}": {path: text} for i, (path, text, _) in enumerate(LOUD)}
    rows = D.candidates(files(tree)).collect()
    got = sorted((r.repo_id, r.category, r.severity, r.status) for r in rows if not (r.path == "l.py" and r.category == "missing_auth"))
    assert got == [(f"case{i:02}", *expected) for i, (_, _, expected) in enumerate(LOUD)]


def test_rls_switched_on(files):
    tree = {"supabase/m.sql": "CREATE TABLE a (id INT);\nALTER TABLE a ENABLE ROW LEVEL SECURITY;\nCREATE TABLE b (id INT);\n"}
    assert [(c, n) for c, _, n, _, _ in found(files, tree, ["DET-19"])] == [("rls_disabled", 3)]


def test_repeated_table_counts_once_with_its_last_line(files):
    tree = {"supabase/m.sql": "CREATE TABLE a (id INT);\n\nCREATE TABLE A (id INT);\nCREATE TABLE b (x INT);\n"}
    assert [n for _, _, n, _, _ in found(files, tree, ["DET-19"])] == [3, 4]


def test_log_without_attacker_input_is_rejected(files):
    text = 'def f(user_name):\n    logger.info(f"x {user_name} \\n")\n    logger.info(f"req {request.id} \\n")\n'
    rows = result(files, {"a.py": text})
    # "user_name" is no attacker word, "request" is
    assert [(r["category"], r["line_number"], r["status"]) for r in rows] == [("log_injection", 3, "candidate")]
    assert result(files, {"a.py": 'logger.warning(f"data {datum}")\n'}) == []


def test_eval_on_request_is_confirmed(files):
    rows = result(files, {"a.js": "function run(req) {\n  return eval(req.body.code)\n}\n"})
    assert [(r["category"], r["status"], r["line_number"]) for r in rows] == [("unsafe_dynamic_code", "confirmed", 2)]


def test_prompt_like_literal_is_no_secret(files):
    tree = {"a.js": 'const system_prompt = "x"\njwt.sign(p, "If $19.99")\n'}
    assert found(files, tree, ["DET-23"]) and result(files, tree, keys=["DET-23"]) == []


def test_model_findings_stay_in_review(files):
    rows = result(files, {"agent.py": "prompt = request.body\nresponse = client.responses.create(input=prompt)\n"})
    assert rows and all(r["status"] == "needs_review" and r["confidence"] <= 0.55 for r in rows)
    assert not any(r["proof"]["exploitability_proven"] for r in rows)


def test_project_level_coverage_leaves_routes_uncertain(files):
    tree = {
        "middleware.py": "@app.middleware('http')\nasync def auth_middleware(request, call_next):\n    return await call_next(request)\n",
        "rate_limit.js": "app.use(rateLimit({ windowMs: 60000, max: 5 }))\n",
        "routes.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/admin/users')\nasync def users():\n    return []\n",
        "routes.js": "router.post('/login', handler)\n",
    }
    facts = S.file_facts(S.mark_ignored(files(tree)))
    rows = S.raw_findings(facts, S.repository_facts(facts)).collect()
    auth = [r for r in rows if r.category == "missing_auth"]
    limit = [r for r in rows if r.category == "missing_rate_limit"]
    assert [(r.status, r.false_positive_risk) for r in auth] == [("needs_review", "high")]
    assert [r.status for r in limit] == ["needs_review"]


def test_open_delete_route_is_a_candidate(files):
    text = "from fastapi import FastAPI\napp = FastAPI()\n@app.delete('/api/admin/users/{id}')\nasync def delete_user(user_id: int):\n    return {}\n"
    assert [(r["category"], r["status"]) for r in result(files, {"public_api.py": text})] == [("missing_auth", "candidate")]


KINDS = [
        ({"pyproject.toml": "[project]\nname='svc'\ndependencies=['fastapi']\n", "internal/worker/app.py": "SERVICE_HOST = '127.0.0.1'\n@app.post('/api/admin/users')\nasync def f(p): return p\n"}, "internal_service"),
        ({"package.json": '{\n  "name": "@acme/sdk",\n  "exports": {".": "./src/index.js"}\n}\n', "src/sdk/index.js": "export function requestClient() { return 'ok'; }\n"}, "library"),
        ({"pyproject.toml": "[project]\nname='framework'\ndependencies=['fastapi']\n", "plugin.py": "from fastapi import APIRouter\nrouter = APIRouter()\ndef install_middleware(app):\n    return app\n"}, "framework"),
        ({"package.json": '{\n  "dependencies": {\n    "express": "^4.0.0"\n  }\n}\n', "routes.js": "app.get('/health', () => {})\n"}, "framework"),
        ({"requirements.txt": "rq\nsqlmodel\n", "rq_pkg/__init__.py": "from rq import Queue\n"}, "library"),
        ({"package.json": '{"dependencies": {"express": "^4.0.0"}}', "server.js": "app.post('/login', handler)\napp.post('/signup', handler)\napp.get('/account/profile', handler)\n"}, "application"),
    ]


def test_repository_kinds(files):
    tree = {f"case{i}": paths for i, (paths, _) in enumerate(KINDS)}
    rows = C.repo_contexts(C.file_context(S.mark_ignored(files(tree)))).collect()
    assert {r.repo_id: r.kind for r in rows} == {f"case{i}": kind for i, (_, kind) in enumerate(KINDS)}


def test_ignored_paths(files):
    tree = {p: "x = 1\n" for p in ["src/main.py", "node_modules/b.js", "generated/t.d.ts", "vendor/v.py", "dist/a.min.js", "yarn.lock", "a/.env", "k.min.js", "README.md"]}
    kept = S.mark_ignored(files(tree)).filter("NOT ignored").select("path").collect()
    assert sorted(r.path for r in kept) == ["a/.env", "src/main.py"]
    strict = S.mark_ignored(files(tree), strict=True).filter("NOT ignored").select("path").collect()
    assert [r.path for r in strict] == ["src/main.py"]


def test_scan_is_the_sum_of_its_parts(files):
    other = {"x.js": "db.query(`SELECT ${a}`)\n", "y.py": 'password = "hunter2hunter2"\n'}
    both = S.scan(files({"one": FIXTURE, "two": other}))
    apart = S.scan(files({"one": FIXTURE})).unionByName(S.scan(files({"two": other})))
    key = [F.col(c) for c in ("repo_id", "path", "line_number", "category", "status", "severity", "confidence", "id")]
    assert sorted(both.select(*key).collect()) == sorted(apart.select(*key).collect())


def test_staged_scan_gives_the_same(files):
    key = ["id", "status", "severity", "confidence"]
    plain = S.scan(files(FIXTURE)).select(*key).collect()
    assert sorted(S.scan(files(FIXTURE), staged=True).select(*key).collect()) == sorted(plain)


def test_scores_do_not_depend_on_row_order(files):
    rows = S.scan(files(FIXTURE))
    again = rows.repartition(3, "line_number").orderBy(F.rand(7))
    assert R.risk_scores(rows).collect() == R.risk_scores(again).collect()


def test_a_rule_of_ones_own(files):
    number = D.outcome("injection", 9, "weak_hash", "low", "candidate", "high", "md5")
    rule = D.LineDetector("OWN-01", "py", ["md5"], "NOT comment", [("line RLIKE 'md5[(]'", number)])
    tree = {"a.py": "h = md5(x)\n# md5(y)\n", "b.js": "md5(x)\n"}
    assert found(files, tree, [rule]) == [("weak_hash", "a.py", 1, "low", "candidate")]
    rows = result(files, tree, keys=[rule])
    assert [(r["category"], r["status"]) for r in rows] == [("weak_hash", "needs_review")]


def _raises(path, lines):
    for i, line in enumerate(lines, 1):
        if "md5" in line:
            yield i, line.strip(), 10 // (len(line) - 10) and _WEAK


_WEAK = D.outcome("injection", 9, "weak_hash", "low", "candidate", "high", "md5")


def test_failing_rules_are_listed_and_change_nothing_else(files):
    tree = {**FIXTURE, "ok.py": "digest = md5(x)\n", "bad.py": "import md5\nmd5(x) # y\n", "c.js": "md5(a)\n"}
    good = D.LineDetector("GOOD", "js", ["md5"], "NOT comment", [("line RLIKE 'md5[(]'", _WEAK)])
    pattern = D.LineDetector("PATTERN", "py", ["md5"], "NOT comment", [("line RLIKE 'md5[('", _WEAK)])
    zero = D.LineDetector("ZERO", "py", ["md5"], "NOT comment", [("10 / (length(line) - 10) > 0", _WEAK)])
    plugin = PL.Plugin("PLUG-IN", _raises, (".py",))
    columns = ("path", "line_number", "category", "severity", "status", "confidence")
    plain = sorted(S.scan(files(tree)).select(*columns).collect())
    rows, errors = S.scan_with_rules(files(tree), [good, pattern, zero, plugin])
    more = [r for r in rows.select(*columns).collect() if r.category == "weak_hash"]
    assert sorted(r for r in rows.select(*columns).collect() if r.category != "weak_hash") == plain
    assert sorted((r.path, r.line_number) for r in more) == [("c.js", 1), ("ok.py", 1)]
    listed = {(r.rule, r.path): r.error for r in errors.collect()}
    assert set(listed) == {("PATTERN", None), ("ZERO", None), ("PLUG-IN", "bad.py")}
    assert "ZeroDivisionError" in listed["PLUG-IN", "bad.py"] and "DIVIDE_BY_ZERO" in listed["ZERO", None]
    assert S.scan_with_rules(files(tree), [good])[1].count() == 0


def test_reviews_change_a_scan(spark, files):
    tree = {**FIXTURE, "safe.py": 'def f(uid):\n    db.execute(f"SELECT {uid}")\n'}
    plain = {(r.path, r.line_number): r.id for r in S.scan(files(tree)).collect()}
    flags = ",".join(f"{f}:boolean" for f in ("source_present", "sink_present", "path_present", "sanitizer_present", "attacker_controlled", "exploitability_proven"))
    verdicts = spark.createDataFrame(
        [
            (plain["vuln_cors.py", 3], "confirmed", 0.97, None, "", ""),
            (plain["vuln_auth.py", 5], "rejected", 0.9, None, "", ""),
            (plain["vuln_sql.py", 6], "confirmed", 0.99, None, "dump the table", ""),
            (plain["safe.py", 2], "confirmed", 0.8, (False, None, None, None, None, None), "", ""),
        ],
        f"id string, verdict string, confidence double, proof struct<{flags}>, attack_scenario string, rationale string",
    )
    packages = spark.createDataFrame(
        [("npm", "react-auth-superhelper-lib", "suspicious", 0.5, None)], "registry string, package string, verdict string, confidence double, reason string"
    )
    patch = "--- a/vuln_sql.py\n+++ b/vuln_sql.py\n@@ -6 +6 @@\n-    cursor.execute(f\"SELECT * FROM users WHERE username = '{username}'\")\n+    cursor.find(username)\n"
    fixes = spark.createDataFrame(
        [(plain["vuln_sql.py", 6], "patch_ready", 0.9, patch, "Bind it", "")], "id string, status string, confidence double, patch string, recommendation string, explanation string"
    )
    rows = {(r.category, r.path, r.line_number): r for r in S.reviewed_scan(files(tree), verdicts, packages, fixes).collect()}
    assert rows["cors_wildcard_credentials", "vuln_cors.py", 3].status == "confirmed"
    assert rows["cors_wildcard_credentials", "vuln_cors.py", 3].confirmed_by == ["verifier"]
    assert rows["cors_wildcard_credentials", "vuln_cors.py", 3].cvss_score == 9.0
    assert ("missing_auth", "vuln_auth.py", 5) not in rows
    assert rows["missing_auth", "vuln_auth.py", 8].status == "needs_review"
    assert ("sql_injection", "safe.py", 2) not in rows  # confirmed without a source: the gate rejects it
    assert rows["slopsquatting", "package.json", 5].status == "needs_review"
    sql = rows["sql_injection", "vuln_sql.py", 6]
    assert sql.fix_code == patch and sql.fix and sql.fix_source == "static_table"
    assert all(r.recommendation for r in rows.values())


def test_a_tree_is_walked_once(monkeypatch):
    text = (
        'class A:\n    @bp.route("/in")\n    def inner(self, q):\n        return eval(q)\n\n@app.get("/out")\nasync def out(a, request):\n'
        '    if a:\n        print(f"got {request.args}", a.replace("x", ""))\n    return "curr" "ent_user"\n'
    )
    seen = []
    keep = ast.iter_fields
    monkeypatch.setattr(ast, "iter_child_nodes", lambda node: seen.append(node) or (x for _, v in keep(node) for x in (v if isinstance(v, list) else [v]) if isinstance(x, ast.AST)))
    facts = pyfacts.file_facts(text.replace('"curr" "ent_user"', '"you"'), "a.py")
    assert not seen and [(f["category"], f["line"], f["sanitized"]) for f in facts["flows"]] == [("command_injection", 4, False), ("log_injection", 9, True)]
    assert [(r["route"], r["line"], r["guarded"], r["seq"]) for r in facts["routes"]] == [("/out", 7, False, 0), ("/in", 3, False, 1)]
    assert [r["guarded"] for r in pyfacts.file_facts(text, "a.py")["routes"]] == [True, False]
    rows = [facts, None, {"parses": False, "routes": [], "flows": []}]
    assert pyfacts._arrow_facts(rows).to_pylist() == rows
