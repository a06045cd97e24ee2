"""A source-code corpus derived from the event table.

Every event becomes one chunk of code picked from a fixed list; forty consecutive
events make one file, so the corpus grows with the events.  A third of the files
belong to one repository, as in real collections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS_PER_FILE = 40

# kind of file -> (path with {f} for the file number, first line, last line, chunk separator)
KINDS: list[tuple[str, str, str, str, str]] = [
    ("py", "src/m{f}/views.py", "print 'module loaded'", "", "\n"),
    ("js", "web/m{f}/server.js", "const db = connect()", "", "\n"),
    ("py", "app/routers/m{f}.py", "print 'router loaded'", "", "\n"),
    ("handler", "app/api/admin/users{f}/route.ts", "import { db } from '../db'", "", "\n"),
    ("sql", "supabase/migrations/m{f}.sql", "-- migration", "", "\n"),
    ("py", "services/worker/m{f}.py", "exec 'legacy'", "", "\n"),
    ("js", "web/m{f}/client.ts", "import { createClient } from '@acme/db'", "", "\n"),
    ("rules", "rules/m{f}/firestore.rules", "rules_version = '2';", "}", "\n"),
    ("rtdb", "rules/m{f}/database.rules.json", "{", "}", ",\n"),
    ("npm", "packages/p{f}/package.json", '{\n  "dependencies": {', "  }\n}", ",\n"),
    ("pip", "services/s{f}/requirements.txt", "# pinned", "", "\n"),
    ("toml", "services/s{f}/pyproject.toml", "[project]", "", "\n"),
    ("mcp", "config/m{f}/mcp.json", '{\n  "mcpServers": {', "  }\n}", ",\n"),
    ("env", "deploy/d{f}/.env.production", "MODE=production", "", "\n"),
    ("js", "generated/m{f}/routes.js", "/* bundle */", "", "\n"),
    ("js", "web/m{f}/vendors/lib.tsx", "export default 1", "", "\n"),
    ("py", "tests/m{f}/test_views.py", "print 'test'", "", "\n"),
    ("handler", "app/api/login{f}/route.js", "import { db } from '../db'", "", "\n"),
    ("sql", "db/schema/m{f}.sql", "-- schema", "", "\n"),
    ("js", "pkg/agents/m{f}.mjs", "import llm from './llm.js'", "", "\n"),
]

# chunks per kind; {u} stands for the user and {e} for the event of the chunk
CHUNKS: dict[str, list[str]] = {
    "py": [
        'cursor.execute(f"SELECT * FROM t{u} WHERE id = \'{request.args}\'")',
        'cursor.execute("SELECT * FROM t WHERE id = %s", (uid,))',
        'db.execute("DELETE FROM t WHERE id = " + uid{u})',
        'rows = Model.objects.raw(f"SELECT * FROM t WHERE a = {name}")',
        'stmt = sqlalchemy.text(f"SELECT {cols}")',
        'query = f"UPDATE t SET a = {body}"',
        'sql = "DELETE FROM t WHERE id = %s" % user_id',
        '# cursor.execute(f"SELECT {x}")',
        "name = request.form",
        "total = compute({u}, {e})",
        'logger.info(f"login {request.user} \\n done")',
        'logging.warning("user %s" % request)',
        'logger.debug(f"record {record_id}")',
        'print(f"got {data}")',
        'subprocess.run(f"ls {path}", shell=True)',
        'os.system("rm " + target)',
        'os.popen(f"cat {input_name}")',
        "subprocess.run(cmd, shell=True) + tail",
        'subprocess.run(["ls", "-l"])',
        '@app.get("/api/admin/users{u}")',
        '@router.post("/api/account/login")',
        '@app.post("/api/payment/charge")',
        '@bp.route("/public/info")',
        '@app.delete("/internal/cache")',
        "def handler_{u}(name, uid):",
        "    return {}",
        'app.add_middleware(\n    CORSMiddleware,\n    allow_origins=["*"],\n    allow_credentials=True,\n)',
        'app.add_middleware(CORSMiddleware, allow_origins=["*"])',
        'app.add_middleware(CORSMiddleware, allow_origins=["https://a.b"])',
        'jwt.encode(payload, key, algorithm="none")',
        "prompt = build(request.body)",
        "answer = client.responses.create(input=text)",
        "exec(model_output)",
        'messages = [{"role": "user", "content": docs}]',
        "memory.save(user_input)",
        "hits = vectorstore.similarity_search(q)",
        'api_key_{u} = "sk-abcdef{e}0123456789"',
        'password = "hunter{e}hunter"',
        'secret = "changeme-please"',
        'key = os.environ.get("API_KEY")',
        'prompt = f"use secret {os.environ[\'OPENAI_API_KEY\']} in message"',
        "x{u} = clean(value).replace('\\n', '')",
        "",
        "    value = json.dumps(body)",
        "from fastapi import FastAPI",
        'system_prompt = "You are {u}"',
    ],
    "js": [
        "db.query(`SELECT * FROM t WHERE id = ${req.params.id}`)",
        'db.query("SELECT * FROM t WHERE id = $1", [id])',
        'conn.query("SELECT * FROM t WHERE id = " + id{u})',
        "conn.query('DELETE FROM t WHERE id = ' + id)",
        "pool.execute(`UPDATE t SET a = ${value}`)",
        "knex.raw(`SELECT ${cols}`)",
        'const s = "select a from t where b = " + b',
        "// db.query(`SELECT ${x}`)",
        "console.log(`user ${req.body.name}\\n`)",
        "console.log(`user ${userName}`)",
        "winston.info(`body ${request.body}`)",
        "exec(`ls ${dir}`)",
        "child_process.execSync(`tar ${name}`)",
        "spawn('git', [`${branch}`])",
        "exec('ls ' + req.query.dir)",
        "spawnSync(req.body.cmd)",
        "return eval(req.body.code)",
        "const fn = new Function(request.query.src)",
        "setTimeout(req.body.cb, {e})",
        "setInterval(req.query.tick, 10)",
        "fs.readFile(req.query.file, cb)",
        "fs.readFile(path.join(base, req.query.file), cb)",
        'app.get("/api/admin/report{u}", handler)',
        "router.post('/login', handler)",
        "app.post('/billing/charge', pay)",
        "router.get('/health', ok)",
        "app.use(cors({\n  origin: \"*\",\n  credentials: true\n}))",
        'app.use(cors({ origin: true }))',
        'app.use(cors({ origin: "https://a.b" }))',
        'res.setHeader("Access-Control-Allow-Origin", "*")',
        'headers: { "Access-Control-Allow-Origin": "*" },',
        'res.setHeader("Access-Control-Allow-Credentials", "true")',
        'const c = createClient(url, "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9abcdefghijklmnop")',
        "await c.from('t').insert({ a: 1 })",
        'jwt.sign(payload, "short-key")',
        "jwt.sign(payload, process.env.JWT_KEY)",
        "const opts = { algorithm: 'none' }",
        "const prompt = req.body.text",
        "const r = await openai.chat.completions.create({ messages })",
        "tool.invoke(completion.text)",
        "memory.add(query)",
        "const docs = await retriever.invoke(q)",
        "const apiToken = 'ghp_abcdef{e}123456789'",
        "const n{u} = {e}",
        "export function helper{u}() { return {e} }",
        "",
        "const message = `token ${process.env.TOKEN} in prompt`",
    ],
    "handler": [
        "export async function GET(req) {",
        "export async function POST(req) {",
        "export function DELETE(req) {",
        "  const row{u} = await db.find({e})",
        "  return Response.json(row)",
        "}",
    ],
    "sql": [
        "CREATE TABLE users{u} (id INT);",
        "create table if not exists orders{e} (id INT);",
        "CREATE TABLE schema_migrations (id INT);",
        "ALTER TABLE users{u} ENABLE ROW LEVEL SECURITY;",
        "INSERT INTO users{u} VALUES ({e});",
        "CREATE TABLE\n  wide{u} (id INT);",
        "SELECT auth.uid();",
    ],
    "rules": [
        "  allow read, write: if true;",
        "  allow read: if true;",
        "  allow write: if true;",
        "  allow read: if request.auth != null;",
        "  match /users{u}/{id} {",
    ],
    "rtdb": [
        '  "n{u}-{e}": {\n    ".read": true }',
        '  "n{u}-{e}": {\n    ".write": "true" }',
        '  "n{u}-{e}": { ".read": "signed in" }',
    ],
    "npm": ['    "lib-{u}": "^{e}.0.0"', '    "@acme/mod{u}": "~1.0"', '    "express": "^4.0.0"'],
    "pip": ["lib{u}>={e}", "pkg-{u}==1.0; python_version > '3'", "# comment {u}", "", "plain{e}", "extra[x]~=1.{u}"],
    "toml": ['name{u} = "svc"', "[tool.x{e}]", 'dep{u} >= "1.0"', 'dependencies = ["fastapi", "celery"]'],
    "mcp": [
        '    "s{u}x{e}": {\n      "command": "npx", "args": [] }',
        '    "s{u}x{e}": {\n      "url": "https://tools.acme{u}.dev" }',
        '    "s{u}x{e}": { "note": "none" }',
    ],
    "env": ["API_HOST=host{u}", "JWT_SECRET=value{e}{u}", "DEBUG=true", "# SECRET=old", "SUPABASE_URL=https://db{u}.dev"],
}
# lines that silence a whole file, put into some files only
GUARDS = ["guard = require_auth", "const guard = passport", "from slowapi import limiter", "const guard = rateLimit"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_no, position, kind, repo_id, path, chunk) of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    c = F.col
    base = events.withColumns(
        {
            "file_no": F.floor(c("event_id") / CHUNKS_PER_FILE).cast("bigint"),
            "position": (c("event_id") % CHUNKS_PER_FILE).cast("int"),
        }
    )
    base = base.withColumn("kind_no", c("file_no") % len(KINDS))
    code = None
    for name, texts in CHUNKS.items():
        numbers = [i for i, k in enumerate(KINDS) if k[0] == name]
        picked = _pick(texts, (c("event_id") * 7 + c("user_id")) % len(texts))
        code = F.when(c("kind_no").isin(*numbers), picked) if code is None else code.when(c("kind_no").isin(*numbers), picked)
    code = F.replace(F.replace(code, F.lit("{u}"), c("user_id").cast("string")), F.lit("{e}"), c("event_id").cast("string"))
    guard = _pick(GUARDS, F.floor(c("file_no") / 3) % len(GUARDS))
    guarded = (c("position") == 5) & (F.floor(c("file_no") / 40) % 2 == 0) & _pick_kind(["py", "js", "handler"])
    return base.select(
        "file_no", "position", "kind_no", repository(c("file_no")).alias("repo_id"), F.when(guarded, guard).otherwise(code).alias("chunk")
    )


def _pick_kind(names: list[str]) -> Column:
    return F.col("kind_no").isin(*[i for i, k in enumerate(KINDS) if k[0] in names])


def spread(spark: SparkSession) -> int:
    """Partitions for work that is heavy for its size, which Spark would else merge."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def repository(file_no: Column) -> Column:
    return F.when(file_no % 3 == 0, "repo-big").otherwise(
        F.concat(F.lit("repo-"), F.floor(file_no / 60).cast("string"))
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, text): one row per file of the corpus.

    A file has at most forty chunks, so the collected group is bounded.
    """
    c = F.col
    parts = chunks(spark, sf_dir)
    grouped = parts.repartition(spread(spark), "file_no", "kind_no", "repo_id").groupBy("file_no", "kind_no", "repo_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "chunk"))).alias("parts")
    )
    number = c("file_no").cast("string")
    path = F.replace(_pick([k[1] for k in KINDS], c("kind_no")), F.lit("{f}"), number)
    first, last = _pick([k[2] for k in KINDS], c("kind_no")), _pick([k[3] for k in KINDS], c("kind_no"))
    separator = _pick([k[4] for k in KINDS], c("kind_no"))
    body = F.array_join(F.transform(c("parts"), lambda p: p.chunk), "\u0000")
    text = F.concat(first, F.lit("\n"), F.replace(body, F.lit("\u0000"), separator), F.lit("\n"), last)
    return grouped.select("repo_id", path.alias("path"), text.alias("text"))
