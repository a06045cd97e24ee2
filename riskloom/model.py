"""Shapes shared by the operators."""

from __future__ import annotations

REF = "struct<kind:string,file_path:string,line_start:int,line_end:int,quote:string>"
FLOW = (
    f"struct<category:string,line:int,confidence:double,sanitized:boolean,refs:array<{REF}>>"
)
ROUTE = "struct<route:string,method:string,line:int,guarded:boolean,seq:int>"
PY_FACTS = f"struct<parses:boolean,routes:array<{ROUTE}>,flows:array<{FLOW}>>"

CANDIDATE_FIELDS = [
    ("scanner", "int"),
    ("chk", "int"),
    ("seq", "int"),
    ("category", "string"),
    ("severity", "string"),
    ("status", "string"),
    ("line_number", "int"),
    ("evidence", "string"),
    ("false_positive_risk", "string"),
    ("detail", "string"),
]
CANDIDATE = "struct<" + ",".join(f"{n}:{t}" for n, t in CANDIDATE_FIELDS) + ">"

PROOF_FLAGS = [
    "source_present",
    "sink_present",
    "path_present",
    "sanitizer_present",
    "attacker_controlled",
    "exploitability_proven",
]
PROOF = "struct<" + ",".join(f"{f}:boolean" for f in PROOF_FLAGS) + ",notes:array<string>>"

# order in which the scanners report; part of the order key of a finding
SCANNERS = ["secrets", "auth", "injection", "ai", "cors", "database", "rate_limit", "packages"]

# columns of the findings table after evidence; ``ord`` and the path give the report order of ties
FINDING_COLUMNS = [
    ("repo_id", "string"),
    ("id", "string"),
    ("rule_id", "string"),
    ("category", "string"),
    ("status", "string"),
    ("severity", "string"),
    ("confidence", "double"),
    ("path", "string"),
    ("line_number", "int"),
    ("evidence", "string"),
    ("evidence_refs", f"array<{REF}>"),
    ("proof", PROOF),
    ("description", "string"),
    ("attack_chain", "string"),
    ("fix_code", "string"),
    ("recommendation", "string"),
    ("fix", "string"),
    ("fix_source", "string"),
    ("cvss_score", "double"),
    ("cvss_vector", "string"),
    ("confirmed_by", "array<string>"),
    ("validator", "string"),
    ("owasp_cat", "string"),
    ("false_positive_risk", "string"),
    ("ord", "bigint"),
]
