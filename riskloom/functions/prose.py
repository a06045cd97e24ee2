"""Texts shown to a reader: what a finding means and how to repair it."""

from __future__ import annotations

from pyspark.sql import Column

from riskloom.functions.text import lookup

# category -> (what it means, short advice, longer advice)
TEXTS: dict[str, tuple[str, str, str]] = {
    "hardcoded_secret": (
        "A credential is written into the source.",
        "Take the credential out of the source and issue a new one.",
        "Anyone who can read the history can read this value, even after the line is gone. Load it at run time from a secret store and revoke the old one.",
    ),
    "committed_env_file": (
        "An environment file with credentials is part of the repository.",
        "Untrack the environment file and replace every credential in it.",
        "List the file in the ignore rules, remove it from the index and from history, and treat all values it held as known to others.",
    ),
    "missing_auth": (
        "A route answers without checking who is calling.",
        "Require an authenticated caller on this route.",
        "Attach the project's login dependency or middleware to the route and test that an anonymous call is refused.",
    ),
    "sql_injection": (
        "A statement is assembled from text that a caller may control.",
        "Bind values as parameters instead of building the statement text.",
        "Keep the statement constant and hand the values to the driver separately. Where names vary, pick them from a fixed list.",
    ),
    "log_injection": (
        "Caller-supplied text goes to the log as it is.",
        "Escape line breaks before logging and log fields, not sentences.",
        "A caller who can add line breaks can forge entries. Use structured logging or replace control characters first.",
    ),
    "command_injection": (
        "A shell command is assembled from text that a caller may control.",
        "Run a fixed program with an argument list and without a shell.",
        "Pass arguments as a list, check them against what is allowed, and never let a shell interpret them.",
    ),
    "unsafe_dynamic_code": (
        "Caller-supplied text is evaluated as code.",
        "Replace dynamic evaluation with a fixed set of operations.",
        "Parse the input as data and select the operation from a table. Evaluating it gives the caller the rights of the process.",
    ),
    "path_traversal": (
        "A file is opened under a name that a caller may control.",
        "Resolve the path and refuse anything outside its folder.",
        "Join the name to a fixed base folder, resolve it, and check that the result is still inside before touching the file.",
    ),
    "cors_wildcard_credentials": (
        "Every origin may call with the visitor's credentials.",
        "Name the allowed origins and keep credentials for those.",
        "With any origin allowed and credentials on, a foreign page can act for a signed-in visitor. List trusted origins.",
    ),
    "cors_wildcard": (
        "Every origin may read responses.",
        "Name the allowed origins.",
        "Replace the star by the origins that need access, per environment.",
    ),
    "rls_disabled": (
        "A table is created without row-level security.",
        "Switch on row-level security and add policies.",
        "Without it the public key can reach all rows. Enable it in the same migration and write one policy per operation.",
    ),
    "firebase_public": (
        "A rule lets everybody read or write.",
        "Tie the rule to a signed-in user.",
        "Require authentication and check ownership in the rule; open rules expose or destroy the whole collection.",
    ),
    "missing_rate_limit": (
        "An attractive endpoint can be called without limit.",
        "Limit the calls per client on this endpoint.",
        "Cap attempts per address and per account, and slow down after failures. Payment endpoints deserve the lowest cap.",
    ),
    "weak_jwt": (
        "Tokens are unsigned or signed with a short literal.",
        "Sign tokens with a long random key kept outside the source.",
        "Fix the accepted algorithm on the server and rotate the key. A short or absent key lets anyone mint tokens.",
    ),
    "slopsquatting": (
        "A dependency looks invented or suspicious.",
        "Remove the dependency or prove that it is the intended package.",
        "Check publisher, age and downloads, pin the version you trust, and look for a well-known equivalent.",
    ),
    "missing_security_headers": (
        "Protective response headers are absent.",
        "Send the usual protective headers.",
        "Set content security policy, transport security, frame and type headers in one place.",
    ),
    "supabase_anon_write": (
        "A client with the public key writes data.",
        "Write through the server or protect the table with policies.",
        "Writes with the public key rely on row policies alone. Move them behind an endpoint that checks the caller.",
    ),
    "prompt_injection": (
        "Foreign text becomes part of a model prompt.",
        "Separate instructions from foreign text and limit what the model may do.",
        "Mark foreign text as data, validate the answer, and require approval before privileged actions.",
    ),
    "unsafe_tool_execution": (
        "Model output reaches a tool or an interpreter.",
        "Validate model output against a schema before acting on it.",
        "Allow only listed tools and arguments, run them with few rights, and keep a person in the loop for the rest.",
    ),
    "agent_privilege_escalation": (
        "An agent holds more rights than its task needs.",
        "Give the agent only the rights its task needs.",
        "Use separate, short-lived credentials per tool and log each use.",
    ),
    "mcp_untrusted_server": (
        "A tool-server entry starts programs, opens addresses or passes variables.",
        "Pin and review the tool servers that may be used.",
        "Use fixed versions from known sources, run them isolated, and pass no credential they do not need.",
    ),
    "llm_secret_exposure": (
        "A credential is placed into a model prompt.",
        "Keep credentials out of prompts.",
        "Prompts are stored and echoed. Resolve credentials inside the tool that needs them and mask them in logs.",
    ),
    "agent_memory_poisoning": (
        "Foreign text is stored in a model's memory.",
        "Check and label text before it is remembered.",
        "Record where a memory came from, scope it to its user, and let it expire.",
    ),
    "retrieval_poisoning": (
        "Retrieved text is trusted by a model.",
        "Index trusted sources only and treat retrieved text as data.",
        "Filter by source, screen for instructions, and show where an answer came from.",
    ),
}


def advice(category: Column) -> tuple[Column, Column]:
    """(recommendation, fix) of a known category, else nulls."""
    return (
        lookup({k: v[1] for k, v in TEXTS.items()}, category),
        lookup({k: v[2] for k, v in TEXTS.items()}, category),
    )
