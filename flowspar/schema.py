"""Names, severities and table layouts shared by the code-flow operators."""

from __future__ import annotations

DATA_FLOW, CALLS, CTRL_FLOW, PATTERN = "DATA_FLOW", "CALLS", "CTRL_FLOW", "PATTERN"
GENERIC = "injection_general"
MAX_NODES, PER_PAIR, PER_CATEGORY = 20, 5, 50

_LEVELS = {
    "critical": "code_injection command_injection deserialization jndi_injection ldap_injection nosql_injection sql_injection ssti xpath_injection xxe",
    "high": "auth_bypass cleartext_transmission format_string header_injection path_traversal ssrf",
    "medium": "crypto_weakness hardcoded_secret info_disclosure injection_general insecure_hash log_injection open_redirect secure_cookie trust_boundary weak_crypto weak_randomness xss",
}
SEVERITY = {c: level for level, names in _LEVELS.items() for c in names.split()}
RANK = {"critical": 3, "high": 2, "medium": 1}
POSITION_GATED = frozenset("code_injection sql_injection ssti xpath_injection".split())
ALIASES = {"weak_crypto": "crypto_weakness"}

CWE = dict(
    pair.split("=")
    for pair in "auth_bypass=CWE-287 code_injection=CWE-94 command_injection=CWE-78 crypto_weakness=CWE-327 deserialization=CWE-502 jndi_injection=CWE-917 open_redirect=CWE-601 path_traversal=CWE-22 sql_injection=CWE-89 ssrf=CWE-918 ssti=CWE-1336 xss=CWE-79 xxe=CWE-611".split()
)

TITLES = {c: c.replace("_", " ") for c in SEVERITY} | {
    "sql_injection": "SQL injection", "xss": "cross-site scripting", "ssrf": "server-side request forgery", "ssti": "template injection", "xxe": "XML external entity", "ldap_injection": "LDAP injection",
    "nosql_injection": "NoSQL injection", "xpath_injection": "XPath injection", "jndi_injection": "JNDI injection", "path_traversal": "path traversal", "deserialization": "unsafe deserialization",
    "auth_bypass": "authentication bypass", "info_disclosure": "information disclosure", "injection_general": "untrusted input", "secure_cookie": "insecure cookie", "weak_randomness": "weak random numbers",
}

FUNCTIONS = "file_path string, name string, start_line int, end_line int, class_name string, is_method boolean, params array<string>, decorators array<string>, signature string, source string"
CLASSES = "file_path string, name string, start_line int, end_line int, bases array<string>, decorators array<string>"
IMPORTS = "file_path string, module string, names array<string>, alias string, is_relative boolean, line int"
CALLS_TABLE = "file_path string, caller string, callee string, line int, end_line int, expression string, call_args array<string>, receiver string, is_method boolean"
DEFS = "file_path string, function string, var_name string, line int, end_line int, text string, is_param boolean, enhanced_for boolean"
USES = "file_path string, function string, var_name string, line int"
BLOCKS = "block_id string, file_path string, function string, start_line int, end_line int, statements array<string>, block_type string"
CFG_EDGES = "src string, dst string, kind string"
SLOTS = "file_path string, class_name string, slot string"
FIELD_TYPES = "file_path string, field string, type_name string"
NODES = (
    "node_id string, node_type string, file_path string, line int, end_line int, function string, name string, var_name string, class_name string, param_index int, "
    "text string, call_args array<string>, caller string, callee string, is_resolved boolean, cross_file boolean, callee_files array<string>"
)
EDGES = "src string, dst string, edge_type string, ctrl_type string, confidence string, seq bigint"
ENDPOINTS = (
    "route string, methods array<string>, handler string, file_path string, line int, params array<struct<name:string,source:string,type_hint:string,required:boolean>>, "
    "auth_required boolean, auth_decorators array<string>, framework string, source_lines array<string>"
)
ENDPOINT_BODY = (
    "route string, methods array<string>, params array<struct<name:string,source:string,type_hint:string,required:boolean>>, auth_required boolean, "
    "auth_decorators array<string>, framework string, source_lines array<string>"
)
