"""HTTP endpoints of a file, from its facts: one function a framework, each adding 'endpoint' rows.

An endpoint row has the handler as name, its class, line, and JSON of (route, methods, params, auth, framework, source
lines) as text. What needs other files comes as 'url' (Django) and 'operation' (OpenAPI) rows, joined later."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from flowspar.parse.clike import Code
from flowspar.parse.model import Facts

_STRING = re.compile(r"[rbu]?([\"'])(.*?)\1", re.S)


def merged(prefix: str, route: str, lead: bool = False) -> str:
    """prefix and route with one slash between; lead puts one in front."""
    out = route if not prefix else prefix if not route else prefix.rstrip("/") + "/" + route.lstrip("/")
    return "/" + out if lead and not out.startswith("/") else out


def _first_string(text: str) -> str:
    m = _STRING.search(text)
    return m.group(2) if m else ""


def _argument(mark: str, *names: str) -> str:
    """The text of a named argument of an annotation or call, or ''."""
    m = re.search(r"\b(?:%s)\s*=\s*(\{[^}]*\}|\[[^\]]*\]|\"[^\"]*\"|'[^']*'|[\w.]+)" % "|".join(names), mark)
    return m.group(1) if m else ""


def _routes(mark: str) -> list[str]:
    """Paths of a mapping annotation: value, path, or the bare argument; one empty path if it has none."""
    named = _argument(mark, "value", "path")
    bare = re.match(r"@[\w.]+\(\s*([\"'{\[].*)\)\s*$", mark, re.S)
    found = [m.group(2) for m in _STRING.finditer(named or (re.split(r",\s*\w+\s*=", bare.group(1))[0] if bare else ""))]
    return found or [""]


def _lines(text: str, row: dict, pattern: str) -> list[str]:
    """The lines of a handler that read input, cut to 120 characters."""
    own = text.split("\n")[row["line"] - 1 : row["end_line"]]
    return [x.strip()[:120] for x in own if re.search(pattern, x)]


def _name(mark: str) -> str:
    return re.match(r"@([\w.]+)", mark).group(1)


def _add(facts: Facts, row: dict, route: str, methods: list[str], params: list[dict], auth: list[str], framework: str, lines: list[str], handler: str | None = None) -> None:
    body = {"route": route, "methods": methods, "params": params, "auth_required": bool(auth), "auth_decorators": auth, "framework": framework, "source_lines": lines}
    facts.add("endpoint", name=handler or row["name"], class_name=row["class_name"], line=row["line"], text=json.dumps(body, ensure_ascii=False))


def _param(name: str, source: str, kind: str = "", required: bool = True) -> dict:
    return {"name": name, "source": source, "type_hint": kind, "required": required}


def _of(facts: Facts, kind: str) -> list[dict]:
    return [r for r in facts.rows if r["kind"] == kind]


# --- Java

_SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": ""}
_SPRING_PARAMS = {"PathVariable": "path", "RequestBody": "body", "RequestHeader": "header", "CookieValue": "cookie", "RequestParam": "query"}
_JAX_PARAMS = {"PathParam": "path", "QueryParam": "query", "HeaderParam": "header", "CookieParam": "cookie", "FormParam": "form", "MatrixParam": "matrix", "BeanParam": "bean"}
_SECURITY = frozenset("PreAuthorize PostAuthorize Secured RolesAllowed RequiresAuthentication RequiresPermissions RequiresRoles".split())
_JAVA_INPUT = r"getParameter|getHeader|getCookies|getInputStream|getReader|getQueryString|@RequestParam|@RequestBody|@PathVariable|@RequestHeader|@CookieValue"


def _java_params(facts: Facts, row: dict, sources: dict[str, str]) -> list[dict]:
    out = []
    for p in _of(facts, "param"):
        if p["function"] != row["name"] or p["line"] != row["line"]:
            continue
        m = re.search(r"@(?:\w+\.)*(%s)\b(\([^()]*\))?" % "|".join(sources), p["text"])
        if m:
            given = m.group(2) or ""
            rest = re.sub(r"@[\w.]+(\([^()]*\))?|\bfinal\b", "", p["text"]).split()
            named = _first_string(_argument(given, "value", "name") or (given if "=" not in given else ""))
            optional = "required" in given and "false" in _argument(given, "required") or "defaultValue" in given
            out.append(_param(named or p["name"], sources[m.group(1)], " ".join(rest[:-1]), not optional))
    return out


def spring(facts: Facts, text: str) -> None:
    """Controllers, Feign clients and actuator endpoints."""
    if not ("org.springframework" in text or "org.springdoc" in text):
        return
    classes = {c["name"]: c for c in _of(facts, "class")}
    for row in _of(facts, "function"):
        owner = classes.get(row["class_name"])
        if owner is None:
            continue
        marks = {_name(m).split(".")[-1]: m for m in owner["marks"]}
        own = {_name(m).split(".")[-1]: m for m in row["marks"]}
        auth = [m for k, m in [*marks.items(), *own.items()] if k in _SECURITY]
        actuator = next((k for k in ("Endpoint", "WebEndpoint", "RestControllerEndpoint", "ControllerEndpoint") if k in marks), None)
        if actuator:
            verb = next((v for k, v in (("ReadOperation", "GET"), ("WriteOperation", "POST"), ("DeleteOperation", "DELETE")) if k in own), None)
            if verb:
                _add(facts, row, "/actuator/" + _first_string(_argument(marks[actuator], "id")), [verb], [], auth, "spring-actuator", [])
        feign = marks.get("FeignClient")
        if not feign and not {"RestController", "Controller"} & set(marks):
            continue
        prefix = _first_string(_argument(feign, "url", "path")) if feign else _routes(marks["RequestMapping"])[0] if "RequestMapping" in marks else ""
        for k, verb in _SPRING.items():
            if k in own:
                methods = [verb] if verb else re.findall(r"RequestMethod\.(\w+)|\b(GET|POST|PUT|DELETE|PATCH)\b", _argument(own[k], "method"))
                methods = [verb] if verb else [a or b for a, b in methods]
                for route in _routes(own[k]):
                    _add(facts, row, merged(prefix, route), methods, _java_params(facts, row, _SPRING_PARAMS), auth, "spring-cloud" if feign else "spring", _lines(text, row, _JAVA_INPUT))


def jaxrs(facts: Facts, text: str) -> None:
    """Resources: one endpoint for each verb of a method. Off unless asked for by name."""
    if not re.search(r"(?:javax|jakarta)\.ws\.rs", text) or "@Path" not in text:
        return
    classes = {c["name"]: c for c in _of(facts, "class")}
    for row in _of(facts, "function"):
        owner = classes.get(row["class_name"])
        own = {_name(m).split(".")[-1]: m for m in row["marks"]}
        verbs = [v for v in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS") if v in own]
        if not verbs:
            continue
        base = next((_first_string(m) for m in owner["marks"] if _name(m).split(".")[-1] == "Path"), "") if owner else ""
        route = merged(base, _first_string(own["Path"]) if "Path" in own else "", lead=True)
        auth = [m for k, m in own.items() if k in _SECURITY]
        for verb in verbs:
            _add(facts, row, route, [verb], _java_params(facts, row, _JAX_PARAMS), auth, "jaxrs", _lines(text, row, r"@(?:%s)\b" % "|".join(_JAX_PARAMS)))


# --- Python

_AUTH = re.compile(r"login_required|auth|jwt|permission|token_required|roles?_required", re.I)


def flask(facts: Facts, text: str) -> None:
    if not re.search(r"(?:from|import)\s+flask", text) or not ("Flask(__name__)" in text or ".route(" in text):
        return
    for row in _of(facts, "function"):
        auth = [m for m in row["marks"] if ".route(" not in m and _AUTH.search(m)]
        for m in row["marks"]:
            verb = re.match(r"@[\w.]+\.(route|get|post|put|delete|patch)\(", m)
            if not verb:
                continue
            route = _first_string(m)
            methods = [g[1] for g in _STRING.findall(_argument(m, "methods"))] if verb.group(1) == "route" else [verb.group(1).upper()]
            params = [_param(n, "path", k or "") for k, n in re.findall(r"<(?:(\w+)(?:\([^)]*\))?:)?(\w+)>", route)]
            _add(facts, row, route, [x.upper() for x in methods] or ["GET"], params, auth, "flask", _lines(text, row, r"request\.(?:args|form|json|data|values|files|headers|cookies|get_json|get_data)"))


_FAST = {"Query": "query", "Body": "body", "Path": "path", "Header": "header", "Cookie": "cookie", "Form": "form", "File": "file"}


def fastapi(facts: Facts, text: str) -> None:
    if not re.search(r"from\s+fastapi|import\s+fastapi", text):
        return
    for row in _of(facts, "function"):
        for m in row["marks"]:
            verb = re.match(r"@[\w.]+\.(get|post|put|delete|patch|head|options|trace)\(", m)
            if not verb:
                continue
            route = _first_string(m)
            inside = re.findall(r"\{(\w+)(?::\w+)?\}", route)
            params, auth = [], []
            for p in _of(facts, "param"):
                if p["function"] != row["name"] or p["line"] != row["line"]:
                    continue
                head, _, default = p["text"].partition("=")
                hint = head.partition(":")[2].strip()
                call = re.search(r"\b(%s)\(" % "|".join(_FAST), default + " " + hint)
                if re.search(r"\b(?:Depends|Security)\(", p["text"]):
                    auth += [p["text"].strip()] if _AUTH.search(p["text"]) else []
                    continue
                source = "path" if p["name"] in inside else _FAST[call.group(1)] if call else "query" if not hint or re.match(r"(?:str|int|float|bool|list|Optional)\b", hint) else "body"
                required = not default.strip() or bool(re.search(r"\(\s*\.\.\.", default))
                params.append(_param(p["name"], source, hint, required))
            _add(facts, row, route, [verb.group(1).upper()], params, auth, "fastapi", _lines(text, row, r"request\.(?:query_params|json|form|headers|cookies|body|path_params)"))


def django(facts: Facts, text: str) -> None:
    """URL entries as 'url' rows (route, last part of the view's name); they meet the views in other files later."""
    if not re.search(r"(?:from|import)\s+django", text):
        return
    for m in re.finditer(r"\b(path|re_path|url)\(\s*[rbu]?([\"'])(.*?)\2\s*,\s*([\w.]+)", text):
        view = m.group(4).removesuffix(".as_view")
        facts.add("url", name=view.split(".")[-1], text=m.group(3), line=text.count("\n", 0, m.start()) + 1, extra=m.group(1))
    for row in _of(facts, "function"):
        first = (row["items"] or [""])[0]
        if first == "request":
            auth = [m for m in row["marks"] if _AUTH.search(m)]
            verbs = [g[1] for g in _STRING.findall(" ".join(m for m in row["marks"] if "require_http_methods" in m or "api_view" in m))]
            verbs += [v for v in ("GET", "POST") if any(m == f"@require_{v}" for m in row["marks"])]
            body = {"methods": verbs or ["GET"], "auth_required": bool(auth), "auth_decorators": auth, "source_lines": _lines(text, row, r"request\.(?:GET|POST|body|FILES|META|COOKIES|data|headers)")}
            facts.add("view", name=row["name"], class_name=row["class_name"], line=row["line"], text=json.dumps(body, ensure_ascii=False))


def openapi(facts: Facts, text: str) -> None:
    """The operations of an OpenAPI document as 'operation' rows: handler's module and name, and the endpoint's JSON."""
    import yaml

    try:
        spec = yaml.safe_load(text)
    except yaml.YAMLError as wrong:
        facts.add("error", text=str(wrong)[:200], line=0)
        return
    paths = spec.get("paths") if isinstance(spec, dict) else None
    for route, item in (paths if isinstance(paths, dict) else {}).items():
        if not isinstance(item, dict):
            continue
        for verb, op in item.items():
            if verb not in ("get", "post", "put", "delete", "patch", "head", "options") or not isinstance(op, dict) or not op.get("operationId"):
                continue
            given = [p for p in [*(item.get("parameters") or []), *(op.get("parameters") or [])] if isinstance(p, dict) and p.get("name")]
            params = [_param(p["name"], p.get("in", "query"), str((p.get("schema") or {}).get("type") or ""), bool(p.get("required"))) for p in given]
            params += [_param("body", "body")] if op.get("requestBody") else []
            secured = bool(op.get("security") or spec.get("security"))
            module, _, handler = str(op["operationId"]).rpartition(".")
            body = {"route": str(route), "methods": [verb.upper()], "params": params, "auth_required": secured, "auth_decorators": [], "framework": "connexion", "source_lines": []}
            facts.add("operation", name=handler, extra=module.replace(".", "/"), text=json.dumps(body, ensure_ascii=False))


# --- JavaScript

_VERBS = frozenset("get post put delete patch head options all use".split())


def express(facts: Facts, text: str) -> None:
    if not re.search(r"require\(\s*[\"']express[\"']\s*\)|from\s+[\"']express[\"']", text):
        return
    code = Code(text, script=True)
    tokens = code.tokens
    functions = {f["name"]: f for f in _of(facts, "function")}
    for i in range(len(tokens) - 4):
        if not (tokens[i].kind == "id" and tokens[i + 1].text == "." and tokens[i + 2].text in _VERBS and tokens[i + 3].text == "(" and tokens[i + 4].kind == "text" and i + 3 in code.match):
            continue
        route, end = tokens[i + 4].text.strip("'\"`"), code.match[i + 3]
        if not route.startswith(("/", "*")):
            continue
        args = [code.text(a, b) for a, b in code.split(i + 5, end) if b > a]
        args = [a for a in args if a]
        last = args[-1] if args else ""
        inline = "=>" in last or last.startswith(("function", "async"))
        handler = "anonymous" if inline or not last else last.split(".")[-1].split("(")[0]
        at = functions.get(handler)
        row = {"name": handler, "class_name": None, "line": tokens[i].line, "end_line": tokens[end].line}
        lines = _lines(text, at if at else row, r"req\.(?:query|params|body|headers|cookies|get\()")
        params = [_param(n, "path") for n in re.findall(r":(\w+)", route)]
        auth = [a for a in args[:-1] if re.search(r"auth|jwt|passport|login|session|protect|guard", a, re.I)]
        _add(facts, row, route, [tokens[i + 2].text.upper() if tokens[i + 2].text not in ("all", "use") else "ANY"], params, auth, "express", lines)


EXTRACTORS: dict[str, Callable[[Facts, str], None]] = {"spring": spring, "jaxrs": jaxrs, "flask": flask, "fastapi": fastapi, "django": django, "connexion": openapi, "express": express}
DEFAULTS = {"python": ("flask", "django", "fastapi", "connexion"), "javascript": ("express",), "java": ("spring",)}


def get_extractor(name: str) -> Callable[[Facts, str], None]:
    """An extractor by its name; unknown names raise."""
    if name not in EXTRACTORS:
        raise ValueError(f"no framework {name!r}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name]


def available_frameworks() -> list[str]:
    return sorted(EXTRACTORS)
