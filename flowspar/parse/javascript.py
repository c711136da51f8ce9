"""Facts of JavaScript sources, by tokens: named functions first, then what their bodies define, use and call."""

from __future__ import annotations

from flowspar.parse.clike import ASSIGN, Code, emit_calls, segments, statements, uses
from flowspar.parse.model import Facts, control_flow

_NOT_METHODS = frozenset("if for while switch catch function return with".split())


def _functions(code: Code) -> list[dict]:
    """Named functions: declarations, methods of classes, and functions or arrows bound to a name."""
    tokens, out = code.tokens, []
    owners: list[tuple[int, int, str]] = []
    for i, t in enumerate(tokens):
        if t.text == "class" and t.kind == "id" and i + 1 < len(tokens) and tokens[i + 1].kind == "id":
            j = i + 2
            while j < len(tokens) and tokens[j].text != "{":
                j += 1
            if j in code.match:
                owners.append((j, code.match[j], tokens[i + 1].text))

    def found(name: str, first: int, opened: int, arrow: bool, owner: str | None) -> None:
        single = tokens[opened].text != "("
        closed = opened if single else code.match.get(opened)
        if closed is None:
            return
        k = closed + 1
        if arrow:
            if k >= len(tokens) or tokens[k].text != "=>":
                return
            k += 1
        if k < len(tokens) and tokens[k].text == "{" and k in code.match:
            body, end = (k + 1, code.match[k]), code.match[k]
        elif arrow and k < len(tokens):  # an expression is the body
            e = k
            while e < len(tokens) and tokens[e].text not in (";", ",", ")", "]", "}") and not (e > k and tokens[e].line > tokens[e - 1].line and tokens[e].kind == "id" and tokens[e - 1].kind != "op"):
                e = code.match.get(e, e) + 1 if tokens[e].text in ("(", "[", "{") else e + 1
            body, end = (k, e), e - 1
        else:
            return
        params = [(opened, opened + 1)] if single else code.split(opened + 1, closed)
        out.append({"name": name, "first": first, "params": params, "body": body, "end": end, "owner": owner})

    for i, t in enumerate(tokens):
        if t.kind != "id" or i + 1 >= len(tokens):
            continue
        after = tokens[i + 1].text
        before = tokens[i - 1].text if i else ""
        if before == "function" and after == "(":
            first = i - 2 if i > 1 and tokens[i - 2].text == "async" else i - 1
            bound = first > 0 and tokens[first - 1].text in ("=", ":", "(", ",")
            if not bound:
                found(t.text, first, i + 1, False, None)
        elif before == "*" and i > 1 and tokens[i - 2].text == "function" and after == "(":
            found(t.text, i - 2, i + 1, False, None)
        elif after in ("=", ":") and before != "?":
            j = i + 2
            if after == ":" and before not in ("{", ","):
                continue
            if j < len(tokens) and tokens[j].text == "async":
                j += 1
            if j < len(tokens) and tokens[j].text == "function":
                j += 1 + (tokens[j + 1].kind == "id" if j + 1 < len(tokens) else 0)
                if j < len(tokens) and tokens[j].text == "(":
                    found(t.text, i, j, False, None)
            elif j < len(tokens) and (tokens[j].text == "(" or tokens[j].kind == "id" and j + 1 < len(tokens) and tokens[j + 1].text == "=>"):
                found(t.text, i, j, True, None)
        elif after == "(" and t.text not in _NOT_METHODS and (i + 1) in code.match:
            end = code.match[i + 1]
            if end + 1 < len(tokens) and tokens[end + 1].text == "{":
                inside = [o for o in owners if o[0] < i < o[1]]
                level = inside and before in ("{", "}", ";", "async", "static", "get", "set", "*") or before == "async"
                if level:
                    found(t.text, i, i + 1, False, inside[-1][2] if inside else None)
    return sorted(out, key=lambda f: (f["body"][0], f["first"]))


def _definitions(code: Code, a: int, b: int) -> list[tuple[str, int, int]]:
    tokens, out = code.tokens, []
    while a < b and tokens[a].text in ("else", "do", "try", "finally", "export", "await", "return"):
        a += 1
    if a < b and tokens[a].text in ("if", "for", "while", "switch", "catch") and a + 1 < b and tokens[a + 1].text == "(":
        end = min(code.close(a + 1), b)
        for x, y in code.split(a + 2, end, ";"):
            out += _definitions(code, x, y)
        return out + (_definitions(code, end + 1, b) if end + 1 < b else [])
    if a < b and tokens[a].text in ("const", "let", "var"):
        for k, (x, y) in enumerate(code.split(a + 1, b)):
            if x < y and tokens[x].kind == "id" and x + 1 < y and tokens[x + 1].text in ("=", "of", "in"):
                out.append((tokens[x].text, a if k == 0 else x, y))
        return out
    if a + 1 < b and tokens[a].kind == "id" and tokens[a + 1].text in ASSIGN:
        out.append((tokens[a].text, a, b))
    return out


def parse(text: str, facts: Facts) -> None:
    """Emits the facts of a script or module; what can't be read is passed over."""
    code, f = Code(text, script=True), facts
    tokens = code.tokens
    functions = _functions(code)
    for i, t in enumerate(tokens):
        if t.text == "import" and t.kind == "id" and (i == 0 or tokens[i - 1].text in (";", "}") or tokens[i - 1].line < t.line):
            end = i + 1
            while end < len(tokens) and tokens[end].kind != "text":
                end += 1
            if end < len(tokens) and end - i < 200:
                module, k = tokens[end].text[1:-1], i + 1
                names = []
                while k < end and tokens[k].text != "from":
                    if tokens[k].kind == "id" and tokens[k].text != "as":
                        renamed = k + 2 < end and tokens[k + 1].text == "as"
                        names.append((tokens[k].text, tokens[k + 2].text if renamed else tokens[k].text))
                        k += 2 if renamed else 0
                    elif tokens[k].text == "*" and k + 2 < end and tokens[k + 1].text == "as":
                        names.append(("*", tokens[k + 2].text))
                        k += 2
                    k += 1
                for name, alias in names or [("", "")]:
                    f.add("import", name=module, items=[name] if name else [], extra=alias or None, flag=module.startswith("."), line=t.line)
        if t.text == "class" and t.kind == "id" and i + 1 < len(tokens) and tokens[i + 1].kind == "id":
            base = [tokens[i + 3].text] if i + 3 < len(tokens) and tokens[i + 2].text == "extends" else []
            f.add("class", name=tokens[i + 1].text, line=t.line, end_line=t.line, items=base, marks=[])
    for fn in functions:
        name, (a, b), line = fn["name"], fn["body"], tokens[fn["first"]].line
        inner = {g["first"]: g["end"] + 1 for g in functions if a <= g["first"] < b and g is not fn}
        params = []
        for x, y in fn["params"]:
            at = x + (x < y and tokens[x].text == "...")
            if at < y and tokens[at].kind == "id":
                params.append((tokens[at].text, code.text(x, y)))
        f.add("function", name=name, class_name=fn["owner"], line=line, end_line=tokens[fn["end"]].line, text=code.text(fn["first"], fn["end"] + 1)[:200], items=[p for p, _ in params], marks=[], extra=code.text(fn["first"], a), flag=fn["owner"] is not None)
        for i, (p, segment) in enumerate(params):
            f.add("param", function=name, name=p, line=line, n=i, text=segment)
            f.add("def", function=name, name=p, line=line, end_line=line, text=segment, flag=True, n=line)
        control_flow(f, name, line, tokens[fn["end"]].line, statements(code, a, b))
        known = {p for p, _ in params}
        for x, y in segments(code, a, b, inner):
            for var, u, v in _definitions(code, x, y):
                known.add(var)
                f.add("def", function=name, name=var, line=tokens[u].line, end_line=tokens[v - 1].line, text=code.text(u, v), flag=False, n=line)
        for var, at in uses(code, a, b, inner, known):
            f.add("use", function=name, name=var, line=at, n=line)
        emit_calls(code, f, name, a, b, inner)
