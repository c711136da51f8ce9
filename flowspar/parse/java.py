"""Facts of Java sources, by tokens: members of classes, then what their bodies define, use and call."""

from __future__ import annotations

from flowspar.parse.clike import ASSIGN, Code, emit_calls, segments, statements, uses
from flowspar.parse.model import Facts, control_flow

_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_PLAIN_TYPES = frozenset("int long short byte char float double boolean void var String Object Integer Long Double Float Boolean Short Byte Character List Map Set Collection ArrayList HashMap HashSet Optional".split())
_KINDS = frozenset(("class", "interface", "enum", "record"))


def _type(code: Code, i: int, b: int) -> int:
    """Behind the type that begins at i, or i if there is none."""
    tokens = code.tokens
    if i >= b or tokens[i].kind != "id":
        return i
    i += 1
    while i + 1 < b and tokens[i].text == "." and tokens[i + 1].kind == "id":
        i += 2
    if i < b and tokens[i].text == "<":
        depth = 0
        while i < b:
            depth += tokens[i].text.count("<") - (tokens[i].text.count(">") if set(tokens[i].text) == {">"} else 0)
            i += 1
            if depth <= 0:
                break
    while i + 1 < b and tokens[i].text == "[" and tokens[i + 1].text == "]":
        i += 2
    return i + 1 if i < b and tokens[i].text == "..." else i


def _skip_marks(code: Code, i: int, b: int) -> tuple[list[str], int]:
    """(annotations, place behind annotations and modifiers)."""
    marks = []
    while i < b:
        t = code.tokens[i]
        if t.text == "@" and i + 1 < b and code.tokens[i + 1].text != "interface":
            j = i + 2
            while j + 1 < b and code.tokens[j].text == ".":
                j += 2
            if j < b and code.tokens[j].text == "(":
                j = code.close(j) + 1
            marks.append(code.text(i, j))
            i = j
        elif t.text in _MODIFIERS and (i + 1 >= b or code.tokens[i + 1].text != "("):
            i += 1
        else:
            break
    return marks, i


def _target(code: Code, a: int, b: int) -> str | None:
    """The variable an assignment counts for: a name, the host of an element or a field; of this.f[0] it is f."""
    tokens = code.tokens
    element = False
    while b > a and tokens[b - 1].text == "]" and b - 1 in code.match:
        b, element = code.match[b - 1], True
    names = [t.text for t in tokens[a:b]]
    if not names or any(n != "." and tokens[a + k].kind != "id" for k, n in enumerate(names)):
        return None
    return names[2] if element and len(names) >= 3 and names[0] == "this" else names[0]


def _definitions(code: Code, a: int, b: int) -> list[tuple[str, int, int, bool]]:
    """(variable, first token, token behind, is it the variable of an enhanced for) of a segment."""
    tokens, out = code.tokens, []
    while a < b and tokens[a].text in ("else", "do", "try", "finally", "default", "return", "throw", "case"):
        if tokens[a].text in ("try",) and a + 1 < b and tokens[a + 1].text == "(":
            break
        a += 1
    if a < b and tokens[a].text in ("if", "for", "while", "switch", "catch", "try", "synchronized") and a + 1 < b and tokens[a + 1].text == "(":
        end = min(code.close(a + 1), b)
        for x, y in code.split(a + 2, end, ";"):
            out += _definitions(code, x, y)
        return out + (_definitions(code, end + 1, b) if end + 1 < b else [])
    _, i = _skip_marks(code, a, b)
    j = _type(code, i, b)
    if i < j < b and tokens[j].kind == "id" and (j + 1 == b or tokens[j + 1].text in ("=", ",", ":", "[")):
        if j + 1 < b and tokens[j + 1].text == ":":
            return [*out, (tokens[j].text, a, b, True)]
        for k, (x, y) in enumerate(code.split(j, b)):
            if any(tokens[m].text == "=" for m in range(x, min(y, x + 4))):
                out.append((tokens[x].text, a if k == 0 else x, y, False))
        return out
    k = i
    while k < b:
        if tokens[k].text in ASSIGN and tokens[k].kind == "op":
            name = _target(code, i, k)
            if name:
                out.append((name, a, b, False))
            i = k + 1
        elif tokens[k].text in ("(", "{") and k in code.match:
            k = code.match[k]
        k += 1
    return out


class _Java:
    def __init__(self, text: str, facts: Facts) -> None:
        self.code, self.facts = Code(text, script=False), facts

    def unit(self) -> None:
        code, tokens, i = self.code, self.code.tokens, 0
        while i < len(tokens):
            if tokens[i].text == "import":
                end = i
                while end < len(tokens) and tokens[end].text != ";":
                    end += 1
                parts = [t.text for t in tokens[i + 1 : end] if t.text not in ("static", ".")]
                if parts:
                    self.facts.add("import", name=".".join(parts), items=[parts[-1]], extra=parts[-1], flag=False, line=tokens[i].line)
                i = end + 1
            elif tokens[i].text == "package":
                while i < len(tokens) and tokens[i].text != ";":
                    i += 1
                i += 1
            else:
                i = self.member(i, len(tokens), None)

    def member(self, i: int, b: int, owner: str | None) -> int:
        """Handles the member that begins at i; the place behind it."""
        code, tokens, f = self.code, self.code.tokens, self.facts
        first = i
        marks, i = _skip_marks(code, i, b)
        if i >= b:
            return b
        if tokens[i].text == ";":
            return i + 1
        if tokens[i].text == "{":  # an initialiser
            return code.close(i) + 1
        kind = i + 1 if tokens[i].text == "@" else i
        if kind + 1 < b and tokens[kind].text in _KINDS and tokens[kind + 1].kind == "id":
            name, j = tokens[kind + 1].text, kind + 2
            while j < b and tokens[j].text != "{":
                j = code.match.get(j, j) + 1 if tokens[j].text == "(" else j + 1
            bases = [t.text for t in tokens[kind + 2 : j] if t.kind == "id" and t.text not in ("extends", "implements", "permits")]
            end = code.close(j) if j < b else b - 1
            f.add("class", name=name, line=tokens[first].line, end_line=tokens[min(end, len(tokens) - 1)].line, items=bases, marks=marks, extra=tokens[kind].text)
            k = j + 1
            if tokens[kind].text == "enum":
                while k < end and tokens[k].text != ";":
                    k = code.match.get(k, k) + 1 if tokens[k].text in ("(", "{") else k + 1
            while k < end:
                k = max(self.member(k, end, name), k + 1)
            return end + 1
        at = i
        if tokens[at].text == "<":
            while at < b and tokens[at].text != ">":
                at += 1
            at += 1
        j = at if at + 1 < b and tokens[at].kind == "id" and tokens[at + 1].text == "(" else _type(code, at, b)
        if j + 1 < b and tokens[j].kind == "id" and tokens[j + 1].text == "(" and j + 1 in code.match:
            return self.method(first, j, b, owner, marks)
        end = j
        while end < b and tokens[end].text != ";":
            end = code.match.get(end, end) + 1 if tokens[end].text in ("(", "{", "[") else end + 1
        if at < j < b and tokens[j].kind == "id":
            for x, _ in code.split(j, end):
                f.add("slot", class_name=owner, name=tokens[x].text)
            for t in tokens[at:j]:
                if t.kind == "id" and t.text not in _PLAIN_TYPES:
                    f.add("field", name=tokens[j].text, class_name=owner, text=t.text)
        return end + 1

    def method(self, first: int, j: int, b: int, owner: str | None, marks: list[str]) -> int:
        code, tokens, f = self.code, self.code.tokens, self.facts
        name, close = tokens[j].text, code.match[j + 1]
        k = close + 1
        while k < b and tokens[k].text not in ("{", ";"):
            k = code.match.get(k, k) + 1 if tokens[k].text == "(" else k + 1
        body = k < b and tokens[k].text == "{"
        end = code.close(k) if body else min(k, b - 1)
        line = tokens[first].line
        params = []
        for x, y in code.split(j + 2, close):
            _, at = _skip_marks(code, x, y)
            after = _type(code, at, y)
            if after < y and tokens[after].kind == "id":
                params.append((tokens[after].text, code.text(x, y), tokens[y - 1].line))
        f.add("function", name=name, class_name=owner, line=line, end_line=tokens[end].line, text=code.text(first, end + 1)[:200], items=[p for p, _, _ in params], marks=marks, extra=code.text(first, k), flag=True)
        for i, (p, segment, last) in enumerate(params):
            f.add("param", function=name, name=p, line=line, n=i, text=segment)
            f.add("def", function=name, name=p, line=line, end_line=max(line, last), text=segment, flag=True, n=line)
        if body:
            control_flow(f, name, line, tokens[end].line, statements(code, k + 1, end))
            known = {p for p, _, _ in params}
            for x, y in segments(code, k + 1, end, {}):
                for var, u, v, each in _definitions(code, x, y):
                    known.add(var)
                    f.add("def", function=name, name=var, line=tokens[u].line, end_line=tokens[v - 1].line, text=code.text(u, v), flag=False, n=line, extra="each" if each else None)
            for var, at in uses(code, k + 1, end, {}, known):
                f.add("use", function=name, name=var, line=at, n=line)
            emit_calls(code, f, name, k + 1, end, {})
        return end + 1


def parse(text: str, facts: Facts) -> None:
    """Emits the facts of a compilation unit; what can't be read is passed over."""
    _Java(text, facts).unit()
