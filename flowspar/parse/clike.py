"""What the parsers of Java and JavaScript share: tokens, brackets, statements, definitions, calls and uses."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from flowspar.parse.model import Facts, Stmt

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<id>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<num>\d[\w.]*)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|\?\.|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


class Code:
    """Tokens of a source text, the partner of each bracket, and the lines."""

    def __init__(self, text: str, script: bool) -> None:
        self.source = text
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.tokens: list[Token] = []
        self._scan(0, len(text), script)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE:
                while stack and OPEN[self.tokens[stack[-1]].text] != t.text:
                    stack.pop()  # an opening one without a partner
                if stack:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def _add(self, kind: str, start: int, end: int) -> None:
        self.tokens.append(Token(kind, self.source[start:end], start, end, self.line(start)))

    def _scan(self, at: int, stop: int, script: bool) -> None:
        text = self.source
        while at < stop:
            if script and text[at] == "`":
                at = self._template(at, stop)
                continue
            if script and text[at] == "/":
                last = self.tokens[-1] if self.tokens else None
                ends_value = last is not None and (last.kind in ("num", "text") or last.kind == "id" and last.text not in ("return", "typeof", "case", "in", "of") or last.text in (")", "]", "}"))
                m = None if ends_value else _REGEX.match(text, at, stop)
                if m:
                    self._add("text", at, m.end())
                    at = m.end()
                    continue
            m = _TOKEN.match(text, at, stop)
            if m is None:
                return
            if m.lastgroup != "space":
                self._add(m.lastgroup, at, m.end())
            at = m.end()

    def _template(self, at: int, stop: int) -> int:
        """A template string: its text, and the tokens of what it puts in between (in brackets of their own)."""
        text, since, i = self.source, at, at + 1
        while i < stop and text[i] != "`":
            if text[i] == "\\":
                i += 2
            elif text.startswith("${", i):
                self._add("text", since, i + 1)
                depth, j = 1, i + 2
                while j < stop and depth:
                    depth += (text[j] == "{") - (text[j] == "}")
                    j += 1
                self._add("op", i + 1, i + 2)
                self.tokens[-1] = self.tokens[-1]._replace(text="(")
                self._scan(i + 2, j - 1, True)
                self._add("op", j - 1, j)
                self.tokens[-1] = self.tokens[-1]._replace(text=")")
                since = i = j
            else:
                i += 1
        self._add("text", since, min(i + 1, stop))
        return i + 1

    def text(self, a: int, b: int) -> str:
        """Source text of the tokens a ... b - 1."""
        return self.source[self.tokens[a].start : self.tokens[b - 1].end] if b > a else ""

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.tokens) - 1)

    def split(self, a: int, b: int, on: str = ",") -> list[tuple[int, int]]:
        """Parts of the tokens a ... b - 1 at a delimiter outside of brackets (angle brackets after a name included)."""
        out, since, i, angle = [], a, a, 0
        while i < b:
            t = self.tokens[i]
            if t.text in OPEN and t.kind == "op" and i in self.match:
                i = self.match[i]
            elif t.text == "<" and i > a and self.tokens[i - 1].kind == "id" and self.tokens[i - 1].text[:1].isupper():
                angle += 1
            elif t.text == ">" and angle:
                angle -= 1
            elif t.text == on and t.kind == "op" and not angle:
                out.append((since, i))
                since = i + 1
            i += 1
        return [*out, (since, b)] if b > since or out else []


_JUMPS = {"return": "return", "throw": "return", "break": "break", "continue": "continue"}


def statements(code: Code, a: int, b: int) -> list[Stmt]:
    """The statements of the tokens a ... b - 1."""
    out: list[Stmt] = []
    while a < b:
        made, a = _statement(code, a, b)
        out += made
    return out


def _block(code: Code, a: int, b: int) -> tuple[list[Stmt], int]:
    """The statements of a block, or one statement, that begins at a."""
    if a < b and code.tokens[a].text == "{":
        end = min(code.close(a), b)
        return statements(code, a + 1, end), end + 1
    return _statement(code, a, b) if a < b else ([], a)


def _simple_end(code: Code, a: int, b: int) -> int:
    """Behind the statement without a block of its own that begins at a."""
    i = a
    while i < b:
        t = code.tokens[i]
        if t.kind == "op" and t.text in OPEN and i in code.match:
            i = code.match[i]
            if code.tokens[i].text == "}" and (i + 1 >= b or code.tokens[i + 1].line > code.tokens[i].line and code.tokens[i + 1].text not in (".", ",", ")", ";", "?.", "+", "?", ":")):
                return i + 1 if i + 1 >= b or code.tokens[i + 1].text != ";" else i + 2
        elif t.text == ";":
            return i + 1
        elif i > a and t.line > code.tokens[i - 1].line and t.kind == "id" and code.tokens[i - 1].kind != "op" and code.tokens[i - 1].text not in ("return", "new", "else"):
            return i  # JavaScript without semicolons
        i += 1
    return b


def _statement(code: Code, a: int, b: int) -> tuple[list[Stmt], int]:
    tokens = code.tokens
    t = tokens[a]

    def made(kind: str, till: int, **rest: object) -> Stmt:
        head = code.text(a, max(a + 1, min(till, b)))
        return Stmt(kind, t.line, tokens[max(a, min(till, b) - 1)].line, head.split("\n")[0][:200], **rest)

    if t.text == ";":
        return [], a + 1
    if t.text == "{":
        return _block(code, a, b)
    group = code.close(a + 1) + 1 if a + 1 < b and tokens[a + 1].text == "(" else a + 1
    if t.text == "if":
        yes, i = _block(code, group, b)
        no: list[Stmt] = []
        if i < b and tokens[i].text == "else":
            no, i = _block(code, i + 1, b)
        return [made("if", group, body=yes, orelse=no)], i
    if t.text in ("for", "while"):
        if t.text == "for" and a + 1 < b and tokens[a + 1].text == "await":
            group = code.close(a + 2) + 1
        body, i = _block(code, group, b)
        return [made("loop", group, body=body)], i
    if t.text == "do":
        body, i = _block(code, a + 1, b)
        return [made("loop", a + 1, body=body)], _simple_end(code, i, b)
    if t.text == "synchronized" and group > a + 1:
        body, i = _block(code, group, b)
        return [made("plain", group), *body], i
    if t.text == "try":
        body, i = _block(code, group, b)
        handlers, final = [], []
        while i < b and tokens[i].text == "catch":
            at = code.close(i + 1) + 1 if tokens[i + 1].text == "(" else i + 1
            caught, i = _block(code, at, b)
            handlers.append(caught)
        if i < b and tokens[i].text == "finally":
            final, i = _block(code, i + 1, b)
        return [made("try", group, body=body, handlers=handlers, final=final)], i
    if t.text == "switch" and group < b and tokens[group].text == "{":
        end = min(code.close(group), b)
        cases, default, since, i = [], False, None, group + 1
        while i <= end:
            label = i < end and tokens[i].text in ("case", "default")
            if label or i == end:
                if since is not None:
                    cases.append(statements(code, since, i))
                if label:
                    default |= tokens[i].text == "default"
                    while i < end and tokens[i].text not in (":", "->"):
                        i = code.match.get(i, i) + 1
                    arrow = i < end and tokens[i].text == "->"
                    since = i + 1
                    if arrow:  # an arrow case ends by itself
                        body, i = _block(code, since, end)
                        cases.append([*body, Stmt("break", tokens[since].line, tokens[since].line, "")])
                        since = None
                        continue
            i = (code.match[i] if i in code.match and i < end and tokens[i].text in OPEN else i) + 1
        return [made("switch", group, handlers=cases, default=default)], end + 1
    i = max(_simple_end(code, a, b), a + 1)
    return [made(_JUMPS.get(t.text, "plain"), i)], i


_NO_CALL = frozenset("if for while switch catch return new throw synchronized super this function await typeof delete void in of instanceof assert do else try yield case".split())
_BLOCK_BEFORE = frozenset(") => -> else do try finally { } ;".split())


def is_block(code: Code, i: int) -> bool:
    """Whether the brace at token i begins a block (and no literal)."""
    return i == 0 or code.tokens[i - 1].text in _BLOCK_BEFORE or code.tokens[i - 1].kind == "id" and code.tokens[i - 1].text not in ("return", "in", "of", "case", "yield")


def segments(code: Code, a: int, b: int, skip: dict[int, int]) -> list[tuple[int, int]]:
    """Stretches of tokens that are one statement, or the head of one. Blocks inside of expressions (lambdas) give their
    own; ``skip`` are functions inside (start -> end) that are left out."""
    out: list[tuple[int, int]] = []
    since, i = a, a
    while i < b:
        t = code.tokens[i]
        if i in skip:
            i = skip[i]
            continue
        if t.text == "{" and t.kind == "op" and i in code.match:
            end = code.match[i]
            if is_block(code, i):
                out += segments(code, i + 1, min(end, b), skip)
                after = code.tokens[end + 1].text if end + 1 < b else ";"
                if after not in (")", ",", ".", ";", "]"):
                    if i > since:
                        out.append((since, i))
                    since = end + 1
                i = end + 1
                continue
        elif t.text == "(" and t.kind == "op" and i in code.match:
            end = min(code.match[i], b)
            for k in range(i + 1, end):
                if code.tokens[k].text == "{" and k in code.match and is_block(code, k) and k not in skip:
                    out += segments(code, k + 1, code.match[k], skip)
            i = end + 1
            continue
        elif t.text == ";" or i > since and t.line > code.tokens[i - 1].line and t.kind == "id" and (code.tokens[i - 1].kind != "op" or code.tokens[i - 1].text in (")", "]")) and t.text in ("const", "let", "var", "return", "if", "for", "while"):
            if i > since:
                out.append((since, i))
            since = i + 1 if t.text == ";" else i
        i += 1
    if b > since:
        out.append((since, b))
    return out


def calls(code: Code, a: int, b: int, skip: dict[int, int]) -> list[tuple[str, int, int, int, int, bool]]:
    """(name, first token of the chain, token behind it, opening bracket, closing bracket, is_method) of each call."""
    out, i = [], a
    tokens = code.tokens
    while i < b:
        if i in skip:
            i = skip[i]
            continue
        t = tokens[i]
        at = i + 1
        made = t.kind == "id" and i > a and _new_before(code, i, a)
        if made and at < b and tokens[at].text == "<":
            depth = 0
            while at < b:
                depth += (tokens[at].text == "<") - (tokens[at].text == ">")
                at += 1
                if depth == 0:
                    break
        if t.kind == "id" and at < b and tokens[at].text == "(" and at in code.match and t.text not in _NO_CALL:
            end = code.match[at]
            follows = tokens[end + 1].text if end + 1 < len(tokens) else ""
            before = tokens[i - 1] if i > a else None
            declared = not made and follows in ("{", "throws") and before is not None and (before.kind == "id" and before.text not in ("return", "else", "await", "new") or before.text in (">", "]"))
            if not declared:
                out.append((t.text, _chain_start(code, i, a), end + 1, at, end, before is not None and before.text in (".", "?.")))
        i += 1
    return out


def _new_before(code: Code, i: int, a: int) -> bool:
    while i - 2 >= a and code.tokens[i - 1].text == "." and code.tokens[i - 2].kind == "id":
        i -= 2
    return i - 1 >= a and code.tokens[i - 1].text == "new"


def _chain_start(code: Code, i: int, a: int) -> int:
    """Where the chain of names, calls and elements that ends in the name at i begins, a 'new' included."""
    tokens = code.tokens
    while i - 1 >= a and tokens[i - 1].text in (".", "?."):
        j = i - 2
        while j >= a and tokens[j].text in (")", "]") and j in code.match:
            j = code.match[j] - 1
        if j >= a and (tokens[j].kind in ("id", "text", "num")) and tokens[j].text not in _NO_CALL - {"this", "super", "in", "of"}:
            i = j
        else:
            i = j + 1
            break
    return i - 1 if i - 1 >= a and tokens[i - 1].text == "new" else i


def uses(code: Code, a: int, b: int, skip: dict[int, int], known: set[str]) -> list[tuple[str, int]]:
    """(variable, line) of each use of a known variable: no callee, no member name, no key."""
    out, i = [], a
    while i < b:
        if i in skip:
            i = skip[i]
            continue
        t = code.tokens[i]
        if t.kind == "id" and t.text in known:
            before = code.tokens[i - 1].text if i else ""
            after = code.tokens[i + 1].text if i + 1 < len(code.tokens) else ""
            if before not in (".", "?.", "::", "@") and after != "(":
                out.append((t.text, t.line))
        i += 1
    return out


def emit_calls(code: Code, facts: Facts, function: str, a: int, b: int, skip: dict[int, int]) -> None:
    for name, first, end, opened, closed, method in calls(code, a, b, skip):
        args = [code.text(x, y) for x, y in code.split(opened + 1, closed) if y > x]
        facts.add("call", function=function, name=name, line=code.tokens[first].line, end_line=code.tokens[end - 1].line, text=code.text(first, end), items=args, flag=method)
