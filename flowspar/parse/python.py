"""Facts of Python sources, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from flowspar.parse.model import Facts, Stmt, control_flow

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_PLAIN_TYPES = frozenset("str int float bool bytes list dict set tuple None Any Optional List Dict Set Tuple Union object".split())


class Source:
    """Text of nodes, by UTF-8 columns."""

    def __init__(self, text: str) -> None:
        self.lines = [x.encode() for x in text.splitlines(keepends=True)] or [b""]

    def cut(self, a: int, b: int, c: int, d: int) -> str:
        if a == c:
            return self.lines[a - 1][b:d].decode("utf-8", "replace")
        middle = [self.lines[a - 1][b:], *self.lines[a : c - 1], self.lines[c - 1][:d] if c <= len(self.lines) else b""]
        return b"".join(middle).decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.cut(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)


def _decorators(source: Source, node: ast.AST) -> list[str]:
    return ["@" + source.of(d) for d in node.decorator_list]


def _parameters(node: ast.AST, method: bool) -> list[tuple[ast.arg, ast.expr | None]]:
    """(parameter, default), in order; a method's self or cls is left out."""
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    out = list(zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults))
    out += [(a.vararg, None)] if a.vararg else []
    out += list(zip(a.kwonlyargs, a.kw_defaults))
    out += [(a.kwarg, None)] if a.kwarg else []
    return out[1:] if method and out and out[0][0].arg in ("self", "cls") else out


def _callee(node: ast.Call) -> tuple[str, bool] | None:
    if isinstance(node.func, ast.Name):
        return node.func.id, False
    return (node.func.attr, True) if isinstance(node.func, ast.Attribute) else None


def _receiver(node: ast.expr) -> str | None:
    """The leftmost name of a dotted callee."""
    dotted = isinstance(node, ast.Attribute)
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if dotted and isinstance(node, ast.Name) else None


def _target(node: ast.expr) -> str | None:
    """The variable that an assignment counts for: a name, or the host of an element or attribute; none for tuples."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Subscript):
        base = node.value
        while isinstance(base, ast.Subscript):
            base = base.value
        if isinstance(base, ast.Attribute):
            return base.attr if isinstance(base.value, ast.Name) and base.value.id == "self" else _target(base)
        return _target(base)
    if isinstance(node, ast.Attribute):
        return _receiver(node)
    return None


def _statements(source: Source, body: list[ast.stmt]) -> list[Stmt]:
    out = []
    for s in body:
        one = lambda kind, **rest: Stmt(kind, s.lineno, s.end_lineno, source.of(s).split("\n")[0][:200], **rest)  # noqa: E731, B023
        inner = lambda b: _statements(source, b)
        if isinstance(s, ast.If):
            out.append(one("if", body=inner(s.body), orelse=inner(s.orelse)))
        elif isinstance(s, ast.For | ast.AsyncFor | ast.While):
            out.append(one("loop", body=inner(s.body), orelse=inner(s.orelse)))
        elif isinstance(s, ast.Try | ast.TryStar):
            out.append(one("try", body=inner(s.body), orelse=inner(s.orelse), handlers=[inner(h.body) for h in s.handlers], final=inner(s.finalbody)))
        elif isinstance(s, ast.With | ast.AsyncWith):
            out += [one("plain"), *inner(s.body)]
        elif isinstance(s, ast.Match):
            wild = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in s.cases)
            cases = [[*inner(c.body), Stmt("break", s.end_lineno, s.end_lineno, "")] for c in s.cases]
            out.append(one("switch", handlers=cases, default=wild))
        elif isinstance(s, ast.Return | ast.Raise):
            out.append(one("return"))
        elif isinstance(s, ast.Break | ast.Continue):
            out.append(one("break" if isinstance(s, ast.Break) else "continue"))
        else:
            out.append(one("plain"))
    return out


class _Walk(ast.NodeVisitor):
    def __init__(self, source: Source, facts: Facts) -> None:
        self.source, self.facts = source, facts
        self.function: ast.AST | None = None
        self.owner: ast.ClassDef | None = None

    def _function(self, node: ast.AST) -> None:
        f, src = self.facts, self.source
        method = self.owner is not None
        params = _parameters(node, method)
        body = node.body[0]
        signature = src.cut(node.lineno, node.col_offset, body.lineno, body.col_offset).rstrip()
        text = src.of(node)
        f.add("function", name=node.name, class_name=self.owner.name if method else None, line=node.lineno, end_line=node.end_lineno, text=text[:200], items=[p.arg for p, _ in params], marks=_decorators(src, node), extra=signature, flag=method)
        for i, (p, default) in enumerate(params):
            segment = src.of(p) + (f" = {src.of(default)}" if default is not None else "")
            f.add("param", function=node.name, name=p.arg, line=node.lineno, n=i, text=segment)
            f.add("def", function=node.name, name=p.arg, line=node.lineno, end_line=max(node.lineno, p.end_lineno), text=segment, flag=True, n=node.lineno)
        control_flow(f, node.name, node.lineno, node.end_lineno, _statements(src, node.body))
        held, self.function, owner, self.owner = self.function, node, self.owner, None
        for d in [*node.decorator_list, node.args]:
            self.function = held
            self.visit(d)
        self.function = node
        for s in node.body:
            self.visit(s)
        self.function, self.owner = held, owner

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.facts.add("class", name=node.name, line=node.lineno, end_line=node.end_lineno, items=[self.source.of(b) for b in node.bases], marks=_decorators(self.source, node))
        held, self.owner, inside, self.function = self.owner, node, self.function, None
        for s in node.body:
            for t in s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []:
                if isinstance(t, ast.Name):
                    self.facts.add("slot", class_name=node.name, name=t.id)
            self.owner = node
            self.visit(s)
        self.owner, self.function = held, inside

    def _named(self, node: ast.AST, target: ast.expr) -> None:
        name = _target(target)
        if name and self.function is not None:
            self.facts.add("def", function=self.function.name, name=name, line=node.lineno, end_line=node.end_lineno, text=self.source.of(node), flag=False, n=self.function.lineno)
        if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
            self.facts.add("slot", name=f"self.{target.attr}")
        elif isinstance(target, ast.Name) and self.function is None and self.owner is None:
            self.facts.add("slot", name=target.id)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self._named(node, t)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._named(node, node.target)
        self.generic_visit(node)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._named(node, node.target)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self._named(node, node.target)
        kind = self.source.of(node.annotation).split("[")[0].split(".")[-1].strip("'\"")
        if kind and kind not in _PLAIN_TYPES:
            self.facts.add("field", name=_target(node.target) or "", text=kind)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        callee = _callee(node)
        if callee and self.function is not None:
            args = [self.source.of(a) for a in node.args] + [self.source.of(k) for k in node.keywords]
            self.facts.add("call", function=self.function.name, name=callee[0], line=node.lineno, end_line=node.end_lineno, text=self.source.of(node), items=args, extra=_receiver(node.func), flag=callee[1])
        if isinstance(node.func, ast.Name):  # a callee is no variable use
            for a in [*node.args, *(k.value for k in node.keywords)]:
                self.visit(a)
        else:
            self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load) and self.function is not None:
            self.facts.add("use", function=self.function.name, name=node.id, line=node.lineno, n=self.function.lineno)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.facts.add("import", name=a.name, items=[], extra=a.asname or a.name.split(".")[0], flag=False, line=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.facts.add("import", name=module, items=[a.name], extra=a.asname or a.name, flag=node.level > 0, line=node.lineno)


def parse(text: str, facts: Facts) -> None:
    """Emits the facts of a module. A module with a syntax error gives one error row."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as wrong:
        facts.add("error", text=str(wrong)[:200], line=getattr(wrong, "lineno", None) or 0)
        return
    _Walk(Source(text), facts).visit(tree)
