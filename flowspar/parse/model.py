"""What all parsers emit: fact rows, statements, and control-flow graphs made from statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

FACTS = (
    "kind string, file_path string, language string, function string, name string, class_name string, line int, end_line int, n int, text string, "
    "items array<string>, marks array<string>, extra string, flag boolean, seq int"
)
FIELDS = [f.split()[0] for f in FACTS.split(", ")]


class Facts:
    """Collects the rows of one file; seq is their order."""

    def __init__(self, path: str, language: str) -> None:
        self.path, self.language, self.rows = path, language, []

    def add(self, kind: str, **values: object) -> None:
        row = dict.fromkeys(FIELDS)
        row.update(values, kind=kind, file_path=self.path, language=self.language, seq=len(self.rows))
        self.rows.append(row)


@dataclass
class Stmt:
    """A statement: kind is plain, if, loop, try, switch, return, break or continue. body, orelse and final are blocks;
    handlers are the blocks of except or catch clauses, or of the cases of a switch."""

    kind: str
    line: int
    end: int
    text: str
    body: list[Stmt] = field(default_factory=list)
    orelse: list[Stmt] = field(default_factory=list)
    handlers: list[list[Stmt]] = field(default_factory=list)
    final: list[Stmt] = field(default_factory=list)
    default: bool = False


def control_flow(facts: Facts, function: str, line: int, end: int, statements: list[Stmt]) -> None:
    """Emits the basic blocks and edges of a function.

    Block 0 is the entry and 1 the exit. A return or throw goes to the exit wherever it stands; a break goes behind its
    loop or switch and a continue to its loop's head (both as fallthrough); what follows a jump has no way in."""
    blocks: list[dict] = []
    edges: list[tuple[int, int, str]] = []

    def block(kind: str, at: int, till: int) -> int:
        blocks.append({"type": kind, "line": at, "end": till, "statements": []})
        return len(blocks) - 1

    Ends = list[tuple[int, str]]

    def run(stmts: list[Stmt], ways: Ends, jumps: tuple[int | None, Ends] | None) -> Ends:
        now: int | None = None

        def hold(s: Stmt, fresh: bool = False) -> int:
            nonlocal now, ways
            if now is None or fresh:
                into = block("normal", s.line, s.end)
                for src, kind in ways if now is None else [(now, "fallthrough")]:
                    edges.append((src, into, kind))
                now, ways = into, []
            blocks[now]["statements"].append(s.text)
            blocks[now]["end"] = max(blocks[now]["end"], s.line)
            return now

        for s in stmts:
            if s.kind == "if":
                at = hold(s)
                yes = run(s.body, [(at, "branch_true")], jumps)
                no = run(s.orelse, [(at, "branch_false")], jumps)
                ways, now = yes + no, None
            elif s.kind == "loop":
                at = hold(s, fresh=True)
                breaks: Ends = []
                for src, kind in run(s.body, [(at, "branch_true")], (at, breaks)):
                    edges.append((src, at, "loop_back" if kind == "fallthrough" else kind))
                ways, now = run(s.orelse, [(at, "branch_false")], jumps) + breaks, None
            elif s.kind == "try":
                at = hold(s, fresh=True)
                out = run(s.body, [(at, "fallthrough")], jumps)
                for h in s.handlers:
                    out = out + run(h, [(at, "exception")], jumps)
                out = run(s.orelse, out, jumps) if s.orelse else out
                ways, now = (run(s.final, out, jumps) if s.final else out), None
            elif s.kind == "switch":
                at = hold(s, fresh=True)
                breaks, through = [], []
                for case in s.handlers:
                    through = run(case, [(at, "branch_true"), *through], (jumps[0] if jumps else None, breaks))
                ways, now = through + breaks + ([] if s.default else [(at, "branch_false")]), None
            elif s.kind == "return":
                edges.append((hold(s), 1, "return"))
                ways, now = [], None
            elif s.kind in ("break", "continue") and jumps:
                at = hold(s)
                if s.kind == "break":
                    jumps[1].append((at, "fallthrough"))
                elif jumps[0] is not None:
                    edges.append((at, jumps[0], "fallthrough"))
                ways, now = [], None
            else:
                hold(s)
        return ways if now is None else [(now, "fallthrough")]

    block("entry", line, line)
    block("exit", end, end)
    for src, kind in run(statements, [(0, "fallthrough")], None):
        edges.append((src, 1, kind))
    name = lambda i: f"bb:{facts.path}:{function}:{i}"
    for i, b in enumerate(blocks):
        facts.add("block", function=function, name=name(i), line=b["line"], end_line=max(b["line"], b["end"]), items=b["statements"], extra=b["type"], n=i)
    for a, b, kind in dict.fromkeys(edges):
        facts.add("cfg", function=function, name=name(a), extra=name(b), text=kind)


Parser = Callable[[str, Facts], None]
