"""Dominators, post-dominators, their trees and control dependence of control-flow graphs, function by function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dominators(entry: str, succ: dict[str, list[str]]) -> dict[str, set[str]]:
    """node -> the nodes that dominate it, for everything the entry reaches. Iterated to a fixed point in reverse postorder,
    with the sets as bits of integers, so that mostly two rounds do."""
    order, seen, stack = [], {entry}, [(entry, iter(succ.get(entry, ())))]
    while stack:
        n, rest = stack[-1]
        m = next((m for m in rest if m not in seen), None)
        if m is None:
            order.append(n)
            stack.pop()
        else:
            seen.add(m)
            stack.append((m, iter(succ.get(m, ()))))
    order.reverse()
    at = {n: i for i, n in enumerate(order)}
    pred: list[list[int]] = [[] for _ in order]
    for n in order:
        for m in succ.get(n, ()):
            pred[at[m]].append(at[n])
    dom = [1] + [(1 << len(order)) - 1] * (len(order) - 1)
    changed = True
    while changed:
        changed = False
        for i in range(1, len(order)):
            new = -1
            for p in pred[i]:
                new &= dom[p]
            new |= 1 << i
            if new != dom[i]:
                dom[i], changed = new, True
    return {n: {order[len(bits) - 1 - i] for i, b in enumerate(bits) if b == "1"} for n, bits in ((n, f"{dom[i]:b}") for i, n in enumerate(order))}


def immediate(dom: dict[str, set[str]]) -> dict[str, str]:
    """node -> its immediate dominator: the strict one that all other strict ones dominate."""
    return {n: max(s - {n}, key=lambda d: (len(dom[d]), d)) for n, s in dom.items() if len(s) > 1}


_EXIT = "<exit>"


def analyse(blocks: list[str], entry: str, edges: list[tuple[str, str]], only_dom: bool = False) -> Iterator[tuple[str, str, str]]:
    """(relation, a, b): a dom b, a pdom b, a idom b, a ipdom b, and b is control dependent (cd) on a; or the first alone."""
    succ: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        succ.setdefault(a, []).append(b)
    dom = dominators(entry, succ)
    if only_dom:
        yield from (("dom", a, b) for b in sorted(dom) for a in sorted(dom[b]))
        return
    back: dict[str, list[str]] = {}
    for a, bs in succ.items():
        for b in bs:
            back.setdefault(b, []).append(a)
    back[_EXIT] = [n for n in blocks if not succ.get(n)]
    pdom = {n: s - {_EXIT} for n, s in dominators(_EXIT, back).items() if n != _EXIT}
    ipdom = immediate(pdom)
    for name, table in (("dom", dom), ("pdom", pdom)):
        for b in sorted(table):
            for a in sorted(table[b]):
                yield name, a, b
    for name, tree in (("idom", immediate(dom)), ("ipdom", ipdom)):
        for b, a in sorted(tree.items()):
            yield name, a, b
    dependent = set()
    for a, bs in succ.items():
        if len(bs) > 1:
            for b in bs:
                at: str | None = b
                while at is not None and at != ipdom.get(a) and (at, a) not in dependent:
                    dependent.add((at, a))
                    at = ipdom.get(at)
    for b, a in sorted(dependent):
        yield "cd", a, b


def dominance(blocks: DataFrame, cfg_edges: DataFrame, only_dom: bool = False) -> DataFrame:
    """(fn, relation, a, b) for blocks(fn, block_id, block_type) and cfg_edges(fn, src, dst). Functions are small, so each
    is worked on as a group; blocks that the entry doesn't reach dominate nothing."""

    def run(b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if b.empty:
            return pd.DataFrame(columns=["fn", "relation", "a", "b"])
        entry = b.block_id[b.block_type == "entry"]
        found = analyse(b.block_id.tolist(), (entry.min() if len(entry) else b.block_id.min()), list(zip(e.src, e.dst)), only_dom)
        return pd.DataFrame([(b.fn.iloc[0], *x) for x in found], columns=["fn", "relation", "a", "b"])

    own = cfg_edges.select(F.col("fn").alias("_f"), "src", "dst").withColumnRenamed("_f", "fn")  # both may come from one table
    return blocks.groupBy("fn").cogroup(own.groupBy("fn")).applyInPandas(run, "fn string, relation string, a string, b string")


def reachable(start: DataFrame, cfg_edges: DataFrame, depth: int = 200) -> DataFrame:
    """(fn, block_id, depth): the blocks that control can reach from start(fn, block_id) by at most ``depth`` edges of
    cfg_edges(fn, src, dst), start included (G6). Edges don't leave a function, so each is searched as a group."""

    def run(b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        succ: dict[str, list[str]] = {}
        for x, y in zip(e.src, e.dst):
            succ.setdefault(x, []).append(y)
        found = dict.fromkeys(b.block_id, 0)
        last = list(found)
        for d in range(1, depth + 1):
            last = [y for y in dict.fromkeys(y for x in last for y in succ.get(x, ())) if y not in found]
            if not last:
                break
            found.update(dict.fromkeys(last, d))
        fn = b.fn.iloc[0] if len(b) else None
        return pd.DataFrame([(fn, k, v) for k, v in found.items()], columns=["fn", "block_id", "depth"])

    own = cfg_edges.select(F.col("fn").alias("_f"), "src", "dst").withColumnRenamed("_f", "fn")
    return start.groupBy("fn").cogroup(own.groupBy("fn")).applyInPandas(run, "fn string, block_id string, depth int")
