"""Trees as values: prefix arrays, and what can be read off their structure.

A node is (nt, nv, ci): its type, an opcode or variable number, and for constants their rank. The
first operand after an operator is the left one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ops import BINARY, BY_CODE, BY_NAME, CONST, TABLE, UNARY, VAR

Node = tuple[int, float, int]
NODES = "array<struct<nt:int,nv:float,ci:int>>"


@dataclass(frozen=True)
class Tree:
    """An expression: an operator's name and operands, or ("x", k), or ("c", k)."""

    op: str
    args: tuple = ()


def parse(text: str, literals: list[float] | None = None) -> Tree:
    """A tree from its infix text: variables x0.. and constants c0.., + - * / ^ (or **), and
    functions by the opcodes' names. Nothing else is accepted, and nothing is evaluated; numbers only
    if literals is given, which takes them: the i-th is then the constant -1 - i."""
    tokens = re.findall(r"\s*([xc]\d+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|[A-Za-z_]+|\*\*|[-+*/^(),])", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"not an expression: {text!r}")
    at = 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (expected and tokens[at] != expected):
            raise ValueError(f"expected {expected or 'an operand'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def chain(lower: Callable[[], Tree], signs: dict[str, str]) -> Tree:
        left = lower()
        while at < len(tokens) and tokens[at] in signs:
            left = Tree(signs[take()], (left, lower()))
        return left

    def power() -> Tree:
        left = atom()
        if at < len(tokens) and tokens[at] in ("^", "**"):
            take()
            return Tree("POW", (left, unary()))
        return left

    def unary() -> Tree:
        if at < len(tokens) and tokens[at] == "-":
            take()
            return Tree("NEG", (unary(),))
        return power()

    def term() -> Tree:
        return chain(unary, {"*": "MUL", "/": "DIV"})

    def whole() -> Tree:
        return chain(term, {"+": "ADD", "-": "SUB"})

    def atom() -> Tree:
        token = take()
        if token == "(":
            inner = whole()
            take(")")
            return inner
        if re.fullmatch(r"[xc]\d+", token):
            return Tree(token[0], (int(token[1:]),))
        if token[0].isdigit() and literals is not None:
            literals.append(float(token))
            return Tree("c", (-len(literals),))
        op = BY_NAME.get(token.upper())
        if op is None:
            raise ValueError(f"unknown name {token!r}")
        take("(")
        args = [whole()]
        while len(args) < op.arity:
            take(",")
            args.append(whole())
        take(")")
        return Tree(op.name, tuple(args))

    tree = whole()
    if at != len(tokens):
        raise ValueError(f"more follows in {text!r}")
    return tree


def lifted(text: str, constants: list[float]) -> tuple[list[Node], list[float]]:
    """Prefix nodes of a text with numbers in it, and its constants: numbers become constants with their
    value, and all are numbered by first occurrence."""
    literals: list[float] = []
    nodes, order, values = prefix(parse(text, literals)), {}, []
    for nt, _, ci in nodes:
        if nt == CONST and ci not in order:
            order[ci] = len(order)
            values.append(literals[-1 - ci] if ci < 0 else constants[ci])
    return [(nt, nv, order[ci] if nt == CONST else ci) for nt, nv, ci in nodes], values


def prefix(tree: Tree) -> list[Node]:
    if tree.op == "x":
        return [(VAR, float(tree.args[0]), -1)]
    if tree.op == "c":
        return [(CONST, 0.0, tree.args[0])]
    op = BY_NAME[tree.op]
    return [(UNARY if op.arity == 1 else BINARY, float(op.code), -1), *(n for a in tree.args for n in prefix(a))]


def from_prefix(nodes: list[Node]) -> Tree:
    """The tree of a prefix array; unknown opcodes and left-over nodes are errors."""
    stack: list[Tree] = []
    for nt, nv, ci in reversed([tuple(n) for n in nodes]):
        if nt == VAR:
            stack.append(Tree("x", (int(nv),)))
        elif nt == CONST:
            stack.append(Tree("c", (ci,)))
        elif nt in (UNARY, BINARY) and int(nv) in BY_CODE and BY_CODE[int(nv)].arity == (1 if nt == UNARY else 2):
            stack.append(Tree(BY_CODE[int(nv)].name, tuple(stack.pop() for _ in range(BY_CODE[int(nv)].arity))))
        else:
            raise ValueError(f"no such node: {(nt, nv, ci)}")
    if len(stack) != 1:
        raise ValueError("not one tree")
    return stack[0]


_SIGN = {"ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/", "POW": "^"}


def infix(tree: Tree) -> str:
    if tree.op in "xc":
        return f"{tree.op}{tree.args[0]}"
    args = [infix(a) for a in tree.args]
    return f"({args[0]} {_SIGN[tree.op]} {args[1]})" if tree.op in _SIGN else f"{tree.op.lower()}({', '.join(args)})"


def compiled(tree: Tree, x: Callable[[int], Column], c: Callable[[int], Column]) -> Column:
    """The tree as one column: whole-stage code, no Python at run time. Constants stay columns."""
    if tree.op == "x":
        return x(tree.args[0])
    if tree.op == "c":
        return c(tree.args[0])
    return BY_NAME[tree.op].column(*(compiled(a, x, c) for a in tree.args))


def _terms(tree: Tree) -> list[tuple[bool, list[Tree]]]:
    """The tree as a sum, products multiplied out: whether each term is negative, and its factors."""
    if tree.op in ("ADD", "SUB"):
        left, right = (_terms(a) for a in tree.args)
        return left + [(negative != (tree.op == "SUB"), factors) for negative, factors in right]
    if tree.op == "NEG":
        return [(not negative, factors) for negative, factors in _terms(tree.args[0])]
    if tree.op == "MUL":
        left, right = (_terms(a) for a in tree.args)
        return [(m != n, f + g) for m, f in left for n, g in right]
    if tree.op in "xc":
        return [(False, [tree])]
    return [(False, [Tree(tree.op, tuple(map(_expanded, tree.args)))])]


def _shape(t: Tree) -> str:
    return "c" if t.op == "c" else f"x{t.args[0]}" if t.op == "x" else f"{t.op}({','.join(map(_shape, t.args))})"


def _expanded(tree: Tree) -> Tree:
    """Products multiplied out; terms and factors in a fixed order that ignores constants' numbers:
    like constants of a product by the shapes of all products that they occur in."""
    terms, products = [], _terms(tree)
    shapes = [",".join(sorted(map(_shape, factors))) for _, factors in products]
    uses = {f.args[0]: sorted(s for s, (_, fs) in zip(shapes, products) if f in fs) for _, factors in products for f in factors if f.op == "c"}
    for negative, factors in products:
        factors = sorted(factors, key=lambda f: (_shape(f), uses[f.args[0]] if f.op == "c" else []))
        term = factors[0]
        for factor in factors[1:]:
            term = Tree("MUL", (term, factor))
        terms.append(Tree("NEG", (term,)) if negative else term)
    terms.sort(key=_shape)
    out = terms[0]
    for term in terms[1:]:
        out = Tree("ADD", (out, term))
    return out


def canonical(tree: Tree) -> Tree:
    """The normal form: products multiplied out, commuting operands ordered whatever their constants'
    numbers, constants numbered anew by first occurrence."""
    names: dict[int, int] = {}

    def renamed(t: Tree) -> Tree:
        if t.op == "c":
            return Tree("c", (names.setdefault(t.args[0], len(names)),))
        return t if t.op == "x" else Tree(t.op, tuple(map(renamed, t.args)))

    return renamed(_expanded(tree))


def has_variable(tree: Tree) -> bool:
    return tree.op == "x" or tree.op != "c" and any(map(has_variable, tree.args))


def inner_set(tree: Tree) -> set[int]:
    """The constants that stand where a variable makes them nonlinear: in a power, a denominator or
    the operand of a function that holds a variable too. Sums and products alone make none."""
    found: set[int] = set()

    def walk(t: Tree, inner: bool) -> None:
        if t.op == "c":
            found.update(t.args if inner else ())
        elif t.op in ("DIV", "LOOSE_DIV"):  # the denominator is a power
            walk(t.args[0], inner)
            walk(t.args[1], inner or has_variable(t.args[1]))
        elif t.op != "x":
            plain = t.op in ("ADD", "SUB", "MUL", "NEG", "LT", "GT", "LE", "GE")
            for a in t.args:
                walk(a, inner or not plain and has_variable(t))

    walk(tree, False)
    return found


def inner_constants(tree: Tree) -> int:
    return len(inner_set(tree))


# ---- structure, as columns over arrays of nodes


def arity(node: Column) -> Column:
    return F.when(node["nt"] <= CONST, 0).otherwise(node["nt"] - 1)


def depth_need(nodes: Column) -> Column:
    """The stack a right-to-left evaluation needs: a running sum's maximum."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(held: Column, node: Column) -> Column:
        now = held["now"] + 1 - arity(node)
        return F.struct(now.cast("int").alias("now"), F.greatest(held["top"], now).cast("int").alias("top"))

    return F.aggregate(F.reverse(nodes), start, step, lambda held: held["top"])


def tree_depth(nodes: Column) -> Column:
    """Levels of the tree: each node's depth goes on a stack of what its operands leave."""
    start = F.array().cast("array<int>")

    def step(stack: Column, node: Column) -> Column:
        n = arity(node)
        below = F.coalesce(F.array_max(F.slice(stack, 1, n)), F.lit(0))
        rest = F.slice(stack, n + 1, F.greatest(F.size(stack) - n, F.lit(0)))
        return F.concat(F.array(below + 1), rest)

    return F.aggregate(F.reverse(nodes), start, step, lambda stack: F.element_at(stack, 1))


def span(nodes: Column, at: Column) -> Column:
    """How many nodes the subtree at a place (from 0) has."""
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("n"))

    def step(held: Column, node: Column) -> Column:
        on = held["open"] > 0
        return F.struct(
            F.when(on, held["open"] - 1 + arity(node)).otherwise(held["open"]).cast("int").alias("open"),
            F.when(on, held["n"] + 1).otherwise(held["n"]).cast("int").alias("n"),
        )

    return F.aggregate(F.slice(nodes, at + 1, F.size(nodes)), start, step, lambda held: held["n"])


def constants_in_order(nodes: Column) -> Column:
    """Whether the constants' ranks run 0, 1, 2, ... in prefix order."""
    ranks = F.transform(F.filter(nodes, lambda n: n["nt"] == CONST), lambda n: n["ci"])
    return ranks == F.transform(ranks, lambda _, i: i)


def constant_count(nodes: Column) -> Column:
    return F.size(F.filter(nodes, lambda n: n["nt"] == CONST))


def has_divergent_loose(nodes: Column) -> Column:
    """Whether an operator node is LOOSE_POW or LOOSE_SQRT, which solvers read in another way."""
    return F.exists(nodes, lambda n: (n["nt"] >= UNARY) & n["nv"].isin(7.0, 28.0))


def opcode_name(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(op.name) for op in TABLE)), code.cast("int"))


def to_prefix(postfix: Column) -> Column:
    """Prefix order of nodes in postfix order (operands first, left before right): subtrees on a stack.

    Constants are numbered anew in the order of the result.
    """
    empty = F.array().cast(f"array<{NODES}>")

    def step(stack: Column, node: Column) -> Column:
        n = arity(node)
        left = F.size(stack) - n
        return F.concat(F.slice(stack, 1, left), F.array(F.concat(F.array(node), F.flatten(F.slice(stack, left + 1, n)))))

    nodes = F.aggregate(postfix, empty, step, lambda stack: F.element_at(stack, 1))
    return renumbered(nodes)


def to_postfix(nodes: Column) -> Column:
    """Postfix order of nodes in prefix order."""
    empty = F.array().cast(f"array<{NODES}>")

    def step(stack: Column, node: Column) -> Column:
        n = arity(node)
        rest = F.slice(stack, n + 1, F.greatest(F.size(stack) - n, F.lit(0)))
        return F.concat(F.array(F.concat(F.flatten(F.slice(stack, 1, n)), F.array(node))), rest)

    return F.aggregate(F.reverse(nodes), empty, step, lambda stack: F.element_at(stack, 1))


def renumbered(nodes: Column) -> Column:
    """Constants ranked by their place among the nodes."""
    before = lambda i: F.size(F.filter(F.slice(nodes, 1, i), lambda n: n["nt"] == CONST))
    return F.transform(nodes, lambda n, i: F.struct(n["nt"].alias("nt"), n["nv"].alias("nv"), F.when(n["nt"] == CONST, before(i)).otherwise(F.lit(-1)).alias("ci")))
