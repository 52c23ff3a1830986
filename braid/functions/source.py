"""One-line expressions to columns: a whitelist of syntax and functions, translated, never evaluated."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A
from .expr import clip, nz

SCALAR: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "log": F.log, "log1p": F.log1p, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil, "sign": F.signum,
    "square": lambda x: x * x, "maximum": F.greatest, "minimum": F.least, "clip": clip, "nan_to_num": nz, "where": lambda c, a, b: F.when(c, a).otherwise(b),
}
ARRAY: dict[str, Callable[..., Column]] = {
    "mean": A.mean, "sum": A.total, "std": A.std, "max": F.array_max, "min": F.array_min, "sort": F.sort_array, "diff": A.diffs, "head": A.head, "tail": A.tail,
    "slope": A.slope, "median": lambda a: A.quantile_sorted(F.sort_array(a), 0.5), "quantile": lambda a, q: A.quantile_sorted(F.sort_array(a), q), "mean_abs": A.mean_abs,
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / F.when(b != 0, b), ast.Pow: F.pow}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def translate(text: str, names: Mapping[str, Column]) -> Column:
    """The column of an expression over ``names``; ValueError for anything that is not on the lists."""
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"no expression: {error.msg}") from None

    def constant(node: ast.AST):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -constant(node.operand)
        raise ValueError("a number is needed here")

    def of(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=v) if type(v) in (int, float):
                return F.lit(float(v))
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](of(a), of(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](of(a), of(b))
            case ast.Call(func=ast.Name(id="clip"), args=[x, low, high], keywords=[]):
                return clip(of(x), constant(low), constant(high))
            case ast.Call(func=ast.Name(id="quantile"), args=[x, q], keywords=[]):
                return ARRAY["quantile"](of(x), constant(q))
            case ast.Call(func=ast.Name(id="ones" | "zeros" as name), args=[n], keywords=[]):
                return F.array_repeat(F.lit(float(name == "ones")), int(constant(n)))
            case ast.Call(func=ast.Name(id="full"), args=[n, v], keywords=[]):
                return F.array_repeat(of(v), int(constant(n)))
            case ast.Call(func=ast.Name(id="linspace"), args=[a, b, n], keywords=[]):
                first, last, n = constant(a), constant(b), int(constant(n))
                return F.array(*(F.lit(first + (last - first) * i / max(n - 1, 1)) for i in range(n)))
            case ast.Call(func=ast.Name(id="concatenate"), args=[ast.List(elts=parts) | ast.Tuple(elts=parts)], keywords=[]) if parts:
                return F.concat(*map(of, parts))
            case ast.Call(func=ast.Name(id="cumsum"), args=[x], keywords=[]):
                a = of(x)
                return F.transform(a, lambda _, i: F.aggregate(F.slice(a, F.lit(1), i + 1), F.lit(0.0), lambda t, v: t + v))
            case ast.Call(func=ast.Name(id="asarray"), args=[x], keywords=[]):
                return of(x)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in SCALAR or name in ARRAY:
                return (SCALAR.get(name) or ARRAY[name])(*map(of, args))
        raise ValueError(f"not allowed: {ast.unparse(node)}")

    return of(tree)


class _Plain(ast.NodeTransformer):
    """``values["a"]`` and ``np.f(...)`` as plain names."""

    def visit_Subscript(self, node: ast.Subscript) -> ast.AST:
        if isinstance(node.value, ast.Name) and node.value.id in ("values", "inputs", "globals") and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return ast.Name(node.slice.value, ast.Load())
        return self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> ast.AST:
        if isinstance(node.value, ast.Name) and node.value.id in ("np", "math"):
            return ast.Name(node.attr, ast.Load())
        return self.generic_visit(node)


def source_parts(text: str) -> list[str]:
    """The expressions of a source: itself, the elements of a list, or the body of ``lambda ctx, values:``, in which parents are ``values["name"]``."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"no expression: {error.msg}") from None
    if isinstance(tree, ast.Lambda):
        if [a.arg for a in tree.args.args] != ["ctx", "values"] or tree.args.defaults or tree.args.kwonlyargs or tree.args.vararg or tree.args.kwarg:
            raise ValueError("a source is a lambda of ctx and values")
        tree = tree.body
    tree = ast.fix_missing_locations(_Plain().visit(tree))
    return [ast.unparse(e) for e in (tree.elts if isinstance(tree, ast.List | ast.Tuple) else [tree])]


def ground_truth(op: str, columns: list[Column], **how) -> Column:
    """The operations that generated tasks are made of."""
    a = columns[0]
    b = columns[1] if len(columns) > 1 else None
    made: dict[str, Callable[[], Column]] = {
        "multiply": lambda: a * b,
        "difference": lambda: a - b,
        "sin": lambda: F.sin(how.get("scale", 1.0) * a),
        "tanh": lambda: F.tanh(how.get("scale", 1.0) * a),
        "square": lambda: a * a,
        "sum_squares": lambda: sum((c * c for c in columns[1:]), a * a),
        "log1p_abs": lambda: F.log1p(F.abs(a)),
        "indicator_gt": lambda: (a > how.get("threshold", 0.0)).cast("double"),
        "safe_ratio": lambda: a / (how.get("offset", 1.0) + F.abs(b)),
        "weighted_sum": lambda: sum((w * c for w, c in zip(how["weights"][1:], columns[1:], strict=True)), how["weights"][0] * a),
    }
    if op not in made:
        raise ValueError(f"unknown operation {op!r}; known: {sorted(made)}")
    return made[op]()
