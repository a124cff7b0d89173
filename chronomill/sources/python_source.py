"""Functions, calls, decisions and comments of Python sources, by the standard library's parser and tokenizer."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from .entities import Analysis, Function

DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)


class _Walk(ast.NodeVisitor):
    """Decisions and calls go to the innermost function; decorators belong to what surrounds it."""

    def __init__(self, text: str, out: Analysis, compat: bool):
        self.text, self.out, self.compat = text, out, compat
        self.lines = text.split("\n")
        self.stack: list[Function] = []

    def visit_function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        head = self.lines[node.lineno - 1].encode()[node.col_offset :]
        match = re.match(rb"(?:async\s+)?def\s+", head)
        column = node.col_offset + (match.end() if match else 0) + 1
        f = Function(node.name, node.lineno, column, node.lineno, node.end_lineno, (node.lineno, node.col_offset + 1), (node.end_lineno, node.end_col_offset + 1))
        self.out.functions.append(f)
        self.stack.append(f)
        for field, value in ast.iter_fields(node):
            if field != "decorator_list":
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST):
                        self.visit(child)
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_function

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.docstrings(node)
        if self.stack:
            f = self.stack[-1]
            if isinstance(node, DECISIONS):
                f.control_flow += 1
            elif isinstance(node, ast.BoolOp):
                f.boolean_operators += len(node.values) - 1
            elif isinstance(node, ast.Match):
                f.match_constructs += 1
                f.match_arms += len(node.cases)
            elif isinstance(node, ast.Call):
                target = node.func
                f.calls.append((ast.get_source_segment(self.text, target) or "", target.lineno, target.col_offset + 1))
        super().generic_visit(node)

    def docstrings(self, node: ast.AST) -> None:
        for child in node.body:
            if isinstance(child, ast.Expr) and (self.compat or isinstance(child.value, ast.Constant) and isinstance(child.value.value, str)):
                self.out.comments.append((child.lineno, child.end_lineno, ast.get_source_segment(self.text, child) or ""))

    def visit_Module(self, node: ast.Module) -> None:
        self.generic_visit(node)


def analyse(text: str, compat: bool = False) -> Analysis:
    """Any expression that stands as a statement counts as a comment with ``compat``, else only strings do."""
    out = Analysis()
    try:
        tree = ast.parse(text)
        walk = _Walk(text, out, compat)
        walk.visit(tree)
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                walk.docstrings(node)
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                out.comments.append((token.start[0], token.end[0], token.string))
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError) as e:
        out.error = f"{type(e).__name__}: {e}"
    out.comments.sort()
    return out
