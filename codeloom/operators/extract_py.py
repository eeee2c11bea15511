"""Symbols, imports and calls of one Python file, by the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

Symbols = list[tuple[str, str, int, int, str | None]]
Imports = list[tuple[str, int, int, str | None, str | None, bool]]
Calls = list[tuple[str, int, str | None, bool]]

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Statements that are looked at and not entered; all others only give way to what they contain.
_OPAQUE = (*_DEFS, ast.ClassDef, ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom)


def parsed(source: str) -> ast.Module | None:
    """The tree, or None for a file that does not parse. One too deeply nested counts as broken, not as an error of the job."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def outer_statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Definitions, assignments and imports outside of functions and classes, in source order; those under if, try, with and loops too."""
    todo = list(ast.iter_child_nodes(tree))[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, _OPAQUE):
            yield node
        else:
            todo += list(ast.iter_child_nodes(node))[::-1]


def extract(tree: ast.Module) -> tuple[Symbols, Imports, Calls]:
    symbols: Symbols = []
    imports: Imports = []

    def symbol(name: str, kind: str, node: ast.AST, parent: str | None = None) -> None:
        symbols.append((name, kind, node.lineno, node.end_lineno or node.lineno, parent))

    for node in outer_statements(tree):
        if isinstance(node, _DEFS):
            symbol(node.name, "function", node)
        elif isinstance(node, ast.ClassDef):
            symbol(node.name, "class", node)
            for member in node.body:
                if isinstance(member, _DEFS):
                    symbol(member.name, "method", member, node.name)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for target in targets:
                if isinstance(target, ast.Name):
                    symbol(target.id, "variable", node)
        elif isinstance(node, ast.Import):
            imports += [(alias.name, 0, node.lineno, None, None, False) for alias in node.names]
        elif [alias.name for alias in node.names] == ["*"]:
            imports.append((node.module or "", node.level, node.lineno, None, None, True))
        else:
            imports += [(node.module or "", node.level, node.lineno, a.asname or a.name, a.name, False) for a in node.names]
    return symbols, imports, list(_calls(tree))


def _calls(tree: ast.Module) -> Iterator[tuple[str, int, str | None, bool]]:
    """name(...) and self.name(...) anywhere; the containing symbol is the outermost function or class."""
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, outer = todo.pop()
        if isinstance(node, ast.Call):
            match node.func:
                case ast.Name(id=name):
                    yield name, node.lineno, outer, False
                case ast.Attribute(value=ast.Name(id="self"), attr=name):
                    yield name, node.lineno, outer, True
        inner = node.name if outer is None and isinstance(node, (*_DEFS, ast.ClassDef)) else outer
        todo += [(child, inner) for child in ast.iter_child_nodes(node)][::-1]
