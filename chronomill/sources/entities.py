"""What the source analysers give for one text."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Function:
    """Lines and byte columns count from 1; ``line`` and ``column`` are those of the name."""

    name: str
    line: int
    column: int
    start_line: int
    end_line: int
    start: tuple[int, int]
    end: tuple[int, int]
    control_flow: int = 0
    match_constructs: int = 0
    match_arms: int = 0
    boolean_operators: int = 0
    calls: list[tuple[str, int, int]] = field(default_factory=list)

    @property
    def cyclomatic(self) -> int:
        return 1 + self.control_flow + self.match_arms + self.boolean_operators

    @property
    def cyclomatic_single(self) -> int:
        return 1 + self.control_flow + self.match_constructs + self.boolean_operators


@dataclass
class Token:
    """kind: ident, literal, label, keyword, operator, punct or comment."""

    kind: str
    text: str
    start: int
    end: int
    start_line: int
    end_line: int


@dataclass
class Analysis:
    functions: list[Function] = field(default_factory=list)
    comments: list[tuple[int, int, str]] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    error: str | None = None


class Places:
    """Byte lines and columns of character offsets, and back."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def place(self, at: int) -> tuple[int, int]:
        line = self.line(at)
        return line, len(self.text[self.starts[line - 1] : at].encode()) + 1

    def offset(self, line: int, column: int) -> int | None:
        """The character offset of a place, None if the text has no such place."""
        if not 1 <= line <= len(self.starts):
            return None
        start = self.starts[line - 1]
        end = self.starts[line] if line < len(self.starts) else len(self.text)
        head = self.text[start:end].encode()[: column - 1]
        return start + len(head.decode(errors="ignore")) if column - 1 <= len(self.text[start:end].encode()) else None
