"""A scanner for Go and what it shows of functions, calls, decisions and comments."""

from __future__ import annotations

import re

from .entities import Analysis, Function, Places, Token

# The keywords and operators of the language.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
OPERATORS = ["<<=", ">>=", "&^=", "...", "&&", "||", "<-", "++", "--", "==", "!=", "<=", ">=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "=", "!", "~", "(", ")", "[", "]", "{", "}", ",", ";", ":", "."]

SCAN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<string>\"(?:\\.|[^\"\\\n])*\")|(?P<char>'(?:\\.|[^'\\\n])+')"
    r"|(?P<number>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?)"
    r"|(?P<word>[^\W\d]\w*)|(?P<operator>" + "|".join(re.escape(o) for o in OPERATORS) + r")|(?P<other>.)",
    re.S,
)
PAIRS = {"(": ")", "[": "]", "{": "}"}


def scan(text: str) -> list[Token]:
    """All tokens but the automatic semicolons, comments included."""
    places, out = Places(text), []
    for m in SCAN.finditer(text):
        kind = m.lastgroup
        if kind in ("space", "other"):
            continue
        if kind == "word":
            kind = "keyword" if m[0] in KEYWORDS else "ident"
        elif kind in ("raw", "string", "char", "number"):
            kind = "literal"
        out.append(Token(kind, m[0], m.start(), m.end(), places.line(m.start()), places.line(m.end() - 1)))
    return out


def closers(tokens: list[Token]) -> dict[int, int]:
    """For each bracket the index of its partner."""
    out, stack = {}, []
    for i, t in enumerate(tokens):
        if t.text in PAIRS and t.kind == "operator":
            stack.append(i)
        elif t.kind == "operator" and t.text in PAIRS.values() and stack and PAIRS[tokens[stack[-1]].text] == t.text:
            j = stack.pop()
            out[i], out[j] = j, i
    return out


def signature_end(tokens: list[Token], pair: dict[int, int], i: int) -> int | None:
    """From a parameter list at i: the index of the body's brace, or None if the line ends without one."""
    i = pair.get(i, len(tokens)) + 1
    while i < len(tokens):
        t = tokens[i]
        if t.text == "{":
            if tokens[i - 1].text in ("interface", "struct"):
                i = pair.get(i, len(tokens)) + 1
                continue
            return i
        if t.text in ("(", "["):
            i = pair.get(i, len(tokens))
        elif t.start_line > tokens[i - 1].end_line or t.text in (";", ")", ",", "}", "]", "=", ":="):
            return None
        i += 1
    return None


def primary_start(tokens: list[Token], pair: dict[int, int], bodies: dict[int, int], i: int) -> int | None:
    """The first token of the operand that ends at i, going back over selectors, indexes, calls and function literals."""
    while i >= 0:
        t = tokens[i]
        if t.text == "}":
            return bodies.get(pair.get(i, -1))
        if t.text in (")", "]") and i in pair:
            j = pair[i]
            before = tokens[j - 1] if j else None
            if before is not None and (before.kind == "ident" or before.text in (")", "]")):
                i = j - 1
                continue
            return j
        if t.kind not in ("ident", "literal"):
            return None
        if i >= 2 and tokens[i - 1].text == "." and (tokens[i - 2].kind in ("ident", "literal") or tokens[i - 2].text in (")", "]", "}")):
            i -= 2
            continue
        return i
    return None


def analyse(text: str) -> Analysis:
    out = Analysis(tokens=scan(text))
    places = Places(text)
    out.comments = [(t.start_line, t.end_line, t.text) for t in out.tokens if t.kind == "comment"]
    tokens = [t for t in out.tokens if t.kind != "comment"]
    pair = closers(tokens)
    quiet: set[int] = set()  # parameter and result lists
    spans: list[tuple[int, int, Function]] = []
    bodies: dict[int, int] = {}  # from a body's brace to its func
    depth = 0
    for i, t in enumerate(tokens):
        if t.text == "func" and t.kind == "keyword":
            at, name = i + 1, None
            if depth == 0 and at < len(tokens) and tokens[at].text == "(" and at in pair and pair[at] + 1 < len(tokens) and tokens[pair[at] + 1].kind == "ident":
                quiet.add(at)
                at = pair[at] + 1
            if depth == 0 and at < len(tokens) and tokens[at].kind == "ident":
                name = tokens[at]
                at += 1
                if at < len(tokens) and tokens[at].text == "[" and at in pair:
                    at = pair[at] + 1
            if at >= len(tokens) or tokens[at].text != "(":
                continue
            body = signature_end(tokens, pair, at)
            if body is not None:
                bodies[body] = i
            stop = body if body is not None else pair.get(at, at) + 1
            quiet.update(k for k in range(at, stop) if tokens[k].text == "(")
            if name is not None:
                last = pair.get(body, len(tokens) - 1) if body is not None else pair.get(at, at)
                f = Function(name.text, *places.place(name.start), t.start_line, tokens[last].end_line, places.place(t.start), places.place(tokens[last].end))
                out.functions.append(f)
                spans.append((i, last, f))
        elif t.kind == "operator":
            depth += (t.text in PAIRS) - (t.text in PAIRS.values())
    for first, last, f in spans:
        for i in range(first, last + 1):
            t = tokens[i]
            if t.kind == "keyword":
                f.control_flow += t.text in ("if", "for")
                f.match_constructs += t.text in ("switch", "select")
                f.match_arms += t.text in ("case", "default")
            elif t.text in ("&&", "||"):
                f.boolean_operators += 1
            elif t.text == "(" and i not in quiet and i > first:
                start = primary_start(tokens, pair, bodies, i - 1)
                if start is None or tokens[i - 1].kind == "literal" or tokens[start].text == "[" or tokens[start - 1].text == "]":
                    continue  # the last two: a conversion to a slice or array type
                end = i - 1
                if tokens[start].text == "(" and pair.get(start) == end:
                    start, end = start + 1, end - 1
                if start <= end:
                    f.calls.append((text[tokens[start].start : tokens[end].end], *places.place(tokens[start].start)))
    return out
