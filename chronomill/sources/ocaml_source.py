"""A scanner for OCaml and what it shows of bindings, calls, decisions and comments.

Every ``let`` or ``and`` binding is a function. A binding ends before its ``in``, the next ``and`` of the same ``let``,
or, where no ``in`` belongs to it, before the next item of the structure. This reads the token stream, not a grammar.
"""

from __future__ import annotations

import re

from .entities import Analysis, Function, Places, Token

# Keywords (the words that are operators among them) and the operators that aren't built of symbols alone.
KEYWORDS = frozenset(
    "and as assert begin class constraint do done downto effect else end exception external false for fun function functor if in include inherit initializer"
    " lazy let match method module mutable new nonrec object of open or private rec sig struct then to true try type val virtual when while with"
    " mod land lor lxor lsl lsr asr".split()
)
OPEN = {"(": ")", "[": "]", "{": "}", "begin": "end", "struct": "end", "sig": "end", "object": "end", "do": "done"}
ITEMS = frozenset("let type module open exception external include class val end".split())
PUNCTUATION = ["[@@@", "[@@", "[%%", "{<", ">}", "[<", "[>", "[|", "|]", ">]", "[@", "[%", ";;", "..", "(", ")", "[", "]", "{", "}", ",", ";", ".", ":", "?", "'", "`", "~"]
FIXED = ["->", "<-", ":=", "::", ":>", "&&", "||"]

SCAN = re.compile(
    r"(?P<space>\s+)|(?P<comment>\(\*(?!\)))|(?P<string>\"(?:\\.|[^\"\\])*\")|(?P<quoted>\{(?:%%?[\w.]+\s*)?(?P<tag>[a-z_]*)\|.*?\|(?P=tag)\})"
    r"|(?P<char>'(?:[^'\\\n]|\\(?:[\\'\"ntbr ]|[0-9]{3}|x[0-9a-fA-F]{2}|o[0-7]{3}))')"
    r"|(?P<number>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[oO][0-7_]+|0[bB][01_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)[g-zG-Z]?)"
    r"|(?P<label>[~?][a-z_][\w']*:(?![:=>]))|(?P<letop>(?:let|and)[$&*+\-/<=>@^|.!?%~:]+)|(?P<word>[^\W\d][\w']*)"
    r"|(?P<fixed>" + "|".join(re.escape(x) for x in FIXED) + r")(?![!$%&*+\-./:<=>?@^|~])"
    r"|(?P<prefix>![!$%&*+\-./:<=>?@^|~#]*|[?~][!$%&*+\-./:<=>?@^|~#]+)|(?P<hash>#[!$%&*+\-./:<=>?@^|~#]*)"
    r"|(?P<punct>" + "|".join(re.escape(p) for p in PUNCTUATION if p not in (".", ":", "?", "~")) + r")"
    r"|(?P<infix>[$&*+\-/<=>@^|%][!$%&*+\-./:<=>?@^|~#]*)|(?P<mark>[.:?~])|(?P<other>.)",
    re.S,
)
ESCAPE = re.compile(r"\\(?:([\\'\"ntbr ])|([0-9]{3})|x([0-9a-fA-F]{2})|o([0-7]{3})|u\{([0-9a-fA-F]+)\}|\n[ \t]*)")


def decoded(body: str) -> str:
    """The content of a string literal."""

    def one(m: re.Match) -> str:
        if m[1]:
            return {"n": "\n", "t": "\t", "b": "\b", "r": "\r"}.get(m[1], m[1])
        for group, base in ((2, 10), (3, 16), (4, 8), (5, 16)):
            if m[group]:
                return chr(int(m[group], base))
        return ""

    return ESCAPE.sub(one, body.replace("\r\n", "\n"))


def comment_end(text: str, at: int) -> int:
    """The end of the comment that starts at ``at``; comments nest, and strings in them hide what looks like an end."""
    depth, i = 0, at
    for m in re.compile(r"\(\*|\*\)|\"(?:\\.|[^\"\\])*\"", re.S).finditer(text, at):
        depth += {"(*": 1, "*)": -1}.get(m[0], 0)
        i = m.end()
        if depth == 0:
            return i
    raise ValueError("a comment doesn't end")


def scan(text: str) -> list[Token]:
    places, out, at = Places(text), [], 0
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else len(text)
    while at < len(text):
        m = SCAN.match(text, at)
        kind, end, word = m.lastgroup, m.end(), m[0]
        if kind == "tag":
            kind = "quoted"
        if kind == "comment":
            end = comment_end(text, at)
            word = text[at:end]
        elif kind == "string":
            kind, word = "literal", decoded(word[1:-1])
        elif kind == "quoted":
            kind, word = "literal", word[word.index("|") + 1 : word.rindex("|")]
        elif kind in ("char", "number"):
            kind = "literal"
        elif kind == "word":
            kind = "keyword" if word in KEYWORDS else "ident"
        elif kind == "mark":
            kind = "punct"
        elif kind in ("letop", "fixed", "prefix", "hash", "infix"):
            kind = "operator"
        elif kind == "other":
            raise ValueError(f"a stray {word!r} at line {places.line(at)}")
        if kind != "space":
            out.append(Token(kind, word, at, end, places.line(at), places.line(end - 1)))
        at = end
    return out


def ends_of_lets(t: list[Token]) -> dict[int, int]:
    """For each let that has one, the index of its in."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i, x in enumerate(t):
        if x.kind not in ("keyword", "punct"):
            continue
        if x.text in OPEN or x.text.startswith(("[", "{")) and x.kind == "punct":
            stack.append(("open", i))
        elif x.text in ("end", "done") or x.kind == "punct" and x.text[-1] in ")]}":
            while stack and stack.pop()[0] != "open":
                pass
        elif x.text == "let":
            stack.append(("let", i))
        elif x.text == "in":
            while stack and stack[-1][0] == "let":
                out[stack.pop()[1]] = i
                break
    return out


def pattern_weight(t: list[Token], first: int, last: int) -> int:
    """The arity of a tuple pattern, in parentheses or not; 1 for any other."""
    while first < last and t[first].text == "(" and t[last - 1].text == ")" and _partner(t, first) == last - 1:
        first, last = first + 1, last - 1
    depth = commas = 0
    for x in t[first:last]:
        if x.kind == "punct":
            depth += x.text[0] in "([{"
            depth -= x.text[-1] in ")]}" and x.text[0] not in "([{"
            commas += x.text == "," and depth == 0
    return commas + 1


def _partner(t: list[Token], i: int) -> int:
    depth = 0
    for j in range(i, len(t)):
        if t[j].kind == "punct":
            depth += t[j].text[0] in "([{"
            depth -= t[j].text[-1] in ")]}" and t[j].text[0] not in "([{"
            if depth == 0:
                return j
    return len(t)


def _atom_end(x: Token) -> bool:
    return x.kind in ("ident", "literal") or x.text in (")", "]", "}", "|]", ">}", "end", "true", "false")


def _argument(x: Token) -> bool:
    return x.kind in ("ident", "literal", "label") or x.text in ("(", "[", "{", "[|", "{<", "begin", "true", "false", "~", "?", "`") or x.kind == "operator" and x.text[0] == "!" and x.text != "!="


class _Frame:
    def __init__(self, kind: str, index: int):
        self.kind, self.index = kind, index  # open, let, wait (for with), arms
        self.function: Function | None = None
        self.pattern = False
        self.first = index + 1
        self.guard: int | None = None


def analyse(text: str) -> Analysis:
    out = Analysis()
    try:
        out.tokens = scan(text)
    except ValueError as e:
        out.error = str(e)
        return out
    places = Places(text)
    out.comments = [(x.start_line, x.end_line, x.text) for x in out.tokens if x.kind == "comment"]
    t = [x for x in out.tokens if x.kind != "comment"]
    has_in = ends_of_lets(t)
    stack: list[_Frame] = []
    heads: set[int] = set()  # tokens of binding heads and match patterns, which hold no calls

    def innermost() -> Function | None:
        return next((f.function for f in reversed(stack) if f.kind == "let" and f.function), None)

    def finish(frame: _Frame, last: int) -> None:
        if frame.kind == "let" and frame.function:
            end = t[max(last, 0)]
            frame.function.end_line, frame.function.end = end.end_line, places.place(end.end)
            frame.function = None

    def close_to(kinds: tuple[str, ...], last: int) -> _Frame | None:
        """Ends frames down to one of these kinds, not past an opening."""
        while stack and stack[-1].kind not in kinds and stack[-1].kind != "open":
            finish(stack.pop(), last)
        return stack[-1] if stack and stack[-1].kind in kinds else None

    def begin_binding(frame: _Frame, i: int) -> None:
        """A binding starts at token i: its head runs to the = at its own depth."""
        while i < len(t) and (t[i].text in ("rec", "nonrec", "open", "module", "exception") or t[i].text in ("%", "[%")):
            if t[i].text in ("open", "module", "exception"):
                return
            i = _partner(t, i) + 1 if t[i].text == "[%" else i + 1
        if i >= len(t):
            return
        last = _partner(t, i) if t[i].text in ("(", "[", "{") else i
        j, depth = i, 0
        while j < len(t) and not (depth == 0 and t[j].text in ("=", "in", ";;")):
            if t[j].kind == "punct":
                depth += t[j].text[0] in "([{"
                depth -= t[j].text[-1] in ")]}" and t[j].text[0] not in "([{"
            heads.add(j)
            if depth == 0 and t[j].text == "," and j > i:
                last = None
            if depth < 0:
                break
            j += 1
        if last is None:
            last = j - 1
        name = text[t[i].start : t[min(last, len(t) - 1)].end]
        f = Function(name, *places.place(t[i].start), t[i].start_line, t[-1].end_line, places.place(t[i].start), places.place(t[-1].end))
        out.functions.append(f)
        frame.function = f

    for i, x in enumerate(t):
        f = innermost()
        if x.kind == "keyword" and x.text in ITEMS and x.text != "end" or x.text == ";;":
            local = x.text == "let" and i in has_in or x.text in ("open", "module", "exception") and i and t[i - 1].text == "let"
            in_expression = x.text in ("type", "val", "class", "module") and i and t[i - 1].text in (":", "of", "(", "object", "with")
            if not local and not in_expression:
                close_to((), i - 1)
        if x.text == "let" and x.kind == "keyword":
            stack.append(_Frame("let", i))
            begin_binding(stack[-1], i + 1)
            continue
        if x.text == "and" and x.kind == "keyword":
            frame = close_to(("let",), i - 1)
            if frame:
                finish(frame, i - 1)
                begin_binding(frame, i + 1)
            continue
        if x.text == "in" and x.kind == "keyword":
            while stack and stack[-1].kind != "open":
                frame = stack.pop()
                finish(frame, i - 1)
                if frame.kind == "let" and has_in.get(frame.index) == i:
                    break
            continue
        if x.kind in ("keyword", "punct") and (x.text in OPEN or x.kind == "punct" and x.text[0] in "[{"):
            stack.append(_Frame("open", i))
        elif x.text in ("end", "done") and x.kind == "keyword" or x.kind == "punct" and x.text[-1] in ")]}" and x.text[0] not in "([{":
            close_to((), i - 1)
            if stack:
                stack.pop()
        top = stack[-1] if stack else None
        if x.kind == "keyword":
            if x.text in ("match", "try"):
                stack.append(_Frame("wait", i))
                if f:
                    f.match_constructs += x.text == "match"
                    f.control_flow += x.text == "try"
            elif x.text in ("with", "function"):
                if x.text == "with":
                    frame = next((g for g in reversed(stack) if g.kind in ("wait", "open")), None)
                    if frame is None or frame.kind == "open":
                        continue
                    close_to(("wait",), i - 1)
                    stack.pop()
                arms = _Frame("arms", i)
                arms.pattern = True
                arms.first = i + 2 if i + 1 < len(t) and t[i + 1].text == "|" else i + 1
                stack.append(arms)
            elif x.text == "when" and top and top.kind == "arms" and top.pattern:
                top.guard = i
            elif x.text in ("if", "for", "while") and f:
                f.control_flow += 1
            elif x.text == "or" and f:
                f.boolean_operators += 1
        elif x.kind == "operator":
            if x.text == "->" and top and top.kind == "arms" and top.pattern:
                stop = top.guard if top.guard is not None else i
                heads.update(range(top.first, stop))
                if f:
                    f.match_arms += pattern_weight(t, top.first, stop) + (top.guard is not None)
                top.pattern, top.guard = False, None
            elif x.text == "|" and not (top and top.kind == "arms" and top.pattern):
                frame = close_to(("arms",), i - 1)
                if frame:
                    frame.pattern, frame.first, frame.guard = True, i + 1, None
            elif x.text in ("&&", "&", "||") and f:
                f.boolean_operators += 1
        # A call: an operand that starts here, stands where no argument can, and has an argument after it.
        if f and i not in heads and (x.kind == "ident" or x.text == "(") and not (i and (_atom_end(t[i - 1]) or t[i - 1].text in (".", "~", "?", "`", "fun", "as", "of", ":", "for", "type", "method", "new") or t[i - 1].kind == "label")):
            first, last = i, i
            if x.text == "(":
                last = _partner(t, i)
                inner = (i + 1, last - 1)
            else:
                while last + 2 < len(t) and t[last + 1].text == "." and t[last + 2].kind == "ident":
                    last += 2
                inner = (i, last)
            if last + 1 < len(t) and _argument(t[last + 1]) and inner[0] <= inner[1] and not (t[i - 1].text == "let" if i else False):
                f.calls.append((text[t[inner[0]].start : t[inner[1]].end], *places.place(t[inner[0]].start)))
    while stack:
        finish(stack.pop(), len(t) - 1)
    return out
