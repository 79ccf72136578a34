"""Go source by its tokens: imports, functions, calls.

A file is lexed once, brackets are matched by a stack, and everything else is read off
the tokens and the matches. A file that is no Go (an open string or comment, brackets
that do not match, no package clause in front) has no structure.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: Keywords of the language, and those after which a line end does not end a statement.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDING = frozenset({"break", "continue", "fallthrough", "return"})
#: Tokens that add a branch.
BRANCHES = frozenset({"if", "for", "case", "default", "&&", "||"})

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)|(?P<raw>`[^`]*`)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<rune>'(?:[^'\\\n]|\\.)+')
    |(?P<word>[^\W\d]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<op>&&|\|\||\.\.\.|<-|\+\+|--|<<=?|>>=?|&\^=?|[-+*/%&|^<>=!:]=|/(?!\*)|[-+*%&|^<>=!:;,.~(){}\[\]])""",
    re.VERBOSE,
)
_CLOSES = {")": "(", "]": "[", "}": "{"}


class NotGo(ValueError):
    pass


class Token:
    __slots__ = ("at", "kind", "text")

    def __init__(self, kind: str, text: str, at: int):
        self.kind, self.text, self.at = kind, text, at


def tokens(code: str) -> list[Token]:
    """The tokens, with a `;` where a line end stands for one."""
    out: list[Token] = []
    at = 0

    def line_end() -> None:
        last = out[-1] if out else None
        if last and (last.kind in ("number", "string", "raw", "rune") or last.text in (")", "]", "}", "++", "--") or last.kind == "word" and (last.text not in KEYWORDS or last.text in _ENDING)):
            out.append(Token("op", ";", at))

    while at < len(code):
        m = _TOKEN.match(code, at)
        if m is None:
            raise NotGo(f"no token at {at}")
        kind = m.lastgroup
        if kind == "line" or kind == "comment" and "\n" in m[0]:
            line_end()
        elif kind not in ("space", "comment"):
            out.append(Token(kind, m[0], at))
        at = m.end()
    line_end()
    return out


def matches(found: list[Token]) -> dict[int, int]:
    """The other bracket of each bracket, by place."""
    out, stack = {}, []
    for k, t in enumerate(found):
        if t.kind != "op":
            continue
        if t.text in "([{":
            stack.append(k)
        elif t.text in _CLOSES:
            if not stack or found[stack[-1]].text != _CLOSES[t.text]:
                raise NotGo("brackets do not match")
            out[k] = stack.pop()
            out[out[k]] = k
    if stack:
        raise NotGo("a bracket is left open")
    return out


class File:
    """A lexed file and what is read off it."""

    def __init__(self, code: str):
        self.code = code
        self.t = tokens(code)
        self.other = matches(self.t)
        if not self.t or self.t[0].text != "package":
            raise NotGo("no package clause")
        self.lines = [m.end() for m in re.finditer("\n", code)]
        self.top = self._top()

    def _top(self) -> list[int]:
        """Places outside all brackets."""
        out, k = [], 0
        while k < len(self.t):
            out.append(k)
            k = self.other[k] + 1 if self.t[k].text in ("(", "[", "{") and k in self.other else k + 1
        return out

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ";"

    def name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "word" and self.t[k].text not in KEYWORDS

    def position(self, at: int) -> tuple[int, int]:
        """(line, byte column), from 1."""
        n = bisect_right(self.lines, at)
        start = self.lines[n - 1] if n else 0
        return n + 1, len(self.code[start:at].encode()) + 1

    def imports(self) -> list[tuple[str, str | None, int]]:
        """(path, alias, line)."""
        out = []
        for k in self.top:
            if self.text(k) != "import" or self.text(k - 1) != ";":
                continue
            stop = self.other[k + 1] if self.text(k + 1) == "(" else next((j for j in range(k, len(self.t)) if self.text(j) == ";"), len(self.t))
            for j in range(k + 1, stop):
                if self.t[j].kind in ("string", "raw"):
                    alias = self.text(j - 1) if self.name(j - 1) or self.text(j - 1) == "." else None
                    out.append((self.text(j).strip('"'), alias, self.position(self.t[j - (alias is not None)].at)[0]))
        return out

    def functions(self) -> list[tuple]:
        """(name, first line, last line, exported, branches + 1, parameter names, result types) of declared functions and methods."""
        out = []
        for k in self.top:
            if self.text(k) != "func" or self.text(k - 1) != ";":
                continue
            at = self.other[k + 1] + 1 if self.text(k + 1) == "(" else k + 1
            if not self.name(at):
                continue
            params = self.other[at + 1] + 1 if self.text(at + 1) == "[" else at + 1
            if self.text(params) != "(":
                continue
            end = results = self.other[params] + 1
            while end < len(self.t) and self.text(end) != ";":
                if self.text(end) == "{" and self.text(end - 1) not in ("interface", "struct"):
                    break
                end = self.other.get(end, end) + 1
            body = self.other[end] if self.text(end) == "{" else end - 1
            name = self.text(at)
            branches = sum(t.text in BRANCHES for t in self.t[k : body + 1] if t.kind in ("word", "op"))
            out.append((name, self.position(self.t[k].at)[0], self.position(self.t[body].at)[0], name[0].isupper(), 1 + branches, self._names(params), ", ".join(self._results(results, end))))
        return out

    def _split(self, start: int, stop: int) -> list[tuple[int, int]]:
        """The parts between commas."""
        out, first, k = [], start, start
        while k < stop:
            if self.text(k) == ",":
                out.append((first, k))
                first = k + 1
            k = self.other.get(k, k) + 1
        return [p for p in [*out, (first, stop)] if p[0] < p[1]]

    def _named(self, part: tuple[int, int]) -> bool:
        """Whether a part of a list is a name with a type."""
        a, b = part
        if b - a < 2 or not self.name(a) or self.text(a + 1) == ".":
            return False
        return self.text(a + 1) != "[" or self.other[a + 1] + 1 < b

    def _fields(self, bracket: int) -> list[tuple[list[str], int, int]]:
        """(names, type from, to) of the fields in a list."""
        parts = self._split(bracket + 1, self.other[bracket])
        if not any(map(self._named, parts)):
            return [([], a, b) for a, b in parts]
        out, names = [], []
        for a, b in parts:
            names.append(self.text(a))
            if self._named((a, b)):
                out.append((names, a + 1, b))
                names = []
        return out

    def _names(self, bracket: int) -> list[str]:
        return [n for names, _, _ in self._fields(bracket) for n in names]

    def _results(self, start: int, stop: int) -> list[str]:
        if start >= stop:
            return []
        if self.text(start) == "(" and self.other[start] == stop - 1:
            return [self._type(a, b) for _, a, b in self._fields(start)]
        return [self._type(start, stop)]

    def _type(self, a: int, b: int) -> str:
        """A type as text; only names, pointers, arrays, maps and empty interfaces have one."""
        if b - a == 1 and self.name(a):
            return self.text(a)
        if b - a == 3 and self.name(a) and self.text(a + 1) == ".":
            return f"{self.text(a)}.{self.text(a + 2)}"
        if self.text(a) == "*":
            return f"*{self._type(a + 1, b)}"
        if self.text(a) == "[":
            return f"[]{self._type(self.other[a] + 1, b)}"
        if self.text(a) == "map":
            return f"map[{self._type(a + 2, self.other[a + 1])}]{self._type(self.other[a + 1] + 1, b)}"
        return "interface{}" if self.text(a) == "interface" else "unknown"

    def _operand(self, k: int) -> int:
        """Where the operand begins that ends at a place."""
        while True:
            if self.text(k) in _CLOSES:
                k = self.other[k]
                if self.name(k - 1) or self.text(k - 1) in _CLOSES:
                    k -= 1
                    continue
                return k - 1 if self.text(k - 1) == "func" else k
            if self.text(k - 1) == "." and k > 1:
                k -= 2
                continue
            return k

    def calls(self) -> list[tuple[str, str | None, int, int, bool]]:
        """(name, receiver, line, column, whether it is selected from something) of calls by name.

        The receiver is only given where it is a plain name; the place is where the whole
        expression begins. Conversions to named types look the same and count, too.
        """
        out = []
        for k, t in enumerate(self.t):
            if t.text != "(" or t.kind != "op" or not self.name(k - 1):
                continue
            name = k - 1
            method = self.text(name - 1) == "."
            first = self._operand(name - 2) if method else name
            before = self.text(first - 1)
            # a declared function, a method of an interface, a conversion to an array, map or channel
            if before in ("func", "]", "chan") or before == ")" and self.text(self.other[first - 1] - 1) == "func" and self.text(self.other[first - 1] - 2) == ";":
                continue
            if not method and before in (";", "{") and self._interface(name):
                continue
            receiver = self.text(name - 2) if method and first == name - 2 and self.name(name - 2) else None
            out.append((self.text(name), receiver, *self.position(self.t[first].at), method))
        return sorted(out, key=lambda c: (c[2], c[3]))

    def _interface(self, k: int) -> bool:
        """Whether a place lies directly in the braces of an interface."""
        k -= 1
        while k >= 0 and self.text(k) not in ("{", "(", "["):
            k = (self.other[k] if self.text(k) in _CLOSES else k) - 1
        return k > 0 and self.text(k) == "{" and self.text(k - 1) == "interface"


def structure(code: str, kinds: tuple = ("imports", "functions", "calls")) -> dict | None:
    """Imports, functions and calls of a file, or some of them; None if it is no Go."""
    try:
        f = File(code)
        return {k: getattr(f, k)() for k in kinds}
    except NotGo:
        return None
