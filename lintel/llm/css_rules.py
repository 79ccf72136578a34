"""Which elements a page's style sheets hide: a small cascade for `display` and `visibility`.

Sheets are read rule by rule, for a screen of VIEWPORT pixels: blocks of `@media`
for other media are skipped, `@supports` and `@layer` are taken for granted, other
at-rules are left out. Selectors may have types, classes, ids, attributes, the
structural pseudo-classes below, `:not`, `:is` and `:where`, and all four
combinators; a selector with anything else (`:hover`, `::before`) matches nothing
here, for no pointer hovers and boxes that a sheet makes have no text of the page.
The winner is found as in the standard: important before normal, the style
attribute before sheets, then the higher specificity, then the later rule.
"""

from __future__ import annotations

import re

VIEWPORT = (1280, 720)
PROPERTIES = ("display", "visibility")

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NAME = r"(?:[-\w\u0080-\U0010ffff]|\\[0-9a-fA-F]{1,6}[ \t\n]?|\\[^\n0-9a-fA-F])+"
_PART = re.compile(rf"([.#])({_NAME})|\[\s*({_NAME})\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|({_NAME}))\s*([iIsS]?)\s*)?\]|(::?)({_NAME})(?:\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\))?|(\*|{_NAME})")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_STOP = re.compile(r"[;{}\"']")
_FEATURE = re.compile(r"\(\s*([a-z-]+)\s*(?::\s*([^()]+?)\s*)?\)")
_LENGTH = re.compile(r"([0-9.]+)(px|em|rem)?")


def unescaped(name: str) -> str:
    """A name without its backslashes."""
    if "\\" not in name:
        return name
    code = lambda m: chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "�"
    return re.sub(r"\\(.)", r"\1", re.sub(r"\\([0-9a-fA-F]{1,6})[ \t\n]?", code, name), flags=re.S)


def declarations(body: str) -> dict[str, tuple[bool, str]]:
    """property: (important, value) of the properties that matter; the last counts, important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if name in PROPERTIES and colon:
            value, mark, _ = value.strip().lower().partition("!")
            important = bool(mark)
            if important or not out.get(name, (False,))[0]:
                out[name] = (important, value.strip())
    return out


def _feature(name: str, value: str | None) -> bool:
    """Whether a media feature holds on the screen."""
    size = dict(zip(("width", "height"), VIEWPORT))
    for prefix, holds in (("min-", lambda a, b: a >= b), ("max-", lambda a, b: a <= b), ("", lambda a, b: a == b)):
        side = name.removeprefix(prefix).removeprefix("device-")
        if name.startswith(prefix) and side in size:
            m = _LENGTH.fullmatch(value or "")
            return value is None or bool(m) and holds(size[side], float(m[1]) * (16 if m[2] in ("em", "rem") else 1))
    fixed = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "none", "pointer": "none", "scripting": "none"}
    if name in fixed:
        return value == fixed[name] if value is not None else fixed[name] not in ("none", "no-preference")
    return name == "color" and value is None


def on_screen(query: str) -> bool:
    """Whether a media query list applies to the screen."""
    for one in query.lower().split(","):
        words = _FEATURE.sub(" ", one).split()
        turned = words[:1] == ["not"]
        kinds = [w for w in words if w not in ("not", "only", "and", "or")]
        good = all(k in ("all", "screen") for k in kinds) and all(_feature(m[1], m[2]) for m in _FEATURE.finditer(one))
        if good != turned:
            return True
    return not query.strip()


def _block(css: str, at: int) -> int:
    """Where the block that opens before `at` ends (after its brace)."""
    depth = 1
    while depth:
        m = _STOP.search(css, at)
        if not m:
            return len(css)
        at = m.end()
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
        elif m[0] in "\"'":
            close = css.find(m[0], at)
            at = len(css) if close < 0 else close + 1
    return at


def rules_of(css: str):
    """(selectors, body) of the style rules that apply, in order."""
    at, n = 0, len(css)
    while at < n:
        start = at
        m = _STOP.search(css, at)
        while m and m[0] in "\"'":
            close = css.find(m[0], m.end())
            m = _STOP.search(css, close + 1) if close >= 0 else None
        if not m:
            return
        head = css[start : m.start()].strip()
        at = m.end()
        if m[0] != "{":
            continue  # a statement such as @import, or a stray brace
        end = _block(css, at)
        body = css[at : end - 1] if css[end - 1 : end] == "}" and end > at else css[at:end]
        at = end
        if not head.startswith("@"):
            yield head, body
            continue
        name, _, rest = head[1:].partition(" ") if " " in head else (head[1:].split("(")[0], "", head[1:][len(head[1:].split("(")[0]) :])
        name = name.lower()
        if name == "media" and on_screen(rest) or name in ("supports", "layer", "container") and not rest.strip().lower().startswith("not"):
            yield from rules_of(body)


class Compound:
    """What one element must be: the parts of a selector between combinators."""

    def __init__(self):
        self.tag = ""
        self.tests: list = []
        self.key = ""  # a class, id or type by which rules are looked up
        self.weight = (0, 0, 0)

    def add(self, a: int, b: int, c: int) -> None:
        self.weight = tuple(x + y for x, y in zip(self.weight, (a, b, c)))

    def fits(self, node) -> bool:
        return (not self.tag or node.tag == self.tag) and all(t(node) for t in self.tests)


def _attribute(name: str, op: str | None, value: str, fold: bool):
    def test(node) -> bool:
        have = node.attrs.get(name)
        if have is None or op is None:
            return have is not None
        want = value
        if fold:
            have, want = have.lower(), want.lower()
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        return bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)

    return test


def elements_of(node) -> list:
    """An element's siblings, itself among them."""
    return [k for k in node.up.kids if not isinstance(k, str)] if node.up is not None else [node]


def _place(pick):
    """A test of an element's place among its siblings of any or of its own type."""
    return lambda node: pick([k for k in elements_of(node)], node)


_PLACES = {
    "root": lambda node: node.up is None,
    "empty": lambda node: not node.kids,
    "first-child": _place(lambda all_, node: all_[0] is node),
    "last-child": _place(lambda all_, node: all_[-1] is node),
    "only-child": _place(lambda all_, node: len(all_) == 1),
    "first-of-type": _place(lambda all_, node: next(k for k in all_ if k.tag == node.tag) is node),
    "last-of-type": _place(lambda all_, node: next(k for k in reversed(all_) if k.tag == node.tag) is node),
}


def _nth(text: str):
    """The test of an an+b of :nth-child, or None."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), text.strip().lower().replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        return None
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)

    def test(node) -> bool:
        k = next(i for i, x in enumerate(elements_of(node)) if x is node) + 1 - b
        return k == 0 if a == 0 else k % a == 0 and k // a >= 0

    return test


def compound_of(text: str) -> Compound | None:
    """The parts of a compound selector, or None where one of them never holds or is not known."""
    out, at = Compound(), 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m[12] and at:
            return None
        at = m.end()
        if m[12]:
            out.tag = "" if m[12] == "*" else unescaped(m[12]).lower()
            out.add(0, 0, int(bool(out.tag)))
            out.key = out.key or out.tag
        elif m[1] == ".":
            name = unescaped(m[2])
            out.tests.append(lambda node, name=name: name in node.attrs.get("class", "").split())
            out.key = out.key if out.key.startswith("#") else "." + name
            out.add(0, 1, 0)
        elif m[1] == "#":
            name = unescaped(m[2])
            out.tests.append(lambda node, name=name: node.attrs.get("id") == name)
            out.key = "#" + name
            out.add(1, 0, 0)
        elif m[3]:
            value = m[5] if m[5] is not None else m[6] if m[6] is not None else unescaped(m[7] or "")
            out.tests.append(_attribute(unescaped(m[3]).lower(), m[4], value, (m[8] or "").lower() == "i"))
            out.add(0, 1, 0)
        else:
            name = m[10].lower()
            if m[9] == "::":
                return None
            if name in ("not", "is", "where", "matches", "-webkit-any", "-moz-any") and m[11] is not None:
                inner = [s for s in map(selector_of, split_list(m[11])) if s]
                if name == "not":
                    out.tests.append(lambda node, inner=inner: not any(s.fits(node) for s in inner))
                else:
                    out.tests.append(lambda node, inner=inner: any(s.fits(node) for s in inner))
                if name != "where" and inner:
                    out.add(*max(s.weight for s in inner))
            elif name == "nth-child" and m[11] is not None and _nth(m[11]):
                out.tests.append(_nth(m[11]))
                out.add(0, 1, 0)
            elif name in _PLACES and m[11] is None:
                out.tests.append(_PLACES[name])
                out.add(0, 1, 0)
            else:
                return None
    return out


class Selector:
    """Compounds from right to left, each with the combinator that leads to the next."""

    def __init__(self, steps: list[tuple[Compound, str]]):
        self.steps = steps
        self.weight = tuple(sum(c.weight[k] for c, _ in steps) for k in range(3))
        self.key = steps[0][0].key

    def fits(self, node, at: int = 0) -> bool:
        compound, how = self.steps[at]
        if not compound.fits(node):
            return False
        if at + 1 == len(self.steps):
            return True
        if how in ("", ">"):
            up = node.up
            while up is not None:
                if self.fits(up, at + 1):
                    return True
                up = None if how else up.up
            return False
        before = elements_of(node)
        before = before[: next(i for i, x in enumerate(before) if x is node)]
        return any(self.fits(x, at + 1) for x in (before[-1:] if how == "+" else reversed(before)))


def selector_of(text: str) -> Selector | None:
    """A complex selector, or None where it never holds or is not known."""
    text, steps, at, start = text.strip(), [], 0, 0
    while at < len(text):
        m = _PART.match(text, at)
        if m:
            at = m.end()
            continue
        c = _COMBINATOR.match(text, at)
        if not c or at == start:
            return None
        steps.append((text[start:at], c[1] or ""))
        at = start = c.end()
    steps.append((text[start:at], ""))
    made = [(compound_of(part), how) for part, how in steps]
    if any(c is None or not part for (c, _), (part, _) in zip(made, steps)):
        return None
    hows = [how for _, how in made[:-1]]
    return Selector([(c, how) for (c, _), how in zip(reversed(made), [*reversed(hows), ""])])


def split_list(text: str) -> list[str]:
    """A selector list at its outer commas."""
    out, depth, start, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


class Cascade:
    """The rules of a page's sheets, looked up by id, class or type."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[str, list] = {}
        order = 0
        for sheet in sheets:
            if "display" not in sheet.lower() and "visibility" not in sheet.lower():
                continue
            for selectors, body in rules_of(_COMMENT.sub(" ", sheet)):
                said = declarations(body)
                if not said:
                    continue
                order += 1
                for text in split_list(selectors):
                    s = selector_of(text)
                    if s:
                        self.by_key.setdefault(s.key, []).append((s, order, said))

    def computed(self, node) -> dict[str, str]:
        """property: value that sheets and the style attribute give an element."""
        attrs = node.attrs
        best: dict[str, tuple] = {}
        if self.by_key:
            keys = ["", node.tag]
            if attrs:
                keys += ["." + c for c in dict.fromkeys(attrs.get("class", "").split())]
                if "id" in attrs:
                    keys.append("#" + attrs["id"])
            for key in keys:
                for s, order, said in self.by_key.get(key, ()):
                    rank = {p: (i, False, s.weight, order) for p, (i, _) in said.items()}
                    if any(p not in best or rank[p] > best[p][0] for p in said) and s.fits(node):
                        for p, (_, value) in said.items():
                            if p not in best or rank[p] > best[p][0]:
                                best[p] = (rank[p], value)
        style = attrs.get("style") if attrs else None
        if style:
            for p, (important, value) in declarations(_COMMENT.sub(" ", style)).items():
                rank = (important, True, (0, 0, 0), 0)
                if p not in best or rank > best[p][0]:
                    best[p] = (rank, value)
        return {p: value for p, (_, value) in best.items()}
