"""Leaves and units of TypeScript, with and without JSX.

Kinds of names follow from a small grammar of types and from the bracket a
name stands in; that is enough for declarations, methods and arrow functions
as they are usually written.
"""

from __future__ import annotations

import re

from twinspan.operators.units import KEPT, LITERAL, LOCAL, Leaf, Unit, Unparsable

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<tick>`)"""
    r"""|(?P<num>0[xXbBoO][\w]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?n?|\.\d+)|(?P<name>[#@]?[^\W\d]?[\w$]*[$\w])"""
    r"""|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[^\w\s])"""
)
_ESCAPE = re.compile(r"\\(?:u\{[^}]*\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r\n|[\s\S])")
_REGEX = re.compile(r"/((?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/([a-z]*)")
_KEYWORDS = frozenset("const let var function return for of in if else while do new class extends implements import export default from as async await yield try catch finally throw switch case break continue typeof instanceof void delete static readonly private public protected abstract override get set interface type enum namespace declare super keyof infer is satisfies".split())
_SOFT = frozenset("of from as async get set type namespace declare is infer static readonly private public protected abstract override satisfies keyof".split())
_ONE_WORD = {"this": KEPT, "true": LITERAL, "false": LITERAL, "null": LITERAL, "undefined": LITERAL}
_PREDEFINED = frozenset("number string boolean any unknown never object symbol void".split())
_OPERAND_END = frozenset((")", "]", "}"))
_MODIFIERS = frozenset("public private protected static readonly override async get set abstract".split())


class Scanner:
    """Tokens (kind, text, byte, line); JSX and templates come out as their parts."""

    def __init__(self, text: str, jsx: bool):
        self.s, self.jsx = text, jsx
        self.i, self.byte, self.line = 0, 0, 1
        self.out: list[list] = []  # kind, text, start, line, role

    def put(self, kind: str, text: str, role: int = -1) -> None:
        if text.strip():
            self.out.append([kind, text, self.byte, self.line, role])
        self.skip(text)

    def skip(self, text: str) -> None:
        self.i += len(text)
        self.byte += len(text.encode())
        self.line += text.count("\n")

    def operand(self) -> bool:
        """Whether an operand is due here."""
        for kind, text, *_ in reversed(self.out):
            if kind != "comment":
                return not (kind in ("name", "num", "quote", "tick_end", "jsx_end") and text not in ("return", "typeof", "case", "in", "of", "default", "else") or text in _OPERAND_END)
        return True

    def code(self, stop: str = "") -> None:
        depth = 0
        while self.i < len(self.s):
            c = self.s[self.i]
            if stop and not depth and c == stop:
                return
            if c == "/" and self.operand() and (m := _REGEX.match(self.s, self.i)) and not self.s.startswith(("//", "/*"), self.i):
                self.put("/", "/", KEPT)
                self.put("regex_pattern", m[1], LITERAL)
                self.put("/", "/", KEPT)
                if m[2]:
                    self.put("regex_flags", m[2], LITERAL)
                self.out[-1][0] = "quote" if not m[2] else self.out[-1][0]
                continue
            if c == "<" and self.jsx and self.operand() and re.match(r"<(?:>|[A-Za-z])", self.s[self.i : self.i + 2]):
                self.element()
                continue
            m = _TOKEN.match(self.s, self.i)
            if m is None:
                raise Unparsable(f"unexpected character at line {self.line}")
            kind, t = m.lastgroup, m.group()
            if kind == "space":
                self.skip(t)
            elif kind == "str":
                self.string(t)
            elif kind == "tick":
                self.template()
            else:
                depth += (t in ("(", "[", "{")) - (t in _OPERAND_END)
                self.put(kind, t)
        if stop:
            raise Unparsable("premature end")

    def string(self, t: str) -> None:
        self.put("quote_open", t[0], KEPT)
        at, body = 0, t[1:-1]
        for m in _ESCAPE.finditer(body):
            if m.start() > at:
                self.put("string_fragment", body[at : m.start()], LITERAL)
            self.put("escape_sequence", m.group(), KEPT)
            at = m.end()
        if at < len(body):
            self.put("string_fragment", body[at:], LITERAL)
        self.put("quote", t[0], KEPT)

    def template(self) -> None:
        self.put("tick", "`", KEPT)
        while True:
            m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match(self.s, self.i)
            if m.group():
                self.put("string_fragment", m.group(), LITERAL)
            if self.s.startswith("`", self.i):
                self.put("tick_end", "`", KEPT)
                return
            if not self.s.startswith("${", self.i):
                raise Unparsable("unterminated template")
            self.put("op", "${", KEPT)
            self.code("}")
            self.put("op", "}", KEPT)

    def spaces(self) -> None:
        self.skip(re.compile(r"\s*").match(self.s, self.i).group())

    def tag_name(self) -> None:
        m = re.compile(r"[\w$]+(?:[-.:][\w$]+)*").match(self.s, self.i)
        if m is None:
            raise Unparsable(f"malformed element at line {self.line}")
        for n, part in enumerate(m.group().split(".")):
            if n:
                self.put("op", ".", KEPT)
            self.put("identifier", part, KEPT)

    def element(self) -> None:
        self.put("op", "<", KEPT)
        if not self.s.startswith(">", self.i):
            self.tag_name()
        while True:
            self.spaces()
            if self.s.startswith("/>", self.i):
                self.put("jsx_end", "/>", KEPT)
                return
            if self.s.startswith(">", self.i):
                self.put("op", ">", KEPT)
                break
            if self.s.startswith("{", self.i):
                self.braces()
                continue
            m = re.compile(r"[\w$][\w$:-]*").match(self.s, self.i)
            if m is None:
                raise Unparsable(f"malformed element at line {self.line}")
            self.put("property_identifier", m.group(), KEPT)
            self.spaces()
            if self.s.startswith("=", self.i):
                self.put("op", "=", KEPT)
                self.spaces()
                if self.s.startswith("{", self.i):
                    self.braces()
                elif m := re.compile(r"\"[^\"]*\"|'[^']*'").match(self.s, self.i):
                    self.string(m.group())
        while True:
            m = re.compile(r"[^<{]*").match(self.s, self.i)
            if m.group():
                self.put("jsx_text", m.group(), KEPT)
            if self.s.startswith("{", self.i):
                self.braces()
            elif self.s.startswith("</", self.i):
                self.put("op", "</", KEPT)
                if not self.s.startswith(">", self.i):
                    self.tag_name()
                self.put("jsx_end", ">", KEPT)
                return
            elif self.s.startswith("<", self.i):
                self.element()
            else:
                raise Unparsable("premature end")

    def braces(self) -> None:
        self.put("op", "{", KEPT)
        self.code("}")
        self.put("op", "}", KEPT)


class Namer:
    """Walks the tokens once and settles the kind of each name and the units."""

    def __init__(self, tokens: list[list]):
        self.all = tokens
        self.t = [x for x in tokens if x[0] != "comment"]
        self.units: list[tuple[str, int, int]] = []
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        stack, pairs = [], {}
        for i, x in enumerate(self.t):
            if x[1] in ("(", "[", "{", "${") and x[0] == "op":
                stack.append(i)
            elif x[1] in _OPERAND_END and x[0] == "op":
                if not stack:
                    raise Unparsable(f"unbalanced at line {x[3]}")
                pairs[stack.pop()] = i
        if stack:
            raise Unparsable("premature end")
        return pairs

    def text(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] in ("op", "name") else ""

    def kind(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def name(self, i: int, kind: str, role: int = KEPT) -> None:
        self.t[i][0], self.t[i][4] = kind, role

    def plain(self, i: int) -> bool:
        return self.kind(i) == "name" and (self.t[i][1] not in _KEYWORDS or self.t[i][1] in _SOFT)

    # -- types: each returns the index behind it

    def type(self, i: int) -> int:
        if self.text(i) in ("|", "&"):
            i += 1
        while True:
            i = self.primary(i)
            while self.text(i) == "[":
                close = self.match[i]
                if close > i + 1:
                    self.type(i + 1)
                i = close + 1
            if self.text(i) == "is":
                i += 1
                continue
            if self.text(i) in ("|", "&", "extends", "?") and not (self.text(i) == "?" and self.text(i + 1) in (")", ",", ":")):
                i += 1
                continue
            return i

    def primary(self, i: int) -> int:
        t = self.text(i)
        while t in ("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new"):
            i += 1
            t = self.text(i)
        if t == "(":
            close = self.match[i]
            if self.text(close + 1) == "=>":
                self.parameters(i)
                return self.type(close + 2)
            self.type(i + 1)
            return close + 1
        if t == "{":
            self.object_type(i)
            return self.match[i] + 1
        if t == "[":
            close, j = self.match[i], i + 1
            while j < close:
                j = max(self.type(j), j + 1)
                j += self.text(j) == ","
            return close + 1
        if self.kind(i) == "name":
            if t in _PREDEFINED or t in _ONE_WORD:
                self.name(i, t, _ONE_WORD.get(t, KEPT))
                return i + 1
            while self.text(i + 1) == ".":
                self.name(i, "identifier", LOCAL)
                i += 2
            self.name(i, "type_identifier")
            return self.angles(i + 1) if self.text(i + 1) == "<" else i + 1
        while self.kind(i) in ("quote_open", "string_fragment", "escape_sequence"):
            i += 1
        return i + 1

    def angles(self, i: int) -> int:
        """Type arguments or parameters at <."""
        i += 1
        while i < len(self.t) and self.text(i) not in (">", ">>", ">>>"):
            j = self.type(i)
            if self.text(j) == "=":
                j = self.type(j + 1)
            i = max(j, i + 1)
            i += self.text(i) == ","
        return i + 1

    def object_type(self, i: int) -> None:
        close, i = self.match[i], i + 1
        while i < close:
            while self.text(i) in ("readonly", "+", "-"):
                i += 1
            if self.text(i) == "[":
                if self.plain(i + 1):
                    self.name(i + 1, "identifier", LOCAL)
                    if self.text(i + 2) == ":":
                        self.type(i + 3)
                i = self.match[i] + 1
            elif self.kind(i) == "name":
                self.name(i, "property_identifier")
                i += 1
            elif self.text(i) != "(":
                i += 1
                continue
            i += self.text(i) == "?"
            if self.text(i) == "<":
                i = self.angles(i)
            if self.text(i) == "(":
                self.parameters(i)
                i = self.match[i] + 1
            if self.text(i) == ":":
                i = self.type(i + 1)
            i += self.text(i) in (";", ",")

    def parameters(self, i: int) -> None:
        close, i = self.match[i], i + 1
        while i < close:
            while self.text(i) in _MODIFIERS and (self.kind(i + 1) == "name" or self.text(i + 1) in ("[", "{")):
                i += 1
            i += self.text(i) == "..."
            i = self.pattern(i)
            i += self.text(i) == "?"
            if self.text(i) == ":":
                i = self.type(i + 1)
            if self.text(i) == "=":
                i = self.until(i + 1, close)
            i += self.text(i) == ","

    def pattern(self, i: int) -> int:
        t = self.text(i)
        if t == "{":
            close, j = self.match[i], i + 1
            while j < close:
                if self.text(j) == "...":
                    j = self.pattern(j + 1)
                elif self.text(j + 1) == ":":
                    self.name(j, "property_identifier")
                    j = self.pattern(j + 2)
                else:
                    self.name(j, "shorthand_property_identifier_pattern")
                    j += 1
                if self.text(j) == "=":
                    j = self.until(j + 1, close)
                j += self.text(j) == ","
            return close + 1
        if t == "[":
            close, j = self.match[i], i + 1
            while j < close:
                if self.text(j) == ",":
                    j += 1
                    continue
                j = self.pattern(j + (self.text(j) == "..."))
                if self.text(j) == "=":
                    j = self.until(j + 1, close)
            return close + 1
        if self.kind(i) == "name":
            if t in _ONE_WORD:
                self.name(i, t, KEPT)
            else:
                self.name(i, "identifier", LOCAL)
        return i + 1

    # -- expressions and statements, between two indexes

    def until(self, i: int, end: int) -> int:
        """An expression up to a comma or the end."""
        while i < end and self.text(i) != ",":
            i = self.step(i, end)
        return i

    def walk(self, i: int, end: int) -> None:
        while i < end:
            i = self.step(i, end)

    def function(self, i: int) -> int:
        """Parameters, return type and body at ( or <; the index behind."""
        if self.text(i) == "<":
            i = self.angles(i)
        if self.text(i) != "(":
            return i
        self.parameters(i)
        i = self.match[i] + 1
        if self.text(i) == ":":
            i = self.type(i + 1)
        if self.text(i) == "{":
            self.walk(i + 1, self.match[i])
            return self.match[i] + 1
        return i

    def arrow_head(self, i: int) -> int:
        """The index of => if ( or a name at i begins an arrow function, else 0."""
        if self.kind(i) == "name":
            return i + 1 if self.text(i + 1) == "=>" else 0
        j = self.match[i] + 1
        if self.text(j) == "=>":
            return j
        if self.text(j) != ":":
            return 0
        saved = [(x[0], x[4]) for x in self.t[j : j + 60]]
        k = self.type(j + 1)
        if self.text(k) == "=>":
            return k
        for x, (a, b) in zip(self.t[j : j + 60], saved, strict=True):
            x[0], x[4] = a, b
        return 0

    def arrow(self, start: int, i: int, at: int, end: int) -> int:
        if self.text(i) == "(":
            self.parameters(i)
            if self.text(self.match[i] + 1) == ":":
                self.type(self.match[i] + 2)
        else:
            self.name(i, "identifier", LOCAL)
        if self.text(at + 1) == "{":
            close = self.match[at + 1]
            self.walk(at + 2, close)
            self.units.append(("arrow_function", start, close))
            return close + 1
        j = at + 1
        while j < end and self.text(j) not in (",", ";"):
            k = self.step(j, end)
            if k < end and self.t[k][3] > self.t[k - 1][3] and self.kind(k) == "name" and self.text(k) not in ("as", "in", "instanceof", "satisfies") and (self.text(k - 1) in _OPERAND_END or self.kind(k - 1) not in ("op", "name")):
                j = k
                break
            j = k
        self.units.append(("arrow_function", start, j - 1))
        return j

    def step(self, i: int, end: int) -> int:
        """Settles one construct; the index behind it."""
        x = self.t[i]
        kind, t = x[0], x[1]
        if kind == "op":
            if t == "(":
                if at := self.arrow_head(i):
                    return self.arrow(i, i, at, end)
                self.walk(i + 1, self.match[i])
                return self.match[i] + 1
            if t == "[":
                self.walk(i + 1, self.match[i])
                return self.match[i] + 1
            if t == "{":
                before, last = self.text(i - 1), self.kind(i - 1)
                if last == "op" and before in ("(", ",", "=", ":", "[", "?", "&&", "||", "??", "...", "=>") or before in ("return", "default"):
                    self.object(i)
                else:
                    self.walk(i + 1, self.match[i])
                return self.match[i] + 1
            if t in (".", "?."):
                if self.kind(i + 1) == "name":
                    self.name(i + 1, "property_identifier" if not self.t[i + 1][1].startswith("#") else "private_property_identifier")
                    return i + 2
            return i + 1
        if kind != "name":
            return i + 1
        if t in ("const", "let", "var") and self.text(i + 1) != "enum":
            i = self.pattern(i + 1)
            if self.text(i) == ":":
                i = self.type(i + 1)
            return i
        if t == "function" or t == "async" and self.text(i + 1) == "function":
            start = i
            i += 1 + (t == "async")
            i += self.text(i) == "*"
            named = self.plain(i)
            if named:
                self.name(i, "identifier")
                i += 1
            before = self.text(start - 1)
            j = self.function(i)
            if named and (start == 0 or before in (";", "}", "{", "export", "default", ")")):
                self.units.append(("function_declaration", start, j - 1))
            return j
        if t == "async" and (self.text(i + 1) == "(" or self.kind(i + 1) == "name") and self.t[i + 1][3] == x[3] and (at := self.arrow_head(i + 1)):
            return self.arrow(i, i + 1, at, end)
        if t == "class":
            return self.klass(i)
        if t == "interface" and self.plain(i + 1):
            self.name(i + 1, "type_identifier")
            i += 2
            i = self.angles(i) if self.text(i) == "<" else i
            while self.text(i) in ("extends", ","):
                i = self.type(i + 1)
            if self.text(i) == "{":
                self.object_type(i)
                return self.match[i] + 1
            return i
        if t == "type" and self.plain(i + 1) and self.text(i + 2) in ("=", "<"):
            self.name(i + 1, "type_identifier")
            i = self.angles(i + 2) if self.text(i + 2) == "<" else i + 2
            return self.type(i + 1)
        if t in ("import", "export") and self.text(i + 1) not in ("(", ".", "default", "const", "function", "class", "async", "interface", "type", "enum", "let", "var", "abstract", "declare") or t in ("import", "export") and self.text(i + 1) == "type" and self.text(i + 2) in ("{", "*"):
            j = i + 1
            while j < end and self.kind(j) not in ("quote_open",) and self.text(j) != ";" and not (j > i + 1 and self.text(j - 1) == "}" and self.text(j) != "from"):
                if self.plain(j) and self.t[j][1] not in ("from", "as", "type"):
                    self.name(j, "identifier")
                j += 1
            return j
        if t in ("as", "satisfies") and self.kind(i - 1) != "op" or t in ("as", "satisfies") and self.text(i - 1) in _OPERAND_END:
            return i + 2 if self.text(i + 1) == "const" else self.type(i + 1)
        if t in _ONE_WORD:
            self.name(i, t, _ONE_WORD[t])
            return i + 1
        if t == "of" and (self.kind(i - 1) == "identifier" or self.text(i - 1) in _OPERAND_END):
            return i + 1
        if self.plain(i):
            if at := self.arrow_head(i):
                return self.arrow(i, i, at, end)
            self.name(i, "identifier", LOCAL)
            if self.text(i + 1) == "<":
                saved = [(y[0], y[4]) for y in self.t]
                try:
                    j = self.angles(i + 1)
                    if self.text(j) == "(" and self.t[j - 1][1] == ">":
                        return j
                except (Unparsable, KeyError, IndexError, RecursionError):
                    pass
                for y, (a, b) in zip(self.t, saved, strict=True):
                    y[0], y[4] = a, b
        return i + 1

    def klass(self, i: int) -> int:
        start = i
        before = self.text(start - 1)
        i += 1
        named = self.plain(i) and self.text(i) not in ("extends", "implements")
        if named:
            self.name(i, "type_identifier")
            i += 1
        if self.text(i) == "<":
            i = self.angles(i)
        if self.text(i) == "extends":
            i = self.step(i + 1, len(self.t))
            while self.text(i) == ".":
                i = self.step(i, len(self.t))
            i = self.angles(i) if self.text(i) == "<" else i
        while self.text(i) in ("implements", ","):
            i = self.type(i + 1)
        if self.text(i) != "{":
            return i
        close, j = self.match[i], i + 1
        while j < close:
            first = j
            while self.text(j) in _MODIFIERS and (self.kind(j + 1) == "name" or self.text(j + 1) in ("[", "*")):
                j += 1
            j += self.text(j) == "*"
            if self.text(j) == "[":
                self.walk(j + 1, self.match[j])
                j = self.match[j] + 1
            elif self.kind(j) == "name":
                self.name(j, "property_identifier" if not self.t[j][1].startswith("#") else "private_property_identifier")
                j += 1
            else:
                j += 1
                continue
            j += self.text(j) in ("?", "!")
            if self.text(j) in ("(", "<"):
                k = self.function(j)
                if self.text(k - 1) == "}":
                    self.units.append(("method_definition", first, k - 1))
                j = k
            else:
                if self.text(j) == ":":
                    j = self.type(j + 1)
                if self.text(j) == "=":
                    line = self.t[j][3]
                    j += 1
                    while j < close and self.text(j) != ";" and not (self.t[j][3] > line and self.kind(j) == "name" and self.text(j - 1) not in ("=", ",", "=>")):
                        line = self.t[j][3]
                        k = self.step(j, close)
                        line = self.t[k - 1][3]
                        j = k
            j += self.text(j) == ";"
        if named and (start == 0 or before in (";", "}", "{", "export", "default", ")")):
            self.units.append(("class_declaration", start, close))
        return close + 1

    def object(self, i: int) -> None:
        close, j = self.match[i], i + 1
        while j < close:
            first = j
            while self.text(j) in ("async", "get", "set", "*") and self.text(j + 1) not in (":", ",", "(", "}"):
                j += 1
            if self.kind(j) == "name" and self.text(j + 1) in (",", "}", "=") and self.text(j) not in _ONE_WORD:
                self.name(j, "shorthand_property_identifier")
                j += 1
            elif self.kind(j) == "name" and self.text(j + 1) in (":", "("):
                self.name(j, "property_identifier")
                if self.text(j + 1) == "(":
                    k = self.function(j + 1)
                    self.units.append(("method_definition", first, k - 1))
                    j = k
                else:
                    j = self.until(j + 2, close)
            else:
                j = self.until(j, close)
            j += self.text(j) == ","
            if j == first:
                j += 1


def typescript_units(text: str, jsx: bool = False) -> tuple[list[Leaf], list[Unit]]:
    scanner = Scanner(text, jsx)
    scanner.code()
    namer = Namer(scanner.out)
    try:
        namer.walk(0, len(namer.t))
    except (KeyError, IndexError, RecursionError) as e:
        raise Unparsable("structure not understood") from e
    leaves = []
    for kind, t, start, line, role in scanner.out:
        if kind in ("quote_open", "quote", "tick", "tick_end", "op", "jsx_end"):
            kind = t
        elif kind == "num":
            kind, role = "number", LITERAL
        elif kind == "name":
            kind = t
        leaves.append(Leaf(kind, t, start, start + len(t.encode()), line, role if role >= 0 else KEPT))
    units = [Unit(k, namer.t[a][2], namer.t[b][2] + len(namer.t[b][1].encode())) for k, a, b in namer.units]
    return leaves, units


def tsx_units(text: str) -> tuple[list[Leaf], list[Unit]]:
    return typescript_units(text, True)
