"""Rust, edition 2021."""

from __future__ import annotations

import re

from twinspan.llm.syntax.base import Bad

_ID = r"(?:r\#)?[^\W\d]\w*"
_SUFFIX = r"(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?"
_NUMBER = rf"(?:0x_*[0-9A-Fa-f][0-9A-Fa-f_]*|0o_*[0-7][0-7_]*|0b_*[01][01_]*){_SUFFIX}|\d[\d_]*(?:\.(?![._]|[^\W\d])[\d_]*)?(?:[eE][+-]?_*\d[\d_]*)?{_SUFFIX}"
_ESCAPE = r"\\(?:[nrt0'\"\\]|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]{1,8}\})"
_CHAR = rf"b?'(?:[^'\\\n\r\t]|{_ESCAPE})'"
_STRING = r"[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|[bc]?r(?P<hash>\#*)\"[\s\S]*?\"(?P=hash)"
_PUNCT = r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[{}()\[\];,<>+\-*/%&|^!?:=.@\#$~]"
_GAP = r"(?:[ \t\n\r\x0b\x0c  ‎‏]+|//[^\n]*+)*+"
TOKEN = re.compile(rf"({_GAP})(?:(?P<chr>{_CHAR})|(?P<str>{_STRING})|(?P<life>'(?:r\#)?[^\W\d]\w*)(?!')|(?P<name>{_ID})|(?P<num>{_NUMBER})|(?P<punct>(?!/\*)(?:{_PUNCT}))|(?P<end>\Z))")
_INDEX = TOKEN.groupindex
CHR, STR, LIFE, NAME, NUM, PUNCT, END = (_INDEX[x] for x in ("chr", "str", "life", "name", "num", "punct", "end"))
_SPACES = re.compile(_GAP)
_COMMENT = re.compile(r"/\*|\*/")
_DOC = re.compile(r"^[ \t]*///(?!/)|/\*\*(?![*/])", re.M)
_WORDS = re.compile(r"[\w\"#]")

KEYWORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split())
_PATH_WORDS = frozenset("self Self super crate".split())
_ITEMS = frozenset("use mod fn struct enum const static type trait impl extern pub unsafe async macro_rules union".split())
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_NO_OPERAND = frozenset(") ] } , ; =>".split())


class Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0
        if text.startswith("﻿"):
            self.i = 1
        if text.startswith("#!", self.i) and not re.match(r"#!\s*\[", text[self.i :]):
            end = text.find("\n")
            self.i = end if end >= 0 else len(text)
        self.k, self.t, self.at, self.doc = 0, "", 0, False
        self.no_struct = False
        self.next()

    # -- lexer

    def next(self) -> None:
        s, doc = self.s, False
        while True:
            m = TOKEN.match(s, self.i)
            if m is not None:
                break
            at = _SPACES.match(s, self.i).end()
            if not s.startswith("/*", at):
                if s.startswith("*/", at):
                    raise Bad("unbalanced_delimiter", at)
                raise Bad("unterminated_literal" if s[at : at + 1] in "\"'" or re.match(r'[bc]?r?#*"', s[at : at + 20]) else "unexpected_token", at)
            doc = doc or bool(_DOC.match(s, at)) or "///" in s[self.i : at]
            depth, self.i = 1, at + 2
            while depth:
                c = _COMMENT.search(s, self.i)
                if c is None:
                    raise Bad("unterminated_literal", at)
                depth += 1 if c.group() == "/*" else -1
                self.i = c.end()
        k = m.lastindex
        if k == _INDEX["hash"]:
            k = STR
        gap = m.group(1)
        self.doc = doc or "///" in gap and bool(_DOC.search(gap))
        self.k, self.t, self.at, self.i = k, m.group(k), m.start(k), m.end()
        if k == NAME or k == NUM:
            c = s[self.i : self.i + 1]
            if c == '"' or c == "#" and self.t not in ("r",) and k == NAME and s[self.i + 1 : self.i + 2] not in "![":
                raise Bad("unexpected_token", self.i)
            if k == NUM and c and _WORDS.match(c):
                raise Bad("unexpected_token", self.i)

    def save(self):
        return self.i, self.k, self.t, self.at, self.doc, self.no_struct

    def restore(self, x) -> None:
        self.i, self.k, self.t, self.at, self.doc, self.no_struct = x

    def peek(self) -> tuple[int, str]:
        x = self.save()
        try:
            self.next()
            return self.k, self.t
        except Bad:
            return 0, ""
        finally:
            self.restore(x)

    def bad(self) -> Bad:
        if self.k == END:
            return Bad("premature_end", self.at)
        return Bad("unbalanced_delimiter" if self.t in ")]}" else "unexpected_token", self.at)

    def is_(self, p: str) -> bool:
        return self.t == p and self.k == PUNCT

    def word(self, w: str) -> bool:
        return self.t == w and self.k == NAME

    def eat(self, p: str) -> bool:
        if self.t == p and self.k == PUNCT:
            self.next()
            return True
        return False

    def eat_word(self, w: str) -> bool:
        if self.t == w and self.k == NAME:
            self.next()
            return True
        return False

    def need(self, p: str) -> None:
        if self.t != p or self.k != PUNCT:
            raise self.bad()
        self.next()

    def split(self, p: str) -> bool:
        """Take one leading character of a longer token."""
        if self.k == PUNCT and self.t.startswith(p):
            self.i = self.at + len(p)
            self.next()
            return True
        return False

    def name(self) -> None:
        if self.k != NAME or self.t in KEYWORDS:
            raise self.bad()
        self.next()

    def ident(self) -> bool:
        return self.k == NAME and self.t not in KEYWORDS

    def close(self, p: str) -> None:
        """The end of a list of items: no doc comment may wait for one."""
        if self.doc and self.is_(p):
            raise Bad("unexpected_token", self.at)
        self.need(p)

    # -- token trees and attributes

    def tree(self) -> str:
        opened = self.t
        if self.k != PUNCT or opened not in _CLOSE:
            raise self.bad()
        stack = [_CLOSE[opened]]
        self.next()
        while stack:
            if self.k == PUNCT:
                if self.t in _CLOSE:
                    stack.append(_CLOSE[self.t])
                elif self.t in ")]}":
                    if self.t != stack.pop():
                        raise self.bad()
            elif self.k == END:
                raise self.bad()
            self.next()
        return opened

    def attributes(self) -> bool:
        found = self.doc
        while self.is_("#"):
            found = True
            self.next()
            self.eat("!")
            if not self.is_("["):
                raise self.bad()
            self.tree()
        return found

    # -- items

    def program(self) -> None:
        while True:
            found = self.attributes()
            if self.k == END:
                if found and self.doc:
                    raise self.bad()
                return
            self.item()

    def visibility(self) -> None:
        if self.eat_word("pub") and self.is_("("):
            x = self.save()
            self.next()
            if self.k == NAME and self.t in ("crate", "self", "super", "in"):
                if self.eat_word("in"):
                    self.path()
                else:
                    self.next()
                if self.eat(")"):
                    return
            self.restore(x)

    def items(self, end: str = "}") -> None:
        while True:
            self.attributes()
            if self.is_(end):
                self.close(end)
                return
            self.item()

    def item(self) -> None:
        self.visibility()
        t = self.t
        if self.k != NAME:
            if self.is_("::") or self.is_(";") and False:
                return self.macro_item()
            raise self.bad()
        if t in ("default", "auto", "safe") and self.peek()[0] == NAME and self.peek()[1] != "as":
            self.next()
            return self.item()
        if t == "use":
            self.next()
            self.use_tree()
            return self.need(";")
        if t == "mod":
            self.next()
            self.name()
            if self.eat(";"):
                return None
            self.need("{")
            return self.items()
        if t == "struct" or t == "union" and self.peek()[0] == NAME:
            return self.struct()
        if t == "enum":
            return self.enum()
        if t == "type":
            self.next()
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            return self.need(";")
        if t == "trait":
            return self.trait()
        if t == "impl":
            return self.impl()
        if t == "static":
            self.next()
            self.eat_word("mut")
            self.name()
            self.need(":")
            self.type()
            if self.eat("="):
                self.expr()
            return self.need(";")
        if t == "const" and not (self.peek()[1] in ("fn", "unsafe", "async", "extern")):
            self.next()
            self.eat_word("mut")
            self.name()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
            return self.need(";")
        if t in ("fn", "const", "unsafe", "async", "extern"):
            while self.k == NAME and self.t in ("const", "unsafe", "async", "safe"):
                self.next()
            if self.eat_word("extern"):
                if self.eat_word("crate"):
                    if not self.eat_word("self"):
                        self.name()
                    if self.eat_word("as"):
                        self.name()
                    return self.need(";")
                if self.k == STR:
                    self.next()
                if self.eat("{"):
                    return self.items()
            if self.word("trait"):
                return self.trait()
            if self.word("impl"):
                return self.impl()
            if self.word("mod"):
                return self.item()
            return self.function()
        return self.macro_item()

    def macro_item(self) -> None:
        self.path()
        self.need("!")
        if self.ident():
            self.next()
        if self.tree() != "{":
            self.need(";")

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                while not self.is_("}"):
                    self.use_tree()
                    if not self.is_("}"):
                        self.need(",")
                self.next()
                return
            if self.k != NAME or self.t in KEYWORDS and self.t not in _PATH_WORDS:
                raise self.bad()
            self.next()
            if not self.eat("::"):
                break
        if self.eat_word("as"):
            self.name()

    def struct(self) -> None:
        self.next()
        self.name()
        self.generics()
        self.where()
        if self.eat(";"):
            return
        if self.is_("("):
            self.tuple_fields()
            self.where()
            self.need(";")
            return
        self.fields()

    def fields(self) -> None:
        self.need("{")
        while True:
            self.attributes()
            if self.is_("}"):
                break
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if not self.is_("}"):
                self.need(",")
        self.close("}")

    def tuple_fields(self) -> None:
        self.need("(")
        while not self.is_(")"):
            self.attributes()
            self.visibility()
            self.type()
            if not self.is_(")"):
                self.need(",")
        self.next()

    def enum(self) -> None:
        self.next()
        self.name()
        self.generics()
        self.where()
        self.need("{")
        while True:
            self.attributes()
            if self.is_("}"):
                break
            self.visibility()
            self.name()
            if self.is_("("):
                self.tuple_fields()
            elif self.is_("{"):
                self.fields()
            if self.eat("="):
                self.expr()
            if not self.is_("}"):
                self.need(",")
        self.close("}")

    def trait(self) -> None:
        self.next()
        self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        if self.eat("="):
            self.bounds()
            self.where()
            self.need(";")
            return
        self.where()
        self.need("{")
        self.items()

    def impl(self) -> None:
        self.next()
        if self.is_("<") and self.peek()[1] != "<":
            x = self.save()
            try:
                self.generics()
            except Bad:
                self.restore(x)
        self.eat_word("const")
        self.eat("!")
        self.type()
        if self.eat_word("for"):
            self.type()
        self.where()
        self.need("{")
        self.items()

    def function(self) -> None:
        if not self.eat_word("fn"):
            raise self.bad()
        self.name()
        self.generics()
        self.need("(")
        while not self.is_(")"):
            self.attributes()
            if not self.receiver():
                if not self.eat("..."):
                    self.pattern()
                    self.need(":")
                    if not self.eat("..."):
                        self.type()
            if not self.is_(")"):
                self.need(",")
        self.next()
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def receiver(self) -> bool:
        x = self.save()
        if self.eat("&"):
            if self.k == LIFE:
                self.next()
        self.eat_word("mut")
        if self.eat_word("self"):
            if self.eat(":"):
                self.type()
            return True
        self.restore(x)
        return False

    def generics(self) -> None:
        if not self.eat("<"):
            return
        while not (self.k == PUNCT and self.t[0] == ">"):
            self.attributes()
            if self.k == LIFE:
                self.next()
                if self.eat(":"):
                    self.bounds()
            elif self.eat_word("const"):
                self.name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.const_argument()
            else:
                self.name()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not (self.k == PUNCT and self.t[0] == ">"):
                self.need(",")
        self.split(">")

    def where(self) -> None:
        if not self.eat_word("where"):
            return
        while not (self.k == END or self.k == PUNCT and self.t in ("{", ";", "=")):
            if self.k == LIFE:
                self.next()
            else:
                self.for_lifetimes()
                self.type()
            self.need(":")
            self.bounds()
            if not self.eat(","):
                break

    def for_lifetimes(self) -> None:
        if self.word("for") and self.peek()[1] == "<":
            self.next()
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.k == LIFE:
                self.next()
            elif self.k == NAME and (self.t not in KEYWORDS or self.t in _PATH_WORDS or self.t in ("for", "async", "const", "use")) or self.k == PUNCT and self.t in ("?", "(", "::", "~", "<"):
                paren = self.eat("(")
                if self.eat("~"):
                    self.eat_word("const")
                self.eat_word("async")
                if self.eat_word("use"):
                    self.generics_arguments()
                else:
                    self.eat("?")
                    self.for_lifetimes()
                    self.path(True)
                if paren:
                    self.need(")")
            else:
                return
            if not self.eat("+"):
                return

    # -- paths and types

    def path(self, types: bool = False, expression: bool = False) -> None:
        self.eat("::")
        while True:
            if self.k != NAME or self.t in KEYWORDS and self.t not in _PATH_WORDS:
                raise self.bad()
            self.next()
            if types:
                if self.k == PUNCT and self.t in ("<", "<<"):
                    self.generics_arguments()
                elif self.is_("("):
                    self.type_list()
                    if self.eat("->"):
                        self.type(False)
            if not self.is_("::"):
                return
            k, t = self.peek()
            if t in ("<", "<<") and k == PUNCT:
                self.next()
                self.generics_arguments()
                if not self.is_("::"):
                    return
            elif k == PUNCT and t == "(" and types:
                self.next()
                self.type_list()
                return
            elif k == PUNCT:
                return
            self.next()

    def type_list(self) -> None:
        self.need("(")
        while not self.is_(")"):
            self.type()
            if not self.is_(")"):
                self.need(",")
        self.next()

    def generics_arguments(self) -> None:
        if not self.split("<"):
            raise self.bad()
        while not (self.k == PUNCT and self.t[0] == ">"):
            if self.k == LIFE:
                self.next()
            elif self.k in (NUM, STR, CHR) or self.k == PUNCT and self.t in ("-", "{") or self.k == NAME and self.t in ("true", "false"):
                self.const_argument()
            else:
                self.type()
                if self.eat("="):
                    if self.k in (NUM, STR, CHR) or self.is_("{") or self.is_("-"):
                        self.const_argument()
                    else:
                        self.type()
                elif self.eat(":"):
                    self.bounds()
            if not (self.k == PUNCT and self.t[0] == ">"):
                self.need(",")
        self.split(">")

    def const_argument(self) -> None:
        if self.is_("{"):
            self.block()
            return
        self.eat("-")
        if self.k in (NUM, STR, CHR) or self.k == NAME:
            self.next()
        else:
            raise self.bad()

    def qualified(self) -> None:
        """<T as Trait>:: at its bracket."""
        self.split("<")
        self.type()
        if self.eat_word("as"):
            self.path(True)
        if not self.split(">"):
            raise self.bad()

    def type(self, plus: bool = True) -> None:
        k, t = self.k, self.t
        if k == PUNCT:
            if t == "&" or t == "&&":
                self.next()
                if self.k == LIFE:
                    self.next()
                self.eat_word("mut")
                self.type(False)
            elif t == "*":
                self.next()
                if not (self.eat_word("const") or self.eat_word("mut")):
                    raise self.bad()
                self.type(False)
            elif t == "[":
                self.next()
                self.type()
                if self.eat(";"):
                    self.expr()
                self.need("]")
            elif t == "(":
                self.type_list()
            elif t == "!":
                self.next()
            elif t in ("<", "<<"):
                self.qualified()
                while self.eat("::"):
                    self.path(True)
            elif t == "::":
                self.path(True)
                self.type_macro()
            elif t == "?":
                self.bounds()
            else:
                raise self.bad()
        elif k == NAME:
            if t == "_":
                self.next()
            elif t in ("impl", "dyn") and not (t == "dyn" and self.peek()[1] == "::"):
                self.next()
                if plus:
                    self.bounds()
                else:
                    self.one_bound()
            elif t in ("fn", "unsafe", "extern", "for"):
                if t == "for":
                    self.for_lifetimes()
                self.eat_word("unsafe")
                if self.eat_word("extern") and self.k == STR:
                    self.next()
                if self.eat_word("fn"):
                    self.fn_pointer()
                else:
                    self.path(True)
                    if plus and self.eat("+"):
                        self.bounds()
            else:
                self.path(True)
                self.type_macro()
                if plus and self.is_("+"):
                    self.next()
                    self.bounds()
        else:
            raise self.bad()

    def one_bound(self) -> None:
        if self.eat("("):
            self.bounds()
            self.need(")")
            return
        if self.k == LIFE:
            self.next()
            return
        self.eat("?")
        self.for_lifetimes()
        self.path(True)

    def type_macro(self) -> None:
        if self.is_("!"):
            self.next()
            self.tree()

    def fn_pointer(self) -> None:
        self.need("(")
        while not self.is_(")"):
            self.attributes()
            if self.eat("..."):
                continue
            if self.k == NAME and self.peek()[1] == ":":
                self.next()
                self.next()
            self.type()
            if not self.is_(")"):
                self.need(",")
        self.next()
        if self.eat("->"):
            self.type(False)

    # -- patterns

    def pattern(self) -> None:
        self.eat("|")
        self.one_pattern()
        while self.is_("|"):
            self.next()
            self.one_pattern()

    def one_pattern(self) -> None:
        k, t = self.k, self.t
        if k in (NUM, STR, CHR) or k == PUNCT and t == "-":
            self.literal_pattern()
            self.range_tail()
            return
        if k == PUNCT:
            if t == "&" or t == "&&":
                self.next()
                self.eat_word("mut")
                self.one_pattern()
            elif t in "([":
                self.next()
                end = _CLOSE[t]
                while not self.is_(end):
                    self.attributes()
                    self.pattern()
                    if not self.is_(end):
                        self.need(",")
                self.next()
            elif t in ("..", "..=", "..."):
                self.next()
                if self.k in (NUM, CHR) or self.is_("-") or self.ident() and t != "..":
                    self.literal_pattern()
            elif t in ("<", "<<"):
                self.qualified()
                self.need("::")
                self.path_pattern()
            elif t == "::":
                self.path_pattern()
            else:
                raise self.bad()
            return
        if k != NAME:
            raise self.bad()
        if t == "_":
            self.next()
            return
        if t in ("true", "false"):
            self.next()
            return
        if t in ("ref", "mut", "box"):
            self.eat_word("ref")
            self.eat_word("mut")
            if self.eat_word("box"):
                self.one_pattern()
                return
            if not self.eat_word("self"):
                self.name()
            if self.eat("@"):
                self.one_pattern()
            return
        if t == "const":
            self.next()
            self.block()
            return
        self.path_pattern()

    def literal_pattern(self) -> None:
        if self.eat("-"):
            if self.k != NUM:
                raise self.bad()
        if self.k == NAME:
            self.path(False, True)
        else:
            self.next()

    def range_tail(self) -> None:
        if self.k == PUNCT and self.t in ("..", "..=", "..."):
            self.next()
            if self.k in (NUM, CHR, STR) or self.is_("-") or self.ident() or self.k == NAME and self.t in _PATH_WORDS:
                self.literal_pattern()

    def path_pattern(self) -> None:
        start = self.at
        self.path()
        single = self.s[start : self.at].strip().isidentifier()
        if self.is_("!"):
            self.next()
            self.tree()
        elif self.eat("("):
            while not self.is_(")"):
                self.attributes()
                self.pattern()
                if not self.is_(")"):
                    self.need(",")
            self.next()
        elif self.is_("{"):
            self.next()
            while not self.is_("}"):
                self.attributes()
                if self.eat(".."):
                    break
                if self.k == NUM or self.k == NAME and self.peek()[1] == ":":
                    self.next()
                    self.need(":")
                    self.pattern()
                else:
                    self.eat_word("box")
                    self.eat_word("ref")
                    self.eat_word("mut")
                    self.name()
                if not self.is_("}"):
                    self.need(",")
            self.need("}")
        elif single and self.eat("@"):
            self.one_pattern()
        else:
            self.range_tail()

    # -- blocks and statements

    def block(self) -> None:
        self.need("{")
        held, self.no_struct = self.no_struct, False
        while True:
            found = self.attributes()
            if self.is_("}"):
                if found:
                    raise Bad("unexpected_token", self.at)
                break
            self.statement()
        self.next()
        self.no_struct = held

    def statement(self) -> None:
        k, t = self.k, self.t
        if k == PUNCT and t == ";":
            self.next()
            return
        if k == END:
            raise self.bad()
        if k == NAME:
            if t == "let":
                self.next()
                self.pattern()
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expr()
                    if self.eat_word("else"):
                        self.block()
                self.need(";")
                return
            if t in _ITEMS:
                n = self.peek()[1]
                if (
                    t in ("use", "mod", "fn", "struct", "enum", "static", "type", "trait", "impl", "extern", "pub")
                    and not (t == "static" and n in ("|", "||", "move"))
                    or t == "const"
                    and n not in ("{", "|", "||", "move")
                    or t == "unsafe"
                    and n in ("fn", "impl", "trait", "extern")
                    or t == "async"
                    and n in ("fn", "unsafe")
                    or t == "union"
                    and self.peek()[0] == NAME
                    and n not in ("as",)
                    or t == "macro_rules"
                    and n == "!"
                ):
                    self.item()
                    return
        block_like = self.statement_expr()
        if self.eat(";") or self.is_("}"):
            return
        if not block_like:
            raise self.bad()

    def statement_expr(self) -> bool:
        """An expression at the start of a statement; whether it may end without ;."""
        k, t = self.k, self.t
        label = k == LIFE
        if label or k == PUNCT and t == "{" or k == NAME and (t in ("if", "match", "loop", "while", "for") or t in ("unsafe", "const") and self.peek()[1] == "{" or t == "async" and self.peek()[1] in ("{", "move")):
            start_async = t == "async"
            if start_async:
                self.expr()
                return True
            self.operand()
            if self.k == PUNCT and self.t in (".", "?"):
                self.postfix_tail()
                self.binary_tail(0)
                self.assign_tail()
                return False
            return True
        if k == NAME and (t not in KEYWORDS or t in _PATH_WORDS) or k == PUNCT and t == "::":
            x = self.save()
            self.path(False, True)
            if self.is_("!") and self.peek()[1] in ("{", "(", "["):
                self.next()
                if self.tree() == "{":
                    if self.k == PUNCT and self.t in (".", "?"):
                        self.postfix_tail()
                        self.binary_tail(0)
                        self.assign_tail()
                        return False
                    return True
            self.restore(x)
        self.expr()
        return False

    # -- expressions

    def expr(self) -> None:
        k, t = self.k, self.t
        if k == PUNCT and t in ("..", "..="):
            self.next()
            if self.starts_operand():
                self.binary(0)
            return
        self.binary(0)
        self.assign_tail()

    def assign_tail(self) -> None:
        if self.k == PUNCT:
            t = self.t
            if t in ("..", "..="):
                self.next()
                if self.starts_operand():
                    self.binary(0)
                elif t == "..=":
                    raise self.bad()
                if self.k == PUNCT and self.t in ("..", "..="):
                    raise self.bad()
                t = self.t
            if self.k == PUNCT and t in _ASSIGN:
                self.next()
                self.expr()

    def starts_operand(self) -> bool:
        if self.k == END:
            return False
        if self.k == PUNCT:
            if self.t == "{":
                return not self.no_struct
            return self.t in ("(", "[", "-", "!", "*", "&", "&&", "|", "||", "<", "::", "#")
        return not (self.k == NAME and self.t in ("as", "else", "in", "where"))

    def no_struct_expr(self) -> None:
        held, self.no_struct = self.no_struct, True
        self.condition()
        self.no_struct = held

    def condition(self) -> None:
        self.expr()

    def binary(self, least: int) -> None:
        self.unary()
        self.binary_tail(least)

    def binary_tail(self, least: int) -> None:
        compared = False
        while True:
            if self.k == NAME:
                if self.t != "as":
                    return
                self.next()
                self.type(False)
                continue
            if self.k != PUNCT:
                return
            p = _BINARY.get(self.t)
            if p is None or p <= least:
                return
            if p == 3:
                if compared:
                    raise self.bad()
                compared = True
            elif compared and p > 3:
                return
            self.next()
            self.binary(p)

    def unary(self) -> None:
        while self.k == PUNCT:
            t = self.t
            if t in ("-", "!", "*"):
                self.next()
            elif t == "&" or t == "&&":
                self.next()
                if self.word("raw") and self.peek()[1] in ("const", "mut"):
                    self.next()
                    self.next()
                else:
                    self.eat_word("mut")
            else:
                break
        self.operand()
        self.postfix_tail()

    def postfix_tail(self) -> None:
        while self.k == PUNCT:
            t = self.t
            if t == ".":
                self.next()
                if self.k == NUM:
                    self.next()
                elif self.k == NAME and (self.t not in KEYWORDS or self.t == "await"):
                    self.next()
                    if self.is_("::"):
                        self.next()
                        self.generics_arguments()
                        if not self.is_("("):
                            raise self.bad()
                else:
                    raise self.bad()
            elif t == "?":
                self.next()
            elif t == "(":
                self.list(")")
            elif t == "[":
                self.next()
                held, self.no_struct = self.no_struct, False
                self.expr()
                self.no_struct = held
                self.need("]")
            else:
                return

    def list(self, end: str) -> int:
        self.next()
        held, self.no_struct = self.no_struct, False
        while not self.is_(end):
            self.attributes()
            self.expr()
            if not self.is_(end):
                self.need(",")
        self.next()
        self.no_struct = held
        return 0

    def operand(self) -> None:
        k, t = self.k, self.t
        if k in (NUM, STR, CHR):
            self.next()
            return
        if k == LIFE:
            self.next()
            self.need(":")
            if not (self.is_("{") or self.k == NAME and self.t in ("loop", "while", "for")):
                raise self.bad()
            self.operand()
            return
        if k == PUNCT:
            if t == "(":
                self.list(")")
            elif t == "[":
                self.next()
                held, self.no_struct = self.no_struct, False
                if not self.is_("]"):
                    self.attributes()
                    self.expr()
                    if self.eat(";"):
                        self.expr()
                    else:
                        while self.eat(","):
                            if self.is_("]"):
                                break
                            self.attributes()
                            self.expr()
                self.no_struct = held
                self.need("]")
            elif t == "{":
                self.block()
            elif t in ("|", "||"):
                self.closure()
            elif t in ("<", "<<"):
                self.qualified()
                self.need("::")
                self.path(False, True)
                self.after_path()
            elif t == "::":
                self.path(False, True)
                self.after_path()
            elif t == "#":
                self.attributes()
                self.unary()
            elif t in ("..", "..="):
                self.expr()
            else:
                raise self.bad()
            return
        if k != NAME:
            raise self.bad()
        if t not in KEYWORDS or t in _PATH_WORDS:
            if t == "_":
                self.next()
                return
            self.path(False, True)
            self.after_path()
        elif t == "if":
            self.if_()
        elif t == "match":
            self.match_()
        elif t == "loop":
            self.next()
            self.block()
        elif t == "while":
            self.next()
            self.no_struct_expr()
            self.block()
        elif t == "for":
            if self.peek()[1] == "<":
                self.for_lifetimes()
                self.operand()
                return
            self.next()
            self.pattern()
            if not self.eat_word("in"):
                raise self.bad()
            self.no_struct_expr()
            self.block()
        elif t in ("unsafe", "try"):
            self.next()
            self.block()
        elif t == "const":
            self.next()
            if self.is_("{"):
                self.block()
            else:
                self.operand()
        elif t in ("async", "move", "static"):
            self.next()
            self.eat_word("move")
            if self.is_("{") and t == "async":
                self.block()
            elif self.k == PUNCT and self.t in ("|", "||") or self.k == NAME and self.t in ("move", "async"):
                self.operand()
            else:
                raise self.bad()
        elif t == "let":
            self.next()
            self.pattern()
            self.need("=")
            held, self.no_struct = self.no_struct, True
            self.binary(2)
            self.no_struct = held
        elif t in ("true", "false"):
            self.next()
        elif t == "return":
            self.next()
            if self.starts_operand() or self.k == PUNCT and self.t in ("..", "{") and not self.no_struct:
                self.expr()
        elif t in ("break", "continue"):
            self.next()
            if self.k == LIFE:
                self.next()
            if t == "break" and self.starts_operand():
                self.expr()
        else:
            raise self.bad()

    def after_path(self) -> None:
        if self.is_("!") and self.peek()[1] in ("(", "[", "{"):
            self.next()
            self.tree()
        elif self.is_("{") and not self.no_struct:
            self.struct_literal()

    def struct_literal(self) -> None:
        self.next()
        while not self.is_("}"):
            self.attributes()
            if self.eat(".."):
                if not self.is_("}"):
                    self.expr()
                break
            if self.k == NUM or self.k == NAME and (self.t not in KEYWORDS):
                self.next()
            else:
                raise self.bad()
            if self.eat(":"):
                self.expr()
            if not self.is_("}"):
                self.need(",")
        self.need("}")

    def closure(self) -> None:
        if not self.eat("||"):
            self.next()
            while not self.is_("|"):
                self.attributes()
                self.one_pattern()
                if self.eat(":"):
                    self.type()
                if not self.is_("|"):
                    self.need(",")
            self.next()
        if self.eat("->"):
            self.type(False)
            self.block()
        else:
            self.expr()

    def if_(self) -> None:
        self.next()
        self.no_struct_expr()
        self.block()
        while self.eat_word("else"):
            if self.eat_word("if"):
                self.no_struct_expr()
                self.block()
            else:
                self.block()
                return

    def match_(self) -> None:
        self.next()
        self.no_struct_expr()
        self.need("{")
        held, self.no_struct = self.no_struct, False
        while True:
            self.attributes()
            if self.is_("}"):
                break
            self.pattern()
            if self.eat_word("if"):
                self.expr()
            self.need("=>")
            block = self.is_("{")
            if block:
                self.block()
                if self.k == PUNCT and self.t in (".", "?"):
                    self.postfix_tail()
                    self.binary_tail(0)
                    block = False
            else:
                block = self.k == NAME and self.t in ("if", "match", "loop", "while", "for", "unsafe")
                if block:
                    block = self.statement_expr()
                    if block and self.k == PUNCT and self.t in _BINARY:
                        self.binary_tail(0)
                        block = False
                else:
                    self.expr()
            if not self.is_("}") and not self.eat(",") and not block:
                raise self.bad()
        self.close("}")
        self.no_struct = held


def recognise(text: str) -> None:
    """Return for a valid source file, raise Bad otherwise."""
    Parser(text).program()
