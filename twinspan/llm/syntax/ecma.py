"""JavaScript (ES module), TypeScript and TypeScript with JSX."""

from __future__ import annotations

import re

from twinspan.llm.syntax.base import Bad

_ID = r"(?:[A-Za-z_$]|[^\W\d]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*"
_NUMBER = r"0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)"
_STRING = r"\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
TOKEN = re.compile(rf"((?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?\*/)*+)(?:({_ID})|({_PUNCT}(?<!\.(?=\d)))|({_NUMBER})|({_STRING})|(`)|(\#{_ID})|(\Z))")
NAME, PUNCT, NUM, STR, TICK, PRIVATE, END = 2, 3, 4, 5, 6, 7, 8
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_JSX_NAME = re.compile(rf"({_ID}(?:-[\w$]*)*)")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?\*/)*")
_LINE = re.compile(r"[\n\r  ]")
_WORD_AFTER = re.compile(r"[\w$\\]")

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with await yield let static implements interface package private protected public".split())
_SOFT = frozenset("let static implements interface package private protected public yield".split())  # names in sloppy places of TypeScript
HARD = RESERVED - _SOFT - {"await"}
BINARY = {"||": 1, "??": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("! ~ + -".split())
_MODIFIERS = frozenset("public private protected static abstract readonly override declare accessor async".split())
_AFTER_TYPE_ARGS = frozenset("( ) ] : ; , . ?. == === != !== && || ?? ^ | }".split())


class Parser:
    def __init__(self, text: str, typescript: bool, jsx: bool):
        self.s, self.ts, self.jsx = text, typescript, jsx
        self.i = 0
        if text.startswith("#!"):
            m = _LINE.search(text)
            self.i = m.start() if m else len(text)
        self.k, self.t, self.nl, self.at = 0, "", False, 0
        self.function = 0  # depth of functions
        self.asyn = True  # await allowed
        self.gen = False
        self.no_in = False
        self.lhs = False
        self.next()

    # -- lexer

    def next(self) -> None:
        m = TOKEN.match(self.s, self.i)
        if m is None:
            gap = _SPACE.match(self.s, self.i).end()
            c = self.s[gap : gap + 1]
            raise Bad("unterminated_literal" if c in "\"'" or self.s.startswith("/*", gap) else "unexpected_token", gap)
        k = m.lastindex
        gap = m.group(1)
        self.nl = bool(gap) and ("\n" in gap or "\r" in gap or " " in gap or " " in gap)
        self.k, self.t, self.at, self.i = k, m.group(k), m.start(k), m.end()
        if k == NUM and _WORD_AFTER.match(self.s, self.i):
            raise Bad("unexpected_token", self.i)

    def save(self):
        return self.i, self.k, self.t, self.nl, self.at, self.function, self.asyn, self.gen, self.no_in

    def restore(self, state) -> None:
        self.i, self.k, self.t, self.nl, self.at, self.function, self.asyn, self.gen, self.no_in = state

    def bad(self):
        if self.k == END:
            return Bad("premature_end", self.at)
        return Bad("unbalanced_delimiter" if self.t in ")]}" else "unexpected_token", self.at)

    def peek(self) -> tuple[int, str, bool]:
        m = TOKEN.match(self.s, self.i)
        if m is None:
            return 0, "", False
        return m.lastindex, m.group(m.lastindex), bool(_LINE.search(m.group(1)))

    def is_(self, p: str) -> bool:
        return self.t == p and self.k == PUNCT

    def word(self, w: str) -> bool:
        return self.t == w and self.k == NAME

    def eat(self, p: str) -> bool:
        if self.t == p and self.k == PUNCT:
            self.next()
            return True
        return False

    def need(self, p: str) -> None:
        if self.t != p or self.k != PUNCT:
            raise self.bad()
        self.next()

    def need_word(self, w: str) -> None:
        if self.t != w or self.k != NAME:
            raise self.bad()
        self.next()

    def semicolon(self) -> None:
        if self.k == PUNCT:
            if self.t == ";":
                self.next()
                return
            if self.t == "}":
                return
        elif self.k == END:
            return
        if not self.nl:
            raise self.bad()

    def close_angle(self) -> None:
        """One > of a token that may hold several."""
        if self.k != PUNCT or self.t[0] != ">" or self.t == ">=" and False:
            raise self.bad()
        self.i = self.at + 1
        self.next()

    # -- names and bindings

    def identifier(self) -> None:
        if self.k != NAME or self.t in HARD or (self.t == "await" and not self.ts):
            raise self.bad()
        if not self.ts and self.t in _SOFT:
            raise self.bad()
        self.next()

    def binding(self) -> None:
        if self.k == PUNCT:
            if self.t == "[":
                self.next()
                while not self.is_("]"):
                    if self.eat(","):
                        continue
                    if self.eat("..."):
                        self.binding()
                    else:
                        self.binding()
                        if self.eat("="):
                            self.assign_in()
                    if not self.is_("]"):
                        self.need(",")
                self.next()
                return
            if self.t == "{":
                self.next()
                while not self.is_("}"):
                    if self.eat("..."):
                        self.binding()
                    else:
                        plain = self.k == NAME and self.t not in HARD
                        self.property_name()
                        if self.eat(":"):
                            self.binding()
                        elif not plain:
                            raise self.bad()
                        if self.eat("="):
                            self.assign_in()
                    if not self.is_("}"):
                        self.need(",")
                self.next()
                return
        self.identifier()

    def property_name(self) -> None:
        if self.k in (NAME, STR, NUM, PRIVATE):
            self.next()
        elif self.eat("["):
            self.assign_in()
            self.need("]")
        else:
            raise self.bad()

    def assign_in(self) -> None:
        held, self.no_in = self.no_in, False
        self.assign()
        self.no_in = held

    # -- program and statements

    def program(self) -> None:
        while self.k != END:
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.is_("}"):
            if self.k == END:
                raise self.bad()
            self.statement(False)
        self.next()

    def statement(self, top: bool = False) -> None:
        k, t = self.k, self.t
        if k == PUNCT:
            if t == "{":
                self.block()
                return
            if t == ";":
                self.next()
                return
            if t == "@":
                self.decorators()
                self.statement(top)
                return
        elif k == NAME:
            method = _STATEMENTS.get(t)
            if method is not None:
                if method(self, top):
                    return
        if k == NAME and t not in HARD:
            state = self.peek()
            if state[0] == PUNCT and state[1] == ":":
                self.next()
                self.next()
                self.statement(False)
                return
        self.expression()
        self.semicolon()

    def sub_statement(self) -> None:
        """A statement where no declaration may stand."""
        if self.k == NAME and (self.t in ("class", "const") or self.t == "let" and self.peek()[0] == NAME):
            raise self.bad()
        self.statement(False)

    def s_var(self, top: bool) -> bool:
        if self.t == "let":
            k, t, _ = self.peek()
            if not (k == NAME and t not in ("in", "instanceof", "of") or k == PUNCT and t in "[{"):
                return False
        if self.t == "const" and self.ts and self.peek()[1] == "enum":
            self.next()
            return self.s_enum(top)
        const = self.t == "const"
        self.next()
        self.declarators(const)
        self.semicolon()
        return True

    def declarators(self, const: bool, loop: bool = False) -> None:
        while True:
            pattern = self.k == PUNCT
            self.binding()
            if self.ts:
                if self.is_("!"):
                    self.next()
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assign()
            elif (const or pattern) and not loop and not self.ambient:
                raise self.bad()
            if not self.eat(","):
                return

    ambient = False

    def s_function(self, top: bool) -> bool:
        self.next()
        gen = self.eat("*")
        if self.k == NAME:
            self.identifier()
        elif not self.default_export:
            raise self.bad()
        self.function_rest(False, gen)
        return True

    default_export = False

    def s_async(self, top: bool) -> bool:
        k, t, nl = self.peek()
        if k == NAME and t == "function" and not nl:
            self.next()
            self.next()
            gen = self.eat("*")
            if self.k == NAME:
                self.identifier()
            elif not self.default_export:
                raise self.bad()
            self.function_rest(True, gen)
            return True
        return False

    def function_rest(self, asyn: bool, gen: bool, body_needed: bool = True) -> None:
        held = self.asyn, self.gen, self.no_in
        self.default_export = False
        if self.ts and self.is_("<"):
            self.type_parameters()
        self.asyn, self.gen, self.no_in = asyn, gen, False
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()
        if self.ts and not self.is_("{"):
            self.semicolon()  # overload or ambient signature
        else:
            self.body()
        self.asyn, self.gen, self.no_in = held

    def body(self) -> None:
        self.function += 1
        self.block()
        self.function -= 1

    def parameters(self) -> None:
        self.need("(")
        while not self.is_(")"):
            while self.is_("@"):
                self.decorators()
            rest = self.eat("...")
            if self.ts:
                while self.k == NAME and self.t in ("public", "private", "protected", "readonly", "override") and self.peek()[0] in (NAME, PUNCT) and (self.peek()[0] == NAME or self.peek()[1] in "[{"):
                    self.next()
                if self.word("this"):
                    self.next()
                else:
                    self.binding()
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                self.binding()
            if self.eat("="):
                self.assign_in()
            if not self.is_(")"):
                if rest:
                    raise self.bad()
                self.need(",")
        self.next()

    def decorators(self) -> None:
        while self.eat("@"):
            self.unary()

    def s_class(self, top: bool) -> bool:
        self.next()
        if self.k == NAME and self.t not in ("extends", "implements"):
            self.identifier()
        elif not self.default_export:
            raise self.bad()
        self.default_export = False
        self.class_rest()
        return True

    def class_rest(self) -> None:
        if self.ts and self.is_("<"):
            self.type_parameters()
        if self.word("extends"):
            self.next()
            self.unary()
            if self.ts and self.is_("<"):
                self.type_arguments()
        if self.ts and self.word("implements"):
            self.next()
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.is_("}"):
            if self.eat(";"):
                continue
            if self.k == END:
                raise self.bad()
            self.member()
        self.next()

    def member(self) -> None:
        if self.is_("@"):
            self.decorators()
        asyn = False
        while self.k == NAME and (self.t in _MODIFIERS if self.ts else self.t in ("static", "async", "accessor")):
            k, t, nl = self.peek()
            if k == PUNCT and t in ("(", "=", ";", "}", "?", "!", ":", "<", ","):
                break
            if self.t == "static" and t == "{":
                self.next()
                held = self.asyn
                self.asyn = False
                self.body()
                self.asyn = held
                return
            if nl and (self.t == "async" or k == PUNCT and t != "["):
                break
            asyn = asyn or self.t == "async"
            self.next()
        gen = self.eat("*")
        if self.k == NAME and self.t in ("get", "set"):
            k, t, _ = self.peek()
            if not (k == PUNCT and t in ("(", "=", ";", "}", "?", "!", ":", "<")):
                self.next()
        if self.ts and self.is_("[") and self.index_signature():
            self.member_end()
            return
        self.property_name()
        if self.ts and (self.is_("?") or self.is_("!")):
            self.next()
        if self.is_("(") or self.ts and self.is_("<"):
            self.function_rest(asyn, gen)
            return
        if gen or asyn:
            raise self.bad()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            held = self.asyn
            self.asyn = False
            self.function += 1
            self.assign_in()
            self.function -= 1
            self.asyn = held
        self.semicolon()

    def member_end(self) -> None:
        if not (self.eat(";") or self.eat(",")) and not self.is_("}") and not self.nl:
            raise self.bad()

    def s_if(self, top: bool) -> bool:
        self.next()
        self.condition()
        self.sub_statement()
        if self.word("else"):
            self.next()
            self.sub_statement()
        return True

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_for(self, top: bool) -> bool:
        self.next()
        if self.word("await"):
            self.next()
        self.need("(")
        self.no_in = True
        if self.is_(";"):
            pass
        elif self.k == NAME and (self.t in ("var", "const") or self.t == "let" and self.peek()[1] not in ("in", "of", ";", "=", ".")):
            self.next()
            self.declarators(False, True)
        else:
            self.expression()
        self.no_in = False
        if self.word("of"):
            self.next()
            self.assign()
        elif self.word("in"):
            self.next()
            self.expression()
        else:
            self.need(";")
            if not self.is_(";"):
                self.expression()
            self.need(";")
            if not self.is_(")"):
                self.expression()
        self.need(")")
        self.sub_statement()
        return True

    def s_while(self, top: bool) -> bool:
        self.next()
        self.condition()
        self.sub_statement()
        return True

    def s_do(self, top: bool) -> bool:
        self.next()
        self.sub_statement()
        self.need_word("while")
        self.condition()
        self.eat(";")
        return True

    def s_return(self, top: bool) -> bool:
        if not self.function:
            raise Bad("unexpected_token", self.at)
        self.next()
        if not (self.nl or self.k == END or self.k == PUNCT and self.t in (";", "}")):
            self.expression()
        self.semicolon()
        return True

    def s_throw(self, top: bool) -> bool:
        self.next()
        if self.nl:
            raise self.bad()
        self.expression()
        self.semicolon()
        return True

    def s_jump(self, top: bool) -> bool:
        self.next()
        if self.k == NAME and not self.nl and self.t not in HARD:
            self.next()
        self.semicolon()
        return True

    def s_debugger(self, top: bool) -> bool:
        self.next()
        self.semicolon()
        return True

    def s_try(self, top: bool) -> bool:
        self.next()
        self.block()
        handled = False
        if self.word("catch"):
            handled = True
            self.next()
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.word("finally"):
            handled = True
            self.next()
            self.block()
        if not handled:
            raise self.bad()
        return True

    def s_switch(self, top: bool) -> bool:
        self.next()
        self.condition()
        self.need("{")
        while not self.is_("}"):
            if self.word("default"):
                self.next()
            else:
                self.need_word("case")
                self.expression()
            self.need(":")
            while not (self.is_("}") or self.word("case") or self.word("default")):
                if self.k == END:
                    raise self.bad()
                self.statement(False)
        self.next()
        return True

    def s_import(self, top: bool) -> bool:
        k, t, _ = self.peek()
        if k == PUNCT and t in ("(", "."):
            return False
        if not top:
            raise self.bad()
        self.next()
        if self.k != STR:
            if self.ts and self.word("type"):
                k, t, _ = self.peek()
                if k == NAME and t != "from" or k == PUNCT and t in "{*" or k == NAME and t == "from" and self.s[self.i :].lstrip()[4:].lstrip()[:4] == "from":
                    self.next()
            if self.k == NAME:
                self.identifier()
                if self.ts and self.eat("="):
                    if self.word("require"):
                        self.next()
                        self.need("(")
                        if self.k != STR:
                            raise self.bad()
                        self.next()
                        self.need(")")
                    else:
                        self.type()
                    self.semicolon()
                    return True
                if self.eat(","):
                    if not (self.is_("{") or self.is_("*")):
                        raise self.bad()
            if self.eat("*"):
                self.need_word("as")
                self.identifier()
            elif self.is_("{"):
                self.specifiers(True)
            self.need_word("from")
        self.module_name()
        return True

    def module_name(self) -> None:
        if self.k != STR:
            raise self.bad()
        self.next()
        if self.k == NAME and self.t in ("with", "assert") and not self.nl:
            self.next()
            self.operand()
        self.semicolon()

    def specifiers(self, local: bool) -> None:
        self.need("{")
        while not self.is_("}"):
            if self.k not in (NAME, STR):
                raise self.bad()
            if self.ts and self.word("type") and self.peek()[0] in (NAME, STR) and self.peek()[1] != "as":
                self.next()
            self.next()
            if self.word("as"):
                self.next()
                if self.k not in (NAME, STR):
                    raise self.bad()
                self.next()
            if not self.is_("}"):
                self.need(",")
        self.next()

    def s_export(self, top: bool) -> bool:
        if not top:
            raise self.bad()
        self.next()
        if self.word("default"):
            self.next()
            self.default_export = True
            if self.k == NAME and (self.t in ("function", "class") or self.t == "async" and self.peek()[1] == "function" or self.ts and self.t in ("abstract", "interface") and self.peek()[0] == NAME):
                self.statement(True)
                self.default_export = False
            elif self.is_("@"):
                self.statement(True)
            else:
                self.default_export = False
                self.assign()
                self.semicolon()
            self.default_export = False
            return True
        if self.ts and self.word("type") and self.peek()[1] in ("{", "*"):
            self.next()
        if self.eat("*"):
            if self.word("as"):
                self.next()
                if self.k not in (NAME, STR):
                    raise self.bad()
                self.next()
            self.need_word("from")
            self.module_name()
        elif self.is_("{"):
            self.specifiers(False)
            if self.word("from"):
                self.next()
                self.module_name()
            else:
                self.semicolon()
        elif self.ts and self.eat("="):
            self.expression()
            self.semicolon()
        elif self.ts and self.word("as"):
            self.next()
            self.need_word("namespace")
            self.identifier()
            self.semicolon()
        elif self.is_("@"):
            self.statement(True)
        elif self.ts and self.word("import"):
            self.statement(True)
        elif self.k == NAME and (self.t in ("var", "let", "const", "function", "class") or self.t == "async" and self.peek()[1] == "function" or self.ts and self.t in _TS_DECLARATIONS and self.peek()[0] in (NAME, STR, PUNCT)):
            before = self.at
            if not _STATEMENTS[self.t](self, True):
                raise Bad("unexpected_token", before)
        else:
            raise self.bad()
        return True

    # -- TypeScript declarations

    def s_interface(self, top: bool) -> bool:
        k, t, nl = self.peek()
        if not self.ts or k != NAME or nl:
            return False
        self.next()
        self.identifier()
        if self.is_("<"):
            self.type_parameters()
        if self.word("extends"):
            self.next()
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()
        return True

    def s_type(self, top: bool) -> bool:
        k, t, nl = self.peek()
        if not self.ts or k != NAME or nl:
            return False
        self.next()
        self.identifier()
        if self.is_("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()
        return True

    def s_enum(self, top: bool) -> bool:
        if not self.ts:
            raise self.bad()
        self.next()
        self.identifier()
        self.need("{")
        while not self.is_("}"):
            self.property_name()
            if self.eat("="):
                self.assign_in()
            if not self.is_("}"):
                self.need(",")
        self.next()
        return True

    def s_namespace(self, top: bool) -> bool:
        k, t, nl = self.peek()
        if not self.ts or k not in (NAME, STR) or nl:
            return False
        self.next()
        if self.k == STR:
            self.next()
        else:
            self.identifier()
            while self.eat("."):
                self.identifier()
        if self.is_("{"):
            self.next()
            while not self.is_("}"):
                if self.k == END:
                    raise self.bad()
                self.statement(True)
            self.next()
        else:
            self.semicolon()
        return True

    def s_declare(self, top: bool) -> bool:
        k, t, nl = self.peek()
        if not self.ts or k != NAME or nl:
            return False
        self.next()
        if self.word("global") and self.peek()[1] == "{":
            self.next()
            self.block()
            return True
        self.ambient = True
        self.statement(top)
        self.ambient = False
        return True

    def s_abstract(self, top: bool) -> bool:
        if not self.ts or self.peek()[1] != "class":
            return False
        self.next()
        return self.s_class(top)

    # -- expressions

    def expression(self) -> None:
        self.assign()
        while self.is_(","):
            self.next()
            self.assign()
            self.lhs = False

    def assign(self) -> None:
        if self.k == NAME:
            t = self.t
            if t == "yield" and self.gen:
                self.next()
                if not self.nl:
                    if self.eat("*"):
                        self.assign()
                    elif not (self.k == END or self.k == PUNCT and self.t in (")", "]", "}", ",", ";", ":")):
                        self.assign()
                self.lhs = False
                return
            if t == "async":
                k, n, nl = self.peek()
                if not nl and k == NAME and n != "function" and n not in HARD:
                    self.next()
                    self.identifier()
                    self.arrow_body(True)
                    return
            elif t not in HARD:
                k, n, _ = self.peek()
                if n == "=>" and k == PUNCT:
                    self.identifier()
                    self.arrow_body(False)
                    return
        self.conditional()
        if self.k == PUNCT and self.t in ASSIGN:
            if not self.lhs:
                raise self.bad()
            self.next()
            self.assign()
            self.lhs = False

    def arrow_body(self, asyn: bool) -> None:
        if self.nl:
            raise self.bad()
        self.need("=>")
        held = self.asyn, self.gen
        self.asyn, self.gen = asyn, False
        if self.is_("{"):
            no_in, self.no_in = self.no_in, False
            self.body()
            self.no_in = no_in
        else:
            self.assign()
        self.asyn, self.gen = held
        self.arrow = True
        self.lhs = False

    arrow = False

    def conditional(self) -> None:
        self.arrow = False
        self.binary()
        if self.arrow:
            return
        if self.is_("?"):
            if self.ts and self.peek()[1] in (":", ",", ")", "=") and self.peek()[0] == PUNCT:
                return  # an optional parameter of what may become an arrow function
            self.next()
            self.assign_in()
            self.need(":")
            self.assign()
            self.lhs = self.arrow = False

    def binary(self) -> None:
        self.unary()
        while not self.arrow:
            k, t = self.k, self.t
            if k == PUNCT:
                if t not in BINARY:
                    return
            elif k == NAME:
                if t == "in":
                    if self.no_in:
                        return
                elif t == "instanceof":
                    pass
                elif self.ts and t in ("as", "satisfies") and not self.nl:
                    self.next()
                    if self.word("const"):
                        self.next()
                    else:
                        self.type()
                    continue
                else:
                    return
            else:
                return
            self.next()
            self.unary()
            self.lhs = False

    def unary(self) -> None:
        k, t = self.k, self.t
        if k == PUNCT:
            if t in _PREFIX:
                self.next()
                self.unary()
                self.lhs = False
                return
            if t == "++" or t == "--":
                self.next()
                self.unary()
                if not self.lhs:
                    raise self.bad()
                self.lhs = False
                return
            if t == "<" and self.ts and not self.jsx:
                self.angle()
                return
        elif k == NAME:
            if t in ("typeof", "void", "delete"):
                self.next()
                self.unary()
                self.lhs = False
                return
            if t == "await" and (self.asyn or self.ts):
                n = self.peek()
                if self.asyn or n[0] != PUNCT:
                    if not self.asyn:
                        raise self.bad()
                    self.next()
                    self.unary()
                    self.lhs = False
                    return
        self.postfix()

    def angle(self) -> None:
        """<T>(x) => y, or the assertion <T>x."""
        state = self.save()
        try:
            self.type_parameters()
            if self.is_("(") and self.arrow_function(False):
                return
        except Bad:
            pass
        self.restore(state)
        self.next()
        self.type()
        self.close_angle()
        self.unary()
        self.lhs = False

    def arrow_function(self, asyn: bool) -> bool:
        """At the parenthesis of what must be an arrow function."""
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()
        if not self.is_("=>"):
            return False
        self.arrow_body(asyn)
        return True

    def postfix(self) -> None:
        self.operand()
        if self.arrow:
            return
        while True:
            k, t = self.k, self.t
            if k == PUNCT:
                if t == ".":
                    self.next()
                    if self.k not in (NAME, PRIVATE):
                        raise self.bad()
                    self.next()
                    self.lhs = True
                elif t == "(":
                    self.arguments()
                    self.lhs = False
                elif t == "[":
                    self.next()
                    held, self.no_in = self.no_in, False
                    self.expression()
                    self.no_in = held
                    self.need("]")
                    self.lhs = True
                elif t == "?.":
                    self.next()
                    if self.is_("("):
                        self.arguments()
                    elif self.eat("["):
                        self.expression()
                        self.need("]")
                    elif self.k in (NAME, PRIVATE):
                        self.next()
                    elif not self.is_("`"):
                        raise self.bad()
                    self.lhs = False
                elif (t == "++" or t == "--") and not self.nl:
                    if not self.lhs:
                        raise self.bad()
                    self.next()
                    self.lhs = False
                elif t == "!" and self.ts and not self.nl:
                    self.next()
                elif (t == "<" or t == "<<") and self.ts:
                    state = self.save()
                    try:
                        self.type_arguments()
                        if not (self.k == TICK or self.k == END or self.nl or self.k == PUNCT and self.t in _AFTER_TYPE_ARGS):
                            raise self.bad()
                    except Bad:
                        self.restore(state)
                        return
                    self.lhs = False
                else:
                    return
            elif k == TICK:
                self.template()
                self.lhs = False
            else:
                return

    def arguments(self) -> None:
        self.next()
        held, self.no_in = self.no_in, False
        while not self.is_(")"):
            self.eat("...")
            self.assign()
            if not self.is_(")"):
                self.need(",")
        self.next()
        self.no_in = held
        self.arrow = False

    def template(self) -> None:
        """At the back quote that opens it."""
        held, self.no_in = self.no_in, False
        while True:
            m = _TEMPLATE.match(self.s, self.i)
            if m is None:
                raise Bad("unterminated_literal", self.at)
            self.i = m.end()
            if m.group(1) == "`":
                self.next()
                self.no_in = held
                return
            self.next()
            self.expression()
            if not self.is_("}"):
                raise self.bad()
            self.arrow = False

    def operand(self) -> None:
        k, t = self.k, self.t
        self.lhs = False
        if k == NAME:
            if t not in HARD:
                if t == "async":
                    n = self.peek()
                    if n[1] == "function" and not n[2]:
                        self.next()
                        self.next()
                        gen = self.eat("*")
                        if self.k == NAME:
                            self.next()
                        self.function_rest(True, gen)
                        return
                    if (n[1] == "(" or self.ts and n[1] == "<") and n[0] == PUNCT and not n[2]:
                        state = self.save()
                        try:
                            self.next()
                            if self.is_("<"):
                                self.type_parameters()
                            if self.arrow_function(True):
                                return
                        except Bad:
                            pass
                        self.restore(state)
                self.identifier()
                self.lhs = True
                return
            if t in ("this", "null", "true", "false", "super"):
                self.next()
                if t == "super" and not (self.k == PUNCT and self.t in ("(", ".", "[")):
                    raise self.bad()
                return
            if t == "function":
                self.next()
                gen = self.eat("*")
                if self.k == NAME:
                    self.next()
                self.function_rest(False, gen)
                return
            if t == "class":
                self.next()
                if self.k == NAME and self.t not in ("extends", "implements"):
                    self.identifier()
                self.class_rest()
                return
            if t == "new":
                self.next()
                if self.eat("."):
                    self.need_word("target")
                    return
                self.operand()
                while True:
                    if self.eat("."):
                        if self.k not in (NAME, PRIVATE):
                            raise self.bad()
                        self.next()
                    elif self.eat("["):
                        self.expression()
                        self.need("]")
                    else:
                        break
                if self.ts and self.is_("<"):
                    state = self.save()
                    try:
                        self.type_arguments()
                    except Bad:
                        self.restore(state)
                if self.is_("("):
                    self.arguments()
                self.lhs = False
                return
            if t == "import":
                self.next()
                if self.eat("."):
                    self.need_word("meta")
                    return
                if not self.is_("("):
                    raise self.bad()
                return
            raise self.bad()
        if k == NUM or k == STR:
            self.next()
            return
        if k == TICK:
            self.template()
            return
        if k == PUNCT:
            if t == "(":
                self.parenthesis()
                return
            if t == "[":
                self.next()
                held, self.no_in = self.no_in, False
                while not self.is_("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assign()
                    if not self.is_("]"):
                        self.need(",")
                self.next()
                self.no_in = held
                self.arrow = False
                self.lhs = True
                return
            if t == "{":
                self.object()
                return
            if t == "/" or t == "/=":
                m = _REGEX.match(self.s, self.at)
                if m is None:
                    raise Bad("unterminated_literal", self.at)
                self.i = m.end()
                self.next()
                return
            if t == "<" and self.jsx:
                self.jsx_or_generic_arrow()
                return
            if t == "@":
                self.decorators()
                if not self.word("class"):
                    raise self.bad()
                self.operand()
                return
        if k == PRIVATE and self.peek()[1] == "in":
            self.next()
            return
        raise self.bad()

    def parenthesis(self) -> None:
        """A parenthesised expression or the head of an arrow function."""
        self.next()
        held, self.no_in = self.no_in, False
        must = comma = False
        count = 0
        while not self.is_(")"):
            comma = False
            count += 1
            if self.eat("..."):
                must = True
                self.binding()
            elif self.ts and self.word("this") and self.peek()[1] == ":":
                self.next()
            else:
                self.assign()
            if self.ts:
                if self.is_("?"):
                    self.next()
                    must = True
                if self.is_(":"):
                    must = True
                    self.next()
                    self.type()
                    if self.eat("="):
                        self.assign()
            if self.is_(","):
                self.next()
                comma = True
            elif not self.is_(")"):
                raise self.bad()
        self.next()
        self.no_in = held
        self.arrow = False
        must = must or comma or not count
        if self.is_("=>"):
            self.arrow_body(False)
            return
        if self.ts and self.is_(":"):
            state = self.save()
            try:
                self.next()
                self.return_type()
                if self.is_("=>") and not self.nl:
                    self.arrow_body(False)
                    return
            except Bad:
                if must:
                    raise
            self.restore(state)
            self.arrow = False
        if must:
            raise self.bad()
        self.lhs = True

    def object(self) -> None:
        self.next()
        held, self.no_in = self.no_in, False
        while not self.is_("}"):
            if self.eat("..."):
                self.assign()
            else:
                self.property()
            if not self.is_("}"):
                self.need(",")
        self.next()
        self.no_in = held
        self.arrow = False
        self.lhs = True

    def property(self) -> None:
        asyn = False
        if self.k == NAME and self.t in ("async", "get", "set"):
            n = self.peek()
            if not (n[0] == PUNCT and n[1] in (",", ":", "(", "}", "=", "<")):
                asyn = self.t == "async"
                if asyn and n[2]:
                    raise self.bad()
                self.next()
                gen = self.eat("*")
                self.property_name()
                self.function_rest(asyn, gen)
                return
        gen = self.eat("*")
        shorthand = self.k == NAME and self.t not in HARD
        self.property_name()
        if self.is_("(") or self.ts and self.is_("<"):
            self.function_rest(False, gen)
        elif gen:
            raise self.bad()
        elif self.eat(":"):
            self.assign()
        elif not shorthand:
            raise self.bad()
        elif self.eat("="):
            self.assign()

    # -- JSX

    def jsx_or_generic_arrow(self) -> None:
        state = self.save()
        k, t, _ = self.peek()
        if self.ts and k == NAME:
            try:
                self.type_parameters(True)
                if self.is_("(") and self.arrow_function(False):
                    return
            except Bad:
                pass
            self.restore(state)
        self.i = self.at
        self.jsx_element()
        self.next()
        self.lhs = self.arrow = False

    def space(self) -> None:
        self.i = _SPACE.match(self.s, self.i).end()

    def jsx_fail(self) -> Bad:
        return Bad("premature_end" if self.i >= len(self.s) else "unexpected_token", self.i)

    def jsx_name(self) -> str:
        self.space()
        start = self.i
        while True:
            m = _JSX_NAME.match(self.s, self.i)
            if m is None:
                raise self.jsx_fail()
            self.i = m.end()
            if self.s[self.i : self.i + 1] in (".", ":") and self.i < len(self.s):
                self.i += 1
            else:
                return self.s[start : self.i]

    def jsx_expression(self, spread_only: bool = False) -> None:
        """At {; leaves self.i behind }."""
        self.i += 1
        self.next()
        if self.eat("..."):
            self.assign_in()
        elif not self.is_("}"):
            held, self.no_in = self.no_in, False
            self.expression()
            self.no_in = held
        elif spread_only:
            raise self.bad()
        if not self.is_("}"):
            raise self.bad()
        self.i = self.at + 1

    def jsx_element(self) -> None:
        """At <; leaves self.i behind the element."""
        s = self.s
        self.i += 1
        self.space()
        name = ""
        if not s.startswith(">", self.i):
            name = self.jsx_name()
            if self.ts and s.startswith("<", self.i):
                self.next()
                self.type_arguments()
                self.i = self.at
            while True:
                self.space()
                c = s[self.i : self.i + 1]
                if c == ">" or c == "/":
                    break
                if c == "{":
                    self.jsx_expression(True)
                    continue
                self.jsx_name()
                self.space()
                if s.startswith("=", self.i):
                    self.i += 1
                    self.space()
                    c = s[self.i : self.i + 1]
                    if c == "{":
                        self.jsx_expression(True)
                    elif c == "<":
                        self.jsx_element()
                    else:
                        m = _JSX_STRING.match(s, self.i)
                        if m is None:
                            raise Bad("unterminated_literal" if c in ("'", '"') else "unexpected_token", self.i)
                        self.i = m.end()
            if s.startswith("/", self.i):
                self.i += 1
                self.space()
                if not s.startswith(">", self.i):
                    raise self.jsx_fail()
                self.i += 1
                return
        self.i += 1
        while True:
            self.i = _JSX_TEXT.match(s, self.i).end()
            c = s[self.i : self.i + 1]
            if c == "{":
                self.jsx_expression()
            elif c == "<":
                m = _SPACE.match(s, self.i + 1).end()
                if s.startswith("/", m):
                    self.i = m + 1
                    self.space()
                    closing = "" if s.startswith(">", self.i) else self.jsx_name()
                    self.space()
                    if closing != name or not s.startswith(">", self.i):
                        raise Bad("unbalanced_delimiter", self.i)
                    self.i += 1
                    return
                self.jsx_element()
            else:
                raise self.jsx_fail()

    # -- types

    def type_parameters(self, jsx: bool = False) -> None:
        self.need("<")
        count = comma = extends = 0
        while not (self.k == PUNCT and self.t[0] == ">"):
            while self.k == NAME and self.t in ("const", "in", "out") and self.peek()[0] == NAME:
                self.next()
            self.identifier()
            if self.word("extends"):
                extends = 1
                self.next()
                self.type()
            if self.eat("="):
                self.type()
            count += 1
            if not (self.k == PUNCT and self.t[0] == ">"):
                self.need(",")
                comma = 1
        if not count or jsx and not (comma or extends):
            raise self.bad()
        self.close_angle()

    def type_arguments(self) -> None:
        if self.t == "<<":
            self.i = self.at + 1
            self.next()
        else:
            self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def return_type(self) -> None:
        if self.word("asserts") and self.peek()[0] == NAME and not self.peek()[2] and self.peek()[1] != "is":
            self.next()
        if self.k == NAME and self.peek()[1] == "is" and not self.peek()[2]:
            self.next()
            self.next()
        self.type()

    def type(self) -> None:
        if self.k == NAME and self.t in ("new", "abstract") and (self.t == "new" or self.peek()[1] == "new"):
            while self.k == NAME:
                self.next()
            self.function_type()
            return
        if self.is_("<"):
            self.function_type()
            return
        self.union()
        if self.word("extends") and not self.nl and not self.no_conditional:
            self.next()
            held, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = held
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    no_conditional = False

    def function_type(self) -> None:
        if self.is_("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        if self.k == PUNCT and self.t in "|&":
            self.next()
        self.array_type()
        while self.k == PUNCT and self.t in ("|", "&"):
            self.next()
            self.array_type()

    def array_type(self) -> None:
        while self.k == NAME and self.t in ("keyof", "unique", "readonly", "infer") and not (self.peek()[0] == PUNCT and self.peek()[1] in (",", ")", "]", ">", ";", "=", "|", "&", "}", "=>")):
            infer = self.t == "infer"
            self.next()
            if infer:
                self.identifier()
                if self.word("extends"):
                    state = self.save()
                    try:
                        self.next()
                        held, self.no_conditional = self.no_conditional, True
                        self.type()
                        self.no_conditional = held
                        if self.is_("?"):
                            raise self.bad()
                    except Bad:
                        self.no_conditional = False
                        self.restore(state)
                return
        self.primary_type()
        while self.is_("[") and not self.nl:
            self.next()
            if not self.is_("]"):
                self.type()
            self.need("]")

    def primary_type(self) -> None:
        k, t = self.k, self.t
        if k == NAME:
            if t == "typeof":
                self.next()
                if self.word("import"):
                    self.primary_type()
                    return
                if self.k != NAME:
                    raise self.bad()
                self.next()
                while self.eat("."):
                    if self.k not in (NAME, PRIVATE):
                        raise self.bad()
                    self.next()
                if self.is_("<") and not self.nl:
                    self.type_arguments()
                return
            if t == "import":
                self.next()
                self.need("(")
                self.type()
                if self.eat(","):
                    self.assign_in()
                self.need(")")
                while self.eat("."):
                    self.next()
                if self.is_("<") and not self.nl:
                    self.type_arguments()
                return
            if t in HARD and t not in ("void", "null", "this", "true", "false"):
                raise self.bad()
            self.next()
            if t == "this" and self.word("is"):
                self.next()
                self.type()
                return
            while self.is_("."):
                self.next()
                if self.k != NAME:
                    raise self.bad()
                self.next()
            if self.is_("<") and not self.nl or self.t == "<<" and self.k == PUNCT:
                self.type_arguments()
            return
        if k in (STR, NUM):
            self.next()
            return
        if k == TICK:
            while True:
                m = _TEMPLATE.match(self.s, self.i)
                if m is None:
                    raise Bad("unterminated_literal", self.at)
                self.i = m.end()
                if m.group(1) == "`":
                    self.next()
                    return
                self.next()
                self.type()
                if not self.is_("}"):
                    raise self.bad()
        if k == PUNCT:
            if t == "-":
                self.next()
                if self.k != NUM:
                    raise self.bad()
                self.next()
                return
            if t == "{":
                self.object_type()
                return
            if t == "[":
                self.next()
                while not self.is_("]"):
                    self.eat("...")
                    if self.k == NAME and self.peek()[1] in (":", "?") and self.peek()[0] == PUNCT:
                        self.next()
                        self.eat("?")
                        if self.eat(":"):
                            self.type()
                    else:
                        self.type()
                        self.eat("?")
                    if not self.is_("]"):
                        self.need(",")
                self.next()
                return
            if t == "(":
                state = self.save()
                try:
                    self.function_type()
                    return
                except Bad:
                    self.restore(state)
                self.next()
                held, self.no_conditional = self.no_conditional, False
                self.type()
                self.no_conditional = held
                self.need(")")
                return
        raise self.bad()

    def index_signature(self) -> bool:
        """[k: T]: U at [, if it is one."""
        n = self.peek()
        if n[0] != NAME:
            return False
        state = self.save()
        self.next()
        self.next()
        if not self.is_(":"):
            self.restore(state)
            return False
        self.next()
        self.type()
        self.need("]")
        if self.eat(":"):
            self.type()
        return True

    def object_type(self) -> None:
        self.need("{")
        held, self.no_conditional = self.no_conditional, False
        while not self.is_("}"):
            if self.k == END:
                raise self.bad()
            self.type_member()
            self.member_end()
        self.next()
        self.no_conditional = held

    def type_member(self) -> None:
        if self.k == PUNCT and self.t in ("+", "-"):
            self.next()
            self.need_word("readonly")
        if self.k == NAME and self.t in ("readonly", "get", "set", "static") and not (self.peek()[0] == PUNCT and self.peek()[1] in ("?", ":", "(", "<", ";", ",", "}")):
            self.next()
        if self.word("new") and self.peek()[1] in ("(", "<"):
            self.next()
        if self.is_("(") or self.is_("<"):
            self.signature()
            return
        if self.is_("["):
            if self.index_signature():
                return
            state = self.save()
            self.next()
            if self.k == NAME:
                self.next()
                if self.word("in"):
                    self.next()
                    self.type()
                    if self.word("as"):
                        self.next()
                        self.type()
                    self.need("]")
                    if self.k == PUNCT and self.t in ("+", "-"):
                        self.next()
                    self.eat("?")
                    if self.eat(":"):
                        self.type()
                    return
            self.restore(state)
        self.property_name()
        self.eat("?")
        if self.is_("(") or self.is_("<"):
            self.signature()
        elif self.eat(":"):
            self.type()

    def signature(self) -> None:
        if self.is_("<"):
            self.type_parameters()
        self.parameters()
        if self.eat(":"):
            self.return_type()


_TS_DECLARATIONS = frozenset("interface type enum namespace module declare abstract".split())
_STATEMENTS = {
    "var": Parser.s_var, "let": Parser.s_var, "const": Parser.s_var, "function": Parser.s_function, "async": Parser.s_async, "class": Parser.s_class,
    "if": Parser.s_if, "for": Parser.s_for, "while": Parser.s_while, "do": Parser.s_do, "return": Parser.s_return, "throw": Parser.s_throw,
    "break": Parser.s_jump, "continue": Parser.s_jump, "debugger": Parser.s_debugger, "try": Parser.s_try, "switch": Parser.s_switch,
    "import": Parser.s_import, "export": Parser.s_export, "interface": Parser.s_interface, "type": Parser.s_type, "enum": Parser.s_enum,
    "namespace": Parser.s_namespace, "module": Parser.s_namespace, "declare": Parser.s_declare, "abstract": Parser.s_abstract,
}


def recognise(text: str, typescript: bool, jsx: bool) -> None:
    """Return for a valid module, raise Bad otherwise."""
    Parser(text, typescript, jsx).program()
