"""One entry for all languages: what is wrong with a source text, if anything."""

from __future__ import annotations

import ast
import io
import json
import re
import sys
import tokenize
import warnings

from twinspan.llm.syntax import ecma, rust
from twinspan.llm.syntax.base import Bad, explain

LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "json": "json"}
#: Frames of the recognisers' pushdown (calls of Python functions live on the heap, about 1 kB a nested level).
#: A text that needs more, some 400,000 nested levels, is too deep for any compiler and does not parse.
DEPTH = 4_000_000
#: Python files are held to the grammar of this version.
PYTHON = (3, 13)


def _constant(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_constant, parse_int=len, parse_float=len)
_JSON_TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\],:])|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9A-Fa-f]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(\Z))")


def json_pushdown(text: str) -> None:
    """The JSON grammar with a stack of its own, for any depth."""
    stack: list[str] = []
    want, i = "value", 0
    while True:
        m = _JSON_TOKEN.match(text, i)
        if m is None:
            raise Bad("unexpected_token", i)
        i, t = m.end(), m.group(1) or m.group(2)
        at = i - len(t or "")
        if t is None:
            if stack or want != "end":
                raise Bad("premature_end", at)
            return
        if want in ("value", "value or ]") and t == "[":
            stack.append("]")
            want = "value or ]"
        elif want in ("value", "value or ]") and t == "{":
            stack.append("}")
            want = "key or }"
        elif t == "]" and (want == "value or ]" or want == "next") and stack and stack[-1] == "]" or t == "}" and (want == "key or }" or want == "next") and stack and stack[-1] == "}":
            stack.pop()
            want = "next" if stack else "end"
        elif want in ("value", "value or ]") and m.group(2):
            want = "next" if stack else "end"
        elif want in ("key", "key or }") and t[0] == '"':
            want = "colon"
        elif want == "colon" and t == ":":
            want = "value"
        elif want == "next" and t == ",":
            want = "key" if stack[-1] == "}" else "value"
        else:
            raise Bad("unbalanced_delimiter" if t in "]}" else "unexpected_token", at)


def _json(text: str) -> None:
    try:
        _JSON.decode(text)
    except RecursionError:
        json_pushdown(text)
    except json.JSONDecodeError as e:
        kind = "unterminated_literal" if e.msg.startswith("Unterminated") else "premature_end" if not text[e.pos :].strip() else "unbalanced_delimiter" if text[e.pos] in "]}" else "unexpected_token"
        raise Bad(kind, e.pos) from None
    except ValueError:
        raise Bad("unexpected_token", 0) from None


def _python(text: str) -> None:
    if sys.version_info[:2] != PYTHON:
        raise RuntimeError(f"Python files are judged by the worker's own parser, which must be {PYTHON[0]}.{PYTHON[1]}, not {sys.version.split()[0]}")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<text>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except SyntaxError as e:
        lines = text.split("\n")
        at = sum(len(x) + 1 for x in lines[: max(0, min((e.lineno or 1), len(lines)) - 1)])
        said = e.msg or ""
        kind = "unterminated_literal" if said.startswith("unterminated") else "premature_end" if "never closed" in said or "unexpected EOF" in said or not text[at:].strip() else "unbalanced_delimiter" if "parenthesis" in said and "match" in said else "unexpected_token"
        raise Bad(kind, at) from None
    except ValueError:
        raise Bad("unexpected_token", text.find("\0")) from None
    except (RecursionError, MemoryError):
        _python_delimiters(text)
        raise Bad("nesting_too_deep", 0) from None  # the language's own parser refuses it


def _python_delimiters(text: str) -> None:
    """What is wrong with literals and delimiters, on an explicit stack, of a text the parser gave up on."""
    close, stack = {"(": ")", "[": "]", "{": "}"}, []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.OP and token.string in close:
                stack.append(close[token.string])
            elif token.type == tokenize.OP and token.string in ")]}" and (not stack or token.string != stack.pop()):
                raise Bad("unbalanced_delimiter", 0)
    except (tokenize.TokenError, SyntaxError):
        raise Bad("premature_end", len(text)) from None
    if stack:
        raise Bad("premature_end", len(text))


def problem(text: str, extension: str) -> tuple[str, int] | None:
    """``kind, offset`` of what makes the text invalid in its language, else None.

    Blank texts are valid code, but no JSON. Kinds: merge_conflict_marker,
    unterminated_literal, premature_end, unbalanced_delimiter,
    unexpected_token, nesting_too_deep (more than ``DEPTH`` frames, or more
    than the parser of Python itself takes).
    """
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    try:
        if extension == "json":
            _json(text)
        elif text.strip("﻿ \t\r\n\f"):
            text = text.removeprefix("﻿")
            if extension == "py":
                _python(text)
            elif extension == "rs":
                rust.recognise(text)
            else:
                ecma.recognise(text, extension != "js", extension == "tsx")
    except Bad as e:
        return explain(text, e), e.at
    except (RecursionError, MemoryError):
        return "nesting_too_deep", 0
    return None
