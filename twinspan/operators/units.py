"""Syntactic units with renamed identifiers, grouped (tier B).

A language gives its leaves (kind, text, bytes, line, whether a name may be
renamed) and the ranges of its units. Inside a unit the names that may be
renamed become v1, v2, ... in order of first use, so renamed copies have equal
token streams.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.session import cut, spread

MIN_LINES, MIN_TOKENS = 3, 15
#: Fixed values of the unit hash and of what stands for a literal in aggressive mode.
SEED, MUL, PLACEHOLDER = 0xCBF29CE484222325, 0x100000001B3, "<LIT>"
_MASK = (1 << 64) - 1
LOCAL, KEPT, LITERAL = 0, 1, 2


@dataclass(slots=True)
class Leaf:
    kind: str
    text: str
    start: int
    end: int
    line: int
    role: int = KEPT


@dataclass(slots=True)
class Unit:
    kind: str
    start: int
    end: int


class Unparsable(Exception):
    """The text is not valid enough for units."""


def stream_hash(tokens: list[tuple[str, str]]) -> int:
    h = SEED
    for kind, text in tokens:
        for b in kind.encode() + b"\x1f" + text.encode() + b"\x1e":
            h = (h ^ b) * MUL & _MASK
    return h


def normalise(leaves: list[Leaf], aggressive: bool) -> tuple[list[tuple[str, str]], list[tuple[int, int, int]]]:
    """Token stream of a unit, and the places of its renamed names."""
    names: dict[str, int] = {}
    tokens, spans = [], []
    for leaf in leaves:
        text = leaf.text
        if leaf.role == LOCAL:
            n = names.setdefault(text, len(names) + 1)
            spans.append((leaf.start, leaf.end, n))
            text = f"v{n}"
        elif leaf.role == LITERAL and aggressive:
            text = PLACEHOLDER
        tokens.append((leaf.kind, text))
    return tokens, spans


# -- Python

_PY_ESCAPE = re.compile(r"\\(?:\r\n|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|N\{[^}]+\}|[\s\S])")
_PY_STRING = re.compile(r"(?s)([A-Za-z]*(?:\"\"\"|'''|\"|'))(.*?)(\"\"\"|'''|\"|')$")
_PY_CONSTANT = {"True": "true", "False": "false", "None": "none"}


def _covered(intervals: list[tuple[int, int]]) -> Callable[[int], bool]:
    merged: list[list[int]] = []
    for a, b in sorted(intervals):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def inside(at: int) -> bool:
        i = bisect.bisect_right(starts, at) - 1
        return i >= 0 and at < merged[i][1]

    return inside


def python_units(text: str) -> tuple[list[Leaf], list[Unit]]:
    try:
        tree = ast.parse(text)
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as e:
        raise Unparsable(str(e)) from e
    lines = io.StringIO(text, newline="").read().splitlines(keepends=True) if "\f" not in text and "\x0b" not in text else re.findall(r"[^\n]*\n|[^\n]+", text)
    base = [0]
    for x in lines:
        base.append(base[-1] + len(x.encode()))
    plain = text.isascii()

    def at(row: int, column: int) -> int:
        return base[row - 1] + (column if plain or row > len(lines) else len(lines[row - 1][:column].encode()))

    def span(node: ast.AST) -> tuple[int, int]:
        return base[node.lineno - 1] + node.col_offset, base[node.end_lineno - 1] + node.end_col_offset

    kept: list[tuple[int, int]] = []
    keywords: set[int] = set()
    units = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            units.append(Unit("class_definition" if isinstance(node, ast.ClassDef) else "function_definition", *span(node)))
            kept += [span(x) for x in node.decorator_list]
            if isinstance(node, ast.ClassDef):
                kept += [span(x) for x in node.bases] + [span(x) for x in node.keywords]
            elif node.returns:
                kept.append(span(node.returns))
        elif isinstance(node, ast.arg) and node.annotation or isinstance(node, ast.AnnAssign):
            kept.append(span(node.annotation))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            kept.append(span(node))
        elif isinstance(node, ast.pattern):
            kept.append(span(node))
        elif isinstance(node, ast.keyword) and node.arg:
            keywords.add(span(node)[0])
    inside = _covered(kept)
    leaves: list[Leaf] = []
    for t in tokens:
        if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER) or not t.string.strip():
            continue
        a, b, line, s = at(*t.start), at(*t.end), t.start[0], t.string
        name = tokenize.tok_name[t.type]
        if t.type == tokenize.COMMENT:
            leaves.append(Leaf("comment", s, a, b, line))
        elif t.type == tokenize.NUMBER:
            real = "." in s or ("e" in s.lower() and not s.lower().startswith("0x"))
            leaves.append(Leaf("float" if real else "integer", s, a, b, line, LITERAL))
        elif t.type == tokenize.STRING:
            m = _PY_STRING.match(s)
            opening, body, closing = m.groups()
            leaves.append(Leaf("string_start", opening, a, a + len(opening), line))
            inner = a + len(opening.encode())
            escapes = [] if "r" in opening.lower() else list(_PY_ESCAPE.finditer(body))
            if escapes:
                for e in escapes:
                    p = inner + len(body[: e.start()].encode())
                    leaves.append(Leaf("escape_sequence", e.group(), p, p + len(e.group().encode()), line + body.count("\n", 0, e.start()), LITERAL))
            elif body.strip():
                leaves.append(Leaf("string_content", body, inner, inner + len(body.encode()), line, LITERAL))
            leaves.append(Leaf("string_end", closing, b - len(closing), b, t.end[0]))
        elif name == "FSTRING_START":
            leaves.append(Leaf("string_start", s, a, b, line))
        elif name == "FSTRING_MIDDLE":
            leaves.append(Leaf("string_content", s, a, b, line, LITERAL))
        elif name == "FSTRING_END":
            leaves.append(Leaf("string_end", s, a, b, line))
        elif t.type == tokenize.NAME:
            before = leaves[-1].text if leaves else ""
            if s in _PY_CONSTANT:
                leaves.append(Leaf(_PY_CONSTANT[s], s, a, b, line, LITERAL))
            elif keyword.iskeyword(s):
                leaves.append(Leaf(s, s, a, b, line))
            else:
                fixed = before in (".", "def", "class") or a in keywords or inside(a)
                leaves.append(Leaf("identifier", s, a, b, line, KEPT if fixed else LOCAL))
        else:
            leaves.append(Leaf("ellipsis" if s == "..." else s, s, a, b, line))
    return leaves, units


# -- Rust

_RS_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<raw>[bc]?r(?P<h>\#*)"[\s\S]*?"(?P=h))|(?P<str>[bc]?"(?:[^"\\]|\\[\s\S])*")"""
    r"""|(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))')|(?P<life>'[^\W\d]\w*)|(?P<num>\d[\w]*(?:\.(?![._]|[^\W\d])[\d_]*(?:[eE][+-]?\d+)?\w*)?)|(?P<name>(?:r\#)?[^\W\d]\w*)"""
    r"""|(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[^\w\s])"""
)
_RS_ESCAPE = re.compile(r"\\(?:u\{[^}]*\}|x[0-9A-Fa-f]{2}|[\s\S])")
_RS_KEYWORDS = frozenset("as async await break const continue dyn else enum extern fn for if impl in let loop match mod move pub ref return static struct trait type unsafe use where while".split())
_RS_PRIMITIVE = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
_RS_OTHER = {"mut": "mutable_specifier", "self": "self", "super": "super", "crate": "crate", "true": "true", "false": "false"}
_RSUNITS = {"fn": "function_item", "impl": "impl_item", "struct": "struct_item", "enum": "enum_item"}
_RS_LEADING = frozenset("pub async unsafe const extern crate ( )".split())


def rust_units(text: str) -> tuple[list[Leaf], list[Unit]]:
    """Units by their keywords and braces; kinds of names by their neighbours."""
    raw: list[tuple[str, str, int, int]] = []
    i, line, byte = 0, 1, 0
    while i < len(text):
        m = _RS_TOKEN.match(text, i)
        if m is None:
            raise Unparsable(f"unexpected character at line {line}")
        kind, s = m.lastgroup if m.lastgroup != "h" else "raw", m.group()
        if kind == "block":
            depth, j = 1, i + 2
            while depth:
                n = re.compile(r"/\*|\*/").search(text, j)
                if n is None:
                    raise Unparsable("unterminated comment")
                depth += 1 if n.group() == "/*" else -1
                j = n.end()
            s = text[i:j]
        if kind != "space":
            raw.append((kind, s, byte, line))
        i += len(s)
        byte += len(s.encode())
        line += s.count("\n")
    leaves: list[Leaf] = []
    code = [k for k, x in enumerate(raw) if x[0] not in ("comment", "block")]
    place = {k: n for n, k in enumerate(code)}

    def near(k: int, by: int) -> str:
        n = place[k] + by
        return raw[code[n]][1] if 0 <= n < len(code) else ""

    braces: list[str] = []
    depth_kinds: list[str] = []
    last_word = ""
    for k, (kind, s, a, ln) in enumerate(raw):
        b = a + len(s.encode())
        if kind in ("comment", "block"):
            leaves.append(Leaf("line_comment" if kind == "comment" else "block_comment", s, a, b, ln))
        elif kind == "str":
            open_ = s.index('"') + 1
            leaves.append(Leaf('"', s[:open_], a, a + open_, ln))
            body = s[open_:-1]
            p = a + open_
            at = 0
            for e in [*_RS_ESCAPE.finditer(body), None]:
                part = body[at : e.start() if e else len(body)]
                if part.strip():
                    q = p + len(body[:at].encode())
                    leaves.append(Leaf("string_content", part, q, q + len(part.encode()), ln + body.count("\n", 0, at), LITERAL))
                if e:
                    q = p + len(body[: e.start()].encode())
                    leaves.append(Leaf("escape_sequence", e.group(), q, q + len(e.group().encode()), ln + body.count("\n", 0, e.start())))
                    at = e.end()
            leaves.append(Leaf('"', '"', b - 1, b, ln + s.count("\n")))
        elif kind == "raw":
            leaves.append(Leaf("raw_string_literal", s, a, b, ln, LITERAL))
        elif kind == "char":
            leaves.append(Leaf("char_literal", s, a, b, ln, LITERAL))
        elif kind == "num":
            leaves.append(Leaf("float_literal" if re.search(r"\.|f32|f64", s) and not s.startswith("0x") else "integer_literal", s, a, b, ln, LITERAL))
        elif kind == "life":
            leaves.append(Leaf("'", "'", a, a + 1, ln))
            leaves.append(Leaf("identifier", s[1:], a + 1, b, ln, LOCAL))
        elif kind == "name":
            before, after = near(k, -1), near(k, 1)
            if s in _RS_KEYWORDS:
                leaves.append(Leaf(s, s, a, b, ln))
                last_word = s if s in ("struct", "enum", "fn", "impl", "match", "trait") else last_word
            elif s in _RS_OTHER:
                leaves.append(Leaf(_RS_OTHER[s], s, a, b, ln))
            elif s in _RS_PRIMITIVE and before != ".":
                leaves.append(Leaf("primitive_type", s, a, b, ln))
            elif before == "." and near(k, -2) != "..":
                leaves.append(Leaf("field_identifier", s, a, b, ln))
            elif after == ":" and braces and braces[-1] in ("fields", "literal"):
                leaves.append(Leaf("field_identifier", s, a, b, ln))
            elif s[0].isupper() and after != "::" and not (before == "::" and after == "(") and not s.isupper():
                leaves.append(Leaf("type_identifier", s, a, b, ln))
            elif s[0].isupper() and s.isupper() and len(s) == 1:
                leaves.append(Leaf("type_identifier", s, a, b, ln))
            else:
                leaves.append(Leaf("identifier", s, a, b, ln, LOCAL))
        else:
            if s == "{":
                prior = leaves[-1] if leaves else None
                literal = prior is not None and prior.kind == "type_identifier" and last_word not in ("impl", "trait") and near(k, -2) not in ("->", "for", "impl", "trait", ">")
                braces.append("fields" if last_word == "struct" else "literal" if literal else "block")
                last_word = ""
            elif s == "}" and braces:
                braces.pop()
            elif s == ";":
                last_word = ""
            leaves.append(Leaf(s, s, a, b, ln))
    del depth_kinds
    # units: from the modifiers before the keyword to the brace that closes its body
    texts = [raw[k][1] for k in code]
    units = []
    for n, t in enumerate(texts):
        if raw[code[n]][0] != "name" or t not in _RSUNITS or (n and texts[n - 1] in (".", "::")):
            continue
        if t in ("fn", "impl") and (n + 1 >= len(texts) or texts[n + 1] == "(" or n and texts[n - 1] in (":", "->", "&", "<", ",", "(", "=") and t == "impl"):
            continue
        depth, j = 0, n + 1
        while j < len(texts):
            if texts[j] in ("(", "["):
                depth += 1
            elif texts[j] in (")", "]"):
                depth -= 1
            elif depth == 0 and texts[j] in ("{", ";"):
                break
            j += 1
        if j >= len(texts):
            raise Unparsable("premature end")
        if texts[j] == ";":
            if t != "struct":
                continue
            end = j
        else:
            depth, end = 1, j + 1
            while end < len(texts) and depth:
                depth += (texts[end] == "{") - (texts[end] == "}")
                end += 1
            if depth:
                raise Unparsable("premature end")
            end -= 1
        first = n
        while first and (texts[first - 1] in _RS_LEADING or raw[code[first - 1]][0] == "str" and texts[first - 2 : first - 1] == ["extern"]):
            first -= 1
        while texts[first] in ("(", ")"):
            first += 1
        units.append(Unit(_RSUNITS[t], raw[code[first]][2], raw[code[end]][2] + len(texts[end].encode())))
    return leaves, units


def _typescript(text: str) -> tuple[list[Leaf], list[Unit]]:
    from twinspan.operators.units_ts import typescript_units

    return typescript_units(text)


def _tsx(text: str) -> tuple[list[Leaf], list[Unit]]:
    from twinspan.operators.units_ts import tsx_units

    return tsx_units(text)


#: Leaves and units by extension; more languages may be added before a scan.
PROFILES: dict[str, Callable[[str], tuple[list[Leaf], list[Unit]]]] = {"py": python_units, "rs": rust_units, "ts": _typescript, "tsx": _tsx}


def file_units(text: str, extension: str, aggressive: bool = False) -> list[dict]:
    """Every unit of a file, nested ones too, in order of position."""
    leaves, units = PROFILES[extension](text)
    starts = [x.start for x in leaves]
    out = []
    for u in sorted(units, key=lambda u: (u.start, -u.end)):
        own = [x for x in leaves[bisect.bisect_left(starts, u.start) : bisect.bisect_left(starts, u.end)] if x.end <= u.end]
        tokens, spans = normalise(own, aggressive)
        last = own[-1]
        out.append({"kind": u.kind, "start": u.start, "end": u.end, "start_line": own[0].line, "end_line": last.line + last.text.count("\n"), "tokens": tokens, "spans": spans, "hash": stream_hash(tokens)})
    return out


UNITS = "path string, unit string, start_line int, end_line int, start_byte int, end_byte int, tokens int, group_hash bigint, part string, alpha array<struct<s:int,e:int,idx:int>>, issue string, message string"


def extract_units(corpus: DataFrame, normalization: str = "conservative") -> DataFrame:
    """One row per unit of each file with a profile, or per file that fails (issue, message)."""
    aggressive = normalization == "aggressive"
    names = [x.split()[0] for x in re.split(r", (?=[a-z_]+ )", UNITS)]
    alpha = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("idx", pa.int32())]))
    types = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.int64(), pa.string(), alpha, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    for u in file_units(text, ext, aggressive):
                        h = u["hash"]
                        stream = "\x1e".join("\x1f".join(t) for t in u["tokens"])
                        rows.append((path, u["kind"], u["start_line"], u["end_line"], u["start"], u["end"], len(u["tokens"]), h - (1 << 64) if h >> 63 else h, md5(stream.encode()).hexdigest(), [dict(zip("sei", x, strict=True)) for x in u["spans"]], None, None))
                except Unparsable as e:
                    rows.append((path, *[None] * 9, "tier_b_parse", str(e)))
                except Exception as e:  # one file never fails the scan
                    rows.append((path, *[None] * 9, "tier_b_panic", f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            columns[9] = [x and [{"s": y["s"], "e": y["e"], "idx": y["i"]} for y in x] for x in columns[9]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    files = corpus.select("path", ext.alias("ext"), "text").filter(F.col("ext").isin(*PROFILES) & F.col("text").isNotNull())
    return spread(files).mapInArrow(run, UNITS)


def tier_b(corpus: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, normalization: str = "conservative") -> tuple[DataFrame, DataFrame]:
    """Occurrences of tier B groups (equal token streams, at least two), and issues."""
    return tier_b_of(cut(extract_units(corpus, normalization)), min_lines, min_tokens)  # parsed once for counts, rows and issues


def tier_b_of(units: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """As :func:`tier_b`, from the rows of units, made now or stored by an earlier scan."""
    issues = units.filter("issue IS NOT NULL").select("path", F.col("issue").alias("kind"), "message")
    big = units.filter((F.col("end_line") - F.col("start_line") + 1 >= min_lines) & (F.col("tokens") >= min_tokens))
    kept = big.groupBy("group_hash", "part").agg(F.count("*").alias("n")).filter("n > 1").select("group_hash", "part")
    rows = big.join(kept, ["group_hash", "part"], "left_semi")
    return rows.select("group_hash", F.lit("B").alias("tier"), "part", "unit", "path", "start_line", "end_line", "start_byte", "end_byte", "tokens", "alpha"), issues
