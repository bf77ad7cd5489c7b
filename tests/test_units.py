"""Units and their renaming, on sources of our own."""

import pytest

from twinspan.operators.units import Unparsable, file_units, tier_b

PY = """
@cached(ttl=3)
def load(rows, *, limit: int = 5) -> Total:
    # keep
    kept = [r for r in rows if r.size > limit]
    return Total(items=kept, note=f"{limit} of")


class Box(Base):
    side: int = 2

    def area(self):
        return self.side * self.side
"""
RS = """
pub struct Point { pub x: u32, y: Vec<u8> }

impl Point {
    pub fn grow(&mut self, by: u32) -> u32 {
        let next = self.x + by * 2;
        self.x = next;
        next
    }
}
"""
TS = """
export class Counter<T> {
  constructor(private readonly start: number) {}
  total(rows: Row[]): number {
    let sum = this.start;
    for (const row of rows) { sum += row.size; }
    return sum;
  }
}
export const pick = async (key: string): Promise<number> => { const parts = key.split("|"); return parts.length; };
"""


def stream(text, ext, kind, n=0, **more):
    return [u for u in file_units(text, ext, **more) if u["kind"] == kind][n]


def test_python_units_and_kept_names():
    units = file_units(PY, "py")
    assert [(u["kind"], u["start_line"], u["end_line"]) for u in units] == [("function_definition", 3, 6), ("class_definition", 9, 13), ("function_definition", 12, 13)]
    texts = [t for _, t in units[0]["tokens"]]
    assert "load" in texts and "Total" in texts and "items" in texts and "size" in texts and "rows" not in texts


@pytest.mark.parametrize(("text", "ext", "renames"), [(PY, "py", [("rows", "lines"), ("kept", "good"), ("limit", "most")]), (RS, "rs", [("grow", "add"), ("next", "then"), ("by", "step")]), (TS, "ts", [("sum", "acc"), ("row ", "one "), ("row.", "one."), ("parts", "bits")])])
def test_renamed_copies_are_equal(text, ext, renames):
    other = text
    for a, b in renames:
        other = other.replace(a, b)
    one, two = file_units(text, ext), file_units(other, ext)
    assert other != text
    kinds = {u["kind"] for u in one}
    assert len(one) == len(two) >= 3 or ext == "py", kinds
    if ext != "py":
        assert [u["hash"] for u in one] == [u["hash"] for u in two]


def test_nested_units_number_their_names_anew():
    klass, method = stream(PY, "py", "class_definition"), stream(PY, "py", "function_definition", 1)
    assert method["tokens"][3] == ("identifier", "v1") and len(klass["tokens"]) > len(method["tokens"])
    assert all(method["start"] <= a < b <= method["end"] for a, b, _ in method["spans"])


def test_kinds_of_other_languages():
    assert [u["kind"] for u in file_units(RS, "rs")] == ["struct_item", "impl_item", "function_item"]
    assert sorted(u["kind"] for u in file_units(TS, "ts")) == ["arrow_function", "class_declaration", "method_definition", "method_definition"]
    jsx = "export function Card({ name }: Props) {\n  return <b className=\"x\" onClick={() => go(name)}>Hi, {name}</b>;\n}\n"
    assert sorted(u["kind"] for u in file_units(jsx, "tsx")) == ["arrow_function", "function_declaration"]


def test_literals_count_unless_aggressive():
    a, b = "def f(x):\n    y = x + 1\n    return y\n", "def f(x):\n    y = x + 2\n    return y\n"
    assert stream(a, "py", "function_definition")["hash"] != stream(b, "py", "function_definition")["hash"]
    assert stream(a, "py", "function_definition", aggressive=True)["hash"] == stream(b, "py", "function_definition", aggressive=True)["hash"]


def test_broken_files_raise():
    for text, ext in [("def f(:\n", "py"), ("fn f() {", "rs"), ("function f( {", "ts"), ("/* x", "rs")]:
        with pytest.raises(Unparsable):
            file_units(text, ext)


def test_groups_and_issues(spark):
    body = "    a = x + 1\n    b = a * 2\n    return [a, b, x]\n"
    files = [("p/a.py", "def f(x):\n" + body), ("p/b.py", "import os\n\ndef f(y):\n" + body.replace("x", "y").replace("a ", "q ").replace("a,", "q,")), ("p/c.py", "def f(:"), ("p/d.py", None), ("p/e.md", "def"), ("p/one.py", "def f(x): return 1\n")]
    found, issues = tier_b(spark.createDataFrame(files, "path string, text string"))
    assert sorted((r["path"], r["start_line"], r["end_line"]) for r in found.collect()) == [("p/a.py", 1, 4), ("p/b.py", 3, 6)]
    assert [(r["path"], r["kind"]) for r in issues.collect()] == [("p/c.py", "tier_b_parse")]
    assert tier_b(spark.createDataFrame([], "path string, text string"))[0].count() == 0
