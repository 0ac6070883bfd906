"""Declarations of six languages, and what is made of broken files."""

import pytest

from tessera.operators import chunking, declarations

CASES = {
    "typescript": (
        """import { a,
  b } from "x";
/* { class No { */
@Component({ selector: 'x' })
export class Box<T> extends Base {
  constructor(private x: number, y = {}) {
    for (let i = 0; i < 3; i++) { }
  }
  async *get(a: { b: number }): Promise<void> { return `} ${x}`; }
}
export default async function main(a = {}, [b]) {
  const r = /[{]\\/"/g;
  function inner() { return "}" }
}
const f = async (x: number): Promise<number> => {
  return x
}
interface Foo { a(): void }
foo(function () { }, () => { })
""",
        [("import", None, 1, 2, None), ("class", "Box", 5, 10, None), ("function", "constructor", 6, 8, "Box"), ("function", "get", 9, 9, "Box"), ("function", "main", 11, 14, None), ("function", "inner", 13, 13, None), ("function", "f", 15, 17, None), ("class", "Foo", 18, 18, None)],
    ),
    "rust": (
        """use std::{a, b};
#[derive(Debug)]
pub struct P<'a> { x: &'a str }
impl<'a> Display for P<'a> {
    pub async fn f<T: Into<String>>(&self, c: char) -> Result<(), E> where T: Sized {
        let s = r#"} " {"#; let q = '{';
        match c { '}' => {}, _ => {} }
    }
}
trait T { fn g(&self); fn h(&self) -> i32 { 1 } }
""",
        [("import", None, 1, 1, None), ("class", "P", 3, 3, None), ("class", "P", 4, 9, None), ("function", "f", 5, 8, "P"), ("class", "T", 10, 10, None), ("function", "h", 10, 10, "T")],
    ),
    "go": (
        """import (
  "fmt"
)
type Box struct {
  a int
}
func (b *Box) Get(x func(int) int) (int, error) {
  if x := 1; x > 0 { return `}`, nil }
  go func() { }()
}
""",
        [("import", None, 1, 3, None), ("class", "Box", 4, 6, None), ("function", "Get", 7, 10, None)],
    ),
    "java": (
        '''import java.util.*;
public final class Box<T extends A> implements B {
  static { init(); }
  public Box(int x) { this.x = x; }
  public <R> List<Map<String, R>> get(final int a, String... b) throws E {
    while (true) { if (a > 1) { } else { } }
    Runnable r = () -> { };
  }
  String s = """
    } { """;
}
record R(int x) { }
''',
        [("import", None, 1, 1, None), ("class", "Box", 2, 11, None), ("function", "Box", 4, 4, "Box"), ("function", "get", 5, 8, "Box"), ("class", "R", 12, 12, None)],
    ),
    "cpp": (
        """#include <vector>
#define X(a) { \\
   a
namespace n {
template <typename T>
class Box : public Base<T> {
 public:
  ~Box() { }
  bool operator==(const Box& o) const { return x_ == o.x_; }
};
}
int Box::other(std::vector<int> v) {
  auto f = [&](int x) { return x; };
  switch (x) { default: break; }
}
static const char* raw = R"x(} " {)x";
""",
        [("import", None, 1, 1, None), ("class", "Box", 5, 10, None), ("function", "~Box", 8, 8, "Box"), ("function", "operator==", 9, 9, "Box"), ("function", "Box::other", 12, 15, None)],
    ),
    "python": ("import os\nclass A:\n    if x:\n        def g(self):\n            return 1\n", [("import", None, 1, 1, None), ("class", "A", 2, 5, None), ("function", "g", 4, 5, "A")]),
}


@pytest.mark.parametrize("language", CASES)
def test_languages(language):
    code, want = CASES[language]
    got = declarations.declared(code, language)
    assert not [d for d in got if d[0] == "error"]
    key = lambda x: tuple(map(str, x))
    assert sorted(((d[0], d[1], d[3], d[4], d[5]) for d in got), key=key) == sorted(want, key=key)
    assert all(d[2].split()[0] in code for d in got)


def test_errors_and_recovery():
    found = lambda code, lang="typescript": [(d[0], d[1] or d[6], d[3]) for d in declarations.declared(code, lang)]
    assert found("class A {\n f( {\n }\n}\nfunction g() { }\n/* x") == [("class", "A", 1), ("error", "( is not closed", 2), ("function", "g", 5), ("error", "comment does not end", 6)]
    assert found("f() }\nclass B { g() { } }\n", "java") == [("error", "} closes nothing", 1), ("class", "B", 2), ("function", "g", 2)]
    assert found("function f() {\n let s = 'open\n}\nfunction g() {\n") == [("function", "f", 1), ("error", "string does not end", 2), ("function", "g", 4), ("error", "{ is not closed", 4)]
    assert found("def (:\n", "python")[0][0] == "error" and found(None) == found("") == [] and found("x\0y", "python")[0][0] == "error"
    assert declarations.language("none such") is declarations.language("javascript") is declarations.language("typescript")
    deep = "{" * 20_000 + "}" * 20_000
    assert found(deep) == [] and len(found("/" * 5000 + "*" * 100_000 + "\n" + '"' + "\\x" * 50_000)) == 1


def test_chunks_stay_in_their_file(spark):
    f = spark.createDataFrame([("a.rs", CASES["rust"][0], "rust"), ("b.go", CASES["go"][0], "go"), ("none", None, None), ("empty", "", "java")], "path string, content string, language string")
    got = {(r.path, r.kind, r.name, r.start_line): r for r in chunking.structural(f).collect()}
    assert {k[:3] for k in got} == {("a.rs", "class", "P"), ("a.rs", "class", "T"), ("b.go", "class", "Box"), ("b.go", "function", "Get")}
    assert got["b.go", "class", "Box", 4].content == "type Box struct {\n  a int\n}"
    assert chunking.parse(f.limit(0)).count() == 0
