"""Readers on tokens: what looks like code inside strings, templates, expressions, documents and comments."""

from __future__ import annotations

import pytest

from test_registry import tree
from weftgraph.sources import registry, script_code
from weftgraph.sources.lexing import Code, blanked, tokens_of
from weftgraph.sources.symbol_code import symbols_of


def found(path, text):
    at = script_code.Lines(text)
    return [(s.qualname, s.kind, at.at(start), at.at(end)) for s, start, end in symbols_of(path, text)]


def names(path, text):
    return [x[0] for x in found(path, text)]


def test_a_brace_in_a_regular_expression():
    assert found("a.ts", "function a() {\n  return /[{]/.test(x)\n}\nfunction b() {}\n") == [("a", "function", 1, 3), ("b", "function", 4, 4)]
    assert names("a.js", "const a = () => x / 2 / y\nconst b = () => { return /}/ }\nfunction c() {}\n") == ["a", "b", "c"]


def test_a_template_inside_a_template():
    assert found("a.ts", "function a() {\n  return `x ${y.map(z => `<${z}>`)} {`\n}\nfunction b() {}\n") == [("a", "function", 1, 3), ("b", "function", 4, 4)]


def test_lifetimes_and_raw_strings():
    text = "impl<'a> Foo<'a> {\n  pub fn new(x: &'a str) -> Self { let c = '{'; let s = r#\"}\"#; Foo { x } }\n}\nimpl<T: Clone> fmt::Display for Bar<T> where T: Copy {\n  fn fmt(&self) { }\n}\n/* a /* b */ fn no() {} */\ntrait T { fn sig(&self); fn own(&self) {} }\n"
    assert found("a.rs", text) == [("Foo.new", "method", 2, 2), ("Bar.fmt", "method", 5, 5), ("T", "trait", 8, 8), ("T.own", "method", 8, 8)]


def test_type_parameters():
    text = "type Stack[T any] struct {\n items []T\n}\nfunc (s *Stack[T]) Push(x T) {\n}\nfunc F[T any](x T) interface{} { return nil }\ntype (\n A struct { }\n B interface { M() }\n)\n"
    assert found("a.go", text) == [("Stack", "struct", 1, 3), ("Stack.Push", "method", 4, 5), ("F", "function", 6, 6), ("A", "struct", 8, 8), ("B", "interface", 9, 9)]


JAVA = """@Entity(name = "x{")
public class A<T> extends B {
  int f = g(1);
  @Override public String toString() { return "}"; }
  @Get("/x")
  <R> Map<String, List<R>> m(@P int a) throws E, F { if (x) { } return y; }
  abstract void n();
  A(int x) { this(); }
  static { foo(); }
  record P(int x, int y) { int s() { return x + y; } }
  enum K { ONE(1) { }, TWO(2); K(int i) {} }
  interface I { void z(); }
}
"""


def test_annotations_records_and_declarations_without_a_body():
    assert found("A.java", JAVA) == [
        ("A", "class", 1, 13), ("A.toString", "method", 4, 4), ("A.m", "method", 5, 6), ("A.n", "method", 7, 7), ("A.A", "method", 8, 8), ("A.P", "record", 10, 10), ("A.P.s", "method", 10, 10),
        ("A.K", "enum", 11, 11), ("A.K.K", "method", 11, 11), ("A.I", "interface", 12, 12), ("A.I.z", "method", 12, 12)]


def test_expression_bodies():
    text = "class A : B<int> {\n  int F() => 1;\n  public async Task<int> G<T>(string s = \"{\") where T : class { return $\"{s}}}\"; }\n  void IC.H() { var s = @\"a\"\"}\"; }\n  public A(int x) : base(x) { }\n  public int P { get; set; }\n}\npublic record R(int X, int Y);\n"
    assert found("a.cs", text) == [("A", "class", 1, 7), ("A.F", "method", 2, 2), ("A.G", "method", 3, 3), ("A.H", "method", 4, 4), ("A.A", "method", 5, 5), ("R", "record", 8, 8)]
    text = "fun String.ext(): Int = 1\nfun next(x: Int) {\n}\nclass K(val a: Int) : Base(a) {\n  override fun run(): String = \"${a.let { \"}\" }}\"\n  companion object { fun make() = K(1) }\n}\ninterface S { fun abs(): Int\n fun other() }\n"
    assert found("a.kt", text) == [("ext", "function", 1, 1), ("next", "function", 2, 3), ("K", "class", 4, 7), ("K.run", "method", 5, 5), ("K.make", "method", 6, 6), ("S", "interface", 8, 9), ("S.abs", "method", 8, 8), ("S.other", "method", 9, 9)]


def test_here_documents_and_ruby_blocks():
    text = "class A\n  def go(x)\n    y = <<~SQL\n      end\n    SQL\n    z = if x then 1 else 2 end\n    while x do\n    end\n    return if z\n    h = { if: 1, end: :end }\n    s = \"#{x.map { |q| \"end\" }}\"\n    r = /end/\n    x.end\n  end\n  def name=(v)\n  end\n  class << self\n    def d!\n      begin\n      end while false\n    end\n  end\nend\nmodule M::N\n  def self.q(*)\n    %w[end if].each do |x| puts x unless y end\n  end\nend\n"
    assert found("a.rb", text) == [("A", "class", 1, 23), ("A.go", "method", 2, 14), ("A.name=", "method", 15, 16), ("A.d!", "method", 18, 21), ("M::N", "module", 24, 28), ("M::N.q", "method", 25, 27)]
    text = "<html>don't {\n<?php\nclass A {\n  function f($x = '}') { $y = <<<EOT\n } class Z {\nEOT;\n return 1; }\n  abstract function g(): ?int;\n}\n?>\n{ it's\n<?php function h() { return \"{$a['}']}\"; }\n"
    assert found("a.php", text) == [("A", "class", 3, 9), ("A.f", "method", 4, 7), ("A.g", "method", 8, 8), ("h", "function", 12, 12)]


def test_scripts():
    text = "class A { private x = foo(3); async *gen<T>(a: T): AsyncIterator<T> { } #p() {} abstract m(): void; }\nconst f = async <T,>(x: T): Promise<T> => { return x }\nconst o = { run(x) { return x } }\n@Component({\n  a: 1\n})\nexport class C { @Input() name(x) { if (x) { y() } else if (z) { } } }\nlet h: (x: number) => void = (x) => { }\nexport const P = () => (\n  <p>Don't {x && <b>it's</b>} / </p>\n)\nfunction q(): { a: number } { return 1 }\n"
    assert found("a.tsx", text) == [("A", "class", 1, 1), ("A.gen", "method", 1, 1), ("A.#p", "method", 1, 1), ("f", "function", 2, 2), ("run", "function", 3, 3), ("C", "class", 4, 7), ("C.name", "method", 7, 7), ("h", "function", 8, 8), ("P", "function", 9, 11), ("q", "function", 12, 12)]


@pytest.mark.parametrize("language", ["javascript", "go", "java", "kotlin", "csharp", "rust", "php", "ruby"])
def test_torn_sources_end(language):
    pieces = ["'", '"', "`", "${", "}", "{", "(", ")", "/*", "//", "<<A", "#{", "%w[", "\\", "\n", "class A", "fn", "r#\"", '"""', "é", "$\"", "@\"", "<?php", "/", "def x", "end", "\x00", "<"]
    for i in range(len(pieces)):
        for j in range(len(pieces)):
            text = f"{pieces[i]}a {pieces[j]} {pieces[(i * j) % len(pieces)]}\n" * 2
            made = tokens_of(text, language)
            assert all(t.start < t.end and text[t.start : t.end] == t.text for t in made) and all(a.end <= b.start for a, b in zip(made, made[1:]))
            assert len(blanked(text, language)) == len(text) and blanked(text, language).count("\n") == text.count("\n")
            Code(text, language)


def test_deep_nesting_takes_time_in_proportion():
    import time

    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        code = Code("{(" * n + "`${" * 50 + "x" + "}`" * 50 + ")}" * n, "javascript")
        assert code.match[0] == len(code.tokens) - 1
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def facts(spark, made):
    return registry.discover(tree(spark, made)).filter("adapter = 'script'").collect()


def test_routes_requests_and_handlers(spark):
    rows = facts(spark, {
        "server.js": "const express = require(\"express\")\nconst app = express()\napp.get(\"/healthcheck\", (req, res) => res.send(\"ok\"))\napp.get([\"/logout\", \"/account/logout\"], logout)\napp.post(ROUTES.pay, payments)\n",
        "auth.jsx": "import ex, { Router as R } from \"express\"\nconst router = R()\nrouter.post(\"/create_token\", createToken)\nmap.get(\"thing\")\n",
        "passed.js": "export function addMiddlewares(app) {\n  app.use(cookieParser())\n  app.get(\"/login\", redirectLogin)\n}\n",
        "typed.ts": "import type { Express, Router } from \"express\"\nexport default (app: Express, admin: Router) => {\n  app.post(\"/orders\", create)\n  admin.delete(\"/orders/:id\", remove)\n}\n",
        "client.js": "const api = axios.create({ baseURL: \"/api\" })\nexport const load = (id) => api.get(\"/orders\", { params: { id } })\nexport const lookup = (key) => store.get(\"/cache/\" + key, onHit)\nconst b = await fetch(`http://order-service/orders/${id({ a: `}` })}`)\n",
    })
    assert {(r.file, r.line, r.method, r.path, r.name) for r in rows if r.fact == "route"} == {
        ("server.js", 3, "GET", "/healthcheck", None), ("server.js", 4, "GET", "/logout", "logout"), ("server.js", 4, "GET", "/account/logout", "logout"), ("auth.jsx", 3, "POST", "/create_token", "createToken"),
        ("passed.js", 3, "GET", "/login", "redirectLogin"), ("typed.ts", 3, "POST", "/orders", "create"), ("typed.ts", 4, "DELETE", "/orders/:id", "remove")}
    assert {(r.file, r.line, r.reason, r.name) for r in rows if r.fact == "skipped" and r.file != "client.js"} == {("server.js", 5, "non-literal-path", "ROUTES.pay")}
    assert {(r.method, r.path, r.host) for r in rows if r.fact == "outbound"} == {("GET", "/orders", None), ("GET", "/orders/{}", "order-service")}


def test_an_application_needs_express_in_its_repository(spark):
    assert [r for r in facts(spark, {"a.js": "export function f(store) { store.use(x); store.get('/cache', y) }\n"}) if r.fact == "route"] == []
