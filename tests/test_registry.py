from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import deps, guidance, manifest, python_code, registry, script_code, symbol_code


def tree(spark, made: dict, repo="svc"):
    return spark.createDataFrame([(repo, p, t.encode()) for p, t in made.items()], "repo string, path string, content binary")


FAST = "from fastapi import APIRouter, FastAPI\n"
CASES = {
    "routers of one name in two modules": ({
        "api/orders.py": FAST + "router = APIRouter()\n@router.get('/orders/{id}')\ndef a(id): ...\n",
        "api/users.py": FAST + "router = APIRouter(prefix='/users')\n@router.get('/{id}/x')\ndef b(id): ...\n",
        "api/main.py": FAST + "from . import orders, users\napp = FastAPI()\napp.include_router(orders.router, prefix='/v1')\napp.include_router(users.router, prefix='/v2')\n",
    }, {"GET /v1/orders/{id}", "GET /v2/users/{id}/x"}),
    "groups through packages": ({
        "app/m/v1/find.py": "from sanic import Blueprint\nfind = Blueprint('f')\n@find.route('/now', methods=['POST'])\nasync def now(request): ...\n",
        "app/m/v1/__init__.py": "from sanic import Blueprint\nfrom .find import find\nfirst = Blueprint.group(find, url_prefix='/find')\n",
        "app/m/__init__.py": "from sanic import Blueprint\nfrom .v1 import first\nsecond = Blueprint.group(first, url_prefix='/v1')\n",
        "app/__init__.py": "from sanic import Blueprint\nfrom .m import second\nthird = Blueprint.group([second], url_prefix='/m')\n",
    }, {"POST /m/v1/find/now"}),
    "one router by two names": ({
        "r/a.py": FAST + "things = APIRouter(prefix='/things')\n@things.get('/{id}')\ndef one(id): ...\n",
        "r/__init__.py": "from .a import things as exported\n",
        "main.py": FAST + "from r import exported\nfrom r.a import things\napp = FastAPI()\napp.include_router(exported, prefix='/public')\ndef late():\n    app.include_router(things, prefix='/internal')\n",
    }, {"GET /public/things/{id}", "GET /internal/things/{id}"}),
    "flask replaces": ({
        "shop/views.py": "from flask import Blueprint\nbp = Blueprint('s', __name__, url_prefix='/old')\n@bp.route('/items')\ndef items(): ...\n",
        "shop/app.py": "from flask import Flask\nfrom .views import bp\napp = Flask(__name__)\napp.register_blueprint(bp, url_prefix='/shop')\n",
    }, {"GET /shop/items"}),
    "flask keeps its own without another": ({
        "shop/views.py": "from flask import Blueprint\nbp = Blueprint('s', __name__, url_prefix='/old')\n@bp.route('/items')\ndef items(): ...\n",
        "shop/app.py": "from flask import Flask\nfrom .views import bp\napp = Flask(__name__)\napp.register_blueprint(bp)\n",
    }, {"GET /old/items"}),
    "sources below a folder": ({
        "src/api/a.py": FAST + "router = APIRouter(prefix='/a')\n@router.get('/x')\ndef x(): ...\n",
        "src/api/main.py": FAST + "from api.a import router\napp = FastAPI()\napp.include_router(router, prefix='/v3')\n",
    }, {"GET /v3/a/x"}),
    "mounted nowhere": ({"svc/r.py": FAST + "router = APIRouter(prefix='/v1')\n@router.get('/ping')\nasync def ping(): ...\n"}, {"GET /v1/ping"}),
    "mounted in an application that is passed in": ({
        "svc/r.py": FAST + "router = APIRouter()\n@router.get('/ping')\nasync def ping(): ...\ndef setup(app):\n    app.include_router(router, prefix='/p')\n"}, {"GET /p/ping"}),
    "a group of a match is no mount": ({
        "svc/r.py": "import re\nfrom sanic import Blueprint\nbp = Blueprint('s', url_prefix='/v1')\nm = re.match('(x)', 'x')\nvalue = m.group(1)\n@bp.route('/ping')\nasync def ping(request): ...\n"}, {"GET /v1/ping"}),
    "a local name does not hide a router": ({
        "svc/r.py": FAST + "eta = APIRouter(prefix='/eta')\n@eta.get('/x')\ndef x():\n    eta = dict(a=1)\n    return eta\n"}, {"GET /eta/x"}),
    "a version of its own": ({
        "svc/r.py": "from sanic import Blueprint\nbp = Blueprint('s', url_prefix='/things', version=2)\n@bp.route('/x')\nasync def x(r): ...\n"}, {"GET /v2/things/x"}),
}


CIRCLE = {
    "svc/a.py": "from sanic import Blueprint\nfrom .b import b\na = Blueprint.group(b, url_prefix='/a')\n",
    "svc/b.py": "from sanic import Blueprint\nfrom .a import a\nb = Blueprint.group(a, url_prefix='/b')\n@b.route('/ping')\nasync def ping(request): ...\n",
}


@pytest.fixture(scope="module")
def mounted(spark):
    """Routes of all cases, each a repository of its own."""
    every = {**{name: made for name, (made, _) in CASES.items()}, "circle": CIRCLE}
    files = spark.createDataFrame([(name, p, t.encode()) for name, made in every.items() for p, t in made.items()], "repo string, path string, content binary")
    out = {name: set() for name in every}
    for r in registry.interfaces(registry.discover(files)).filter("type = 'rest'").collect():
        out[r.slug].add(f"{r.method} {r.path}")
    return out


@pytest.mark.parametrize("name", CASES)
def test_mounts(mounted, name):
    assert mounted[name] == CASES[name][1]


def test_a_circle_of_mounts_ends(mounted):
    assert mounted["circle"] and all(f.endswith("/ping") for f in mounted["circle"])


def test_languages_meet_in_one_registry(spark):
    made = {
        "app.py": FAST + "app = FastAPI()\n@app.get('/a')\ndef a(): ...\n@app.get('/a')\ndef again(): ...\n",
        "web.ts": "import express from 'express'\nconst app = express()\napp.get('/a', h)\napp.post('/b', h)\nhttpClient.post('/remote', {})\n",
        "config/routes.rb": "resources :orders, :bills, only: %i[show]\nget '/c', to: 'plain#c'\n",
        "app/controllers/api/orders_controller.rb": "class X\n  def show\n  end\nend\n",
        "config.json": '{"publish": {"TOPIC": "made"}}', "package.json": '{"dependencies": {"kafkajs": "1"}}',
    }
    files = tree(spark, made)
    facts = registry.with_channels(registry.discover(files), files)
    found = {(r.method, r.path): r for r in registry.interfaces(facts).collect()}
    assert set(found) == {("GET", "/a"), ("POST", "/b"), ("GET", "/orders/:id"), ("GET", "/bills/:id"), ("GET", "/c"), ("PUBLISH", "made")}
    assert found["GET", "/a"].evidence == ["app.py:3", "app.py:5"] and found["GET", "/a"].framework == "fastapi"
    assert found["GET", "/orders/:id"].evidence == ["config/routes.rb:1", "app/controllers/api/orders_controller.rb:2"] and found["PUBLISH", "made"].framework == "config"
    dead = registry.duplicate_paths(facts).collect()
    assert [(r.file, r.line, r.method, r.expr, r.snippet) for r in dead] == [("app.py", 5, "GET", "/a", "also declared at app.py:3")]
    assert {(r.slug, r.verb, r.path) for r in python_code.outbound_calls(facts).collect()} == {("svc", "POST", "/remote")}
    assert len({r.id for r in found.values()}) == len(found)


def test_readers_can_be_added(spark):
    def read(files):
        return files.filter(F.col("path").endswith(".toy")).select("repo", F.col("path").alias("file"), F.lit("route").alias("fact"), F.lit(1).alias("line"), F.lit("GET").alias("method"), F.decode("content", "UTF-8").alias("path"))

    facts = registry.discover(tree(spark, {"x.toy": "/toy", "y.py": "x = 1"}), (*registry.ADAPTERS, registry.Adapter("toy", read)))
    assert [(r.method, r.path) for r in registry.interfaces(facts).collect()] == [("GET", "/toy")]
    assert registry.interfaces(registry.discover(tree(spark, {}))).count() == 0


def rails(text):
    return {(r["method"], r["path"]) for r in script_code.rails_routes(text) if r["fact"] == "route"}


def test_rails_blocks():
    assert rails("namespace :api do\n  if ENV['X']\n    get 'x'\n  end\n  get 'y' if Rails.env.test?\nend\nget 'z'\n") == {("GET", "/api/x"), ("GET", "/api/y"), ("GET", "/z")}
    assert rails("resources :users, only: [:index] do\n  member { get 'status' }\n  collection { post :bulk; get :all }\n  get :near, on: :member\n  resources :posts, only: :show\nend") == {
        ("GET", "/users"), ("GET", "/users/:id/status"), ("POST", "/users/bulk"), ("GET", "/users/all"), ("GET", "/users/:id/near"), ("GET", "/users/:user_id/posts/:id")}
    assert rails("scope '/v2', defaults: { format: 'json' } do\n  resource :profile, except: [:new, :edit, :destroy]\n  match 'both', to: 'a#b', via: [:get, :post]\nend\nscope module: 'x' do\n  get 'm' => 'c#d'\nend") == {
        ("GET", "/v2/profile"), ("POST", "/v2/profile"), ("PUT", "/v2/profile"), ("PATCH", "/v2/profile"), ("GET", "/v2/both"), ("POST", "/v2/both"), ("GET", "/m")}
    skipped = [r["reason"] for r in script_code.rails_routes("mount Engine => '/e'\nresources name\nget path_of(x)\n") if r["fact"] == "skipped"]
    assert skipped == ["mounted-engine", "non-literal-resource", "non-literal-path"]


def test_script_calls():
    found = list(script_code.script_facts("""
        import express from 'express'
        const app = express(); const c = axios.create(); // fetch('/no')
        app.get(`/a`, async (q, s) => {}); c.get('/x'); await api.get<User[]>(`http://pay/${id}/b`); cache.get(key);
        client.post(url, { a: 1 }); router.use(path, (req) => 1); emitter.get(name, function () {});
        sqs.sendMessage('orders'); consumer.subscribe({ topic: 't' }); bus.emit('no')
    """))
    got = {(f["fact"], f.get("method"), f.get("path")) for f in found}
    assert got == {("route", "GET", "/a"), ("outbound", "GET", "/x"), ("outbound", "GET", "/{}/b"), ("skipped", "POST", None), ("event", "PUBLISH", "orders"), ("skipped", "CONSUME", None)}
    assert {f["line"] for f in found if f["fact"] == "route"} == {4}


def test_ruby_calls():
    text = "RestClient::Request.execute(method: :put, url: 'http://a/p')\nconn.get '/q'\nparams.get('/no')\nFaraday.new(url: 'http://b')\nclient.post(path, body)\n# conn.get '/c'\nNet::HTTP.get('http://n/' + x)\n"
    got = {(f["fact"], f["method"], f.get("path"), f.get("host")) for f in script_code.ruby_calls(text)}
    assert got == {("outbound", "PUT", "/p", "a"), ("outbound", "GET", "/q", None), ("outbound", "GET", "/", "b"), ("skipped", "POST", None, None), ("skipped", "GET", None, None)}


def facts_of(source):
    made = python_code.parse(source)
    return [r for r in python_code.Reader("r", "a.py", source, made).read() if r["fact"] in ("outbound", "skipped", "event", "route")]


def test_python_heuristics():
    say = lambda line: [(r["fact"], r.get("reason")) for r in facts_of(f"import boto3\nasync def f(request):\n    {line}\n")]
    assert say("request.args.get(key)") == [] and say("await redis_client_cache.get(k)") == [("skipped", "non-literal-url")]
    assert say("await cache.get(k)") == [] and say("await Model.all().delete(k)") == [] and say("x.get(k, headers=h)") == [("skipped", "non-literal-url")]
    assert say("await CacheWarmingHttp.get(k)") == [("skipped", "non-literal-url")] and say("await thing.get(k)") == [("skipped", "non-literal-url")]
    assert say("sqs.get_queue_url(QueueName='q')") == [("skipped", "non-literal-channel")] and say("sqs.send_message(Body=1)") == [("skipped", "no-channel-argument")]
    assert say("thing.publish(topic='t')") == [] and say("thing.produce('t')") == [("event", None)] and say("producer.publish('t')") == [("event", None)]
    big = "from flask import Flask\napp = Flask(1)\n@app.route('/big')\ndef big(): ...\n" + "#" * 2_100_000
    assert [r["path"] for r in facts_of(big) if r["fact"] == "route"] == ["/big"]
    assert [r["path"] for r in facts_of("from flask import Flask\nreg.add('/odd/<x>', view)\n'a/b'.split('/x')\nrequests.hook('/no/x')\n") if r["fact"] == "skipped"] == ["/odd/<x>"]
    assert python_code.names_in(__import__("ast").parse("Model.uri(base, self.x) + base").body[0].value) == ["Model", "uri", "base", "self", "x"]


def test_manifests_by_their_own_grammar():
    read = lambda name, text: [n for n, _ in deps.packages(name, text)]
    assert read("Pipfile", '[[source]]\nurl = "u"\nverify_ssl = true\n[packages]\nflask = "*"\n[dev-packages]\nmypy = "*"\n[requires]\npython_version = "3"\n') == ["flask", "mypy"]
    pom = '<project xmlns="http://m"><artifactId>own</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>dep</artifactId></dependency></dependencies><build><plugins><plugin><artifactId>plug</artifactId></plugin></plugins></build></project>'
    assert read("pom.xml", pom) == ["dep"] and read("pom.xml", "<broken") == []
    assert read("go.mod", "module m\ngo 1.2\nrequire a/b v1 // x\nrequire (\n\tc/d v2 // indirect\n)\nreplace e/f => g/h v3\n") == ["a/b", "c/d"]
    assert read("Gemfile", "source 'x'\ngem 'rails', '~> 7'\n  gem(\"puma\")\n# gem 'no'\ngemspec\n") == ["rails", "puma"]
    assert read("requirements.txt", "-r other.txt\nFlask[async]>=2\n# no\nhttps://h/x.git@1&egg=eg\n") == ["Flask", "https://h/x.git@1&egg=eg"]
    assert read("package.json", "[1]") == [] and read("Cargo.toml", "[dependencies]\nserde = '1'\n[build-dependencies]\ncc = '1'\n") == ["serde", "cc"]


def test_frontmatter_grammar():
    read = guidance.frontmatter
    assert read("a: 1\nb:\n  c: [x, 'y z']\n  d: \"q\"\n\n# no\ne: f: g\n") == {"a": "1", "b": {"c": ["x", "y z"], "d": "q"}, "e": "f: g"}
    for wrong in ("  a: 1", "a: 1\n  b: 2", "a:\n     b: 2", "plain", ": x"):
        with pytest.raises(guidance.RuleError):
            read(wrong)


def test_what_a_repository_says_of_itself(spark):
    made = tree(spark, {
        "package.json": '{"description": " Takes   orders. "}', "README.md": "# Orders\nServes the shop.\n## Install\nno", "weftgraph.yaml": "guidance: [rules/, .]\n", "x.gemspec": "s.summary = 'gem'"})
    row = manifest.declared_purpose(made).first()
    assert row.lines[1:] == ["  Takes orders.", "  Serves the shop."] and "package.json, README.md" in row.lines[0] and row.hash_input == "Takes orders.\nServes the shop."
    assert {r.root for r in manifest.guidance_roots(made).collect()} == {"rules", ""}
    for name, text, want in (("setup.py", "setup(name='x', description='A')", "A"), ("setup.cfg", "[metadata]\ndescription = B\n", "B"), ("pom.xml", "<project><description> C\n d</description></project>", "C d"), ("x.gemspec", "s.summary = \"E\"", "E"), ("pyproject.toml", "[", "")):
        assert manifest.description_of(name, text) == want


SYMBOLS = {
    "a.ts": ("export class Shop<T> {\n  @log()\n  async buy(x: number): Promise<void> {\n    if (x) { call(x) }\n  }\n  static get size() { return 1 }\n}\nexport const add = (a, b) => {\n  return a + b\n}\nconst one = x => x + 1;\nfunction* gen() { }\ninterface P { a: string }\n// function no() {}\n",
             [("Shop", "class", 1, 7), ("Shop.buy", "method", 2, 5), ("Shop.size", "method", 6, 6), ("add", "function", 8, 10), ("one", "function", 11, 11), ("gen", "function", 12, 12), ("P", "interface", 13, 13)]),
    "b.go": ("package b\ntype Shop struct {\n\tname string\n}\nfunc (s *Shop) Buy(x int) error {\n\treturn nil\n}\nfunc main() {\n}\n", [("Shop", "struct", 2, 4), ("Shop.Buy", "method", 5, 7), ("main", "function", 8, 9)]),
    "C.java": ("public class C extends D {\n  private final int n;\n  public C(int n) { this.n = n; }\n  @Override\n  public List<String> all(int a) throws E {\n    for (int i = 0; i < a; i++) { use(i); }\n    return new Foo() { };\n  }\n}\n", [("C", "class", 1, 9), ("C.C", "method", 3, 3), ("C.all", "method", 4, 8)]),
    "d.rs": ("pub struct P { x: i32 }\nimpl Show for P {\n    pub fn show(&self) -> i32 {\n        self.x\n    }\n}\nfn free() {}\n", [("P", "struct", 1, 1), ("P.show", "method", 3, 5), ("free", "function", 7, 7)]),
    "e.php": ("<?php\nclass E {\n  public function go($x) {\n    return 1;\n  }\n}\nfunction f() { }\n", [("E", "class", 2, 6), ("E.go", "method", 3, 5), ("f", "function", 7, 7)]),
    "f.kt": ("data class F(val a: Int)\nclass G {\n  fun run(x: Int): Int {\n    return x\n  }\n}\nfun top() { }\n", [("F", "class", 1, 1), ("G", "class", 2, 6), ("G.run", "method", 3, 5), ("top", "function", 7, 7)]),
    "g.cs": ("namespace N {\n  public interface I { }\n  class G {\n    public async Task<int> RunAsync(string s) {\n      return 1;\n    }\n  }\n}\n", [("I", "interface", 2, 2), ("G", "class", 3, 7), ("G.RunAsync", "method", 4, 6)]),
    "h.rb": ("module M\n  class A < B\n    def go(x)\n      if x\n        y = 1 if z\n      end\n      list.each do |i|\n      end\n    end\n    def self.one; 1; end\n    def two = 2\n  end\nend\n",
             [("M", "module", 1, 13), ("M.A", "class", 2, 12), ("M.A.go", "method", 3, 9), ("M.A.one", "method", 10, 10), ("M.A.two", "method", 11, 11)]),
}


@pytest.mark.parametrize("path", SYMBOLS)
def test_symbols_of_other_languages(spark, path):
    text, want = SYMBOLS[path]
    facts = symbol_code.read_symbols(tree(spark, {path: text})).orderBy("line", F.desc("line_end")).collect()
    assert [(r.name, r.method, r.line, r.line_end) for r in facts] == want
    spans = python_code.symbol_spans(symbol_code.read_symbols(tree(spark, {path: text}))).collect()
    assert {r.id for r in spans} == {f"code_symbol:svc:{path}::{name}" for name, *_ in want}
