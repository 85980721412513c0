"""Extraction rules on small samples of each language."""

import pytest
from pyspark.sql import functions as F

from loomgraph.extract import imports as KI
from loomgraph.extract import structure as KS
from loomgraph.extract import web as KW
from loomgraph.projection import Graph
from loomgraph.sources import scan as S

PY = '''import os
import sys, json
from a import b, c
from ..p import C
from x import *

class Animal(Base, Mixin):
    def speak(self):
        return 1

    def walk(self):

        return 2

class Dog(Animal):
    pass

def top():
    x = 1
    return x
'''
FLASK = '''from flask import Flask
@app.route('/users')
def users():
    pass
@app.route('/users/<int:i>', methods=['GET'])
def user(i):
    pass
@blueprint.route("/add", methods=['POST', "PUT"])
@login
def add():
    pass
'''
FASTAPI = '''from fastapi import FastAPI
@app.get("/items/{i}")
@cached
async def item(i):
    pass
@app.post('/items')
def create():
    pass
'''
MODELS = '''class User(Base):
    __tablename__ = 'users'
    id = Column(Integer, primary_key=True)
    name = Column(String(50), unique=True, nullable=False)
    team_id = Column(Integer, ForeignKey('teams.id'))
    posts = relationship("Post", back_populates="author")

class Plain:
    pass

@dataclass
class Point:
    x: int
    y: float = 1.0
    z: str = None
class Req(BaseModel):
    q: str
'''
GO = '''package main
import (
    "fmt"
    log "github.com/sirupsen/logrus"
)
import "github.com/gin-gonic/gin"

type User struct {
    Name string `json:"name"`
    Age int
}
type Shape interface {
    Area() float64
}
func (u *User) Hello(x string) string {
    if x == "}" {
        return "{"
    }
    return x
}
func main() {
    r.GET("/ping", pong)
    router.POST("/users", add)
}
'''
JS = '''import React from 'react';
import { a, b as c } from "./lib";
import * as ns from 'ns';
import './style.css';
const fs = require('fs');
require("dotenv/config");
import express from 'express';
function top(x) {
  app.get('/users/:id', handler);
  if (x) { return 1; }
}
class View extends Base {
  render() {
    return 1;
  }
}
const arrow = (a) => {
  router.post("/p", arrow);
};
'''
TS = '''export interface User {
  name: string;
  age?: number;
}
type Id = string;
'''
JAVA = '''package com.shop;
import java.util.List;
import com.shop.*;
import static org.x.Y.*;

@RestController
@RequestMapping("/api")
public class UserController extends Base implements A, B {
    @GetMapping("/users")
    public List<User> all() {
        return null;
    }

    @PostMapping("add")
    public User add(User u) {
        return u;
    }
    private int helper() {
        return 1;
    }
}

class UserDTO {
    private String name;
}
'''
CS = '''using System;
using static System.Math;
using Proj = Company.Product.Module;

[ApiController]
[Route("api/users")]
public class UsersController : ControllerBase
{
    [HttpGet("{id}")]
    public User Get(int id)
    {
        return null;
    }
    [HttpPost]
    public User Add(User u)
    {
        return u;
    }
}

public class Address
{
    public string Street { get; set; }
    public string City { get; set; }
    public string Text()
    {
        return "";
    }
}
'''
PROTO = '''syntax = "proto3";
import "google/protobuf/empty.proto";
import "shop/money.proto";
message Cart {
  string user_id = 1;
  repeated Item items = 2;
  message Item {
    int32 n = 1;
  }
}
service CartService {
  rpc Add(AddRequest) returns (Empty) {}
  rpc Get (GetRequest) returns (Cart) {}
}
'''
MD = "intro\n# Top\ntext\n\n## Sub Part\nmore\n### Deep\n"
JSON = '{\n  "a": {"b": 1},\n  "b": [\n    {"c" : "a"}\n  ]\n}\n'


@pytest.fixture(scope="module")
def files(spark):
    rows = [("m.py", "python", PY), ("flask.py", "python", FLASK), ("fast.py", "python", FASTAPI), ("models.py", "python", MODELS),
            ("m.go", "go", GO), ("m.js", "javascript", JS), ("m.ts", "typescript", TS), ("M.java", "java", JAVA),
            ("M.cs", "csharp", CS), ("c.proto", "protobuf", PROTO), ("d.md", "markdown", MD), ("j.json", "json", JSON),
            ("src/pages/api/users/[id].js", "javascript", "export default function handler(req, res) {\n}\n")]
    return spark.createDataFrame([("r", p, lang, c) for p, lang, c in rows], "repo_url string, path string, language string, content string").cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_python_imports(files):
    got = rows(KI.python_imports(files.filter("path = 'm.py'")), "line", "name", "target", "alias")
    assert got == [(1, "os", "os", None), (2, "json", "json", None), (2, "sys", "sys", None), (3, "b", "a", "a.b"),
                   (3, "c", "a", "a.c"), (4, "C", "..p", "..p.C"), (5, "x.*", "x", None)]


def test_go_imports(files):
    assert rows(KI.go_imports(files), "line", "kind", "name", "target", "alias") == [
        (3, "block", "fmt", "fmt", None), (4, "block", "log", "github.com/sirupsen/logrus", "log"),
        (6, "single", "gin", "github.com/gin-gonic/gin", None)]


def test_js_imports(files):
    assert rows(KI.js_imports(files.filter("path = 'm.js'")), "line", "kind", "name", "target") == [
        (1, "default", "React", "react"), (2, "named", "a", "./lib"), (2, "named", "c", "./lib"), (3, "namespace", "ns", "ns"),
        (4, "side_effect", "style.css", "./style.css"), (5, "require", "fs", "fs"), (6, "bare_require", "config", "dotenv/config"),
        (7, "default", "express", "express")]


def test_java_and_csharp_imports(files):
    assert rows(KI.java_imports(files), "name", "target", "kind") == [
        ("List", "java.util.List", "class"), ("com.shop.*", "com.shop", "wildcard"), ("org.x.Y.*", "org.x.Y", "wildcard")]
    assert rows(KI.csharp_usings(files), "name", "target", "kind") == [
        ("Math", "System.Math", "namespace"), ("Proj", "Company.Product.Module", "alias"), ("System", "System", "namespace")]


def spans(files, path):
    return rows(KS.symbols(files.filter(f"path = '{path}'")), "start_line", "end_line", "kind", "name")


def test_symbols(files):
    assert spans(files, "m.py") == [(7, 13, "class", "Animal"), (8, 9, "function", "speak"), (11, 13, "function", "walk"),
                                    (15, 16, "class", "Dog"), (18, 20, "function", "top")]
    assert spans(files, "m.go") == [(8, 11, "struct", "User"), (12, 14, "interface", "Shape"), (15, 20, "function", "Hello"),
                                    (21, 24, "function", "main")]
    assert spans(files, "m.js") == [(8, 11, "function", "top"), (12, 16, "class", "View"), (13, 15, "function", "render"),
                                    (17, 19, "function", "arrow")]
    assert spans(files, "M.java") == [(8, 21, "class", "UserController"), (10, 12, "function", "all"), (15, 17, "function", "add"),
                                      (18, 20, "function", "helper"), (23, 25, "class", "UserDTO")]
    assert [(s, e, n) for s, e, k, n in spans(files, "M.cs")] == [
        (7, 19, "UsersController"), (10, 13, "Get"), (15, 18, "Add"), (21, 29, "Address"), (25, 28, "Text")]


def test_inheritance(files):
    got = {r["name"]: (r.superclasses, r.interfaces) for r in KW.inheritance(files.filter("path IN ('m.py', 'M.java')")).collect()}
    assert got["Animal"] == (["Base", "Mixin"], []) and got["Dog"] == (["Animal"], [])
    assert got["UserController"] == (["Base"], ["A", "B"])


def test_flask_and_fastapi(files):
    assert rows(KW.flask_routes(files), "route", "method", "name") == [
        ("/add", "POST", "add"), ("/add", "PUT", "add"), ("/users", "GET", "users"), ("/users/<int:i>", "GET", "user")]
    assert rows(KW.python_endpoints(files.filter("path = 'fast.py'")), "route", "method", "name", "framework") == [
        ("/items", "POST", "create", "FastAPI"), ("/items/{i}", "GET", "item", "FastAPI")]
    assert rows(KW.python_endpoints(files.filter("path = 'flask.py'")), "route", "method", "name") == [
        ("/users", "GET", "users"), ("/users/<int:i>", "GET", "user")]


def test_models(files):
    symbols = KS.symbols(files)
    user, = KW.sqlalchemy_models(symbols.filter("file_path = 'models.py'")).collect()
    assert len(KW.sqlalchemy_models(symbols).collect()) == 2  # a base named Base is enough
    assert (user["name"], user.table_name) == ("User", "users")
    assert [(f["name"], f["type"], f["constraints"]) for f in user.fields] == [
        ("id", "Integer", ["PRIMARY KEY"]), ("name", "String", ["UNIQUE", "NOT NULL"]),
        ("team_id", "Integer", ["FOREIGN KEY (teams.id)"]), ("posts", "Relationship<Post>", [])]
    got = {r["name"]: r for r in KW.python_models(symbols).collect()}
    assert got["Point"]["type"] == "Dataclass" and got["Req"]["type"] == "Pydantic"
    assert [(f["name"], f["type"], f["required"]) for f in got["Point"].fields] == [
        ("x", "int", True), ("y", "float", True), ("z", "str", False)]
    ts = {r["name"]: r for r in KW.ts_models(files).collect()}
    assert [(f["name"], f["type"], f["required"]) for f in ts["User"].fields] == [("name", "string", True), ("age", "number", False)]
    assert ts["Id"]["type"] == "Type"
    assert rows(KW.java_models(files), "name") == [("UserDTO",)]
    go, = KW.go_models(files).collect()
    assert [(f["name"], f["type"], f["tags"]) for f in go.fields] == [("Name", "string", '`json:"name"`'), ("Age", "int", None)] or \
        [(f["name"], f["type"], f["tags"]) for f in go.fields] == [("Name", "string", '`json:"name"`'), ("Age", "int", "")]
    assert rows(KW.csharp_models(files), "name") == [("Address",)]


def test_endpoints(files):
    got = rows(KW.all_endpoints(files, KI.go_imports(files)), "framework", "method", "route", "name")
    assert got == sorted([
        ("FastAPI", "GET", "/items/{i}", "item"), ("FastAPI", "POST", "/items", "create"), ("Flask", "GET", "/users", "users"),
        ("Flask", "GET", "/users/<int:i>", "user"), ("Express", "GET", "/users/:id", "GET__users_:id"),
        ("Express", "POST", "/p", "POST__p"), ("Next.js", "ANY", "/api/users/[id]", "handler"), ("Spring", "GET", "/api/users", "all"),
        ("Spring", "POST", "/api/add", "add"), ("Gin", "GET", "/ping", "GET__ping"), ("Gin", "POST", "/users", "POST__users"),
        ("ASP.NET Core", "GET", "api/users/{id}", "Get"), ("ASP.NET Core", "POST", "api/users", "Add")])


def test_proto(files):
    messages, services = KS.proto_messages(files), KS.proto_services(files)
    assert rows(messages, "name", "start_line", "end_line") == [("Cart", 4, 9)]
    assert rows(KS.proto_fields(messages), "name", "type", "modifier", "number") == [
        ("items", "Item", "repeated", "2"), ("n", "int32", "optional", "1"), ("user_id", "string", "optional", "1")]
    assert rows(services, "name", "start_line") == [("CartService", 11)]
    assert rows(KS.proto_methods(services), "name", "request_type", "response_type") == [
        ("Add", "AddRequest", "Empty"), ("Get", "GetRequest", "Cart")]
    assert rows(KS.proto_imports(files), "name", "is_system") == [("empty.proto", True), ("money.proto", False)]


def test_markdown_and_json(files):
    assert rows(KS.markdown_sections(files), "start_line", "end_line", "level", "title", "unique_id", "content") == [
        (2, 4, 1, "Top", "section_top_chunk_0", "text\n"), (5, 6, 2, "Sub Part", "section_sub_part_chunk_1", "more"),
        (7, 8, 3, "Deep", "section_deep_chunk_2", "")]
    assert rows(KS.json_keys(files), "n", "name", "start_line", "end_line") == [(0, "a", 2, 3), (1, "b", 2, 3), (2, "b", 2, 3), (3, "c", 4, 5)]


def test_manifests(spark):
    k8s = ("apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  labels:\n    app: cart\n  name: cart\nspec:\n  template:\n    spec:\n"
           "      containers:\n      - name: server\n        image: x\n---\nkind: Service\nmetadata:\n  name: other\n")
    compose = "version: 3\nservices:\n  web:\n    image: w\n  db:\n    image: d\nvolumes:\n  data:\n    x: 1\n"
    df = spark.createDataFrame([("a", "kubernetes-manifests/cart.yaml", k8s), ("a", "docker-compose.yaml", compose),
                                ("b", "docker-compose.yaml", compose)], "repo_url string, path string, content string")
    got = rows(S.scan_service_manifests(df), "repo_url", "service_name", "origin", "labels")
    assert got == [("a", "cart", "kubernetes", "app: cart\n"), ("b", "db", "compose", ""), ("b", "web", "compose", "")] or \
        [(r, s, o) for r, s, o, _ in got] == [("a", "cart", "kubernetes"), ("b", "db", "compose"), ("b", "web", "compose")]


SPANS = {
    "python": ("def f(\n    a,\n    b,\n):\n    x = \"\"\"\nclass no:\n\"\"\"\n    # }\n    return g(\n1,\n)\n\n# end\ndef h(): pass\n", {("f", 1, 11), ("h", 14, 14)}),
    "java": ("class A {\n  void f(\n    int a,\n    int b,\n    int c)\n    throws X\n  {\n    /* } */\n    String s = \"}\";\n    char c = '}';\n  }\n}\n", {("A", 1, 12), ("f", 2, 11)}),
    "javascript": ("function f(a) {\n  const t = `}\n}`;\n  // }\n  return t;\n}\nconst g = (x) => x + 1\nconst h = (x) => {\n  return x\n}\nfunction k() {}\n", {("f", 1, 6), ("g", 7, 7), ("h", 8, 10), ("k", 11, 11)}),
    "go": ("type A struct {\n\tB struct {\n\t\tC int\n\t}\n}\nfunc f(a int,\n\tb int) error {\n\ts := `{`\n\treturn nil\n}\n", {("A", 1, 5), ("f", 6, 10)}),
    "csharp": ("public class A\n{\n  public int F(int a)\n  {\n    return a;\n  }\n}\n", {("A", 1, 7), ("F", 3, 6)}),
}


@pytest.mark.parametrize("language", list(SPANS))
def test_spans_end_where_the_block_does(spark, language):
    text, wanted = SPANS[language]
    files = spark.createDataFrame([("r", "f", language, text)], "repo_url string, path string, language string, content string")
    got = {(r["name"], r.start_line, r.end_line) for r in KS.symbols(files).collect()}
    assert {g for g in got if g[0] in {n for n, _, _ in wanted}} == wanted


def test_nested_types(spark):
    schema = "repo_url string, path string, language string, content string"
    ts = spark.createDataFrame([("r", "a.ts", "typescript", "interface A { a; b?: {c: number; d: {e: string}}; f: string }\ninterface B {\n  x: {\n    y: number;\n  };\n  z?: Map<string, A>;\n}\n")], schema)
    got = {r["name"]: [(f["name"], f["required"]) for f in r["fields"]] for r in KW.ts_models(ts).collect()}
    assert got == {"A": [("a", True), ("b", False), ("f", True)], "B": [("x", True), ("z", False)]}
    go = spark.createDataFrame([("r", "a.go", "go", "type A struct {\n\tB struct {\n\t\tC int\n\t} `json:\"b\"`\n\tD string\n}\n")], schema)
    row, = KW.go_models(go).collect()
    assert [(f["name"], f["tags"]) for f in row["fields"]] == [("B", '`json:"b"`'), ("D", "")]


SCHEMA = "repo_url string, path string, language string, content string"


def test_interface_members_at_any_depth(spark):
    text = '''interface A { a: {b:{c:{d:{e:{f:number}}}}}; z: string }
interface B<T extends {x: number; y: string}> extends C<{k: number}> {
  f(x: number, y: {z: string}): void; // not; a: member
  "q-r"?: string; list: Array<string, number>;
  g?: (a: number) => Map<string, Array<number>>
  h: | "one;"
    | "two,"
  [key: string]: any
  (call: number): string
  readonly r: number, /* s: string; */ t
}
if (a < b) { x = "interface No {" }
interface Never
;{ a: string }
interface Open { a: string;
'''
    ts = spark.createDataFrame([("r", "a.ts", "typescript", text), ("r", "n.ts", "typescript", None), ("r", "e.ts", "typescript", "")], SCHEMA)
    got = {r["name"]: [tuple(f) for f in r["fields"]] for r in KW.ts_models(ts).collect()}
    assert got == {
        "A": [("a", "{b:{c:{d:{e:{f:number}}}}}", True), ("z", "string", True)],
        "B": [("f", "(x: number, y: {z: string}): void", True), ("q-r", "string", False), ("list", "Array<string, number>", True),
              ("g", "(a: number) => Map<string, Array<number>>", False), ("h", '| "one;" | "two,"', True), ("[key: string]", "any", True),
              ("r", "number", True), ("t", "", True)]}


def test_python_fields_are_those_of_the_class_body(spark):
    text = '''
@dataclass
# between
@register(
    "x")

class P:
    """Doc: string = no"""
    a: int = 3
    b: Dict[str, int] = field(
        default_factory=lambda: {"k": 1})
    c: "Optional[int]" = None  # d: int

    def m(self):
        local: int = 3
        id = Column(Integer)

    class Inner:
        e: int

class T(Base):
    __tablename__ = "t"
    id = Column(Integer, default=func.now(f(g(1))), primary_key=True)
    name: Mapped[str] = db.Column(String(50), unique=True,
                                  nullable=False)
    kids = relationship("Kid", lazy=f(")"))
    def m(self):
        x = Column(Float)
'''
    symbols = KS.symbols(spark.createDataFrame([("r", "m.py", "python", text)], SCHEMA))
    got = {r["name"]: [tuple(f) for f in r["fields"]] for r in KW.python_models(symbols).collect()}
    assert set(got) == {"P"}
    assert [f[:2] for f in got["P"]] == [("a", "int"), ("b", "Dict[str, int]"), ("c", '"Optional[int]"')]
    assert [f[3] for f in got["P"]] == [True, True, False] and got["P"][2][2] == "None"
    table, = KW.sqlalchemy_models(symbols.filter("name = 'T'")).collect()
    assert [(f["name"], f["type"], f["constraints"]) for f in table.fields] == [
        ("id", "Integer", ["PRIMARY KEY"]), ("name", "String", ["UNIQUE", "NOT NULL"]), ("kids", "Relationship<Kid>", [])]


def test_struct_fields_at_any_depth(spark):
    text = ("type A[T any] struct {\n\tX, Y map[string]struct{ V int }\n\tB struct {\n\t\tC struct { D struct { E struct { F int } } }\n"
            "\t} `json:\"b\"` // note\n\tBase\n\tG func(a int, b string) (<-chan int, error)\n}\n")
    row, = KW.go_models(spark.createDataFrame([("r", "a.go", "go", text)], SCHEMA)).filter("name = 'A'").collect()
    assert [(f["name"], f["tags"]) for f in row["fields"]] == [("X", ""), ("Y", ""), ("B", '`json:"b"`'), ("G", "")]
    assert row["fields"][3]["type"] == "func(a int, b string) (<-chan int, error)"


def test_members_take_linear_time():
    import re
    import time

    from loomgraph.extract.members import block_members, class_statements
    head, t = re.compile(r"\binterface\s+(\w+)"), time.time()
    assert len(block_members("interface A { a: {b: number}; c: string }\n" * 20000, head, ";,\n", True)) == 20000
    assert block_members("interface A {\n" * 20000, head, ";,\n", True) == []
    assert block_members("interface A " * 20000 + ";", head, ";,\n", True) == []
    assert len(class_statements("class A:\n" + "    a: int = f(1)\n" * 20000)) == 20000
    assert time.time() - t < 20


def test_rendered_source_holds_whole_texts(spark):
    g = Graph(spark, "/root/testdata/sf0.001")
    rows = g.files.select("path", F.col("content").alias("prose")).join(g.code_files.select("path", "content"), "path").collect()
    assert len(rows) == 200
    for r in rows:
        prose, code = r.prose.split("\n"), r.content.split("\n")
        assert len(prose) == len(code) and all(p in c for p, c in zip(prose, code))


def test_trailing_comments(spark):
    text = {
        "go": "import ( // (why; \"x\"\n\ta \"b/c\" // \"d\"\n) // end\n\"no/import\"",
        "java": "import a.B; // c; d\nclass X { // {\n  public int f(int a) { // g(); h\n  }\n}",
        "csharp": "using A.B; // c; d",
    }
    files = spark.createDataFrame([("r", f"f.{k}", k, v) for k, v in text.items()], "repo_url string, path string, language string, content string")
    assert [(r.line, r.target) for r in KI.go_imports(files).collect()] == [(2, "b/c")]
    assert [r.target for r in KI.java_imports(files).collect()] == ["a.B"]
    assert [r.target for r in KI.csharp_usings(files).collect()] == ["A.B"]
    assert {(r.name, r.start_line, r.end_line) for r in KS.symbols(files).collect()} == {("X", 2, 5), ("f", 3, 4)}
