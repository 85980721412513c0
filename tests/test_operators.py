"""Operators against brute force on small fixtures, and invariants over the projected graph."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import audit, chats, chunking, containment, cross_service, embedding, imports, repair, search
from loomgraph.operators import edges as E
from loomgraph.projection import ACTIVE_REPO, Graph
from loomgraph.sources import scan, store
from loomgraph.streaming import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark, SF)


def as_set(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


def test_vector_topk_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    # A third of the rows are copies of one vector; some rows have no vector or another dimension.
    rows = [("r%d" % (i % 3), "p%d" % (i % 7), i, "c%03d" % i, [float(x) for x in (base[0] if i % 3 == 0 else base[i % 40])])
            for i in range(150)]
    rows += [("r0", "p", 1, "none", None), ("r0", "p", 1, "short", [1.0, 2.0])]
    cand = spark.createDataFrame(rows, "repo_url string, file_path string, start_line int, chunk_id string, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([("a", [float(x) for x in base[0]], 7), ("b", [float(x) for x in base[3]], 4)],
                               "query_id string, embedding array<float>, k int")

    def expected(q, k, repo=None):
        q = np.array(q, dtype=np.float32).astype(float)
        out = []
        for r, p, line, c, v in rows[:150]:
            v = np.array(v, dtype=np.float32).astype(float)
            s = round((1 + float(v @ q) / np.linalg.norm(v) / np.linalg.norm(q)) / 2, 6)
            if repo is None or r == repo:
                out.append((-s, p, line, r, c))
        return [x[4] for x in sorted(out)[:k]]

    got = search.vector_topk_many(cand, qs).orderBy("query_id", "rn").collect()
    assert [r.chunk_id for r in got if r.query_id == "a"] == expected(base[0], 7)
    assert [r.chunk_id for r in got if r.query_id == "b"] == expected(base[3], 4)
    per = search.vector_topk_many(cand, qs, per_repo=True).orderBy("query_id", "repo_url", "rn").collect()
    for repo in ("r0", "r1", "r2"):
        assert [r.chunk_id for r in per if r.query_id == "a" and r.repo_url == repo] == expected(base[0], 7, repo)


def test_question_batches(spark, monkeypatch, g):
    qs = g.table("embeddings").filter("vec_id < 7").select(F.col("vec_id").cast("string").alias("query_id"), "embedding", F.lit(3).alias("k"))
    whole = as_set(search.vector_topk_many(g.embedded_chunks, qs), "query_id", "chunk_id", "rn")
    monkeypatch.setattr(search, "QUESTION_BATCH", 3)
    assert as_set(search.vector_topk_many(g.embedded_chunks, qs), "query_id", "chunk_id", "rn") == whole
    assert search.vector_topk_many(g.embedded_chunks, qs.filter("false")).count() == 0


def test_secondary_repositories(spark):
    vec = lambda *x: [float(v) for v in x]
    chunks = spark.createDataFrame([
        ("act", "README.md", 1, "a0", "text a0", vec(1, 0)), ("act", "x.py", 1, "a1", "text a1", vec(0, 1)),
        ("con", "y.py", 1, "b0", "text b0", vec(1, 0.1)), ("oth", "z.py", 1, "z0", "text z0", vec(1, 0))],
        "repo_url string, file_path string, start_line int, chunk_id string, content string, embedding array<float>")
    files = spark.createDataFrame([("act", "README.md", True), ("act", "x.py", False), ("con", "y.py", False), ("oth", "z.py", False)],
                                  "repo_url string, path string, is_documentation boolean")
    questions = spark.createDataFrame([("q", "what is this", vec(1, 0)), ("s", "the services", vec(1, 0))],
                                      "query_id string, question string, embedding array<float>")
    topic = chunks.select("repo_url", "chunk_id", F.col("content").alias("text"), F.col("file_path").alias("path"), "start_line", F.lit(1.0).alias("priority"))
    run = lambda t: search.retrieve_context(questions, chunks, chunks, files, spark.createDataFrame([("con",)], "repo_url string"), "act", t)
    got = run(topic)
    rows = [(r.chunk_id, round(r.score, 3), r.secondary_repo) for r in got.filter("query_id = 'q'").orderBy("rn").collect()]
    assert rows == [("a0", 2.25, False), ("b0", 0.798, True), ("a1", 0.5, False)]
    assert as_set(got.filter("query_id = 's'"), "chunk_id", "score") == {(c, 1.0) for c in ("a0", "a1", "b0", "z0")}
    # With one topical row only, the shortcut is not taken.
    assert as_set(run(topic.limit(1)).filter("query_id = 's'"), "chunk_id") == {("a0",), ("a1",), ("b0",)}


def test_text_mentions_match_brute_force(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 14))) for _ in range(120)]
    texts = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(words) for _ in range(6))) for i in range(80)]
    needles = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 10))) for _ in range(60)} | set(words[:20])
                     | {f"{rnd.choice(words)} {rnd.choice(words)[:2]}" for _ in range(40)} | {"c", "a\nb", "a  b"})
    got = cross_service.text_mentions(spark.createDataFrame(texts, "id int, text string"),
                                      spark.createDataFrame([(n,) for n in [*needles, "", " "]], "needle string"), ["id"])
    assert as_set(got, "id", "needle") == {(i, n) for i, t in texts for n in needles if n in t}


def test_calls_are_counted_once_per_endpoint(spark):
    endpoints = spark.createDataFrame(
        [(1, "ru", "users", "getUser", "/pay"), (2, "ru", "users", "get_all", "/all"), (3, "ru", "users", "getUser", "/x"), (4, "ro", "orders", "getUser", "/pay")],
        "endpoint_id long, repo_url string, service_name string, name string, path string")
    texts = [("f1", "http getUser /pay"), ("f2", "fetch get-all"), ("f3", "http of users with /pay"), ("f4", "getUser without client"), ("f5", "http getUser")]
    functions = spark.createDataFrame([("rw", "web", u, t) for u, t in texts] + [("ro", "orders", "o1", "http getUser")],
                                      "repo_url string, service_name string, unique_id string, text string")
    calls = cross_service.may_call(functions, endpoints)
    assert as_set(calls, "unique_id", "rule", "key", "n_endpoints") == {
        ("f1", "name", "getUser", 3), ("f1", "path", "/pay", 2), ("f2", "name", "get_all", 1), ("f3", "service", "users", 3), ("f3", "path", "/pay", 2),
        ("f5", "name", "getUser", 3), ("o1", "name", "getUser", 2)}
    # web -> users: f1 sees 1 and 3, f2 sees 2, f3 sees all three, f5 sees 1 and 3.
    assert as_set(cross_service.calls_service(calls, endpoints), "src", "dst", "n") == {("web", "users", 8), ("web", "orders", 3), ("orders", "users", 2)}


def test_dependencies_are_chunk_pairs(spark):
    files = spark.createDataFrame([(r, p) for r in ("r", "q") for p in ("main.py", "src/a.py", "b.py")], "repo_url string, path string")
    texts = [("r", "main.py", "see ./src/a.py:3"), ("r", "main.py", "import x"), ("r", "src/a.py", "(main.py)"), ("r", "src/a.py", "none"), ("r", "src/a.py", "xmain.pyx"),
             ("q", "b.py", "nothing"), ("q", "main.py", "main.py itself")]
    rows = [(r, p, f"c{i}", t) for i, (r, p, t) in enumerate(texts)]
    chunks_ = spark.createDataFrame(rows, "repo_url string, file_path string, chunk_id string, content string")
    pairs = sum((("src/a.py" in t1 and p1 == "main.py") or "main.py" in t2) for r1, p1, _, t1 in rows for r2, p2, _, t2 in rows
                if r1 == r2 == "r" and p1 == "main.py" and p2 == "src/a.py")
    got = as_set(cross_service.dependency_mentions(chunks_, files), "repo_url", "source", "target", "strength")
    assert got == {("r", "main.py", "src/a.py", pairs), ("r", "src/a.py", "main.py", pairs)}


def test_upsert_takes_one_incoming_row(spark):
    stored = spark.createDataFrame([("a", "c", 1)], "path string, language string, size long")
    incoming = spark.createDataFrame([("a", "go", 5, 2), ("a", "java", 2, 3), ("b", None, 7, 1)], "path string, language string, size long, at int")
    assert as_set(store.upsert_nodes(stored, incoming, ["path"], ["at"]), "path", "language", "size") == {("a", "java", 2), ("b", None, 7)}
    assert as_set(store.upsert_nodes(stored, incoming.drop("at"), ["path"]), "path", "language", "size") == {("a", "java", 2), ("b", None, 7)}


def test_keys_with_separators_are_not_duplicates(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("x", "y"), ("x", "y"), ("n", None)], "p string, q string")
    assert as_set(audit.key_uniqueness({"t": (rows, ["p", "q"])}), "table", "key", "has_null", "n") == {("t", '["x","y"]', False, 2), ("t", '["n",null]', True, 1)}


def test_two_users_asking_one_id(spark):
    store_ = spark.createDataFrame([(1, 7, 5), (2, 8, 5)], "id long, user_id long, payload_id long")
    asked = spark.createDataFrame([(5, 7), (5, 8), (1, 8)], "req_id long, user_id long")
    assert as_set(chats.chat_by_id(store_, asked), "req_id", "req_user", "id") == {(5, 7, 1), (5, 8, 2), (1, 8, 1)}


def test_mentions_go_to_the_first_symbol(spark):
    symbols = spark.createDataFrame([("r", "f", "Class", "cx", "Alpha", 1, 3), ("r", "f", "Function", "fx", "beta", 8, 9)],
                                    "repo_url string, file_path string, label string, unique_id string, name string, start_line int, end_line int")
    chunks = spark.createDataFrame([("r", "f", "k", 5, 6, "x beta and Alpha")], "repo_url string, file_path string, chunk_id string, start_line int, end_line int, content string")
    assert as_set(containment.assign_chunks(chunks, symbols), "parent_id", "rule") == {("cx", "mention")}


def test_parents_naming_symbols_match_brute_force(spark):
    rnd = random.Random(3)
    part = lambda: "".join(rnd.choice("ab/") for _ in range(rnd.randint(1, 4)))
    uids = sorted({f"{part()}::{part()}" for _ in range(60)} | {"a::b::a", "b/a::get", "b/a::get_user"})
    parents = sorted({f"file::{part()}" for _ in range(20)} | {f"{part()}::{part()}{part()}" for _ in range(60)} | {"x/b/a::get_user", "a::b::a::b", "plain"})
    symbols = spark.createDataFrame([("r", "Function", u) for u in uids], "repo_url string, label string, unique_id string")
    chunks = spark.createDataFrame([("r", p, f"c{i}") for i, p in enumerate(parents)], "repo_url string, parent_id string, chunk_id string")
    got = repair.parents_naming_symbols(chunks, symbols)
    expected = {(p, u) for p in parents for u in uids if u in p}
    assert as_set(got, "parent_id", "unique_id") == expected
    ambiguous = as_set(repair.ambiguous_chunks(symbols, chunks), "chunk_id", "n_symbols")
    counts = {f"c{i}": sum(u in p for u in uids) for i, p in enumerate(parents)}
    assert ambiguous == {(c, n) for c, n in counts.items() if n > 1}


def test_covering_across_line_blocks(spark):
    rnd = random.Random(4)
    spans = lambda n, size: [("r", "f%d" % (i % 2), "%d" % i, s, s + rnd.randint(0, size)) for i in range(n) for s in [rnd.randint(1, 2000)]]
    inner, outer = spans(60, 40), spans(60, 900)
    cols = "repo_url string, file_path string, id string, start_line int, end_line int"
    got = containment.covering_pairs(spark.createDataFrame(inner, cols), spark.createDataFrame(outer, cols))
    assert as_set(got, "id", "o_id") == {(a[2], b[2]) for a in inner for b in outer if a[1] == b[1] and b[3] <= a[3] and b[4] >= a[4]}


def test_import_rules(spark):
    files = ["pkg/a.py", "pkg/sub/__init__.py", "pkg/b/c.py", "web/lib.ts", "web/ui/index.js", "com/x/Y.java", "N/S/T.cs", "svc/cart/main.go", "src/root.txt"]
    cases = [("pkg/b/c.py", "..a", "a", "pkg/a.py", "relative"), ("pkg/a.py", "pkg.sub", "sub", "pkg/sub/__init__.py", "python"),
             ("pkg/a.py", "pkg.b.c", "c", "pkg/b/c.py", "python"), ("web/app.ts", "./lib", "lib", "web/lib.ts", "javascript"),
             ("web/app.js", "./ui", "ui", "web/ui/index.js", "javascript"), ("m.java", "com.x.Y", "Y", "com/x/Y.java", "java"),
             ("m.cs", "N.S.T", "T", "N/S/T.cs", "csharp"), ("m.go", "example.org/cart", "cart", "svc/cart/main.go", "go"),
             ("m.py", "src/root.txt", "x", "src/root.txt", "exact"), ("m.py", "nowhere", "x", None, None)]
    imp = spark.createDataFrame([("r", s, t, n, i) for i, (s, t, n, _, _) in enumerate(cases)], "repo_url string, source_path string, target_text string, import_name string, line int")
    got = imports.resolve_imports(imp, spark.createDataFrame([("r", f) for f in files], "repo_url string, path string"))
    assert as_set(got, "line", "target_path", "rule") == {(i, t, r) for i, (_, _, _, t, r) in enumerate(cases) if t}


def test_every_chunk_has_one_parent(g):
    assigned = containment.assign_chunks(g.code_chunks, g.symbols)
    assert assigned.count() == g.chunks.count() == assigned.select("repo_url", "chunk_id").distinct().count()


def test_repairs_are_idempotent(g):
    stored = g.stored_edge_table
    for fix in (lambda s: repair.file_to_symbol(g.files, g.symbols, s), lambda s: repair.file_to_chunk(g.files, g.chunks, s),
                lambda s: repair.symbol_to_chunk_by_id(g.symbols, g.chunks, s)):
        first = fix(stored)
        assert first.count() > 0
        assert fix(repair.add_edges(stored, first)).count() == 0


def test_expansions_agree_with_counts(g):
    named = E.named_class_edges(g.classes, "superclasses")
    pairs = E.expand_named_edges(g.classes, "superclasses", g.classes)
    assert named.agg(F.sum("n_edges")).first()[0] == pairs.count()
    similar = cross_service.similar_models(g.data_models)
    expanded = cross_service.similar_to(g.data_models, g.data_models)
    assert similar.agg(F.sum(F.col("n_models") * F.col("n_similar"))).first()[0] == expanded.count()
    groups = E.proto_multi_path(g.files, g.symbols)
    paths = E.expand_proto_paths(groups, g.symbols)
    assert paths.count() == g.symbols.filter(F.col("file_path").endswith(".proto")).count()


def test_size_chunks(g):
    chunks = chunking.chunk_by_size(g.files)
    longest = chunks.agg(F.max(F.length("content"))).first()[0]
    assert longest <= 2000  # lines that start in the first 1000 characters, the last of them at most 1000 long
    lines = chunks.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct().count()
    assert lines == g.lines.count()


def test_line_span_rules(spark):
    full = "\n".join(f"line {i} word{i}" for i in range(1, 31))
    cases = [("exact", "\n".join(full.split("\n")[4:7]), 5, 7),
             ("first_line", "line 8 word8\nline 9 word9\nline 10 word10\nline  11 word11", 8, 11),
             ("ends", "\n".join(full.split("\n")[9:12]) + "\nAA BB CC DD EE FF GG HH II JJ KK\n" + "\n".join(full.split("\n")[19:22]), 10, 22),
             ("default", "nothing here", 1, 1)]
    df = spark.createDataFrame([(r, c, full, 1) for r, c, _, _ in cases], "name string, chunk string, full string, start_line int")
    assert as_set(chunking.chunk_line_span(df), "name", "rule", "first", "last") == {(r, r, a, b) for r, _, a, b in cases}


def test_embedder_plug_in(spark):
    chunks = spark.createDataFrame([("c%d" % i, "text %d" % i) for i in range(9)], "chunk_id string, content string").coalesce(1)

    def model(texts):
        if "text 4" in texts:
            raise RuntimeError("down")
        return [[1.0, 2.0]] * len(texts)

    got = embedding.embed_chunks(chunks, dim=2, model=model, batch=3)
    assert as_set(got.filter("embedding IS NOT NULL"), "chunk_id") == {(f"c{i}",) for i in (0, 1, 2, 6, 7, 8)}
    assert as_set(got.filter("embedding IS NULL"), "chunk_id", "embedding_error") == {(f"c{i}", "RuntimeError: down") for i in (3, 4, 5)}
    other = embedding.embed_chunks(chunks, dim=3, model=model, batch=3)
    assert other.count() == 9 and other.filter("embedding IS NULL AND embedding_error IS NOT NULL").count() == 9
    blank = embedding.embed_chunks(spark.createDataFrame([("c", "")], "chunk_id string, content string")).first()
    assert blank.embedding == [0.0] * embedding.DIM


def test_scan_repo_files(spark, tmp_path):
    for name, text in {"a.py": b"x = 1", "src/b.py": b"y \xff", "dist/c.py": b"z", "src/d.log.py": b"q", ".git/e.py": b"no", ".github/f.py": b"no",
                       "src/g.txt": b"t", "src/__init__.py": b"", ".gitignore": b"# comment\n\ndist/\n*.log\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_url string, root string")
    got = scan.scan_repo_files(roots, [".py"], 2)
    assert as_set(got, "path", "content") == {("a.py", "x = 1"), ("src/b.py", "y �"), ("src/__init__.py", "")}


def test_chats_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "1", "title": "a"}, {"id": "x", "payload": {"id": "2", "title": "b", "messages": [{"role": "user", "content": "hi"}]}}, {"title": "no id"}]')
    got = store.import_chats_json(spark, str(tmp_path / "c.json"), "me")
    assert as_set(got, "id", "title", "userId") == {("1", "a", "me"), ("2", "b", "me")}


def test_version_write_and_report(spark, tmp_path, g):
    path = store.write_version(g.repositories, str(tmp_path / "repositories"), "1")
    assert spark.read.parquet(path).count() == 20
    store.report_sink(g.repositories, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 20


def test_incremental_ingest_twice(g):
    current = g.repositories.select("url", "current_sha", F.lit(False).alias("force"))
    scanned = g.files.select("repo_url", "path", F.lit("new").alias("v"))
    nodes, status = feeds.ingest_changed(current, g.repositories.select("url", "last_indexed_commit_sha"), scanned, scanned.withColumn("v", F.lit("old")))
    changed = status.filter("reloaded").count()
    assert changed == 10
    assert nodes.filter("v = 'new'").select("repo_url").distinct().count() == changed
    again, status2 = feeds.ingest_changed(current, status.drop("reloaded"), scanned.withColumn("v", F.lit("third")), nodes)
    assert status2.filter("reloaded").count() == 0 and again.filter("v = 'third'").count() == 0


def test_request_queue(spark, tmp_path):
    rows = [("u1", "a", "2024-01-01 00:00:00"), ("u1", "b", "2024-01-01 00:10:00"), ("u2", "a", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "url string, commit string, at string").selectExpr("url", "commit", "timestamp(at) AS requested_at").coalesce(1).write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, commit string, requested_at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    feeds.ingest_queue(stream, lambda batch, epoch: seen.extend(r.url for r in batch.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == ["u1", "u2"]


def test_change_feed_over_two_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, at string, chat_id long, op string, value double"
    make = lambda rows: spark.createDataFrame(rows, "event_id long, at string, chat_id long, op string, value double").selectExpr(
        "event_id", "timestamp(at) AS ts", "at", "chat_id", "op", "value").coalesce(1)
    make([(1, "2024-01-01 00:00:01", 1, "insert", 1.0), (2, "2024-01-01 00:00:05", 2, "insert", 1.0)]).write.parquet(str(tmp_path / "in" / "a"))
    make([(3, "2024-01-01 00:00:03", 2, "update", 2.0), (4, "2024-01-01 00:00:09", 1, "delete", 3.0)]).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = feeds.follow_changes(spark, stream)
    assert as_set(got, "chat_id", "event_id", "op") == {(1, 4, "delete"), (2, 2, "insert")}


def test_append_mode_gives_closed_sessions(spark):
    """In append mode, state is dropped as the watermark passes: closed sessions equal the batch result."""
    batch = spark.read.parquet(f"{SF}/events.parquet")
    whole = as_set(feeds.debounced_saves(feeds.change_feed(batch), "10 minutes"), "chat_id", "event_id", "changes")
    streamed = as_set(feeds.materialize_stream(feeds.debounced_saves(feeds.read_changes(spark, SF), "10 minutes"), "append"),
                      "chat_id", "event_id", "changes")
    assert streamed <= whole and len(streamed) > 0.9 * len(whole)


def test_text_mentions_in_a_very_long_word(spark):
    """One word of a million characters, needles of forty lengths, in one automaton and in many."""
    import time

    needles = ["ab" * n + "c" for n in range(1, 21)] + [f"x{n}/" + "y" * n for n in range(20)] + [" ", "é日", "a b"]
    text = "ab" * 500_000 + "c" + "x7/yyyyyyyyyy é日"
    frames = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    expected = sorted(n for n in needles if n.strip() and n in text)
    for shard in (10**6, 100):
        start = time.time()
        found = cross_service.text_mentions(*frames, ["id"], shard=shard).collect()
        assert sorted(r.needle for r in found) == expected and {r.id for r in found} == {1}
        assert shard == 100 or time.time() - start < 5
    assert cross_service.text_mentions(frames[0], frames[1].limit(0), ["id"]).collect() == []


def test_nesting_like_brute_force(spark):
    rnd = random.Random(27)
    rows = []
    for i in range(400):
        start = rnd.choice([1, 2, 3, rnd.randint(1, 900)])
        rows.append(("r", f"f{i % 3}", rnd.choice(["Class", "Function"]), f"u{i}", rnd.choice("abc"), start, start + rnd.choice([0, 0, 1, 5, 40, 600])))
    rows += [("r", "f0", "Class", "open", "a", None, None), ("r", None, "Class", "nowhere", "a", 1, 1)]
    cols = ["repo_url", "file_path", "label", "unique_id", "name", "start_line", "end_line"]
    got = containment.entity_nesting(spark.createDataFrame(rows, "repo_url string, file_path string, label string, unique_id string, name string, start_line int, end_line int").repartition(5))
    expected = set()
    for a in rows:
        over = [b for b in rows if a is not b and None not in (a[1], a[5], b[1], b[5]) and a[1] == b[1] and b[5] <= a[5] and b[6] >= a[6]
                and ((a[5], a[6]) != (b[5], b[6]) or (b[2], b[4], b[3]) < (a[2], a[4], a[3]))]
        best = min(over, key=lambda b: (b[6] - b[5], b[3]))[3] if over else None
        expected.add((a[3], best, len(over)))
    assert as_set(got, "unique_id", "parent_id", "nesting_level") == expected


def test_chunk_parents_like_brute_force(spark):
    rnd = random.Random(6)
    spans = lambda n, size: [(f"f{i % 2}", i, s, s + rnd.randint(0, size)) for i in range(n) for s in [rnd.randint(1, 1500)]]
    chunks, symbols = spans(200, 30), spans(150, 700)
    got = containment.chunk_parent_by_range(
        spark.createDataFrame([("r", f, f"c{i}", s, e) for f, i, s, e in chunks], "repo_url string, file_path string, chunk_id string, start_line int, end_line int"),
        spark.createDataFrame([("r", f, "Function", f"u{i:03}", s, e) for f, i, s, e in symbols], "repo_url string, file_path string, label string, unique_id string, start_line int, end_line int"))
    expected = set()
    for f, i, s, e in chunks:
        over = [(q - p, p, f"u{k:03}") for g, k, p, q in symbols if g == f and p <= s and q >= e]
        expected.add((f"c{i}", min(over)[2] if over else None))
    assert as_set(got, "chunk_id", "parent_id") == expected


def test_many_symbols_on_one_line(spark):
    """Four times the symbols of one line cost about four times the time, not sixteen times."""
    import time

    import numpy as np

    from loomgraph.operators.sweep import dominated

    took = []
    for n in (50_000, 200_000):
        start = time.time()
        count, best = dominated(np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, bool), np.ones(n, bool), np.arange(n)[::-1].copy())
        took.append(time.time() - start)
        assert count.tolist() == list(range(n)) and best[1:].tolist() == [n - 1 - k for k in range(n - 1)]
    assert took[1] < 10 * took[0]
    rows = spark.range(20_000).selectExpr("'r' AS repo_url", "'one.js' AS file_path", "'Function' AS label", "printf('u%05d', id) AS unique_id",
                                          "printf('n%05d', id) AS name", "1 AS start_line", "1 AS end_line")
    got = {r.unique_id: (r.parent_id, r.nesting_level) for r in containment.entity_nesting(rows).collect()}
    assert len(got) == 20_000 and got["u00000"] == (None, 0) and got["u19999"] == ("u00000", 19_999)


def test_many_questions_meet_blocks_of_candidates(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(90, 6)).astype(np.float32)
    rows = [(f"r{i % 4}" if i % 9 else None, f"p{i % 3}", i % 5, f"c{i:03d}", base[i % 60].tolist()) for i in range(90)]
    rows += [("r1", "p", 1, "none", None), ("r1", "p", 1, "short", [1.0])]
    cand = spark.createDataFrame(rows, "repo_url string, file_path string, start_line int, chunk_id string, embedding array<float>").repartition(3)
    qs = spark.createDataFrame([(f"q{i:02d}", base[i].tolist(), 2 + i % 3) for i in range(30)], "query_id string, embedding array<float>, k int")
    columns = ["query_id", "repo_url", "file_path", "start_line", "chunk_id", "score", "rn"]
    for per_repo in (False, True):
        monkeypatch.setattr(search, "QUESTION_BATCH", 1024)
        whole = as_set(search.vector_topk_many(cand, qs, per_repo), *columns)
        monkeypatch.setattr(search, "QUESTION_BATCH", 10)
        monkeypatch.setattr(search, "BLOCK", 16)
        found = search.vector_topk_many(cand, qs, per_repo)
        assert as_set(found, *columns) == whole
        assert len(whole) == found.count()
        # The questions stay in the cluster: one step over pairs of blocks, not one pass over the candidates for every batch.
        assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") <= 1


def test_callers_are_not_shuffled(spark):
    endpoints = spark.createDataFrame([(k, "ru", "users", f"name{k}", f"/p{k}") for k in range(5)],
                                      "endpoint_id long, repo_url string, service_name string, name string, path string")
    functions = spark.createDataFrame([("rw", "web", f"f{k}", f"http name{k} /p{k}") for k in range(5)],
                                      "repo_url string, service_name string, unique_id string, text string")
    calls = cross_service.may_call(functions, endpoints)
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert calls.count() == 10
    per_service = cross_service.may_call(functions.union(functions).coalesce(1), endpoints, ids=["repo_url", "service_name"])
    assert per_service.count() == 10  # rules and keys once, not once for each function


def test_grouped_calls_count_like_single_ones(spark):
    rnd = random.Random(8)
    names, paths, services = [f"n{k}x" for k in range(8)], [f"/{k}/" for k in range(8)], ["svca", "svcb", "svcc"]
    endpoints = [(k, "r", rnd.choice(services), rnd.choice(names), rnd.choice(paths)) for k in range(60)]
    functions = [("r", rnd.choice(services), f"f{k % 35}", "http " + " ".join(rnd.sample([*names, *paths, *services], rnd.randint(0, 6)))) for k in range(40)]
    functions = [(r, "svca" if k % 35 < 5 else s, u, t) for k, (r, s, u, t) in enumerate(functions)]  # five functions come twice
    e = spark.createDataFrame(endpoints, "endpoint_id long, repo_url string, service_name string, name string, path string")
    f = spark.createDataFrame(functions, "repo_url string, service_name string, unique_id string, text string")
    pairs = {(s, u, k, d) for _, s, u, t in functions for k, _, d, n, p in endpoints if s != d and (n in t or p in t or d in t)}
    wanted: dict = {}
    for s, _, _, d in pairs:
        wanted[s, d] = wanted.get((s, d), 0) + 1
    grouped = cross_service.may_call(f, e, grouped=True)
    for calls in (grouped, cross_service.may_call(f, e)):
        assert {(r.src, r.dst): r.n for r in cross_service.calls_service(calls, e).collect()} == wanted


def test_long_needles_need_no_automaton(spark, monkeypatch):
    rnd = random.Random(4)
    needles = sorted({"src/" + "".join(rnd.choice("abé/") for _ in range(rnd.randint(2, 30))) for _ in range(300)})
    texts = [(i, "x".join(rnd.choice(needles)[rnd.randint(0, 1):] for _ in range(4)) + "é" * (i % 3)) for i in range(60)] + [(99, None), (98, ""), (97, "src/")]
    from loomgraph.operators import matching

    built = []
    monkeypatch.setattr(matching, "mentions", lambda t, n, *a, f=matching.mentions: (built.append(n.count()), f(t, n, *a))[1])
    got = matching.text_mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"), ["id"])
    assert as_set(got, "id", "needle") == {(i, n) for i, t in texts for n in needles if t and n in t}
    assert built == [sum(len(n.encode()) < 8 for n in needles)]
