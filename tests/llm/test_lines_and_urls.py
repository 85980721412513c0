"""Line dedup and URL templates on small tables, and against their SQL."""

import hashlib

from loomgraph.llm import line_dedup, url_filter

LONG = "A line that is long enough"


def digest(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(spark.createDataFrame(rows, schema)).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_shared_lines_stay_in_the_last_document(spark):
    rows = [(1, f"x\n  {LONG.upper()}\t\n{LONG}\ny"), (2, f"{LONG}\n{LONG}"), (3, f"é\n{LONG}\n{LONG}\n"), (4, None), (5, ""), (6, "short\nshort")]
    assert digest(spark, rows) == {
        1: (4, 2, sha("x\ny")),
        2: (2, 2, sha("")),
        3: (4, 0, sha(f"é\n{LONG}\n{LONG}\n")),
        4: (1, 0, sha("")),
        5: (1, 0, sha("")),
        6: (2, 0, sha("short\nshort")),
    }


def test_two_documents_are_not_enough_and_only_ascii_is_lowered(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG), (3, "É" * 20), (4, "é" * 20), (5, "é" * 20 + " "), (6, "é" * 19)]
    assert all(v[1] == 0 for v in digest(spark, rows).values())


def test_bitmap_runs(spark):
    text = "\n".join([LONG, LONG, "k1", LONG, "k2", LONG])
    docs = spark.createDataFrame([(1, text), (2, LONG), (3, LONG)], "doc_id long, text string")
    runs = {r._doc: [tuple(x) for x in r._drops] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert runs == {1: [(0, 2), (3, 4), (5, 6)], 2: [(0, 1)]}


def test_other_columns_and_odd_rows(spark):
    rows = [(1, LONG, "a", 7), (2, LONG, None, 8), (None, LONG, "c", 9), (None, "x", "d", 1), (3, LONG + "\n" * 50_000, "e", 2)]
    out = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string, drops string, n_lines int"))
    got = {(r.doc_id, r.drops): (r.n_lines, r.n_dropped, len(r.text)) for r in out.collect()}
    assert got == {(1, "a"): (1, 1, 0), (2, None): (1, 1, 0), (None, "c"): (1, 1, 0), (None, "d"): (1, 0, 1), (3, "e"): (50_001, 0, len(LONG) + 50_000)}
    assert digest(spark, []) == {}


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "http://net", "x://b.net/", "http://example.com/de/1", "http://notexample.com/de/1", "http://q.org/fr/", "no url", None, "a://b://c/d", "http://h?x/y", "http://ÄB.org/fr/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([], "label_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        1: ("net", "", None, "allow"),
        2: ("b.net", "/", "net/", "block"),
        3: ("example.com", "/de/1", "example.com/de/", "block"),
        4: ("notexample.com", "/de/1", None, "allow"),
        5: ("q.org", "/fr/", "org/fr/", "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("b:", "//c/d", None, "allow"),
        9: ("h", "", None, "allow"),
        10: ("Äb.org", "/fr/1", "org/fr/", "allow"),
    }


def test_impure_branch_is_a_template_of_its_own_and_rejected(spark):
    pages = [(i, f"http://h.com/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    labels = [(i, 0 if i % 2 else 1) for i in range(200)]
    out = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "label_id long, good int"))
    got = {(r.template, r.verdict) for r in out.collect()}
    assert got == {("/spam/*", "block"), ("/news/*", "allow")}


def test_similar_branches_merge(spark):
    pages = [(i, f"http://h.com/{'ab'[i % 2]}/{i}") for i in range(200)] + [(None, None), (None, "")]
    labels = [(i, i % 4 < 2) for i in range(200)]
    out = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(a, int(b)) for a, b in labels], "label_id long, good int"))
    rows = out.collect()
    assert len(rows) == 202 and {r.template for r in rows if r.host} == {"/*/*"}


def judged(spark, urls, good):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(good)), "label_id long, good int")
    return url_filter.judge(pages, labels).collect()


def test_paths_split_at_any_depth(spark):
    urls = [f"http://h.com/en/shop/a/b/{'spam' if i % 2 else 'news'}/{i}" for i in range(400)]
    got = {(r.template, r.verdict) for r in judged(spark, urls, [1 - i % 2 for i in range(400)])}
    assert got == {("/*/*/*/*/spam/*", "block"), ("/*/*/*/*/news/*", "allow")}


def test_alike_branches_share_their_labels(spark):
    urls = [f"http://h.com/{'abcdef'[i % 6]}/{i}" for i in range(600)] + ["http://h.com/*low/x"]
    got = {(r.template, r.verdict, r.n_labelled) for r in judged(spark, urls, [int(i % 6 > 1) for i in range(600)])}
    assert got == {("/*low/*", "block", 200), ("/*high/*", "allow", 400), ("/*/*", "allow", 0)}


def test_judge_matches_its_sql(spark):
    import random

    import duckdb
    rng = random.Random(5)
    words = ["en", "fr", "spam", "*", "*low", "", "x"]
    urls = [f"https://h{rng.choice('ab')}.com/" + "/".join([*(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 6]))), str(i)]) for i in range(1500)]
    good = [int(rng.random() < (0.15 if "spam" in u else 0.5 if "fr" in u else 0.95)) for u in urls]
    urls += [None, "", "http://h.com/" + "y/" * 20_000]
    rows = judged(spark, urls, good)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [p for p in enumerate(urls) if len(p[1] or "") < 1000])
    con.executemany("INSERT INTO labels VALUES (?, ?, 0)", list(enumerate(good)))
    found = con.execute(url_filter.ORACLE)
    names = [d[0] for d in found.description]
    want = {tuple(sorted(zip(names, r), key=lambda x: x[0])) for r in found.fetchall()}
    got = {tuple(sorted(r.asDict().items())) for r in rows if len(r.path) < 1000}
    assert got == want and len(rows) == 1503
    assert any("low" in r.template for r in rows) and len({r.template for r in rows}) > 12


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, spark.createDataFrame([(1, 1)], "label_id long, good int")).collect() == []
