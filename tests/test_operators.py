import random

import pytest
from pyspark.sql import functions as F

from sparkquiver import schema
from sparkquiver.functions import hashes, paths, text
from sparkquiver.graph import from_rows
from sparkquiver.operators import analytics, architecture, http, incremental, resolve, search, similarity, traverse
from sparkquiver.operators.architecture import Scoped
from sparkquiver.operators.components import connected_components
from sparkquiver.schema import InvalidRequest, NotFound


def fn(name, path="src/lib.rs", **more):
    return {"id": name, "kind": "function", "name": name, "qualified_name": name, "file_path": path, "start_line": 1, "end_line": 3} | more


def call(a, b):
    return {"source": a, "target": b, "kind": "calls"}


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return from_rows(spark, [fn(x) for x in "abcdy"], [call("a", "b"), call("b", "c"), call("c", "d")])


def plain_bfs(edges, starts, depth):
    """Distances over a small edge list."""
    out, queue = {s: 0 for s in starts}, list(starts)
    for x in queue:
        if out[x] < depth:
            for a, b in edges:
                if a == x and b not in out:
                    out[b] = out[x] + 1
                    queue.append(b)
    return out


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_reachable(spark, chain):
    assert ids(traverse.reachable_calls(chain, seeds(spark, "d"), 2)) == ["b", "c"]
    assert ids(traverse.reachable_calls(chain, seeds(spark, "d"), 1)) == ["c"]
    assert ids(traverse.reachable_calls(chain, seeds(spark, "d"), 0)) == []
    assert ids(traverse.reachable_calls(chain, seeds(spark, "b"), 2, "both")) == ["a", "c", "d"]
    with pytest.raises(InvalidRequest):
        traverse.reachable_calls(chain, seeds(spark, "b"), 2, "up")


def test_distances_of_random_graphs(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(30)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)]
    g = from_rows(spark, [fn(n) for n in names], [call(a, b) for a, b in pairs])
    got = {r["id"]: r["depth"] for r in traverse.distances(seeds(spark, "n0", "n7"), traverse.directed(g.edges, "outbound"), 4).collect()}
    assert got == plain_bfs(pairs, ["n0", "n7"], 4)


def test_relations_and_subgraphs(spark, chain):
    assert sorted((r["node_id"], r["depth"]) for r in traverse.callers(chain, "d", 2).collect()) == [("b", 2), ("c", 1)]
    assert [(r["node_id"], r["depth"]) for r in traverse.callees(chain, "a", 1).collect()] == [("b", 1)]
    with pytest.raises(NotFound):
        traverse.callers(chain, "nope", 1)
    sub = traverse.subgraph(chain, "b", 1)
    assert ids(sub.nodes) == ["a", "b", "c"] and sub.edges.count() == 3
    assert traverse.bfs(chain, ["b"], 1).edges.count() == 2
    assert sorted((r["role"], r["id"], r["depth"]) for r in traverse.impact_analysis(chain, "b", 2).collect()) == [("callee", "c", 1), ("callee", "d", 2), ("caller", "a", 1)]


def test_blast(spark):
    g = from_rows(spark, [fn("api"), fn("helper"), fn("caller", "src/consumer.rs")], [call("caller", "api"), call("caller", "helper")])
    seed, hit, files = traverse.blast_radius(g, ["src/lib.rs"])
    assert seed.count() == 2 and ids(hit) == ["caller"] and ids(files, "file_path") == ["src/consumer.rs"]


def test_dead_code(spark):
    g = from_rows(spark, [fn("a"), fn("b"), fn("c", is_exported=True), fn("d", "x/bin/main.rs")], [call("a", "b")])
    assert ids(analytics.dead_code(g)) == ["a"]
    row = analytics.dead_code_report(g).first()
    assert (row["total_functions"], row["entry_points"], row["dead"]) == (4, 2, 1)


def test_dead_code_sorts_no_side(spark):
    """Nodes stream past the called ones, each told once however many calls reach it."""
    g = from_rows(spark, [fn("a"), fn("b"), fn("c")], [call("a", "b")] * 50 + [call("b", "gone"), {"id": "n", "source": "a", "target": None, "kind": "calls"}])
    dead = analytics.dead_code(g)
    assert ids(dead) == ["a", "c"] and analytics.dead_code_report(g).first()["dead"] == 2
    plan = dead._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.index("ShuffledHashJoin") < plan.index("HashAggregate")


def test_hotspots_and_layers(spark):
    g = from_rows(spark, [fn(x) for x in "abcd"], [call("a", "c"), call("b", "c"), call("b", "d"), call("a", "d"), call("c", "d")])
    assert [(r["id"], r["in_degree"]) for r in architecture.hotspots(Scoped(g), 2).collect()] == [("d", 3), ("c", 2)]
    found = {r["id"]: (r["layer"], r["cyclic"]) for r in traverse.layers(g, seeds(spark, "a")).collect()}
    assert found == {"a": (0, False), "c": (1, False), "d": (2, False)}
    loop = from_rows(spark, [fn(x) for x in "abc"], [call("a", "b"), call("b", "c"), call("c", "b")])
    assert {r["id"]: (r["layer"], r["cyclic"]) for r in traverse.layers(loop, seeds(spark, "a")).collect()} == {"a": (0, True), "b": (1, True), "c": (2, True)}


def test_scope_rules(spark):
    g = from_rows(spark, [fn(f"a{i}", "src/a.rs") for i in range(5)] + [fn(f"c{i}", "src/b/c.rs") for i in range(3)], [])
    assert architecture.overview(Scoped(g)).first()["nodes"] == 8
    assert architecture.overview(Scoped(g, "src/a")).first()["nodes"] == 5
    assert architecture.structure(Scoped(g, "src/b")).first()["node_count"] == 3
    for bad in ("a'b", "a;b", "a\\b"):
        with pytest.raises(InvalidRequest):
            Scoped(g, bad)
    assert architecture.parse_aspects("deps, file-tree,nope") == ["dependencies", "file_tree"]
    assert len(architecture.parse_aspects("")) == 11


@pytest.mark.parametrize(
    ("name", "want"),
    [("updateCloudClient", "update cloud client"), ("parse_user_input", "parse user input"), ("XMLParser_next", "xmlparser next"), ("", ""), ("___", ""), ("foo123Bar", "foo123 bar"), ("HTTP", "http"), ("a_a_b", "a b")],
)
def test_identifier_tokens(spark, name, want):
    assert spark.createDataFrame([(name,)], "x string").select(text.tokenize_identifier(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("/users/", "/users"), ("//foo//bar//", "/foo/bar"), ("/", "/"), ("//", "/"), ("/users/:id", "/users/*"), ("/items/{item_id}", "/items/*"), ("/f/<x>/*rest", "/f/*/*")])
def test_http_paths(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(paths.normalize_http_path(F.col("x"))).first()[0] == want


def test_packages(spark):
    df = spark.createDataFrame([("a.rs",), ("src/a.rs",), ("src/b/c/d.rs",)], "p string").select(paths.package_of(F.col("p")))
    assert [r[0] for r in df.collect()] == ["", "src", "src/b"]


def test_cross_service(spark):
    def score(ma, pa, mb, pb):
        one = lambda m, p: spark.createDataFrame([(m, p)], "method string, path string")
        r = http.cross_service(one(ma, pa), one(mb, pb)).collect()
        return r[0]["confidence"] if r else 0.0

    assert score("GET", "/users/:id", "get", "/users/:id") == 1.0
    assert score("GET", "/users/:id", "GET", "/users/42") == 0.85
    assert score("GET", "/:v/users", "GET", "/v1/users") == 0.85
    assert score("GET", "/v1/users", "GET", "/:v/users") == 0.85
    assert score("GET", "/users/*", "GET", "/users") == 0.7
    assert score("GET", "/orders", "POST", "/orders") == 0.5
    assert score("GET", "/a", "GET", "/b") == 0.0


def test_search(spark):
    g = from_rows(spark, [fn("Parser"), fn("parse_user_input"), fn("Parse", qualified_name="x::Parse")], [])
    assert [r["name"] for r in search.search_nodes(g, "parse").collect()][0] == "Parse"
    for q in ("", "  ", "___"):
        assert search.search_nodes(g, q).count() == 3
    assert ids(search.find_definitions(g, "Parser")) == ["Parser"]


def test_code_search(spark):
    g = from_rows(spark, [fn("f", "src/a.rs", start_line=1, end_line=10), fn("t", "tests/a.rs")], [call("x", "f"), call("y", "f")])
    files = spark.createDataFrame([("src/a.rs", "needle\nb\nneedle\nd"), ("docs/b.rs", "needle"), ("tests/a.rs", "needle")], "path string, text string")
    rows = search.code_search(g, files, "needle", context=1).collect()
    assert [(r["node_id"], r["file_path"], r["match_count"], r["snippet"], r["hit_kind"], r["in_degree"]) for r in rows] == [("f", "src/a.rs", 2, "needle\nb", "definition", 2), (None, "docs/b.rs", 1, "needle", "usage", 0)]
    assert search.code_search(g, files, "needle", path_regex="src/").count() == 1
    assert search.code_search(g, files, " ").count() == 0
    for bad in ({"limit": 0}, {"context": 51}):
        with pytest.raises(InvalidRequest):
            search.code_search(g, files, "x", **bad)


def test_enclosing_takes_the_smallest(spark):
    spans = from_rows(spark, [fn("outer", "a", start_line=1, end_line=900), fn("inner", "a", start_line=300, end_line=310), fn("twin", "a", start_line=300, end_line=310)], []).nodes
    points = spark.createDataFrame([("a", 305), ("a", 299), ("a", 901), ("b", 1)], "file_path string, line int")
    assert {(r["file_path"], r["line"]): r["node_id"] for r in search.enclosing(points, spans).collect()} == {("a", 305): "inner", ("a", 299): "outer", ("a", 901): None, ("b", 1): None}


def test_resolve(spark):
    nodes = [{"id": "file:src/a.rs", "kind": "file", "name": "src/a.rs", "file_path": "src/a.rs"}, fn("go", "src/a.rs", start_line=3, end_line=9), fn("far", "lib/z.rs"), fn("near", "src/b.rs") | {"name": "far"}]
    edges = [{"id": "e", "source": "file:src/a.rs", "target": "function:far:*", "kind": "calls", "line": 4}, {"id": "f", "source": "file:src/a.rs", "target": "function:gone:*", "kind": "calls", "line": 4}, call("go", "near")]
    g = from_rows(spark, nodes, edges)
    assert sorted((r["source"], r["target"]) for r in resolve.resolve_references(g.nodes, g.edges).collect()) == [("file:src/a.rs", "function:gone:*"), ("go", "near"), ("go", "near")]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 3)], "id string, seq int, version long")
    new = spark.createDataFrame([("b", 5), ("b", 4), ("c", 6)], "id string, seq int")
    assert sorted(tuple(r) for r in resolve.upsert(old, new, ["id"]).select("id", "seq", "version").collect()) == [("a", 1, 1), ("b", 5, 5), ("c", 6, 1)]


def test_replace_files_leaves_no_double_edges(spark):
    g = from_rows(spark, [fn("a"), fn("b", "src/b.rs")], [call("a", "b"), call("b", "a")])
    paths_ = spark.createDataFrame([("src/lib.rs",)], "path string")
    again = from_rows(spark, [fn("a")], [call("a", "b")])
    out = incremental.replace_files(g, paths_, again.nodes, again.edges)
    assert sorted((r["source"], r["target"]) for r in out.edges.collect()) == [("a", "b"), ("b", "a")] and ids(out.nodes) == ["a", "b"]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes():
    assert f"{hashes.fnv(b''):016x}" == "cbf29ce484222325" and f"{hashes.fnv(b'a'):016x}" == "af63dc4c8601ec8c"
    m = hashes.minhash_of(list("abcdef"))
    assert len(m) == 64 and m == hashes.minhash_of(list("abcdef")) and all(0 <= x < 1 << 32 for x in m)
    assert hashes.minhash_of([]) == hashes.minhash_of([]) and hashes.minhash_of(["a"]) != hashes.minhash_of(["b"])
    v = hashes.random_index_of("foo")
    assert len(v) == 8 and abs(sum(x * x for x in v.values()) - 1) < 1e-9 and v == hashes.random_index_of("foo")


def test_hashes_of_batches():
    rng = random.Random(2)
    rows = [["".join(rng.choices("abé$", k=rng.choice([0, 1, 5, 47, 48, 49, 300]))) for _ in range(rng.choice([0, 1, 2, 3, 40]))] for _ in range(60)] + [None]
    assert hashes.minhash_all(rows) == [None if r is None else hashes.minhash_of(r) for r in rows]


def test_components_that_do_not_settle_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(schema.StorageError):
        connected_components(path, max_rounds=1)


def test_resolution_of_names_that_many_share(spark):
    """The caller's file first, then what lies under its directory, then any; against a plain search."""
    rng = random.Random(8)
    files = ["a.rs", "x/a.rs", "x/b.rs", "x/y/c.rs", "z/d.rs"]
    nodes = [fn(f"n{i}", rng.choice(files)) | {"name": rng.choice(["new", "ns::new", "get", "own"])} for i in range(60)]
    edges = [{"id": f"e{k}", "source": f"n{rng.randrange(60)}", "target": rng.choice(["function:new:*", "*:get", "function:none:*", "x:own:*"]), "kind": "calls"} for k in range(80)]
    g = from_rows(spark, nodes, edges)
    where = {n["id"]: n["file_path"] for n in nodes}
    want = {}
    for e in edges:
        parts, file = e["target"].split(":"), where[e["source"]]
        name = parts[-1] if e["target"].startswith("*") else parts[-2]
        same = [n for n in nodes if n["name"].split("::")[-1] == name]
        folder = file[: file.rfind("/") + 1]
        rank = lambda n: 0 if n["file_path"] == file else 1 if folder and n["file_path"].startswith(folder) else 2  # noqa: B023, E731
        want[e["id"]] = min(same, key=lambda n: (rank(n), nodes.index(n)))["id"] if same else e["target"]
    assert {r["id"]: r["target"] for r in resolve.resolve_references(g.nodes, g.edges).collect()} == want


def test_resolution_reads_edges_twice(spark):
    """Once for open edges and once for the others; sources that are files, no nodes or null, and repeated edges, come out right."""
    nodes = [{"id": "file:x/a.rs", "kind": "file", "name": "x/a.rs", "file_path": "x/a.rs"}, fn("in", "x/a.rs", start_line=3, end_line=9), fn("any", "z.rs") | {"name": "go"}, fn("near", "x/y/b.rs") | {"name": "go"}, fn("root", "") | {"name": "top"}]
    edges = [
        {"id": "moved", "source": "file:x/a.rs", "target": "function:go:*", "kind": "calls", "line": 4},
        {"id": "outside", "source": "file:x/a.rs", "target": "*:go", "kind": "calls", "line": 40},
        {"id": "lost", "source": "file:x/a.rs", "target": "function:none:*", "kind": "calls", "line": 4},
        {"id": "foreign", "source": "nobody", "target": "function:go:*", "kind": "calls"},
        {"id": "null", "source": None, "target": "function:top:*", "kind": "calls"},
        {"id": "empty", "source": "root", "target": "function:top:*", "kind": "calls"},
        {"id": "nameless", "source": "in", "target": "function::*", "kind": "calls"},
        {"id": "twice", "source": "in", "target": "*:go", "kind": "calls"},
        {"id": "twice", "source": "in", "target": "*:go", "kind": "calls"},
        call("in", "any") | {"id": "done"},
    ]
    g = from_rows(spark, nodes, edges)
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    counted = spark.createDataFrame(g.edges.rdd.map(seen), g.edges.schema)
    got = sorted((r["id"], r["source"], r["target"]) for r in resolve.resolve_references(g.nodes, counted).collect())
    assert read.value == 2 * len(edges)
    assert got == [("done", "in", "any"), ("empty", "root", "root"), ("foreign", "nobody", "any"), ("lost", "file:x/a.rs", "function:none:*"), ("moved", "in", "near"), ("nameless", "in", "function::*"), ("null", None, "root"), ("outside", "file:x/a.rs", "near"), ("twice", "in", "near"), ("twice", "in", "near")]


def test_content_hash(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select(hashes.content_hash("t"))
    assert [r[0] for r in df.collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None]


def test_semantic_edges_match_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(14):
        t = rng.sample(words, rng.randint(2, 5))
        if i % 3 == 1:
            t = rows[-1][4]
        rows.append((f"n{i}", f"name{i}", i % 4 != 0, i % 3 == 0, t, t[:2], sorted(t), [float(len(t))] * 25, [int(x[1:]) for x in t], [1.0, float(len(t))], "src/a.rs", i))
    sig = spark.createDataFrame(rows, "id string, name string, is_exported boolean, is_async boolean, tokens array<string>, api_sig array<string>, data_flow_set array<string>, ast_profile array<double>, minhash array<long>, ri_vec array<double>, module_path string, seq long")
    a, b = sig.select(F.struct("*").alias("a")), sig.select(F.struct("*").alias("b"))
    every = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), similarity.combined_score().alias("s")).where("s >= 0.75")
    want = sorted((r["x"], r["y"], round(r["s"], 9)) for r in every.collect())
    got = sorted((r["source"], r["target"], round(r["score"], 9)) for r in similarity.semantic_edges(sig, top=99).collect())
    assert got == want and want


def test_semantic_edges_score_alike_nodes_once(spark):
    """Many nodes that differ in their name only, some not even in that: the best of each against all pairs, over few scored pairs."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        k = rng.randrange(4)
        name = "twin" if i % 11 == 0 else f"name{i}" if i % 13 else f"test_{i}"
        t = ["a", "b", "c", "d"] if k < 3 else [f"own{i}"]
        rows.append((f"n{i:02}", name, k != 1, k == 2, t, t[:1], sorted(t), [1.0] * 25, [k, 2, 3], [1.0, k / 3], f"src/{i % 2}.rs", i))
    sig = spark.createDataFrame(rows, "id string, name string, is_exported boolean, is_async boolean, tokens array<string>, api_sig array<string>, data_flow_set array<string>, ast_profile array<double>, minhash array<long>, ri_vec array<double>, module_path string, seq long")
    a, b = sig.select(F.struct("*").alias("a")), sig.select(F.struct("*").alias("b"))
    every = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.round(similarity.combined_score(), 9).alias("s")).where("s >= 0.75").collect()
    want = {}
    for r in sorted(every, key=lambda r: (r["x"], -r["s"], r["y"])):
        want.setdefault(r["x"], []).append((r["y"], r["s"]))
    for top in (1, 3, 99):
        got = {}
        for r in sorted(similarity.semantic_edges(sig, top=top).collect(), key=lambda r: (r["source"], -round(r["score"], 9), r["target"])):
            got.setdefault(r["source"], []).append((r["target"], round(r["score"], 9)))
        assert got == {x: y[:top] for x, y in want.items()} and len(want) > 20


def test_empty_graph(spark):
    g = from_rows(spark, [], [])
    assert analytics.stats(g).first()["total_nodes"] == 0
    assert search.search_nodes(g, "x").count() == 0
    assert architecture.hotspots(Scoped(g)).count() == 0
    assert schema.columns(schema.NODE)[17] == "extra"


def test_vector_codec_and_projection(spark):
    import numpy as np

    df = spark.createDataFrame([([1.0, -0.5, 0.1234567],)], "v array<double>").select(similarity.encode_vector(F.col("v")).alias("t"))
    assert df.first()[0] == "1.000000 -0.500000 0.123457"
    back = df.select(similarity.decode_vector(F.col("t"), 3).alias("a"), similarity.decode_vector(F.col("t"), 4).alias("b"), similarity.decode_vector(F.lit("1 x 2"), 3).alias("c")).first()
    assert back["a"] == [1.0, -0.5, 0.123457] and back["b"] is None and back["c"] is None
    e = similarity.project_signature(np.zeros(768), np.arange(25.0), np.arange(64))
    assert abs(float((e * e).sum()) - 1) < 1e-9


def test_random_index_corpus_and_diffusion(spark):
    docs = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"]), ("c", ["x", "y"])], "id string, tokens array<string>")
    corpus = similarity.random_index_corpus(docs, 64)
    vecs = {r["token"]: r["vec"] for r in corpus.collect()}
    assert set(vecs) == {"x", "y", "z"} and all(abs(sum(t * t for t in v) - 1) < 1e-9 for v in vecs.values())
    d = {r["id"]: r["vec"] for r in similarity.document_vectors(docs, corpus, 64).collect()}
    assert d["a"] == d["c"] != d["b"]
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0]), ("r", [0.0, 0.0])], "id string, vec array<double>")
    e = spark.createDataFrame([("p", "q", 1), ("p", "p", 2), ("p", "gone", 3)], "source string, target string, seq int")
    out = {r["id"]: r["vec"] for r in similarity.diffuse(v, e, 0.5).collect()}
    assert [round(x, 6) for x in out["p"]] == [0.707107, 0.707107] and out["q"] == [0.0, 1.0] and out["r"] == [0.0, 0.0]
    assert {r["id"]: r["vec"] for r in similarity.diffuse(v, e, float("nan")).collect()}["p"] == [1.0, 0.0]


def test_parallel_edges_are_counted_before_their_ends_are_joined(spark):
    nodes = [{"id": i, "kind": "module", "name": i, "file_path": p} for i, p in (("a", "x/y/a.rs"), ("b", "x/y/b.rs"), ("c", "x/z/c.rs"))]
    ends = [("a", "b")] * 5 + [("a", "c")] * 3 + [("c", "a")] * 2 + [("b", "lost")] + [("lost", "b")]
    g = from_rows(spark, nodes, [{"source": s, "target": t, "kind": k} for s, t in ends for k in ("imports", "calls")])
    scoped = architecture.Scoped(g)
    assert scoped.ends.count() == 8 and scoped.ends.agg({"n": "sum"}).first()[0] == 22
    assert [tuple(r) for r in architecture.structure(scoped).collect()] == [("x/y", 2, 10), ("x/z", 1, 0)]
    assert [tuple(r) for r in architecture.dependencies(scoped).collect()] == [("x/y/a.rs", "x/y/b.rs", 5), ("x/y/a.rs", "x/z/c.rs", 3), ("x/z/c.rs", "x/y/a.rs", 2)]
    assert [tuple(r)[:3] for r in architecture.boundaries(scoped).collect()] == [("x/y", 3, 2), ("x/z", 2, 3)]
    assert [tuple(r) for r in architecture.languages(scoped).collect()] == [("rust", 3, 3, 22)]


def test_levels_of_few_and_of_many_nodes_are_the_same(spark, monkeypatch):
    """Steps are stored only for a level that is too large to be sent to them."""
    from sparkquiver.operators import components

    g = from_rows(spark, [fn(x) for x in "abcdefg"], [call(s, t) for s, t in ("ab", "ac", "bd", "cd", "de", "ef", "ef", "fa", "xa", "gx")])
    found, stored = [], []
    monkeypatch.setattr(traverse, "cut", lambda df: stored.append("here" in df.columns) or components.cut(df))
    for few in (10_000, 0):
        monkeypatch.setattr(traverse, "FEW", few, raising=False)
        monkeypatch.setattr(components, "FEW", few, raising=False)
        stored.clear()
        rows = [sorted(map(tuple, df.collect())) for df in (traverse.callers(g, "a", 2), traverse.subgraph(g, "a", 2).edges.select("source", "target", "seq"))]
        found.append(rows)
        assert any(stored) == (few < 10_000)
    assert found[0] == found[1]


def test_layers_are_longest_walks_from_entries(spark):
    rng = random.Random(9)
    steps = {(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.12}
    g = from_rows(spark, [fn(f"n{i}", "a.rs") for i in range(30)], [{"id": f"e{a}.{b}", "source": f"n{a}", "target": f"n{b}", "kind": "calls"} for a, b in steps])
    want = {0: 0, 7: 0, 29: 0}
    for a, b in sorted(steps):
        if a in want:
            want[b] = max(want.get(b, 0), want[a] + 1)
    entries = spark.createDataFrame([("n0",), ("n7",), ("n29",)], "id string")
    got = traverse.layers(g, entries).collect()
    assert {int(r["id"][1:]): r["layer"] for r in got} == want and len(got) == len(want) and not any(r["cyclic"] for r in got)


def test_first_rows_come_from_all_tasks(spark):
    """A large limit leaves the rows where they were sorted, rather than in one task."""
    ordered = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k").repartition(6).orderBy("k")
    for limit in (0, 1, 1700, 4999, 5000, 1 << 30):
        assert [r["k"] for r in search.first_rows(ordered, limit).collect()] == list(range(min(limit, 5000)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert search.first_rows(ordered, 1 << 30).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_minhash_reads_a_batch_in_runs(spark, monkeypatch):
    import pyarrow as pa

    rows = [["a", "b", "c"] * 5, None, [], ["x"], ["y"] * 40, ["z", "w"]]
    monkeypatch.setattr(hashes, "HELD", 7)
    seen, whole = [], hashes.minhash_all
    monkeypatch.setattr(hashes, "minhash_all", lambda r: seen.append(len(r)) or whole(r))
    assert hashes.minhash.func(pa.array(rows)).to_pylist() == whole(rows) and len(seen) > 2
