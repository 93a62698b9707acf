"""Operators on small inputs made by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom import api, extensions, store
from graphloom.functions import classify, paths, text
from graphloom.graph import PropertyGraph
from graphloom.operators import analytics, clusters, components, decisions, extract, findings, incremental, quality, relational, resolve, retrieval, search, similarity, syntax, traverse
from graphloom.plans import evaluation_queries, match
from graphloom.streaming import events


def graph(spark, *pairs, labels=None):
    names = sorted({x for p in pairs for x in p[:2]})
    nodes = spark.createDataFrame([(n, (labels or {}).get(n, "Symbol"), n.upper(), None) for n in names], "id string, label string, name string, path string")
    rows = [(f"e{k}", p[0], p[1], p[2] if len(p) > 2 else "Calls") for k, p in enumerate(pairs)]
    return PropertyGraph(nodes, spark.createDataFrame(rows, "id string, source string, target string, kind string"))


def test_match_language(spark):
    g = graph(spark, ("a", "b"), ("a", "b"), ("c", "b", "Contains"), ("b", "d"))
    assert [tuple(r) for r in match.run(g, 'MATCH (x:Symbol)-[:Calls]->(y:Symbol) WHERE x.name CONTAINS "A" RETURN x, y').collect()] == [("a", "A", "b", "B")]
    assert match.run(g, 'MATCH (x)-[:Calls]->(y)-[:Calls]->(z) RETURN x, z').count() == 1
    assert match.run(g, 'MATCH (y)<-[:Contains]-(x) WHERE x.name = "C" AND y.name = "B" RETURN y').count() == 1
    assert match.run(g, 'MATCH (x) WHERE x.color = "red" RETURN x').count() == 0
    for bad in ("MATCH (x RETURN x", "MATCH (x) RETURN y", "MATCH (x) WHERE z.name = \"a\" RETURN x", "MATCH (x) RETURN x x", "MATCH (x)-[:K]->(x) RETURN x", "MATCH (x) WHERE x.name = a RETURN x", "FIND (x)", "MATCH (x) RETURN %"):
        with pytest.raises(match.QueryError):
            match.parse(bad)


def test_degrees_of_dangling_ends(spark):
    g = graph(spark, ("a", "b"), ("c", "b"))
    bare = PropertyGraph(g.nodes.where("id = 'a'"), g.edges)
    assert {tuple(r) for r in analytics.degrees(bare, dangling=True).collect()} == {("a", 0, 1), ("b", 2, 0), ("c", 0, 1)}
    assert {tuple(r) for r in analytics.degrees(bare).collect()} == {("a", 0, 1)}
    assert {r.issue for r in bare.issues().collect()} == {"dangling_source", "dangling_target"}


def test_shortest_path_takes_the_first_ids(spark):
    g = graph(spark, ("a", "c"), ("c", "z"), ("a", "b"), ("z", "b"), ("a", "b"))
    assert [(r.source, r.target, r.edge_id) for r in traverse.shortest_path(g, "a", "z").orderBy("hop").collect()] == [("a", "b", "e2"), ("b", "z", "e3")]
    assert traverse.shortest_path(g, "a", "a").count() == 0


def test_betweenness(spark):
    score = {r.id: r.score for r in analytics.betweenness(graph(spark, ("a", "b"), ("b", "a"), ("b", "c"))).collect()}
    assert score == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_betweenness_counts_all_shortest_paths(spark):
    pairs = [(f"{i:02}", f"{j:02}") for i in range(30) for j in range(30) if i != j and (i * 7 + j * 11) % 13 == 0]
    g = graph(spark, *pairs)
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    ids = sorted(r.id for r in g.nodes.collect())
    for sources, found in ((ids, analytics.betweenness(g)), ([ids[k * len(ids) // 4] for k in range(4)], analytics.betweenness(g, exact_up_to=2, samples=4))):
        wanted = dict.fromkeys(ids, 0.0)
        for s in sources:
            ways, last = {s: [[s]]}, [s]
            while last:
                new = {}
                for v in last:
                    for w in out.get(v, []):
                        if w not in ways:
                            new.setdefault(w, []).extend([*p, w] for p in ways[v])
                ways |= new
                last = list(new)
            for t, all_ways in ways.items():
                for way in all_ways if t != s else []:
                    for v in way[1:-1]:
                        wanted[v] += len(ids) / len(sources) / len(all_ways)
        assert {r.id: round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in wanted.items()}


def test_vector_top_in_blocks_is_as_in_one(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, vector array<double>")
    asked = rows.select(rows["id"].alias("query"), "vector")
    one, many = (sorted(map(tuple, search.vector_top(rows, asked, 3, block=b).select("query", "id", "rank").collect())) for b in (1000, 8))
    assert one == many and len(one) == 180


def test_passages_in_blocks_are_as_in_one(spark):
    one, many = (sorted(map(tuple, evaluation_queries._relevant(spark, "/root/testdata/sf0.001", b).collect())) for b in (100_000, 7))
    assert one == many and one


def test_two_triangles_are_two_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "u string, v string, weight int")
    label = {r.id: r.community for r in analytics.communities(edges).collect()}
    assert label["a"] == label["b"] == label["c"] != label["d"] == label["e"] == label["f"]
    members = spark.createDataFrame(list(label.items()), "id string, community string")
    ends = spark.createDataFrame(pairs, "source string, target string")
    assert {(r.intra, r.boundary, r.cohesion) for r in analytics.community_stats(members, ends).collect()} == {(3, 1, 1.0)}


def test_components_and_cycles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (5, 5)], "u long, v long")
    root = {r.node: r.root for r in components.components(links).collect()}
    assert set(root.values()) == {1, 30} and len(root) == 22
    assert components.components(links.limit(0)).count() == 0
    cyclic = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    assert {tuple(r) for r in traverse.strong_components(cyclic).collect()} == {(x, "a", 3) for x in "abc"}


def test_health(spark):
    g = graph(spark, ("a", "b"), ("b", "a"), *[("hub", f"n{k}") for k in range(12)])
    degree = analytics.degrees(g).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    found = {tuple(r) for r in findings.health(degree, g.edges).collect()}
    assert found == {("GodClass", "hub"), ("Bridge", "hub"), ("Cycle", "a|b")}


def test_tag_expressions(spark):
    tags = spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (2, "k", "a"), (3, "r", "x")], "entity_id long, namespace string, value string")
    ids = lambda e: sorted(r.entity_id for r in findings.resolve_tags(tags, e).collect())
    assert ids("k:a") == [1, 2] and ids("k:a, !k:b; r:x") == [2, 3] and ids("k:a, k:b") == [1]
    for bad in ("!k:a", "k", "k:a; !k:b", ""):
        with pytest.raises(ValueError):
            findings.resolve_tags(tags, bad)


def test_similarity_join_finds_all_pairs(spark):
    import random

    rng = random.Random(1)
    sets = [(k, "x", sorted(rng.sample(range(25), rng.randint(1, 10)))) for k in range(80)]
    df = spark.createDataFrame([(k, p, [str(x) for x in s]) for k, p, s in sets], "id long, lang string, tokens array<string>")
    least = {}
    for k, _, s in sets:
        least.setdefault(tuple(s), k)
    distinct = [(k, set(s)) for s, k in least.items()]
    wanted = {(a, b) for a, x in distinct for b, y in distinct if a < b and len(x & y) / len(x | y) >= 0.6}
    assert {(r.id_a, r.id_b) for r in similarity.near_pairs(df).collect()} == wanted
    assert {r.id: r["class"] for r in similarity.classes_of(df).collect()} == {k: least[tuple(s)] for k, _, s in sets}


def test_text_and_path_functions(spark):
    words = ["camelCase", "XMLParser", "snake_case_name", "kebab-case-name", "dotted.module.name", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(text.identifier_tokens(F.col("w"))).collect()
    assert [r[0] for r in rows] == [["camel", "case"], ["xml", "parser"], ["snake", "case", "name"], ["kebab", "case", "name"], ["dotted", "module", "name"], []]
    files = ["src/api/users.py", "tests/test_x.py", "src/app/x_test.go", "docker/Dockerfile", "src/main.rs", "docs/a.md"]
    found = spark.createDataFrame([(f,) for f in files], "p string").select(paths.layer(F.col("p")), classify.is_test_file(F.col("p")), classify.is_auxiliary_file(F.col("p")), paths.extension(F.col("p"))).collect()
    assert [tuple(r) for r in found] == [("Api", False, False, "py"), ("Test", True, True, "py"), ("Test", False, False, "go"), ("Infra", False, False, ""), ("Unknown", False, False, "rs"), ("Unknown", False, True, "md")]
    assert spark.range(1).select(paths.resolved(F.lit("a/b/c.md"), F.lit("../d/./e.md"))).first()[0] == "a/d/e.md"
    assert spark.range(1).select(text.decay(F.lit(100), F.lit(200))).first()[0] == 1_000_000


def test_unique_and_suffix_matches(spark):
    names = spark.createDataFrame([("1", "a::b::f"), ("2", "c::f"), ("3", "a::g"), ("4", "bg")], "id string, qualified string")
    refs = spark.createDataFrame([("f",), ("b::f",), ("g",), ("a::g",), ("zz",)], "ref string")
    assert {(r.ref, r.id) for r in relational.suffix_match(refs, names, "ref", "qualified", "id").collect()} == {("b::f", "1"), ("g", "3"), ("a::g", "3")}


def test_chunks_cover_every_byte_once(spark):
    docs = [("a", "é" * 5000), ("b", "line\n" * 2000), ("c", ""), ("d", None), ("e", "x\n" * 10 + "y" * 4000 + "\nz")]
    rows = search.chunks(spark.createDataFrame(docs, "id string, text string")).collect()
    for name, body in docs:
        data, at = (body or "").encode(), 0
        for r in sorted((r for r in rows if r.id == name), key=lambda r: r.ordinal):
            assert r.start <= at < r.stop and r.stop - at <= 3000 and at - r.start <= 150 and data[r.start : r.stop].decode() == r.text
            at = r.stop
        assert at == len(data)


def test_owners(spark):
    stored = spark.createDataFrame([("k", "1", "a/x"), ("k", "2", "b"), ("m", "1", "a/y"), ("n", "1", "ab")], "key string, content string, owner string")
    new = spark.createDataFrame([("k", "3", "a/x"), ("p", "9", "a/z")], "key string, content string, owner string")
    found = {tuple(r) for r in incremental.reconcile_owners(stored, new, "a").collect()}
    assert found == {("k", "Update", True), ("m", "Delete", False), ("n", "NoOp", False), ("p", "Insert", False)}


def test_tools(spark):
    g = graph(spark, ("a", "b"), ("b", "c"), labels={"a": "Main"})
    assert {r.id for r in api.call("impact_analysis", g, "c").collect()} == {"a", "b", "c"}
    assert api.call("find_dead_code", g, "Main").count() == 1 and api.call("search_graph", g, "b").first().degree == 2
    with pytest.raises(KeyError):
        api.call("nothing", g)


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), (F.col("id") % 5).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/in")
    stream = events.windowed(events.read_events(spark, f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(spark.table("windows")) == same(events.windowed(rows))


def test_watch_reports_changes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    spark.createDataFrame([(2, "c"), (3, "d")], "id long, hash string").write.parquet(f"{tmp_path}/in")
    stream, seen = spark.readStream.schema("id long, hash string").parquet(f"{tmp_path}/in"), []
    run = events.watch(stream, lambda: old, lambda df: seen.append({tuple(r) for r in df.collect()}), "id", "hash", every="1 second", checkpoint=f"{tmp_path}/check")
    run.processAllAvailable()
    run.stop()
    assert seen == [{(1, "removed"), (2, "changed"), (3, "added")}]


def moved_by_hand(links):
    """Local moving over all nodes in one order."""
    ids = sorted({x for u, v, _ in links for x in (u, v)})
    near = {x: {} for x in ids}
    for u, v, w in links:
        near[u][v] = near[u].get(v, 0) + w
        near[v][u] = near[v].get(u, 0) + w
    degree = {x: sum(near[x].values()) for x in ids}
    total, label, active = sum(degree.values()), {x: x for x in ids}, set(ids)
    while active:
        x = min(active)
        active.remove(x)
        volume = {}
        for y in ids:
            if y != x:
                volume[label[y]] = volume.get(label[y], 0) + degree[y]
        inside = {label[x]: 0}
        for y, w in near[x].items():
            inside[label[y]] = inside.get(label[y], 0) + w
        gain = {c: w * total - degree[x] * volume.get(c, 0) for c, w in inside.items()}
        best = min(gain, key=lambda c: (-gain[c], c))
        if gain[best] > gain[label[x]]:
            label[x] = best
            active |= set(near[x])
    first = {}
    for x in ids:
        first.setdefault(label[x], x)
    return {(x, first[label[x]]) for x in ids}


def test_communities_by_local_moving(spark):
    import random

    rng = random.Random(4)
    links = {}
    for group in range(5):
        for _ in range(14):
            u, v = sorted(rng.sample(range(group * 8, group * 8 + 8), 2))
            links[f"n{u:02}", f"n{v:02}"] = rng.randint(1, 4)
    for _ in range(4):
        u, v = sorted(rng.sample(range(24), 2))
        links[f"n{u:02}", f"n{v:02}"] = 1
    links["n00", "n00"] = 2
    rows = [(u, v, w) for (u, v), w in links.items()]
    found = clusters.local_moving(spark.createDataFrame(rows, "u string, v string, weight long").repartition(3))
    assert {tuple(r) for r in found.collect()} == moved_by_hand(rows)


def test_top_kinds_count_an_edge_once(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, cluster string")
    rows = [("1", "a", "c", "Single"), ("1", "a", "c", "Single"), ("1", "a", "b", "Single"), ("2", "a", "c", "Bulk"), ("3", "b", "c", "Bulk"), ("4", "c", "nobody", "Never")]
    edges = spark.createDataFrame(rows, "id string, source string, target string, kind string")
    found = clusters.slice_insights(members, edges, spark.createDataFrame([], "id string, category string"))
    assert {r.cluster: r.top_kinds for r in found.collect()} == {"x": ["Bulk", "Single"], "y": ["Bulk", "Never"]}


def test_strong_components(spark):
    import random

    rng = random.Random(6)
    for n, m in ((12, 14), (20, 40), (15, 12)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in pairs}
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
            if more == reach:
                break
            reach = more
        wanted = set()
        for a in range(n):
            own = [b for b in range(n) if (a, b) in reach and (b, a) in reach]
            if own:
                wanted.add((a, min(own), len(own)))
        found = traverse.strong_components(spark.createDataFrame(list(pairs), "source long, target long"))
        assert {tuple(r) for r in found.collect()} == wanted


def test_stores(spark, tmp_path):
    g, path = graph(spark, ("a", "b"), ("b", "c")), f"file://{tmp_path}/graph"
    assert store.load_graph(spark, path) is None
    assert store.save_graph(g, path) and not store.save_graph(g, path)
    assert store.load_graph(spark, path).edges.count() == 2
    assert store.save_graph(PropertyGraph(g.nodes, g.edges.limit(1)), path) and store.load_graph(spark, path).edges.count() == 1
    store._move(spark, f"{path}/manifest", f"{path}/manifest.next")  # a break between the two renames
    assert store.load_graph(spark, path).edges.count() == 1
    bundle = f"file://{tmp_path}/bundle"
    store.export_bundle(g, bundle)
    assert store.import_bundle(spark, bundle).nodes.count() == 3
    g.edges.limit(1).write.mode("append").json(f"{bundle}/edges")
    with pytest.raises(store.StoreError):
        store.import_bundle(spark, bundle)
    place = f"file://{tmp_path}/doc.json"
    assert store.load_document(spark, place) is None
    assert store.save_document(spark, place, {"a": "ü", "version": 1}) and not store.save_document(spark, place, {"version": 1, "a": "ü"})
    assert store.load_document(spark, place, {1: lambda d: d | {"b": 2}}) == {"a": "ü", "b": 2, "version": 2}
    with pytest.raises(store.StoreError):
        store.load_document(spark, place, {}, 0)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [store.cached(spark, f"file://{tmp_path}/cache", "k", make)[1] for _ in range(2)] == [False, True] and made == [1]
    assert store.write_report(spark.range(2), spark, f"file://{tmp_path}/r.md", "T").splitlines()[-1] == "| 1 |"


def test_extension_points(spark):
    rows = spark.createDataFrame([("1", "alpha beta"), ("2", "")], "id string, text string")
    plain, prompted = extensions.HashedEmbedder(), extensions.HashedEmbedder(query_prompt="find")
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(plain.embed(rows)) == same(prompted.embed(rows)) != same(prompted.embed(rows, "query"))
    with pytest.raises(ValueError):
        plain.embed(rows, "other")

    class Counter:
        inputs = ("rows",)

        def compute(self, tables):
            return tables["rows"].groupBy().count()

        def validate(self, result):
            return result.where("count > 2")

    assert extensions.run_agent(Counter(), {"rows": rows}).first()["count"] == 2
    for bad in ({}, {"rows": rows.unionByName(rows)}):
        with pytest.raises(ValueError):
            extensions.run_agent(Counter(), bad)
    assert retrieval.profile_difference({"model": "a", "query_prompt": "x"}, {"model": "b", "query_prompt": "y"}) == ["model"]


def test_inputs_are_minimised():
    assert quality.minimised(list(range(40)), lambda x: {3, 17, 30} <= set(x)) == [3, 17, 30]
    assert quality.minimised([1], lambda x: True) == [1]


def test_structured_files(spark):
    made = {
        "a/Cargo.toml": '[dependencies]\nserde = "1"\ntokio = { version = "2", features = ["x"] }\n',
        "b/pyproject.toml": '[project]\ndependencies = ["Flask_Login[x]>=2; python_version>\'3\'", "requests"]\n[tool.poetry.dependencies]\nrich = "^13"\n',
        "c/docker-compose.yml": "services:\n  web:\n    image: nginx:1\n    ports: ['80:80']\n    depends_on: [db]\n  db:\n    build: .\n",
        "d/tsconfig.json": '{ // note\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["lib/*", "alt/*"],}, }, }',
        "e/pom.xml": "<project xmlns='m'><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>",
        "f/x.csproj": "<Project><ItemGroup><PackageReference Include='Newton' Version='3'/></ItemGroup></Project>",
        "g/broken.json": "{", "h/composer.json": '{"require": {"php/lib": "^2"}}', "i/empty.yml": "",
    }
    values = extract.structured(spark.createDataFrame(list(made.items()), "path string, content string").repartition(2)).cache()
    found = {tuple(r)[:4] for r in extract.manifest_packages(values).collect()}
    assert {("a/Cargo.toml", "dependencies", "serde", "1"), ("a/Cargo.toml", "dependencies", "tokio", "2"), ("b/pyproject.toml", "dependencies", "flask-login", ">=2"), ("b/pyproject.toml", "dependencies", "requests", ""), ("b/pyproject.toml", "dependencies", "rich", "^13"), ("e/pom.xml", "dependency", "g:a", "1"), ("f/x.csproj", "Include", "Newton", None), ("h/composer.json", "require", "php/lib", "^2")} == found
    assert {(r.service, r.image, r.builds, tuple(r.ports), tuple(r.depends_on)) for r in extract.compose_services(values).collect()} == {("web", "nginx:1", False, ("80:80",), ("db",)), ("db", None, True, (), ())}
    assert {(r.base_url, r.pattern, r.at, r.target) for r in extract.path_aliases(values).collect()} == {("src", "@/*", 0, "lib/*"), ("src", "@/*", 1, "alt/*")}
    assert [(r.path, r.value) for r in values.where("kind = 'Error'").collect()] == [("g/broken.json", "JSONDecodeError")]
    gradle = spark.createDataFrame([("b.gradle", "dependencies {\n  implementation 'a:b:1'\n  testImplementation(\"c:d:2\")\n}")], "path string, content string")
    assert {(r.scope, r.package) for r in extract.gradle_dependencies(gradle).collect()} == {("implementation", "a:b"), ("testImplementation", "c:d")}


def test_globs():
    import re as regex

    for glob, hits, misses in (("*.rs", ["a.rs", "d/a.rs"], ["a.rss"]), ("src/**/x?.{py,md}", ["src/x1.py", "src/a/b/x2.md"], ["src/x.py"]), ("[!a]b", ["cb"], ["ab"])):
        p = paths.glob_pattern(glob)
        assert all(regex.match(p, h) for h in hits) and not any(regex.match(p, m) for m in misses)
    for bad in ("a[b", "{a"):
        with pytest.raises(ValueError):
            paths.glob_pattern(bad)


def test_a_walk_reads_a_folder(spark, tmp_path):
    from graphloom.sources.files import read_facts, walk

    for name, body in (("src/a.rs", b"x\ny\n"), ("src/.hidden/b.rs", b"x"), ("tests/c.rs", b"x"), ("bin.dat", b"a\0b")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    digest, status, lines = read_facts(F.col("content"))
    found = walk(spark, f"file://{tmp_path}").select("path", status.alias("s"), lines.alias("n"))
    assert {tuple(r) for r in found.collect()} == {("src/a.rs", "Text", 2), ("bin.dat", "Binary", None)}


def test_circles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("z", "c"), ("z", "y"), ("y", "a"), ("c", "d"), ("d", "c")], "source string, target string")
    found = {tuple(r) for r in resolve.topological_layers(edges).collect()}
    assert found == {("z", 0), ("y", 1), ("a", 2), ("b", 2), ("c", 3), ("d", 3)}
    assert resolve.topological_layers(edges.limit(0)).count() == 0


def test_syntax_facts(spark):
    code = "import a.b as c\nfrom .x import y\n\nclass K(Base, m.Other):\n    @staticmethod\n    def run(self):\n        return helper(1)\n\ndef top():\n    def inner():\n        pass\n"
    files = [("p.py", code), ("bad.py", "def ("), ("s.graphql", "type Query {\n  user(id: ID): User # x\n}\ntype User {\n  name: String\n}\nextend type Mutation {\n  add: Int\n}"), ("m.go", 'import (\n  "net/http"\n)\nfunc (s *T) Serve() {}\ntype T struct {}')]
    df = spark.createDataFrame(files, "path string, content string")
    found = {(r.path, r.kind, r.name, r.owner, r.first, r.detail) for r in syntax.python_facts(df.where("path LIKE '%.py'")).collect()}
    assert found == {
        ("p.py", "Import", "a.b", None, 1, "c"), ("p.py", "Import", ".x:y", None, 2, None), ("p.py", "Class", "K", None, 4, "Base,m.Other"), ("p.py", "Method", "run", "K", 6, "staticmethod"),
        ("p.py", "Call", "helper", "K.run", 7, None), ("p.py", "Function", "top", None, 9, None), ("p.py", "Function", "inner", "top", 10, None), ("bad.py", "Error", "SyntaxError", None, 1, None),
    }
    edges = {(r.kind, r.source, r.target) for r in syntax.python_edges(syntax.python_facts(df.where("path = 'p.py'"))).collect()}
    assert {("Inherits", "symbol:p.py#K", "unresolved:m.Other"), ("Calls", "symbol:p.py#K.run", "unresolved:helper"), ("Contains", "symbol:p.py#K", "symbol:p.py#K.run")} <= edges
    assert {(r.type, r.field, r.line) for r in syntax.graphql_fields(df.where("path = 's.graphql'")).collect()} == {("Query", "user", 2), ("Mutation", "add", 8)}
    assert {(r.kind, r.name) for r in syntax.pattern_facts(df.where("path = 'm.go'")).collect()} == {("Import", "net/http"), ("Function", "Serve"), ("Class", "T")}


def test_decisions(spark):
    text = "# Use Spark\n\n## Status\nAccepted on a day\n\n## Context\nmuch\n## data\n"
    records = decisions.parsed(spark.createDataFrame([("adr/0001-spark.md", text), ("adr/0002.md", "no heading")], "path string, content string")).cache()
    assert {(r.id, r.title, r.status, r.sections.get("Context")) for r in records.collect()} == {("0001-spark", "Use Spark", "accepted", "much"), ("0002", "0002", "proposed", None)}
    changed = decisions.updated(records, "0002", "rejected", {"Context": "new"})
    assert {(r.status, r.sections["Context"]) for r in changed.where("id = '0002'").collect()} == {("rejected", "new")}
    assert decisions.created(records, records).count() == 2 and decisions.deleted(records, "0002").count() == 1
    with pytest.raises(ValueError):
        decisions.updated(records, "0002", "done")


def test_what_edges_name_is_looked_up_once(spark):
    nodes = spark.createDataFrame([("a", "Order", None, None), ("p", "Part", None, None), ("p", "Order", None, None)], "id string, label string, name string, path string")
    edges = spark.createDataFrame([("1", "a", "p", "Contains"), ("2", "x", "a", "Calls"), ("3", None, "y", "Contains"), ("4", "a", None, None), ("5", "a", "a", None), ("6", "a", "a", "SuppliedBy")], "id string, source string, target string, kind string")
    g = PropertyGraph(nodes, edges)
    want = [("2", "dangling_source"), ("3", "dangling_source"), ("3", "dangling_target"), ("4", "dangling_target")]
    found = g.issues()
    assert sorted((r.edge_id, r.issue) for r in found.where("issue <> 'target_label'").collect()) == want
    assert "6" in {r.edge_id for r in found.where("issue = 'target_label'").collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Path" not in plan


def test_the_last_level_of_a_path_is_not_followed(spark, monkeypatch):
    names, write = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: (names.append(name), write(df, name))[1])
    edges = [("e1", "a", "b", "K"), ("e0", "a", "c", "K"), ("e3", "b", "z", "K"), ("e2", "z", "c", "K"), ("e9", "z", "b", "K")]
    g = PropertyGraph(spark.createDataFrame([(x, "L", x, None) for x in "abcz"], "id string, label string, name string, path string"), spark.createDataFrame(edges, "id string, source string, target string, kind string"))
    assert [(r.source, r.target, r.edge_id) for r in traverse.shortest_path(g, "a", "z").orderBy("hop").collect()] == [("a", "b", "e1"), ("b", "z", "e3")]
    assert "near" in names and names.count("trails") == 4


def test_members_of_communities_are_made_once(spark, monkeypatch):
    names, write = [], analytics.written
    monkeypatch.setattr(analytics, "written", lambda df, name: (names.append(name), write(df, name))[1])
    members = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, community string")
    assert analytics.community_stats(members, spark.createDataFrame([("a", "b")], "source string, target string")).first().intra == 1
    assert names == ["members"]


def test_digests_take_no_few_tasks(spark):
    from graphloom.plans import retrieval_queries

    text = open(retrieval_queries.__file__).read()
    assert not __import__("re").search(r"repartition\(\d", text)
