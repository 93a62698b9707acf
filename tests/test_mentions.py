"""Inline tokens and what they name against plain Python."""

import random

from graphloom.operators import mentions


def tokens_of(text):
    data, out = text.encode(), []
    ticks = [i for i, b in enumerate(data) if b == 0x60]
    for a, b in zip(ticks[::2], ticks[1::2]):
        token = data[a + 1 : b]
        if token and b"\n" not in token:
            out.append((token.decode(), b"service" in data[max(0, a - 15) : b + 15].lower()))
    return out


def test_inline_tokens(spark):
    rng = random.Random(4)
    bits = ["`", "`", "``", "service", "Service ", "é", "日本", " ", "x", "\n", "some longer words here ", "a" * 20, "ser", "vice"]
    texts = {f"p{k}": "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for k in range(120)} | {"empty": "", "none": None}
    found = {}
    for r in mentions.inline_tokens(spark.createDataFrame(list(texts.items()), "path string, content string")).orderBy("at").collect():
        found.setdefault(r.path, []).append((r.token, r.near))
    assert found == {p: t for p, x in texts.items() if x and (t := tokens_of(x))}


def test_targets_and_commands(spark):
    files = [("justfile", "set x := 1\nbuild a:\n  no:\nrun:\nv := 2\n# c:\nlint: build"), ("a/Makefile", "all: x\n\tcc y:z\n.PHONY: all"), ("package.json", '{"scripts": {"dev": "x", "a-b": ""}}'), ("b/package.json", "broken"), ("c/package.json", None)]
    targets = mentions.runner_targets(spark.createDataFrame(files, "path string, content string"))
    assert {tuple(r) for r in targets.collect()} == {("just", "run"), ("just", "v"), ("just", "lint"), ("make", "all"), ("make", ".PHONY"), ("npm", "dev"), ("npm", "a-b")}
    commands = [("d", k, c) for k, c in enumerate(("just run", "just build", "make all", "make", "npm run dev", "yarn run no", "npm install", "cargo test", "  pnpm   run  a-b x"))]
    stale = mentions.stale_commands(spark.createDataFrame(commands, "path string, line long, command string"), targets)
    assert {(r.line, r.program, r.target) for r in stale.collect()} == {(1, "just", "build"), (5, "npm", "no")}


def test_unmentioned(spark):
    from graphloom.operators.findings import unmentioned

    names = ["a", "Ab", "xyz", "a b c", "GET /api/users/list", "/é", "", "zz/long/word/here", "é", "q"]
    lines = ["xx ab yy", "get /API/users/list more", "A B c", "", "zz/long/wordy/here", "/É"]
    found = unmentioned(spark.createDataFrame([(n,) for n in names], "name string"), "name", spark.createDataFrame([(x,) for x in lines], "text string"))
    assert {r.name for r in found.collect()} == {n for n in names if not any(n.lower() in x.lower() for x in lines)}
    assert unmentioned(spark.createDataFrame([("",), ("a",)], "name string"), "name", spark.createDataFrame([], "text string")).count() == 2
