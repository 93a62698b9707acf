"""Positions, labels and ignore rules against plain Python."""

import math
import random
import re
import subprocess

import pytest

from graphloom.operators import ignore, labels, positions


def test_text_positions(spark):
    rng = random.Random(1)
    texts = {k: "".join(rng.choice(("a", "é", "日", "\r\n", "\n", " B", "🙂", "x" * 50)) for _ in range(rng.randint(0, 60))) for k in range(30)}
    texts |= {100: "", 101: "\n", 102: "é" * 5000 + "\r\n" + "y" * 9000, 103: "one\rtwo"}
    offsets, wanted = [(999, 0), (100, -1), (100, 1)], set()
    for k, text in texts.items():
        at = 0
        for i in range(len(text) + 1):
            if i % (1 if len(text) < 500 else 97) == 0 or i == len(text):
                offsets.append((k, at))
                head = text[:i]
                line = head.split("\n")[-1]
                wanted.add((k, at, head.count("\n") + 1, len(line.replace("\r", "")) + 1))
            at += len(text[i : i + 1].encode())
    offsets.append((102, 1))
    wanted.add((102, 1, 1, None))
    frame = spark.createDataFrame([*texts.items(), (None, "x"), (7777, None)], "id long, text string")
    found = positions.text_positions(frame, spark.createDataFrame(offsets, "id long, offset long")).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    pattern = r"[A-Zé]\w*"
    got = {tuple(r) for r in positions.match_offsets(frame, pattern).collect() if r.id is not None}
    assert got == {(k, m.group(), len(t[: m.start()].encode())) for k, t in texts.items() for m in re.finditer(pattern, t, re.ASCII)}


@pytest.mark.parametrize("limit", [None, 7])
def test_labels(spark, limit):
    rng = random.Random(2)
    rows = [(f"n{k}", rng.randint(0, 9), float(rng.randint(0, 60)), float(rng.randint(0, 60)), k in (5, 6)) for k in range(400)]
    rows += [(f"t{k}", 3, 10.0, 10.0, False) for k in range(50)] + [("none", 5, None, 1.0, False), (None, 5, 1.0, 1.0, False), ("zero", None, 59.0, 1.0, False)]
    kept = []
    for i, _, x, z, chosen in sorted((r for r in rows if r[0] and r[2] is not None), key=lambda r: (not r[4], -(r[1] or 0), r[0])):
        if chosen or all(math.sqrt((x - a) ** 2 + (z - b) ** 2) >= 7 for _, a, b in kept):
            kept.append((i, x, z))
    found = labels.labelled(spark.createDataFrame(rows, "id string, priority int, x double, z double, selected boolean"), 7.0, limit)
    if limit is None:
        assert {r.id for r in found.collect()} == {i for i, _, _ in kept}
    else:
        assert [(r.id, r.place) for r in sorted(found.collect(), key=lambda r: r.place)] == [(i, k + 1) for k, (i, _, _) in enumerate(kept[:limit])]
    assert labels.labelled(found.selectExpr("id", "1 AS priority", "0D AS x", "0D AS z").limit(0), 1.0).count() == 0


RULES = {
    "": "# top\n*.log\n!keep.log\n/build/\ndocs/*.txt\n**/cache/**\nfoo/**/bar\n\\#odd\n[ab]?.tmp\n*.[!c]\nspace \\ \n  \n",
    "src": "*.gen\n!/a.gen\nout/\nsub/x.log\n",
    "src/sub": "!*.log\nx.log\n",
    "vendor": "*\n!/ok.c\n",
}
PATHS = """a.log keep.log src/keep.log build/x.c src/build/x.c docs/a.txt docs/b/a.txt x/cache/y/z.c cache/q.c foo/c/bar foo/a/b/bar foo/bar/x.c #odd a1.tmp c1.tmp ab.tmp x.d x.c src/a.gen src/b.gen
src/sub/a.gen src/out/x.c src/out2/x.c src/sub/x.log src/sub/y.log src/sub/out/y.log vendor/ok.c vendor/no.c vendor/d/ok.c out/x.c a/b/c.log notes.txt""".split()


def test_ignored_as_git_does(spark, tmp_path):
    for folder, text in RULES.items():
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / ".gitignore").write_text(text)
    for path in PATHS:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        if not (tmp_path / path).is_dir():
            (tmp_path / path).write_text("x")
    files = [p for p in PATHS if (tmp_path / p).is_file()]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    out = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(files), capture_output=True, text=True).stdout
    wanted = set(out.split("\n")) - {""}
    rules = ignore.ignore_rules(spark.createDataFrame([(f"{f}/.gitignore" if f else ".gitignore", t) for f, t in RULES.items()] + [("x.gitignore", "*"), ("n/.gitignore", None)], "path string, content string"))
    found = {r.path: r.ignored for r in ignore.ignored(spark.createDataFrame([(p,) for p in [*files, None]], "path string"), rules).collect()}
    assert found == {p: p in wanted for p in files}
    assert ignore.ignored(spark.createDataFrame([("a",)], "path string"), rules.limit(0)).collect()[0].ignored is False


def test_walk_with_ignore_files(spark, tmp_path):
    from graphloom.sources.files import walk

    for path in ("src/a.rs", "src/b.gen", "out/c.rs", "d.log"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    rules = spark.createDataFrame([(".gitignore", "/out/\n*.log"), ("src/.gitignore", "*.gen")], "path string, content string")
    assert {r.path for r in walk(spark, f"file://{tmp_path}", ignores=rules).collect()} == {"src/a.rs"}
