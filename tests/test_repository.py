"""A folder as a graph, through the command line."""

from graphloom import repository
from graphloom.api import main
from graphloom.store import load_graph


def test_a_repository_by_the_command_line(spark, tmp_path, capsys):
    repo, store = tmp_path / "repo", f"file://{tmp_path}/store"
    files = {
        "docs/guide.md": "# Guide\nSee [it](../deploy/Dockerfile) and [gone](none.md).\n```sh\nmake all\n```\n", "deploy/Dockerfile": "FROM rust:1\nENV A=1\n", "Cargo.toml": '[package]\nname = "p"\n[dependencies]\nserde = "1"\n',
        "stack/compose.yml": "services:\n  web:\n    image: w:1\n    depends_on: [db]\n", "logo.png": "\0\1", "id_rsa": "secret", "tests/test_x.py": "import os",
    }
    for path, text in files.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    assert main(["inspect", store]) == 1 and "nothing is stored" in capsys.readouterr().out
    assert main(["init", f"file://{repo}", store]) == 0 and capsys.readouterr().out == "stored\n"
    assert main(["update", f"file://{repo}", store]) == 0 and capsys.readouterr().out == "nothing has changed\n"
    graph = load_graph(spark, f"{store}/graph")
    assert graph.issues().where("issue <> 'target_label'").count() == 0
    nodes = {r.id: r.label for r in graph.nodes.collect()}
    assert nodes["artifact:deploy/Dockerfile"] == "Artifact" and nodes["image:rust:1"] == "Container" and nodes["unresolved:db"] == "Unresolved" and nodes["package:p"] == "Package"
    assert "artifact:tests/test_x.py" not in nodes and "artifact:id_rsa" in nodes and not [n for n in nodes if "secret" in n]
    edges = {(r.source, r.target, r.kind) for r in graph.edges.collect()}
    assert ("artifact:docs/guide.md", "artifact:deploy/Dockerfile", "References") in edges and ("package:p", "package:serde", "DependsOnPackage") in edges
    assert main(["inspect", store]) == 0 and "nodes Artifact 6" in capsys.readouterr().out
    (repo / "docs/guide.md").unlink()
    (repo / "new.md").write_text("# New")
    (repo / "Cargo.toml").write_text("[package]")
    assert main(["watch", f"file://{repo}", store]) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["changed Cargo.toml", "removed docs/guide.md", "added new.md"]
    assert main(["export", store, f"file://{tmp_path}/bundle"]) == 0 and main(["import", f"file://{tmp_path}/bundle", f"file://{tmp_path}/other"]) == 0
    assert load_graph(spark, f"file://{tmp_path}/other/graph").nodes.count() == len(nodes)
    assert main(["report", store, f"file://{tmp_path}/report.md"]) == 0 and "| nodes | Artifact | 6 |" in (tmp_path / "report.md").read_text()
    assert main(["query", "none", "x"]) == 1
    assert repository.repository_graph(spark.createDataFrame([], "path string, analyzer string, content string")).nodes.count() == 0
