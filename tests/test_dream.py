"""The synthesis pass, and the driver's small sources."""

import json

from docloom.plans.dream import dream, fold_tree
from docloom.sources import extras

SCHEMA = "path string, folder string, okf_type string, title string, tags array<string>, sources array<string>, identifiers map<string,array<string>>, body string"


def rows(b="Body B"):
    make = lambda p, ids, body: (p, p.split("/")[0], "FolderSummary", p, ["t"], [f"{p}.pdf"], ids, body)
    return [make("a/a.md", {"k": ["999888777"]}, "Intro\n\n## One\n\nx"), make("b/b.md", {"n": ["999888777"]}, b), make("c/c.md", {}, "Body C"), make("handbuch/h.md", {"k": ["999888777"]}, "Manual")]


def counting(path, answer):
    def model(text):
        with open(path, "a") as f:
            f.write("x")
        return answer

    return model


def n_calls(path):
    return len(path.read_text()) if path.exists() else 0


def test_dream(spark, tmp_path):
    scans, dives = tmp_path / "scans", tmp_path / "dives"
    models = {"synthesize": counting(str(scans), "## Matters\n\nold\n\n## Patterns\n\np"), "dive": counting(str(dives), "### Matter\nsame contract\n### Conflicts\nnone\n### Actions\npay")}
    calls = lambda: (n_calls(scans), n_calls(dives))
    tree = lambda *b: spark.createDataFrame(rows(*b), SCHEMA)
    first = dream(tree(), **models)
    got = first.matters.collect()
    assert [(r.group_key, r.slug, r.n_members, r.members) for r in got] == [("a/a.md", "matter-999888777", 2, ["a/a.md", "b/b.md"])]
    assert calls() == (1, 1) and "## Patterns\n\np" in first.synthesis and "same contract" in first.synthesis
    for known in (first.matters, None):  # an unchanged tree makes no call, whatever is known of its matters
        again = dream(tree(), known_hash=first.source_hash, known_matters=known, **models)
        assert again.synthesis is None and calls() == (1, 1)
    moved = dream(tree("Body B2"), known_hash=first.source_hash, known_matters=first.matters, **models)
    assert moved.synthesis is not None and moved.matters.collect()[0].source_hash != got[0].source_hash and calls() == (2, 2)
    dream(spark.createDataFrame([*rows(), ("d/d.md", "d", "FolderSummary", "d", [], ["d.pdf"], {}, "Body D")], SCHEMA), known_hash=first.source_hash, known_matters=first.matters, **models)
    assert calls() == (3, 2)  # the matter's members are as they were
    assert dream(tree(), budget=60, **models).synthesis and n_calls(scans) == 3 + 4  # three batches and one over the replies
    assert dream(spark.createDataFrame([], SCHEMA), **models).synthesis == ""


def test_fold_keeps_order_and_ends(spark):
    texts = spark.createDataFrame([(f"{i:04}", f"t{i:04}") for i in range(3000)], "k string, t string").repartition(7)
    joined = fold_tree(texts, "k", "t", lambda s: "".join(x[-5:] for x in s.split("\n\n")[-1:]), 700)
    assert joined == "t2999"
    assert fold_tree(texts.limit(0), "k", "t", str) == ""


def test_dream_writes_a_tree(spark, tmp_path, capsys):
    from docloom.__main__ import dashboard_page, validate_tree
    from docloom.plans import dream as plan
    from docloom.plans import ingest

    root = tmp_path / "docs"
    for name in ("a", "b", "c"):
        (root / name).mkdir(parents=True)
        (root / name / "doc.txt").write_text(f"Brief {name}\n\n" + ("Kundennummer: 99988877\n" if name != "c" else "") + "Ein Absatz mit Inhalt, der lang genug ist, um zu bestehen. " * 3)
    ingest.run(spark, str(root))
    done, counts = plan.run(spark, str(root), now="2024-01-01")
    assert counts["synthesis"] == 1 and counts["matters"] == 1 and counts["readme"] == 1
    page = next((root / "matters").glob("*.md")).read_text()
    assert "type: 'Matter'" in page and "(../a/a.md)" in page and "(../b/b.md)" in page
    readme = (root / "README.md").read_text()
    assert "(a/a.md)" in readme and "| Folder aggregates | 3 |" in readme and "synthesis.md" in readme
    again, counts = plan.run(spark, str(root), now="2024-01-01")
    assert again.synthesis is None and counts["readme"] == 0
    (root / "README.md").write_text("mine")
    (root / "b/doc.txt").write_text("Brief b\n\n" + "Ganz anderer Inhalt, der lang genug ist, um zu bestehen. " * 3)
    ingest.run(spark, str(root))
    _, counts = plan.run(spark, str(root))
    assert (root / "README.md").read_text() == "mine" and counts["deleted"] == 1 and not list((root / "matters").glob("*.md"))
    assert validate_tree(spark, str(root)) == 0
    page = (root / "a/a.md").read_text()
    (root / "a/a.md").write_text(page.replace("99988877", "00000000"))
    assert validate_tree(spark, str(root)) == 1 and "identifiers: missing: Kundennummer=99988877" in capsys.readouterr().out
    (root / "a/a.md").write_text(page)
    assert dashboard_page(spark, str(root), str(tmp_path / "page.html")) == 0
    assert (tmp_path / "page.html").read_text().count("<details>") == 5


def test_extras(spark, tmp_path):
    assert extras.commits(spark, str(tmp_path)).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"evals": [{"id": 1, "prompt": "p" * 200, "expectations": ["a", "b"]}, {"id": 2, "prompt": "q"}]}))
    assert [(r.eval_id, len(r.prompt), r.n_expectations) for r in extras.evaluations(spark, str(tmp_path / "e.json")).collect()] == [("1", 140, 2), ("2", 1, 0)]
    (tmp_path / "b.json").write_text(json.dumps({"runs": [{"eval_id": "1", "configuration": "with", "result": {"pass_rate": 0.9}}]}))
    assert extras.evaluation_runs(spark, extras.newest_file(str(tmp_path / "b*.json"))).collect()[0].pass_rate == 0.9
    assert extras.prompt(str(tmp_path), "none.md", "built in") == "built in"
