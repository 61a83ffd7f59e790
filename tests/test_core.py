"""Truth tables and invariants of the core operators."""

import datetime as dt
import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import gating, render, text
from docloom.operators import chunking, digests, folders, incremental, merging, search, tokens, validation
from docloom.plans import config
from docloom.sources import files, okf


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_gates(spark):
    paths = ["router-handbuch.pdf", "a/AGB_2024.pdf", "photos/x.txt", "archive/x.pdf", "wichtig/handbuch.pdf", "contract.txt", ".git/x.txt", "a/.x.txt", "index.md"]
    gates = gating.Gates(exclude=("archive/*", "*.md"), priority=("*wichtig*",))
    p = F.col("p")
    got = values(spark, [(x,) for x in paths], "p string", "p", gating.matches_any(p, gates.exclude), gating.is_deprioritized(p, gates), gating.is_hidden(p), gating.is_supported(p))
    assert got == [
        ("router-handbuch.pdf", False, True, False, True), ("a/AGB_2024.pdf", False, True, False, True), ("photos/x.txt", False, True, False, True), ("archive/x.pdf", True, False, False, True),
        ("wichtig/handbuch.pdf", False, False, False, True), ("contract.txt", False, False, False, True), (".git/x.txt", False, False, True, True), ("a/.x.txt", False, False, True, True), ("index.md", True, False, False, False),
    ]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_the_text(t, size, overlap):
    bounds = list(chunking.chunk_bounds(t, size, overlap))
    assert all(b - a <= size for a, b in bounds)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(t)
    assert all(a < a2 <= b <= b2 for (a, b), (a2, b2) in zip(bounds, bounds[1:]))


def test_chunks(spark):
    long = "x" * 500
    rows = [(1, long), (2, ""), (3, None), (4, "A" * 80 + "\n\n" + "B" * 80)]
    got = chunking.chunks(spark.createDataFrame(rows, "k int, t string"), "k", "t", 200, 50).orderBy("k", "chunk_no").collect()
    ones = [r.chunk for r in got if r.k == 1]
    assert len(ones) == 3 and ones[0][-50:] == ones[1][:50]
    assert [(r.k, r.n_chunks, r.chunk) for r in got if r.k in (2, 3)] == [(2, 1, "")]
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame(rows, "k int, t string"), "k", "t", 100, 100)


def test_tokens(spark):
    t = "Vertrag 999888777, Zähler 1ABC0012345678, Az. 1122334455, kurz 1234, Jahr 2023"
    ((five, four),) = values(spark, [(t,)], "t string", tokens.reference_tokens(F.col("t")), tokens.reference_tokens(F.col("t"), 4))
    assert {"999888777", "1122334455", "1ABC0012345678"} <= set(five) and "1234" not in five
    assert "1234" in four and "2023" not in four


def test_matters(spark):
    rows = [("a", "111111"), ("b", "111111"), ("b", "222222"), ("c", "222222"), ("d", "333333"), ("e", "444444"), ("f", "444444")]
    got = {r.group_key: (r.n_members, r.n_tokens, r.slug) for r in tokens.matters(spark.createDataFrame(rows, "path string, token string"), "path").collect()}
    assert got == {"a": (3, 2, "matter-111111-222222"), "e": (2, 1, "matter-444444")}


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(a, a + r.randint(1, 3)) for a in range(0, 120) if r.random() < 0.6]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.key: x.label for x in tokens.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_identifiers(spark):
    t = "Kundennummer: 1383617673 (SWK Bank)\nVersicherungsnummer 13040393 S 105 steht hier\nRVNR 13040393S105, Steuer 12345678901"
    got = {(r.label, r.value) for r in tokens.labelled_identifiers(spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string"), "k", "t").collect()}
    assert got == {("Kundennummer", "1383617673"), ("Versicherungsnummer", "13040393 S 105"), ("Steuer-ID", "12345678901")}


def test_merging(spark):
    rows = [(1, 2, "Invoice 42", ["b", "a"], "two"), (1, 1, None, ["a"], "one"), (1, 3, "x", None, " ")]
    df = merging.merge_parts(spark.createDataFrame(rows, "k int, o int, title string, tags array<string>, body string"), "k", "o", {"title": "first", "tags": "tags", "body": "body"})
    assert df.collect()[0].asDict() == {"k": 1, "title": "Invoice 42", "tags": ["a", "b"], "body": "one\n\ntwo"}
    maps = [(1, {"p": ["2", "1"], "e": [""]}), (1, {"p": ["1"], "b": ["9"]}), (1, None)]
    assert merging.identifier_union(spark.createDataFrame(maps, "k int, m map<string,array<string>>"), "k", "m").collect()[0].identifiers == {"b": ["9"], "p": ["1", "2"]}


def test_validation(spark):
    block = "Der Betrag von 100 Euro wurde am 1. Mai bezahlt und verbucht."
    rows = [
        (1, "a/a.md", "FolderSummary", [], "text", None),
        (2, "b/b.md", "FolderSummary", ["b/x.pdf", "b/y.pdf"], "## X\n\n_Source: x.pdf_\n\n" + "long text " * 30, None),
        (3, "c/c.md", "FolderSummary", ["c/x.pdf"], "_Source: x.pdf_\n\ntype: Fact\n\ntitle: ...\nsource: path/to/x\n\n" + "\n\n".join([block, block.replace("1", "2"), block.replace("1", "3")]) + "\n\nHere is the output", None),
        (4, "d.md", "Matter", ["e/e.md"], "nothing", None),
        (5, "e.md", "Fact", [], "", None),
        (6, "f.md", "FolderSummary", None, None, None),
    ]
    found = validation.findings(spark.createDataFrame(rows, "concept_id int, path string, okf_type string, sources array<string>, body string, check_id string").drop("check_id"))
    failed = {(r.concept_id, r.check_id): r.evidence for r in found.where("not passed").collect()}
    assert set(failed) == {(1, "sources"), (2, "citations"), (3, "leak"), (3, "placeholder"), (3, "repeats"), (3, "meta"), (4, "citations"), (4, "density"), (6, "sources")}
    assert failed[2, "citations"] == "b/y.pdf" and failed[3, "placeholder"] == "source, title"
    sums = {r.concept_id: (r.n_checks, r.n_failed) for r in validation.report(found).collect()}
    assert sums == {1: (6, 1), 2: (7, 1), 3: (7, 4), 4: (7, 2), 6: (6, 1)}


def test_lost_identifiers(spark):
    aggregates = spark.createDataFrame([("a", ["t1", "t2"], "hat 13040393 S 105"), ("b", ["none"], "")], "path string, sources array<string>, body string")
    transcripts = spark.createDataFrame([("t1", "Versicherungsnummer: 13040393S105"), ("t2", "Kundennummer: 77665544")], "rel_path string, text string")
    assert [(r.path, r.value) for r in validation.lost_identifiers(aggregates, transcripts).collect()] == [("a", "77665544")]


def test_digest_and_batches(spark):
    schema = "path string, title string, tags array<string>, sources array<string>, identifiers map<string,array<string>>, body string"
    row = ("p.md", "T", ["x"], [], {"b": ["1", "2"], "a": ["3"]}, "Intro.\n\n## One\n\n_Source: f_\n\nsecret")
    ((got,),) = values(spark, [row], schema, digests.digest(*map(F.col, ("path", "title", "tags", "sources", "identifiers", "body"))))
    assert got == "### Aggregate: p.md\nTitle: T\nTags: x\nIdentifiers: a: 3; b: 1, 2\nSummary: Intro.\nSections:\n  ## One\n  _Source: f_"
    assert digests.batch_numbers([40, 40, 40], 100) == [1, 1, 2]
    calls = []
    digests.fold(iter(["a" * 40, "b" * 40]), 50, lambda p: calls.append(p) or "r")
    assert len(calls) == 3


def test_splice(spark):
    base = "## Matters\n\nold\n\n## Patterns\n\np\n\n## Open actions\n\nact"
    arrays = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    ((a, b, c),) = values(
        spark, [(base,)], "t string", digests.splice(F.col("t"), arrays("m1", "m2"), arrays("none", "c1"), arrays("more")), digests.splice(F.col("t"), arrays(), arrays(), arrays()), digests.splice(F.lit("no sections"), arrays("m"), arrays(), arrays())
    )
    assert a == "## Matters\n\nm1\n\nm2\n\n## Conflicts\n\nc1\n\n## Patterns\n\np\n\n## Open actions\n\nact\n\nmore"
    assert b == base and c == "no sections"


def test_verdicts_titles_and_hosts(spark):
    rows = [("OK",), ("FLAGGED: made up",), ("flagged - x",), ("  FLAGGED",), ("fine",)]
    assert values(spark, rows, "r string", text.verdict_passed(F.col("r")), text.verdict_reason(F.col("r"))) == [(True, ""), (False, "made up"), (False, "x"), (False, ""), (True, "")]
    assert values(spark, [("a/birth_record.pdf", "")], "p string, t string", text.default_title(F.col("t"), F.col("p")))[0][0] == "Birth Record"
    hosts = [("localhost",), ("http://192.168.1.10:1234/v1",), ("api.example.com",), ("127.0.0.1:80",)]
    assert [x[0] for x in values(spark, hosts, "h string", text.is_local_host(F.col("h")))] == [True, True, False, True]


def test_rollup(spark):
    tree = folders.folder_tree(spark.createDataFrame([("h/2026/b",), ("h",), ("",), (".x/y",), (None,)], "folder string"), "folder")
    assert {r.folder: (r.parent, r.depth) for r in tree.collect()} == {"h": ("", 1), "h/2026": ("h", 2), "h/2026/b": ("h/2026", 3)}
    links = folders.rollup_links(tree, spark.createDataFrame([("h/2026", "Year")], "folder string, description string"))
    assert {r.folder: r.links for r in links.collect()} == {"h": "- [2026](2026/2026.md) — Year", "h/2026": "- [b](b/b.md) — b"}
    once = folders.with_rollup(F.col("b"), F.lit("- x"))
    ((a, b),) = values(spark, [("Intro\n\n## A\n\ntext",)], "b string", once, folders.with_rollup(once, F.lit("- x")))
    assert a == b == "Intro\n\n## A\n\ntext\n\n## Subfolders\n\n- x"


def test_grep_context(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(10))), (2, None), (3, "")], "k int, t string")
    got = search.hits_in_context(df, "k", "t", "L5", 1).collect()
    assert [(r.line_no, r.line, r.is_hit) for r in got] == [(5, "l4", False), (6, "l5", True), (7, "l6", False)]


T0 = dt.datetime(2025, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


FILES = "rel_path string, bundle string, folder string, name string, suffix string, size_bytes bigint, sha256 string, scanned_at timestamp, loaded_at timestamp, path string"
CONCEPTS = "concept_id bigint, folder string, okf_type string, stamped_at timestamp, loaded_at timestamp, run_id string, sources array<string>, source_hashes map<string,string>"
RUNS = "run_id string, attempt int, started_at timestamp, finished_at timestamp, status string"


def scan(path, sha, n, loaded=None):
    folder, _, name = path.rpartition("/")
    return (path, "b", folder, name, "", 1, sha, day(n), day(loaded if loaded is not None else n), "clash")


def test_pending_files(spark):
    scans = [
        scan("f/a.txt", "AA", 1), scan("f/a.txt", "AA", 1), scan("f/b.txt", "old", 1), scan("f/b.txt", "sha256:NEW", 5), scan("f/b.txt", None, 6), scan("./f/c.txt".replace("./", ""), "cc", 1),
        scan("f/d.txt", "dd", 9, 1), scan("f/d.txt", "d0", 2, 10), scan("g/x.txt", "xx", 1), scan("f/e.txt", "ee", 1), scan(None or "h/n.txt", None, 1),
    ]
    concepts = [
        (1, "f", "FolderSummary", day(3), day(3), "r1", ["f\\a.txt", "./f/b.txt", "f/d.txt", "f/e.txt"], {"a.txt": "sha256:aa", "b.txt": "old", "d.txt": "DD"}),
        (2, "f", "FolderSummary", day(7), day(7), "r2", ["f/a.txt", "f/b.txt", "f/c.txt"], {"b.txt": "new", "c.txt": "cc"}),  # failed run
        (3, "g", "FolderSummary", day(7), day(7), "r9", ["g/x.txt"], {"x.txt": "xx"}),  # no such run
        (4, "f", "FolderSummary", None, day(9), "r1", [], {}),
    ]
    runs = [("r1", 1, day(2), day(2), "failed"), ("r1", 2, day(3), day(4), "success"), ("r2", 1, day(7), None, "failed"), ("r3", 1, day(0), None, "running")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {(r.rel_path, r.change) for r in incremental.pending_files(make(scans, FILES), make(concepts, CONCEPTS), make(runs, RUNS)).collect()}
    assert got == {("f/b.txt", "changed"), ("f/c.txt", "new"), ("g/x.txt", "new"), ("f/e.txt", "changed")}
    empty = incremental.pending_files(make(scans, FILES), make([], CONCEPTS), make([], RUNS))
    assert {r.change for r in empty.collect()} == {"new"}
    assert incremental.pending_files(make([], FILES), make(concepts, CONCEPTS), make(runs, RUNS)).count() == 0


def test_kept_state_reads_only_what_was_loaded_since(spark, tmp_path):
    """Against a run over everything, with late scans, failed runs and a transaction that was open for long; what was loaded before the bound is not read again."""
    import random

    r = random.Random(4)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    files, kept, concepts, runs = str(tmp_path / "files"), str(tmp_path / "kept"), [], []
    for step in range(4):
        now = 10 * (step + 1)
        late = [scan(f"f{r.randint(0, 3)}/{r.randint(0, 30)}.txt", r.choice(["AA", "bb", "sha256:cc", None]), r.randint(max(0, now - 15), now), r.randint(now - 9, now)) for _ in range(60)]
        make(late, FILES).coalesce(1).write.parquet(f"{files}/part={step}")
        if step == 2:  # written by the transaction that was open at the run before
            make([scan("f1/slow.txt", "dd", 11, 14)], FILES).coalesce(1).write.parquet(f"{files}/part=9")
        table = spark.read.schema(FILES).parquet(*[f"{files}/{p}" for p in sorted(p.name for p in (tmp_path / "files").iterdir() if p.name.startswith("part="))])
        args = make(concepts, CONCEPTS), make(runs, RUNS)
        want = {(x.rel_path, x.version, x.change) for x in incremental.pending_files(table, *args).collect()}
        done = incremental.pending_since(table, *args, kept)
        assert {(x.rel_path, x.version, x.change) for x in done.pending.collect()} == want and want
        if step in (1, 3):
            plan = done.known._jdf.queryExecution().toString()
            assert "loaded_at,2025" in plan.split("PushedFilters", 1)[1].replace("GreaterThanOrEqual(", "") if runs else True
        # The work of this run; f3 fails.
        status = "failed" if step == 1 else "success"
        newest = {(x.folder, x.rel_path): x for x in done.known.collect()}
        for f in ("f0", "f1", "f2"):
            own = [x for (folder, _), x in newest.items() if folder == f]
            concepts.append((len(concepts), f, "FolderSummary", day(now), day(now), f"r{step}", [x.rel_path for x in own], {x.name: x.version for x in own}))
        runs.append((f"r{step}", 1, day(now), day(now) if status == "success" else None, status))
        if step == 1:
            runs.append(("slow", 1, day(13), day(31), "success"))
        done = incremental.pending_since(table, make(concepts, CONCEPTS), make(runs, RUNS), kept)
        incremental.keep(done, kept)
    # What lies before the bound of the last run may be gone: it is known.
    bound = spark.read.parquet(f"{kept}/bound/{(tmp_path / 'kept/bound/.current').read_text()}").first()["bound"]
    later = table.where(F.col("loaded_at") >= F.lit(bound).cast("timestamp"))
    args = make(concepts, CONCEPTS), make(runs, RUNS)
    assert later.count() < table.count()
    assert {tuple(x) for x in incremental.pending_since(later, *args, kept).pending.collect()} == {tuple(x) for x in incremental.pending_since(table, *args, kept).pending.collect()}


def test_yaml_round_trip(spark):
    rows = [("Fact", "It's: [odd]", ["a", "b"], {"f.pdf": "12"}, {"nr": ["0123", "x"]}, "Body\n\n---\n\ntext")]
    df = spark.createDataFrame(rows, "type string, title string, tags array<string>, hashes map<string,string>, ids map<string,array<string>>, body string")
    fields = {"type": F.col("type"), "title": F.col("title"), "list:tags": F.col("tags"), "map:source_hashes": F.col("hashes"), "lists:identifiers": F.col("ids")}
    back = okf.parse_documents(df.select(F.lit(1).alias("k"), okf.render_document(fields, F.col("body")).alias("c")), "k", "c").collect()[0]
    assert (back.type, back.title, back.tags, back.source_hashes, back.identifiers, back.body) == rows[0]
    for bad in ("plain text", "---\ntitle: Broken: [unclosed\n---\n\nx", "---\nno colon here\n---\nx"):
        assert okf.parse_document(bad) == {"type": "Unknown", "body": bad}


def docx(paragraph, cells):
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p(paragraph)}<w:tbl><w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def test_readers_and_ingest(spark, tmp_path):
    from docloom.plans.ingest import ingest

    root = tmp_path / "docs"
    for name, content in {
        "a/contract.txt": b"Vertrag\nKundennummer: 1234567\n", "a/table.csv": b"name,value\nfoo,1\n", "b/mail.eml": b"From: a@x\nTo: b@x\nSubject: S\nDate: D\n\nHello", "b/locked.docx": bytes.fromhex("D0CF11E0") + b"0" * 99,
        "b/doc.docx": docx("Hi", ["Invoice", "42"]), "b/pic.png": b"\x89PNG", ".git/x.txt": b"no", "b/empty.txt": b" ",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    first = ingest(spark, str(root))
    texts = {r.rel_path: r.text for r in first.transcripts.collect()}
    assert texts["b/doc.docx"] == "Hi\nInvoice | 42" and texts["b/mail.eml"] == "From: a@x\nTo: b@x\nSubject: S\nDate: D\n\nHello" and texts["a/table.csv"].startswith("name,value")
    assert {r.rel_path: r.reason for r in first.skipped.collect()} == {"b/locked.docx": "encrypted", "b/pic.png": "no reader for .png", "b/empty.txt": "empty"}
    assert {r.folder: r.n_sections for r in first.aggregates.collect()} == {"a": 2, "b": 2} and first.n_derived == 4
    assert ingest(spark, str(root), state=first.state).n_derived == 0
    (root / "a/contract.txt").write_bytes(b"Vertrag neu\nKundennummer: 7654321\n")

    def failing(chunk, context):
        raise RuntimeError("down")

    failed = ingest(spark, str(root), state=first.state, extractor=failing)
    old = {r.rel_path: r.sha256 for r in first.state.collect()}
    assert {r.rel_path: r.sha256 for r in failed.state.collect()} == old  # tried again next time
    again = ingest(spark, str(root), state=failed.state)
    assert again.n_derived == 1 and "7654321" in {r.folder: r.body for r in again.aggregates.collect()}["a"]


def test_html_and_config(tmp_path):
    assert render.markdown_html("# T\n\na **b**\nc\n- x\n- y\n_Source: f<.pdf_") == '<h1>T</h1>\n<p>a <strong>b</strong> c</p>\n<ul><li>x</li><li>y</li></ul>\n<p class="citation">Source: f&lt;.pdf</p>'
    assert render.may_overwrite(None) and not render.may_overwrite("# mine")
    (tmp_path / config.FILE_NAME).write_text("chunk_threshold: 100\nchunk_overlap: 5\n")
    (tmp_path / "below").mkdir()
    made = config.load(str(tmp_path / "below"), {"DOCLOOM_CHUNK_OVERLAP": "7"})
    assert (made.chunk_threshold, made.chunk_overlap) == (100, 7)
    with pytest.raises(ValueError):
        config.Config(model_host="https://api.example.com")


def test_stream_and_table_windows_agree(spark, tmp_path):
    from docloom.streaming import incremental as stream

    rows = [(i, T0 + dt.timedelta(minutes=17 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(40)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream.event_windows(stream.stream_table(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    on_table = {tuple(r) for r in stream.event_windows(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == on_table and sum(r[2] for r in on_table) == 40


def test_stream_ledger_processes_each_version_once(spark, tmp_path):
    from docloom.streaming import incremental as stream

    rows = [scan("f/a.txt", "AA", 1), scan("f/a.txt", "aa", 1), scan("f/b.txt", "bb", 2)]
    spark.createDataFrame(rows, FILES).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    seen = []

    def run():
        source = stream.stream_table(spark, str(tmp_path / "in" / "*"), FILES)
        stream.process_new(stream.new_versions(source), str(tmp_path / "ledger"), str(tmp_path / "check"), lambda df: seen.extend(r.rel_path for r in df.collect()) or df).awaitTermination()

    run()
    spark.createDataFrame([scan("f/b.txt", "bb", 2), scan("f/c.txt", "cc", 3)], FILES).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    run()
    assert sorted(seen) == ["f/a.txt", "f/b.txt", "f/c.txt"]


def test_stream_ledger_takes_late_scans_of_a_later_run(spark, tmp_path):
    from docloom.streaming import incremental as stream

    seen = []

    def run(number, rows):
        df = spark.createDataFrame([scan(path, sha, 1) for path, sha, _ in rows], FILES)
        at = F.to_timestamp(F.element_at(F.create_map(*(F.lit(x) for pair in {path: at for path, _, at in rows}.items() for x in pair)), F.col("rel_path")))
        df.withColumn("loaded_at", at.cast(df.schema["loaded_at"].dataType)).coalesce(1).write.parquet(str(tmp_path / "in" / str(number)))
        source = stream.stream_table(spark, str(tmp_path / "in" / "*"), FILES)
        stream.process_new(stream.new_versions(source), str(tmp_path / "ledger"), str(tmp_path / "check"), lambda df: seen.extend(r.rel_path for r in df.collect()) or df).awaitTermination()

    run(1, [("f/a.txt", "aa", "2024-06-01"), ("f/b.txt", "bb", "2024-06-02")])
    run(2, [("f/c.txt", "cc", "2024-06-03")])
    run(3, [("f/late.txt", "dd", "2024-01-01"), ("f/a.txt", "aa", "2024-01-01"), ("f/late.txt", "dd", "2024-01-01")])  # a backfill
    assert sorted(seen) == ["f/a.txt", "f/b.txt", "f/c.txt", "f/late.txt"]


def test_dashboard_shows_every_concept(spark):
    rows = [(f"p/{i:04}.md", None, "Note" if i else None, f"text {i} <b>") for i in range(1500)]
    page = render.dashboard("t", {"model": "", "n": "<3"}, spark.createDataFrame(rows, "path string, title string, okf_type string, body string"), commits=["* a1 first"], runs=[("case", 0.9), ("other", None)])
    assert page.count("<details>") == 1500 and "<summary>1499 <small>Note" in page and "&lt;b&gt;" in page and "<td>—</td>" in page and "&lt;3" in page and "class='pass'" in page and "* a1 first" in page
    assert render.dashboard("t", {}, spark.createDataFrame([], "path string, title string, okf_type string, body string")).count("<details>") == 0


def test_inline_marks():
    assert render.inline("a **b _c_** <x> [l](u?a=1&b) snake_case_name") == 'a <strong>b <em>c</em></strong> &lt;x&gt; <a href="u?a=1&amp;b">l</a> snake_case_name'
    assert render.inline("open ** and _never closed") == "open ** and _never closed"
    assert render.inline("") == ""


def test_write_changed_survives_a_retry(spark, tmp_path):
    from docloom.sources.sinks import write_changed

    folder, schema = str(tmp_path / "t"), "k string, v string"
    one = spark.createDataFrame([("a", "1"), ("b", "1")], schema)
    assert write_changed(one, folder, "k", "v", "r1") == 2
    assert write_changed(one, folder, "k", "v", "r1") == 2 and spark.read.parquet(folder).count() == 2
    two = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], schema)
    for _ in range(2):
        assert write_changed(two, folder, "k", "v", "r2") == 2
    assert write_changed(two, folder, "k", "v", "r3") == 0


def test_saved_state_is_whole_or_the_last(spark, tmp_path):
    from docloom.sources.sinks import load_state, save_state

    folder = str(tmp_path / "s")
    assert load_state(spark, folder) is None
    for i in range(4):
        save_state(spark.range(i), folder)
    assert load_state(spark, folder).count() == 3
    broken = spark.range(5).selectExpr("raise_error('down') as x")
    with pytest.raises(Exception, match="down"):
        save_state(broken, folder)
    assert load_state(spark, folder).count() == 3
    save_state(spark.range(9), folder)
    assert load_state(spark, folder).count() == 9


def calls_in(path):
    return len(path.read_text()) if path.exists() else 0


def test_ingest_writes_and_keeps_state(spark, tmp_path):
    from docloom.operators.extraction import rule_extractor
    from docloom.plans import ingest
    from docloom.plans.config import Config

    root, derived, told = tmp_path / "docs", str(tmp_path / "derived"), str(tmp_path / "told")
    text = "Vertrag {}\n\n" + "Ein Satz über den Vertrag, der lang genug ist, um als Inhalt zu gelten und zu bestehen. " * 2
    for name in ("a/x/one.txt", "a/x/two.txt", "b/three.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text.format(name))

    def extract(chunk, context):
        with open(derived, "a") as f:
            f.write("x")
        return rule_extractor(chunk, context)

    def tell(sections):
        with open(told, "a") as f:
            f.write("x")
        return "Zwei Sätze zur Orientierung."

    config = Config(document_root=str(root), derive_per_file=True)
    run = lambda **more: ingest.run(spark, str(root), config, **{"extractor": extract, "summarizer": tell, **more})
    counts = lambda: (calls_in(tmp_path / "derived"), calls_in(tmp_path / "told"))
    done, written = run()
    assert counts() == (3, 2) and written == {"transcripts": 3, "facts": 3, "documents": 3, "deleted": 0}
    page = (root / "a/x/x.md").read_text()
    assert page.startswith("---\ntype: 'FolderSummary'") and "Aggregated extraction of 2 document(s) in x" in page and "Zwei Sätze zur Orientierung." in page and page.count("_Source: ") == 2
    index = (root / "a/a.md").read_text()
    assert "FolderIndex" in index and "- [x](x/x.md) — Aggregated extraction of 2 document(s) in x" in index
    assert (root / ".docloom/transcripts/b/three.txt.txt").read_text() == text.format("b/three.txt") and (root / ".docloom/facts/b/three.txt.md").exists()
    done, written = run()  # an unchanged tree
    assert counts() == (3, 2) and done.n_derived == 0 and written["documents"] == 0
    (root / "a/x/two.txt").write_text(text.format("changed"))
    done, written = run()
    assert counts() == (4, 3) and written["documents"] == 1
    # A folder without files loses its aggregate and index, a page by hand stays.
    (root / "a/x/one.txt").unlink()
    (root / "a/x/two.txt").unlink()
    (root / "b/b.txt.md").write_text("by hand")
    done, written = run()
    assert written["deleted"] == 2 and not (root / "a/x/x.md").exists() and not (root / "a/a.md").exists() and (root / "b/b.md").exists()
    # No file of a folder can be read any more: its aggregate becomes a flagged stub.
    (root / "b/three.txt").unlink()
    (root / "b/pic.png").write_bytes(b"x")
    done, written = run()
    assert "could be read" in (root / "b/b.md").read_text() and done.n_flagged == 1
    assert {r.rel_path: r.reason for r in done.skipped.collect()} == {"b/pic.png": "no reader for .png"}


def test_command_line(spark, tmp_path, capsys):
    from docloom.__main__ import ingest_tree, main

    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.txt").write_text("Brief\n\n" + "Ein Absatz mit Inhalt, der lang genug ist, um zu bestehen. " * 3)
    (tmp_path / "a/locked.pdf").write_bytes(b"%PDF-1.7 trailer << /Encrypt 5 0 R >>")
    assert ingest_tree(spark, str(tmp_path), False) == 2 and "skipped a/locked.pdf: encrypted" in capsys.readouterr().out
    (tmp_path / "a/locked.pdf").unlink()
    assert ingest_tree(spark, str(tmp_path), False) == 0
    assert ingest_tree(spark, str(tmp_path), False) == 0 and "0 derived" in capsys.readouterr().out.strip().split("\n")[-1]
    (tmp_path / "docloom.yaml").write_text("exclude:\n- '*.csv'\n")
    (tmp_path / "a/more.csv").write_text("x,y\n")
    assert ingest_tree(spark, str(tmp_path), False) == 2 and "skipped a/more.csv: excluded" in capsys.readouterr().out
    assert main(["nonsense"]) == 1 and main(["ingest", str(tmp_path / "none")]) == 1


def test_failed_sections_of_a_written_state_are_tried_again(spark, tmp_path):
    from docloom.plans import ingest

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("Alt\n\n" + "Inhalt " * 30)
    ingest.run(spark, str(tmp_path))
    (tmp_path / "d/a.txt").write_text("Neu\n\n" + "Inhalt " * 30)

    def failing(chunk, context):
        raise RuntimeError("down")

    done, _ = ingest.run(spark, str(tmp_path), extractor=failing)
    assert "Alt" in (tmp_path / "d/d.md").read_text() and "down" in done.skipped.where("rel_path = 'd/a.txt'").first().reason
    ingest.run(spark, str(tmp_path))
    assert "Neu" in (tmp_path / "d/d.md").read_text()


def test_external_readers(tmp_path):
    from docloom.sources import external

    assert external.program_reader(["cat", "{file}"], 5, ".txt")(b"abc") == "abc"
    assert external.program_reader(["cp", "{file}", "{folder}/out.md"], 5, ".pdf", "out*.md")(b"made") == "made"
    with pytest.raises(RuntimeError, match="not installed"):
        external.program_reader(["no-such-program-here"], 5, ".png")(b"")
    with pytest.raises(RuntimeError, match="exit 3: " + "x" * 2000 + "$"):
        external.program_reader(["sh", "-c", "printf 'y%.0s' 1 2 3 >&2; head -c 2000 /dev/zero | tr '\\0' x >&2; exit 3"], 5, ".png")(b"")
    with pytest.raises(RuntimeError, match="no output"):
        external.program_reader(["true"], 5, ".pdf", "*.md")(b"")
    assert external.with_ocr(lambda c: "layer")(b"") == "layer" and not external.available("no-such-program-here")
    assert external.described_images(lambda url: url[:22], {".png": lambda c: "seen"})[".png"](b"1") == "data:image/png;base64,\n\nseen"


def test_models(spark):
    from docloom.operators import extraction
    from docloom.plans.config import Config

    asked = []
    offer = lambda: asked.append(1) or ["a", "b"]
    extraction.preflight({"a": offer, "b": offer})
    assert asked == [1]
    with pytest.raises(LookupError, match="c"):
        extraction.preflight({"a": offer, "c": offer})
    assert extraction.localized("p", "") == "p" and "nl" in extraction.localized("p", "nl")
    assert Config(model="m", verify_model="v").models()["verify"] == ("v", "http://localhost:11434")
    row = spark.createDataFrame([(bytearray(b"1"), "x.JPG"), (bytearray(b"1"), "x")], "c binary, n string").select(extraction.image_payload(F.col("c"), F.col("n")).alias("u")).collect()
    assert [r.u for r in row] == ["data:image/jpeg;base64,MQ==", "data:image/png;base64,MQ=="]
    with pytest.raises(ValueError):
        Config(verify_host="https://far.example")
    assert Config(verify_host="https://far.example", allowed_hosts=("far.example",)).summary()["allowed_hosts"] == "far.example"


def test_lost_identifiers_reach_the_report(spark):
    body = "Intro\n\n## One\n\n_Source: a.txt_\n\n" + "Kundennummer 1234567 steht hier. " * 8
    concepts = spark.createDataFrame([("c1", "f/f.md", "FolderSummary", ["f/a.txt"], body), ("c2", ".x/f.md", "FolderSummary", ["f/a.txt"], body), ("c3", "g/g.md", "FolderSummary", ["g/none.txt"], body.replace("a.txt", "none.txt"))], "concept_id string, path string, okf_type string, sources array<string>, body string")
    transcripts = spark.createDataFrame([("f/a.txt", "Kundennummer: 1234567\n" + "\n".join(f"Vertragsnummer: 88{i}0{i}77" for i in range(10)))], "rel_path string, text string")
    found = {(r.concept_id, r.check_id): r for r in validation.findings(concepts, transcripts).collect()}
    lost = found["c1", "identifiers"]
    assert not lost.passed and lost.evidence.startswith("missing: Vertragsnummer=8800077") and lost.evidence.endswith("(+2 more)")
    assert not any(c in ("c2",) for c, _ in found) and ("c3", "identifiers") not in found
    report = {r.concept_id: r for r in validation.report(validation.findings(concepts, transcripts)).collect()}
    assert not report["c1"].passed and report["c3"].passed
    flagged = {r.concept_id: r.body for r in validation.with_banner(concepts, validation.report(validation.findings(concepts, transcripts))).collect()}
    assert flagged["c1"].startswith("_Verification: FLAGGED — identifiers: ") and flagged["c3"] == concepts.where("concept_id = 'c3'").first().body


def test_checkpoints_need_a_named_folder_on_a_cluster(spark):
    from docloom import session

    class Cluster:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: self, "getCheckpointDir": lambda self: self, "isDefined": lambda self: False})()

    fake = type("S", (), {"conf": type("C", (), {"get": lambda self, *a: None})(), "sparkContext": Cluster()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
