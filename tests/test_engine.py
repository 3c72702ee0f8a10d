"""The store, writing and undoing, links in bodies, import, streams, tuning."""

import pytest
from pyspark.sql import functions as F

from lexigraph.config import DEFAULTS, apply_patch
from lexigraph.errors import BadRequest, Conflict, NotFound
from lexigraph.functions import embedding
from lexigraph.operators import bridge, graph, links, notes, revisions, terms
from lexigraph.plans import evaluate, index, search
from lexigraph.sources import files
from lexigraph.sources.warehouse import Registry, prefix_for
from lexigraph.streaming import reindex

BODIES = {
    "LT-0001": ("Lamp basics", "# Lamp basics\n\nA lamp gives light. The filament glows. See [[LT-0002]].\n\n## Bulbs\n\nBulbs hold a filament in a vacuum.\n"),
    "LT-0002": ("Filament wire", "# Filament wire\n\nTungsten filament wire glows white hot and lights the lamp. [[LT-0003|power]]\n"),
    "LT-0003": ("Power supply", "# Power supply\n\nA supply feeds current into the wire. [[Missing note]]\n"),
    "LT-0004": ("Gardening", "# Gardening\n\nTomatoes need sun and water. [[LT-0001]] [[LT-0002]]\n"),
}


@pytest.fixture(scope="module")
def note_rows(spark):
    rows = [(i, t, b, "en", "active", 1) for i, (t, b) in BODIES.items()]
    return spark.createDataFrame(rows, "id string, title string, body string, lang string, status string, rev int")


@pytest.fixture(scope="module")
def built(spark, note_rows):
    model = embedding.find_model("hashing-64")
    e = lambda t: spark.createDataFrame([], t)
    stored = e("id long, space_id string, note_id string, strategy string, ord int, heading_path string, kind string, text string, text_hash string, tokens int")
    return index.index(note_rows, e("note_id string, alias string"), e("note_id string, source_path string"), stored, e("space_id string, text_hash string, vec array<float>"), model), model


@pytest.fixture(scope="module")
def search_index(built, note_rows):
    run, model = built
    none = F.array().cast("array<string>")
    attributes = note_rows.select("id", "title", F.lit("").alias("outline"), *[none.alias(c) for c in ("alias_list", "tag_list", "keywords_manual", "keywords_auto", "phrases_manual", "phrases_auto")])
    return search.build(note_rows, run.chunks, run.embeddings, attributes, graph.adjacency(run.links), model)


def test_index_run(spark, built, note_rows):
    run, model = built
    assert {(r.change, r.notes) for r in run.report.collect()} == {("new", 4)}
    got = {(r.src, r.dst, r.resolved) for r in run.links.collect()}
    assert got == {("LT-0001", "LT-0002", True), ("LT-0002", "LT-0003", True), ("LT-0003", "Missing note", False), ("LT-0004", "LT-0001", True), ("LT-0004", "LT-0002", True)}
    again = index.index(note_rows, spark.createDataFrame([], "note_id string, alias string"), spark.createDataFrame([], "note_id string, source_path string"), run.chunks, run.embeddings, model)
    assert {(r.change, r.notes) for r in again.report.collect()} == {("current", 4)}
    assert again.embeddings.count() == run.embeddings.count()
    first, second = ({r.name: r.n for r in x.counters.collect()} for x in (run, again))
    assert first["notes_total"] == first["notes_chunked"] == 4 and first["embedded"] == first["unique_texts"] == run.embeddings.count() and (first["links"], first["dangling"]) == (5, 1)
    assert second["notes_unchanged"] == 4 and second["reused"] == first["embedded"] and second["embedded"] == second["pruned_vectors"] == second["notes_dropped"] == 0


def test_search_order_and_parts(spark, search_index):
    asked = spark.createDataFrame([("a", "filament wire"), ("b", "tomatoes"), ("c", "the of")], "qid string, q string")
    config = apply_patch(DEFAULTS, {"search.limits.minSimilarity": 0.0})
    rows = search.search(search_index, asked, config, expand_links=True).collect()
    top = {r.qid: r.id for r in rows if r["rank"] == 1}
    assert top["a"] == "LT-0002" and top["b"] == "LT-0004"
    for r in rows:
        assert abs(r.score - sum(r.why[k] for k in ("text", "vector", "meta", "graph", "multi_chunk"))) < 2e-6
    lex = search.search(search_index, asked, config, mode="lexical").collect()
    assert all(r.why.vector == 0 for r in lex)
    assert [n.neighbour for n in next(r for r in rows if r.qid == "b" and r.id == "LT-0004").neighbours] == ["LT-0001", "LT-0002"]
    with pytest.raises(BadRequest):
        search.search(search_index, asked, mode="exact")
    with pytest.raises(Exception, match="must be in English"):
        search.search(search_index, spark.createDataFrame([("x", "лампа")], "qid string, q string")).collect()


def test_typos(spark, search_index):
    asked = spark.createDataFrame([("a", "filamnet"), ("b", "tungstin")], "qid string, q string")
    hits = search.search(search_index, asked, mode="lexical", fuzzy=True).collect()
    assert {r.qid for r in hits} == {"b"} == {r.qid for r in search.search(search_index, asked, mode="lexical").collect()}
    assert not search.search(search_index, asked, mode="lexical", fuzzy=False).collect()


def test_tuning(spark, search_index):
    rows = [("q1", "filament wire", ["LT-0002"], []), ("q2", "tomatoes sun", ["LT-0004"], ["LT-0001"]), ("q3", "current supply", ["LT-0003"], []), ("q4", "bulbs vacuum", ["LT-0001"], [])]
    golden = spark.createDataFrame(rows, "qid string, q string, relevant array<string>, irrelevant array<string>")
    assert "few" in evaluate.warning(golden)
    out = evaluate.tune(search_index, golden, n=2, seed=4)
    assert out["best"] >= out["baseline"] and out["trials"] == 2
    part, held = evaluate.split(golden)
    assert {r.qid for r in held.collect()} == {"q2", "q4"} and part.count() == 2
    runs = evaluate.log_run(spark.createDataFrame([], "id long, space_id string, queries int, recall_k int, ndcg_k int, recall double, mrr double, ndcg double, p50_ms int, p95_ms int, config string, metrics string, note string, created_at timestamp"), evaluate.run(search_index, golden), [3.0, 5.0, 9.0], "{}")
    r = evaluate.recent_runs(runs).first()
    assert (r.id, r.queries, r.p50_ms, r.p95_ms) == (1, 4, 5, 9) and r.mrr > 0.9


def test_golden_set(spark):
    out = files.read_golden(spark, "- q: lamp\n  relevant: [LT-0001]\n- q: wire\n  relevant: LT-0002\n  irrelevant: [LT-0004]\n").collect()
    assert [(r.q, r.relevant, r.irrelevant) for r in out] == [("lamp", ["LT-0001"], []), ("wire", ["LT-0002"], ["LT-0004"])]
    for bad in ("[]", "- {}", "- q: x\n  relevant: [1]", "a: [", "- q: ' '"):
        with pytest.raises(BadRequest):
            files.read_golden(spark, bad)


def test_related_section():
    body = "# A\n\ntext\n"
    one = links.insert_related(body, "LT-0002", "Wire")
    assert one == "# A\n\ntext\n\n## Related\n\n- [[LT-0002 Wire]]\n"
    two = links.insert_related(one, "LT-0003", "Power")
    assert two.endswith("- [[LT-0002 Wire]]\n- [[LT-0003 Power]]\n")
    assert links.drop_related(two, "LT-0002").endswith("## Related\n\n- [[LT-0003 Power]]\n")
    assert links.drop_related(one, "LT-0002") == "# A\n\ntext\n" and links.drop_related(body, "x") == body
    with pytest.raises(BadRequest):
        links.require_distinct("a", "a")


def test_warehouse(spark, tmp_path, note_rows):
    reg = Registry(spark, f"file://{tmp_path}")
    project = reg.create("Lamp Tests")
    assert project.get_meta("id_prefix") == "LT" and reg.names() == ["Lamp Tests"]
    with pytest.raises(Conflict):
        reg.create("Lamp Tests")
    with pytest.raises(NotFound):
        reg.open("none")
    assert project.load("notes").count() == 0
    full = note_rows.select("id", "title", "body", F.sha2("body", 256).alias("body_hash"), F.lit(None).cast("string").alias("outline"), "lang", "status", "rev", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    project.save("notes", full)
    mark = project.fingerprint("s")
    project.save("notes", project.load("notes").withColumn("rev", F.col("rev") + 1))
    assert project.fingerprint("s") != mark and project.load("notes").count() == 4 and len(project.versions("notes")) == 2
    assert project.vacuum("notes") == 1 and project.load("notes").count() == 4
    with pytest.raises(Exception, match="notes.status"):
        project.save("notes", full.withColumn("status", F.lit("gone")))
    mark = project.fingerprint("s")
    project.save("links", spark.createDataFrame([("LT-0001", "LT-0002", "", None, "wikilink", True)], "src string, dst string, anchor string, heading string, kind string, resolved boolean"))
    linked = project.fingerprint("s")
    project.save("notes", project.load("notes").withColumn("status", F.when(F.col("id") == "LT-0001", "archived").otherwise(F.col("status"))))
    assert len({mark, linked, project.fingerprint("s")}) == 3
    for version in ("1", "2"):
        project.save_snapshot("s", "words", version, mark, note_rows)
    assert project.load_snapshot("s", "words", "2", mark).count() == 4 and project.snapshots() == [("s", "words", "2")]
    assert project.load_snapshot("s", "words", "2", "other") is None and project.load_snapshot("s", "words", "1", mark) is None
    project.clear_snapshots("s")
    assert project.load_snapshot("s", "words", "2", mark) is None
    project.clear_snapshots()
    reg.remove("Lamp Tests", delete=True)
    assert reg.names() == [] and prefix_for(spark, "kb") == "KB" and prefix_for(spark, "Shaders") == "SHA"
    with pytest.raises(BadRequest):
        prefix_for(spark, "42")


def test_files_round_trip(spark, tmp_path, note_rows):
    rich = note_rows.withColumn("tags", F.array(F.lit("glow"))).withColumn("aliases", F.array(F.lit("x: y"), F.lit("z")))
    wanted = files.rendered(rich)
    folder = f"file://{tmp_path}/out"
    none = spark.createDataFrame([], "filename string, contents string")
    assert files.apply_export(spark, files.export_actions(wanted, none), folder) == {"created": 4}
    (tmp_path / "out" / ".obsidian").mkdir()
    (tmp_path / "out" / ".obsidian" / "x.md").write_text("no")
    (tmp_path / "out" / "LT-0099 old.md").write_text("old")
    (tmp_path / "out" / "mine.md").write_text("mine")
    found = files.find_markdown(spark, folder)
    present = found.select(F.col("path").alias("filename"), F.col("body").alias("contents"))
    counts = {r["action"]: r["count"] for r in files.export_actions(wanted, present).groupBy("action").count().collect()}
    assert counts == {"unchanged": 4, "removed": 1}
    read = found.select("path", files.parsed_file(F.col("body")).alias("f"))
    by = {r.path: r.f for r in read.collect()}
    note = by["LT-0001 Lamp basics.md"]
    assert note.front.id == "LT-0001" and note.front.aliases == ["x: y", "z"] and note.body == BODIES["LT-0001"][1].strip() and by["mine.md"].front is None
    assert {r.path for r in files.under(found, only=["mine.md"]).collect()} == {"mine.md"}
    assert files.parse_file("---\n: [\n---\nx")["error"]
    flat = read.where("f.front is not null").select(F.col("path").alias("filename"), "f.front.id", "f.front.title", "f.front.rev", F.concat("f.body", F.lit("\nmore")).alias("body"), F.lit(True).alias("has_front"))
    behind = flat.withColumn("rev", F.lit(0))
    acts = bridge.import_actions(behind, note_rows, "both")
    assert {r.detail for r in acts.collect()} == {"kept-both"}
    copies = {r.title: r.body for r in bridge.conflict_copies(behind, note_rows, acts).collect()}
    assert "- [[LT-0001 Lamp basics]]" in copies["Lamp basics (conflict copy)"]


def test_merged_metadata(spark):
    f = spark.createDataFrame([("n1", ["#a", "b"], ["x"], ["k"], [])], "id string, tags array<string>, aliases array<string>, keywords_manual array<string>, phrases_manual array<string>")
    al = spark.createDataFrame([("n1", "old"), ("n2", "keep")], "note_id string, alias string")
    tg = spark.createDataFrame([("n1", "old")], "note_id string, tag string")
    mt = spark.createDataFrame([("n1", "m", "keyword")], "note_id string, term string, kind string")
    a, t, m = (sorted(map(tuple, x.collect())) for x in bridge.merged_metadata(f, al, tg, mt))
    assert a == [("n1", "x"), ("n2", "keep")] and t == [("n1", "a"), ("n1", "b")] and m == [("n1", "k", "keyword"), ("n1", "m", "keyword")]


def test_revision_log(spark):
    cols = "note_id string, rev int, title string, body string, op string, author string, batch_id string, created_at timestamp"
    log = spark.createDataFrame([], cols)
    write = lambda body, op, expected: spark.createDataFrame([("n", "t", body, op, "me", "b1", expected)], "note_id string, title string, body string, op string, author string, batch_id string, expected_rev int").withColumn("created_at", F.current_timestamp())
    log = spark.createDataFrame(notes.append_revision(log, write("one", "create", None)).collect(), cols)
    log = spark.createDataFrame(log.collect() + notes.append_revision(log, write("two", "update", 1)).collect(), cols)
    assert notes.current(log).first().body == "two"
    with pytest.raises(Exception, match="revision conflict"):
        notes.append_revision(log, write("three", "update", 1)).collect()
    with pytest.raises(Conflict):
        notes.check_revision(1, 2, "n")
    back = revisions.revert(log, "n", 1, "me")
    assert notes.current(back).first().body == "one" and back.count() == 3
    assert [r.added for r in revisions.diff_revisions(log).orderBy("rev").collect()] == [1, 1]
    assert revisions.undo_plan(log).first().action == "archive"
    assert revisions.read_revision(log, "n").first().rev == 2 and revisions.new_batch_id().startswith("b2")


def test_terms(spark, note_rows):
    found = {(r.note_id, r.lemma): r for r in terms.candidates(note_rows).collect()}
    assert ("LT-0002", "filament wire") in found and ("LT-0002", "wire") in found
    assert terms.collapse([("fragment shader unit", "phrase"), ("shader unit", "phrase"), ("shader", "keyword"), ("unit", "phrase")]) == [0, 2, 3]
    assert terms.diversify([("a b", 1.0), ("a b c", 0.99), ("d", 0.9)], 0.7, 2) == [0, 2]
    vocab = spark.createDataFrame([(1, "lamp", "lamp", "auto", False, False, 1.0, 2)], "id long, term string, lemma string, source string, pinned boolean, blocked boolean, weight double, df int")
    new = spark.createDataFrame([("Lamp", "lamp", "manual", 1.0), ("wire", "wire", "auto", 0.4)], "term string, lemma string, source string, weight double")
    out = {r.lemma: r for r in terms.upsert_terms(vocab, new).collect()}
    assert out["lamp"].source == "manual" and out["lamp"].id == 1 and out["wire"].id == 2
    assert terms.set_flags(vocab, "lamp", blocked=True).first().blocked
    down = {r.lemma: r for r in terms.upsert_terms(spark.createDataFrame([out["lamp"]], vocab.schema), spark.createDataFrame([("lamp", "lamp", "auto", 0.2)], new.schema)).collect()}
    assert down["lamp"].source == "manual"


def test_stream_reindexes_bursts(spark, tmp_path):
    src, check = str(tmp_path / "log"), str(tmp_path / "check")
    rows = [("a", 1, "t", "x", "create", "me", None), ("a", 2, "t", "y", "update", "me", None), ("b", 1, "t", "z", "create", "me", None)]
    cols = "note_id string, rev int, title string, body string, op string, author string, batch_id string"
    df = spark.createDataFrame(rows, cols).withColumn("created_at", F.current_timestamp())
    df.coalesce(1).write.parquet(src)
    seen, exported = [], []
    q = reindex.start(reindex.revision_stream(spark, src), check, lambda w, n: seen.append(sorted((r.note_id, r.body) for r in w.collect())), lambda w, n: exported.append(w.count()), interval=None)
    q.awaitTermination(60)
    df.limit(1).withColumn("rev", F.lit(3)).write.mode("append").parquet(src)
    q = reindex.start(reindex.revision_stream(spark, src), check, lambda w, n: seen.append(sorted((r.note_id, r.rev) for r in w.collect())), interval=None)
    q.awaitTermination(60)
    assert seen == [[("a", "y"), ("b", "z")], [("a", 3)]] and exported == [2]


def test_pool(spark):
    pool, made = reindex.Pool(1), []
    make = lambda: made.append(1) or spark.range(3)
    for mark in ("a", "a", "b"):
        assert pool.get("p", mark, make).count() == 3
    assert len(made) == 2
    pool.get("q", "x", make)
    pool.release("q")
    now = [0.0]
    pool = reindex.Pool(4, idle=10, clock=lambda: now[0])
    pool.get("a", "x", make)
    now[0] = 6.0
    pool.get("b", "x", make)
    now[0] = 11.0
    assert pool.evict_idle() == ["a"] and pool.evict_idle() == []
    pool.release("b")


def test_adoption_report(spark):
    f = spark.createDataFrame([("x/a.md", "see [[One]]", "T"), ("y/a.md", "b", "U")], "path string, body string, title string")
    n = spark.createDataFrame([("N-0001", "t", "[[One]] [[Two]]")], "id string, title string, body string")
    acts = bridge.adopt_actions(f, n, spark.createDataFrame([], "note_id string, source_path string, body_hash string"))
    assert {(r.path, r.action, r.note_id) for r in acts.collect()} == {("x/a.md", "claimed", "N-0001"), ("y/a.md", "created", None)}
    assert bridge.losing_links(acts, f, n).first().losing == ["Two"]
    assert bridge.collisions(f).first().paths == ["x/a.md", "y/a.md"]
    assert {(r.action, r.files) for r in bridge.adopt_counts(acts).collect()} == {("claimed", 1), ("created", 1)}


def test_repair(spark, note_rows):
    e = lambda t: spark.createDataFrame([], t)
    old = spark.createDataFrame([("LT-0001", "LT-0002", False), ("LT-0003", "Missing note", False)], "src string, dst string, resolved boolean")
    fresh, report = bridge.repair(note_rows, e("note_id string, alias string"), e("note_id string, source_path string"), old, "LT", 2)
    assert fresh.count() == 5 and report == {"links_resolved": 1, "counter": 4, "raised": True}
