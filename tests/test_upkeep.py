"""A stream keeps the index as a full rebuild has it: through updates, deletes,
failures, restarts, replays and compaction."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import embedding
from lexigraph.operators import lexical
from lexigraph.schemas import TABLES
from lexigraph.streaming import reindex, upkeep

WORDS = "lamp wire power bulb glass heat light metal copper glow vacuum current".split()


def bursts(seed, n=4):
    """Bursts of writes: new notes, updates, deletes, notes that come back, and one stale write."""
    rng, rev, out = random.Random(seed), {}, []
    for b in range(n):
        rows = []
        for note in rng.sample([f"N-{i}" for i in range(14)], 8):
            for _ in range(rng.randint(1, 2)):
                rev[note] = rev.get(note, 0) + 1
                body = "# " + rng.choice(WORDS) + "\n\n" + "\n\n".join(" ".join(rng.choices(WORDS, k=rng.randint(3, 40))) for _ in range(rng.randint(1, 4)))
                rows.append((note, rev[note], f"Title {note}", body, "delete" if rng.random() < 0.25 else "update", "a", "b", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=b)))
        out.append(rows)
    out[-1].append((*out[0][0][:1], 0, *out[0][0][2:]))
    return out


def rebuilt(spark, everything, model, cut):
    last = {}
    for r in everything:
        if r[0] not in last or r[1] > last[r[0]][1]:
            last[r[0]] = r
    rows = [(r[0], r[2], r[3], "en", "active", r[1]) for r in last.values() if r[4] != "delete"]
    notes = spark.createDataFrame(rows, "id string, title string, body string, lang string, status string, rev int")
    passages = cut(notes)
    index = lexical.build(passages, "id", {"text": F.col("text"), "heading_path": F.coalesce("heading_path", F.lit(""))})
    vecs = passages.groupBy("text_hash").agg(F.min("embed_text").alias("t")).select("text_hash", embedding.embed(F.col("t"), model).alias("vec"))
    return {(r[0], r[5]) for r in rows}, passages, index, vecs


def state(df, *columns):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*columns).collect())


def same(live, want):
    heads, passages, index, vecs = want
    assert {tuple(r) for r in live.heads().collect()} == heads
    cols = ("id", "note_id", "strategy", "ord", "heading_path", "kind", "text", "text_hash")
    assert state(live.passages(), *cols) == state(passages, *cols)
    mine = live.lexical()
    assert state(mine.postings, "field", "token", "doc", "tf", "len", "df") == state(index.postings, "field", "token", "doc", "tf", "len", "df")
    assert state(mine.fields, "field", "n", "avg_len") == state(index.fields, "field", "n", "avg_len")
    near = {r.text_hash: list(r.vec) for r in live.vectors().collect()}
    assert near.keys() == {r.text_hash for r in vecs.collect()} and all(near[r.text_hash] == pytest.approx(list(r.vec), abs=1e-6) for r in vecs.collect())


def test_equal_to_a_rebuild(spark, tmp_path):
    model, cut = embedding.find_model("hashing-64"), upkeep.passages_of()
    parts = bursts(1)
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    live = upkeep.LiveIndex(spark, str(tmp_path / "live"), model, cut)
    put = lambda rows: spark.createDataFrame(rows, TABLES["note_revisions"]).coalesce(1).write.mode("append").parquet(log)
    run = lambda index: reindex.start(reindex.revision_stream(spark, log, 1), check, index, interval=None)
    put(parts[0])
    run(live.apply).awaitTermination()
    same(live, rebuilt(spark, parts[0], model, cut))
    put(parts[1])
    # The stream dies after a batch's tables and before its commit: nothing of it shows.
    broken = upkeep.LiveIndex(spark, live.path, model, cut)
    write = broken._put

    def dies(generation, table, batch, df):
        if table == "commits":
            raise RuntimeError("executor lost")
        write(generation, table, batch, df)

    broken._put = dies
    with pytest.raises(Exception, match="executor lost"):
        run(broken.apply).awaitTermination()
    same(live, rebuilt(spark, parts[0], model, cut))
    run(live.apply).awaitTermination()
    want = rebuilt(spark, parts[0] + parts[1], model, cut)
    same(live, want)
    # A batch that comes again, even the first one after the second, changes nothing.
    for number in (1, 0):
        live.apply(spark.createDataFrame(parts[number], TABLES["note_revisions"]), number)
    same(live, want)
    # The stream goes on from a compacted index.
    live.compact()
    assert live.generation() == 1 and live._commits(1) == [1]
    same(live, want)
    for number in (1, 0):
        live.apply(spark.createDataFrame(parts[number], TABLES["note_revisions"]), number)
    assert live._commits(1) == [1]
    put(parts[2] + parts[3])
    run(live.apply).awaitTermination()
    assert live._commits(1) == [1, 2]
    same(live, rebuilt(spark, sum(parts, []), model, cut))


def test_late_writes_are_dropped_and_counted(spark, tmp_path):
    """Within the watermark a late write counts as in a batch; beyond it it is dropped, and counted."""
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    feeds = [[("a", m) for m in range(50)], [("a", m) for m in range(50, 100)], [("b", m) for m in (10, 11, 88, 89, 95)], [("end", 100_000)], [("end", 200_000)]]
    dropped = 0
    for rows in feeds:
        spark.createDataFrame([(f"n{m}", 1, "", "", "update", who, "b", at(m)) for who, m in rows], TABLES["note_revisions"]).coalesce(1).write.mode("append").parquet(log)
        query = reindex.stream_bursts(reindex.revision_stream(spark, log), out, check, "30 seconds", "10 minutes")
        query.awaitTermination()
        dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    found = sorted((r.author, r.began, r.writes) for r in spark.read.parquet(out).where("author != 'end'").collect())
    # The watermark is 89 minutes: a burst that ends 30 seconds later than 89 is in, one that ends at 88 and a half isn't.
    assert dropped == 3 and [f for f in found if f[0] == "b"] == [("b", at(89), 1), ("b", at(95), 1)]
    kept = [(who, m) for rows in feeds[:3] for who, m in rows if who == "a" or m >= 89]
    batch = reindex.write_bursts(spark.createDataFrame([(f"n{m}", who, at(m)) for who, m in kept], "note_id string, author string, created_at timestamp"), "30 seconds")
    assert found == sorted((r.author, r.began, r.writes) for r in batch.collect())
