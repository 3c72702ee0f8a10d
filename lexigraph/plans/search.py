"""Search of batches of queries: one plan, whatever the number of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, metadata_boosts, resolve_weights
from ..errors import BadRequest
from ..functions import embedding
from ..functions import text as T
from ..operators import fusion, graph, inverted, lexical, vectors
from ..storage import materialise

CHUNK_BOOSTS = {"text": 1.0, "heading_path": 1.5}


@dataclass(frozen=True)
class SearchIndex:
    """Everything that a search reads, as tables."""

    notes: DataFrame  # id, title, status
    chunks: DataFrame  # id, note_id, strategy, heading_path, kind, text
    vectors: DataFrame  # id (of the passage), vec
    chunk_words: lexical.LexicalIndex
    note_words: lexical.LexicalIndex
    edges: DataFrame
    model: embedding.Model


def build(notes: DataFrame, chunks: DataFrame, embeddings: DataFrame, attributes: DataFrame, edges: DataFrame, model: embedding.Model) -> SearchIndex:
    """attributes: id, title, outline, alias_list, tag_list and the four lists of
    terms, as grouped_attributes gives them."""
    active = notes.where("status = 'active'").select("id", "title", "status")
    mine = chunks.join(active.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    vecs = vectors.chunk_vectors(mine.select("id", "space_id", "text_hash"), embeddings).select("id", "vec")
    return assemble(active, mine, vecs, attributes, edges, model)


def assemble(active: DataFrame, mine: DataFrame, vecs: DataFrame, attributes: DataFrame, edges: DataFrame, model: embedding.Model) -> SearchIndex:
    """The index of active notes (id, title, status), their passages and the vectors
    (id, vec) of these."""
    words = lexical.build(mine, "id", {"text": F.col("text"), "heading_path": F.coalesce("heading_path", F.lit(""))})
    joined = lambda c: F.array_join(c, " ")
    fields = {
        "title": F.col("title"), "aliases": joined("alias_list"), "tags": joined("tag_list"), "outline": F.coalesce("outline", F.lit("")),
        "keywordsManual": joined("keywords_manual"), "keywordsAuto": joined("keywords_auto"), "phrasesManual": joined("phrases_manual"), "phrasesAuto": joined("phrases_auto"),
    }
    named = lexical.build(attributes.join(active.select("id"), "id", "left_semi"), "id", fields)
    return SearchIndex(active, mine, vecs, words, named, edges, model)


#: What a stored index consists of; its version changes when what these hold does.
KINDS, VERSION = ("notes", "chunks", "vectors", "chunk_postings", "chunk_fields", "chunk_near", "note_postings", "note_fields", "note_near", "edges"), "3"


def _tables(index: SearchIndex) -> dict[str, DataFrame]:
    words = [t for w in (index.chunk_words, index.note_words) for t in (w.postings, w.fields, lexical.deletions(w.postings) if w.near is None else w.near)]
    return dict(zip(KINDS, (index.notes, index.chunks, index.vectors, *words, index.edges), strict=True))


def _of(t: dict[str, DataFrame], model: embedding.Model) -> SearchIndex:
    words = (lexical.LexicalIndex(*(t[f"{x}_{k}"] for k in ("postings", "fields", "near"))) for x in ("chunk", "note"))
    return SearchIndex(t["notes"], t["chunks"], t["vectors"], *words, t["edges"], model)


def kept(index: SearchIndex) -> SearchIndex:
    """The index with its tables written once, for many searches."""
    words = [lexical.LexicalIndex(materialise(w.postings, "index-postings"), w.fields) for w in (index.chunk_words, index.note_words)]
    index = replace(index, chunk_words=words[0], note_words=words[1])
    return _of({k: df if k.endswith("postings") else materialise(df, f"index-{k}") for k, df in _tables(index).items()}, index.model)


def for_one_batch(index: SearchIndex) -> SearchIndex:
    """The index for a single batch of queries: what is read several times is written
    once. Passages and their vectors stay as they are, and passages' words aren't
    kept, as a batch reads few of them."""
    names = lexical.LexicalIndex(materialise(index.note_words.postings, "index-postings"), materialise(index.note_words.fields, "index-fields"))
    return replace(index, notes=materialise(index.notes, "index-notes"), edges=materialise(index.edges, "index-edges"), chunk_words=lexical.for_one_batch(index.chunk_words), note_words=names)


def stored(project, space: str, model: embedding.Model, make: Callable[[], SearchIndex]) -> SearchIndex:
    """A project's index: its snapshots where they were made by this version from
    the data as they are, else made anew and stored."""
    mark = project.fingerprint(space)
    found = {k: project.load_snapshot(space, k, VERSION, mark) for k in KINDS}
    if any(df is None for df in found.values()):
        for k, df in _tables(make()).items():
            project.save_snapshot(space, k, VERSION, mark, df)
        found = {k: project.load_snapshot(space, k, VERSION, mark) for k in KINDS}
    return _of(found, model)


def check_gate(queries: DataFrame) -> DataFrame:
    """Queries in a rejected script fail as they pass."""
    found = T.blocked_name(F.col("q"))
    message = F.concat(F.lit("a query must be in English: "), found)
    return queries.withColumn("q", F.when(found.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("q")))


def tolerance_of(config: dict, fuzzy: bool | None) -> int:
    """Edits that a word may be away from the one asked for: the configuration's,
    unless a search says otherwise."""
    return config["search"]["tolerance"] if fuzzy is not False else 0


def retrieve(index: SearchIndex, queries: DataFrame, config: dict, weights: tuple[float, float], fuzzy: bool | None = None) -> DataFrame:
    """Scored passages of both passes, each cut to its best before they meet."""
    limits = config["search"]["limits"]
    k = limits["candidateK"]
    spark = queries.sparkSession
    nothing = spark.createDataFrame([], "qid string, doc long, score double, rank int")
    lex = lexical.search(queries, index.chunk_words, CHUNK_BOOSTS, k, tolerance=tolerance_of(config, fuzzy)) if weights[0] > 0 else nothing
    if weights[1] <= 0:
        return fusion.merge_passes(lex, nothing, *weights)
    asked = queries.select("qid", embedding.embed(F.col("q"), index.model, query=True).alias("vec"))
    return fusion.merge_passes(lex, vectors.search(asked, index.vectors, k, limits["minSimilarity"]), *weights)


def search(index: SearchIndex, queries: DataFrame, config: dict | None = None, mode: str = "hybrid", k: int | None = None, expand_links: bool = False, fuzzy: bool | None = None) -> DataFrame:
    """queries (qid, q). Returns hits (qid, rank, id, title, score, why,
    snippets, via), each query's best first; modes hybrid, semantic, lexical.
    What the passes found, and the hits before the graph, are each read several
    times and written once."""
    if mode not in ("hybrid", "semantic", "lexical"):
        raise BadRequest(f'no mode "{mode}" of passages', {"mode": mode}, "exact, id and graph searches have functions of their own")
    config = config or DEFAULTS
    weights = resolve_weights(config, mode)
    queries = check_gate(queries)
    scored = materialise(retrieve(index, queries, config, weights, fuzzy), "search-passes")
    named = lexical.matches(queries, index.note_words, tolerance_of(config, fuzzy), require_all=True)
    out = rank(index, scored, named, config, weights, k, once=True)
    return graph.attach_neighbours(out, index.edges, index.notes) if expand_links else out


def rank(index: SearchIndex, scored: DataFrame, named: DataFrame, config: dict, weights: tuple[float, float], k: int | None = None, once: bool = False) -> DataFrame:
    """Hits of what the passes found (scored) and of matches in metadata
    (named), under a configuration. A pure vector search uses no metadata."""
    s = config["search"]
    meta = lexical.rank(named, metadata_boosts(config), s["limits"]["candidateK"], require_all=True) if weights[0] > 0 else named.sparkSession.createDataFrame([], "qid string, doc string, score double")
    hits = fusion.fuse(scored, index.chunks, meta, index.notes, config, weights)
    hits = materialise(hits, "search-hits") if once else hits
    return fusion.finish(fusion.apply_graph(hits, index.edges, index.notes, config, once), k or s["limits"]["resultK"])


# ---- a few queries on a stored index ----

#: Queries that search_few takes at once: what it gathers is bounded by them.
FEW = 64


@dataclass(frozen=True)
class QuickIndex:
    """An index of which a search reads what its few queries need, by their words,
    and then by the ids that these lead to."""

    index: SearchIndex
    chunk_words: inverted.Clustered
    note_words: inverted.Clustered
    chunk_near: inverted.Sorted  # token, key
    note_near: inverted.Sorted
    chunks: inverted.Sorted
    notes: inverted.Sorted
    near: inverted.Sorted  # a, b: neighbours, both ways round


def quick(index: SearchIndex) -> QuickIndex:
    """Sorts and packs an index (kept or stored) for searches of a few queries."""
    words = [inverted.write(w, f"{x}-words") for x, w in (("chunk", index.chunk_words), ("note", index.note_words))]
    near = [inverted.write_sorted(w.near if w.near is not None else materialise(lexical.deletions(w.postings), "near"), "key", name="near") for w in (index.chunk_words, index.note_words)]
    both = materialise(graph.symmetric(index.edges), "near-edges")
    by_id = [inverted.write_sorted(t, "id", name="by-id", rows=2_000) for t in (index.chunks, index.notes)]
    return QuickIndex(index, *words, *near, *by_id, inverted.write_sorted(both, "a", "b", name="near-edges"))


def _local(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    return spark.createDataFrame(pa.table(columns)).coalesce(1)


def _here(df: DataFrame) -> tuple[DataFrame, pa.Table]:
    """A bounded table as one partition, and its rows: what is made of such tables
    needs no shuffle."""
    rows = df.toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema).coalesce(1), rows


def _near_words(tokens: pa.Table, near: inverted.Sorted, words: lexical.LexicalIndex, tolerance: int) -> pa.Table:
    """(qid, n_tokens, token, near): tokens with the known words near them."""
    if not tolerance:
        return tokens.append_column("near", tokens["token"])
    if tolerance > 1:
        return lexical.expand_typos(_local(near.spark, {c: tokens[c] for c in tokens.column_names}), words.postings, tolerance).select("qid", "n_tokens", F.col("asked").alias("token"), F.col("token").alias("near")).toArrow()
    asked = {w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for w in set(tokens["token"].to_pylist())}
    pairs = [(w, k) for w, ks in asked.items() for k in sorted(ks)]
    keys = _local(near.spark, {"asked": pa.array([w for w, _ in pairs], pa.string()), "key": pa.array([k for _, k in pairs], pa.string())})
    known = near.read([k for _, k in pairs]).join(F.broadcast(keys), "key").where(F.levenshtein("asked", "token", tolerance) >= 0)
    found: dict[str, set] = {}
    for w, t in zip(*(known.select("asked", "token").toArrow().to_pydict().values()), strict=True):
        found.setdefault(w, set()).add(t)
    rows = [{**r, "near": t} for r in tokens.to_pylist() for t in sorted(found.get(r["token"], ()))]
    return pa.Table.from_pylist(rows, pa.schema([*tokens.schema, pa.field("near", pa.string())]))


def search_few(quick: QuickIndex, queries: DataFrame, config: dict | None = None, mode: str = "hybrid", k: int | None = None, fuzzy: bool | None = None) -> DataFrame:
    """What search finds for up to FEW queries, from the blocks and rows that these
    need. Passes are cut to candidateK for each query before anything is gathered."""
    if mode not in ("hybrid", "semantic", "lexical"):
        raise BadRequest(f'no mode "{mode}" of passages', {"mode": mode}, "exact, id and graph searches have functions of their own")
    config = config or DEFAULTS
    weights, limits, index = resolve_weights(config, mode), config["search"]["limits"], quick.index
    spark, tolerance, k_pass = queries.sparkSession, tolerance_of(config, fuzzy), config["search"]["limits"]["candidateK"]
    queries, asked = _here(check_gate(queries).select("qid", "q").limit(FEW + 1))
    if asked.num_rows > FEW:
        raise BadRequest("too many queries", {"most": FEW}, "search takes batches of any size")
    nothing = spark.createDataFrame([], "qid string, doc long, score double, rank int")
    lex, vec, meta = nothing, nothing, nothing.select("qid", F.col("doc").cast("string").alias("doc"), "score")
    if weights[1] > 0:
        vec = vectors.search(queries.select("qid", embedding.embed(F.col("q"), index.model, query=True).alias("vec")), index.vectors, k_pass, limits["minSimilarity"])
    if weights[0] > 0:
        tokens = lexical.query_tokens(queries).toArrow()
        close = _near_words(tokens, quick.chunk_near, index.chunk_words, tolerance)
        times = Counter(zip(close["qid"].to_pylist(), close["near"].to_pylist(), strict=True))
        lex = inverted.search_words([(*key, n) for key, n in times.items()], quick.chunk_words, CHUNK_BOOSTS, k_pass)
        named = _near_words(tokens, quick.note_near, index.note_words, tolerance)
        wanted = _local(spark, {c: named[x] for c, x in (("qid", "qid"), ("n_tokens", "n_tokens"), ("asked", "token"), ("token", "near"))})
        found = quick.note_words.postings(named["near"].to_pylist()).join(F.broadcast(wanted), "token").join(F.broadcast(quick.note_words.fields), "field")
        part = lexical.bm25(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("n"), F.col("df")).alias("part")
        meta = lexical.rank(found.select("qid", "doc", "field", "asked", "n_tokens", part), metadata_boosts(config), k_pass, require_all=True)
    scored, passages = _here(fusion.merge_passes(_here(lex)[0], _here(vec)[0], *weights))
    meta, named = _here(meta)
    chunks, about = _here(quick.chunks.read(passages["chunk_id"].to_pylist()))
    notes, _ = _here(quick.notes.read(about["note_id"].to_pylist() + named["doc"].to_pylist()))
    hits, ids = _here(fusion.fuse(scored, chunks, meta, notes, config, weights))
    edges = quick.near.read(ids["id"].to_pylist()).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return fusion.finish(fusion.apply_graph(hits, edges, index.notes, config), k or limits["resultK"])


def check_model(space_model: str, requested: str) -> None:
    if space_model != requested:
        raise BadRequest(f'the index was made with "{space_model}", not "{requested}"', {"space": space_model, "requested": requested})
