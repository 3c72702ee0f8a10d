"""The link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities, graph, layout
from ..operators import links as L
from ..storage import materialise
from . import fixtures as X
from .fixtures import ctes, table
from .registry import query
from .search_queries import BODY, body_hits

EDGES = """
edges AS (SELECT DISTINCT src, dst FROM links WHERE resolved AND src <> dst),
near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
degree AS (SELECT a AS node, count(*) AS degree FROM near GROUP BY a)"""


def _edges(spark, sf_dir):
    return graph.adjacency(X.links(spark, sf_dir))


@query(ctes(X.LINKS, EDGES) + "SELECT src, dst FROM edges")
def gra1_adjacency(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(ctes(X.LINKS) + "SELECT src, dst FROM links WHERE NOT resolved")
def gra2_dangling(spark, sf_dir):
    return graph.dangling(X.links(spark, sf_dir)).select("src", "dst")


@query(ctes(X.LINKS) + "SELECT dst, anchor FROM links WHERE src = 5")
def gra2_outgoing(spark, sf_dir):
    return graph.outgoing(X.links(spark, sf_dir), 5).select("dst", "anchor")


@query(ctes(X.NOTES, X.LINKS, EDGES) + "SELECT a AS id, b AS neighbour, CASE WHEN o.src IS NOT NULL AND i.src IS NOT NULL THEN 'both' WHEN o.src IS NOT NULL THEN 'links' ELSE 'backlinks' END AS relation FROM near LEFT JOIN edges o ON o.src = a AND o.dst = b LEFT JOIN edges i ON i.src = b AND i.dst = a WHERE b IN (SELECT id FROM notes WHERE status = 'active')")
def gra3_neighbours(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), X.notes(spark, sf_dir))


@query(ctes(X.LINKS, EDGES) + "SELECT node, degree FROM degree")
def agg21_degree(spark, sf_dir):
    return graph.degree(_edges(spark, sf_dir))


@query(ctes(X.NOTES, X.LINKS) + "SELECT id FROM notes WHERE status = 'active' AND id NOT IN (SELECT src FROM links WHERE resolved) AND id NOT IN (SELECT dst FROM links WHERE resolved)")
def gra7_orphans(spark, sf_dir):
    return graph.orphans(X.notes(spark, sf_dir), X.links(spark, sf_dir))


@query(ctes("links AS (SELECT page_id AS src, page_id + 1 AS dst, page_id % 3 = 0 AS resolved FROM pages)", "notes AS (SELECT page_id AS id, 'active' AS status FROM pages)") + "SELECT id FROM notes WHERE id NOT IN (SELECT src FROM links WHERE resolved) AND id NOT IN (SELECT dst FROM links WHERE resolved)")
def jn5_orphan_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    links = pages.select(F.col("page_id").alias("src"), (F.col("page_id") + 1).alias("dst"), (F.col("page_id") % 3 == 0).alias("resolved"))
    return graph.orphans(pages.select(F.col("page_id").alias("id"), F.lit("active").alias("status")), links)


HITS = "hits AS (SELECT qid, doc AS id, score FROM body)"


def _hits(spark, sf_dir):
    """Written once: votes read them twice, and they are sent to the links."""
    return materialise(body_hits(spark, sf_dir).select("qid", F.col("doc").alias("id"), "score"), "hits")


@query(ctes(X.NOTES, X.LINKS, EDGES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY, HITS) + "SELECT h.qid, h.id, round(0.15 * sum(o.score) / any_value(degree), 6) AS boost FROM hits h JOIN near ON a = h.id JOIN hits o ON o.qid = h.qid AND o.id = b JOIN degree ON node = h.id GROUP BY h.qid, h.id HAVING sum(o.score) > 0")
def gra4_boost(spark, sf_dir):
    return graph.adjust(_hits(spark, sf_dir), _edges(spark, sf_dir), 0.15)[0].select("qid", "id", F.round("boost", 6).alias("boost"))


@query(ctes(X.NOTES, X.LINKS, EDGES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY, HITS) + "SELECT h.qid, b AS id, round(0.15 * avg(h.score), 6) AS score, list_sort(list(h.id)) AS via FROM hits h JOIN near ON a = h.id LEFT JOIN hits o ON o.qid = h.qid AND o.id = b WHERE o.id IS NULL GROUP BY h.qid, b HAVING count(*) >= 2")
def gra4_expansion(spark, sf_dir):
    return graph.adjust(_hits(spark, sf_dir), _edges(spark, sf_dir), 0.15)[1].select("qid", "id", F.round("score", 6).alias("score"), "via")


BFS = """
origins AS (SELECT tag AS qid, min(id) AS id FROM notes GROUP BY tag),
one AS (SELECT DISTINCT qid, b AS id, o.id AS via FROM origins o JOIN near ON a = o.id WHERE b <> o.id),
front AS (SELECT one.* FROM one JOIN notes USING (id) WHERE status = 'active'),
seen AS (SELECT qid, id FROM origins UNION SELECT qid, id FROM one),
two AS (SELECT f.qid, b AS id, min(f.id) AS via FROM front f JOIN near ON a = f.id WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.qid = f.qid AND s.id = b) GROUP BY f.qid, b)"""


@query(ctes(X.NOTES, X.LINKS, EDGES, BFS) + "SELECT qid, id, 1 AS distance, via FROM front UNION ALL SELECT qid, id, 2, via FROM two JOIN notes USING (id) WHERE status = 'active'")
def gra5_walk_two_steps(spark, sf_dir):
    notes = X.notes(spark, sf_dir)
    origins = notes.groupBy(F.col("tag").alias("qid")).agg(F.min("id").alias("id"))
    return graph.traverse(origins, _edges(spark, sf_dir), notes, 2)


@query(
    ctes(X.NOTES, X.LINKS, EDGES).replace("WITH", "WITH RECURSIVE", 1)
    + """, origins AS (SELECT tag AS qid, min(id) AS id FROM notes GROUP BY tag),
walk AS (SELECT qid, id, 0 AS distance FROM origins UNION SELECT w.qid, b, distance + 1 FROM walk w JOIN near ON a = w.id JOIN notes n ON n.id = b WHERE status = 'active' AND distance < 40)
SELECT qid, id, min(distance)::INT AS distance FROM walk GROUP BY qid, id HAVING min(distance) > 0"""
)
def gra5_walk_all(spark, sf_dir):
    """All that each source's first note leads to, and how far it is."""
    notes = X.notes(spark, sf_dir)
    origins = notes.groupBy(F.col("tag").alias("qid")).agg(F.min("id").alias("id"))
    return graph.traverse(origins, _edges(spark, sf_dir), notes, None).select("qid", "id", "distance")


@query(ctes(X.NOTES, X.LINKS, EDGES, BFS) + "SELECT qid, id, 0.5::DOUBLE AS score FROM front")
def ret14_graph_search(spark, sf_dir):
    notes = X.notes(spark, sf_dir)
    origins = notes.groupBy(F.col("tag").alias("qid")).agg(F.min("id").alias("id"))
    return graph.walk_scores(graph.traverse(origins, _edges(spark, sf_dir), notes, 1)).select("qid", "id", "score")


@query(
    ctes(X.NOTES, X.LINKS, EDGES)
    + """SELECT id::VARCHAR AS id, coalesce(n, 0) AS degree, false AS phantom FROM notes LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) USING (id)
UNION ALL SELECT dst::VARCHAR, count(DISTINCT src), true FROM links WHERE NOT resolved GROUP BY dst"""
)
def gra11_graph_view(spark, sf_dir):
    return graph.export_nodes(X.notes(spark, sf_dir), X.links(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id AS note_id, doc_id * 1.0 AS x, n_chars * 1.0 AS y FROM documents), l AS (SELECT vec_id * 2 AS note_id, -1.0 AS x, label * 1.0 AS y, label % 2 = 0 AS pending FROM embeddings)
SELECT coalesce(s.note_id, l.note_id) AS note_id, (CASE WHEN coalesce(pending, false) OR s.x IS NULL THEN l.x ELSE s.x END)::DOUBLE AS x, (CASE WHEN coalesce(pending, false) OR s.x IS NULL THEN l.y ELSE s.y END)::DOUBLE AS y FROM s FULL JOIN l USING (note_id)""")
def gra14_merged_layout(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").cast("double").alias("x"), F.col("n_chars").cast("double").alias("y"))
    local = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("note_id"), F.lit(-1.0).alias("x"), F.col("label").cast("double").alias("y"), (F.col("label") % 2 == 0).alias("pending"))
    return graph.merge_layout(stored, local)


@query(ctes(X.NOTES, X.LINKS, EDGES, X.QUERIES_SQL, X.QUERY_TOKENS, BODY) + "SELECT qid, doc AS id, coalesce(list_sort(list(b) FILTER (WHERE status = 'active')), []) AS neighbours FROM (SELECT * FROM body WHERE rank <= 10) h LEFT JOIN near ON a = doc LEFT JOIN notes n ON n.id = b GROUP BY qid, doc")
def ret11_neighbours_of_hits(spark, sf_dir):
    top = body_hits(spark, sf_dir).where("rank <= 10").select("qid", F.col("doc").alias("id"))
    return graph.attach_neighbours(top, _edges(spark, sf_dir), X.notes(spark, sf_dir)).select("qid", "id", F.transform("neighbours", lambda n: n["neighbour"]).alias("neighbours"))


@query(ctes(X.LINKS) + "SELECT dst AS note_id, list_sort(list(anchor)) AS anchors FROM links WHERE resolved AND anchor IS NOT NULL GROUP BY dst")
def agg12_anchors(spark, sf_dir):
    return L.anchors_of(X.links(spark, sf_dir))


@query(ctes(X.LINKS) + "SELECT count(*) AS links, count(*) FILTER (WHERE NOT resolved) AS dangling FROM links")
def agg22_link_totals(spark, sf_dir):
    return L.sync_totals(X.links(spark, sf_dir))


#: Notes with ids, titles, aliases and source paths, and links that use each.
NAMED = """
named AS (SELECT 'DOC-' || (doc_id + 10000) AS id, 'Title ' || (doc_id // 2) AS title, 'nick ' || doc_id AS alias, source || '/f' || doc_id || '.md' AS path, source, doc_id FROM documents),
wanted AS (
  SELECT id AS src, id || ' any words' AS target, id AS dst, true AS resolved FROM named
  UNION ALL SELECT id, ' NICK ' || doc_id, id, true FROM named
  UNION ALL SELECT id, 'title ' || (doc_id // 2), min(id) OVER (PARTITION BY title), true FROM named
  UNION ALL SELECT id, './f' || doc_id || '.md', id, true FROM named
  UNION ALL SELECT id, '../' || source || '/x/../F' || doc_id, id, true FROM named
  UNION ALL SELECT id, '/' || source || '/f' || doc_id, id, true FROM named
  UNION ALL SELECT id, 'elsewhere/nick ' || doc_id || '.markdown', id, true FROM named
  UNION ALL SELECT id, 'DOC-0001', 'DOC-0001', false FROM named
  UNION ALL SELECT id, ' nothing ' || doc_id, 'nothing ' || doc_id, false FROM named)"""


@query(ctes(NAMED) + "SELECT src, target, dst, resolved FROM wanted")
def gra8_resolved_links(spark, sf_dir):
    d = F.col("doc_id")
    half = F.floor(d / 2)
    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("DOC-"), d + 10000).alias("id"), F.concat(F.lit("Title "), half).alias("title"), F.concat(F.lit("nick "), d).alias("alias"), F.concat("source", F.lit("/f"), d, F.lit(".md")).alias("path"), "source", "doc_id")
    forms = F.array(
        F.concat("id", F.lit(" any words")), F.concat(F.lit(" NICK "), d), F.concat(F.lit("title "), half), F.concat(F.lit("./f"), d, F.lit(".md")), F.concat(F.lit("../"), "source", F.lit("/x/../F"), d),
        F.concat(F.lit("/"), "source", F.lit("/f"), d), F.concat(F.lit("elsewhere/nick "), d, F.lit(".markdown")), F.lit("DOC-0001"), F.concat(F.lit(" nothing "), d),
    )
    links = named.select(F.col("id").alias("src"), F.explode(forms).alias("target"))
    return L.resolve(links, named, named.select(F.col("id").alias("note_id"), "alias"), named.select(F.col("id").alias("note_id"), F.col("path").alias("source_path")))


@query()
def gra12_communities(spark, sf_dir):
    """The documents' link graph, phantoms and all: each node's community, and how good the division is."""
    found, quality = communities.communities(X.links(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    return found.withColumn("modularity", F.lit(quality))


@query(
    ctes(X.LINKS)
    + """e AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst), d AS (SELECT doc_id AS id, source AS c FROM documents),
x AS (SELECT a.c AS ca, b.c AS cb FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst),
o AS (SELECT ca AS c, count(*) AS o, count(*) FILTER (WHERE ca = cb) AS inside FROM x GROUP BY ca), i AS (SELECT cb AS c, count(*) AS i FROM x GROUP BY cb)
SELECT sum(coalesce(o, 0))::BIGINT AS links, sum(coalesce(inside, 0))::BIGINT AS inside, round(sum(coalesce(inside, 0)) / sum(coalesce(o, 0)) - sum(coalesce(o, 0) * coalesce(i, 0))::DOUBLE / sum(coalesce(o, 0)) / sum(coalesce(o, 0)), 6) AS modularity FROM o FULL JOIN i USING (c)""".replace("e AS", ", e AS", 1)
)
def gra12_modularity_of_sources(spark, sf_dir):
    """How well the documents' sources divide their links."""
    division = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("community"))
    return communities.divided(X.links(spark, sf_dir), division).withColumn("modularity", F.round("modularity", 6))


@query()
def gra13_layout(spark, sf_dir):
    """Places of all documents by ten rounds of forces along their links."""
    return layout.arrange(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), X.links(spark, sf_dir), rounds=10)
