"""An index kept up to date by a stream of revisions.

Each burst of writes (a micro-batch) adds a folder of its own to every table, named
by the batch's number: the notes it touched, their passages now, their postings, the
vectors of texts that had none, and by how much counts changed. Nothing stored is
rewritten. A note's rows are those of the last batch that touched it; earlier ones
are dead, and a deleted note's last batch has none. Word and length counts are sums
of changes: what the touched notes have now less what they had.

A batch counts once its number is in ``commits``, which is written last, so one that
broke off is invisible; when it comes again it is made from the batches before it
alone and overwrites its own folders: a batch that is replayed, even after others,
changes nothing. Writes that are no newer than what is stored are left out.

``compact`` writes the living rows as one batch of a new generation, in which reading
goes on once it is committed; a stream that is down meanwhile resumes on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as T
from ..operators import lexical
from ..plans import index as plan
from ..storage import drop, materialise
from .reindex import latest_writes

#: passages: what cut gives; the rest is as a lexical index and the store have it.
SCHEMAS = {
    "heads": "note_id string, rev int, deleted boolean",
    "passages": "id long, note_id string, strategy string, ord int, heading_path string, kind string, text string, text_hash string",
    "postings": "note_id string, field string, token string, doc long, tf long, len int",
    "vectors": "text_hash string, vec array<float>",
    "words": "field string, token string, change long",
    "sizes": "field string, docs long, length long",
}


def passages_of(settings: dict | None = None, space: str = "live") -> Callable[[DataFrame], DataFrame]:
    """Cuts notes into passages, as an index run does."""

    def cut(notes: DataFrame) -> DataFrame:
        rows = plan.cut(notes, space, settings).withColumn("ord", F.col("ord").cast("int"))
        return rows.select("id", "note_id", "strategy", "ord", "heading_path", "kind", "text", "text_hash", "embed_text")

    return cut


def whole_notes(notes: DataFrame) -> DataFrame:
    """Each note as one passage."""
    text = F.coalesce("body", F.lit(""))
    return notes.select(F.xxhash64("id").alias("id"), F.col("id").alias("note_id"), F.lit("note").alias("strategy"), F.lit(0).alias("ord"), F.lit("").alias("heading_path"), F.lit("prose").alias("kind"), text.alias("text"), F.sha2(text, 256).alias("text_hash"), text.alias("embed_text"))


class LiveIndex:
    """Tables under a folder that all machines share. model None: no vectors."""

    def __init__(self, spark: SparkSession, path: str, model: embedding.Model | None = None, cut: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.model, self.cut = spark, path.rstrip("/"), model, cut or passages_of()

    # ---- folders ----

    def _names(self, path: str) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def generation(self) -> int:
        """The last one that has a committed batch."""
        made = sorted((int(n.removeprefix("gen-")) for n in self._names(self.path) if n.startswith("gen-")), reverse=True)
        return next((g for g in made if self._commits(g)), 0)

    def _commits(self, generation: int) -> list[int]:
        folder = f"{self.path}/gen-{generation}/commits"
        done = [n for n in self._names(folder) if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in done if "_SUCCESS" in self._names(f"{folder}/{n}"))

    def _put(self, generation: int, table: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/gen-{generation}/{table}/batch={batch}")

    def _read(self, table: str, before: int | None = None) -> DataFrame:
        """A table's rows of the committed batches (before one), with their batch."""
        g = self.generation()
        root = f"{self.path}/gen-{g}/{table}"
        paths = [f"{root}/batch={b}" for b in self._commits(g) if before is None or b < before]
        schema = SCHEMAS[table] + ", batch int"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- what there is now ----

    def _heads(self, before: int | None = None) -> DataFrame:
        """(note_id, rev, deleted, batch): of each note the last batch's."""
        row = F.struct("batch", "rev", "deleted")
        return self._read("heads", before).groupBy("note_id").agg(F.max(row).alias("h")).select("note_id", "h.rev", "h.deleted", "h.batch")

    def _living(self, table: str, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        heads = self._heads(before).where("not deleted")
        heads = heads if of is None else heads.join(of.select("note_id"), "note_id", "left_semi")
        return self._read(table, before).join(heads.select("note_id", "batch"), ["note_id", "batch"], "left_semi").drop("batch")

    def heads(self) -> DataFrame:
        return self._heads().where("not deleted").select("note_id", "rev")

    def passages(self) -> DataFrame:
        return self._living("passages")

    def vectors(self) -> DataFrame:
        """(text_hash, vec) of texts that a passage has."""
        return self._read("vectors").drop("batch").join(self.passages().select("text_hash"), "text_hash", "left_semi")

    def words(self) -> DataFrame:
        """(field, token, df)."""
        return self._read("words").groupBy("field", "token").agg(F.sum("change").alias("df")).where("df > 0")

    def fields(self) -> DataFrame:
        """(field, n, avg_len)."""
        sums = self._read("sizes").groupBy("field").agg(F.sum("docs").alias("n"), F.sum("length").alias("length"))
        return sums.where("n > 0").select("field", "n", (F.col("length") / F.col("n")).alias("avg_len"))

    def lexical(self) -> lexical.LexicalIndex:
        return lexical.LexicalIndex(self._living("postings").drop("note_id").join(self.words(), ["field", "token"]), self.fields())

    # ---- what a burst changes ----

    def apply(self, writes: DataFrame, number: int) -> None:
        """Indexes a burst's writes (revisions; op delete takes a note out) as batch
        number. Fields: text and heading_path."""
        g = self.generation()
        if g and number <= self._commits(g)[0]:  # within what was compacted
            return
        known = self._heads(number).select("note_id", F.col("rev").alias("known"))
        fresh = latest_writes(writes).join(known, "note_id", "left").where("known is null or rev > known").drop("known")
        fresh = materialise(fresh.withColumn("deleted", F.col("op") == "delete"), "live-writes")
        notes = fresh.where("not deleted").select(F.col("note_id").alias("id"), "title", "body", F.lit("en").alias("lang"), F.lit("active").alias("status"), "rev")
        cut = materialise(self.cut(notes), "live-passages")
        postings = materialise(self._postings(cut), "live-postings")
        old = self._living("postings", number, fresh)
        one = F.count(F.lit(1))
        count = lambda df, sign: df.groupBy("field", "token").agg((one * sign).alias("change"))
        words = count(postings, 1).unionByName(count(old, -1)).groupBy("field", "token").agg(F.sum("change").alias("change")).where("change != 0")
        size = lambda df, sign: self._stacked(df).groupBy("field").agg((one * sign).alias("docs"), (F.sum(F.size("tokens")) * sign).alias("length"))
        sizes = size(cut, 1).unionByName(size(self._living("passages", number, fresh), -1)).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))
        vectors = self.spark.createDataFrame([], SCHEMAS["vectors"])
        if self.model is not None:
            texts = cut.groupBy("text_hash").agg(F.min("embed_text").alias("t")).join(self._read("vectors", number), "text_hash", "left_anti")
            vectors = texts.select("text_hash", embedding.embed(F.col("t"), self.model).alias("vec"))
        made = {"heads": fresh.select("note_id", "rev", "deleted"), "passages": cut.drop("embed_text"), "postings": postings, "vectors": vectors, "words": words, "sizes": sizes}
        for table, df in made.items():
            self._put(g, table, number, df)
        self._put(g, "commits", number, self.spark.range(1))
        for used in (fresh, cut, postings):
            drop(used)

    @staticmethod
    def _stacked(cut: DataFrame) -> DataFrame:
        """(note_id, doc, field, tokens) of passages."""
        fields = F.array(*[F.struct(F.lit(f).alias("field"), T.search_tokens(F.coalesce(f, F.lit(""))).alias("tokens")) for f in ("text", "heading_path")])
        return cut.select("note_id", F.col("id").alias("doc"), F.explode(fields).alias("f")).select("note_id", "doc", "f.*")

    def _postings(self, cut: DataFrame) -> DataFrame:
        rows = self._stacked(cut).select("note_id", "doc", "field", F.size("tokens").alias("len"), "tokens").select("note_id", "doc", "field", "len", F.explode("tokens").alias("token"))
        return rows.groupBy("note_id", "field", "token", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")).select("note_id", "field", "token", "doc", "tf", "len")

    def compact(self) -> None:
        """The living rows as the last committed batch of a new generation."""
        g = self.generation()
        done = self._commits(g)
        if len(done) < 2:
            return
        heads = self._heads().select("note_id", "rev", "deleted")
        now = {"heads": heads, "passages": self.passages(), "postings": self._living("postings"), "vectors": self.vectors(), "words": self.words().select("field", "token", F.col("df").alias("change")), "sizes": self._read("sizes").groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))}
        for table, df in now.items():
            self._put(g + 1, table, done[-1], df)
        self._put(g + 1, "commits", done[-1], self.spark.range(1))
