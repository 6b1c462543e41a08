"""A stored inverted index of full text, searched for the best k.

An index is a list of segments. A segment deals its documents to ranges by a hash and holds for each term and range one
block: the postings, and in columns of their own how many they are, their highest frequencies and their least length. Those
bound what any document of the range can score, so a search reads the bounds of the asked terms only, scores the most promising ranges of a query
whole, and then only the ranges that could still hold one of the best k (block-max pruning). Blocks lie in folders by
a hash of the term, so other terms' folders are not read.

Writing and removing documents add a segment and corrections (document frequencies, sizes and the ids whose older postings no longer
count); nothing is changed in place, and a version is one manifest (``sources.snapshots``). ``compact`` makes one segment of
all. Scores are those of ``retrieval.bm25`` over the documents as they are now; with several columns a term's frequency in a
document is the weighted sum of its frequencies, as the weights of a search say.

Ids are unique and not null; of a write's rows with equal ids the columns are those of the last by content. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenvault.operators.graph import cut, release
from lumenvault.operators.retrieval import B, K1, LOOKUP_TERMS, query_terms, terms, top
from lumenvault.sources.snapshots import Snapshots

#: Folders that terms are dealt to.
BUCKETS = 64
#: Documents of a range, about.
RANGE_DOCS = 512
#: Ranges of a folder whose blocks one task sorts; more are dealt to several.
RANGES_OF_TASK = 1024
#: Scores are compared to nine decimals, so bounds within this of a limit are not passed over.
SLACK = 2e-9


def _bucket(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


class TextIndex:
    """An index of documents (id, columns...) in a shared folder."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = ("text",)):
        self.spark, self.columns, self.versions = spark, columns, Snapshots(spark, root)

    # Writing

    def _segment(self, docs: DataFrame, base: DataFrame | None, gone: DataFrame | None, number: int) -> dict[str, str]:
        """The folders of a segment: blocks and forward rows of docs, and what they and ``gone`` change of older segments."""
        # Texts are shuffled once, to the task of their range; equal ids meet there, and their terms are counted there.
        ranges = max(1, -(-docs.count() // RANGE_DOCS))
        at_home = docs.select("id", *self.columns, _bucket(F.col("id"), ranges).alias("range")).repartition("range")
        one = at_home.groupBy("range", "id").agg(F.max(F.struct(*self.columns)).alias("d")).select("range", "id", "d.*")
        places = [f"_{k}" for k in range(len(self.columns))]
        lists = one.select("range", "id", *(terms(F.coalesce(F.col(c), F.lit(""))).alias(p) for c, p in zip(self.columns, places)))
        length = sum((F.size(p) for p in places[1:]), F.size(places[0]))
        told = F.concat(*(F.arrays_zip(F.col(p).alias("term"), F.array_repeat(F.lit(k), F.size(p)).alias("at")) for k, p in enumerate(places)))
        each = lists.select("range", "id", length.alias("length"), F.explode_outer(told).alias("x")).select("range", "id", "length", F.col("x")["term"].alias("term"), F.col("x")["at"].alias("at"))
        counted = each.groupBy("range", "id", "length", "term").agg(*(F.count_if(F.col("at") == k).cast("int").alias(p) for k, p in enumerate(places)))
        # Terms with their counts, one row for each document; blocks are made of these, so texts are parted once.
        kept = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", F.array(*places).alias("tf"))))
        rows = counted.groupBy("range", "id", "length").agg(kept.alias("_told")).select("range", "id", "length", F.col("_told.term").alias("terms"), F.col("_told.tf").alias("tfs"))
        folders = {"forward": self.versions.write(rows.withColumn("segment", F.lit(number)))}
        new = self.versions.read(folders["forward"])
        n_docs, total = new.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        folders["blocks"] = self._write_blocks(new, ranges, number)
        old = None
        if base is not None:
            touched = cut(new.select("id").union(gone.select("id")).distinct() if gone is not None else new.select("id"))
            old = cut(base.join(touched, "id", "left_semi"))
            folders["dead"] = self.versions.write(touched.select("id", F.lit(number).alias("before")))
            less = old.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("less"))
            folders["less"] = self.versions.write(less.withColumn("bucket", _bucket(F.col("term"), BUCKETS)), ("bucket",))
            fewer, shorter = old.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            n_docs, total = n_docs - fewer, total - shorter
            release(touched, old)
        return {**folders, "docs": n_docs, "length": total}

    def _write_blocks(self, forward: DataFrame, ranges: int, number: int) -> str:
        """The folder of the blocks of forward rows (range, id, length, terms, tfs).

        Postings are shuffled once, to the task of their folder, and gathered to blocks there; a term's blocks are sorted together, so a file's statistics of terms leave most of it unread.
        """
        each = forward.select("range", "id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        posting = F.struct("id", "length", F.col("x")["tfs"].alias("tf"))
        placed = each.select(F.col("x")["terms"].alias("term"), "range", posting.alias("p"))
        # Terms of a folder are dealt to more tasks where there are more ranges than one task sorts.
        some = 1 + ranges // RANGES_OF_TASK
        dealt = placed.withColumns({"bucket": _bucket(F.col("term"), BUCKETS), "_part": F.pmod(F.xxhash64("term", F.lit(1)), F.lit(some))}).repartition(BUCKETS * some, "bucket", "_part")
        most = [F.max(F.col("p.tf")[k]) for k in range(len(self.columns))]
        blocks = dealt.groupBy("bucket", "_part", "term", "range").agg(F.count("*").alias("n"), F.array(*most).alias("most"), F.min("p.length").alias("least"), F.collect_list("p").alias("postings"))
        named = blocks.select("term", "range", "n", "most", "least", "postings", F.lit(number).alias("segment"), "bucket")
        return self.versions.write(named.sortWithinPartitions("bucket", "term", "range"), ("bucket",))

    def _commit(self, made: dict, now: dict | None) -> int:
        before = now["folders"] if now else {}
        folders = {name: [*before.get(name, []), *([made[name]] if name in made else [])] for name in ("blocks", "forward", "dead", "less")}
        docs, length = (now["docs"], now["length"]) if now else (0, 0)
        return self.versions.commit(folders, now["version"] if now else 0, docs=docs + made["docs"], length=length + made["length"], segments=(now["segments"] if now else 0) + 1, columns=list(self.columns))

    def write(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """M2: the version after documents (id, columns...) were added, or took the place of older ones, and the ids of ``gone`` (id) were removed."""
        now = self.versions.current()
        return self._commit(self._segment(docs, self._live_forward(now) if now else None, gone, now["segments"] if now else 0), now)

    def remove(self, ids: DataFrame) -> int:
        """The version after the documents of ids (id) were removed."""
        none = self.spark.createDataFrame([], ids.select("id").schema).select("id", *(F.lit(None).cast("string").alias(c) for c in self.columns))
        return self.write(none, ids)

    def compact(self) -> int:
        """The version in which all segments are one and nothing dead is left."""
        now = self.versions.current()
        n_docs = now["docs"]
        ranges = max(1, -(-n_docs // RANGE_DOCS))
        # Blocks of all are made of the live forward rows: no posting is looked up among the dead ones.
        live = self._live_forward(now).withColumns({"range": _bucket(F.col("id"), ranges), "segment": F.lit(0)}).repartition("range")
        forward = self.versions.write(live)
        made = {"forward": [forward], "blocks": [self._write_blocks(self.versions.read(forward), ranges, 0)]}
        return self.versions.commit({**made, "dead": [], "less": []}, now["version"], docs=n_docs, length=now["length"], segments=1, columns=list(self.columns))

    # Reading

    def _all(self, now: dict, name: str) -> DataFrame | None:
        """The rows of a name's folders; each is a table of its own with the same partitions."""
        found = None
        for folder in now["folders"][name]:
            part = self.versions.read(folder)
            found = part if found is None else found.unionByName(part)
        return found

    def _blocks(self, now: dict) -> DataFrame:
        return self._all(now, "blocks")

    def _dead(self, now: dict) -> DataFrame | None:
        dead = self._all(now, "dead")
        return None if dead is None else dead.groupBy("id").agg(F.max("before").alias("before"))

    def _alive(self, rows: DataFrame, now: dict, key: str) -> DataFrame:
        """rows with a segment and an id in column ``key`` that no later segment took the place of."""
        dead = self._dead(now)
        if dead is None:
            return rows
        return rows.join(dead.withColumnRenamed("id", "_dead"), (F.col(key) == F.col("_dead")) & (F.col("segment") < F.col("before")), "left_anti")

    def _live_forward(self, now: dict) -> DataFrame:
        return self._alive(self._all(now, "forward"), now, "id")

    def postings(self) -> DataFrame:
        """M2: (id, term, tf) as they are now, tf an array of one number for each column."""
        now = self.versions.current()
        if not now["folders"]["dead"]:
            return self._blocks(now).select("term", F.explode("postings").alias("p")).select("p.id", "term", "p.tf")
        # Where some are dead, documents are looked up among the dead ones, not each of their postings.
        return self._live_forward(now).select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", F.col("x")["terms"].alias("term"), F.col("x")["tfs"].alias("tf"))

    def asked_blocks(self, wanted: DataFrame, now: dict | None = None) -> DataFrame:
        """The blocks of wanted terms (term): only their folders are read if the terms are few."""
        now = now or self.versions.current()
        few = [r.term for r in wanted.select("term").distinct().limit(LOOKUP_TERMS + 1).collect()]
        return self._asked(self._blocks(now), wanted, few)

    def _asked(self, rows: DataFrame, wanted: DataFrame, few: list[str]) -> DataFrame:
        if len(few) > LOOKUP_TERMS:
            return rows.join(wanted.select("term").distinct(), "term", "left_semi")
        if not few:
            return rows.where("false")
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in few], "term string").select(_bucket(F.col("term"), BUCKETS)).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(few))

    def search(self, queries: DataFrame, k: int, weights: dict[str, float] | None = None, k1: float = K1, b: float = B, idf_variant: str = "plus") -> DataFrame:
        """(query, id, score, rank): the best k documents of each query (query, text) by BM25, ties by the smallest id.

        weights: of columns, 1 each if not given. The rows equal those of scoring every document.
        """
        now = self.versions.current()
        wanted = cut(queries.select("query", F.explode(query_terms(F.col("text"))).alias("term")))
        few = [r.term for r in wanted.select("term").distinct().limit(LOOKUP_TERMS + 1).collect()]
        blocks = self._asked(self._blocks(now), wanted, few)
        spread = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        less = self._all(now, "less")
        if less is not None:
            fewer = self._asked(less, wanted, few).groupBy("term").agg(F.sum("less").alias("less"))
            spread = spread.join(fewer, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df")).where("df > 0")
        n_docs, mean = now["docs"], now["length"] / max(now["docs"], 1)
        ratio = (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)
        idf = F.greatest(F.lit(1e-6), F.log(ratio)) if idf_variant == "fts5" else F.log(1 + ratio)
        share = [float((weights or {}).get(c, 1.0)) for c in self.columns]

        def part(tf: Column, length: Column) -> Column:
            f = sum((tf[i] * w for i, w in enumerate(share[1:], 1)), tf[0] * share[0])
            return F.col("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * length / F.lit(float(mean or 1))))

        asked = cut(wanted.join(spread.select("term", idf.alias("idf")), "term"))
        # Bounds without postings: what a document of the range could have at most.
        bounds = blocks.select("term", "segment", "range", "most", "least").join(asked, "term")
        places = cut(bounds.groupBy("query", "segment", "range").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound")))
        # The best k lie in k ranges at most: those of the highest bounds give a limit, if they hold k documents.
        promising = Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "range")
        first = cut(places.withColumn("_r", F.row_number().over(promising)).where(F.col("_r") <= k).select("query", "segment", "range"))

        def scored(some: DataFrame) -> DataFrame:
            """(query, id, score) of all live documents of some ranges (query, segment, range)."""
            rows = blocks.select("term", "segment", "range", "postings").join(asked.join(some, "query"), ["term", "segment", "range"])
            each = rows.select("query", "idf", "segment", F.explode("postings").alias("p")).select("query", "idf", "segment", F.col("p.id").alias("id"), part(F.col("p.tf"), F.col("p.length")).alias("part"))
            return self._alive(each, now, "id").groupBy("query", "id").agg(F.sum("part").alias("score"))

        early = cut(scored(first))
        limits = top(early, k).groupBy("query").agg(F.min("score").alias("limit"), F.count("*").alias("m")).where(F.col("m") == k)
        open_ = places.join(first, ["query", "segment", "range"], "left_anti").join(limits, "query", "left")
        later = scored(open_.where(F.col("bound") >= F.coalesce("limit", F.lit(0.0)) - SLACK).select("query", "segment", "range"))
        found = cut(top(early.unionByName(later), k))
        release(wanted, asked, places, first, early)
        return found
