"""Stored indexes of text and vectors, and the snapshots that they live in."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvault.operators import retrieval, text_index, vector_index
from lumenvault.operators.text_index import TextIndex
from lumenvault.operators.vector_index import VectorIndex, recall_of
from lumenvault.sources.snapshots import Conflict, Snapshots

SF = "/root/testdata/sf0.001"


# Full text


def rows(df):
    return sorted((r.query, r.id, r.rank, round(r.score, 8)) for r in df.collect())


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(text_index, "RANGE_DOCS", 8)


def words(draw, n):
    return " ".join(draw.choices(["red", "blue", "fish", "bird", "stone", "tree", "q" + str(draw.randrange(40))], weights=[9, 5, 4, 3, 2, 1, 3], k=n))


def test_index_equals_scoring_all(spark, tmp_path, small_ranges):
    """After writes, replacements, removals and compaction, for several k and both forms of idf."""
    draw = random.Random(4)
    docs = {k: words(draw, draw.randrange(0, 30)) if k % 11 else None for k in range(160)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    queries = spark.createDataFrame([(1, "red stone"), (2, "tree Q3 q7"), (3, "nothing here"), (4, ""), (5, None), (6, "fish fish bird")], "query long, text string")
    index = TextIndex(spark, f"{tmp_path}/ix")

    def same(k, idf="plus"):
        wanted = retrieval.top(retrieval.bm25(frame(docs), queries, idf_variant=idf), k)
        assert rows(index.search(queries, k, idf_variant=idf)) == rows(wanted)

    index.write(frame(docs))
    same(3)
    same(3, "fts5")
    changed = {k: words(draw, 12) for k in (*range(0, 160, 3), 900, 901)}
    docs |= changed
    index.write(frame(changed))
    same(5)
    gone = list(range(0, 160, 5)) + [901]
    for k in gone:
        docs.pop(k)
    index.remove(spark.createDataFrame([(k,) for k in [*gone, 7777]], "id long"))
    same(5)
    back = {5: "stone tree red", 10: "tree"}
    docs |= back
    index.write(frame(back), gone=spark.createDataFrame([(900,)], "id long"))
    docs.pop(900)
    same(200)
    index.compact()
    same(4)
    assert index.versions.current()["docs"] == len(docs) and index.versions.version() == 5
    assert {n[:5] for n in index.versions.recover()} >= {"data-"}
    same(4)


def test_search_reads_asked_terms_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex(spark, f"{tmp_path}/ix")
    index.write(docs)
    wanted = spark.createDataFrame([("the",), ("zebra",)], "term string")
    plan = index.asked_blocks(wanted).select("n", "most", "least")._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "PushedFilters: [In(term" in plan
    assert "postings" not in plan.split("ReadSchema")[1]
    read = index.asked_blocks(wanted).select(F.input_file_name().alias("f")).distinct().collect()
    assert 1 <= len({r.f.split("bucket=")[1].split("/")[0] for r in read}) <= 2


def test_bounds_leave_ranges_unread(spark, tmp_path, small_ranges, monkeypatch):
    """Of many ranges a search for the best two scores few."""
    docs = spark.createDataFrame([(k, "rare " * (30 if k < 2 else 1) + "filler " * (k % 17 + 5)) for k in range(600)], "id long, text string")
    index = TextIndex(spark, f"{tmp_path}/ix")
    index.write(docs)
    queries = spark.createDataFrame([(1, "rare")], "query long, text string")
    seen = []
    plain = TextIndex._alive

    def counted(self, rows, now, key):
        if "part" in rows.columns:
            seen.append(rows.count())
        return plain(self, rows, now, key)

    monkeypatch.setattr(TextIndex, "_alive", counted)
    assert [r.id for r in index.search(queries, 2).orderBy("rank").collect()] == [0, 1]
    assert sum(seen) < 100


def test_weighted_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple", "x y z"), (2, "z", "apple apple"), (3, None, "w")], "id long, title string, body string")
    index = TextIndex(spark, f"{tmp_path}/ix", ("title", "body"))
    index.write(docs)
    queries = spark.createDataFrame([(1, "apple")], "query long, text string")
    assert [r.id for r in index.search(queries, 2).orderBy("rank").collect()] == [2, 1]
    assert [r.id for r in index.search(queries, 2, weights={"title": 10.0}).orderBy("rank").collect()] == [1, 2]


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/ix")
    index.write(spark.createDataFrame([], "id long, text string"))
    queries = spark.createDataFrame([(1, "apple")], "query long, text string")
    assert index.search(queries, 2).count() == 0
    index.write(spark.createDataFrame([(1, "apple")], "id long, text string"))
    assert [r.id for r in index.search(queries, 2).collect()] == [1]


# Vectors


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((40, 24))
    data = [(k, "s", (centres[k % 40] + 0.35 * draw.standard_normal(24)).tolist(), k % 9 != 4, k % 3) for k in range(3000)]
    data += [(9000 + k, "t", draw.standard_normal(24).tolist(), True, k % 3) for k in range(60)]
    data += [(9900, "s", [0.0] * 24, True, 0), (9901, "s", [1.0, 2.0], True, 0), (9902, "s", None, True, 0)]
    return spark.createDataFrame(data, "id long, scope string, vector array<double>, active boolean, grp int")


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    found = VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")))
    found.build(clustered, F.col("active"))
    return found


def asked(df, where):
    return df.where(where).select(F.col("id").alias("query"), "scope", "vector")


def plain_search(df, queries, k, group, threshold=500):
    data = [r for r in df.collect() if r.vector is not None]
    counts = {s: sum(r.active for r in df.where(F.col("scope") == s).collect()) for s in "st"}
    out = []
    for q in queries.collect():
        way = "index" if counts[q.scope] > threshold and len(q.vector) == 24 and any(q.vector) else "loop"
        v = np.array(q.vector)
        scored = sorted(((-round(float(v @ np.array(r.vector) / ((np.linalg.norm(v) + 1e-12) * (np.linalg.norm(r.vector) + 1e-12))), 9), r.id, r) for r in data if r.scope == q.scope and len(r.vector) == len(v) and (any(r.vector) or way == "loop")), key=lambda x: x[:2])
        if way == "index":
            scored = scored[: k * (4 if group else 2)]
        kept = [x for x in scored if x[2].active and (not group or x[2].grp == 1)]
        out += [(q.query, x[1], n + 1, way) for n, x in enumerate(kept[:k])]
    return sorted(out)


@pytest.mark.parametrize("group", [False, True])
def test_exact_index_and_loop(clustered, index, group):
    queries = asked(clustered, "id % 250 = 0 or id >= 9055").where("vector is not null")
    found = index.search(queries, 10, F.col("active"), F.col("grp") == 1 if group else None)
    assert sorted((r.query, r.id, r.rank, r.way) for r in found.collect()) == plain_search(clustered, queries, 10, group)


def test_recall_of_few_cells(clustered, index):
    queries = asked(clustered, "id % 50 = 0 and id < 3000")
    exact = index.search(queries, 10, F.lit(True))
    assert {r.way for r in exact.collect()} == {"index"}
    assert len(index.versions.read(index.versions.current()["folders"]["cells"]).collect()) > 40
    assert recall_of(index.search(queries, 10, F.lit(True), probes=6), exact) >= 0.95


def test_index_compares_cells_within_tasks(clustered, index, monkeypatch):
    """Only queries that go row by row are compared by expressions; queries in several blocks give the same."""
    queries = asked(clustered, "id % 50 = 0 and id < 3000")
    wanted = plain_search(clustered, queries, 10, True)

    def none(*_):
        raise AssertionError("pair by pair")

    monkeypatch.setattr(vector_index, "cosine", none)
    for size in (1 << 26, 5_000):
        monkeypatch.setattr(vector_index, "QUERY_BYTES", size)
        found = index.search(queries, 10, F.col("active"), F.col("grp") == 1)
        assert sorted((r.query, r.id, r.rank, r.way) for r in found.collect()) == wanted


def test_index_with_odd_vectors(spark, tmp_path):
    """Null and not finite components: such vectors are ranked as SQL ranks their scores, and spoil no cell."""
    draw = np.random.default_rng(4)
    rows = [(k, draw.standard_normal(6).tolist()) for k in range(700)] + [(700, [float("nan")] * 6), (701, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (702, [float("inf"), *[1.0] * 5])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    for ids in (F.col("id"), F.col("id").cast("string"), F.struct("id")):
        some = vectors.select(ids.alias("id"), F.lit(None).cast("string").alias("scope"), "vector")
        queries = vectors.where("id % 50 = 0 or id = 701").select(F.col("id").alias("query"), F.lit(None).cast("string").alias("scope"), "vector")
        found = VectorIndex(spark, f"{tmp_path}/{some.schema['id'].dataType.typeName()}")
        found.build(some, F.lit(True))
        show = lambda df: sorted(map(str, df.select("query", "id", "rank", F.round("score", 9).alias("score")).collect()))
        assert show(found.search(queries, 5, F.lit(True))) == show(retrieval.top(retrieval.vector_scores(some, queries), 5))


def test_empty_vector_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, scope string, vector array<double>, active boolean")
    found = VectorIndex(spark, f"{tmp_path}/v")
    found.build(none, F.col("active"))
    assert found.search(spark.createDataFrame([(1, "s", [1.0])], "query long, scope string, vector array<double>"), 3, F.col("active")).count() == 0
    assert vector_index.recall_of(none.withColumn("query", F.lit(1)), none.withColumn("query", F.lit(1))) == 0


# Snapshots


class Killed(Exception):
    pass


def test_killed_writer_leaves_old_or_new(spark, tmp_path, monkeypatch):
    """A rebuild is stopped before each of its steps in turn; readers see the whole old or the whole new snapshot."""
    table = lambda n: spark.createDataFrame([(k, n) for k in range(n)], "id long, of long")

    def rebuild(kept, n):
        base = kept.version()
        return kept.commit({"a": kept.write(table(n)), "b": kept.write(table(n).where("id > 0"))}, base)

    for stop in range(5):
        kept = Snapshots(spark, f"{tmp_path}/{stop}")
        rebuild(kept, 3)
        before, steps = kept.last_good(), [0]

        def step(real):
            def wrapped(*args, **kw):
                if steps[0] == stop:
                    raise Killed
                steps[0] += 1
                return real(*args, **kw)

            return wrapped

        dying = Snapshots(spark, f"{tmp_path}/{stop}")
        monkeypatch.setattr(dying, "write", step(dying.write))
        monkeypatch.setattr(dying, "_put", step(dying._put))
        monkeypatch.setattr(dying, "commit", step(dying.commit))
        died = False
        try:
            rebuild(dying, 5)
        except Killed:
            died = True
        now = kept.current()
        n = 3 if died else 5
        assert now["version"] == (1 if died else 2) and (kept.last_good() == before) == died
        assert kept.read(now["folders"]["a"]).count() == n and kept.read(now["folders"]["b"]).count() == n - 1
        kept.recover()
        assert {k for k in kept._names() if k.startswith("draft")} == set() and len([k for k in kept._names() if k.startswith("data")]) == 2
        assert kept.read(now["folders"]["a"]).count() == n
        assert rebuild(kept, 7) == now["version"] + 1


def test_two_writers_of_one_version(spark, tmp_path):
    kept = Snapshots(spark, f"{tmp_path}/s")
    folder = kept.write(spark.range(3))
    assert kept.current() is None and kept.last_good() is None and kept.version() == 0
    assert kept.commit({"a": folder}, 0, model="m") == 1
    with pytest.raises(Conflict):
        kept.commit({"a": folder}, 0)
    assert kept.current()["model"] == "m" and kept.read(folder).count() == 3
    assert kept.read(kept.write(spark.range(0).withColumn("p", F.lit(1)), ("p",))).count() == 0


def test_seed_from_a_sibling(spark, tmp_path):
    a, b, c = (Snapshots(spark, f"{tmp_path}/{n}") for n in "abc")
    assert not b.seed(a)
    a.commit({"chunks": a.write(spark.range(4)), "more": [a.write(spark.range(2)), a.write(spark.range(1))]}, 0, model="m")
    assert b.seed(a) and not b.seed(a) and b.current()["model"] == "m"
    a.drop()
    assert b.read(b.current()["folders"]["chunks"]).count() == 4 and b.read(b.current()["folders"]["more"][0]).count() == 2
    assert c.version() == 0


def test_writing_shuffles_texts_and_postings_once(spark, tmp_path, small_ranges):
    """Neither words nor texts go round again: what is dealt by range is counted there, and postings are dealt by folder and gathered there."""
    draw = random.Random(8)
    docs = spark.createDataFrame([(k, words(draw, 20)) for k in range(100)], "id long, text string")
    index = TextIndex(spark, f"{tmp_path}/once")
    plans, write = [], index.versions.write

    def seen(df, by=()):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(df, by)

    index.versions.write = seen
    index.write(docs.unionAll(docs.where("id < 5").withColumn("text", F.lit(""))))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1]
    assert not any("rangepartitioning" in p for p in plans)
    found = {(r.id, r.term): r.tf for r in index.postings().collect()}
    wanted = {(r.id, w): [r.text.split().count(w)] for r in docs.collect() for w in r.text.split()}
    assert found == wanted
