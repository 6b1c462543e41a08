"""The knowledge store: predicates, lookups, merging, corrections and consolidation.

Every update is a projection of a snapshot to the next one; nothing is changed in
place. Predicates on pairs are evaluated by groups and ranges, not by pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.functions.scores import first_confidence, raised_confidence
from lumenvault.functions.text import content_key

NEARBY_LINES = 5


def in_scope(owner: str, codebase: str, repo: str | None = None) -> Column:
    """Rows of one tenant, and of one repo."""
    found = (F.col("owner") == owner) & (F.col("codebase") == codebase)
    return found & (F.col("repo") == repo) if repo is not None else found


def active() -> Column:
    """Neither retired nor superseded."""
    return F.col("invalid_at").isNull() & F.col("superseded_by").isNull()


def recallable() -> Column:
    """Not retired; superseded rows are recalled."""
    return F.col("invalid_at").isNull()


def list_items(items: DataFrame, owner: str, codebase: str, kind: str | None = None, include_invalid: bool = False) -> DataFrame:
    """Items of a scope, the last updated first."""
    found = items.where(in_scope(owner, codebase))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if not include_invalid:
        found = found.where(active())
    return found.orderBy(F.desc("updated_at"), "item")


def resolve_prefix(ids: DataFrame, wanted: DataFrame, least: int = 4) -> DataFrame:
    """S3: (wanted, id): the exact id, else the only id that begins so, else null.

    ids (id), no id twice, and wanted (wanted), no prefix twice. An id is cut to each of the lengths that prefixes have, ``least`` or more, and
    cuts are counted before they meet prefixes, so no two rows of one head are compared; shorter prefixes are exact ids only.
    """
    # At most as many lengths as an id has characters.
    lengths = [r[0] for r in wanted.select(F.length("wanted")).where(F.length("wanted") >= least).distinct().collect()]
    cuts = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("id"))
    heads = ids.select("id", F.explode(cuts).alias("n")).groupBy(F.substring("id", F.lit(1), F.col("n")).alias("wanted"))
    by_head = heads.agg(F.count("id").alias("n"), F.min("id").alias("only"), F.bool_or(F.length("id") == F.col("n")).alias("same"))
    exact = ids.where(F.length("id") < least).groupBy(F.col("id").alias("wanted")).agg(F.count("id").alias("n"), F.min("id").alias("only"), F.lit(True).alias("same"))
    known = by_head.unionByName(exact).select("wanted", F.when(F.col("same"), F.col("wanted")).when(F.col("n") == 1, F.col("only")).alias("id"))
    return wanted.join(known, "wanted", "left")


def contradictions(items: DataFrame, least: float = 0.5) -> DataFrame:
    """The facts and lessons (item) that have another on the same subject with another conclusion.

    Two lessons that both have a symptom share a subject if the symptoms are equal; if
    either has none, if their first evidence is near: the same file, within five lines, no line being 0. An empty root
    cause equals none. Facts share a subject if they are of equal detail and near, and conclude in their
    summaries. Items without evidence are near none. Pairs are never formed: of each line only the extremes of what
    is said there matter to its neighbours.
    """
    sure = items.where(F.col("confidence") >= least)
    first = F.get("evidence", F.lit(0))
    scope = ["owner", "codebase"]
    symptom, cause = content_key(F.coalesce("symptom", F.lit(""))), content_key(F.coalesce("root_cause", F.lit("")))
    lessons = sure.where("kind = 'bug_lesson'").select("item", *scope, symptom.alias("subject"), F.nullif(cause, F.lit("")).alias("said"), first["file"].alias("file"), F.coalesce(first["line"], F.lit(0)).alias("line"))
    told = lessons.where("subject <> ''").groupBy(*scope, "subject").agg(F.count("*").alias("n"), F.count("said").alias("n_said"), F.min("said").alias("low"), F.max("said").alias("high"))
    split = told.where("n > 1 and (n_said < n or low <> high)").select(*scope, "subject")
    by_symptom = lessons.join(split, [*scope, "subject"], "left_semi").select("item")

    bare = F.col("subject") == ""
    place = [*scope, "file", "line"]
    lines = lessons.where("file is not null").groupBy(*place).agg(
        F.count("*").alias("n"), F.count("said").alias("n_said"), F.min("said").alias("low"), F.max("said").alias("high"),
        F.count_if(bare).alias("m"), F.count(F.when(bare, F.col("said"))).alias("m_said"), F.min(F.when(bare, F.col("said"))).alias("bare_low"), F.max(F.when(bare, F.col("said"))).alias("bare_high"),
    )
    near = Window.partitionBy(*scope, "file").orderBy("line").rangeBetween(-NEARBY_LINES, NEARBY_LINES)
    of = {"n": F.sum, "n_said": F.sum, "low": F.min, "high": F.max, "m": F.sum, "m_said": F.sum, "bare_low": F.min, "bare_high": F.max}
    around = lessons.join(lines.select(*place, *(f(c).over(near).alias(c) for c, f in of.items())), place)
    # One without a symptom meets all lessons near it, one with a symptom only those without.
    unlike = lambda n, said, low, high: (n > said) | F.coalesce((low != F.col("said")) | (high != F.col("said")), F.lit(False))
    meets_all = F.when(F.col("said").isNull(), F.col("n") > 1).otherwise(unlike(F.col("n"), F.col("n_said"), F.col("low"), F.col("high")))
    meets_bare = F.when(F.col("said").isNull(), F.col("m") > 0).otherwise(unlike(F.col("m"), F.col("m_said"), F.col("bare_low"), F.col("bare_high")))
    by_place = around.where(F.when(bare, meets_all).otherwise(meets_bare)).select("item")

    facts = sure.where("kind = 'fact'").select("item", *scope, F.coalesce("kind_detail", F.lit("")).alias("detail"), first["file"].alias("file"), F.coalesce(first["line"], F.lit(0)).alias("line"), content_key(F.coalesce("summary", F.lit(""))).alias("said")).where("file is not null")
    keys = [*scope, "detail", "file", "line"]
    extremes = facts.groupBy(*keys).agg(F.min("said").alias("low"), F.max("said").alias("high"))
    near = Window.partitionBy(*keys[:-1]).orderBy("line").rangeBetween(-NEARBY_LINES, NEARBY_LINES)
    unlike_lines = extremes.select(*keys, F.min("low").over(near).alias("l"), F.max("high").over(near).alias("h")).where("l <> h").select(*keys)
    # A fact is flagged only if one near it says something else than it does itself.
    heard = extremes.select(*keys, F.min("low").over(near).alias("l"), F.max("high").over(near).alias("h")).join(unlike_lines, keys, "left_semi")
    by_summary = facts.join(heard, keys).where("l <> said or h <> said").select("item")
    return by_symptom.union(by_place).union(by_summary).distinct()


def related(items: DataFrame, cap: int = 20) -> DataFrame:
    """(item, related): items of the same scope and kind among whose evidence files or blast radius is one of
    the item's evidence files, at most ``cap``, smallest ids first. Items without evidence have none.
    """
    keys = ["owner", "codebase", "kind", "file"]
    scope = items.select("item", *keys[:-1], F.transform(F.coalesce("evidence", F.array()), lambda e: e["file"]).alias("own"), F.coalesce("blast_radius", F.array()).alias("radius"))
    mine = scope.select("item", *keys[:-1], F.explode(F.array_distinct("own")).alias("file")).where("file is not null")
    theirs = scope.select("item", *keys[:-1], F.explode(F.array_union("own", "radius")).alias("file")).where("file is not null")
    # A group's first cap + 1 ids are all that any of its members can list.
    firsts = theirs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("item"))).where(F.col("rank") <= cap + 1)
    listed = firsts.groupBy(*keys).agg(F.collect_list("item").alias("members"))
    found = mine.join(listed, keys).select("item", F.explode("members").alias("other")).where("item <> other").distinct()
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("other"))).where(F.col("rank") <= cap)
    lists = best.groupBy("item").agg(F.array_sort(F.collect_list("other")).alias("related"))
    return items.select("item").join(lists, "item", "left").select("item", F.coalesce("related", F.array()).alias("related"))


def duplicate_clusters(vectors: DataFrame, least: float = 0.92) -> DataFrame:
    """(kind, cluster, n): clusters of two or more items (id, kind, vector) with a cosine of at least ``least``, domain knowledge left out."""
    from lumenvault.operators.graph import components
    from lumenvault.operators.retrieval import vector_duplicates

    meant = vectors.where("kind <> 'domain_knowledge'")
    grouped = components(vector_duplicates(meant, least))
    return meant.join(grouped, meant.id == grouped.node).groupBy("kind", F.col("component").alias("cluster")).agg(F.count("*").alias("n")).where("n >= 2")


def with_vectors(stored: DataFrame, new: DataFrame, size: int) -> DataFrame:
    """M3: the vectors (id, vector) after new ones were written: by id, zero vectors and those of another size left out."""
    good = new.where((F.size("vector") == size) & F.exists("vector", lambda x: x != 0))
    return stored.join(good.select("id"), "id", "left_anti").unionByName(good.select("id", "vector"))


def with_postings(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """M2: postings (id, term, tf) after the texts of changed items (id, text) were written: their old ones go, their new ones come."""
    from lumenvault.operators.retrieval import terms

    fresh = changed.select("id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return postings.join(changed.select("id"), "id", "left_anti").unionByName(fresh)


def set_fields(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """M9: stored with the kind, confidence and tags of changes (item, kind, confidence, tags), null where a field stays."""
    new = changes.select("item", *(F.col(c).alias(f"_{c}") for c in ("kind", "confidence", "tags")))
    both = stored.join(new, "item", "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("kind", "confidence", "tags") else F.col(c) for c in stored.columns))


def memorize(stored: DataFrame, batch: DataFrame, step: float = 0.3) -> DataFrame:
    """M5: the snapshot after a batch (item, kind, tier, tags, evidence, at, owner, codebase, blast_radius, corrects): linked, merged, corrected.

    New items see the store as it was before the batch, and not each other; corrections (corrects: an item, or null) count at once,
    for items of the batch too. Columns: those of ``mention`` and related.
    """
    links = shared_files(stored, batch).withColumnRenamed("links", "related")
    after = mention(stored.select("item", "kind", "tier", "confidence", "created_at", "tags", "evidence", "corrected_by", "invalid_at", "superseded_by", "access_count"), batch.select("item", "kind", "tier", "tags", "evidence", "at"), step)
    told = batch.where("corrects is not null and corrects <> item").select(F.col("corrects").alias("item"), F.col("item").cast("string").alias("by"))
    return mark_corrected(after, told).join(links, "item", "left").withColumn("related", F.coalesce("related", F.array()))


#: Columns that a write by id leaves as they are.
KEPT = ("created_at", "owner", "codebase")


def upsert(stored: DataFrame, new: DataFrame, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """M1: the snapshot after new rows were written by item: all columns are the new row's but those of ``kept``; rows of both have the same columns, whichever these are."""
    there = F.struct(F.lit(True).alias("_there"))
    s, n = stored.withColumn("_row", there).alias("s"), new.select(*stored.columns).withColumn("_row", there).alias("n")
    both = s.join(n, F.col("s.item") == F.col("n.item"), "full_outer")
    old, come = F.col("s._row").isNotNull(), F.col("n._row").isNotNull()
    pick = lambda c: F.when(old & F.lit(c in kept), F.col(f"s.{c}")).when(come, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select(*(pick(c).alias(c) for c in stored.columns))


def shared_files(stored: DataFrame, batch: DataFrame, cap: int = 20) -> DataFrame:
    """U4: (item, links): for items of a batch the active stored items of their scope and kind, in whose evidence or blast radius one of their evidence files is, the first ``cap``."""
    keys = ["owner", "codebase", "kind", "file"]
    own = batch.select("item", *keys[:-1], F.explode(F.array_distinct(F.transform("evidence", lambda e: e["file"]))).alias("file"))
    there = stored.where(active()).select(F.col("item").alias("other"), *keys[:-1], F.explode(F.array_union(F.transform("evidence", lambda e: e["file"]), "blast_radius")).alias("file"))
    firsts = there.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("other"))).where(F.col("r") <= cap + 1)
    met = own.join(firsts, keys).where("item <> other").select("item", "other").distinct()
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("other"))).where(F.col("r") <= cap)
    return ranked.groupBy("item").agg(F.array_sort(F.collect_list("other")).alias("links"))


def remember(stored: DataFrame, batch: DataFrame, step: float = 0.3, cap: int = 20, safe: bool = False) -> DataFrame:
    """The snapshot of all columns after a batch was linked, merged, written and its corrections marked.

    batch has the columns of stored, and corrects (an item, or null). A confidence of 0 is taken from the tier. Links are those that the
    batch brings and those of ``shared_files``, the first ``cap``. An id that is there and active is a re-mention: its
    confidence rises, its access count, valid_at, links and evidence stay and are united with the new ones (links without a cap), the earlier created_at counts. Then rows
    are written by id (``upsert``), so of a row that is there and not active only created_at, owner and codebase stay.
    A stored row outside the batch is marked by the least item that corrects it, once. Rows of the batch
    carry what the batch says, null if it says nothing; in safe mode a stored correction and the kind mental_model stay.
    """
    links = shared_files(stored, batch, cap)
    columns = stored.columns
    united = lambda: F.array_sort(F.array_union("_related", "related"))
    old = stored.select(F.col("item").alias("_item"), active().alias("_live"), *(F.col(c).alias(f"_{c}") for c in ("confidence", "access_count", "created_at", "valid_at", "related", "evidence", "corrected_by", "kind")))
    met = batch.join(links, "item", "left").join(old, F.col("item") == F.col("_item"), "left")
    live = F.coalesce("_live", F.lit(False))
    fresh = met.withColumns({
        "related": F.slice(F.array_sort(F.array_union("related", F.coalesce("links", F.array().cast(batch.schema["related"].dataType)))), 1, cap),
        "confidence": F.when(F.col("confidence") == 0.0, first_confidence(F.col("tier"))).otherwise(F.col("confidence")),
    })
    both = F.concat("_evidence", "evidence")
    keys = F.transform(both, lambda e: F.struct(e["file"], e["line"]))
    merged = fresh.withColumns({
        "confidence": F.when(live, raised_confidence(F.col("_confidence"), F.col("tier"), step)).otherwise(F.col("confidence")),
        "access_count": F.when(live, F.col("_access_count")).otherwise(F.col("access_count")),
        "created_at": F.when(live, F.least("_created_at", "created_at")).otherwise(F.col("created_at")),
        "valid_at": F.when(live, F.col("_valid_at")).otherwise(F.col("valid_at")),
        "related": F.when(live, united()).otherwise(F.col("related")),
        "evidence": F.when(live, F.filter(both, lambda e, i: F.array_position(keys, F.struct(e["file"], e["line"])) == i + 1)).otherwise(F.col("evidence")),
        "corrected_by": F.coalesce("corrected_by", F.when(F.lit(safe), F.col("_corrected_by"))),
        "kind": F.when(F.lit(safe) & (F.col("_kind") == "mental_model"), F.col("_kind")).otherwise(F.col("kind")),
    })
    after = upsert(stored, merged.select(*columns))
    told = batch.where("corrects is not null and corrects <> item").select(F.col("corrects").alias("item"), F.col("item").cast("string").alias("by"))
    if not safe:
        told = told.join(batch.select("item"), "item", "left_anti")
    return mark_corrected(after, told).select(*columns)


def mention(stored: DataFrame, new: DataFrame, step: float = 0.3, safe: bool = True) -> DataFrame:
    """M1, M4: the snapshot after new items (item, kind, tier, tags, evidence, at) were written by id.

    An id that is there is a re-mention: confidence rises, the first created_at and
    the evidence stay, new evidence is added by (file, line). In safe mode a
    correction and a promotion stay too; else the new row's values stand.
    """
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.item") == F.col("n.item"), "full_outer")
    again, fresh = F.col("s.item").isNotNull() & F.col("n.item").isNotNull(), F.col("s.item").isNull()
    live = F.col("s.invalid_at").isNull() & F.col("s.superseded_by").isNull()
    known = F.transform(F.col("s.evidence"), lambda e: F.struct(e["file"], e["line"]))
    added = F.filter(F.col("n.evidence"), lambda e: ~F.array_contains(known, F.struct(e["file"], e["line"])))
    kept = lambda name: F.when(again & ~F.lit(safe), F.lit(None)).otherwise(F.col(f"s.{name}"))
    return both.select(
        F.coalesce("s.item", "n.item").alias("item"),
        F.when(again & (F.col("s.kind") == "mental_model") & F.lit(safe), F.col("s.kind")).otherwise(F.coalesce("n.kind", "s.kind")).alias("kind"),
        F.coalesce("n.tier", "s.tier").alias("tier"),
        F.when(fresh, first_confidence(F.col("n.tier"))).when(again & live, raised_confidence(F.col("s.confidence"), F.col("n.tier"), step)).when(again, first_confidence(F.col("n.tier"))).otherwise(F.col("s.confidence")).alias("confidence"),
        F.coalesce("s.created_at", "n.at").alias("created_at"),
        F.coalesce("n.tags", "s.tags").alias("tags"),
        F.when(again & live, F.concat("s.evidence", added)).otherwise(F.coalesce("n.evidence", "s.evidence")).alias("evidence"),
        kept("corrected_by").alias("corrected_by"),
        F.when(again, F.lit(None)).otherwise(F.col("s.invalid_at")).alias("invalid_at"),
        F.when(again, F.lit(None)).otherwise(F.col("s.superseded_by")).alias("superseded_by"),
        F.coalesce("s.access_count", F.lit(0)).alias("access_count"),
    )


def touch(stored: DataFrame, recalled: DataFrame, now: Column) -> DataFrame:
    """M6: one more access and the time for each recalled item (item)."""
    hit = recalled.select(F.col("item").alias("_hit")).distinct()
    both = stored.join(hit, stored.item == hit._hit, "left")
    return both.withColumns({"access_count": F.col("access_count") + F.when(F.col("_hit").isNotNull(), 1).otherwise(0), "last_recalled": F.when(F.col("_hit").isNotNull(), now).otherwise(F.col("last_recalled"))}).drop("_hit")


def retire(stored: DataFrame, which: Column, now: Column) -> DataFrame:
    """M7: retire rows that are not retired yet."""
    return stored.withColumn("invalid_at", F.when(which & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at")))


def mark_corrected(stored: DataFrame, corrections: DataFrame) -> DataFrame:
    """M8: (item, by): the first correction stays; of several at once the smallest."""
    first = corrections.groupBy("item").agg(F.min("by").alias("_by"))
    return stored.join(first, "item", "left").withColumn("corrected_by", F.coalesce("corrected_by", "_by")).drop("_by")


def add_tag(tags: Column, tag: str, when: Column) -> Column:
    """The tag once, where the condition holds."""
    return F.when(when, F.array_union(tags, F.array(F.lit(tag)))).otherwise(tags)


def consolidate(items: DataFrame, merged: DataFrame, now: Column, promote_at: int = 3, stale_days: float = 90.0) -> DataFrame:
    """The next snapshot; every pass sees the rows as they were.

    merged (item): lessons whose patch is upstream already. They are tagged and lose
    half their confidence once.
    """
    promote = active() & (F.col("access_count") >= promote_at) & ~F.col("kind").isin("mental_model", "domain_knowledge")
    conflict = contradictions(items.where(active())).distinct().withColumn("_conflict", F.lit(True))
    upstream = merged.select("item").distinct().withColumn("_merged", F.lit(True))
    anchor = F.coalesce("last_recalled", "created_at")
    stale = active() & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(anchor.cast("timestamp")) > stale_days * 8.64e10)
    both = items.join(conflict, "item", "left").join(upstream, "item", "left")
    lesson = F.col("_merged").isNotNull() & active() & (F.col("kind") == "bug_lesson")
    first = lesson & ~F.array_contains("tags", "merged_upstream")
    tags = add_tag(add_tag(add_tag(F.col("tags"), "needs_review", F.col("_conflict").isNotNull()), "merged_upstream", lesson), "stale", stale)
    return both.select(
        *(c for c in items.columns if c not in ("kind", "confidence", "tags")),
        F.when(promote, "mental_model").otherwise(F.col("kind")).alias("kind"),
        F.when(first, F.col("confidence") * 0.5).otherwise(F.col("confidence")).alias("confidence"),
        tags.alias("tags"), promote.alias("promoted"), F.col("_conflict").isNotNull().alias("contradicts"), lesson.alias("merged_upstream"), stale.alias("stale"),
    )


def as_of(items: DataFrame, at: Column) -> DataFrame:
    """Rows that were true and not retired at a time. An extension: no lookup by time is asked for elsewhere."""
    return items.where((F.coalesce("valid_at", "created_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of two manifests (path, sha): added, changed, removed or same."""
    o, n = old.select("path", F.col("sha").alias("_old")), new.select("path", F.col("sha").alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def files_to_embed(changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh chunks (file, ...) of added and changed files, which are all that has to be made anew."""
    return fresh.join(changes.where(F.col("state").isin("changed", "added")).select(F.col("path").alias("file")), "file", "left_semi")


def replaced_counts(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: chunks before an update (n_before), and those of changed and removed files that it deletes (n_deleted)."""
    gone = changes.where(F.col("state").isin("changed", "removed")).select(F.col("path").alias("file"), F.lit(1).alias("_gone")).distinct()
    return chunks.join(gone, "file", "left").agg(F.count("*").alias("n_before"), F.count("_gone").alias("n_deleted"))


def replace_chunks(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks (file, ...) without changed and removed files, and the fresh ones of changed and added files."""
    gone = changes.where(F.col("state").isin("changed", "removed")).select(F.col("path").alias("file"))
    come = changes.where(F.col("state").isin("changed", "added")).select(F.col("path").alias("file"))
    return chunks.join(gone, "file", "left_anti").unionByName(fresh.join(come, "file", "left_semi"))


def index_mode(forced: Column, has_manifest: Column, same_model: Column, same_schema: Column, n_changed: Column) -> Column:
    """How an index is brought up to date."""
    return F.when(forced | ~has_manifest | ~same_model | ~same_schema, "full_rebuild").when(n_changed == 0, "noop").otherwise("incremental")


def index_reason(forced: Column, has_manifest: Column, same_model: Column, same_schema: Column, n_changed: Column) -> Column:
    """Why ``index_mode`` says what it says: the first of what asks for it."""
    return (
        F.when(~has_manifest, "no index yet").when(~same_model, "another model").when(~same_schema, "another schema").when(forced, "forced")
        .when(n_changed == 0, "nothing changed").otherwise(F.concat(n_changed.cast("string"), F.lit(" changed")))
    )
