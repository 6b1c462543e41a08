"""Batch aggregation of findings, citation grading, patch states and cleaning plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.operators.graph import components, cut

TIER_ORDER = ("high", "relevant", "none")


def security_tier(theme: Column, keyword: Column, risk: Column) -> Column:
    """The theme first, then keywords and risk."""
    bad = F.coalesce(risk >= 0.5, F.lit(False))
    hit = F.coalesce(keyword, F.lit(False))
    return F.when((theme == "security") & (bad | hit), "high").when(theme == "security", "relevant").when(hit & bad, "high").when(hit | bad, "relevant").otherwise("none")


def module_counts(findings: DataFrame, most: int = 10) -> DataFrame:
    """A4: (module, n): findings of each module, each counted once, the largest first."""
    each = findings.select(F.explode(F.array_distinct("modules")).alias("module"))
    return each.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(most)


def similar_findings(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """(src, dst): findings of one theme whose file sets have a Jaccard index of at least ``least``.

    Equal sets are one row first; sets meet on a shared file among the first few in a
    global order of rare files first: two sets with that index share one of them. What stands behind the shared file bounds
    how large the other set may be, so a set meets only sets of the sizes that are left, and those that share a common file alone don't meet.
    """
    f = findings.where(F.size("files") > 0).select("finding", F.coalesce("theme", F.lit("function")).alias("theme"), F.array_sort(F.array_distinct("files")).alias("files"))
    sets = f.groupBy("theme", "files").agg(F.min("finding").alias("finding"))
    same = f.join(sets.withColumnRenamed("finding", "low"), ["theme", "files"]).where("finding <> low").select(F.col("low").alias("src"), F.col("finding").alias("dst"))
    each = sets.select("theme", "finding", F.size("files").alias("n"), F.explode("files").alias("file"))
    spread = each.groupBy("theme", "file").agg(F.count("*").alias("spread"))
    order = Window.partitionBy("finding").orderBy("spread", "file")
    placed = each.join(spread, ["theme", "file"]).withColumn("place", F.row_number().over(order))
    # Of n files at ``place`` the shared one and those behind it can be common; other sets have this many files at most.
    most = F.floor((1 + least) / least * (F.col("n") - F.col("place") + 1) + 1e-9) - F.col("n")
    prefix = placed.withColumn("most", most).where(F.col("most") >= F.ceil(F.col("n") * least - 1e-9))
    # The larger set looks for the smaller one, of equal ones both for each other.
    sizes = F.sequence(F.ceil(F.col("n") * least - 1e-9).cast("int"), F.least("n", F.col("most")).cast("int"))
    a = prefix.select("theme", "file", F.col("finding").alias("src"), F.col("n").alias("na"), F.explode(sizes).alias("n"))
    b = prefix.select("theme", "file", F.col("finding").alias("dst"), "n", "most")
    met = a.join(b, ["theme", "file", "n"]).where((F.col("na") <= F.col("most")) & ((F.col("n") < F.col("na")) | (F.col("src") < F.col("dst")))).select("src", "dst").distinct()
    left, right = sets.select(F.col("finding").alias("src"), F.col("files").alias("fa")), sets.select(F.col("finding").alias("dst"), F.col("files").alias("fb"))
    pairs = met.join(left, "src").join(right, "dst").where(F.size(F.array_intersect("fa", "fb")) / F.size(F.array_union("fa", "fb")) >= least)
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).union(same)


def subject_groups(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """(finding, subject): findings that similar ones join, named by the least; the rest stand alone."""
    grouped = components(similar_findings(findings, least))
    return findings.select("finding").join(grouped, F.col("finding") == F.col("node"), "left").select("finding", F.coalesce("component", "finding").alias("subject"))


def grade_citations(citations: DataFrame, files: DataFrame, spans: DataFrame, tolerance: int = 5) -> DataFrame:
    """(citation, grade): strict in a span, near within a few lines, file if only the file is there, else bad.

    citations (citation, file, line); files (file, n_lines); spans (file, first, last).
    Spans are cut into blocks of lines, so that a line meets only spans near it. Lines are graded once, however often they are cited, and equal spans are one.
    """
    block = 64
    cut = lambda x: F.floor(x / block)
    dealt = spans.select("file", "first", "last").distinct().select("file", "first", "last", F.explode(F.sequence(cut(F.col("first") - tolerance), cut(F.col("last") + tolerance))).alias("block"))
    lines = citations.where("file is not null and line is not null").select("file", "line").distinct()
    met = lines.withColumn("block", cut(F.col("line"))).join(dealt, ["file", "block"])
    strict = F.col("line").between(F.col("first"), F.col("last"))
    near = F.col("line").between(F.col("first") - tolerance, F.col("last") + tolerance)
    best = met.groupBy("file", "line").agg(F.max(F.when(strict, 2).when(near, 1).otherwise(0)).alias("best"))
    known = files.select("file", "n_lines")
    grade = F.when(F.col("n_lines").isNull(), "bad").when(F.col("best") == 2, "strict").when(F.col("best") == 1, "near").when(F.col("line").isNull() | F.col("line").between(1, F.col("n_lines")), "file").otherwise("bad")
    return citations.join(known, "file", "left").join(best, ["file", "line"], "left").select("citation", grade.alias("grade"))


def spans_of_ranges(ranges: DataFrame, spans: DataFrame, block: int = 16) -> DataFrame:
    """(range, symbol): spans that share a line with a range of the same file; both are dealt in blocks of lines.

    A pair is told in the block of its first common line only, so pairs are never shuffled.
    """
    cut = lambda x: F.floor(x / block)
    r = ranges.select("range", "file", F.col("first").alias("a"), F.col("last").alias("b"), F.explode(F.sequence(cut(F.col("first")), cut(F.col("last")))).alias("block"))
    s = spans.select("symbol", "file", "first", "last", F.explode(F.sequence(cut(F.col("first")), cut(F.col("last")))).alias("block"))
    met = r.hint("merge").join(s, ["file", "block"]).where("a <= last and b >= first and a <= b and first <= last")
    return met.where(F.col("block") == cut(F.greatest("a", "first"))).select("range", "symbol")


def patch_states(commits: DataFrame, known: DataFrame) -> DataFrame:
    """(commit, state) of commits (commit, patch, applies) against patches known elsewhere (patch)."""
    there = known.select("patch").distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("_there").isNotNull(), "already_fixed").when(F.col("applies").isNull(), "uncertain").when(F.col("applies"), "recommend_merge").otherwise("conflict")
    return commits.join(there, "patch", "left").select("commit", state.alias("state"))


STATES = ("already_fixed", "recommend_merge", "conflict", "uncertain")


def state_histogram(states: DataFrame) -> DataFrame:
    """(state, n) with a row for each of the four states."""
    names = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return names.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def packaging_only(files: Column, prefix: str = "debian/") -> Column:
    """There are files and all lie under the prefix."""
    return (F.size(files) > 0) & F.forall(files, lambda f: f.startswith(prefix))


def _base(c: Column | str) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _ends(c: Column) -> Column:
    """All ends of a text, itself included."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.substring(c, i, F.length(c))))


def fitting_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): for each path that fits a file the equal one, else the first by name of those that it fits: of the same last part, or one the end of the other.

    Paths with a slash that end alike share their last part; one without may be the end of a
    last part, so it meets the ends of last parts. Of the files of a last part, and of an end, only the first is kept before paths
    meet them, so no path meets more than a few rows. Null and empty names fit nothing.
    """
    p = asked.select("path").distinct().where("path <> ''")
    f = files.select("file").distinct().where("file <> ''")
    first = f.groupBy(_base("file").alias("_b")).agg(F.min("file").alias("file"))
    equal = p.join(f, F.col("path") == F.col("file")).select("path", F.lit(False).alias("unlike"), "file")
    same = p.withColumn("_b", _base("path")).join(first, "_b").select("path", F.lit(True).alias("unlike"), "file")
    of_end = first.select("file", F.explode(_ends(F.col("_b"))).alias("path")).groupBy("path").agg(F.min("file").alias("file"))
    bare_path = p.where(~F.col("path").contains("/")).join(of_end, "path").select("path", F.lit(True).alias("unlike"), "file")
    bare = f.where(~F.col("file").contains("/"))
    bases = p.select(_base("path").alias("_b")).distinct()
    of_base = bases.select("_b", F.explode(_ends(F.col("_b"))).alias("file")).join(bare, "file").groupBy("_b").agg(F.min("file").alias("file"))
    bare_file = p.withColumn("_b", _base("path")).join(of_base, "_b").select("path", F.lit(True).alias("unlike"), "file")
    found = equal.union(same).union(bare_path).union(bare_file)
    return found.groupBy("path").agg(F.min(F.struct("unlike", "file"))["file"].alias("file"))


def cited_files(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations (citation, file) whose path fits a path of files (file)."""
    fits = fitting_paths(citations.select(F.col("file").alias("path")), files).select(F.col("path").alias("file"))
    return citations.join(fits, "file", "left_semi").select("citation", "file")


def in_ranges(points: DataFrame, ranges: DataFrame, block: int = 64) -> DataFrame:
    """P10: points (file, line) that lie in a range (file, first, last), each once; both are dealt in blocks of lines."""
    cut = lambda x: F.floor(x / block)
    r = ranges.select("file", "first", "last").distinct().select("file", "first", "last", F.explode(F.sequence(cut(F.col("first")), cut(F.col("last")))).alias("_block"))
    at = points.select("file", "line").distinct().withColumn("_block", cut(F.col("line")))
    return at.join(r, ["file", "_block"]).where("line between first and last").select("file", "line").distinct()


def verify_citations(citations: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(citation, verdict) of citations (citation, file, line) against changed files (file) and changed ranges (file, first, last).

    unnamed: no file. bad: the file fits no changed file. file: it fits, but there is no line, or no ranges of such a file.
    anchored, unanchored: the line lies in a range of the file, or not. Of several files with ranges
    that a path fits, the equal one counts, else the first by name.
    """
    asked = citations.select(F.col("file").alias("path")).distinct()
    known = fitting_paths(asked, files).select(F.col("path").alias("file"), F.lit(True).alias("_known"))
    chosen = fitting_paths(asked, ranges.select("file")).select(F.col("path").alias("file"), F.col("file").alias("_with"))
    placed = citations.join(known, "file", "left").join(chosen, "file", "left")
    inside = in_ranges(placed.where("_with is not null and line is not null").select(F.col("_with").alias("file"), "line"), ranges).select(F.col("file").alias("_with"), "line", F.lit(True).alias("_in"))
    verdict = F.when(F.col("file").isNull() | (F.col("file") == ""), "unnamed").when(F.col("_known").isNull(), "bad").when(F.col("line").isNull() | F.col("_with").isNull(), "file").when(F.col("_in").isNotNull(), "anchored").otherwise("unanchored")
    return placed.join(inside, ["_with", "line"], "left").select("citation", verdict.alias("verdict"))


def citation_summary(verdicts: DataFrame) -> DataFrame:
    """One row: total, n_bad, file_rate (of all; 1 if there are none) and anchor_rate (of those with a line and ranges; null if there are none)."""
    of = lambda *names: F.count_if(F.col("verdict").isin(*names))
    total, lined = F.count("*"), of("anchored", "unanchored")
    return verdicts.agg(total.alias("total"), of("bad").alias("n_bad"), F.when(total > 0, (total - of("bad")) / total).otherwise(1.0).alias("file_rate"), F.when(lined > 0, of("anchored") / lined).alias("anchor_rate"))


def aggregate_findings(findings: DataFrame, risky: float = 0.5, most: int = 10, least: float = 0.5) -> DataFrame:
    """One row over findings (finding, theme, tier, risk, modules, files): total, n_high, n_risky, by_theme and by_tier (maps),
    hot_modules (module and count, the largest first), n_unique (subjects) and n_groups (subjects of several findings; ``duplicate_groups`` has them as rows).
    """
    theme, tier = F.coalesce("theme", F.lit("function")), F.coalesce("tier", F.lit("none"))
    counts = lambda key, name: findings.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    totals = findings.agg(F.count("*").alias("total"), F.count_if(tier == "high").alias("n_high"), F.count_if(F.col("risk") >= risky).alias("n_risky"))
    hot = module_counts(findings, most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), "module", "n"))).alias("h")).select(F.transform("h", lambda x: F.struct(x["module"].alias("module"), x["n"].alias("n"))).alias("hot_modules"))
    sizes = subject_groups(findings, least).groupBy("subject").agg(F.count("*").alias("n"))
    subjects = sizes.agg(F.count("*").alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_groups"))
    # Each side is one row.
    out = totals
    for side in (counts(theme, "by_theme"), counts(tier, "by_tier"), hot, subjects):
        out = out.crossJoin(F.broadcast(side))
    return out


def duplicate_groups(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """(subject, finding): a row for each finding of a subject that has several."""
    grouped = subject_groups(findings, least)
    several = grouped.where("finding <> subject").select("subject").distinct()
    return grouped.join(several, "subject", "left_semi").select("subject", "finding")


def analyse_patches(patches: DataFrame, spans: DataFrame, modules: DataFrame, risk: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(commit, theme, applies, risk, tier, modules, files, error): what is known of each patch without a model.

    patches (commit, diff, theme, applies, error); spans (file, symbol, first, last); modules (symbol,
    module); risk (symbol, risk). A patch with an error stays as a row with that error and nothing else. Risk is the
    largest of the changed symbols', 0 without one; a keyword in a changed symbol's name raises the tier.
    """
    from lumenvault.operators import diffs

    good = patches.where("error is null")
    changed = diffs.hunks(good.select("commit", "diff"))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.lower(F.col("symbol").cast("string")).contains(word)
    # What is told of a patch is a set, a maximum and an alternative: equal spans and equal ranges are one row each before they meet.
    known = spans.select("file", "symbol", "first", "last").join(modules, "symbol", "left").join(risk, "symbol", "left")
    told = [F.max("risk").alias("risk"), F.bool_or("hit").alias("hit")]
    kept = known.withColumn("hit", hit).groupBy("file", "first", "last", "module").agg(*told)
    asked = changed.select("file", F.col("start").alias("first"), F.col("end").alias("last")).distinct().select(F.struct("file", "first", "last").alias("range"), "*")
    met = spans_of_ranges(asked, kept.select("file", "first", "last", F.struct("module", "risk", "hit").alias("symbol"))).select("range", "symbol.*")
    of_range = met.groupBy("range", "module").agg(*told).groupBy("range").agg(F.collect_set("module").alias("modules"), *told)
    each = changed.select("commit", F.struct("file", F.col("start").alias("first"), F.col("end").alias("last")).alias("range")).join(of_range, "range")
    per = each.groupBy("commit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("modules")))).alias("modules"), *told)
    both = patches.join(per, "commit", "left")
    fine = F.col("error").isNull()
    worth = F.coalesce("risk", F.lit(0.0))
    return both.select(
        "commit", F.when(fine, F.col("theme")).alias("theme"), F.when(fine, F.col("applies")).alias("applies"), F.when(fine, worth).alias("risk"),
        F.when(fine, security_tier(F.col("theme"), F.coalesce("hit", F.lit(False)), worth)).alias("tier"),
        F.when(fine, F.coalesce("modules", F.array().cast("array<bigint>"))).alias("modules"), F.when(fine, diffs.changed_files(F.col("diff"))).alias("files"), "error",
    )


def batch_report(analysed: DataFrame) -> DataFrame:
    """One row over ``analyse_patches``: total, n_failed, n_high, n_relevant, risk (the mean of those that did not fail), and report, a text of one line for each tier."""
    fine = F.col("error").isNull()
    tiers = analysed.groupBy(F.when(fine, F.col("tier")).otherwise("failed").alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("risk"), 3).alias("risk"))
    line = F.concat("tier", F.lit(": "), "n", F.when(F.col("risk").isNotNull(), F.concat(F.lit(", risk "), F.format_string("%.3f", "risk"))).otherwise(""))
    told = tiers.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("report"))  # a row for each tier
    totals = analysed.agg(F.count("*").alias("total"), F.count_if(~fine).alias("n_failed"), F.count_if(F.col("tier") == "high").alias("n_high"), F.count_if(F.col("tier") == "relevant").alias("n_relevant"), F.avg("risk").alias("risk"))
    return totals.crossJoin(F.broadcast(told))


def learned_from(patches: DataFrame, analysed: DataFrame, stored: DataFrame, owner: str, codebase: str) -> DataFrame:
    """The store of lessons (item, summary, commit) after the lessons of all patches of a batch that did not fail and whose tier is not none were written by id."""
    from lumenvault.operators.knowledge import upsert

    worth = analysed.where("error is null and tier <> 'none'").select("commit")
    new = lesson_rows(patches.join(worth, "commit", "left_semi"), owner, codebase).select(F.col("id").alias("item"), "summary", "commit")
    # Equal patches are one lesson, that of the first commit.
    first = new.groupBy("item").agg(F.min_by("summary", "commit").alias("summary"), F.min("commit").alias("commit"))
    return upsert(stored, first, kept=())


def lesson_rows(patches: DataFrame, owner: str, codebase: str, summary: Column | None = None) -> DataFrame:
    """One lesson for each patch (commit, diff): id by the diff, its files, and the start of each hunk as evidence.

    Without a summary the lesson says how many hunks there are in which files.
    """
    from lumenvault.functions.text import short_id
    from lumenvault.operators import diffs

    files = diffs.changed_files(F.col("diff"))
    each = diffs.hunks(patches.select("commit", "diff")).groupBy("commit").agg(F.array_sort(F.collect_list(F.struct("file", F.col("start").alias("line")))).alias("evidence"))
    both = patches.join(each, "commit", "left").withColumn("evidence", F.coalesce("evidence", F.array()))
    own = F.concat(F.size("evidence").cast("string"), F.lit(" hunks in "), F.array_join(files, ", "))
    said = F.coalesce(F.nullif(F.trim(summary), F.lit("")), own) if summary is not None else own
    return both.select("commit", short_id(F.lit(owner), F.lit(codebase), F.lit("bug_lesson"), F.col("diff")).alias("id"), F.substring(said, 1, 200).alias("summary"), files.alias("blast_radius"), "evidence", F.array(F.lit("patch_insight")).alias("tags"))


def localisation_lessons(cases: DataFrame) -> DataFrame:
    """(case, summary, root_cause, symptom, evidence, blast_radius) of cases (case, found, trigger), found being JSON.

    Evidence without a file is left out, its line the first number given; without a blast radius the files of the
    evidence stand for it, and without a problem summary the head of the trigger for the symptom.
    """
    from lumenvault.functions.text import first_line_number

    form = "root_cause string, problem_summary string, blast_radius_files array<string>, evidence array<struct<file: string, line: string>>"
    read = cases.withColumn("j", F.from_json("found", form))
    kept = F.filter(F.coalesce("j.evidence", F.array()), lambda e: e["file"].isNotNull() & (e["file"] != ""))
    evidence = F.transform(kept, lambda e: F.struct(e["file"].alias("file"), first_line_number(e["line"]).alias("line")))
    cause, given = F.coalesce("j.root_cause", F.lit("")), F.coalesce("j.blast_radius_files", F.array())
    radius = F.when(F.size(given) > 0, given).otherwise(F.array_distinct(F.transform(kept, lambda e: e["file"])))
    symptom = F.coalesce(F.nullif("j.problem_summary", F.lit("")), F.substring(F.coalesce("trigger", F.lit("")), 1, 200))
    return read.select("case", F.substring(cause, 1, 200).alias("summary"), cause.alias("root_cause"), symptom.alias("symptom"), evidence.alias("evidence"), radius.alias("blast_radius"))


def finding_of_answer(answer: Column) -> Column:
    """Struct (summary, citations) of an answer: what its outer JSON says, else its first 500 characters and no citations."""
    from lumenvault.functions.text import outer_json

    found = outer_json(answer)
    cited = F.from_json(F.get_json_object(found, "$.citations"), "array<struct<file: string, line: int>>")
    return F.when(found.isNotNull(), F.struct(F.coalesce(F.get_json_object(found, "$.summary"), F.lit("")).alias("summary"), F.coalesce(cited, F.array()).alias("citations"))).otherwise(F.struct(F.substring(answer, 1, 500).alias("summary"), F.array().cast("array<struct<file: string, line: int>>").alias("citations")))


def named_plans(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, name, focus, named): each candidate (id, raw_name) with the last answer (id, name, focus, place) to its id as text, if that has both; else its own name."""
    last = answers.groupBy(F.col("id").cast("string").alias("_id")).agg(F.max_by(F.struct("name", "focus"), "place").alias("a"))
    both = candidates.join(last, F.col("id").cast("string") == F.col("_id"), "left")
    named = F.coalesce((F.trim("a.name") != "") & (F.trim("a.focus") != ""), F.lit(False))
    return both.select("id", F.when(named, F.substring(F.trim("a.name"), 1, 80)).otherwise(F.col("raw_name")).alias("name"), F.when(named, F.trim("a.focus")).otherwise(F.col("raw_name")).alias("focus"), named.alias("named"))


def with_key_symbols(communities: DataFrame, hubs: DataFrame, most: int = 15) -> DataFrame:
    """Communities (community, ...) with key_symbols: the first few of their hubs (community, symbol, place)."""
    first = hubs.where("community is not null").withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy("place", "symbol"))).where(F.col("_r") <= most)
    lists = first.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "symbol"))), lambda x: x["symbol"]).alias("key_symbols"))
    return communities.join(lists, "community", "left").withColumn("key_symbols", F.coalesce("key_symbols", F.array()))


def hunk_context(patches: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(commit, file, context): for each changed file of a patch (commit, diff) the best ``k`` chunks (id, text), sought by the
    file's name and the lines that its first hunk adds, one after the other; null if none has a word of them.

    Words that no chunk has score nothing: files whose other words are the same are one search.
    """
    from lumenvault.operators import diffs
    from lumenvault.operators.retrieval import bm25, query_terms, top

    first = diffs.hunks(patches.select("commit", "diff")).where("file <> ''").groupBy("commit", "file").agg(F.min_by("body", "place").alias("body"))
    added = F.transform(F.filter(F.split("body", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, F.lit(2), F.length(x)))
    asked = first.select(F.struct("commit", "file").alias("query"), F.concat_ws("\n", "file", F.array_join(added, "\n")).alias("text"))
    there = chunks.select(F.explode(query_terms(F.col("text"))).alias("term")).distinct()
    words = asked.select("query", F.explode(query_terms(F.col("text"))).alias("term")).join(there, "term")
    sought = words.groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("words"))
    searches = cut(sought.select("words").distinct())
    best = top(bm25(chunks, searches.select(F.col("words").alias("query"), F.col("words").alias("text"))), k).join(chunks.select("id", "text"), "id")
    lists = best.groupBy(F.col("query").alias("words")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l")).select("words", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("context"))
    return asked.select("query").join(sought.join(lists, "words"), "query", "left").select("query.commit", "query.file", "context")


def cherry_counts(commits: DataFrame, known: DataFrame) -> DataFrame:
    """(branch, n_new, n_there): commits (branch, patch) whose patch is not among known ones (patch), and the others."""
    there = known.select("patch").distinct().withColumn("_there", F.lit(True))
    return commits.join(there, "patch", "left").groupBy("branch").agg(F.count_if(F.col("_there").isNull()).alias("n_new"), F.count("_there").alias("n_there"))


def gc_plan(records: DataFrame, now: Column, most_days: int) -> DataFrame:
    """(name, action): what age and role say of registry rows (name, role, created, path_exists)."""
    age = F.coalesce(F.datediff(now, F.try_to_date("created")), F.lit(0))
    action = F.when(~F.col("path_exists"), "orphan").when(F.col("role") == "baseline", "keep").when(F.col("role") == "unmanaged", "legacy").when(age > most_days, "delete").otherwise("keep")
    return records.select("name", age.alias("age"), action.alias("action"))


def find_repos(records: DataFrame, project: str, version: str | None = None) -> DataFrame:
    """Records (name, url, role) with a part of the project's name, and the version, in the name or the url's tail; else those with all of it."""
    parts = [p for p in re.split(r"[-_.]", project.lower()) if len(p) >= 2]
    where = F.lower(F.concat_ws(" ", "name", F.element_at(F.split("url", "/"), -1)))
    hit = F.lit(False)
    for p in parts:
        hit = hit | where.contains(p)
    if version:
        hit = hit & where.contains(version.lower())
    marked = records.withColumns({"_hit": hit, "_all": where.contains(project.lower())})
    none = marked.where("_hit").limit(1).agg((F.count("*") == 0).alias("_none"))
    return marked.crossJoin(F.broadcast(none)).where("_hit or (_none and _all)").select("name", "url", "role").orderBy(F.col("role") != "baseline", "name")
