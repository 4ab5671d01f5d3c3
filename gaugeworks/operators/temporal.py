"""Metrics of a change history: churn, coupling, fragmentation, stability, hotspots.

``changes`` has repo_id, hash, author, ts, path, added and deleted, one row for
each file of a commit; ``commits`` has repo_id, hash, author and ts. Wall-clock
time is never read: ``as_of`` is a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import percentage
from gaugeworks.operators.steps import kept

#: Days of the window, files of a bulk commit, commits of a coupled file, per cent of a strong pair, days without any gap.
WINDOW_DAYS, BULK_FILES, LEAST_COMMITS, STRONG, QUIET_DAYS = 90, 50, 5, 70.0, 30.0
#: Commits from which a file is told by a broadcast table; it affects speed only.
OFTEN = 50_000


def since(ts: Column, as_of: dt.datetime, days: int = WINDOW_DAYS) -> Column:
    """Whether a time lies in the days up to ``as_of``."""
    return ts >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")


def churn_rate(commits: DataFrame, changes: DataFrame, as_of: dt.datetime, days: int = WINDOW_DAYS) -> DataFrame:
    """Changed lines a commit within the window; commits without files count."""
    return _churn(commits, changes.where(since(F.col("ts"), as_of, days)).select("repo_id", (F.col("added") + F.col("deleted")).alias("lines")), as_of, days)


def _churn(commits: DataFrame, recent: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """``churn_rate`` from the changes of the window (repo_id, lines)."""
    n = commits.where(since(F.col("ts"), as_of, days)).groupBy("repo_id").agg(F.count_distinct("hash").alias("commits"))
    lines = recent.groupBy("repo_id").agg(F.sum("lines").alias("lines"))
    return n.join(lines, "repo_id", "left").select("repo_id", "commits", F.coalesce(F.try_divide("lines", "commits"), F.lit(0.0)).alias("churn_rate"))


def coupled_pairs(changes: DataFrame, least_commits: int = LEAST_COMMITS, bulk: int = BULK_FILES) -> DataFrame:
    """Pairs of files changed together, with the share of the rarer file's commits.

    Commits are counted first: one of more than ``bulk`` files is never gathered. Files of fewer than
    ``least_commits`` of the others go next, since no pair of theirs is kept; only then are the few files that a
    commit still has put together. Pairs are counted by partial sums before they are shuffled, so a file of very
    many commits is one row for each of its pairs and tasks. Files of ``OFTEN`` commits and more are told by a
    broadcast table, which holds one row for so many of the input; the rest is joined by file, so no task gets
    more rows of one file than that.
    """
    whole = Window.partitionBy("repo_id", "hash")
    order = whole.orderBy("path")
    # One sort by commit and path serves all steps up to the commit's row: no table of distinct files is built.
    files = changes.select("repo_id", "hash", "path", F.lag(F.struct("path")).over(order).alias("before"))
    files = files.where(F.col("before").isNull() | ~F.col("before.path").eqNullSafe(F.col("path")))
    few = files.select("repo_id", "hash", "path", F.row_number().over(order).alias("at")).where(F.col("at") <= bulk + 1)
    few = few.withColumns({"n": F.count("*").over(whole), "paths": F.collect_list("path").over(whole)})
    few = kept(few.where((F.col("at") == 1) & (F.col("n") <= bulk)).select("repo_id", "hash", F.array_sort("paths").alias("paths")))
    single = few.select("repo_id", "hash", F.explode("paths").alias("path"))
    every = kept(single.groupBy("repo_id", "path").agg(F.count("*").alias("commits")))
    each = every.where(F.col("commits") >= least_commits)
    if every.where(F.col("commits") < least_commits).isEmpty():
        small = few
    else:
        hot = each.where(F.col("commits") >= OFTEN).select("repo_id", "path", F.lit(True).alias("hot"))
        told = single.join(F.broadcast(hot), ["repo_id", "path"], "left")
        rest = told.where("hot is null").join(each, ["repo_id", "path"], "left_semi")
        often = told.where("hot").select("repo_id", "hash", "path").unionByName(rest.select("repo_id", "hash", "path"))
        small = often.groupBy("repo_id", "hash").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    left = small.select("repo_id", "paths", F.posexplode("paths").alias("at", "a"))
    pair = left.select("repo_id", "a", F.explode(F.slice("paths", F.col("at") + 2, F.lit(bulk))).alias("b"))
    together = pair.groupBy("repo_id", "a", "b").agg(F.count("*").alias("shared"))
    first = each.select("repo_id", F.col("path").alias("a"), F.col("commits").alias("commits_a"))
    second = each.select("repo_id", F.col("path").alias("b"), F.col("commits").alias("commits_b"))
    both = together.join(first, ["repo_id", "a"]).join(second, ["repo_id", "b"])
    return both.withColumn("strength", percentage(F.col("shared"), F.least("commits_a", "commits_b")))


def coupling(pairs: DataFrame, strong: float = STRONG) -> DataFrame:
    """The share of pairs that are strong."""
    return pairs.groupBy("repo_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("strength") > strong).alias("strong_pairs")).withColumn("temporal_coupling_pct", percentage(F.col("strong_pairs"), F.col("pairs")))


def author_fragmentation(changes: DataFrame, as_of: dt.datetime, days: int = WINDOW_DAYS) -> DataFrame:
    """The mean number of distinct authors of a file within the window."""
    by_author = changes.where(since(F.col("ts"), as_of, days)).select("repo_id", "path", "author").distinct()
    return _fragmentation(by_author.groupBy("repo_id", "path").agg(F.count("author").alias("recent_authors")))


def _by_file(changes: DataFrame, as_of: dt.datetime, days: int, parts: int | None) -> DataFrame:
    """Changes with ``lines``, ``gap_days`` since the file's change before, ``lately`` and, of those, the author.

    A change goes to its file once, to one of ``parts`` partitions if given; all metrics of files are read from here.
    """
    there = changes.select("repo_id", "path", "ts", "hash", (F.col("added") + F.col("deleted")).alias("lines"), "author")
    there = there.repartition(parts, "repo_id", "path") if parts else there
    lately = since(F.col("ts"), as_of, days)
    return kept(_with_before(there).select("repo_id", "path", "lines", _gap_days().alias("gap_days"), lately.alias("lately"), F.when(lately, F.col("author")).alias("author")))


def _fragmentation(files: DataFrame) -> DataFrame:
    return files.where("recent_authors > 0").groupBy("repo_id").agg(F.avg("recent_authors").alias("author_fragmentation"), F.count("*").alias("files"))


def change_gaps(changes: DataFrame) -> DataFrame:
    """Days between a file's consecutive changes."""
    return _with_before(changes).where("before is not null").select("repo_id", "path", _gap_days().alias("gap_days"))


def _with_before(changes: DataFrame) -> DataFrame:
    """Changes with the time ``before`` of the file's change before."""
    return changes.withColumn("before", F.lag("ts").over(Window.partitionBy("repo_id", "path").orderBy("ts", "hash")))


def _gap_days() -> Column:
    return F.expr("timestampdiff(SECOND, before, ts)") / 86400.0


def commit_stability(changes: DataFrame) -> DataFrame:
    """The upper median of the gaps of all files; quiet histories get a fixed number of days.

    The median is found by rank over counted gaps, so no repository's gaps are
    gathered in one place: gaps are counted by value first, and the window runs
    over distinct values.
    """
    return stability_of_gaps(changes.select("repo_id").distinct(), change_gaps(changes))


def stability_of_gaps(repos: DataFrame, gaps: DataFrame) -> DataFrame:
    """``commit_stability`` of repositories (repo_id) from gaps (repo_id, gap_days) that are there already."""
    counted = gaps.groupBy("repo_id", "gap_days").agg(F.count("*").alias("n"))
    order = Window.partitionBy("repo_id").orderBy("gap_days")
    running = counted.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = counted.groupBy("repo_id").agg(F.sum("n").alias("total"))
    middle = running.join(total, "repo_id").where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("repo_id").agg(F.min("gap_days").alias("median"))
    return repos.join(middle, "repo_id", "left").select("repo_id", F.coalesce("median", F.lit(QUIET_DAYS)).alias("commit_stability"))


def file_changes(changes: DataFrame) -> DataFrame:
    """Changed lines, commits and authors of each file.

    A change is sent to its file once, and not three times as by two distinct counts in one grouping; there the first
    row of each commit and of each author is marked in sorted order, without tables of distinct values.
    """
    there = changes.select("repo_id", "path", "hash", "author", (F.col("added") + F.col("deleted")).alias("lines")).repartition("repo_id", "path")
    first = lambda x: (F.row_number().over(Window.partitionBy("repo_id", "path", x).orderBy(x)) == 1) & F.col(x).isNotNull()
    marked = there.withColumn("commit", first("hash")).withColumn("person", first("author"))
    return marked.groupBy("repo_id", "path").agg(F.sum("lines").alias("total_changes"), F.count_if("commit").alias("commits"), F.count_if("person").alias("authors"))


def hotspot_concentration(files: DataFrame) -> DataFrame:
    """The share of changes in the most changed tenth of the files, one file at least; null without changes.

    Files are counted by their number of changes first, so the window runs over
    distinct numbers, not over a repository's files; ties do not matter to the sum.
    """
    counted = files.groupBy("repo_id", "total_changes").agg(F.count("*").alias("n"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("total_changes")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("repo_id")
    hot = F.greatest(F.lit(1), F.floor(F.sum("n").over(every) / 10))
    ranked = counted.withColumn("upto", F.sum("n").over(order)).withColumn("hot", hot)
    taken = F.greatest(F.lit(0), F.least("n", F.col("hot") - F.col("upto") + F.col("n")))
    sums = ranked.groupBy("repo_id").agg(F.sum(taken * F.col("total_changes")).alias("in_hot"), F.sum(F.col("n") * F.col("total_changes")).alias("in_all"))
    return sums.select("repo_id", F.try_divide(F.col("in_hot") * 100.0, F.col("in_all").cast("double")).alias("hotspot_concentration"))


def top_hotspots(files: DataFrame, top: int = 10) -> DataFrame:
    """The most changed files of each repository."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("total_changes"), "path")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def history_metrics(commits: DataFrame, changes: DataFrame, as_of: dt.datetime, strong: float = STRONG, days: int = WINDOW_DAYS, coupled: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The five history metrics of each repository, long: repo_id, metric, value, available.

    Coupling may be measured on other changes (``coupled``), as of coarser paths. ``parts`` is the number of
    partitions that changes are dealt to, by file and by commit; without it the session's.
    """
    each = _by_file(changes, as_of, days, parts)
    recent = each.where("lately")
    authors = recent.select("repo_id", "path", "author").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("recent_authors"))
    files = each.groupBy("repo_id", "path").agg(F.sum("lines").alias("total_changes"))
    stable = stability_of_gaps(each.select("repo_id").distinct(), each.where("gap_days is not null").select("repo_id", "gap_days"))
    together = coupled if coupled is not None else changes
    pairs = coupled_pairs(together.repartition(parts, "hash") if parts else together)
    found = [
        (_churn(commits, recent, as_of, days), "churn_rate"), (_fragmentation(authors), "author_fragmentation"), (stable, "commit_stability"),
        (hotspot_concentration(files), "hotspot_concentration"), (coupling(pairs, strong), "temporal_coupling_pct"),
    ]
    values = [frame.select("repo_id", F.lit(name).alias("metric"), F.col(name).alias("value")) for frame, name in found]
    out = values[0]
    for p in values[1:]:
        out = out.unionByName(p)
    return out.withColumn("available", F.col("value").isNotNull())
