"""Clone detection: statement windows, their groups, duplicated lines and clone pairs.

``statements`` has repo_id, file, block, pos, hash, start and end: one row for
each statement of a block. A window is a run of consecutive statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import percentage
from gaugeworks.operators.steps import kept

#: Statements and lines of the smallest window.
LEAST_STATEMENTS, LEAST_LINES = 3, 6
#: A key is common if it has more than one in so many of the rows that are looked at; so there are fewer of them.
OFTEN = 1024
#: Long windows are those of which there is at most one for so many lines; they are looked at first.
LINES_A_LONG_WINDOW = 16
#: Parts into which a range of lengths is cut at a time, so that few passes find a length.
PARTS_OF_RANGE = 8


def _reach(statements: DataFrame, lines: int) -> DataFrame:
    """``statements`` with ``at`` (their number in the block), ``last`` (that of the block's last one), ``upto`` (the
    first statement with which a window from here spans enough lines) and ``since`` (the last from which a window to
    here does); null if there is none.

    Ends of lines are asked for and found in one sorted pass each: a running minimum over the block's statements
    by their end, downwards, and a running maximum by their start, upwards. All passes need the rows of a block
    together and nothing else, so they share one shuffle; the two answers meet by a grouping inside it.
    """
    block = ["repo_id", "file", "block"]
    rows = statements.withColumn("at", F.row_number().over(Window.partitionBy(*block).orderBy("pos")))
    rows = rows.withColumn("last", F.max("at").over(Window.partitionBy(*block)))
    ends = rows.select("*", F.explode(F.array(
        F.struct((F.col("start") + lines - 1).alias("key"), F.lit(0).alias("gives"), F.lit(1).alias("kind")),
        F.struct(F.col("end").alias("key"), F.lit(1).alias("gives"), F.lit(1).alias("kind")),
        F.struct((F.col("end") - lines + 1).alias("key"), F.lit(0).alias("gives"), F.lit(2).alias("kind")),
        F.struct(F.col("start").alias("key"), F.lit(1).alias("gives"), F.lit(2).alias("kind")),
    )).alias("e")).select(*rows.columns, "e.*")
    # Upwards for the starts, downwards for the ends; of equal keys those that give come first.
    order = Window.partitionBy(*block).orderBy("kind", F.when(F.col("kind") == 1, -F.col("key")).otherwise(F.col("key")), F.desc("gives")).rowsBetween(Window.unboundedPreceding, 0)
    down, up = (F.when((F.col("gives") == 1) & (F.col("kind") == k), F.col("at")) for k in (1, 2))
    found = ends.withColumn("to", F.when(F.col("kind") == 1, F.min(down).over(order)).otherwise(F.max(up).over(order))).where("gives = 0")
    return found.groupBy(*rows.columns).agg(F.max(F.when(F.col("kind") == 1, F.col("to"))).alias("upto"), F.max(F.when(F.col("kind") == 2, F.col("to"))).alias("since"))


def _name(value: Column) -> Column:
    """A name of 16 bytes; null for null."""
    return F.unhex(F.md5(value))


def _of_repeated(frame: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key occurs more than once. A key of more than a ``OFTEN``th of these rows, of which there are
    fewer than ``OFTEN``, is met by broadcast, so that no task gets all rows of a common key."""
    counts = kept(frame.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * OFTEN > total).select(*key, F.lit(True).alias("often"))
    rows = frame.join(F.broadcast(often), key, "left")
    seldom = counts.where(F.col("n") * OFTEN <= total).select(*key)
    return rows.where("often").drop("often").unionByName(rows.where("often is null").drop("often").join(seldom, key, "left_semi"))


def deciding_windows(statements: DataFrame, least: int = LEAST_STATEMENTS, lines: int = LEAST_LINES, parts: int | None = None) -> DataFrame:
    """The windows that decide which lines are duplicated, of any length: repo_id, file, hash, start, end, size.

    Let two equal runs of statements span enough lines each. The shortest windows of enough lines in both, from
    each of their statements on and up to each of them, are equal as well and cover all of them. As they are
    shortest, their size is that of a shortest window in one of the two. So a window from a statement is taken
    at the sizes that are shortest for a statement whose first ``least`` statements are the same, and likewise up
    to a statement; where these occur once there is nothing to take.

    Statements are named by doubling: the hash of 2 k statements is that of two hashes of k, one step of ``lead``
    each, and a window of any size is named by its first and its last power of two. So no window is ever
    gathered, and a row moves along with its names only. ``parts`` is the number of partitions that the names are
    carried in; without it the session's. The steps before take the partitions of ``statements`` if these lie by block.
    """
    block = ["repo_id", "file", "block"]
    order = Window.partitionBy(*block).orderBy("at")
    half = least.bit_length() - 1

    def doubled(frame: DataFrame, count: int) -> DataFrame:
        for t in range(count):
            frame = frame.withColumn(f"f{t + 1}", _name(F.concat(f"f{t}", F.lead(f"f{t}", 1 << t).over(order))))
        return frame

    rows = _reach(statements.withColumn("hash", _name(F.col("hash").cast("string"))), lines)
    longer, back = F.greatest(F.col("upto") - F.col("at") + 1, F.lit(least)), F.greatest(F.col("at") - F.col("since") + 1, F.lit(least))
    rows = rows.withColumn("longer", F.when(F.col("upto").isNotNull() & (F.col("at") + longer - 1 <= F.col("last")), longer))
    rows = rows.withColumn("back", F.when(F.col("since").isNotNull() & (F.col("at") >= back), back))
    first = _name(F.concat(f"f{half}", F.lead(f"f{half}", least - (1 << half)).over(order)))
    rows = doubled(rows.withColumnRenamed("hash", "f0"), half).withColumn("first", first)
    rows = reached = kept(rows.select(*block, "at", "start", "end", "last", "longer", "back", "f0", "first"))
    most = rows.agg(F.max(F.greatest("longer", "back"))).first()[0] or least
    steps = max(int(most).bit_length() - 1, half)
    # An equal window begins and ends with statements that occur again; all other rows go before names are carried.
    again = kept(_of_repeated(rows.select(*block, "at", "first").where("first is not null"), ["repo_id", "first"]))
    # Both go to their block in one shuffle; a row's mark is the row of ``again`` beside it.
    marked = rows.drop("first").withColumn("first", F.lit(None).cast("binary")).unionByName(again, allowMissingColumns=True)
    marked = marked.repartition(parts, *block) if parts else marked.repartition(*block)
    marked = marked.withColumn("first", F.max("first").over(Window.partitionBy(*block, "at"))).where("f0 is not null")
    rows = doubled(marked, steps).withColumn("final", F.lag("first", least - 1).over(order))
    forward = F.array(*(F.col(f"f{t}") for t in range(steps + 1))).alias("forward")
    backward = F.array(*(F.lag(f"f{t}", (1 << t) - 1).over(order) for t in range(steps + 1))).alias("backward")
    rows = kept(rows.select(*block, "at", "start", "end", "last", "longer", "back", "first", "final", forward, backward).where("first is not null or final is not null"), reached, again)

    def sized(name: str, own: str) -> DataFrame:
        """Rows with each ``size``, at least their own, that is shortest for one of several rows of one name."""
        met = rows.where(F.col(own).isNotNull() & F.col(name).isNotNull())
        sizes = met.select("repo_id", name, F.col(own).alias("size")).distinct()
        return met.join(sizes, ["repo_id", name]).where(F.col("size") >= F.col(own))

    ahead = sized("first", "longer").where("at + size - 1 <= last").select(*block, "at", "size")
    behind = sized("final", "back").where("at >= size").select(*block, (F.col("at") - F.col("size") + 1).alias("at"), "size")
    windows = kept(ahead.union(behind).distinct())
    power = F.floor(F.log2("size")).cast("int")
    heads = rows.select(*block, "at", "start", "forward")
    tails = rows.select(*block, F.col("at").alias("to"), "end", "backward")
    whole = windows.join(heads, [*block, "at"]).withColumn("to", F.col("at") + F.col("size") - 1).join(tails, [*block, "to"])
    name = F.md5(F.concat(F.col("size").cast("string").cast("binary"), F.get("forward", power), F.get("backward", power)))
    # Kept, as those who group windows read them more than once.
    return kept(whole.select("repo_id", "file", name.alias("hash"), "start", "end", F.col("size").cast("int").alias("size")))


def _lines(texts: DataFrame) -> DataFrame:
    """The texts with ``lines``, the names of their lines in order, in place of the text."""
    kept_columns = [c for c in texts.columns if c != "text"]
    return texts.where("text is not null").select(*kept_columns, F.transform(F.split("text", "\n"), _name).alias("lines"))


def _beside(size: Column | int) -> list[Column]:
    """For each place of ``lines``, the name of the line before it and of the line after a window of ``size`` from it."""
    before = F.concat(F.array(F.lit(None).cast("binary")), "lines")
    return [before.alias("before"), F.slice("lines", size + 1, F.size("lines")).alias("after")]


def line_windows(texts: DataFrame, size: int, around: bool = False) -> DataFrame:
    """All windows of ``size`` lines of texts (repo_id, file, text): repo_id, file, hash, start, end; ``around`` adds
    ``before`` and ``after``, the names of the lines beside a window, null where its file begins or ends."""
    return _windows(_lines(texts), size, around)


def _windows(lines: DataFrame, size: int, around: bool) -> DataFrame:
    """``line_windows`` of files with their ``lines``. A row has all lines of its file, so nothing moves: the lines
    are zipped with themselves, moved by one each, and a row for each place is made of that."""
    moved = [F.slice("lines", k + 1, F.size("lines")).alias(f"line_{k}") for k in range(size)]
    beside = ["before", "after"] if around else []
    rows = lines.select("repo_id", "file", F.posexplode(F.arrays_zip(*moved, *(_beside(size) if around else []))).alias("pos", "at")).where(f"at.line_{size - 1} is not null")
    name = _name(F.concat(*(F.col(f"at.line_{k}") for k in range(size))))
    return rows.select("repo_id", "file", name.alias("hash"), (F.col("pos") + 1).alias("start"), (F.col("pos") + size).alias("end"), *(F.col(f"at.{x}") for x in beside))


def _long_windows(lines: DataFrame, least: int, sizes: list[int]) -> DataFrame:
    """``_windows`` with the lines beside them of all ``sizes``, each ``own`` lines long. A size is ``least`` doubled
    some times, and names of twice the size are made of two names inside the row of the file."""
    def named(names: str, count: int, step: int) -> Column:
        """A name for each place that has ``count`` of the ``names``, ``step`` apart; null if there is none."""
        last = F.size(names) - (count - 1) * step - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _name(F.concat(*(F.get(names, i + k * step) for k in range(count))))))

    rows, size = lines.where(F.size("lines") >= min(sizes)).withColumn(f"of_{least}", named("lines", least, 1)), least
    while size < max(sizes):
        rows, size = rows.withColumn(f"of_{2 * size}", named(f"of_{size}", 2, size)), 2 * size
    each = F.array(*(F.struct(F.lit(n).alias("own"), F.col(f"of_{n}").alias("names")) for n in sizes))
    rows = rows.select("repo_id", "file", "lines", F.explode(each).alias("of")).where("of.names is not null")
    rows = rows.select("repo_id", "file", F.col("of.own").alias("own"), F.posexplode(F.arrays_zip(F.col("of.names").alias("hash"), *_beside(F.col("of.own")))).alias("pos", "at"))
    rows = rows.where("at.hash is not null")
    return rows.select("repo_id", "file", "at.hash", (F.col("pos") + 1).alias("start"), (F.col("pos") + F.col("own")).alias("end"), "at.before", "at.after", "own")


def _duplicated(windows: DataFrame, *also: str) -> DataFrame:
    """``duplicated_windows`` with all columns and ``leader``, the file, start and columns ``also`` of the first window of its class."""
    leader = F.min(F.struct("file", "start", *also)).alias("leader")
    spread = windows.where("file is not null").groupBy("repo_id", "hash").agg(F.min("file").alias("least"), F.max("file").alias("most"), F.min("end").alias("min_end"), F.max("start").alias("max_start"), leader)
    joined = windows.where("file is not null").join(spread.where("least != most or min_end <= max_start"), ["repo_id", "hash"])
    found = joined.where((F.col("least") != F.col("most")) | (F.col("min_end") <= F.col("start")) | (F.col("max_start") >= F.col("end")))
    return found.select(*windows.columns, "leader")


def duplicated_windows(windows: DataFrame) -> DataFrame:
    """Windows that occur again without overlapping: in another file, or apart in the same one.

    A hash in several files is duplicated wherever it is. One in a single file has there a least end and a
    greatest start: a window has a partner if it ends before the latest start or starts after the first end. So one
    grouped pass decides and no pair is formed. Windows without a file or repository have no partner.
    """
    return _duplicated(windows).select("repo_id", "hash", "file", "start", "end")


def duplication_rate(windows: DataFrame, totals: DataFrame) -> DataFrame:
    """Per cent of a repository's lines (``totals``: repo_id, lines) inside duplicated windows."""
    spans = duplicated_windows(windows).groupBy("repo_id", "file", "start").agg(F.max("end").alias("end"))
    # A window adds those of its lines that lie beyond the ends of all that start before it.
    before = F.max("end").over(Window.partitionBy("repo_id", "file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, F.coalesce(before, F.lit(0))))
    marked = spans.withColumn("added", added).groupBy("repo_id").agg(F.sum("added").alias("duplicated_lines"))
    joined = totals.join(marked, "repo_id", "left").withColumn("duplicated_lines", F.coalesce("duplicated_lines", F.lit(0)))
    return joined.withColumn("duplication_rate", percentage(F.col("duplicated_lines"), F.col("lines")))


def clone_classes(windows: DataFrame) -> DataFrame:
    """One row for each class of equal windows that occur apart: repo_id, hash, copies, files and the first copy."""
    found = duplicated_windows(windows)
    first = F.min(F.struct("file", "start", "end"))
    grouped = found.groupBy("repo_id", "hash").agg(F.count("*").alias("copies"), F.min("file").alias("least"), F.max("file").alias("most"), first.alias("first"))
    files = found.select("repo_id", "hash", "file").distinct().groupBy("repo_id", "hash").agg(F.count("*").alias("files"))
    return grouped.join(files, ["repo_id", "hash"]).select("repo_id", "hash", "copies", "files", F.col("first.file").alias("first_file"), F.col("first.start").alias("first_start"), F.col("first.end").alias("first_end"))


def partners(windows: DataFrame) -> DataFrame:
    """Each duplicated window with one partner of its class that does not overlap it: repo_id, hash, file, start,
    end, partner_file, partner_start, partner_end.

    The partner is the first copy of the class (by file and start), if it lies apart; else (the window lies in
    that copy's file) the nearest copy after the window in its own file; else the first copy in another file.
    First copies are grouped minima, and the nearest copy is a running minimum over the copies of one file that
    begin at or after the window's end. So n copies give n rows, however many of them there are.
    """
    found = kept(duplicated_windows(windows))
    one = F.struct("file", "start", "end")
    firsts = kept(found.groupBy("repo_id", "hash").agg(F.min(one).alias("first")))
    joined = found.join(firsts, ["repo_id", "hash"])
    apart = (F.col("file") != F.col("first.file")) | (F.col("first.end") <= F.col("start")) | (F.col("first.start") >= F.col("end"))
    done = joined.where(apart).select("repo_id", "hash", "file", "start", "end", F.col("first").alias("p"))
    near = joined.where(~apart).drop("first")
    # The copies of the first one's file: each gives its start, and those that overlap the first ask from their end on.
    own = joined.where("file = first.file").select("repo_id", "hash", "file", F.col("start").alias("key"), F.lit(1).alias("gives"), "start", "end")
    asks = near.select("repo_id", "hash", "file", F.col("end").alias("key"), F.lit(0).alias("gives"), "start", "end")
    order = Window.partitionBy("repo_id", "hash", "file").orderBy(F.desc("key"), F.desc("gives")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.min(F.when(F.col("gives") == 1, F.struct("file", "start", "end"))).over(order)
    asked = own.unionByName(asks).withColumn("after", after).where("gives = 0")
    other = joined.where("file != first.file").groupBy("repo_id", "hash").agg(F.min(one).alias("other"))
    rest = asked.join(other, ["repo_id", "hash"], "left").select("repo_id", "hash", "file", "start", "end", F.coalesce("after", "other").alias("p"))
    every = done.unionByName(rest)
    return every.select("repo_id", "hash", "file", "start", "end", F.col("p.file").alias("partner_file"), F.col("p.start").alias("partner_start"), F.col("p.end").alias("partner_end"))


def longest_windows(texts: DataFrame, top: int = 5, least: int = LEAST_STATEMENTS) -> DataFrame:
    """The ``top`` longest pairs of equal windows of lines apart from each other, of any length, with windows inside
    longer ones counted as pairs of their own.

    A pair of windows lies in a maximal clone, and a clone of n lines holds k + 1 pairs of n - k lines; so the
    ``top`` longest clones, each cut to its ``top`` greatest lengths and first places, hold them all.
    """
    runs = _line_clones(texts, top, least)
    shorter = F.sequence(F.lit(0), F.least(F.lit(top - 1), F.col("line_count") - least))
    cut = runs.select("*", F.explode(shorter).alias("less")).withColumn("size", F.col("line_count") - F.col("less"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(top - 1), (F.col("n") - F.col("size")).cast("int")))).alias("on"))
    moved = [(F.col(f"start_{x}") + F.col("on")).alias(f"start_{x}") for x in "ab"]
    out = cut.select("repo_id", "file_a", moved[0], "file_b", moved[1], F.col("size").cast("int").alias("line_count"))
    ends = {f"end_{x}": F.col(f"start_{x}") + F.col("line_count") - 1 for x in "ab"}
    best = Window.partitionBy("repo_id").orderBy(F.desc("line_count"), "file_a", "start_a", "file_b", "start_b")
    out = out.withColumns(ends).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select("repo_id", "file_a", "start_a", "end_a", "file_b", "start_b", "end_b", "line_count", "rank")


def line_clones(texts: DataFrame, top: int = 5, least: int = LEAST_STATEMENTS) -> DataFrame:
    """The longest maximal clones of each repository's ``texts`` (repo_id, file, text) by lines, at any length.

    A clone is a run of equal lines at one distance in two files, or apart in one
    file, that no line before or after prolongs; in one file it ends where its copy
    begins. Of files with the same text, those after the first ``top`` + 2 always lose
    the tie of their equals and are left out. A length is found for each repository, ``least``
    doubled some times, of which there are ``top`` clones, but not of twice that (see ``_levels``);
    ``_longest_clones`` finds the exact one. Pairs are never more than a fixed number a window,
    however many copies a passage has (see ``_pairs``).
    """
    return _line_clones(texts, top, least).drop("n")


def _line_clones(texts: DataFrame, top: int, least: int) -> DataFrame:
    """``line_clones`` with ``n``, the lines for which each clone's two places agree, overlapping ones included."""
    copies = Window.partitionBy("repo_id", "key").orderBy("file")
    named = _lines(texts.where("repo_id is not null and file is not null").select("repo_id", "file", "text", _name(F.col("text")).alias("key")))
    lines = kept(named.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= top + 2).select("repo_id", "file", "lines"))
    return _longest_clones(_levels(lines, top, least), top)


def _levels(lines: DataFrame, top: int, least: int) -> DataFrame:
    """For each repository the duplicated windows of ``own`` lines, ``least`` doubled some times, the most of which
    there are ``top`` clones, with ``low`` and ``high``, a length of which there are and one of which there are not;
    if there never are, those of ``least`` lines, which is ``high``.

    Long windows are few and are made and tried first, all sizes at once. Only repositories which these don't settle
    go through all windows of ``least`` lines, which are doubled as long as any is duplicated, and down again.
    """
    n = F.size("lines")
    all_sizes = [least << k for k in range(29) if least << k < 1 << 31]
    total, *counts = lines.agg(F.sum(n), *(F.sum(F.greatest(n - size + 1, F.lit(0))) for size in all_sizes)).first()
    sizes = [size for size, count in zip(all_sizes, counts) if count]
    long = [size for size, count in zip(all_sizes, counts) if size > least and count and count * LINES_A_LONG_WINDOW <= total]
    windows = ["repo_id", "file", "hash", "start", "end", "before", "after"]
    bounds = [F.col("own").alias("low"), (2 * F.col("own")).alias("high")]
    out = None
    if long:
        found = kept(_duplicated(_long_windows(lines, least, long), "before", "after"))
        most = kept(_enough(found.withColumn("size", F.col("own")), top).groupBy("repo_id").agg(F.max("size").alias("own")))
        out = found.join(most, ["repo_id", "own"]).select(*windows, "own", *bounds)
        lines = lines.join(most, "repo_id", "left_anti")
    if out is not None and lines.isEmpty():
        return kept(out)
    levels = [(least, kept(_duplicated(_windows(lines, least, around=True)).drop("leader")))]
    while 2 * levels[-1][0] in sizes and 2 * levels[-1][0] not in long and not levels[-1][1].isEmpty():
        size, half = levels[-1]
        twice = _prolonged(half.withColumns({"own": F.lit(size), "size": F.lit(2 * size)})).drop("size")
        levels.append((2 * size, kept(_duplicated(twice).drop("leader"))))
    settled = None
    for size, level in reversed(levels):
        some = level if settled is None else level.join(settled, "repo_id", "left_anti")
        enough = kept(_enough(_led(some.withColumn("size", F.lit(size))), top).select("repo_id"))
        part = level.join(enough, "repo_id", "left_semi").withColumn("own", F.lit(size)).select(*windows, "own", *bounds)
        out = part if out is None else out.unionByName(part)
        settled = enough if settled is None else settled.union(enough)
    never = levels[0][1].join(settled, "repo_id", "left_anti").withColumns({"own": F.lit(least), "low": F.lit(least - 1), "high": F.lit(least)})
    return kept(out.unionByName(never))


def _led(windows: DataFrame) -> DataFrame:
    """Windows of ``_duplicated`` with their ``leader``, where it was not kept."""
    leaders = windows.groupBy("repo_id", "hash").agg(F.min(F.struct("file", "start", "before", "after")).alias("leader"))
    return windows.join(leaders, ["repo_id", "hash"])


def _enough(found: DataFrame, top: int) -> DataFrame:
    """repo_id and size, where the duplicated windows ``found`` show ``top`` clones of that size or more: every pair of
    a crowd (see ``_pairs``) is one, and where there is no crowd, they are as many as the pairs that begin differently."""
    enough = F.max("crowd") | (F.count_if("begins") >= top)
    return _pairs(found, top).groupBy("repo_id", "size").agg(enough.alias("enough")).where("enough").select("repo_id", "size")


def _prolonged(windows: DataFrame) -> DataFrame:
    """The windows of ``size`` lines, from half of it to all of it covered by each of the ``windows`` of ``own`` lines."""
    keys = ["repo_id", "file", "start", "size"]
    second = windows.select("repo_id", "file", (F.col("start") + F.col("own") - F.col("size")).alias("start"), "size", F.col("hash").alias("next"), F.col("end").alias("to"), F.col("after").alias("beyond"))
    joined = windows.join(second, keys)
    # The same two windows name others of another size.
    name = _name(F.concat(F.col("size").cast("string").cast("binary"), "hash", "next"))
    return joined.select("repo_id", "file", name.alias("hash"), "start", F.col("to").alias("end"), "before", F.col("beyond").alias("after"), "size")


def _pairs(found: DataFrame, top: int) -> DataFrame:
    """Pairs of equal windows of ``size`` lines that lie apart, from windows of ``_duplicated``: repo_id, file_a,
    start_a, file_b, start_b, size, ``begins`` (the lines before differ), ``ends`` (those after do) and ``crowd``.

    Of a class whose first window has 2 ``top`` windows after it that lie apart from it, a crowd, only the pairs of
    these are formed; all other classes give all their pairs. In those, whatever lies apart from any window lies
    apart from the first as well, so there are fewer than 2 ``top`` second places; the others overlap the first.
    """
    here = F.struct("file", "start", "before", "after")
    beyond = (F.col("file") > F.col("leader.file")) | ((F.col("file") == F.col("leader.file")) & (F.col("start") - F.col("leader.start") >= F.col("size") - 1))
    one = Window.partitionBy("repo_id", "hash")
    after = found.where(beyond).withColumn("at", F.row_number().over(one.orderBy("file", "start"))).where(F.col("at") <= 2 * top)
    after = kept(after.withColumn("crowd", F.count("*").over(one) == 2 * top).select("repo_id", "hash", "size", "leader", here.alias("b"), "crowd"))
    firsts = after.select("repo_id", F.col("leader").alias("a"), "b", "size", "crowd")
    near = (F.col("file") == F.col("leader.file")) & (F.col("start") > F.col("leader.start")) & ~beyond
    seconds = after.where("not crowd").select("repo_id", "hash", "b", "size", "crowd")
    others = found.where(near).select("repo_id", "hash", here.alias("a")).unionByName(seconds.select("repo_id", "hash", F.col("b").alias("a")))
    apart = (F.col("a.file") < F.col("b.file")) | ((F.col("a.file") == F.col("b.file")) & (F.col("b.start") - F.col("a.start") >= F.col("size") - 1))
    every = firsts.unionByName(others.join(seconds, ["repo_id", "hash"]).where(apart).select("repo_id", "a", "b", "size", "crowd"))
    differ = [~F.coalesce(F.col(f"a.{x}") == F.col(f"b.{x}"), F.lit(False)) for x in ("before", "after")]
    places = [F.col(f"{x}.{y}").alias(f"{y}_{x}") for x in "ab" for y in ("file", "start")]
    return every.select("repo_id", *places, "size", differ[0].alias("begins"), differ[1].alias("ends"), "crowd")


def _runs(pairs: DataFrame) -> DataFrame:
    """Clones from all pairs of equal windows of one size, joined where they follow one another."""
    diagonal = ["repo_id", "file_a", "file_b", "shift"]
    pairs = pairs.withColumn("shift", F.col("start_b") - F.col("start_a"))
    island = F.col("start_a") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("start_a"))
    runs = pairs.withColumn("island", island).groupBy(*diagonal, "island").agg(F.min("start_a").alias("start_a"), (F.count("*") + F.max("size") - 1).cast("int").alias("n"))
    count = F.when(F.col("file_a") == F.col("file_b"), F.least("n", F.col("shift") + 1)).otherwise(F.col("n")).cast("int")
    return runs.select("repo_id", "file_a", "start_a", "file_b", (F.col("start_a") + F.col("shift")).alias("start_b"), count.alias("line_count"), "n")


def _ranked(clones: DataFrame, top: int) -> DataFrame:
    """The ``top`` longest clones of each repository."""
    best = Window.partitionBy("repo_id").orderBy(F.desc("line_count"), "file_a", "start_a", "file_b", "start_b")
    ends = [(F.col(f"start_{x}") + F.col("line_count") - 1).alias(f"end_{x}") for x in "ab"]
    return clones.select("repo_id", "file_a", "start_a", ends[0], "file_b", "start_b", ends[1], "line_count", F.row_number().over(best).alias("rank"), "n").where(F.col("rank") <= top)


def _longest_clones(windows: DataFrame, top: int) -> DataFrame:
    """The longest clones of repositories from the ``windows`` of ``_levels``.

    The greatest length of which there are ``top`` clones, say m, lies from ``low`` to below ``high``; the range is cut
    in ``PARTS_OF_RANGE`` at a time. Fewer than ``top`` clones are
    longer than m, so they have no crowds and are known whole. Of those of m lines, clones whose second place
    begins on the last line of the first are found by their distance. Among the 2 ``top`` pairs of a crowd at most
    ``top`` - 1 belong to longer clones and one touches its first window, so ``top`` or more are clones of m
    lines, and no other pair of that class comes before them. A repository that never has ``top`` clones has
    all its clones among the longer ones.
    """
    bounds = kept(windows.select("repo_id", "low", "high").distinct())
    windows = windows.drop("low", "high")

    def found(size: DataFrame) -> DataFrame:
        return kept(_duplicated(_prolonged(windows.join(size, "repo_id").where("size >= own")), "before", "after"))

    while not (open_ := bounds.where("high - low > 1")).isEmpty():
        cuts = F.array_distinct(F.array(*(F.expr(f"cast(low + (high - low) * {k} div {PARTS_OF_RANGE} as int)") for k in range(1, PARTS_OF_RANGE))))
        sizes = open_.select("repo_id", F.explode(cuts).alias("size"), "low").where("size > low").drop("low")
        got = _enough(found(sizes), top).withColumn("enough", F.lit(True))
        tried = sizes.join(got, ["repo_id", "size"], "left").groupBy("repo_id").agg(F.max(F.when(F.col("enough"), F.col("size"))).alias("yes"), F.min(F.when(F.col("enough").isNull(), F.col("size"))).alias("no"))
        bounds = kept(bounds.join(tried, "repo_id", "left").select("repo_id", F.coalesce("yes", "low").alias("low"), F.coalesce("no", "high").alias("high")), bounds)
    level = found(bounds.select("repo_id", F.explode(F.array("low", "high")).alias("size")))
    pairs = _pairs(level, top).join(bounds, "repo_id")
    longer = _runs(pairs.where("size = high").drop("low", "high", "crowd"))
    exact = pairs.where("size = low and begins and ends and (file_a != file_b or start_b - start_a >= size)")
    exact = exact.select("repo_id", "file_a", "start_a", "file_b", "start_b", F.col("size").alias("line_count"), F.col("size").alias("n"))
    place = [F.col("file").alias("file_a"), F.col("start").alias("start_a"), F.col("file").alias("file_b"), F.col("end").alias("start_b")]
    level = level.join(bounds, "repo_id").where("size = low")
    again = level.select("repo_id", "hash", F.col("file").alias("file_b"), F.col("start").alias("start_b"))
    touching = _runs(level.select("repo_id", "hash", *place, "size").join(again, ["repo_id", "hash", "file_b", "start_b"]))
    return _ranked(longer.unionByName(exact).unionByName(touching), top)
