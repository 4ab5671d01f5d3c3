"""Import graphs: resolution, degrees, fan-out, depth, cycles, dead exports.

Edges have repo_id, src and dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.steps import kept
from gaugeworks.operators.summary import language_rank

#: Edges of a graph up to which it is handled as one row; the bits of a long bound it.
SMALL_EDGES = 62


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges from imports (repo_id, src, target) to known modules (repo_id, module); self-edges go."""
    known = modules.select("repo_id", F.col("module").alias("target")).distinct()
    return imports.join(known, ["repo_id", "target"]).where("src != target").select("repo_id", "src", F.col("target").alias("dst")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """All ends of edges."""
    return edges.select("repo_id", F.col("src").alias("node")).union(edges.select("repo_id", F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Efferent (out) and afferent (in) degree of each node; nodes without edges have zeros."""
    out = edges.groupBy("repo_id", F.col("src").alias("node")).agg(F.count("*").alias("efferent"))
    into = edges.groupBy("repo_id", F.col("dst").alias("node")).agg(F.count("*").alias("afferent"))
    base = members if members is not None else nodes(edges)
    joined = base.join(out, ["repo_id", "node"], "left").join(into, ["repo_id", "node"], "left")
    return joined.select("repo_id", "node", F.coalesce("efferent", F.lit(0)).alias("efferent"), F.coalesce("afferent", F.lit(0)).alias("afferent"))


def fan_out(degree: DataFrame, only_with_edges: bool = False) -> DataFrame:
    """Mean and largest efferent degree, and the first node that has it."""
    rows = degree.where("efferent > 0") if only_with_edges else degree
    top = rows.groupBy("repo_id").agg(F.avg("efferent").alias("fanout_avg"), F.max("efferent").alias("fanout_max"))
    first = rows.join(top.select("repo_id", F.col("fanout_max").alias("efferent")), ["repo_id", "efferent"]).groupBy("repo_id").agg(F.min("node").alias("fanout_max_node"))
    return top.join(first, "repo_id")


def depth(path: Column) -> Column:
    """Folders above a file."""
    return F.size(F.split(path, "/")) - 1


def depth_summary(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Greatest and mean depth of a repository's files."""
    d = depth(F.col(path))
    return files.groupBy("repo_id").agg(F.max(d).alias("max_depth"), F.avg(d).alias("avg_depth"))


def segment_summary(imports: DataFrame, target: str = "target") -> DataFrame:
    """Mean and greatest number of segments of import paths."""
    n = F.size(F.split(target, "/"))
    return imports.groupBy("repo_id").agg(F.avg(n).alias("segments_avg"), F.max(n).alias("segments_max"))


def dead_exports(exports: DataFrame, used: DataFrame, units: DataFrame) -> DataFrame:
    """Exports (repo_id, unit, name, ...) that no row of ``used`` (repo_id, unit, name) needs.

    Repositories with a single unit have none: ``units`` gives repo_id and unit.
    """
    several = units.select("repo_id", "unit").distinct().groupBy("repo_id").agg(F.count("*").alias("n")).where("n > 1").select("repo_id")
    return exports.join(several, "repo_id", "left_semi").join(used, ["repo_id", "unit", "name"], "left_anti")


def dead_names(definitions: DataFrame, imported: DataFrame, files: DataFrame) -> DataFrame:
    """Definitions (repo_id, name, file, ...) whose name nothing imports anywhere, in repositories with several files."""
    several = files.select("repo_id", "file").distinct().groupBy("repo_id").agg(F.count("*").alias("n")).where("n > 1").select("repo_id")
    return definitions.join(several, "repo_id", "left_semi").join(imported.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_anti")


def module_of(path: Column) -> Column:
    """The dotted module of a Python file; a package's own file stands for the package."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def relative_module(module: Column, level: Column, name: Column) -> Column:
    """The absolute module of a relative import: ``level`` dots up from the importing module."""
    parts = F.split(module, r"\.")
    kept = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - level))
    return F.array_join(F.concat(kept, F.when(F.length(name) > 0, F.array(name)).otherwise(F.array().cast("array<string>"))), ".")


def script_path(folder: Column, target: Column) -> Column:
    """A relative import of a script file as a path without extension or trailing index."""
    joined = F.split(F.concat_ws("/", folder, target), "/")
    start = F.array().cast("array<string>")
    folded = F.aggregate(joined, start, lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, p)))
    return F.regexp_replace(F.regexp_replace(F.array_join(folded, "/"), r"\.(tsx?|jsx?)$", ""), r"/index$", "")


def imported_names(*sources: DataFrame) -> DataFrame:
    """All names (repo_id, name) that some source has, each once."""
    out = sources[0].select("repo_id", "name")
    for s in sources[1:]:
        out = out.union(s.select("repo_id", "name"))
    return out.distinct()


def merged_fan_out(by_language: DataFrame) -> DataFrame:
    """Over languages (repo_id, language, fanout_avg, fanout_max, fanout_max_node): all of the one with the larger maximum, the first of equals."""
    best = F.min_by(F.struct("fanout_avg", "fanout_max", "fanout_max_node"), F.struct((-F.col("fanout_max")).alias("m"), language_rank(F.col("language")).alias("r")))
    return by_language.groupBy("repo_id").agg(best.alias("b")).select("repo_id", "b.*")


def merged_depth(by_language: DataFrame) -> DataFrame:
    """Over languages: the greatest depth and the greatest mean."""
    return by_language.groupBy("repo_id").agg(F.max("max_depth").alias("max_depth"), F.max("avg_depth").alias("avg_depth"))


def intra_module(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports (repo_id, target, ...) whose path begins with the repository's module path (repo_id, module)."""
    return imports.join(modules, "repo_id").where(F.col("target").startswith(F.col("module")))


def module_paths(files: DataFrame, module_files: DataFrame) -> DataFrame:
    """The module path of each file (repo_id, rel_path): that of the nearest folder upwards with a module file
    (repo_id, rel_path, content); else the first three parts of its path."""
    name = F.trim(F.regexp_extract("content", r"(?m)^[ \t]*module (.*)$", 1))
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    known = module_files.select("repo_id", folder.alias("folder"), name.alias("module")).where("module != ''")
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = files.select("repo_id", "rel_path", F.explode(F.array_distinct(above)).alias("folder"))
    nearest = up.join(known, ["repo_id", "folder"]).groupBy("repo_id", "rel_path").agg(F.max_by("module", F.length("folder")).alias("module"))
    return files.select("repo_id", "rel_path").join(nearest, ["repo_id", "rel_path"], "left").withColumn("module", F.coalesce("module", F.array_join(F.slice(F.split("rel_path", "/"), 1, 3), "/")))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Nodes that lie on cycles, with the smallest node of their strongly connected component: repo_id, node, component.

    Nodes without an edge in or out are trimmed. Then every node learns the smallest node that leads to it, by
    labels that travel along the edges; a node that keeps its own label is a root, and those of its label from
    which it can be reached, against the edges, are its component. These are taken out, and the rest goes on.
    A step is one join by (repository, node) and a grouped minimum, and a table holds no more than a row for each
    node and each edge; no pair of nodes is ever listed. Graphs of at most ``SMALL_EDGES`` edges are done as a row each.
    """
    few, many = _by_size(edges)
    rows = _small(few).select("repo_id", F.explode(F.filter("members", lambda m: m["size"] > 1)).alias("m")).select("repo_id", "m.node", "m.component")
    return rows if many is None else rows.unionByName(_large_components(many))


def _by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct edges between two nodes, of small graphs and of the others (none: no such graph). Large graphs are fewer
    than edges by a factor of ``SMALL_EDGES``, so edges are told apart by a table of these."""
    proper = kept(edges.where("repo_id is not null and src != dst").select("repo_id", "src", "dst").distinct())
    large = kept(proper.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_EDGES).select("repo_id"))
    if large.isEmpty():
        return proper, None
    # Selected again, so that the steps over large graphs do not let go of a table which is read once more for cycles.
    return proper.join(large, "repo_id", "left_anti"), kept(proper.join(large, "repo_id", "left_semi")).select("repo_id", "src", "dst")


def _small(edges: DataFrame) -> DataFrame:
    """Small graphs, a row each: names (those that edges start from, in order; a node is its place among them from 0),
    links (for each node the nodes it leads to, as bits), and members (node, at, component, size).

    A node without an edge out lies on no cycle, so at most ``SMALL_EDGES`` nodes are left, a bit each in a long.
    """
    graphs = edges.groupBy("repo_id").agg(F.array_sort(F.collect_set("src")).alias("names"), F.collect_list(F.struct("src", "dst")).alias("edges"))
    place = lambda x: F.array_position("names", x) - 1
    inner = F.filter("edges", lambda e: F.array_contains("names", e["dst"]))
    graphs = graphs.select("repo_id", "names", F.transform(inner, lambda e: F.struct(place(e["src"]).cast("int").alias("s"), place(e["dst"]).cast("int").alias("d"))).alias("edges"))
    every = F.sequence(F.lit(0), F.size("names") - 1)
    into = lambda k: F.aggregate(F.filter("edges", lambda e: e["s"] == k), F.lit(0).cast("long"), lambda acc, e: acc.bitwiseOR(_bit(e["d"])))
    graphs = graphs.select("repo_id", "names", F.transform(every, into).alias("links"))
    through = lambda reach, k: F.transform(reach, lambda r: F.when(_has(r, k), r.bitwiseOR(F.get(reach, k))).otherwise(r))
    graphs = graphs.withColumn("reach", F.aggregate(every, F.col("links"), through))
    mates = lambda k: F.filter(every, lambda j: (j == k) | (_has(F.get("reach", k), j) & _has(F.get("reach", j), k)))
    graphs = graphs.withColumn("mates", F.transform(every, mates))
    member = lambda m, k: F.struct(F.get("names", k).alias("node"), k.alias("at"), F.get("names", F.get(m, F.lit(0))).alias("component"), F.size(m).alias("size"))
    return graphs.select("repo_id", "names", "links", F.transform("mates", member).alias("members"))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _has(bits: Column, k: Column) -> Column:
    return F.call_function("getbit", bits, k.cast("int")) == 1


def _large_components(now: DataFrame) -> DataFrame:
    """The components of graphs of any size, by steps over all of them: repo_id, node, component."""
    edges, out = now, None
    while not (now := _trimmed(now)).isEmpty():
        found = _rooted(now, _reached_from(now))
        out = found if out is None else kept(out.unionByName(found))
        gone = found.select("repo_id", F.col("node").alias("gone"))
        now = kept(now.join(gone.withColumnRenamed("gone", "src"), ["repo_id", "src"], "left_anti").join(gone.withColumnRenamed("gone", "dst"), ["repo_id", "dst"], "left_anti").select("repo_id", "src", "dst"))
    if out is None:
        return edges.select("repo_id", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    several = out.groupBy("repo_id", "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return out.join(several, ["repo_id", "component"], "left_semi").select("repo_id", "node", "component")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose ends both have an edge in and an edge out, again and again."""
    before = edges.count()
    while True:
        ends = edges.select("repo_id", F.col("dst").alias("src")).distinct()
        starts = edges.select("repo_id", F.col("src").alias("dst")).distinct()
        rest = kept(edges.join(ends, ["repo_id", "src"], "left_semi").join(starts, ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"), edges)
        after = rest.count()
        if after == before:
            return rest
        edges, before = rest, after


def _reached_from(edges: DataFrame) -> DataFrame:
    """(repo_id, node, label): the smallest node from which each node can be reached, itself included."""
    labels = kept(nodes(edges).withColumn("label", F.col("node")))
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "src"), ["repo_id", "src"]).groupBy("repo_id", F.col("dst").alias("node")).agg(F.min("label").alias("got"))
        moved = labels.join(sent, ["repo_id", "node"], "left").select("repo_id", "node", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("new"))
        after = kept(moved, labels)
        labels = after.drop("new")
        if after.where("new").isEmpty():
            return labels


def _rooted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo_id, node, component): the nodes that reach the root of their label without leaving the label."""
    src, dst = (labels.select("repo_id", F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in ("src", "dst"))
    inside = edges.join(src, ["repo_id", "src"]).join(dst, ["repo_id", "dst"]).where("src_label = dst_label")
    inside = kept(inside.select("repo_id", F.col("src").alias("node"), "dst", F.col("src_label").alias("component")))
    found = fresh = kept(labels.where("node = label").select("repo_id", "node", F.col("label").alias("component")))
    while True:
        back = inside.join(fresh.select("repo_id", F.col("node").alias("dst"), "component"), ["repo_id", "dst", "component"]).select("repo_id", "node", "component").distinct()
        fresh = kept(back.join(found, ["repo_id", "node", "component"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = kept(found.unionByName(fresh))


def cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The shortest cycles, one through each edge that lies on a cycle, each once: repo_id, cycle (nodes in order).

    A cycle begins and ends with its smallest node. Of an edge's shortest cycles it is the one whose nodes from
    the edge's end on come first in order. The end of each such edge is searched from, breadth first inside its
    component: a step is one join and a grouped minimum of paths, which are as long as the step. A search goes
    on only while the start of one of its edges is still to be met, so short cycles end it early.
    Graphs of at most ``SMALL_EDGES`` edges are done as a row each, unless their components are given.
    """
    if components is not None:
        return _large_cycles(edges, components)
    few, many = _by_size(edges)
    rows = _small_cycles(_small(few))
    return rows if many is None else rows.unionByName(_large_cycles(many, _large_components(many)))


def _small_cycles(graphs: DataFrame) -> DataFrame:
    """The cycles of small graphs: for each edge the layers of nodes that reach its start, then from its end the
    smallest node of each nearer layer."""
    zero = F.lit(0).cast("long")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda d: _has(F.get("links", s), d)), lambda d: F.struct(s.alias("s"), d.alias("d")))))
    inside = F.filter(pairs, lambda e: F.get("members", e["s"])["component"] == F.get("members", e["d"])["component"])
    one = graphs.select("repo_id", "names", "links", F.explode(inside).alias("e")).select("repo_id", "names", "links", "e.s", "e.d")
    every = F.sequence(F.lit(0), F.size("names") - 1)
    before = lambda layer: F.aggregate(every, zero, lambda acc, k: F.when(F.get("links", k).bitwiseAND(layer) != 0, acc.bitwiseOR(_bit(k))).otherwise(acc))
    start = F.struct(F.array(_bit(F.col("s"))).alias("layers"), _bit(F.col("s")).alias("seen"))

    def further(acc: Column, _: Column) -> Column:
        fresh = before(F.element_at(acc["layers"], -1)).bitwiseAND(F.bitwise_not(acc["seen"]))
        return F.when(_has(acc["seen"], F.col("d")), acc).otherwise(F.struct(F.array_append(acc["layers"], fresh).alias("layers"), acc["seen"].bitwiseOR(fresh).alias("seen")))

    one = one.withColumn("layers", F.aggregate(every, start, further)["layers"])
    nearer = F.slice(F.reverse("layers"), 2, F.size("layers"))
    lowest = lambda bits: F.get(F.filter(every, lambda k: _has(bits, k)), F.lit(0))
    path = F.aggregate(nearer, F.array("d"), lambda acc, layer: F.array_append(acc, lowest(F.get("links", F.element_at(acc, -1)).bitwiseAND(layer))))
    one = one.withColumn("path", path)
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at))
    # The same cycles of a graph come from the same rows of it, so they are made distinct by places, before names.
    each = one.select("repo_id", "names", turned.alias("turned")).groupBy("repo_id", "names").agg(F.collect_set("turned").alias("all"))
    return each.select("repo_id", "names", F.explode("all").alias("c")).select("repo_id", F.transform("c", lambda k: F.get("names", k)).alias("cycle"))


def _large_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The cycles of graphs of any size, by steps over all of them."""
    member = kept(components)
    src, dst = (member.select("repo_id", F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in ("src", "dst"))
    inside = edges.where("src != dst").select("repo_id", "src", "dst").distinct().join(src, ["repo_id", "src"]).join(dst, ["repo_id", "dst"])
    inside = kept(inside.where("src_component = dst_component").select("repo_id", "src", "dst"))
    wanted = kept(inside.select("repo_id", F.col("dst").alias("source"), F.col("src").alias("node")))
    front = wanted.select("repo_id", "source").distinct().select("repo_id", "source", F.col("source").alias("node"), F.array("source").alias("path"))
    seen, closed = kept(front.select("repo_id", "source", "node")), None
    while not wanted.isEmpty():
        step = front.join(wanted.select("repo_id", "source").distinct(), ["repo_id", "source"], "left_semi")
        step = step.join(inside.withColumnRenamed("src", "node"), ["repo_id", "node"]).select("repo_id", "source", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        fresh = step.join(seen, ["repo_id", "source", "node"], "left_anti")
        front = kept(fresh.groupBy("repo_id", "source", "node").agg(F.min("path").alias("path")))
        met = front.join(wanted, ["repo_id", "source", "node"], "left_semi").select("repo_id", "path")
        closed = kept(met if closed is None else closed.unionByName(met))
        wanted = kept(wanted.join(front, ["repo_id", "source", "node"], "left_anti"))
        seen = kept(seen.unionByName(front.select("repo_id", "source", "node")))
    if closed is None:
        return inside.select("repo_id", F.array("src").alias("cycle"))
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at))
    return closed.select("repo_id", turned.alias("cycle")).distinct()
