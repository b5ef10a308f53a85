"""Bounded traversal, reachability and cycles over edge tables.

Each level is one join of the frontier with the edges and an anti-join with what
has been visited. Only the new frontier is written, with checkpoint(), whose files
all executors share; what has been visited is the union of the frontiers. Nothing
but counts comes to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint as cut


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth): the first level at which a node is reached; seeds have 0. Without a depth, all that can be reached."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("__to")).distinct()
    visited = frontier = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    for level in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(e, "node").select(F.col("__to").alias("node")).distinct()
        frontier = cut(reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def hierarchy(edges: DataFrame, root: str, depth: int | None = None, child: str = "child", parent: str = "parent") -> DataFrame:
    """All descendants of a name, cycle-safe; the root needs no row of its own."""
    seed = edges.sparkSession.createDataFrame([(root,)], "node string")
    return bfs(edges, seed, depth, parent, child).where("depth > 0")


def inbound(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Uses of each symbol: by resolved target, or by name where unresolved; each place once."""
    from ..functions import text as t

    direct = refs.where("to_symbol is not null").select(F.col("to_symbol").alias("qualname"), "kind", "from_file", "from_line", "confidence")
    named = symbols.select("qualname", t.last_segment("qualname").alias("__last"))
    loose = refs.where("to_symbol is null").withColumn("__last", t.last_segment("to_name")).join(named, "__last").select("qualname", "kind", "from_file", "from_line", "confidence")
    return direct.unionByName(loose).distinct().join(symbols.select("qualname").distinct(), "qualname", "left_semi")


def _reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node) pairs reached along the edges from (root, node) seeds, within a root's part."""
    visited = frontier = cut(seeds.distinct())
    while True:
        step = frontier.join(edges, ["part", "node"]).select("part", F.col("to").alias("node")).distinct()
        frontier = cut(step.join(visited, ["part", "node"], "left_anti"))
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


#: Edge tables up to this size (it is checked) are worked out in one task.
ONE_TASK = 200_000


def _tarjan(pairs) -> list[tuple[str, str]]:
    """(node, component) of a small graph, without recursion."""
    ahead: dict[str, list[str]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    inside: set[str] = set()
    out = []
    for start in sorted(ahead):
        if start in number:
            continue
        work = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        open_.append(start)
        inside.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    open_.append(to)
                    inside.add(to)
                    work.append((to, iter(ahead[to])))
                    break
                if to in inside:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    at = open_.index(node)
                    held = open_[at:]
                    del open_[at:]
                    inside.difference_update(held)
                    out += [(x, min(held)) for x in held]
    return out


def _components_in_one_task(edges: DataFrame) -> DataFrame:
    def run(frames):
        import pandas as pd

        pairs = [p for f in frames for p in f.itertuples(index=False)]
        yield pd.DataFrame(_tarjan(pairs), columns=["node", "component"])

    return edges.coalesce(1).mapInPandas(run, "node string, component string")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 1000, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): forward-backward reachability from one pivot of each part, all parts at once.

    What a pivot reaches and is reached from is its component; the rest falls into
    three parts that no cycle crosses. Nodes without an edge in or out are trimmed
    first. Work is linear in the edges for each round, not in reachable pairs.
    """
    e = cut(edges.select(F.col(src).cast("string").alias("node"), F.col(dst).cast("string").alias("to")).where("node != to").distinct())
    if e.count() <= one_task:
        return _components_in_one_task(e)
    nodes = e.select("node").union(e.select("to")).distinct()
    rest = cut(nodes.withColumn("part", F.lit("")))
    done = None
    for _ in range(rounds):
        inner = cut(e.join(rest, "node").join(rest.select(F.col("node").alias("to"), F.col("part").alias("__p")), "to").where("part = __p").select("part", "node", "to"))
        live = cut(rest.join(inner.select("node").intersect(inner.select(F.col("to").alias("node"))), "node", "left_semi").select("node", "part"))
        alone = rest.join(live, "node", "left_anti").select("node", F.col("node").alias("component"))
        done = cut(alone if done is None else done.unionByName(alone))
        if live.isEmpty():
            return done
        if live.count() < rest.count():
            rest = live
            continue
        pivots = cut(live.groupBy("part").agg(F.min("node").alias("pivot")))
        seeds = pivots.select("part", F.col("pivot").alias("node"))
        ahead = _reach(inner, seeds).withColumn("__f", F.lit(1))
        behind = _reach(inner.select("part", F.col("to").alias("node"), F.col("node").alias("to")), seeds).withColumn("__b", F.lit(1))
        seen = cut(live.join(ahead, ["part", "node"], "left").join(behind, ["part", "node"], "left").join(pivots, "part"))
        found = seen.where("__f = 1 and __b = 1").select("node", F.col("pivot").alias("component"))
        done = cut(done.unionByName(found))
        left = seen.where("__f is null or __b is null")
        rest = cut(left.select("node", F.sha2(F.concat_ws(":", "part", "pivot", F.coalesce(F.col("__f"), F.lit(0)), F.coalesce(F.col("__b"), F.lit(0))), 256).alias("part")))
    raise RuntimeError("components need more rounds")


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of two nodes or more: (component, size, members), smallest first."""
    parts = strong_components(edges, src, dst).groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    least = parts.where("size > 1").select(F.element_at("members", 1).alias("component"), "size", "members")
    return least.orderBy("size", "members")


def reference_rank(files: DataFrame, names: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Score of each file: in how many other files its names occur, by document frequency minus itself.

    ``names`` has (file, name, weight): a module's own name weighs 2, a symbol 1.
    """
    from ..functions import text as t

    tokens = files.select(file, F.explode(t.identifiers(text)).alias("name"))
    wanted = names.select("name").distinct()
    df = tokens.join(wanted, "name", "left_semi").groupBy("name").agg(F.count("*").alias("df"))
    own = names.join(tokens.withColumn("own", F.lit(1)), [file, "name"], "left").join(df, "name", "left")
    return own.groupBy(file).agg(F.sum(F.col("weight") * (F.coalesce("df", F.lit(0)) - F.coalesce("own", F.lit(0)))).alias("score"))


def impact(target: str, refs: DataFrame, symbols: DataFrame, parents: DataFrame, tests: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(symbols reached, tests that cover their files): uses, and then the uses of what encloses them.

    A use outside every symbol reaches its module, which goes no further. ``parents``
    has (child, parent) names of bases and interfaces. The first level that reaches
    a symbol counts.
    """
    from ..functions import text as t
    from . import index, intervals

    spans = symbols.select(F.col("file").alias("from_file"), F.col("qualname").alias("user"), "line_start", "line_end")
    # What encloses a use depends on its place alone.
    places = refs.select("from_file", "from_line").distinct()
    placed = intervals.innermost(places, ["from_file", "from_line"], "from_line", spans, "line_start", "line_end", ["from_file"], 200).select("from_file", "from_line", "user")
    module = F.concat("from_file", F.lit("::<module>"))
    uses = refs.join(placed, ["from_file", "from_line"], "left").select(F.coalesce("to_symbol", "to_name").alias("used"), F.coalesce("user", module).alias("user")).select(t.last_segment("used").alias("src"), F.col("user").alias("dst"))
    kin = parents.select(t.last_segment("parent").alias("src"), t.last_segment("child").alias("__last")).join(symbols.select(t.last_segment("qualname").alias("__last"), F.col("qualname").alias("dst")), "__last").select("src", "dst")
    named = uses.union(kin).join(symbols.select(t.last_segment("qualname").alias("src"), F.col("qualname").alias("from")), "src").select(F.col("from").alias("src"), "dst").distinct()
    seed = index.symbol_match(symbols, target).select("qualname")
    reached = bfs(named, seed, depth)
    files = reached.select(F.split_part("node", F.lit("::"), F.lit(1)).alias("target_file")).distinct()
    return reached, tests.join(files, "target_file", "left_semi").select("test_file").distinct()


def tests_for(changed: DataFrame, tests: DataFrame, imports: DataFrame, depth: int = 2) -> DataFrame:
    """(test_file, layer) for changed files: recorded coverage, changed tests, names, then imports that lead to a test."""
    from . import index

    c = changed.select(F.col(changed.columns[0]).alias("target_file")).distinct()
    linked = lambda source: tests.where(F.col("source") == source).join(c, "target_file", "left_semi").select("test_file")
    known = tests.select("test_file").distinct()
    own = c.select(F.col("target_file").alias("test_file")).join(known, "test_file", "left_semi")
    reached = bfs(imports, c, depth, "dst", "src").where("depth > 0").select(F.col("node").alias("test_file")).join(known, "test_file", "left_semi")
    return index.layered_union([("coverage", linked("coverage")), ("changed", own), ("convention", linked("convention")), ("import", reached)], ["test_file"])
