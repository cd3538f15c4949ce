"""Graph operators over ``src``, ``dst`` tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import freeze, ship


def reachable(edges: DataFrame, limit: int = 200) -> DataFrame:
    """All pairs (src, dst) with a path of at least one edge. Only pairs found in the last round are extended."""
    step = freeze(edges.select("src", "dst").distinct(), "edges")
    seen, fresh = step, step
    for _ in range(limit):
        grown = fresh.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
        fresh = freeze(grown.join(seen, ["src", "dst"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return seen
        seen = freeze(seen.union(fresh), "seen")
    raise RuntimeError("closure did not settle")


#: Members of a reachable set that one row holds; numbers that a component gathers as arrays, at most; members up to which a set
#: stays an array in a graph of any size. In a large one it does up to one in 32 of all numbers, from where bitmaps are smaller.
CHUNK, GATHER, FEW = 1 << 12, 1 << 20, 1 << 14


def _one_bits(rows: DataFrame) -> DataFrame:
    """Bitmaps of the numbers of each ``scc``, one per block of 32,768 numbers."""
    return rows.groupBy("scc", F.bitmap_bucket_number("number").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def _all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _in_order(placed: DataFrame) -> tuple[DataFrame, int]:
    """``node``, ``scc`` and ``number``, from 1 without gaps in the order of ``scc`` and ``node``; and how many there are."""
    runs = freeze(placed.sort("scc", "node").select("node", "scc", F.monotonically_increasing_id().alias("_id")), "ordered")
    total = runs.count()
    sizes = runs.groupBy(F.shiftright("_id", 33).alias("_run")).agg(F.count("*").alias("_n"))  # one row for each partition
    starts = sizes.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n") + 1).alias("_start"))
    number = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = runs.join(F.broadcast(starts), F.shiftright("_id", 33) == F.col("_run"))
    return freeze(placed.select("node", "scc", number.cast("int" if total < 1 << 31 else "long").alias("number")), "numbered"), total


def reachable_sets(edges: DataFrame, nodes: DataFrame | None = None, keep: bool = True, merge_every: int = 8) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Reachable sets without their pairs: ``node``, ``scc``, ``number`` of every node; ``scc``, ``part``, ``size``, ``dense``,
    ``few``; and ``scc``, ``block``, ``bits``, None if no set is dense.

    A set holds the numbers of the nodes that a component reaches, its own nodes among them. It is the arrays ``few``, in
    parts of ``CHUNK`` members from part 0, so that its room follows from its members, wherever they lie; or, if ``dense``, bitmaps
    of 32,768 numbers each. ``size`` is that of the whole set. Unless ``keep``, sets that no other one needs are only counted.

    Strong components are made one node; then, from the sinks up, a component's set is the union of its own and its
    successors' sets. Each set is made once, after those it needs. A component gathers up to ``GATHER`` numbers as arrays; if
    there are more or a successor is dense, bitmaps are united, which are pre-aggregated, so that none leaves its task for one edge."""
    edges = freeze(edges.select("src", "dst"), "edges")  # read five times below; a caller's may be a join of large tables
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    every = every.union(nodes.select("node")) if nodes is not None else every
    every = freeze(every.where("node is not null").distinct(), "nodes")
    scc = strong_components(edges.where("src is not null and dst is not null"))
    # in order of their components, so that the numbers of one are a range and sets that share members share blocks
    numbered, total = _in_order(every.join(scc, "node", "left").withColumn("scc", F.coalesce("scc", "node")))
    a, b = (numbered.select(F.col("node").alias(n), F.col("scc").alias(c)).hint("merge") for n, c in (("_a", "up"), ("_b", "down")))
    links = freeze(edges.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("up <> down").select("up", "down").distinct(), "component_links")
    own = numbered.groupBy("scc").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    height = freeze(longest_depth(links.select(F.col("down").alias("src"), F.col("up").alias("dst")), own.select(F.col("scc").alias("node"))).withColumnRenamed("node", "of"), "height")
    links = freeze(links.join(height.hint("merge"), F.col("up") == F.col("of")).select("up", "down", "depth"), "links_by_height")
    asked = links.select(F.col("down").alias("_d")).distinct().hint("merge")
    own = own.join(height.hint("merge"), F.col("scc") == F.col("of")).join(asked, F.col("scc") == F.col("_d"), "left")
    own = freeze(own.select("scc", "first", "last", "depth", F.lit(True) if keep else F.col("_d").isNotNull()).toDF("scc", "first", "last", "depth", "asked"), "own")
    # for each height, so that levels on which nothing can be large are not searched for it
    most = dict(links.groupBy("up", "depth").count().groupBy("depth").agg(F.max("count")).collect())
    longest = dict(own.groupBy("depth").agg(F.max(F.col("last") - F.col("first") + 1)).collect())
    limit, largest = max(FEW, total // 32), 0
    sets: list[DataFrame] = []
    bits: list[DataFrame] = []
    for level in range(max(longest, default=0) + 1):
        at, mine = links.where(F.col("depth") == level), own.where(F.col("depth") == level)
        below = _all_of(sets).withColumnRenamed("scc", "_s") if sets else None
        reach = min(total, longest.get(level, 0) + most.get(level, 0) * largest)
        wide = None
        if bits or longest.get(level, 0) + most.get(level, 0) * largest > GATHER:
            wide = mine.where(F.col("last") - F.col("first") >= GATHER).select("scc")
            if below is not None:
                heads = below.where("part = 0").select("_s", "size", "dense")
                weight = at.join(heads.hint("merge"), F.col("down") == F.col("_s")).groupBy(F.col("up").alias("scc")).agg(F.sum("size").alias("size"), F.max("dense").alias("dense"))
                wide = wide.union(weight.where(F.col("dense") | (F.col("size") > GATHER)).select("scc")).distinct()
            wide = freeze(wide, "wide")
            wide = None if wide.isEmpty() else wide
        narrow = at if wide is None else at.join(wide.hint("merge"), F.col("up") == F.col("scc"), "left_anti")
        arrays = (mine if wide is None else mine.join(wide.hint("merge"), "scc", "left_anti")).select("scc", "asked", F.sequence("first", "last").alias("few"))
        if below is not None:
            moved = narrow.join(below.where("not dense").select("_s", "few").hint("merge"), F.col("down") == F.col("_s")).select(F.col("up").alias("scc"), F.lit(False).alias("asked"), "few")
            arrays = arrays.union(moved).groupBy("scc").agg(F.max("asked").alias("asked"), F.array_distinct(F.flatten(F.collect_list("few"))).alias("few"))
        size = F.size("few")
        cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda i: F.slice("few", i * CHUNK + 1, CHUNK))
        none = F.array(F.lit(None).cast(arrays.schema["few"].dataType))
        parts = F.posexplode(F.when(F.col("asked"), cut).otherwise(none)).alias("part", "few")
        made = freeze(arrays.select("scc", size.cast("long").alias("size"), (F.col("asked") & (size > limit)).alias("dense"), parts).select("scc", "part", "size", "dense", "few"), "reached")
        sets.append(made)
        if reach > limit and not made.where("dense").isEmpty():
            bits.append(freeze(_one_bits(made.where("dense").select("scc", F.explode("few").alias("number"))), "reached_bits"))
        if wide is not None:
            united = [_one_bits(numbered.join(wide.hint("merge"), "scc", "left_semi"))]
            if below is not None:
                broad = at.join(wide.hint("merge"), F.col("up") == F.col("scc"), "left_semi")
                single = broad.join(below.where("not dense").select("_s", "few").hint("merge"), F.col("down") == F.col("_s"))
                united.append(_one_bits(single.select(F.col("up").alias("scc"), F.explode("few").alias("number"))))
                if bits:
                    united.append(broad.join(_all_of(bits).withColumnRenamed("scc", "_s").hint("merge"), F.col("down") == F.col("_s")).select(F.col("up").alias("scc"), "block", "bits"))
            bits.append(freeze(_all_of(united).groupBy("scc", "block").agg(F.bitmap_or_agg("bits").alias("bits")), "reached_bits"))
            heads = bits[-1].groupBy("scc").agg(F.sum(F.bitmap_count("bits")).alias("size"))
            sets.append(freeze(heads.select("scc", F.lit(0).alias("part"), "size", F.lit(True).alias("dense"), F.lit(None).cast(made.schema["few"].dataType).alias("few")), "reached"))
        if reach > FEW:
            reach = max(s.agg(F.max("size")).first()[0] or 0 for s in sets[-2 if wide is not None else -1 :])
        largest = max(largest, reach)
        if len(sets) > merge_every:  # keeps the plan of a deep graph short
            sets = [freeze(_all_of(sets), "reached")]
        if len(bits) > merge_every:
            bits = [freeze(_all_of(bits), "reached_bits")]
    return numbered, _all_of(sets), _all_of(bits) if bits else None


def closure_size(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct nodes that each node reaches, itself left out."""
    numbered, sets, _ = reachable_sets(edges, nodes, keep=False)
    size = sets.where("part = 0").select(F.col("scc").alias("_s"), (F.col("size") - 1).alias("size"))
    return numbered.join(size, F.col("scc") == F.col("_s")).select("node", F.col("size").cast("long").alias("size"))


def reaches(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with ``reached``: whether a path leads from one node to another one, or to itself by a cycle."""
    numbered, sets, bits = reachable_sets(edges)
    n = numbered.select(F.col("node").alias("_n"), F.col("scc").alias("_c"), "number")
    members = numbered.groupBy("scc").agg(F.count("*").alias("members"))
    loops = edges.where("src = dst").select(F.col("src").alias("_l")).distinct()
    p = pairs.join(n.select(F.col("_n").alias("src"), F.col("_c").alias("scc")), "src", "left").join(members, "scc", "left").join(loops, F.col("src") == F.col("_l"), "left")
    p = p.join(n.select(F.col("_n").alias("dst"), "number"), "dst", "left")
    asked = p.select("scc", "number").dropna().distinct()
    hit = asked.join(sets.where("not dense").select("scc", "few"), "scc").where(F.array_contains("few", F.col("number"))).select("scc", "number")
    if bits is not None:
        place = F.bitmap_bit_position("number")
        octet = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
        found = asked.withColumn("block", F.bitmap_bucket_number("number")).join(bits, ["scc", "block"])
        found = found.withColumn("octet", octet).withColumn("place", place)
        hit = hit.union(found.where("shiftright(octet, cast(place % 8 as int)) & 1 = 1").select("scc", "number"))
    j = p.join(hit.withColumn("_hit", F.lit(True)), ["scc", "number"], "left")
    own = F.when(F.col("src") == F.col("dst"), F.col("_l").isNotNull() | (F.col("members") > 1)).otherwise(F.col("_hit"))
    return j.select("src", "dst", F.coalesce(own, F.lit(False)).alias("reached"))


def _spread(start: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Least ``value`` that reaches each node along ``src`` to ``dst``."""
    state = freeze(start, "value")
    for _ in range(limit):
        moved = state.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "value")
        nxt = freeze(state.select("node", "value").union(moved).groupBy("node").agg(F.min("value").alias("value")), "value")
        changed = nxt.join(state.withColumnRenamed("value", "was"), "node").where("value <> was").isEmpty()
        state = nxt
        if changed:
            return state
    raise RuntimeError("spreading did not settle")


def _trimmed(edges: DataFrame, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes that are left when nodes without an edge in or out are taken away again and again; at most
    ``rounds`` times, since the rest is right with or without them."""
    size = edges.count()
    for _ in range(rounds):
        left = freeze(edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_semi"), "two_sided")
        inner = left.withColumnRenamed("node", "_n")
        kept = freeze(edges.join(inner, F.col("src") == F.col("_n"), "left_semi").join(inner, F.col("dst") == F.col("_n"), "left_semi"), "trimmed")
        now = kept.count()
        if now in (0, size):
            return kept, left if now else left.limit(0)
        edges, size = kept, now
    return edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def strong_components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """``node``, ``scc``: the least node of its strongly connected component.

    Nodes without an edge in or out are components by themselves and go first, round by round; what an acyclic graph
    consists of goes that way. Then colouring: the least node that reaches a node is its colour; the nodes of a colour
    that lead back to it form its component and leave the graph. Data per round stays linear in the graph."""
    every = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    e, left = _trimmed(freeze(edges.where("src <> dst").select("src", "dst").distinct(), "edges"))
    done = every.join(left, "node", "left_anti").select("node", F.col("node").alias("scc"))
    if left.isEmpty():
        return done
    for _ in range(limit):
        color = _spread(left.select("node", F.col("node").alias("value")), e, limit).withColumnRenamed("value", "color")
        a = color.select(F.col("node").alias("s"), F.col("color").alias("cs"))
        b = color.select(F.col("node").alias("d"), F.col("color").alias("cd"))
        inner = freeze(e.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("d")).where("cs = cd").select("src", "dst"), "inner")
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        hit = freeze(color.where("node = color").select("node", F.col("color").alias("value")), "roots")
        seen = hit
        while True:  # each front holds new nodes only, so it ends
            fresh = seen.join(back, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "value").distinct().join(hit.select("node"), "node", "left_anti")
            seen = freeze(fresh, "front")
            if seen.isEmpty():
                break
            hit = freeze(hit.union(seen), "hit")
        found = hit.select("node", F.col("value").alias("scc"))
        done = done.union(found)
        left = freeze(left.join(hit.select("node"), "node", "left_anti"), "left")
        if left.isEmpty():
            return done
        gone = hit.select(F.col("node").alias("g"))
        e = freeze(e.join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti"), "rest")
    raise RuntimeError("components did not settle")


def longest_depth(edges: DataFrame, nodes: DataFrame | None = None, limit: int = 1000) -> DataFrame:
    """Longest path that ends in each node of an acyclic graph. Only nodes whose depth rose push on. No side of a join is
    broadcast: nodes, whose files are small for their number, would pass through the driver in every round."""
    e = freeze(edges.select("src", "dst").distinct(), "edges")
    every = nodes if nodes is not None else e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    best = freeze(every.select("node", F.lit(0).alias("depth")), "depth")
    front = best
    for _ in range(limit):
        push = front.join(e.hint("merge"), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.max(F.col("depth") + 1).alias("new"))
        front = freeze(push.join(best.hint("merge"), F.col("to") == F.col("node")).where("new > depth").select("node", F.col("new").alias("depth")), "front")
        if front.isEmpty():
            return best
        best = freeze(best.join(front.withColumnRenamed("depth", "up").hint("merge"), "node", "left").select("node", F.greatest("depth", F.coalesce("up", "depth")).alias("depth")), "depth")
    raise RuntimeError("the graph has a cycle or is deeper than the limit")


def _graph_of(pdf: pd.DataFrame) -> tuple[list, dict]:
    nodes = list(dict.fromkeys(pdf.sort_values("ord", kind="stable")["src"]))
    out: dict = {}
    for s, d in pdf.sort_values("ord", kind="stable")[["src", "dst"]].itertuples(index=False):
        if d is not None and d not in out.setdefault(s, []):
            out[s].append(d)
    return nodes, out


def back_edges(edges: DataFrame, group: str = "workspace") -> DataFrame:
    """Edges that close a cycle in a depth-first walk from unowned nodes, then from the rest in input order. The walk's
    order is its meaning, so each workspace is one group."""
    ship(edges.sparkSession)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, out = _graph_of(pdf)
        nodes = list(dict.fromkeys([*nodes, *(d for s in nodes for d in out.get(s, ()))]))
        owned = {d for ds in out.values() for d in ds}
        color, found = {}, []
        for start in [*(n for n in nodes if n not in owned), *nodes]:
            if start in color:
                continue
            color[start] = 1
            stack: list[tuple[object, Iterator]] = [(start, iter(out.get(start, ())))]
            while stack:
                node, rest = stack[-1]
                for child in rest:
                    if child not in color:
                        color[child] = 1
                        stack.append((child, iter(out.get(child, ()))))
                        break
                    if color[child] == 1:
                        found.append((node, child))
                else:
                    color[node] = 2
                    stack.pop()
        columns = {group: [pdf[group].iloc[0]] * len(found), "src": [a for a, _ in found], "dst": [b for _, b in found]}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy(group).applyInPandas(walk, f"{group} {edges.schema[group].dataType.simpleString()}, src {kind}, dst {kind}")


def ownership_forest(edges: DataFrame, nodes: DataFrame | None = None, group: str = "workspace") -> DataFrame:
    """Pre-order rows of the ownership forest: ``seq``, ``depth``, ``node``, ``note``.

    Roots are unowned nodes with children, by reachable size, then id; children by id. A node met again is noted with
    its first parent and not expanded; the first visit of a node with several owners names the other ones (three at
    most, then how many more). Cycles without a root do not appear. Roots without children come last."""
    ship(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    rows = edges.select(group, "src", "dst")
    if nodes is not None:
        rows = rows.union(nodes.select(group, F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        # sorted lists, made once: sets of a few members each take many times their room
        every = set(pdf["src"])
        links = pdf[["src", "dst"]].dropna().drop_duplicates().sort_values(["src", "dst"])
        links = links[links["src"] != links["dst"]]
        out: dict = {}
        owners: dict = {}
        for s, d in links.itertuples(index=False):
            out.setdefault(s, []).append(d)
            owners.setdefault(d, []).append(s)
        every.update(owners)
        del links
        size = {}
        for r in every - set(owners):
            seen, todo = {r}, [r]
            while todo:
                for c in out.get(todo.pop(), ()):
                    if c not in seen:
                        seen.add(c)
                        todo.append(c)
            size[r] = len(seen) - 1
        rows, first = [], {}
        for root in sorted(size, key=lambda r: (-size[r], r)):
            if not size[root]:
                continue
            stack = [(root, 0, None)]
            while stack:
                node, depth, parent = stack.pop()
                if node in first:
                    rows.append((depth, node, f"expanded above under {first[node]}"))
                    continue
                first[node] = parent if parent is not None else node
                others = [o for o in owners.get(node, ()) if o != parent]
                note = ("also owned by " + ", ".join(map(str, others[:3])) + (f" +{len(others) - 3} more" if len(others) > 3 else "")) if others else ""
                rows.append((depth, node, note))
                stack += [(c, depth + 1, node) for c in reversed(out.get(node, ()))]
        rows += [(0, r, "leaf root") for r in sorted(x for x, n in size.items() if not n)]
        columns = {group: [pdf[group].iloc[0]] * len(rows), "seq": range(len(rows)), "depth": [r[0] for r in rows], "node": [r[1] for r in rows], "note": [r[2] for r in rows]}
        return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})

    return rows.groupBy(group).applyInPandas(walk, f"{group} {edges.schema[group].dataType.simpleString()}, seq long, depth int, node {kind}, note string")
