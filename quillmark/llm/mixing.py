"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). Flow runs
from patterns to sources: a pattern offers its words once at cost 0, again at cost 1, a third
time at cost 2 (repetition grows dearer), a source takes its quota. Documents of a pattern
are then taken in seeded order until the pattern's flow is used up.

Scale: up to MAX_PATTERNS patterns are solved on the driver, which never sees documents: that many over
50 sources take 9 to 15 seconds and some 200 MB. Beyond that
targets come from rounds over the table of sources, and each set of sources that patterns
connect is solved by itself in a task. A pattern's seeded order is dealt into BINS hash bins whose sums tell whole bins in
or out; only the rows of the one bin where the flow ends are sorted, so a source with a third
of all documents is neither collected nor sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import cut, words
from quillmark.llm.components import components

WEIGHTS, MAX_COPIES, BINS, MAX_PATTERNS = (5, 2, 1), 3, 4096, 200_000


def targets(sizes: dict, weights=WEIGHTS, copies: int = MAX_COPIES, total: int | None = None) -> dict:
    """Target words of each source: weighted shares of the total, stopped at ``copies`` times a
    source's size, the excess shared again among the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values()) if total is None else total), list(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > copies * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(copies * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return {s: out[s] for s in order}


def _fill(members: list, holders: list, flow: list, spare: list, need: list) -> bool:
    """One round of a maximum flow: levels from the sources in need, back over what patterns give to other
    sources, to patterns with spare words; then words are passed on along rising levels until none get through.
    Returns whether any did."""
    level, depth = [-1] * len(need), [-1] * len(members)
    front, found = [s for s, n in enumerate(need) if n > 0], False
    wanting = front
    for s in front:
        level[s] = 0
    while front:
        after = []
        for s in front:
            for p, _ in holders[s]:
                if depth[p] < 0:
                    depth[p] = level[s]
                    found = found or spare[p] > 0
                    for t, given in zip(members[p], flow[p]):
                        if given and level[t] < 0:
                            level[t] = level[s] + 1
                            after.append(t)
        front = after
    if not found:
        return False
    # the next pattern to try at each source, and the next source to relieve at each pattern
    tried, relieved = [0] * len(need), [0] * len(members)
    for goal in wanting:
        path, s = [], goal  # of each step: the source, its pattern, the source's place there, that of the one relieved
        while need[goal] > 0:
            if tried[s] == len(holders[s]):
                if not path:
                    break
                s, p, _, _ = path.pop()
                relieved[p] += 1
                continue
            p, j = holders[s][tried[s]]
            if depth[p] != level[s]:
                tried[s] += 1
            elif spare[p]:
                x = min(need[goal], spare[p], *(flow[q][k] for _, q, _, k in path))
                spare[p] -= x
                flow[p][j] += x
                need[goal] -= x
                for _, q, i, k in path:
                    flow[q][k] -= x
                    flow[q][i] += x
                for c, (t, q, _, k) in enumerate(path):
                    if not flow[q][k]:
                        path, s = path[:c], t
                        break
            else:
                k = relieved[p]
                while k < len(members[p]) and not (flow[p][k] and level[members[p][k]] == level[s] + 1):
                    k += 1
                relieved[p] = k
                if k == len(members[p]):
                    tried[s] += 1
                else:
                    path.append((s, p, j, k))
                    s = members[p][k]
    return True


def route(supply: dict[tuple, int], quota: dict, copies: int = MAX_COPIES) -> dict[tuple, int]:
    """Words taken from each pattern by the cheapest flow that fills the quotas as far as possible.

    Moving words between sources is free, so the cost of a path is the repetition level of the pattern
    where it starts. The cheapest flow is thus a maximum flow of the first repetitions, made greater by
    the second ones, and by the third: one maximum flow a level, each going on from the one before.
    The order of the patterns given does not matter.
    """
    order = sorted((p for p in supply if p and supply[p]), key=lambda p: [(s is None, s or "") for s in p])
    place = {s: k for k, s in enumerate(dict.fromkeys(s for p in order for s in p))}
    members = [[place[s] for s in p] for p in order]
    flow, spare, need = [[0] * len(p) for p in order], [0] * len(order), [quota.get(s, 0) for s in place]
    holders: list = [[] for _ in place]
    for p, held in enumerate(members):
        for j, s in enumerate(held):
            holders[s].append((p, j))
    for _ in range(copies):
        spare = [n + supply[p] for n, p in zip(spare, order)]
        while _fill(members, holders, flow, spare, need):
            pass
    taken = dict.fromkeys(supply, 0)
    return taken | {p: sum(given) for p, given in zip(order, flow)}


PLAN = "pattern array<string>, source_size long, target double, rounds long, rest long"


def rounds_of(n: int, got: int, copies: int) -> tuple[int, int]:
    """How often a pattern of n words is taken whole, and the words of its last, partial round."""
    return (min(copies, got // n), got % n if got < copies * n else 0) if n else (0, 0)


def _targets_apart(sizes: DataFrame, total: int, weights, copies: int) -> DataFrame:
    """source, n, target: as ``targets``, in rounds over the table of sources. Only their names are numbered in one task."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    open_ = cut(sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))))
    left, done = float(total), None
    while True:
        w = open_.agg(F.sum("w").alias("w")).first().w
        if not w:
            return done
        full = F.lit(left / w) * F.col("w") > copies * F.col("n")
        capped = cut(open_.where(full).select("source", "n", (copies * F.col("n")).cast("double").alias("target")))
        if capped.isEmpty():
            last = open_.select("source", "n", (F.lit(left / w) * F.col("w")).alias("target"))
            return last if done is None else done.unionByName(last)
        left -= capped.agg(F.sum("target").alias("t")).first().t
        done, open_ = capped if done is None else done.unionByName(capped), cut(open_.where(~full))


def _plan_apart(seen: DataFrame, weights, copies: int) -> DataFrame:
    """The plan, solved for each set of sources that patterns connect in a task of its own."""
    spark = seen.sparkSession
    each = seen.select("pattern", "n", F.explode("pattern").alias("source"))
    sizes = cut(each.groupBy("source").agg(F.sum("n").alias("n")))
    want = cut(_targets_apart(sizes, seen.agg(F.sum("n").alias("n")).first().n, weights, copies).withColumnRenamed("n", "whole"))
    node = F.xxhash64(F.col("source").isNull(), "source")
    links = each.select(F.xxhash64(F.get("pattern", F.lit(0)).isNull(), F.get("pattern", F.lit(0))).alias("a"), node.alias("b")).where("a <> b")
    part = components(links).withColumnRenamed("component", "part")
    held = each.withColumn("node", node).join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    held = held.join(want, held.source.eqNullSafe(want.source)).drop(want.source)

    def solve(pdf):
        none = lambda s: None if s is None or s != s else s
        supply, quota, whole = {}, {}, {}
        for pattern, n, s, target, size in zip(pdf.pattern, pdf.n, pdf.source, pdf.target, pdf.whole):
            supply[tuple(map(none, pattern))] = n
            quota[none(s)], whole[none(s)] = target, size
        got = route(supply, {s: round(t) for s, t in quota.items()}, copies)
        return pd.DataFrame([(list(p), sum(whole[s] for s in p), sum((quota[s] for s in p), 0.0), *rounds_of(n, got[p], copies)) for p, n in supply.items()],
                            columns=["pattern", "source_size", "target", "rounds", "rest"])

    empty = seen.where("size(pattern) = 0").select("pattern", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("rounds"), F.lit(0).cast("long").alias("rest"))
    return held.groupBy("part").applyInPandas(solve, PLAN).unionByName(empty)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix(docs: DataFrame, members: Column | None = None, size: Column | None = None, weights=WEIGHTS, copies: int = MAX_COPIES, seed: int = 0, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    ``members`` is the array of sources of a row (by default its one ``source``, which may be
    null), ``size`` its words. A document is taken whole, as often as its pattern's flow goes
    round; the one on which a pattern's flow ends is taken in part, so that each source gets its
    target to the word. With several sources, source_size and target are sums over them. Null and empty
    texts have size 0 and are never taken; very long ones count whole. A null doc_id is an id like others. Rows with equal doc_id are ordered by a hash of the row. Reruns agree.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    size = n_words(F.col("text")) if size is None else size
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.array_sort(F.array_distinct(members)).alias("pattern"),
            F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.xxhash64(F.col("text") if "text" in docs.columns else F.lit(0)).alias("tie"))
        .withColumn("bin", F.pmod("h", F.lit(BINS)).cast("int"))
    )
    seen = cut(rows.groupBy("pattern").agg(F.sum("size").alias("n")))
    if seen.count() > max_patterns:
        plan = _plan_apart(seen, weights, copies)
    else:
        supply = {tuple(r.pattern): r.n for r in seen.collect()}
        sizes: dict = {}
        for p, n in supply.items():
            for s in p:
                sizes[s] = sizes.get(s, 0) + n
        want = targets(sizes, weights, copies, sum(supply.values()))
        got = route(supply, {s: round(t) for s, t in want.items()}, copies)
        plan = rows.sparkSession.createDataFrame(
            [(list(p), sum(sizes[s] for s in p), sum((want[s] for s in p), 0.0), *rounds_of(n, got[p], copies)) for p, n in supply.items()], PLAN)
    bins = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("n"))
    bins = bins.select("pattern", "bin", "n", (F.sum("n").over(W.partitionBy("pattern").orderBy("bin")) - F.col("n")).alias("before"))
    bins = bins.join(plan, "pattern").withColumn("part", F.expr("before < rest and before + n > rest"))
    dealt = rows.join(bins, ["pattern", "bin"])
    whole = dealt.where("not part").withColumn("more", F.expr("case when before < rest then size else 0 end"))
    order = W.partitionBy("pattern", "bin").orderBy("h", "doc_id", "tie")
    ends = dealt.where("part").withColumn("sofar", F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    ends = ends.withColumn("more", F.expr("least(size, greatest(0, rest - sofar))")).drop("sofar")
    return whole.unionByName(ends).select("doc_id", "size", "source_size", "target", F.expr("rounds * size + more").alias("taken"))
