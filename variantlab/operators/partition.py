"""A weighted similarity graph cut into parts of bounded size, across few links: balanced label propagation.

Components that are small beside the slack are dealt whole, by running totals of sizes; larger ones are
ordered by labels that some rounds of propagation give neighbours in common, and cut where a part is full.
Then rounds of moves follow.  Each row asks for the part that it has most link weight to; of the rows
that want from one part to another, those that gain most go, as many as come back, and what the slack
allows beyond that.  Half of the rows, by a hash, may move in a round, so that neighbours don't swap.
Rounds end when the cut has stopped to fall; the best one counts.

A round joins links with parts, sums up by row and part, and ranks those who want to move by running
totals over slices; the driver gets sums by pair of parts.  Parts differ from their share by the slack
at most, but where single rows are heavier than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.tables import components, removed, running, written


def _weighted(links: DataFrame) -> DataFrame:
    """Links in both directions with their summed weight; a row's link to itself counts for nothing."""
    rows = links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")).where("weight > 0")
    once = rows.groupBy("u", "v").agg(F.sum("weight").alias("weight"))
    return once.union(once.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def _common_labels(both: DataFrame, rounds: int) -> DataFrame:
    """id and a label that rows with much weight between them tend to share."""
    labels = both.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct()
    for k in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u", "label").agg(F.sum("weight").alias("w"))
        # equal weights go by a hash of the round, so that labels don't all run to one end
        best = near.groupBy("u").agg(F.max_by("label", F.struct("w", F.xxhash64(F.lit(k), "label"))).alias("best"))
        moves = F.pmod(F.xxhash64(F.lit(100 + k), "id"), F.lit(2)) == 0
        new = written(labels.join(best.withColumnRenamed("u", "id"), "id").select("id", F.when(moves, F.col("best")).otherwise(F.col("label")).alias("label")), "labels")
        removed(labels)
        labels = new
    return labels


def cut_weight(both: DataFrame, parts: DataFrame) -> float:
    """The weight of links between parts; `both` has every link in both directions."""
    a = parts.select(F.col("id").alias("u"), F.col("part").alias("_a"))
    b = parts.select(F.col("id").alias("v"), F.col("part").alias("_b"))
    return both.join(a, "u").join(b, "v").agg((F.coalesce(F.sum(F.when(F.col("_a") != F.col("_b"), F.col("weight"))), F.lit(0.0)) / 2).alias("c")).first().c


def _allowed(wanted: dict[tuple[int, int], float], sizes: list[float], low: float, high: float) -> dict[tuple[int, int], float]:
    """How much may move from part to part: what comes back, and beyond that what keeps every part within its bounds."""
    out, now = {(i, j): min(n, wanted.get((j, i), 0.0)) for (i, j), n in wanted.items()}, list(sizes)
    for (i, j), n in sorted(wanted.items(), key=lambda x: (out[x[0]] - x[1], x[0])):
        more = max(0.0, min(n - out[i, j], high - now[j], now[i] - low))
        out[i, j] += more
        now[j], now[i] = now[j] + more, now[i] - more
    return out


def _within(moved: dict[tuple[int, int], float], sizes: list[float], low: float, high: float) -> set[tuple[int, int]]:
    """The pairs of parts whose moves are made: rows that fit into an amount sum up to less than it, so pairs are left out until all parts are within their bounds."""
    kept = set(moved)
    while True:
        now = list(sizes)
        for i, j in kept:
            now[i], now[j] = now[i] - moved[i, j], now[j] + moved[i, j]
        # a part that was out of bounds before may stay so, but not go further
        wrong = [j for j, n in enumerate(now) if n > max(high, sizes[j]) + 1e-9 or n < min(low, sizes[j]) - 1e-9]
        if not wrong:
            return kept
        i, j = max((p for p in kept if wrong[0] in p), key=lambda p: (abs(moved[p] - moved.get(p[::-1], 0.0)), p))
        kept -= {(i, j), (j, i)}


def balanced_split(nodes: DataFrame, links: DataFrame, parts: int, slack: float = 0.05, rounds: int = 16, orders: int = 10) -> DataFrame:
    """Id, size and part (from 0) of `nodes` (id, size) by `links` (u, v, weight), each part within `slack` of an equal share of the sizes.

    Rows without id are left out, of rows that share an id sizes are summed up; a null size is 1.
    Links of ids that aren't in `nodes` count for nothing.
    """
    rows = nodes.where("id is not null").groupBy("id").agg(F.sum(F.coalesce(F.col("size").cast("double"), F.lit(1.0))).alias("size"))
    rows = written(rows, "nodes")
    known = rows.select("id")
    own = links.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")
    both = written(_weighted(own), "links")
    reached = components(both.select("u", "v"))
    labels = _common_labels(both, orders)
    placed = rows.join(reached, "id", "left").join(labels, "id", "left").select("id", "size", F.coalesce("component", "id").alias("component"), F.coalesce("label", "id").alias("label"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0.0))).first()[0]
    share = total / parts
    low, high = share * (1 - slack), share * (1 + slack)
    line = running(placed, ["component", "label", "id"], {"_to": F.col("size")})
    ends = line.groupBy("component").agg(F.min(F.col("_to") - F.col("size")).alias("_from"), F.sum("size").alias("_all"))
    at = F.when(F.col("_all") <= share * slack / 2, F.col("_from") + F.col("_all") / 2).otherwise(F.col("_to") - F.col("size") / 2)
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(at / (share or 1.0)))).cast("int")
    now = written(line.join(ends, "component").select("id", "size", part.alias("part")), "parts")
    best, least, stale = now, cut_weight(both, now), 0
    for k in range(rounds):
        if not least or stale > 1:
            break
        near = both.join(now.select(F.col("id").alias("v"), F.col("part").alias("to")), "v").groupBy("u", "to").agg(F.sum("weight").alias("w"))
        near = near.withColumnRenamed("u", "id").join(now, "id")
        inside = F.coalesce(F.max(F.when(F.col("to") == F.col("part"), F.col("w"))), F.lit(0.0))
        outside = F.max(F.when(F.col("to") != F.col("part"), F.struct("w", (-F.col("to")).alias("minus"))))
        wish = near.groupBy("id", "size", "part").agg(inside.alias("in"), outside.alias("out")).where((F.col("out.w") > F.col("in")) & (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(2)) == 0))
        wish = written(wish.select("id", "size", "part", (-F.col("out.minus")).alias("to"), (F.col("in") - F.col("out.w")).alias("loss")), "wishes")
        wanted = {(r.part, r.to): r.n for r in wish.groupBy("part", "to").agg(F.sum("size").alias("n")).collect()}
        sizes = dict(now.groupBy("part").agg(F.sum("size")).collect())
        sizes = [sizes.get(j, 0.0) for j in range(parts)]
        allowed = {m: n for m, n in _allowed(wanted, sizes, low, high).items() if n > 0}
        if not allowed:
            stale += 1
            removed(wish)
            continue
        queue = running(wish, ["part", "to", "loss", "id"], {"_up": F.col("size")})
        base = queue.groupBy("part", "to").agg(F.min(F.col("_up") - F.col("size")).alias("_base"))
        most = wish.sparkSession.createDataFrame([(i, j, n) for (i, j), n in allowed.items()], "part int, to int, _most double")
        moved = queue.join(F.broadcast(base.join(most, ["part", "to"])), ["part", "to"]).where(F.col("_up") - F.col("_base") <= F.col("_most") + 1e-9)
        moved = written(moved.select("id", "size", "part", "to"), "moves")
        made = _within({(r.part, r.to): r.n for r in moved.groupBy("part", "to").agg(F.sum("size").alias("n")).collect()}, sizes, low, high)
        pairs = F.broadcast(wish.sparkSession.createDataFrame(sorted(made), "part int, to int"))
        moved = moved.join(pairs, ["part", "to"], "left_semi").select("id", "to")
        new = written(now.join(moved, "id", "left").select("id", "size", F.coalesce("to", "part").alias("part")), "parts")
        removed(wish)
        if now is not best:
            removed(now)
        now, cut = new, cut_weight(both, new)
        if cut < least:
            if best is not now:
                removed(best)
            best, least, stale = now, cut, 0
        else:
            stale += 1
    return best


def split_report(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row of a split (id, size, part): n_parts, smallest and largest part, the weight of all links and of those between parts."""
    both = _weighted(links)
    sizes = nodes.groupBy("part").agg(F.sum("size").alias("n")).agg(F.count("*").alias("n_parts"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    a = nodes.select(F.col("id").alias("u"), F.col("part").alias("_a"))
    b = nodes.select(F.col("id").alias("v"), F.col("part").alias("_b"))
    between = F.sum(F.when(F.col("_a") != F.col("_b"), F.col("weight")).otherwise(0.0)) / 2
    weights = both.join(a, "u").join(b, "v").agg(F.coalesce(F.sum("weight") / 2, F.lit(0.0)).alias("weight"), F.coalesce(between, F.lit(0.0)).alias("cut"))
    return sizes.crossJoin(F.broadcast(weights))
