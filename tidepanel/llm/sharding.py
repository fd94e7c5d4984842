"""Sharding by balanced label propagation.

Documents of equal text are linked and, where asked for, those that share a line. Linked documents
ask, round by round, for the shard in which most of their neighbours are, and a share of them moves
there within the room that the shard's quota leaves, until none gains by a move or the cut no longer
falls. Groups of copies that fit then take their shards whole. Documents without links fill what
remains, so that the counts of any two shards differ by at most one (law `rows`).

Every choice is a function of a row's number and the round, so a lost task repeats it. Only
per-shard sums (at most the square of the shard count) reach the driver.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.session import materialize, shuffle_partitions

#: a bound that propagation does not reach unless it goes on improving; reported if it does
ROUNDS = 100
#: rounds without a smaller cut after which propagation ends
PATIENCE = 5
SLACK = 0.05
#: parts into which the holders of a line are dealt
PARTS = 64
_SCALE = 1 << 30


def _draw(*keys: Column | str) -> Column:
    """A number from 0 to 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(_SCALE)) / F.lit(float(_SCALE))


def ranks(df: DataFrame, group: str, key: str) -> DataFrame:
    """Adds `rank`, from 0 without gaps within each group, in an order that depends on key alone.

    Keys are dealt into buckets by hash and numbered there; prefix sums over the buckets' counts
    (a row for each group and bucket) join them up, so no group meets in one task.
    """
    buckets = 4 * shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    counts = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(key)) - 1
    return dealt.withColumn("__own", own).join(bases, [group, "__bucket"]).withColumn("rank", F.col("__base") + F.col("__own")).drop("__bucket", "__own", "__base")


def propagate(links: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for every node of links (src, dst, weight), no shard above its quota by more than chance.

    Nodes start in a shard drawn from their number. In a round, half of the nodes (drawn anew) count
    their neighbours' shards by a join; one that gains by a move takes it with the probability at
    which as many leave as come: moves between two shards are matched first, and what is left over
    shares the target's room up to its quota and SLACK. It ends when no node gains by a move, or when
    PATIENCE rounds have not lowered the cut; the labels of the least cut are returned. A warning tells
    of a search that `rounds` ended.
    """
    shards = len(quotas)
    both = materialize(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "shard-links")
    labels = materialize(both.select(F.col("src").alias("node")).distinct().withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "shard-labels")
    least, kept, stale, gaining = None, labels, 0, 0
    for at in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "shard").agg(F.sum("weight").alias("votes"))
        stands = votes.select(F.col("src").alias("node"), F.col("shard").alias("of"), "votes").join(labels, "node").groupBy("node").agg(
            F.first("shard").alias("shard"), F.max(F.struct("votes", (-F.col("of")).alias("low"))).alias("best"), F.coalesce(F.max(F.when(F.col("of") == F.col("shard"), F.col("votes"))), F.lit(0)).alias("own_votes")
        )
        asked = stands.select("node", "shard", (-F.col("best.low")).alias("want"), "own_votes", (F.col("best.votes") - F.col("own_votes")).alias("gain"))
        #: the round is text, which generated code takes as an argument: all rounds run the same code
        asked = materialize(asked.withColumn("asks", (F.col("gain") > 0) & (_draw("node", F.lit(f"{at}")) < 0.5)), "shard-asks")
        counts = asked.groupBy("shard", "want", "asks").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gain") > 0, 1)).alias("gaining"), F.sum("own_votes").alias("whole")).collect()
        now = {(r["shard"], r["want"], r["asks"]): r["n"] for r in counts}
        gaining, cut = sum(r["gaining"] for r in counts), -sum(r["whole"] for r in counts)
        if least is None or cut < least:
            least, kept, stale = cut, labels, 0
        else:
            stale += 1
        if not gaining or stale >= PATIENCE:
            break
        wish = [[now.get((i, j, True), 0) if i != j else 0 for j in range(shards)] for i in range(shards)]
        held = [sum(n for (i, _, _), n in now.items() if i == j) for j in range(shards)]
        even = [[min(wish[i][j], wish[j][i]) for j in range(shards)] for i in range(shards)]
        over = [sum(wish[i][j] - even[i][j] for i in range(shards)) for j in range(shards)]
        share = [min(1.0, max(0.0, quotas[j] * (1 + SLACK) - held[j]) / over[j]) if over[j] else 0.0 for j in range(shards)]
        chance = [(even[i][j] + (wish[i][j] - even[i][j]) * share[j]) / wish[i][j] if wish[i][j] else 0.0 for i in range(shards) for j in range(shards)]
        odds = F.element_at(F.array(*[F.lit(c) for c in chance]), F.col("shard") * shards + F.col("want") + 1)
        moved = F.when(F.col("asks") & (_draw("node", F.lit(f"{at} move")) < odds), F.col("want")).otherwise(F.col("shard"))
        labels = asked.select("node", moved.cast("int").alias("shard"))
    else:
        warnings.warn(f"propagation ended by its bound of {rounds} rounds; {gaining} nodes gained by a move in the last one", stacklevel=2)
        return labels
    return kept


def gathered(groups: DataFrame, labels: DataFrame, quotas: list[int]) -> DataFrame:
    """(group, shard) for the groups of groups (node, group) that keep together; group is its centre's node.

    Each group that fits asks for its centre's shard, larger ones first. Those that found no room
    ask again, for a shard drawn by the room left among those that can hold them, until none of
    the groups left fits any shard; each pass places the largest group that asks for a shard.
    """
    shards = len(quotas)
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    waiting = sizes.join(labels.select(F.col("node").alias("group"), F.col("shard").alias("want")), "group")
    room, done, at = list(quotas), None, 0
    while True:
        waiting = waiting.where(F.col("size") <= max(room))
        if at:
            #: the number of a shard at which the sum of the rooms that can hold the group passes the draw
            fits = [F.when(F.col("size") <= r, F.lit(float(r))).otherwise(F.lit(0.0)) for r in room]
            sums = [sum(fits[1 : j + 1], fits[0]) for j in range(shards)]
            drawn = _draw("group", F.lit(at), F.lit("gather")) * sums[-1]
            want = F.lit(None).cast("int")
            for j in reversed(range(shards)):
                want = F.when((F.col("size") <= room[j]) & (drawn < sums[j]), F.lit(j)).otherwise(want)
            waiting = waiting.withColumn("want", want)
        #: groups of a shard and size are numbered together; sizes before them come from a row for each shard and size
        dealt = materialize(waiting.select("group", "size", "want", (F.col("size") * shards + F.col("want")).alias("__class")), "shard-wishes")
        classes = dealt.groupBy("__class", "want", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("weight"))
        larger = Window.partitionBy("want").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        bases = classes.select("__class", F.coalesce(F.sum("weight").over(larger), F.lit(0)).alias("base"))
        end = F.col("base") + (F.col("rank") + 1) * F.col("size")
        tried = ranks(dealt, "__class", "group").join(bases, "__class")
        tried = materialize(tried.select("group", "size", "want", (end <= F.element_at(F.array(*[F.lit(r) for r in room]), F.col("want") + 1)).alias("held")), "shard-groups")
        taken = {r["want"]: r["n"] for r in tried.where("held").groupBy("want").agg(F.sum("size").alias("n")).collect()}
        placed = tried.where("held").select("group", F.col("want").cast("int").alias("shard"))
        done = placed if done is None else done.unionByName(placed)
        if not taken:
            return done
        room = [r - taken.get(j, 0) for j, r in enumerate(room)]
        waiting, at = tried.where("not held").select("group", "size", "want"), at + 1


def balanced(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS, groups: DataFrame | None = None) -> DataFrame:
    """(node, shard, slot) for nodes (node), unique longs; counts at most one apart, slots from 0 without gaps.

    Groups (node, group) of linked nodes, if given, keep together where a shard can hold them.
    """
    total = nodes.count()
    quotas = [total // shards + (j < total % shards) for j in range(shards)]
    labels = propagate(links, quotas, rounds)
    taken = [0] * shards
    whole = None
    if groups is not None:
        placed = groups.join(gathered(groups, labels, quotas), "group").select("node", "shard")
        whole = materialize(ranks(placed, "shard", "node").select("node", "shard", F.col("rank").cast("long").alias("slot")), "shard-whole")
        taken = [n for _, n in sorted(({j: 0 for j in range(shards)} | {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}).items())]
        labels = labels.join(whole.select("node"), "node", "left_anti")
    placed = ranks(labels, "shard", "node").withColumn("rank", F.col("rank") + F.element_at(F.array(*[F.lit(n) for n in taken]), F.col("shard") + 1))
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("shard") + 1)
    kept = placed.where(F.col("rank") < quota).select("node", "shard", F.col("rank").cast("long").alias("slot"))
    kept = materialize(kept if whole is None else kept.unionByName(whole), "shard-kept")
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = nodes.select("node").join(kept.select("node"), "node", "left_anti").withColumn("__all", F.lit(0))
    free = ranks(free, "__all", "node")
    shard, slot, first = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for j, q in enumerate(quotas):
        room = q - held.get(j, 0)
        inside = (F.col("rank") >= first) & (F.col("rank") < first + room)
        shard = F.when(inside, F.lit(j)).otherwise(shard)
        slot = F.when(inside, F.col("rank") - first + held.get(j, 0)).otherwise(slot)
        first += room
    return kept.unionByName(free.select("node", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")))


def _lines(text: Column) -> Column:
    """The distinct lines of a text, bar blank ones, as (line, n): a hash of the trimmed line and its characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("n"))))


def line_links(held: DataFrame) -> DataFrame:
    """(src, dst, weight): nodes that hold a line in common, by trees over its holders; weight is the characters of the lines.

    held: (node, line, n), unique by node and line. A line's holders are dealt into PARTS by their number; each meets the first of its
    part, and the firsts meet the first of all, so that a line that every node holds brings no node more than that part of them.
    """
    dealt = held.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    firsts = materialize(dealt.groupBy("line", "part").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("holders"), F.max("n").alias("n")), "shard-lines")
    lower = dealt.drop("n").join(firsts.where("holders > 1"), ["line", "part"])
    tops = firsts.groupBy("line").agg(F.min("dst").alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    upper = firsts.withColumnRenamed("dst", "node").join(tops.withColumnRenamed("top", "dst"), "line")
    both = lower.select("node", "dst", "n").unionByName(upper.select("node", "dst", "n")).where("node <> dst")
    return both.groupBy(F.col("node").alias("src"), "dst").agg(F.sum("n").alias("weight"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lines: bool = False) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs, by the law `rows`.

    Rows of equal texts are linked, each to the first of its group, and stay together as far as the
    quotas allow; a group larger than a shard's quota, or than the room that larger groups left in
    every shard, is spread. With `lines`, rows that hold a line in common are linked too, and go to the same shard
    as far as the propagation finds it. Null texts count as empty ones, of size 1. Repeated
    rows are rows of their own, each with its slot. Texts of any length count whole, and only their digests
    move; ids keep their types. Other columns are left aside, whatever their names; an empty table gives
    an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col(id_col).alias("doc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
        *([_lines(text).alias("lines")] if lines else []),
    )
    rows = materialize(rows, "shard-rows")
    first = rows.groupBy("digest", "size").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("members")).where("members > 1")
    copies = rows.select("node", "digest", "size").join(first, ["digest", "size"]).where("node <> dst").select(F.col("node").alias("src"), "dst", F.lit(1).cast("long").alias("weight"))
    copies = materialize(copies, "shard-copies")
    groups = copies.select(F.col("src").alias("node"), F.col("dst").alias("group")).unionByName(copies.select(F.col("dst").alias("node"), F.col("dst").alias("group")).distinct())
    links = copies
    if lines:
        shared = line_links(rows.select("node", F.explode("lines").alias("l")).select("node", "l.line", "l.n"))
        links = copies.unionByName(shared).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    placed = balanced(rows.select("node"), links, shards, rounds, groups)
    return rows.join(placed, "node").select(F.col("doc").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
