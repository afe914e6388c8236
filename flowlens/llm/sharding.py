"""Sharding by balanced label propagation.

Documents with equal texts are linked. They start in a random balanced deal; then, round by round, the copies of a
text ask to move to the shard where most of their neighbours are. Between two shards as many documents go one way
as come back: requests are swapped with each other, and what is left is swapped with documents that have no links,
as far as the shard has them. So every shard keeps its number of rows, and fewer links are cut each round.

All copies of a text in one shard are one row (a cell) of the iteration, so a text with a third of all rows is 40 rows.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, range_starts, ranges, stored

#: Shards, and rounds without a fall of the cut links after which the iteration ends (each asks other homes).
SHARDS, IDLE = 40, 2
LOG = logging.getLogger(__name__)
#: The group of the documents without links; sorts after the hashes of texts.
FREE = "ffffffff-free"


def deal(groups: DataFrame, shards: int, count: int) -> DataFrame:
    """Cells (grp, shard, n) of the first deal: groups in hash order, their members go round the shards."""
    placed = groups.withColumn("_all", F.lit(0))
    placed = prefix_sums(placed, range_starts(placed, ["_all"], "grp", "n", count), ["_all"], "grp", [], "n", count)
    turn = F.explode(F.expr(f"sequence(0, cast(least(n, {shards}) - 1 as int))"))
    cells = placed.select("grp", "n", "before", turn.alias("j"))
    return cells.select(
        "grp",
        F.expr(f"cast((before + j) % {shards} as int)").alias("shard"),
        F.expr(f"(n - 1 - j) div {shards} + 1").alias("n"),
    )


def requests(cells: DataFrame, free: DataFrame, room: int, turn: int) -> DataFrame:
    """Moves (grp, i, j, n, gain) asked for by the linked cells: to the cells of the text with the most copies, shards
    with exchangeable documents first, another of equals each turn. A text larger than a shard (``room`` rows) has
    as many such homes as it fills. A document moves only if it gains neighbours."""
    seen = cells.join(F.broadcast(free), "shard")  # one row per shard
    order = F.struct(F.col("free") > 0, F.col("n"), F.xxhash64("grp", "shard", F.lit(turn)), F.col("shard"))
    sorted_cells = F.sort_array(F.collect_list(order), asc=False)  # at most one per shard
    filled = F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("free") > 0, F.col("n")).otherwise(0)) / F.lit(room)))
    homes = seen.groupBy("grp").agg(F.slice(sorted_cells, 1, filled.cast("int")).alias("h"))
    asked = cells.join(homes.select("grp", F.transform("h", lambda x: F.struct(x["shard"].alias("shard"), x["n"].alias("n"))).alias("h")), "grp")
    asked = asked.where(~F.exists("h", lambda x: x["shard"] == F.col("shard")))
    asked = asked.withColumn("best", F.expr(f"h[cast(pmod(xxhash64(grp, shard, {turn}), size(h)) as int)]")).where("best.n - n + 1 > 0")
    return asked.select("grp", F.col("shard").alias("i"), F.col("best.shard").alias("j"), "n", F.expr("best.n - n + 1").alias("gain"))


def quotas(asked: DataFrame, free: DataFrame) -> DataFrame:
    """Per pair of shards: ``take`` documents may go from i to j, ``fill`` unlinked ones come back beyond the swap.

    At most a row per pair of shards. A shard asked for more than it has unlinked documents shares them in proportion.
    """
    there = asked.groupBy("i", "j").agg(F.sum("n").alias("r"))
    back = there.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("r").alias("s"))
    pairs = there.join(back, ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    pairs = pairs.withColumn("more", F.greatest(F.col("r") - F.col("s"), F.lit(0)))
    wanted = pairs.groupBy("j").agg(F.sum("more").alias("wanted"))
    pairs = pairs.join(F.broadcast(wanted), "j").join(F.broadcast(free.withColumnRenamed("shard", "j")), "j")
    # Shares of whole documents: differences of the rounded running share, so that none of them is lost.
    run = "sum(more) over (partition by j order by i)"
    upto = "cast(floor(cast({} as decimal(30, 0)) * least(free, wanted) / greatest(wanted, 1)) as bigint)"
    pairs = pairs.withColumn("fill", F.expr(f"{upto.format(run)} - {upto.format(f'({run} - more)')}"))
    return pairs.select("i", "j", "fill", F.expr("least(r, s) + fill").alias("take"))


def moved(asked: DataFrame, pairs: DataFrame, count: int) -> DataFrame:
    """The accepted moves: of each pair of shards the largest gains up to its quota, by distributed prefix sums."""
    rank = "lpad(lower(hex(255 - least(255, cast(8 * log2(gain) as int)))), 2, '0')"
    keyed = asked.withColumn("_order", F.expr(f"concat({rank}, grp)"))
    starts = range_starts(keyed, ["i", "j"], "_order", "n", count).join(pairs, ["i", "j"])
    kept = prefix_sums(keyed, starts, ["i", "j"], "_order", [], "n", count)
    return kept.withColumn("n", F.expr("least(n, greatest(0L, take - before))")).where("n > 0").select("grp", "i", "j", "n")


def cut_links(cells: DataFrame) -> int:
    """Pairs of equal texts that stand in different shards."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    sizes = cells.groupBy("grp").agg(F.sum("n").alias("all"), F.sum(whole("n") * whole("n")).alias("kept"))
    return int(sizes.agg(F.sum(whole("all") * whole("all") - F.col("kept"))).first()[0] or 0) // 2


def propagate(cells: DataFrame, free: DataFrame, room: int, count: int, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds of moves until the cut links are no longer falling (``IDLE`` rounds accept no move or cut no less), at most
    ``rounds`` if given; every round is stored, the one with the fewest cut links is kept and their number logged."""
    turn = idle = 0
    best, least = (cells, free), cut_links(cells)
    while least and idle < IDLE and (rounds is None or turn < rounds):
        asked = stored(requests(cells, free, room, turn), "shard-asked")
        pairs = stored(quotas(asked, free), "shard-quotas")
        turn, idle = turn + 1, idle + 1
        if not pairs.where("take > 0").limit(1).count():
            continue
        moves = moved(asked, pairs, count)
        flows = moves.select("grp", F.inline(F.expr("array(struct(i as shard, -n as n), struct(j as shard, n as n))")))
        cells = cells.unionByName(flows).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        cells = stored(cells, "shard-cells")
        fills = pairs.select(F.inline(F.expr("array(struct(j as shard, -fill as free), struct(i as shard, fill as free))")))
        free = stored(free.unionByName(fills).groupBy("shard").agg(F.sum("free").alias("free")), "shard-free")
        if (links := cut_links(cells)) < least:
            best, least, idle = (cells, free), links, 0
    LOG.info("%d rounds, %d links are left cut", turn, least)
    return best


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Law ``rows``: the numbers of documents differ by at most one. Equal texts are linked; null texts are linked
    with each other and count like empty ones in size and checksum. Repeated rows count each and may stand in
    either of their places. Fewer documents than shards leave shards empty; an empty table gives no rows; other
    columns are not read. Slots run from 0 within a shard, group after group.
    """
    spark = docs.sparkSession
    count = ranges(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("00000000-null")).alias("grp"),
    )
    rows = stored(rows.withColumn("_key", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text_crc32"))), "shard-rows")
    linked = stored(rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    alone = rows.join(linked.select("grp", F.lit(1).alias("_linked")), "grp", "left")
    rows = stored(alone.withColumn("grp", F.when(F.col("_linked") == 1, F.col("grp")).otherwise(FREE)).drop("_linked"), "shard-rows")

    one = F.lit(1).cast("long")
    starts = stored(range_starts(rows.withColumn("_one", one), ["grp"], "_key", "_one", count), "shard-starts")
    cells = stored(deal(starts.select("grp", F.col("total").alias("n")), shards, count), "shard-cells")
    free = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("free"))
    free = free.unionByName(cells.where(F.col("grp") == FREE).select("shard", F.col("n").alias("free")))
    free = stored(free.groupBy("shard").agg(F.sum("free").alias("free")), "shard-free")
    room = max(1, math.ceil(rows.count() / shards))
    cells, free = propagate(cells.where(F.col("grp") != FREE), free, room, count, rounds)

    cells = cells.unionByName(free.select(F.lit(FREE).alias("grp"), "shard", F.col("free").alias("n")).where("n > 0"))
    bases = prefix_sums(cells, range_starts(cells, ["shard"], "grp", "n", count), ["shard"], "grp", [], "n", count)
    # The cells of a group, at most one per shard, in order, with the ranks that they hold.
    places = bases.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n", F.col("before").alias("base")))).alias("c"))
    low = "aggregate(slice(c, 1, i - 1), 0L, (a, x) -> a + x.n)"
    places = places.select("grp", F.expr(f"transform(sequence(1, size(c)), i -> struct(c[i - 1].shard, c[i - 1].n, c[i - 1].base, {low} as low))").alias("places"))
    ranked = prefix_sums(rows.withColumn("_one", one), starts.join(places, "grp"), ["grp"], "_key", ["doc_id", "text_crc32"], "_one", count)
    ranked = ranked.withColumn("p", F.expr("filter(places, x -> before >= x.low and before < x.low + x.n)[0]"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "p.shard",
        F.expr("p.base + before - p.low").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
