"""Candidate pairs from inverted lists, without all pairs of a list.

``posted`` has a row (rep, weight, home, load, token) for every list ``token``
that ``rep`` is in; ``weight`` is the company that it has in all its lists,
``home`` one list in which it is compared in blocks, and ``load`` its share of
a block (1 for an ordinary one).  A relation whose components are wanted is
found in three looks; in each, a pair that one component holds already is left
out, as it can change nothing:

1. every list is compared with one of its members, the one of most weight (its hub);
2. lists of at most ``SHORT`` members that hold several components are compared
   in all pairs of different components, longer ones with ``HUBS`` more hubs;
3. what is left of the longer ones is compared in blocks of about ``BLOCK``
   members, block against block; a component of that size has blocks of its own.
   The pairs of blocks are dealt in rounds of at most ``COPIES`` copies of each
   member on average, so that what a shuffle holds grows as the members, not as their pairs.

Column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import join_hot, stored
from postroom.llm.components import components, merged

SHORT = 8  # members of a list that is compared in all pairs of components
HUBS = 2  # hubs of longer lists in the second look
BLOCK = 400  # load of a block
COPIES, FEW_COPIES = 8, 1_000_000  # of a member, and in all, that a round shuffles


def with_components(posted: DataFrame, found: DataFrame | None) -> DataFrame:
    """``posted`` with ``comp``, the component of each representative so far, in lists that hold several."""
    if found is None:
        now = posted.withColumn("comp", F.col("rep"))
    else:
        now = posted.join(found.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    now = stored(now, "now")
    lists = now.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    live = stored(lists.filter("low < high").select("token", "n"), "live")
    return stored(join_hot(now, live, "token"), "live")


def hub_pairs(live: DataFrame, orders: list[Column]) -> DataFrame:
    """(a, b): each list's first documents by ``orders`` with its documents of other components."""
    hubs = live.groupBy("token").agg(*(F.max(F.struct(o.alias("o"), "rep", "comp")).alias(f"hub{i}") for i, o in enumerate(orders)), F.count(F.lit(1)).alias("n"))
    hubs = hubs.select("token", "n", F.array_distinct(F.array(*(F.struct(f"hub{i}.rep", f"hub{i}.comp") for i in range(len(orders))))).alias("hubs"))
    met = join_hot(live.select("token", "rep", "comp"), stored(hubs, "hubs"), "token")
    met = met.select("rep", "comp", F.explode("hubs").alias("hub")).filter(F.col("hub.comp") != F.col("comp"))
    return met.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()


def short_pairs(live: DataFrame, first: Column) -> DataFrame:
    """(a, b): pairs of different components in lists of at most ``SHORT`` documents, but for those of the list's first."""
    member = F.struct(first.alias("o"), "rep", "comp")
    lists = live.groupBy("token").agg(F.array_sort(F.collect_list(member)).alias("m"))  # SHORT at most
    lists = lists.select(F.slice("m", 1, F.size("m") - 1).alias("m"))  # its first is the greatest
    pair = lambda x, y: F.struct(F.greatest(x["rep"], y["rep"]).alias("a"), F.least(x["rep"], y["rep"]).alias("b"))
    others = lambda x: F.transform(F.filter("m", lambda y: (y["rep"] < x["rep"]) & (y["comp"] != x["comp"])), lambda y: pair(x, y))
    return lists.select(F.explode(F.flatten(F.transform("m", others))).alias("p")).select("p.*").distinct()


def blocks(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, comp, block), (pair, one, two)): blocks of representatives and the pairs of blocks to compare.

    A member lives in its home.  A component with a load of ``BLOCK`` there has
    blocks of its own, the others share blocks.
    """
    homed = stored(live.select("rep", "comp", "home", "load").distinct(), "homed")
    sizes = homed.groupBy("home", "comp").agg(F.sum("load").alias("c"), F.count(F.lit(1)).alias("n"))
    small = F.col("c") < BLOCK
    rest = sizes.filter(small).groupBy("home").agg(F.ceil(F.sum("c") / BLOCK).alias("pieces"), F.sum("n").alias("n"))
    own = sizes.filter(~small).select("home", "comp", F.ceil(F.col("c") / BLOCK).alias("own"), "n")
    # a component or a list can hold a large share of all
    alone = join_hot(homed, own, ["home", "comp"]).select("rep", "comp", F.xxhash64("home", "comp", F.pmod(F.xxhash64("rep"), F.col("own"))).alias("block"), F.col("comp").alias("only"))
    shared = homed.join(own.select("home", "comp"), ["home", "comp"], "left_anti")
    shared = join_hot(shared, rest, "home").select("rep", "comp", F.xxhash64("home", F.pmod(F.xxhash64("comp"), F.col("pieces"))).alias("block"), F.lit(None).cast("long").alias("only"))
    members = stored(alone.unionByName(shared), "members")
    lists = stored(live.select("rep", "token").join(members.select("rep", "block", "only"), "rep").groupBy("token", "block").agg(F.first("only").alias("only")), "lists")
    left = lists.select("token", F.col("block").alias("one"), F.col("only").alias("only1"))
    right = lists.select("token", F.col("block").alias("two"), F.col("only").alias("only2"))
    pairs = left.join(right, "token").filter("one <= two").filter(F.coalesce(F.col("only1") != F.col("only2"), F.lit(True)))
    pairs = pairs.filter("one < two or only1 is null").select("one", "two").distinct()
    return members.select("rep", "comp", "block"), stored(pairs.withColumn("pair", F.xxhash64("one", "two")), "block_pairs")


def rounds_of(members: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """``pairs`` of blocks by rounds, each of which copies about ``COPIES`` times as many rows as there are members, or ``FEW_COPIES``."""
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    copies = pairs.select(F.explode(F.array("one", "two")).alias("block")).join(sizes, "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, -(-copies // max(COPIES * members.count(), FEW_COPIES)))
    return [pairs.filter(F.pmod(F.xxhash64("pair", F.lit("round")), F.lit(n)) == k) for k in range(n)]


def linked(posted: DataFrame, links: Callable[[DataFrame], DataFrame], block_links: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every member that has a link.

    ``links`` gives, stored, those of the pairs (a, b) that are links, where ``a``
    can be a hub with any number of partners; ``block_links`` gives the links of
    members (rep, comp, block) and pairs of blocks (pair, one, two).
    """
    live = with_components(posted, None)
    found = components(links(hub_pairs(live, [F.col("weight")])))
    live = with_components(posted, found)
    if live.isEmpty():
        return found
    short, long = live.filter(F.col("n") <= SHORT), live.filter(F.col("n") > SHORT)
    orders = [F.xxhash64("rep", F.lit(k)) for k in range(HUBS)]
    found = merged(found, links(short_pairs(short, F.col("weight")).unionByName(hub_pairs(long, orders)).distinct()))
    if long.isEmpty():
        return found
    live = with_components(long.select("rep", "weight", "home", "load", "token"), found)
    if live.isEmpty():
        return found
    members, pairs = blocks(live)
    return merged(found, reduce(DataFrame.unionByName, [block_links(members, p) for p in rounds_of(members, pairs)]))
