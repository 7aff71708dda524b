"""Threads: what a message says of its place, and resolving places in a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.functions.address import normalize_message_id
from postroom.functions.subject import header_lines, is_forward, is_reply, looks_like_forward, looks_like_reply, normalize_subject
from postroom.functions.text import let, quoted_lines
from postroom.operators.store import Store

RESOLUTION = "resolution"

# Scores of the resolver in hundredths, its look-back and bands of recency.
BASE, TO_RECIPIENT, FROM_RECIPIENT, LEAST = 45, 25, 20, 45
RECENCY = ((1 / 24, 10), (1, 6), (7, 3))
LOOKBACK_DAYS = 30


def infer_thread(subject: Column, message_id: Column, in_reply_to: Column, references: Column, body: Column) -> Column:
    """struct of all that a single message tells about its thread.

    Parent: In-Reply-To, else the last reference.  Root: the first reference, else
    In-Reply-To, else the message itself.
    """
    empty = F.array().cast("array<string>")
    refs = F.coalesce(F.array_distinct(F.filter(F.transform(references, normalize_message_id), lambda r: r.isNotNull())), empty)
    signs = F.struct(
        refs.alias("refs"),
        normalize_message_id(in_reply_to).alias("reply"),
        normalize_message_id(message_id).alias("own"),
        quoted_lines(body).alias("quoted"),
        F.size(header_lines(body)).alias("heads"),
        is_reply(subject).alias("by_subject"),
        looks_like_reply(body).alias("body_reply"),
        is_forward(subject).alias("forward_subject"),
        looks_like_forward(body).alias("body_forward"),
        normalize_subject(subject).alias("plain"),
    )
    return let(signs, _thread)


def _thread(s: Column) -> Column:
    refs, reply, own, quoted, heads = s["refs"], s["reply"], s["own"], s["quoted"], s["heads"]
    by_subject, body_reply, forward_subject, body_forward, plain = s["by_subject"], s["body_reply"], s["forward_subject"], s["body_forward"], s["plain"]
    first, last = F.try_element_at(refs, F.lit(1)), F.try_element_at(refs, F.lit(-1))
    parent, root = F.coalesce(reply, last), F.coalesce(first, reply, own)
    response = parent.isNotNull() | by_subject
    forward = forward_subject | body_forward
    notes = F.array_compact(
        F.array(
            F.when(reply.isNotNull(), "parent resolved from in_reply_to").when(last.isNotNull(), "parent resolved from last reference"),
            F.when(first.isNotNull(), "thread root resolved from first reference").when(reply.isNotNull(), "thread root fallback to in_reply_to").when(own.isNotNull(), "thread root defaulted to current message_id"),
            F.when(by_subject, "reply subject prefix detected"),
            F.when(forward_subject, "forward subject prefix detected"),
            F.when(body_reply, "reply pattern detected in body"),
            F.when(body_forward, "forward pattern detected in body"),
            F.when(quoted > 0, F.concat(F.lit("quoted lines detected: "), quoted.cast("string"))),
            F.when(heads > 0, F.concat(F.lit("quoted header lines detected: "), heads.cast("string"))),
            F.concat(F.lit("normalized subject: "), plain),
        )
    )
    return F.struct(
        response.alias("is_response"),
        (response | body_reply | (quoted > 0) | (heads > 0)).alias("looks_like_response"),
        forward.alias("is_forward"),
        parent.alias("response_to_message_id"),
        F.when(reply.isNotNull(), "in_reply_to").when(last.isNotNull(), "references").alias("response_to_message_id_source"),
        root.alias("thread_root_message_id"),
        F.size(refs).alias("references_depth"),
        quoted.alias("quoted_line_count"),
        plain.alias("normalized_subject"),
        confidence(reply.isNotNull(), F.size(refs), by_subject, quoted, body_reply, heads > 0, forward, parent.isNotNull()).alias("confidence"),
        notes.alias("decision_notes"),
    )


def confidence(has_reply: Column, depth: Column, by_subject: Column, quoted: Column, body_reply: Column, heads: Column, forward: Column, parent: Column) -> Column:
    """How sure the inference is, in thousandths over 1000, so that no rounding is needed."""
    # Weights of the signs, floor and ceiling without a parent.
    n = (
        F.when(has_reply, 700).otherwise(0)
        + F.least(F.lit(200), 80 * depth)
        + F.when(by_subject, 50).otherwise(0)
        + F.when(body_reply, 100).otherwise(0)
        + F.least(F.lit(100), 10 * quoted)
        + F.when(heads, 50).otherwise(0)
    )
    n = F.when(~parent & (by_subject | body_reply), F.greatest(n, F.lit(350))).otherwise(n)
    n = F.when(~parent & forward, F.least(n, F.lit(400))).otherwise(n)
    return F.least(n, F.lit(1000)) / 1000.0


#: seconds of a bucket of time: what one task is dealt of a subject that is taken by rows
BUCKET = 86_400

#: messages and recipients of a group of subjects that one task takes; a subject with more than four times as many is taken by rows
GROUP = 1_000_000

# What stands in the keys' two places: of an earlier message its sender and a recipient,
# of one that asks a recipient and its sender; by class with its points.
CLASSES = ((BASE + TO_RECIPIENT + FROM_RECIPIENT, True, True), (BASE + TO_RECIPIENT, True, False), (BASE + FROM_RECIPIENT, False, True), (BASE, False, False))


def _windows(lookback_days: int) -> list[tuple[int, int]]:
    """(length in microseconds, points): windows that end at a message, each longer than the one before and of fewer points."""
    bands = [(days, points) for days, points in RECENCY if days < lookback_days]
    last = next((points for days, points in RECENCY if days >= lookback_days), 0)
    return [(round(days * 86_400_000_000), points) for days, points in (*bands, (lookback_days, last))]


def scored_candidates(messages: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(id, parent_id, parent_message_id, parent_root, score): the best earlier message of the same subject.

    ``messages``, read several times: id, message_id, sender, sent_at, subject, recipients, root,
    is_response, is_forward.  A backward as-of join with a tolerance, ranked by
    score; of equal scores the earliest (then smallest id) wins.

    No pairs are made.  A score is the sum of the participants that agree (none, one way,
    the other, both) and of the band of age, and of equal scores the earliest wins, so only
    the earliest message of each such class and window can be the best: 4 keys (the
    subject; with its sender among the recipients; with a recipient as sender; with both)
    by as many windows as there are bands.  A message that belongs to more than its class is
    found in the better class as well, so the class's points suffice.  Windows that end at
    a message and begin earlier hold the bands between: their earliest message is of the
    oldest band that has one.

    The earliest message of a window is the next one of its key at or after the window's
    beginning, if it comes before the message that asks.  Subjects are dealt in groups of about
    ``GROUP`` messages and recipients, a message once, and a task looks windows up in the sorted
    keys of its group.  Subjects of more than four groups, which no task takes whole, are taken
    by rows (``_by_rows``), with equal results.  A subject of n messages is O(n log n).
    """
    us = F.unix_micros(F.col("sent_at").cast("timestamp"))
    good = messages.filter(F.col("subject").isNotNull() & (F.col("subject") != "") & F.col("sent_at").isNotNull())
    to = F.coalesce(F.array_distinct(F.filter("recipients", lambda r: r.isNotNull())), F.array().cast("array<string>"))
    good = good.select("id", us.alias("us"), "subject", "sender", to.alias("to"), F.col("message_id").isNotNull().alias("said"), F.coalesce(F.col("is_response") & ~F.col("is_forward"), F.lit(False)).alias("asks"))
    sizes = good.groupBy("subject").agg(F.sum(1 + F.size("to")).alias("n"))
    large = F.col("n") > 4 * GROUP
    total, busy = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(large)).first()
    windows = _windows(lookback_days)
    if busy:
        few = F.broadcast(sizes.filter(large).select("subject"))  # fewer than a message in 4 * GROUP
        best = _in_groups(good.join(few, "subject", "left_anti"), total, windows).unionByName(_by_rows(good.join(few, "subject", "left_semi"), windows))
    else:
        best = _in_groups(good, total, windows)
    named = messages.select(F.col("id").alias("p"), F.col("message_id").alias("parent_message_id"), F.col("root").alias("parent_root"))
    return best.join(named, F.col("parent_id") == F.col("p")).select("id", "parent_id", "parent_message_id", "parent_root", "score")


def _in_groups(good: DataFrame, total: int, windows: list[tuple[int, int]]) -> DataFrame:
    """(id, parent_id, score) by groups of whole subjects."""
    part = F.pmod(F.xxhash64("subject"), F.lit(-(-total // GROUP) or 1))
    groups = good.filter("said or asks").withColumn("part", part).groupBy("part")
    return groups.applyInArrow(lambda group: _best_in_group(group, windows), "id long, parent_id long, score int")


def _best_in_group(group: pa.Table, windows: list[tuple[int, int]]) -> pa.Table:
    """(id, parent_id, score) of the messages of a group that ask and have a candidate.

    Messages are known by their rank in time, of equal times by id.  A message that was said
    is a number, its key's times the size of the group plus its rank; the next number at or after a key's and
    a window's beginning is the window's earliest message.
    """
    group = group.combine_chunks().sort_by([("us", "ascending"), ("id", "ascending")])
    ids, us = group["id"].to_numpy(), group["us"].to_numpy()
    n, to = len(ids), group["to"].combine_chunks()
    subject = group["subject"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    names = pa.concat_arrays([group["sender"].combine_chunks(), to.flatten()]).dictionary_encode()
    codes, people = names.indices.fill_null(-1).to_numpy().astype(np.int64), len(names.dictionary) + 1
    sender, recipient, row_of = codes[:n], codes[n:], pc.list_parent_indices(to).to_numpy()
    said, asks = (group[c].to_numpy(zero_copy_only=False) for c in ("said", "asks"))
    first_at = np.searchsorted(us, us, "left")  # rank of the first message of the same time: those before are earlier
    best = np.full(n, -1, np.int64)  # score * (n + 1) + n - rank of the parent
    top = max(recent for _, recent in windows)

    def keyed(rows: np.ndarray, by_sender: bool, by_recipient: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, sender, recipient) of each key of the chosen rows; 0 where a key has neither."""
        if by_recipient:
            entry = rows[row_of]
            own, other = row_of[entry], recipient[entry]
        else:
            own = np.flatnonzero(rows)
            other = np.full(len(own), -1)
        if by_sender:
            own, other = own[sender[own] >= 0], other[sender[own] >= 0]
        return own, (sender[own] if by_sender else np.full(len(own), -1)) + 1, other + 1

    for points, one_way, other_way in CLASSES:
        mine, a, b = keyed(said, one_way, other_way)
        row, b_asked, a_asked = keyed(asks & (best < (points + top + 1) * (n + 1)), other_way, one_way)
        if not len(mine):
            continue
        known, key = np.unique(subject[mine] * people + a, return_inverse=True)
        row, key_asked, b_asked = _met(known, subject[row] * people + a_asked, row, b_asked)
        known, key = np.unique(key * people + b, return_inverse=True)
        row, key_asked = _met(known, key_asked * people + b_asked, row)
        numbers = np.append(np.sort(key * n + mine), np.iinfo(np.int64).max)
        for length, recent in windows:
            begins = np.searchsorted(us, us[row] - length, "left")
            found = numbers[np.searchsorted(numbers, key_asked * n + begins)]
            hit = found < key_asked * n + first_at[row]
            np.maximum.at(best, row[hit], (points + recent) * (n + 1) + n - (found[hit] - key_asked[hit] * n))
            row, key_asked = row[~hit], key_asked[~hit]  # longer windows have fewer points
    row = np.flatnonzero(best >= LEAST * (n + 1))
    score, parent = best[row] // (n + 1), n - best[row] % (n + 1)
    return pa.table({"id": ids[row], "parent_id": ids[parent], "score": pa.array(score, pa.int32())})


def _met(known: np.ndarray, asked: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """``columns`` and, in second place, the place of ``asked`` among the sorted ``known``, for those that are there."""
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    there = known[at] == asked
    first, *others = (c[there] for c in columns)
    return first, at[there], *others


def _by_rows(good: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """(id, parent_id, score) of subjects of any size.

    Each window is a row at its beginning, sorted with the messages of its key, newest first, and takes the last one
    seen.  Keys are cut into buckets of time of ``BUCKET`` seconds, and what the next bucket with messages begins
    with follows each bucket as its halo, so that a subject is dealt to as many tasks as it
    has buckets.
    """
    none, no_one = F.lit(None).cast("string"), F.array(F.lit(None).cast("string"))
    earlier = good.filter("said")
    sender = lambda needed: F.col("sender") if needed else none
    to = lambda needed: F.col("to") if needed else no_one
    sides = [(F.lit(k).alias("class"), F.lit(points).alias("points"), one_way, other_way) for k, (points, one_way, other_way) in enumerate(CLASSES)]
    said = earlier.select("subject", "us", "id", F.inline(F.array(*(F.struct(k, F.lit(one_way).alias("full"), sender(one_way).alias("a"), to(other_way).alias("b")) for k, _, one_way, other_way in sides))))
    said = said.filter(~F.col("full") | F.col("a").isNotNull()).drop("full").withColumn("b", F.explode("b")).withColumn("from", F.col("us"))
    lengths = F.array(*(F.struct(F.lit(length).alias("length"), F.lit(points).alias("recent")) for length, points in windows))
    asked = good.filter("asks").select("subject", "us", "id", F.inline(F.array(*(F.struct(k, points, F.lit(other_way).alias("full"), to(one_way).alias("a"), sender(other_way).alias("b")) for k, points, one_way, other_way in sides))))
    asked = asked.filter(~F.col("full") | F.col("b").isNotNull()).drop("full").withColumn("a", F.explode("a")).select("*", F.inline(lengths))
    asked = asked.withColumn("from", F.col("us") - F.col("length")).withColumn("points", F.col("points") + F.col("recent")).drop("length", "recent")
    key = ["class", "subject", "a", "b"]
    both = said.withColumn("points", F.lit(None).cast("int")).unionByName(asked).withColumn("bucket", F.floor(F.col("from") / (BUCKET * 1_000_000)))
    place = F.struct(F.col("us").alias("at"), F.col("id").alias("by"))
    is_said = F.col("points").isNull()
    firsts = both.groupBy(*key, "bucket").agg(F.min(F.when(is_said, place)).alias("first"))
    later = Window.partitionBy(*key).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    halos = firsts.select(*key, "bucket", F.last("first", ignorenulls=True).over(later).alias("halo")).filter("halo is not null")
    # the halo is one row more at the far end of its bucket
    halos = halos.select(*key, "bucket", F.col("halo.at").alias("us"), F.col("halo.by").alias("id"), F.col("halo.at").alias("from"), F.lit(None).cast("int").alias("points"))
    newest_first = Window.partitionBy(*key, "bucket").orderBy(F.desc("from"), F.col("points").asc_nulls_first(), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.unionByName(halos).withColumn("met", F.last(F.when(is_said, place), ignorenulls=True).over(newest_first))
    met = met.filter(~is_said & (F.col("met.at") < F.col("us")))
    # the best candidate by an aggregate, with partial aggregation before the shuffle
    best = met.groupBy("id").agg(F.max(F.struct("points", (-F.col("met.at")).alias("e"), (-F.col("met.by")).alias("i"))).alias("b")).filter(F.col("b.points") >= LEAST)
    return best.select("id", (-F.col("b.i")).alias("parent_id"), F.col("b.points").alias("score"))


def resolve_threads(messages: DataFrame, references: DataFrame, lookback_days: int = LOOKBACK_DAYS, mode: str = "single_pass", rounds: int = 50) -> DataFrame:
    """Parent and root of every message: (id, kind, parent, source, root_id, depth).

    ``messages`` as in ``scored_candidates``, with in_reply_to; ``references``:
    (id, pos, reference).  The first that applies of: references that exist,
    In-Reply-To that exists, the scored candidate, the message itself.  Chains of
    more than 2 ** ``rounds`` parents raise.

    ``single_pass`` takes the roots that parents had before, but for a parent by
    In-Reply-To that comes first in the order of the pass (no date first, then
    newest, then smallest id), whose new root counts; chains of these are followed
    to their end.  ``fixpoint`` follows every chain to its end, which makes a
    second run change nothing; messages whose parents go round in a circle, and all below
    them, have the oldest of the circle as root (undated last, of equals the smallest id).
    """
    known = _known(messages)
    m = _places(messages, references, known, scored_candidates(messages, lookback_days))
    m = m.checkpoint()  # joins and candidates once, not for each look at the links
    if mode == "fixpoint":
        return _to_the_end(m, known, rounds)
    # a parent by In-Reply-To that the pass has visited already: newer, or undated, or equal with a smaller id
    dated, p_dated = F.col("sent_at").isNotNull(), F.col("parent_at").isNotNull()
    same = F.col("sent_at").eqNullSafe(F.col("parent_at"))
    visited = (F.col("kind") == "in_reply_to") & ((dated & ~p_dated) | F.coalesce(F.col("parent_at") > F.col("sent_at"), F.lit(False)) | (same & (F.col("parent_row") < F.col("id"))))
    m = m.withColumn("follow", F.when(visited, F.col("parent_row")))
    now, left = m, m.filter("follow is not null").count()
    while left:
        if rounds == 0:
            raise ValueError(f"{left} messages have longer chains of parents than the rounds allow")
        rounds -= 1
        up = now.select(F.col("id").alias("u"), F.col("root_id").alias("u_root"), F.col("follow").alias("u_follow"), F.col("message_id").alias("u_message"))
        now = now.join(up, F.col("follow") == F.col("u"), "left").withColumn("root_id", F.when(F.col("follow").isNotNull(), F.coalesce("u_root", "u_message")).otherwise(F.col("root_id"))).withColumn("follow", F.col("u_follow")).drop("u", "u_root", "u_follow", "u_message").checkpoint()
        left = now.filter("follow is not null").count()
    return now.select("id", "kind", "parent", "root_id", "depth")


def _known(messages: DataFrame) -> DataFrame:
    """One row for each message id: the oldest, of equals the largest id."""
    order = Window.partitionBy("message_id").orderBy(F.col("sent_at").asc_nulls_last(), F.desc("id"))
    first = messages.filter(F.col("message_id").isNotNull()).withColumn("n", F.row_number().over(order)).filter("n = 1")
    return first.select(F.col("message_id").alias("k"), F.col("id").alias("k_id"), F.col("root").alias("k_root"), F.col("sent_at").alias("k_at"))


def _places(messages: DataFrame, references: DataFrame, known: DataFrame, candidates: DataFrame) -> DataFrame:
    """Kind, parent, depth and the root by the parent alone, of each message."""
    hit = references.join(known.select("k"), F.col("reference") == F.col("k"), "left_semi")
    by_ref = hit.groupBy("id").agg(F.max_by("reference", "pos").alias("ref_parent"), F.min_by("reference", "pos").alias("ref_root"), F.count(F.lit(1)).cast("int").alias("ref_depth"))
    guess = candidates.select(F.col("id").alias("g"), F.col("parent_message_id").alias("g_parent"), F.col("parent_root").alias("g_root"))
    # joins by the id alone: by the name, all messages that answer none would be dealt to one task
    answers = messages.select(F.col("id").alias("i"), F.col("in_reply_to").alias("name")).filter("name is not null").join(known, F.col("name") == F.col("k")).drop("name")
    m = messages.join(by_ref.withColumnRenamed("id", "r"), F.col("id") == F.col("r"), "left").join(answers, F.col("id") == F.col("i"), "left").join(guess, F.col("id") == F.col("g"), "left")
    kind = F.when(F.col("ref_parent").isNotNull(), "references").when(F.col("k").isNotNull(), "in_reply_to").when(F.col("g_parent").isNotNull(), "heuristic").when(F.col("message_id").isNotNull(), "self_rooted").otherwise("unresolved")
    null = F.lit(None).cast("string")
    return m.withColumn("kind", kind).select(
        "id",
        "message_id",
        "sent_at",
        "kind",
        F.when(kind == "references", F.col("ref_parent")).when(kind == "in_reply_to", F.col("k")).when(kind == "heuristic", F.col("g_parent")).otherwise(null).alias("parent"),
        F.when(kind == "references", F.col("ref_root")).when(kind == "in_reply_to", F.coalesce("k_root", "k")).when(kind == "heuristic", F.coalesce("g_root", "g_parent")).when(kind == "self_rooted", F.col("message_id")).otherwise(null).alias("root_id"),
        F.when(kind == "references", F.col("ref_depth")).when(kind.isin("in_reply_to", "heuristic"), 1).otherwise(0).alias("depth"),
        F.when(kind == "in_reply_to", F.col("k_id")).alias("parent_row"),
        F.col("k_at").alias("parent_at"),
    )


def _left(rows: DataFrame, other: DataFrame, key: str, own: str) -> DataFrame:
    """``rows``, stored or cheap, with the columns of ``other`` but its key ``own``; rows without a key are not shuffled, as they would all meet in one task."""
    without = rows.filter(F.col(key).isNull())
    met = rows.filter(F.col(key).isNotNull()).join(other, F.col(key) == F.col(own), "left").drop(own)
    return met.unionByName(without.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in other.dtypes if c != own)))


def _to_the_end(m: DataFrame, known: DataFrame, rounds: int) -> DataFrame:
    start = _left(m, known.select(F.col("k").alias("p"), F.col("k_id").alias("up")), "parent", "p")
    start = start.withColumn("up", F.when(F.col("up") != F.col("id"), F.col("up"))).withColumn("top", F.coalesce("parent", "message_id")).checkpoint()
    return start.select("id", "kind", "parent", "depth").join(_tops(start, rounds), "id").select("id", "kind", "parent", "root_id", "depth")


def _tops(start: DataFrame, rounds: int) -> DataFrame:
    """(id, root_id) by pointer jumping over parents: the rounds are logarithmic in the longest chain.

    ``start``, a stored table: id, message_id, sent_at, up (the parent's id, null at an end) and top (an end's root).

    A message that is open after k rounds points 2 ** k parents up and knows the oldest
    message on that way.  Where the way from there on has the same oldest one, it was met
    twice: the way has gone round a circle, and it is the oldest of that.  All below the circle
    end there like other chains.
    """
    oldest = F.struct(F.col("sent_at").isNull().alias("undated"), "sent_at", "id", "message_id")
    open_ = start.filter("up is not null").select("id", "up", oldest.alias("oldest"))
    done = start.filter("up is null").select("id", "top")
    left = open_.count()
    while left:
        if rounds == 0:
            raise ValueError(f"{left} messages have longer chains of parents than the rounds allow")
        rounds -= 1
        above = open_.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("oldest").alias("a_oldest"), F.lit(None).cast("string").alias("a_top"))
        above = above.unionByName(done.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("a_up"), F.lit(None).cast(dict(open_.dtypes)["oldest"]).alias("a_oldest"), F.col("top").alias("a_top")))
        met = open_.join(above, F.col("up") == F.col("a")).withColumn("round", F.coalesce(F.col("oldest") == F.col("a_oldest"), F.lit(False)))
        now = met.select("id", F.when(~F.col("round"), F.col("a_up")).alias("up"), F.least("oldest", "a_oldest").alias("oldest"), F.when(F.col("round"), F.col("oldest.message_id")).otherwise(F.col("a_top")).alias("top")).checkpoint()
        done = done.unionByName(now.filter("up is null").select("id", "top"))
        open_ = now.filter("up is not null").select("id", "up", "oldest")
        left = open_.count()
    return done.select("id", F.col("top").alias("root_id"))


def update_threads(messages: DataFrame, references: DataFrame, old: DataFrame, new: DataFrame, lookback_days: int = LOOKBACK_DAYS, rounds: int = 50) -> DataFrame:
    """What new messages change of a resolution by ``fixpoint``: rows of ``old`` that change, and those of the new messages.

    ``messages`` and ``references``: all of them, with the new ones; ``old``: the resolution
    before (id, kind, parent, root_id, depth); ``new``: the new ids.  With these rows in place
    of the old ones the resolution is that of all messages.

    Affected are the new messages, those that name them, and those that ask in a subject within
    reach of one: by buckets of time as long as the look-back, which takes in some more.  These get new
    places.  Roots change only in the threads that had an affected message, so chains are followed
    within those threads; a parent in another one has the root that it had.
    """
    ids = new.select("id").distinct()
    bucket = F.floor(F.unix_timestamp("sent_at") / (86_400 * lookback_days)).alias("bucket")
    asks = F.col("is_response") & ~F.col("is_forward") & F.col("subject").isNotNull() & F.col("sent_at").isNotNull()
    fresh = messages.join(ids, "id", "left_semi")
    names = fresh.select(F.col("message_id").alias("name")).filter("name is not null").distinct()
    named = references.join(names, F.col("reference") == F.col("name"), "left_semi").select("id").unionByName(messages.join(names, F.col("in_reply_to") == F.col("name"), "left_semi").select("id"))
    reach = fresh.filter("message_id is not null and subject is not null and sent_at is not null").select("subject", F.explode(F.array(bucket, bucket + 1)).alias("bucket")).distinct()
    asking = messages.filter(asks).select("id", "subject", bucket).join(reach, ["subject", "bucket"], "left_semi").select("id")
    affected = ids.unionByName(named).unionByName(asking).distinct().checkpoint()
    # their places: candidates from the buckets that they can reach, parents by the names that they say
    own = messages.join(affected, "id", "left_semi")
    wanted = own.filter(asks).select("subject", F.explode(F.array(bucket, bucket - 1)).alias("bucket")).distinct()
    near = messages.withColumn("bucket", bucket).join(wanted, ["subject", "bucket"], "left_semi").drop("bucket")
    near = near.join(affected.withColumn("hit", F.lit(True)), "id", "left").withColumn("is_response", F.col("is_response") & F.col("hit").isNotNull()).drop("hit").checkpoint()  # read several times
    said = references.join(affected, "id", "left_semi")
    names = said.select(F.col("reference").alias("name")).unionByName(own.select(F.col("in_reply_to").alias("name"))).distinct()
    known = _known(messages.join(names, F.col("message_id") == F.col("name"), "left_semi"))
    places = _places(own, said, known, scored_candidates(near, lookback_days)).select("id", "kind", "parent", "depth")
    # the threads that had one of them
    threads = old.join(affected, "id", "left_semi").select("root_id").distinct()
    rest = old.join(threads, "root_id", "left_semi").join(affected, "id", "left_anti").select("id", "kind", "parent", "depth")
    part = places.unionByName(rest).join(messages.select("id", "message_id", "sent_at"), "id").checkpoint()
    parents = _known(messages.join(part.select(F.col("parent").alias("name")).distinct(), F.col("message_id") == F.col("name"), "left_semi")).select(F.col("k").alias("p"), F.col("k_id").alias("up"))
    start = _left(part, parents, "parent", "p").withColumn("up", F.when(F.col("up") != F.col("id"), F.col("up"))).checkpoint()
    ups = start.select("up").filter("up is not null").distinct()
    places_of = part.select(F.col("id").alias("u"), F.col("id").alias("in"), F.lit(None).cast("string").alias("out_root"))
    outside = old.select(F.col("id").alias("u"), F.lit(None).cast("long").alias("in"), F.col("root_id").alias("out_root"))
    outside = outside.join(ups, F.col("u") == F.col("up"), "left_semi").join(part.select(F.col("id").alias("p")), F.col("u") == F.col("p"), "left_anti")
    start = _left(start, places_of.unionByName(outside), "up", "u")
    start = start.withColumn("top", F.coalesce("out_root", "parent", "message_id")).withColumn("up", F.col("in")).drop("in", "out_root").checkpoint()
    found = start.select("id", "kind", "parent", "depth").join(_tops(start, rounds), "id").select("id", "kind", "parent", "root_id", "depth")
    before = old.select(F.col("id").alias("o"), F.struct("kind", "parent", "root_id", "depth").alias("was"))
    changed = found.join(before, F.col("id") == F.col("o"), "left").filter(F.col("o").isNull() | ~F.col("was").eqNullSafe(F.struct("kind", "parent", "root_id", "depth")))
    return changed.drop("o", "was")


def store_update(store: Store, messages: DataFrame, references: DataFrame, new: DataFrame, source: str | None = None, batch: int | None = None, lookback_days: int = LOOKBACK_DAYS) -> bool:
    """The table ``resolution`` of a store brought up to the new messages: one version, in which the buckets with a change are rewritten."""
    if source is not None and store.stamps.get(source, -1) >= batch:
        return False
    old = store.read(RESOLUTION) if RESOLUTION in store.tables else store.spark.createDataFrame([], "id long, kind string, parent string, root_id string, depth int")
    changed = update_threads(messages, references, old, new, lookback_days).checkpoint()
    table, _ = store.merged(RESOLUTION, changed, ["id"], {c: F.col(f"new.{c}") for c in ("kind", "parent", "root_id", "depth")})
    store.publish({RESOLUTION: table}, {} if source is None else {source: batch})
    return True


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """One row of counters over a resolution."""
    return resolved.agg(*_counters())


def _counters() -> list[Column]:
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return [
        F.count(F.lit(1)).alias("processed"),
        n("references").alias("resolved_by_references"),
        n("in_reply_to").alias("resolved_by_in_reply_to"),
        n("heuristic").alias("resolved_by_heuristic"),
        n("self_rooted").alias("self_rooted"),
        n("unresolved").alias("unresolved"),
        (n("self_rooted") + n("unresolved")).alias("heuristic_rejected"),
    ]


# Where a parent comes from, by kind of resolution.
SOURCES = {"references": "references", "in_reply_to": "in_reply_to", "heuristic": "heuristic_subject_time_participants"}
PLACE = {"response_to_message_id": "parent", "response_to_message_id_source": "source", "thread_root_message_id": "root_id", "references_depth": "depth"}


def rebuild(messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """``messages`` (id and the columns of ``PLACE``) with their resolved places, and ``updated``: whether one of them is new.

    Messages that were not resolved stay as they are.
    """
    source = F.coalesce(*(F.when(F.col("kind") == kind, name) for kind, name in SOURCES.items()))
    new = resolved.select(F.col("id").alias("_id"), F.struct("kind", "parent", source.alias("source"), "root_id", "depth").alias("_new"))
    both = messages.join(new, F.col("id") == F.col("_id"), "left")
    known = F.col("_id").isNotNull()
    same = F.lit(True)
    for old, name in PLACE.items():
        same = same & F.col(old).eqNullSafe(F.col(f"_new.{name}"))
    both = both.withColumns({"updated": known & ~same, "kind": F.col("_new.kind")})
    return both.withColumns({old: F.when(known, F.col(f"_new.{name}")).otherwise(F.col(old)) for old, name in PLACE.items()}).drop("_id", "_new")


def rebuild_stats(rebuilt: DataFrame) -> DataFrame:
    """``resolution_stats`` and the number of messages that a rebuild changed."""
    return rebuilt.agg(*_counters(), F.count_if("updated").alias("updated_messages"))


def thread_view(messages: DataFrame, root: str) -> DataFrame:
    """Members of a thread, oldest first: two equi-filters, so no nested loop."""
    members = messages.filter(F.col("root") == root).unionByName(messages.filter(F.col("message_id") == root)).dropDuplicates(["id"])
    return members.orderBy(F.col("sent_at").asc_nulls_last(), "id")
