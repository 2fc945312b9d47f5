"""Connected components by contraction, and links within buckets, with DataFrame operations alone.

Every node moves to the neighbour (or itself) that comes first in a hashed order; edges are then rewritten
to the nodes moved to, and loops and repeats dropped, until no edge is left. Each round shrinks a star to
one node and a path by a constant factor. Rounds are written to the shared folder and removed once the next
is written; nothing is gathered on the driver. All sums over a node's edges combine before the shuffle, and
joins on a hub's key read written tables, so that Spark can split them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_KEYS, BROADCAST_WIDE, materialise, only, release, sweep


def _rank(name: str) -> Column:
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one type, in any order; loops and repeats allowed. Returns node, component for every
    node with an edge to another, as a written table; component is the component's smallest node."""
    live = materialise(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = materialise(both.groupBy("a").agg(F.min(_rank("b")).alias("n")).select(F.col("a").alias("node"), F.least(_rank("a"), F.col("n"))["id"].alias("to")), "moves")
        if labels is None:
            labels = materialise(moves.select("node", F.col("to").alias("root")), "labels")
        else:
            step, old = moves.select(F.col("node").alias("root"), "to"), labels
            labels = materialise(old.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            release(old)
        at_a, at_b = moves.select(F.col("node").alias("a"), F.col("to").alias("x")), moves.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved, old = live.join(at_a, "a").join(at_b, "b").where(F.col("x") != F.col("y")), live
        live = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        release(old, moves)
    if labels is None:
        return materialise(live.select(F.col("a").alias("node"), F.col("b").alias("component")), "parts")
    # Both sides of the last join are written tables: a component of any size can be split.
    smallest = materialise(labels.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    parts = materialise(labels.join(smallest, "root").select("node", "component"), "parts")
    release(live, labels, smallest)
    return parts


def joined_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``parts`` (node, component: a written table) after more ``links`` (a, b), as a written table. Only what the
    links tie together is contracted."""
    at_a, at_b = (parts.select(F.col("node").alias(end), F.col("component").alias(f"at_{end}")) for end in ("a", "b"))
    ends = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b"))
    tied = connected_components(ends)
    moved = parts.join(tied.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # A component's id is one of its nodes; nodes that had no component come from the links alone.
    fresh = tied.join(parts.select("node"), "node", "left_anti").select("node", "component")
    whole = materialise(moved.unionAll(fresh), "parts")
    release(tied)
    return whole


def link_buckets(banded: DataFrame, nodes: DataFrame, near: Callable[[str, str], Column], fetch: Callable[[DataFrame], DataFrame], exact: Callable[[str, str], Column], enough: Callable[[str, str, Column], Column] | None = None, rounds: int = 1, wide: DataFrame | None = None, nearer: Callable[[str, str], Column] | None = None, slices: int = 0, done: DataFrame | None = None, told: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Components of nodes that share a bucket and are confirmed to be alike, without pairing all of a bucket.

    banded: key, id (a row for each bucket a node is in). nodes: id and what ``near`` reads, one row each.
    near(a, b): a cheap necessary condition on the nodes' columns with the prefixes a and b; it is tested inside
    the joins, so that pairs it rules out never leave them. fetch: ids to what ``exact`` reads of them, one row
    each. exact(a, b): whether the two are a link. enough(a, b, n): whether n buckets in common are enough for the
    two to be tested (a second condition on the nodes' columns); one is, if it is not given. wide, nearer: a written table
    with id and more columns of some nodes, and a second condition on them, asked of two nodes that are both there. Such columns
    meet pairs that are near and rows that may be, but don't travel with the members of buckets. slices: the buckets are made
    in so many parts, by key, one after the other, so that the disk of what is made on the way is that of one part, and members
    without a near partner in their bucket leave it there: they are in no link that it could give. done: a written table that ``banded``
    alone reads, removed once all buckets are made. told: the same as ``exact`` of pairs that are rows already (steps 1 and 2), where it
    need not be fit for the condition of a join; ``exact``, if it is not given.

    1. Each node is paired with the smallest id that comes first in one of its buckets and is near.
    2. In buckets whose members are still of different components, the first member is paired with near
       members of other components, one pair for two components; ``rounds`` times, or until it links nothing.
    3. What is left is settled exactly. Semi-joins keep the members with a near partner in another
       component of their bucket, then those that have enough in common with one and settle it in that bucket; a join that
       holds all conditions, ``exact`` too, then gives links alone. So no near pair of two components (with enough in common) goes untested, and no untested pair leaves a join.
    """
    columns = [c for c in nodes.columns if c != "id"]
    known: list[DataFrame] = []  # what has been fetched, in parts
    asked: list[DataFrame] = []  # the ids it was fetched for

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        """``rows`` with the prefix ``name`` on all columns but the key."""
        return rows.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ["id", *more, *columns]])

    def small(table: DataFrame) -> DataFrame:
        """A written table, to be broadcast up to a number of rows that is counted: the members of buckets then stay where they are."""
        return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table

    def held(table: DataFrame) -> DataFrame:
        """The same of rows of some hundred bytes."""
        return F.broadcast(table) if table.count() <= BROADCAST_WIDE else table

    def fetched(ids: DataFrame) -> DataFrame:
        """What ``exact`` reads of these ids; each is fetched once."""
        wanted = ids = materialise(ids, "ids")
        asked.append(wanted)
        for part in known:
            ids = ids.join(part.select("id"), "id", "left_anti")
        ids = materialise(ids, "ids")
        if not known or not ids.isEmpty():
            known.append(materialise(fetch(ids), "fetched"))
        release(ids)
        whole = known[0]
        for part in known[1:]:
            whole = whole.unionAll(part)
        return only(whole, wanted, "id") if len(known) > 1 else whole

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs that are links, as a written table."""
        own = fetched(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
        more = [c for c in own.columns if c != "id"]
        sides = [own.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in more]) for name in ("a", "b")]
        return materialise(pairs.join(sides[0], "a").join(sides[1], "b").where((told or exact)("a_", "b_")).select("a", "b"), "links")

    def nearer_pairs(pairs: DataFrame) -> DataFrame:
        """The near ``pairs`` (a_id, b_id and more) that are nearer, too."""
        if wide is None:
            return pairs
        own = [c for c in wide.columns if c != "id"]
        sides = [held(wide.select(F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in own])) for name in ("a", "b")]
        # Pairs that aren't both there have nothing to be asked; their rows stay where they are if wide is small.
        joined = pairs.join(sides[0], "a_id", "left").join(sides[1], "b_id", "left")
        return joined.where(F.coalesce(nearer("a_", "b_"), F.lit(True))).select(*pairs.columns)

    def with_partner(rows: DataFrame, condition: Column) -> DataFrame:
        """The ``rows`` that have a partner in their bucket for which ``condition`` holds."""
        named, partner = (rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns]) for name in ("a", "b"))
        # The ids differ wherever parts do; asked for, both sides have the same columns and are shuffled once.
        pair = (F.col("a_key") == F.col("b_key")) & (F.col("a_id") != F.col("b_id"))
        return named.join(partner, pair & condition, "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in rows.columns])

    def met(part: DataFrame) -> DataFrame:
        """The members of a slice's buckets, with ``slices`` those that have a near partner there: key, id, first (of all) and what ``near`` reads."""
        stars = part.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") != F.col("last")).select("key", "first")
        stars = materialise(stars, "stars")
        sweep(stars)
        whole = materialise(part.join(small(stars), "key").join(nodes, "id").select("key", "id", "first", *columns), "buckets")
        if not slices:
            release(stars)
            return whole
        found = materialise(with_partner(whole, near("a_", "b_")), "members")
        release(stars, whole)
        return found

    several = [met(banded.where(F.pmod("key", F.lit(slices)) == i) if slices > 1 else banded) for i in range(max(1, slices))]
    members = several[0]
    for part in several[1:]:
        members = members.unionAll(part)
    if done is not None:
        release(done)
    firsts = side(members.where(F.col("id") == F.col("first")), "a")
    pairs = side(members.where(F.col("id") != F.col("first")), "b").join(firsts, "key").where(near("a_", "b_"))
    if enough:
        values = [f"{name}_{c}" for name in ("a", "b") for c in columns]
        pairs = pairs.groupBy("a_id", "b_id", *values).agg(F.count(F.lit(1)).alias("shared")).where(enough("a_", "b_", F.col("shared")))
    pairs = nearer_pairs(pairs.select("a_id", "b_id")).groupBy(F.col("b_id").alias("b")).agg(F.min("a_id").alias("a"))
    tried = materialise(pairs.select("a", "b"), "pairs")
    parts = connected_components(confirm(tried))

    def mixed() -> DataFrame:
        """The members of buckets that hold different components: key, id, part, first and what ``near`` reads."""
        whole = members.join(small(parts).withColumnRenamed("node", "id"), "id", "left").select("key", "id", "first", F.coalesce("component", "id").alias("part"), *columns)
        keys = materialise(whole.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where(F.col("p") != F.col("q")).select("key"), "keys")
        rows = materialise(whole.join(small(keys), "key"), "mixed")
        release(keys)
        return rows

    rows = mixed()
    for _ in range(rounds):
        firsts = side(rows.where(F.col("id") == F.col("first")), "a", "part")
        cross = side(rows, "b", "part").join(firsts, "key").where((F.col("a_part") != F.col("b_part")) & near("a_", "b_"))
        cross = nearer_pairs(cross.select("a_id", "b_id", "a_part", "b_part"))
        one = cross.groupBy(F.least("a_part", "b_part").alias("p"), F.greatest("a_part", "b_part").alias("q")).agg(F.min(F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).alias("x"))
        fresh = materialise(one.select("x.a", "x.b").join(tried, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            break
        found = confirm(fresh)
        tried = tried.unionAll(fresh)
        if found.isEmpty():
            break
        old, parts = (parts, rows), joined_components(parts, found)
        rows = mixed()
        release(*old)
    release(*several)

    across = (F.col("a_part") != F.col("b_part")) & near("a_", "b_")
    left = materialise(with_partner(rows.drop("first"), across), "open")
    if wide is not None:
        # The same again with the wide columns of what is left alone.
        across = across & F.coalesce(nearer("a_", "b_"), F.lit(True))
        fuller = materialise(left.join(held(wide), "id", "left"), "open")
        release(left)
        left = materialise(with_partner(fuller, across), "open")
        release(fuller)
    release(rows)
    if left.isEmpty():
        release(left, *known, *asked)
        return parts
    # Each member knows its buckets, so that a pair is settled in the first it shares, and in no other.
    own = materialise(left.groupBy("id").agg(F.collect_set("key").alias("keys")), "ids")
    shared = F.array_intersect("a_keys", "b_keys")
    once = F.col("a_key") == F.array_min(shared)
    if enough:
        once = once & enough("a_", "b_", F.size(shared))
    # Pairs that were tested before and aren't tied since are no links. Each is known by its second node, which has one from the first
    # pairs and one at most for each of its buckets and rounds.
    tested = materialise(tried.groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("tested")), "tested")

    def asked_before(a: str, b: str) -> Column:
        return F.coalesce(F.array_contains(F.col(f"{b}_tested"), F.col(f"{a}_id")), F.lit(False))

    once = once & ~asked_before("a", "b") & ~asked_before("b", "a")
    # What ``exact`` reads goes to those members and buckets alone that have a pair to be settled.
    keyed = materialise(left.join(own, "id").join(held(tested), "id", "left"), "open")
    release(left, own, tested)
    left = materialise(with_partner(keyed, across & once), "open")
    release(keyed)
    full = materialise(left.join(fetched(left.select("id").distinct()), "id"), "open")
    release(left)
    named, partner = (full.select(*[F.col(c).alias(f"{name}_{c}") for c in full.columns]) for name in ("a", "b"))
    same = F.col("a_key") == F.col("b_key")
    found = named.join(partner, same & across & (F.col("a_id") < F.col("b_id")) & once & exact("a_", "b_")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    links = materialise(found.distinct(), "links")
    whole = joined_components(parts, links)
    release(full, parts, links, *known, *asked)
    return whole
