"""Distributed join of points of the Jaccard metric space: pivots, Voronoi regions, triangle windows, recursion.

Outermost level. Points at distance below 1 share an element, so pivots are points and reach their
regions through elements: of the points that hold an element among their first ones (see jaccard.py),
the one of the least fingerprint is a pivot, and all of them belong to its region. Two linked points share
one of their first elements, so they meet in a region, and a point without a region is proved to have
no link. A point has few regions, since the elements of near copies choose the same pivot.

Levels below. A region of at most cap members is joined in one task (regions.py). In a larger one,
dealt to tasks in chunks, all distances to PIVOTS further pivots are taken. Members within r of a pivot are linked
to it. Members caught by the main pivots (the connected ones that catch most, then those connected with what is
passive already) are passive: they are known to be linked with one another, and only pairs with an active
member are left. Then, region by region:

* few active members, or nothing else has helped: blocks of active members meet chunks of the region;
* many members became passive: further pivots, chosen among the active ones;
* the cells shrink it: each member goes to the Voronoi cell of its nearest pivot and, as a boundary
  member, to those whose pivot is at most 2r farther. Cells are regions of the next level;
* else its members choose pivots once more through their first elements, now in the order of exact
  frequencies within the region, counted by a shuffle.

No step holds a region, a list of holders or a component in one task, and none emits the pairs of a region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.llm import sketch
from veritide.llm.cluster import components, cut, partitions, release, spread_join
from veritide.llm.regions import EPS, linked
from veritide.llm.words import trim

CAP, PIVOTS, LEVELS, SHRINK, STAY, FEW_REGIONS = 2048, 6, 8, 0.5, 0.7, 200_000
MEMBER = "rid bigint, pid bigint, f1 bigint, hint bigint, keyed boolean, payload binary"
COLUMNS = ("rid", "pid", "f1", "hint", "keyed", "payload")
Decode = Callable[[bytes], np.ndarray]  # of one payload; where it has an attribute many, that decodes a list of them


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(len(batch), dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(last.schema.get_field_index(k))[-1].as_py() != batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        at = 0
        for edge in [*np.flatnonzero(new).tolist(), len(batch)]:
            if edge > at:
                held.append(batch.slice(at, edge - at))
            if held and edge < len(batch):
                yield pa.Table.from_batches(held)
                held = []
            at = edge
    if held:
        yield pa.Table.from_batches(held)


def group_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 2000, size: int = 1 << 24) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, edges): whole groups of batches that are sorted by keys, many at a time; group i is edges[i]:edges[i + 1]. Holds so many rows or bytes, and one group."""
    held: list[pa.RecordBatch] = []

    def edges_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        new[0] = True
        for k in keys:
            c = table[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        edges = edges_of(table)
        if edges[-1]:  # the last group may go on
            yield table.slice(0, edges[-1]), edges
        held = table.slice(edges[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(edges_of(table), len(table))


def first_count(n, percent: int):
    """How many first elements two linked sets must share one of, for a set of n."""
    return n - -(-percent * n // 100) + 1


def class_of_points(points: DataFrame, decode: Decode, percent: int, cap: int = CAP, trace: list | None = None, homes: DataFrame | None = None, fetch: Callable[[sketch.Membership], DataFrame] | None = None) -> DataFrame:
    """(f1, f2, component): the least id linked to each possible point.

    points (id, f1, f2, keys, payload) has one row per copy; keys are null where no partner is possible. A row
    without payload is a copy of one with it. Points are known by (f1, f2) throughout: the copy that has the
    payload need not have the least id, and rows of several points may have one id. With homes (f1, rids), the regions of
    every f1 that has any, keys are not read and need not be there. Fingerprints of different sets
    differ, but for a chance of one in 2**128 a pair; of two that share a key, their f1, but for one in 2**64. With fetch, points have no payloads:
copies are told by rows without keys, or with the same ones, and fetch(ids) gives (f1, f2, payload) of all rows with one of some ids, and any others. Where points have a mark and a
    size (see possible()), members whose marks rule out every link in their region leave it before payloads are moved. trace, if given, gets a tuple of each level:
    regions, those above cap, members.
    """
    spark = points.sparkSession
    if fetch is None:
        able = points.where("payload is not null")
    else:  # of copies one: keys are moved once, and texts are read again for one id a point
        able = cut(points.where("size(keys) > 0").groupBy("f1", "f2").agg(F.first(F.struct("id", "keys")).alias("p")).select("f1", "f2", "p.*"))
        release(spark)
    if homes is None:
        homes, points = _homes(able), points.where("keys is not null")
    if "mark" in points.columns:
        homes = _hopeful(able, homes, percent, cap)
        release(spark)
    if fetch is None:
        met = sketch.Membership(homes.select("f1"))
        sent = able.where(met("f1")).select("f1", "f2", "payload")
    else:
        met = sketch.Membership(able.join(homes, "f1", "left_semi").select("id"))
        sent = fetch(met)
    # dealt by f1 once, for the grouping and for the join
    payloads = sent.repartition("f1").groupBy("f1", "f2").agg(F.first("payload").alias("payload"))
    base = cut(payloads.join(homes, "f1").withColumn("pid", F.monotonically_increasing_id()))
    met.close()
    release(spark)
    members = base.select(F.explode("rids").alias("rid"), "pid", "f1", F.lit(None).cast("bigint").alias("hint"), F.lit(False).alias("keyed"), "payload")
    near = components(join_regions(members, decode, percent, cap, trace))
    copies = points.groupBy("f1", "f2").agg(F.min("id").alias("id"))
    named = base.select("pid", "f1", "f2").join(near, F.col("pid") == F.col("node")).select("f1", "f2", F.col("component").alias("group"))
    owned = cut(named.join(copies, ["f1", "f2"]))
    least = owned.groupBy("group").agg(F.min("id").alias("component"), F.count("*").alias("__n"))
    known = spread_join(owned, cut(least).select("group", "component"), ["group"]).select("f1", "f2", "component")
    return copies.join(known, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))


def _homes(able: DataFrame) -> DataFrame:
    """(f1, rids) of points that share a key with others, as a checkpoint: the least fingerprints of these keys' holders."""
    spark = able.sparkSession
    by_key = able.select("f1", F.explode("keys").alias("key"))
    led = by_key.groupBy("key").agg(F.min("f1").alias("rid"), F.max("f1").alias("last"), F.count("*").alias("__n"))
    led = cut(led.where("rid <> last").drop("last"))
    release(spark)
    shared = sketch.Membership(led.select("key"))  # most keys belong to copies of one point, and go no further
    member = spread_join(by_key.where(shared("key")), led.select("key", "rid"), ["key"], counts=led.select("key", "__n"))
    homes = cut(member.groupBy("f1").agg(F.collect_set("rid").alias("rids")))
    shared.close()
    release(spark)
    return homes


def possible(marks: np.ndarray, sizes: np.ndarray, rid: np.ndarray, percent: int) -> np.ndarray:
    """Which members, sorted by rid, have another one in their region that their marks allow a link with.

    A mark has the bit of every element set, rows of uint64. An element of one set alone differs in one bit at most, so
    marks of linked sets differ in (100 - percent) / (100 + percent) of both sizes at most. sizes are not below the sets' own.
    """
    alive = np.zeros(len(rid), dtype=bool)
    first = np.arange(len(rid) - 1) if len(rid) else np.zeros(0, np.int64)
    step = 1
    while len(first := first[: np.searchsorted(first, len(rid) - step)]):
        first = first[rid[first] == rid[first + step]]
        for at in range(0, len(first), 100_000):
            a = first[at : at + 100_000]
            a = a[~(alive[a] & alive[a + step])]
            apart = np.bitwise_count(marks[a] ^ marks[a + step]).sum(axis=1, dtype=np.int64)
            near = a[apart * (100 + percent) <= (sizes[a] + sizes[a + step]) * (100 - percent)]
            alive[near] = alive[near + step] = True
        step += 1
    return alive


def _hopeful(able: DataFrame, homes: DataFrame, percent: int, cap: int) -> DataFrame:
    """homes (f1, rids) without the regions in which the point's mark rules out every link, as a checkpoint. Regions above cap are left as they are."""
    spark = able.sparkSession
    pairs = homes.select("f1", F.explode("rids").alias("rid"))
    sizes = cut(pairs.groupBy("rid").agg(F.count("*").alias("n")))
    total = sizes.agg(F.count_if(F.col("n") > cap).alias("big"), F.sum("n").alias("members")).first()
    big = sizes.where(F.col("n") > cap).select("rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in group_runs(batches, ("rid",), 20_000):
            rid, f1 = rows["rid"].to_numpy(), rows["f1"].to_numpy()
            one = np.append(True, (rid[1:] != rid[:-1]) | (f1[1:] != f1[:-1]))  # a point's copies of several tasks are no partners
            rid, f1, size = rid[one], f1[one], rows["size"].to_numpy()[one].astype(np.int64)
            marks = np.frombuffer(b"".join(rows["mark"].filter(pa.array(one)).to_pylist()), dtype=np.uint64).reshape(len(rid), -1)
            kept = possible(marks, size, rid, percent)
            yield pa.RecordBatch.from_arrays([pa.array(rid[kept]), pa.array(f1[kept])], names=["rid", "f1"])
        trim()

    met = sketch.Membership(homes.select("f1"))
    marks = able.where(met("f1")).select("f1", "mark", "size").join(homes.hint("shuffle_hash"), "f1").select(F.explode("rids").alias("rid"), "f1", "mark", "size")
    small = marks if not total["big"] else _by_region(marks, big, total["big"], "left_anti")
    dealt = small.repartition(partitions(spark, total["members"] or 0, 200_000), "rid").sortWithinPartitions("rid", "f1")
    alive = dealt.mapInArrow(run, "rid bigint, f1 bigint")
    if total["big"]:
        alive = alive.unionByName(_by_region(pairs, big, total["big"], "left_semi").select("rid", "f1"))
    out = cut(alive.groupBy("f1").agg(F.collect_set("rid").alias("rids")))
    met.close()
    return out


def join_regions(members: DataFrame, decode: Decode, percent: int, cap: int = CAP, trace: list | None = None) -> DataFrame:
    """Links (a, b) of pids, enough to connect all members linked within a region. members: MEMBER, as a checkpoint."""
    links = []
    for depth in range(LEVELS + 1):
        release(members.sparkSession)
        sizes = cut(members.groupBy("rid").agg(F.count("*").alias("n"), F.count("hint").alias("passive")).where("n > passive").drop("passive"))
        total = sizes.agg(F.count("*").alias("regions"), F.count_if(F.col("n") > cap).alias("big"), F.sum("n").alias("members"), F.sum(F.when(F.col("n") > cap, F.col("n"))).alias("large")).first()
        if trace is not None and total["members"]:
            trace.append((total["regions"], total["big"], total["members"]))
        big = sizes.where(F.col("n") > cap)
        # members of regions without an active member are harmless here: one hint makes them one component
        small = members if not total["big"] else _by_region(members, big, total["big"], "left_anti")
        # a checkpoint a level: the driver holds the plans and broadcasts of one level at a time
        links.append(cut(_solve(small.withColumns({"active": F.lit(True), "b": F.lit(0), "t": F.lit(0)}), decode, percent, total["members"] or 0)))
        if not total["big"]:
            break
        found, members = _divide(_by_region(members, big, total["big"], "inner"), total, decode, percent, cap, depth)
        links += found
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _by_region(rows: DataFrame, facts: DataFrame, n: int, how: str) -> DataFrame:
    """rows joined on rid to facts, one row each of n regions: broadcast while that is some MB, else shuffled."""
    return rows.join(F.broadcast(facts) if n <= FEW_REGIONS else facts, "rid", how)


def _solve(rows: DataFrame, decode: Decode, percent: int, n: int) -> DataFrame:
    """Links within each (rid, b, t), joined in one task each."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = getattr(decode, "many", lambda payloads: [decode(x) for x in payloads])
        a, b = [], []
        for part, edges in group_runs(batches, ("rid", "b", "t")):
            pids, actives, payloads, hints = part["pid"].to_numpy(), part["active"].to_numpy(), part["payload"], part["hint"].to_pylist()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                pid, active = pids[lo:hi], actives[lo:hi]
                root = linked(many(payloads.slice(lo, hi - lo).to_pylist()), percent, hints[lo:hi], None if active.all() else active)
                more = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
                if len(more):
                    least = np.full(len(pid), np.iinfo(np.int64).max)
                    np.minimum.at(least, root[more], pid[more])
                    a.append(pid[more])
                    b.append(least[root[more]])
            if sum(map(len, a)) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        trim()

    dealt = rows.select("rid", "b", "t", "pid", "f1", "hint", "active", "payload").repartition(partitions(rows.sparkSession, n, 50_000), "rid", "b", "t")
    return dealt.sortWithinPartitions("rid", "b", "t", "f1").mapInArrow(solve, "a bigint, b bigint")


def _divide(large: DataFrame, total, decode: Decode, percent: int, cap: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Links found in regions above cap (MEMBER and n), and the members of the regions that are left, as a checkpoint."""
    spark, half = large.sparkSession, max(1, cap // 2)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("hint").isNotNull(), F.xxhash64("pid", F.lit(depth)), "pid"))
    # compared as it is, the rank limits each task's rows before they are shuffled
    pivots = cut(large.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("rid", (F.col("rank") - 1).alias("j"), "pid", "n", "payload"))
    chunks = F.ceil(F.col("n") / half).cast("int")
    one = large.select("rid", F.pmod(F.xxhash64("pid"), chunks).cast("int").alias("chunk"), F.lit(PIVOTS).alias("j"), *[c for c in COLUMNS if c != "rid"])
    two = pivots.select("rid", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "j", "pid", F.lit(0).cast("bigint").alias("f1"), F.lit(None).cast("bigint").alias("hint"), F.lit(False).alias("keyed"), "payload")
    dealt = one.unionByName(two).repartition(partitions(spark, total["large"], 50_000), "rid", "chunk").sortWithinPartitions("rid", "chunk", "j")
    measured = cut(dealt.mapInArrow(_measurer(decode, percent), MEMBER + ", caught bigint, near int, window bigint, pivots array<bigint>"))
    links = [measured.select(F.col("pid").alias("a"), F.explode("pivots").alias("b"))]
    counts = measured.groupBy("rid", "caught", "near", "window", "keyed").agg(F.count("*").alias("n"), F.max("hint").cast("string").alias("hint"))  # text: pandas would make it a float
    last = depth == LEVELS - 1

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        return _plan(rows, half, last)

    facts = counts.groupBy("rid").applyInPandas(decide, "rid bigint, main bigint, first int, known bigint, plan int, live bigint, n_active bigint, n_all bigint")
    hints = pivots.select("rid", F.col("j").alias("first"), "pid")
    facts = cut(facts.join(hints, ["rid", "first"], "left").withColumn("main_pid", F.coalesce("known", "pid")).drop("pid", "known"))
    plans = {row["plan"] for row in facts.select("plan").distinct().collect()}
    release(spark)
    rows = _by_region(measured, facts.where("plan > 0"), total["big"], "inner")
    active = F.col("caught").bitwiseAND(F.col("main")) == 0
    rows = rows.withColumns({"active": active, "hint": F.when(~active, F.col("main_pid"))})
    # blocks of active members by chunks of the region
    flat = rows.where("plan = 1")
    blocks, parts = F.ceil(F.col("n_active") / half).cast("int"), F.ceil(F.col("n_all") / half).cast("int")
    block, part = F.pmod(F.xxhash64("pid"), blocks).cast("int"), F.pmod(F.xxhash64("pid"), parts).cast("int")
    first = flat.where("active").withColumns({"b": block, "t": F.explode(F.sequence(F.lit(0), parts - 1))})
    second = flat.withColumns({"t": part, "b": F.explode(F.sequence(F.lit(0), blocks - 1)), "active": F.lit(False)})
    if 1 in plans:
        links.append(cut(_solve(first.unionByName(second), decode, percent, 2 * total["large"])))
    # Voronoi cells with their windows
    cells = F.filter(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda c: _bit("live", c) & _bit("window", c) & (~F.col("active") | (c <= F.col("near"))))
    inner = rows.where("plan = 2").withColumn("c", F.explode(cells)).withColumn("rid", F.xxhash64("rid", "c", F.lit(depth)))
    left = rows.where("plan = 4").select(*COLUMNS).unionByName(inner.select(*COLUMNS))
    if 3 in plans:  # pivots chosen once more, through elements
        left = left.unionByName(_rekeyed(rows.where("plan = 3"), decode, percent, depth).select(*COLUMNS))
    return links, cut(left)


def _bit(name: str, c) -> F.Column:
    """Is bit c of the column set?"""
    return F.call_function("getbit", F.col(name), c) == 1


def _measurer(decode: Decode, percent: int):
    r = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ("rid", "chunk")):
            role = rows["j"].to_numpy()
            k = int(np.searchsorted(role, PIVOTS))
            sets = [decode(x.as_py()) for x in rows["payload"]]
            pids = rows["pid"].to_numpy()
            members = sets[k:]
            if not members:
                continue
            size = np.array([len(s) for s in members])
            flat, ends = np.concatenate(members), np.cumsum(size)
            dist, hit = np.ones((k, len(members))), np.zeros((k, len(members)), dtype=bool)
            for j, p in enumerate(sets[:k]):
                at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
                both = np.diff(np.concatenate([[0], np.cumsum(p[at] == flat)])[np.concatenate([[0], ends])])
                union = len(p) + size - both
                dist[j], hit[j] = 1 - both / union, 100 * both >= percent * union
            bits = np.int64(1) << np.arange(k, dtype=np.int64)[:, None]
            window = dist <= dist.min(axis=0) + 2 * r + EPS
            own = rows.slice(k).combine_chunks().select(COLUMNS)
            passive = own["hint"].is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            own = own.append_column("caught", pa.array((hit * bits).sum(axis=0) | passive << PIVOTS))
            own = own.append_column("near", pa.array(dist.argmin(axis=0).astype(np.int32)))
            own = own.append_column("window", pa.array((window * bits).sum(axis=0)))
            own = own.append_column("pivots", pa.array([pids[:k][hit[:, i]] for i in range(len(members))], pa.list_(pa.int64())))
            yield from own.to_batches()
        trim()

    return run


def _plan(rows: pd.DataFrame, half: int, last: bool) -> pd.DataFrame:
    """How one region goes on, from its counts by (caught, near, window): 0 done, 1 blocks, 2 cells, 3 pivots through elements, 4 further pivots.

    Bit PIVOTS of caught tells passive members, which share one hint. rows: 2**16 at most.
    """
    caught, near, window, n = (rows[c].to_numpy(dtype=np.int64) for c in ("caught", "near", "window", "n"))
    groups: list[int] = []
    for mask in np.unique(caught[caught > 0]).tolist():
        for other in [g for g in groups if g & mask]:
            groups.remove(other)
            mask |= other
        groups.append(mask)
    main = max(groups, key=lambda g: (g >> PIVOTS, n[caught & g > 0].sum(), g), default=0)
    before = int(n[caught >> PIVOTS == 0].sum())
    active = caught & main == 0
    n_active, n_all = int(n[active].sum()), int(n.sum())
    live = cost = 0
    for c in range(PIVOTS):
        owners = int(n[active & (near == c)].sum())
        if owners:
            live |= 1 << c
            cost += owners * int(n[window >> c & 1 > 0].sum())
    keyed = bool(rows["keyed"].iloc[0])
    if not n_active:
        plan = 0
    elif n_active <= half or last:
        plan = 1
    elif n_active <= STAY * before:
        plan = 4
    elif cost <= SHRINK * n_active * n_all:
        plan = 2
    else:
        plan = 1 if keyed else 3
    first, known = (main & -main).bit_length() - 1, next((h for h in rows["hint"] if isinstance(h, str)), None)
    return pd.DataFrame({"rid": [rows["rid"].iloc[0]], "main": [main], "first": [first], "known": pd.array([None if known is None else int(known)], dtype="Int64"), "plan": [plan], "live": [live], "n_active": [n_active], "n_all": [n_all]})


def _rekeyed(rows: DataFrame, decode: Decode, percent: int, depth: int) -> DataFrame:
    """Members in regions of new pivots, through their first elements in the order of exact frequencies within their old region."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, pid, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = decode(payload.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rid.as_py())), pa.array(np.full(len(found), pid.as_py())), pa.array(found), pa.array(np.full(len(found), len(found)))], names=["rid", "pid", "e", "size"])

    own = cut(rows.select("rid", "pid", "payload").mapInArrow(elements, "rid bigint, pid bigint, e bigint, size bigint"))
    led = cut(own.groupBy("rid", "e").agg(F.count("*").alias("__n"), F.min("pid").alias("leader")))
    found = spread_join(own, led.select("rid", "e", F.col("__n").alias("n"), "leader"), ["rid", "e"], counts=led)
    need = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    chosen = found.groupBy("rid", "pid", "size").agg(F.sort_array(F.collect_list(F.struct("n", "e", "leader"))).alias("x"))
    chosen = chosen.select("rid", "pid", F.array_distinct(F.transform(F.filter(F.slice("x", F.lit(1), need.cast("int")), lambda s: s["n"] > 1), lambda s: s["leader"])).alias("leaders"))
    moved = rows.join(cut(chosen), ["rid", "pid"]).withColumn("leader", F.explode("leaders"))
    return moved.withColumns({"rid": F.xxhash64("rid", "leader", F.lit(depth), F.lit(1)), "keyed": F.lit(True)})
