"""Op 3: near-duplicate documents by a grouped prefix join on word shingles.

Shingles have one global order, rare ones first. Two sets that overlap enough share one of the first few shingles (the
prefix). Documents with equal sets are one unit; units with equal prefix and size are one group. Groups that share a
prefix shingle are candidates, filtered by size and position, then expanded to members whose sets are compared.

A cluster of copies would give all its pairs. So members are first compared with one hub per group, shingle and size class; only pairs
that then still lie in different components are compared with each other, every one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import arrays as A
from textloom.llm.common import keyed_texts, quoted, written
from textloom.llm.components import connected_components

SHINGLE = 4
PERCENT = 85
HUB_ROUNDS = 2

# Shingles whose hash is below this come first in the order and are counted. It is well above the share of a set that a prefix takes,
# so nearly all prefixes lie among counted shingles.
_COUNTED = np.uint64(int(0.35 * 2**64))
# Slots of the table that tells how frequent counted shingles are, and bits of the filter of units to compare: fixed sizes, whatever
# the input. Both steer work only: any table without a missing entry gives a valid order, any false alarm of the filter is joined away.
FREQUENCY_SLOTS = 1 << 25
FILTER_BITS = 1 << 26

# 64-bit words of a set's parity map: each shingle turns over one bit, so two maps differ in no more bits than their sets in shingles.
PARITY_WORDS = 16


def _sets(batches: Iterator[pa.RecordBatch], shingle: int):
    """Per block: rows, and for each row the sorted distinct shingle hashes."""
    for rows, data, bounds in A.blocks(batches):
        data = A.LOWER[data]
        start, end, row = A.spans(A.NOT_SPACE[data], bounds)
        words = A.span_hashes(A.prefix_hashes(data), start, end)
        cut = A.cuts(row, rows.num_rows)
        grams = A.gram_hashes(words, shingle)
        sets = []
        for low, high in zip(cut[:-1], cut[1:]):
            if high - low >= shingle:
                sets.append(np.unique(grams[low : high - shingle + 1]))
            elif high > low:
                sets.append(A.gram_hashes(words[low:high], int(high - low)) ^ np.uint64(high - low))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield rows, sets


def needed(n):
    """The overlap that a set of ``n`` shingles has with any set it links with, at least."""
    return -(-PERCENT * n // 100)


def _identity(members: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        first, second = np.add.reduce(A.mix(members)), np.add.reduce(A.mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(np.uint64(first).astype(np.int64)), int(np.uint64(second).astype(np.int64))


def _frequencies(rows: DataFrame, shingle: int) -> np.ndarray:
    """For each slot of hashes the highest class of a shared shingle there: 0 none, else one more than log2 of its documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, shingle):
            # Sets are sorted, so the counted members are a leading part.
            lead = [members[: np.searchsorted(members, _COUNTED)] for members in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lead).view(np.int64))], names=["token"])

    shared = rows.mapInArrow(counted, "token bigint").groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    slot = F.col("token").bitwiseAND(FREQUENCY_SLOTS - 1).cast("int")
    classes = shared.groupBy(slot.alias("slot")).agg(F.max(F.least(F.floor(F.log2("c")), F.lit(200))).cast("byte").alias("class")).toArrow()
    table = np.zeros(FREQUENCY_SLOTS, np.uint8)
    for part in classes.to_batches():  # at most FREQUENCY_SLOTS rows of five bytes
        table[part.column("slot").to_numpy()] = part.column("class").to_numpy().view(np.uint8)
    return table


def _prefixes(rows: DataFrame, shingle: int, frequency) -> DataFrame:
    """Per row its set's size, identity and the shared shingles of its prefix, with the place of the first of them.

    The order is: counted shingles by class, then all others; equal ones by hash. Class 0 stands in one document only, so such members take
    their places in the prefix but are no one's candidates.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value
        for part, sets in _sets(batches, shingle):
            sizes, ones, twos, starts, prefixes = [], [], [], [], []
            for members in sets:
                n = len(members)
                length = n - needed(n) + 1 if n else 0
                lead = int(np.searchsorted(members, _COUNTED))
                classes = np.full(n, 255, np.uint8)
                classes[:lead] = table[(members[:lead] & np.uint64(FREQUENCY_SLOTS - 1)).astype(np.int64)]
                order = np.argsort(classes, kind="stable")[:length]
                alone = int(np.searchsorted(classes[order], 1))
                one, two = _identity(members)
                sizes.append(n)
                ones.append(one)
                twos.append(two)
                starts.append(alone)
                prefixes.append(members[order[alone:]].view(np.int64))
            lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            listed = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(prefixes)))
            columns = [part.column("key"), *[pa.array(c, pa.int64()) for c in (sizes, ones, twos, starts)], listed]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "h1", "h2", "start", "prefix"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(take, f"key {kind}, n bigint, h1 bigint, h2 bigint, start bigint, prefix array<bigint>")


def _filter_bits(units: DataFrame) -> np.ndarray:
    slot = F.col("h1").bitwiseAND(FILTER_BITS - 1)
    held = units.select(slot.alias("slot")).groupBy(F.expr("slot div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return bits


def _parity(members: np.ndarray) -> np.ndarray:
    odd = np.bincount((members >> np.uint64(20) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _parity_allows(n1: str, every1: str, some1: str, n2: str, every2: str, some2: str) -> str:
    """No two sets of sizes ``n1`` and ``n2`` link if their parity maps differ in more bits than linking sets may differ in shingles.

    ``every`` are the bits that all sets of a side have, ``some`` those that any has; bits that all of one side have and none of the
    other differ for every pair.
    """
    bits = " + ".join(f"bit_count(({every1}[{i}] & ~{some2}[{i}]) | ({every2}[{i}] & ~{some1}[{i}]))" for i in range(PARITY_WORDS))
    return f"{bits} <= {n1} + {n2} - 2 * ceil({PERCENT} * ({n1} + {n2}) / {100 + PERCENT})"


def _full_sets(rows: DataFrame, shingle: int, bits) -> DataFrame:
    """The whole sets of the rows whose identity the filter may know."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for _, sets in _sets(batches, shingle):
            out = []
            for members in sets:
                if len(members):
                    one, two = _identity(members)
                    slot = one & (FILTER_BITS - 1)
                    if (int(known[slot >> 6]) >> (slot & 63)) & 1:
                        out.append((one, two, len(members), members.view(np.int64), _parity(members)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h1", "h2", "n", "members", "parity"])

    return rows.mapInArrow(take, "h1 bigint, h2 bigint, n bigint, members array<bigint>, parity array<bigint>")


def _may_link(n1: str, n2: str) -> str:
    return f"100 * least({n1}, {n2}) >= {PERCENT} * greatest({n1}, {n2})"


def _position_allows(n1: str, p1: str, n2: str, p2: str) -> str:
    """No overlap beyond the shared shingle and what follows it, if it is the first shared one."""
    common = f"(1 + least({n1} - {p1} - 1, {n2} - {p2} - 1))"
    return f"100 * {common} >= {PERCENT} * ({n1} + {n2} - {common})"


def _near(pairs: DataFrame, left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """The different ``u, v`` of ``pairs`` joined with units ``u, n1, x`` and ``v, n2, y`` whose parity maps allow a link; the second join
    puts out no others."""
    first = pairs.join(left, on[0])
    both = first.join(right, on[1]).filter(_parity_allows("n1", "x", "x", "n2", "y", "y"))
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of units whose sets link."""
    u = sets.select(F.col("unit").alias("u"), F.col("members").alias("mu"))
    v = sets.select(F.col("unit").alias("v"), F.col("members").alias("mv"))
    both = near.join(u, "u").join(v, "v").withColumn("common", F.size(F.array_intersect("mu", "mv")))
    return both.filter(f"100 * common >= {PERCENT} * (size(mu) + size(mv) - common)").select("u", "v")


def _labelled(units: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges, "u", "v")
    return units.join(found, units["unit"] == found["node"], "left").select(*units.columns, F.coalesce("component", "unit").alias("component"))


def link_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: key, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a row's set holds its distinct ``shingle``-word runs, or all its words as
    one if it has fewer. Rows link when ``100 * intersection >= PERCENT * union``; a component is what links reach, named by its smallest key.
    Null texts and texts without words have empty sets, link with nothing and are their own component. Rows with a null key take part; a
    component of null keys alone has a null id. Repeated rows link with each other.
    """
    rows = keyed_texts(documents, key, text)
    context = documents.sparkSession.sparkContext
    frequency = context.broadcast(_frequencies(rows, shingle))
    numbered = rows.withColumn("key", F.struct("key", F.monotonically_increasing_id().alias("row")))
    scanned = written(_prefixes(numbered, shingle, frequency), "shingle-prefixes")

    # Equal sets are one unit, named by its first row.
    units = written(
        scanned.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("key.row").alias("unit"), F.first("start").alias("start"), F.first("prefix").alias("prefix"))
        .withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64(F.lit(1), "prefix")}),
        "shingle-units",
    )
    # Units of equal size and prefix are one group, named by its first unit. A unit with no shared shingle in its prefix links with none.
    grouped = ["n", "start", "p1", "p2"]
    groups = written(units.filter("size(prefix) > 0").groupBy(*grouped).agg(F.min("unit").alias("gid"), F.count("*").alias("units"), F.first("prefix").alias("prefix")), "shingle-groups")
    postings = groups.select("gid", "n", "units", "start", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("start") + F.col("pos")).drop("start")
    # Shared by two units, be they of one group: units that do not link with their group's first one may link with each other.
    shared = postings.groupBy("token").agg(F.sum("units").alias("holders")).filter("holders > 1").select("token")
    postings = written(postings.drop("units").join(shared, "token"), "shingle-postings")

    in_play = postings.select("gid").distinct()
    members = units.select("unit", "h1", "h2", *grouped).join(groups.select(*grouped, "gid").join(in_play, "gid", "left_semi"), grouped)
    members = written(members.select("unit", "gid", "n", "h1", "h2"), "shingle-members")
    bits = context.broadcast(_filter_bits(members))
    sets = _full_sets(rows, shingle, bits).join(members.select("unit", "n", "h1", "h2"), ["n", "h1", "h2"]).groupBy("unit").agg(F.first("members").alias("members"), F.first("parity").alias("parity"))
    sets = written(sets, "shingle-sets")

    def side(unit: str, n: str, parity: str) -> DataFrame:
        return sets.select(F.col("unit").alias(unit), F.size("members").alias(n), F.col("parity").alias(parity))

    def linked(pairs: DataFrame) -> DataFrame:
        return _verified(_near(pairs, side("u", "n1", "x"), side("v", "n2", "y"), ("u", "v")), sets)

    edges = linked(members.filter("unit <> gid").select(F.col("unit").alias("u"), F.col("gid").alias("v")))
    # Sizes of one class may link; the hub of a shingle and class is compared with all others there.
    size_class = F.floor(F.log("n") / F.lit(-np.log(PERCENT / 100.0)))
    labelled = postings.withColumn("component", F.col("gid"))
    for turn in range(HUB_ROUNDS):
        draw = F.struct(F.xxhash64("gid", F.lit(turn)).alias("draw"), F.col("gid").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("component").alias("hub_component"))
        classed = labelled.withColumn("class", size_class)
        hubs = classed.groupBy("token", "class").agg(F.min(draw).alias("h"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token", "class", "h.*")
        tried = (
            classed.join(hubs, ["token", "class"])
            .filter("component <> hub_component")
            .filter(_may_link("n", "hub_n"))
            .filter(_position_allows("n", "pos", "hub_n", "hub_pos"))
            .select(F.least("gid", "hub").alias("u"), F.greatest("gid", "hub").alias("v"))
            .distinct()
        )
        edges = written(edges.union(linked(tried)), "shingle-links")
        components = written(_labelled(members.select("unit", "gid", "n"), edges), "shingle-components")
        labelled = postings.join(components.filter("unit = gid").select("gid", "component"), "gid")

    # Groups, now also split by component; every pair of different components that share a shingle is compared.
    maps = [F.array(*[f(F.col("parity")[i]) for i in range(PARITY_WORDS)]).alias(name) for f, name in ((F.bit_and, "every"), (F.bit_or, "some"))]
    parts = written(components.join(sets.select("unit", "parity"), "unit").groupBy("gid", "n", "component").agg(F.min("unit").alias("part"), *maps), "shingle-maps")
    lists = postings.select("gid", "pos", "token").join(parts.select("gid", "n", "component", "part"), "gid")
    lists = written(lists, "shingle-parts")
    sizes = lists.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1").select("token", F.col("top.component").alias("main"))
    mixed = lists.select("token", "pos", "part").join(largest, "token").join(parts.drop("gid"), "part")
    mixed = written(mixed, "shingle-mixed")
    columns = {"part": "p", "n": "n", "pos": "pos", "component": "c", "every": "every", "some": "some"}
    left = mixed.filter("component <> main").select("token", *[F.col(c).alias(f"{name}1") for c, name in columns.items()])
    right = mixed.select("token", "main", *[F.col(c).alias(f"{name}2") for c, name in columns.items()])
    pairs = (
        left.join(right, "token")
        .filter("c1 <> c2 and (c2 = main or p1 < p2)")
        .filter(_may_link("n1", "n2"))
        .filter(_position_allows("n1", "pos1", "n2", "pos2"))
        .filter(_parity_allows("n1", "every1", "some1", "n2", "every2", "some2"))
        .select("p1", "p2")
        .distinct()
    )
    named = components.join(parts.select("gid", "n", "component", "part"), ["gid", "n", "component"]).select("unit", "part")
    left = named.withColumnsRenamed({"part": "p1", "unit": "u"}).join(side("u", "n1", "x"), "u")
    right = named.withColumnsRenamed({"part": "p2", "unit": "v"}).join(side("v", "n2", "y"), "v")
    edges = written(edges.union(_verified(_near(pairs, left, right, ("p1", "p2")), sets)), "shingle-links")
    final = _labelled(units.select("unit", "n", "h1", "h2"), edges)
    placed = written(
        scanned.select("key.key", "key.row", "n", "h1", "h2").join(final, ["n", "h1", "h2"], "left").select("key", "n", F.coalesce("component", "row").alias("component")),
        "shingle-rows",
    )
    smallest = placed.groupBy("component").agg(F.min("key").alias("component_id"))
    return placed.join(smallest, "component").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The row with the smallest key of each component, columns unchanged. Keys must identify rows; a null key goes."""
    linked = link_documents(documents, key, text, shingle)
    kept = linked.filter(quoted(key) == F.col("component_id")).select(F.col("component_id").alias("kept_key"))
    return documents.join(kept, quoted(key) == F.col("kept_key"), "left_semi")
