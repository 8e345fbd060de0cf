"""N-gram Jaccard join by T-occurrence search with DivideSkip; the classes of documents that links connect.

A document's set holds the 64-bit hashes of its distinct runs of ``Plan.words`` words. Two documents link when their
sets' intersection is at least ``Plan.percent`` hundredths of their union.

1. Documents with equal sets form a class and need no comparison.
2. Routing. Linked sets of sizes a and b differ in at most (a + b)(100 - p)/(100 + p) elements. A hash deals a set's
   elements to more segments than that, so linked sets agree in one segment at least, one with elements in it unless
   both have many empty ones, which then count too. A class sends a hash of each segment, for its own range of sizes and the next
   one; classes with a hash in common meet at the least of them, their leader. No link is lost, and a passage that many
   documents share hardly ever fills a segment alone.
3. Search. The classes of a leader, in chunks of bounded size that all hold the leader, are indexed: an inverted list
   for each element. A set of n elements looks for those, no smaller, that share T = ceil(2 n p / (100 + p)): its
   longest L lists are set aside, the others are merged with a heap, what occurs T - L times in them is probed in the long lists by binary
   search, and the required overlap is tested exactly. Lists leave out what is in the searcher's component already,
   so copies of one text cost no comparison of all pairs.
4. Groups of several chunks go on: what is not yet linked to the leader visits the other chunks, again in chunks.
5. Links of all searches, one for each class and component of a chunk, are joined by connected components.

Classes are told apart by a 64-bit hash of the set. Defined results: null and empty texts have no shingles and link with
nothing; a text of fewer words than a run is one shingle; texts of any length are taken whole; a null key gets its
count and a null component; repeated rows are one class; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, mixed, slices, word_hashes
from tessera.operators.components import connected_components


@dataclass(frozen=True)
class Plan:
    words: int = 4
    percent: int = 85
    chunk_sets: int = 2048
    chunk_elements: int = 1 << 21


def shingles(texts: pa.Array, plan: Plan = Plan()) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of words; the texts of a slice at once."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()).view(pa.string()), ""))  # A-Z only
    lists = pc.ascii_split_whitespace(lowered)  # the six ASCII blanks
    words, sizes = word_hashes(lists.flatten())
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    real = sizes > 0
    if not real.all():  # blanks at an end of a text
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths))
        words = words[real]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    runs = np.empty(len(words), np.uint64)  # of each word as the first
    for at in range(0, len(words), 1 << 15):  # what fits a cache
        runs[at : at + (1 << 15)] = _run(words[at : at + (1 << 15) + plan.words - 1], min(1 << 15, len(words) - at), plan.words)
    counts = np.where(lengths < plan.words, np.minimum(lengths, 1), lengths - plan.words + 1)
    for n in np.flatnonzero((lengths > 0) & (lengths < plan.words)):
        runs[starts[n]] = _run(words[starts[n] : ends[n]], 1, int(lengths[n]))[0]
    found = []
    for start, count in zip(starts.tolist(), counts.tolist()):
        own = runs[start : start + count]
        own.sort()
        fresh = np.ones(count, bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        found.append(own[fresh])
    return found


def _run(words: np.ndarray, count: int, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words that begin at the first ``count`` words; of fewer at the end of all."""
    runs = np.full(count, width, np.uint64)
    for n in range(width):
        own = runs[: max(0, len(words) - n)]
        own[:] = mixed(own * np.uint64(0x9E3779B97F4A7C15) + words[n : n + len(own)])
    return runs


def set_hash(elements: np.ndarray) -> int:
    """Of the set, signed 64 bits."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


@lru_cache(maxsize=None)
def _ranges(percent: int) -> tuple[int, ...]:
    """Least sizes of the ranges: linked sizes lie in one range or in neighbours."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, 100 * (starts[-1] - 1) // percent + 1))
    return tuple(starts)


def signatures(elements: np.ndarray, plan: Plan = Plan()) -> np.ndarray:
    """Hashes of a set's segments, signed 64 bits; linked sets that differ have one in common."""
    return all_signatures([elements], plan)[0]


def all_signatures(sets: list[np.ndarray], plan: Plan = Plan()) -> tuple[np.ndarray, np.ndarray]:
    """``signatures`` of several sets, and which set each is of."""
    starts = np.array(_ranges(plan.percent))
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    spread = mixed(elements)
    found, owners = [], []
    for further in (0, 1):
        label = np.searchsorted(starts, sizes, "right") - 1 + further
        most = starts[label + 1] - 1
        differ = 2 * most * (100 - plan.percent) // (100 + plan.percent)
        differ[sizes == 0] = 0
        segments = differ + 2 + differ // 16
        owner = np.repeat(np.arange(len(sets)), sizes)
        segment = ((elements >> np.uint64(32)) * segments.astype(np.uint64)[owner]) >> np.uint64(32)
        fresh = np.ones(len(elements), bool)  # the elements of a set are sorted
        fresh[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
        firsts = np.flatnonzero(fresh)
        if not len(firsts):
            continue
        numbers, sums, owner = segment[firsts], np.add.reduceat(spread, firsts), owner[firsts]
        filled = np.bincount(owner, minlength=len(sets))
        for n in np.flatnonzero((differ > 0) & (filled <= differ)):
            empty = np.setdiff1d(np.arange(segments[n], dtype=np.uint64), numbers[owner == n])
            numbers, sums = np.append(numbers, empty), np.append(sums, np.zeros(len(empty), np.uint64))
            owner = np.append(owner, np.full(len(empty), n))
        routed = differ[owner] > 0  # else linked sets of these sizes are equal
        numbers, sums, owner = numbers[routed], sums[routed], owner[routed]
        place = numbers * np.uint64(1 << 16) + label.astype(np.uint64)[owner]
        found.append(mixed(sums + mixed(place + np.uint64(0x632BE59BD9B4E019))))
        owners.append(owner)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).view(np.int64), np.concatenate(owners)


class Forest:
    """Union-find over positions of a chunk; the roots are in ``root`` for numpy."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = [[i] for i in range(n)]

    def union(self, a: int, b: int) -> None:
        a, b = int(self.root[a]), int(self.root[b])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.root[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []


class Index:
    """Inverted lists over sets, and the search in them."""

    def __init__(self, sets: list[np.ndarray], plan: Plan):
        self.sizes, self.plan = np.array([len(s) for s in sets], np.int64), plan
        elements = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owners, elements))
        self.owners = owners[order]
        self.elements, self.starts = np.unique(elements[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        lists = np.repeat(np.arange(len(self.elements)), self.ends - self.starts)
        self.span = len(sets)
        self.entries = lists * self.span + self.owners  # ascending: list by list, owner by owner

    def search(self, wanted: np.ndarray, forest: Forest, me: int, apart: np.ndarray | None = None) -> None:
        """Unite ``me``, whose set is ``wanted``, with each component that it links to by a set no smaller than its own.

        apart: True for the positions that may be partners. Such partners share at least 2 n p / (100 + p) elements.
        """
        n, percent = len(wanted), self.plan.percent
        needed = -(-2 * n * percent // (100 + percent))
        lists = self._present(wanted)
        if len(lists) < needed:
            return
        lengths = self.ends[lists] - self.starts[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        aside = min(needed - 1, int(needed / (0.0085 * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        merged = heapq.merge(*self._others(short, forest, me, apart))
        candidate, count = -1, 0
        for owner in [*merged, -1]:
            if owner == candidate:
                count += 1
                continue
            if candidate >= 0 and count >= needed - aside and forest.root[candidate] != forest.root[me]:
                self._probe(candidate, count, long, n, forest, me)
            candidate, count = owner, 1

    def fits(self, owners: np.ndarray, n: int) -> np.ndarray:
        sizes = self.sizes[owners]
        return (sizes >= n) & (self.plan.percent * sizes <= 100 * n)

    def _present(self, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.elements, wanted), len(self.elements) - 1)
        return at[self.elements[at] == wanted]

    def _others(self, lists: np.ndarray, forest: Forest, me: int, apart: np.ndarray | None) -> list[list[int]]:
        """The lists without what is in the component of ``me`` (or not ``apart``), empty ones left out."""
        starts, lengths = self.starts[lists], self.ends[lists] - self.starts[lists]
        starts, lengths = starts[lengths > 1], lengths[lengths > 1]
        if not len(starts):
            return []
        ends = np.cumsum(lengths)
        owners = self.owners[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]
        free = (forest.root[owners] != forest.root[me]) & self.fits(owners, self.sizes[me])
        if apart is not None:
            free &= apart[owners]
        if not free.any():
            return []
        bounds = np.searchsorted(np.flatnonzero(free), ends).tolist()
        left = owners[free].tolist()
        return [left[a:b] for a, b in zip([0, *bounds], bounds) if a < b]

    def _probe(self, candidate: int, count: int, long: np.ndarray, n: int, forest: Forest, me: int) -> None:
        other, percent = int(self.sizes[candidate]), self.plan.percent
        keys = long * self.span + candidate
        found = np.searchsorted(self.entries, keys)
        shared = count + int((self.entries[np.minimum(found, len(self.entries) - 1)] == keys).sum())
        if 100 * shared >= percent * (n + other - shared):
            forest.union(me, candidate)


def link_chunk(sets: list[np.ndarray], plan: Plan, visitors: np.ndarray | None = None) -> np.ndarray:
    """Root of each set after all searches; with ``visitors``, they and the others search only among each other."""
    forest, index = Forest(len(sets)), Index(sets, plan)
    for me, wanted in enumerate(sets):
        apart = None if visitors is None else visitors != visitors[me]
        index.search(wanted, forest, me, apart)
    return forest.root


def _classes(docs: DataFrame, plan: Plan) -> DataFrame:
    """key, n, cls (null without shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                sets = shingles(rows.column("text"), plan)
                hashes = pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), pa.array([len(s) for s in sets], pa.int64()), hashes], ["key", "n", "cls"]
                )

    fields = [docs.schema["key"], T.StructField("n", T.LongType()), T.StructField("cls", T.LongType())]
    return docs.mapInArrow(run, T.StructType(fields))


def _routes(docs: DataFrame, plan: Plan) -> DataFrame:
    """sig, cls of each row's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                sets = {set_hash(s): s for s in shingles(rows.column("text"), plan) if len(s)}
                found, owner = all_signatures(list(sets.values()), plan)
                if len(found):
                    owner = np.array(list(sets), np.int64)[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(owner)], ["sig", "cls"])

    return docs.select("text").mapInArrow(run, "sig long, cls long")


def _leaders(docs: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """leader, cls: each class that shares a segment with a lesser one, and the leader itself."""
    # A hash has a row for each class at most, one of about its hundred segments, so no hash holds a large part of the rows.
    least = F.expr("min(cls) OVER (PARTITION BY sig)")
    led = _routes(docs, plan).withColumn("leader", least).filter("leader < cls").select("leader", "cls").distinct()
    led = scratch.table(led, "led")
    return led.unionByName(led.select("leader", F.col("leader").alias("cls")).distinct())


def _sets_in(rows: pa.RecordBatch, plan: Plan) -> list[tuple[int, np.ndarray]]:
    """(position, set) of the rows whose text is of the class they stand for."""
    found = []
    for n, (elements, cls) in enumerate(zip(shingles(rows.column("text"), plan), rows.column("cls").to_pylist())):
        if len(elements) and set_hash(elements) == cls:  # rows with one key may differ in text
            found.append((n, elements))
    return found


def _search(seated: DataFrame, plan: Plan) -> DataFrame:
    """src, dst, leader: a class and the first of its component in its chunk; of singles only if they are alone.

    seated: leader, chunk, visit, cls, visitor, text; sorted by the first three within partitions.
    """

    def closed(place: tuple, members: dict, roles: dict) -> pa.RecordBatch:
        names = list(members)
        visitors = np.array([roles[c] for c in names]) if place[2] >= 0 else None
        roots = link_chunk(list(members.values()), plan, visitors)
        src = np.array(names, np.int64)
        leads = np.full(len(names), place[0], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(src), pa.array(src[roots]), pa.array(leads)], ["src", "dst", "leader"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, members, roles = None, {}, {}
        for batch in batches:
            for rows in slices(batch, "text"):
                seats = list(zip(*(rows.column(c).to_pylist() for c in ("leader", "chunk", "visit", "cls", "visitor"))))
                for n, elements in _sets_in(rows, plan):
                    *here, cls, visitor = seats[n]
                    if tuple(here) != place:
                        if members:
                            yield closed(place, members, roles)
                        place, members, roles = tuple(here), {}, {}
                    members[cls], roles[cls] = elements, visitor
        if members:
            yield closed(place, members, roles)

    return seated.mapInArrow(run, "src long, dst long, leader long")


def links(docs: DataFrame, classes: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """src, dst: links that connect what is linked, over classes."""
    key = docs.schema["key"].name
    least = classes.filter("cls IS NOT NULL AND key IS NOT NULL").groupBy("cls").agg(F.min(key).alias("key"), F.max("n").alias("n"))
    least = scratch.table(least, "least")
    routed = scratch.table(_leaders(docs, plan, scratch).join(least, "cls"), "routed")
    sums = routed.groupBy("leader").agg(
        F.ceil(
            F.greatest(F.count("cls") / F.lit(plan.chunk_sets), F.sum("n") / F.lit(plan.chunk_elements))
        ).cast("int").alias("chunks")
    )
    placed = routed.join(scratch.table(sums, "sums").hint("merge"), "leader")  # a leader of many rows can be split
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    seats = F.when(F.col("cls") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    seated = scratch.table(
        placed.select("key", "cls", "leader", "chunks", own.alias("home"), F.explode(seats).alias("chunk")), "seats"
    )
    order = ["leader", "chunk", "visit"]
    texts = docs.select("key", "text")

    def searched(at: DataFrame, name: str) -> DataFrame:
        # Seats grow with the rows: joined by sorting at every size, never broadcast.
        rows = texts.join(at.hint("merge"), "key").select(*order, "cls", "visitor", "text")
        return scratch.table(_search(rows.repartition(*order).sortWithinPartitions(*order), plan), name)

    first = seated.select("key", "cls", "leader", "chunk", F.lit(-1).alias("visit"), F.lit(False).alias("visitor"))
    found = searched(first, "first")
    # In groups of several chunks, what shares no component with the leader has yet to visit the other chunks.
    large = seated.filter("chunks > 1")
    if large.limit(1).count():
        with_leader = found.filter("src = leader").select("leader", F.col("dst").alias("dst")).distinct()
        linked = found.join(with_leader, ["leader", "dst"], "left_semi").select("leader", F.col("src").alias("cls"))
        open_ = scratch.table(
            large.filter("chunk = home").join(linked.distinct(), ["leader", "cls"], "left_anti")
            .select("key", "cls", "leader", "chunks", F.col("home").alias("visit")),
            "open",
        )
        visits = open_.select(
            "key", "cls", "leader", "visit", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        ).filter("chunk <> visit")
        hosts = visits.select("leader", "chunk", "visit").distinct()
        residents = large.filter("chunk = home").select("key", "cls", "leader", "chunk").join(hosts, ["leader", "chunk"])
        both = visits.withColumn("visitor", F.lit(True)).unionByName(residents.withColumn("visitor", F.lit(False)))
        found = found.unionByName(searched(both, "second"))
    return found.filter("src <> dst").select("src", "dst")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """key, n_shingles, component_id: the smallest key that links reach, the row's own included."""
    scratch = Scratch(docs.sparkSession, "shingles")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    classes = scratch.table(_classes(chosen, plan), "classes")
    parts = connected_components(links(chosen, classes, plan, scratch))
    # Written tables on both sides, one row a key in the right one: adaptive execution can split a hot class or component.
    full = classes.join(parts, F.col("cls") == F.col("node"), "left")
    named = scratch.table(full.select("key", "n", F.coalesce("component", "cls").alias("part")), "named")
    heads = named.filter("part IS NOT NULL").groupBy(F.col("part").alias("head_part")).agg(F.min("key").alias("head"))
    heads = scratch.table(heads, "heads")
    joined = named.join(heads.hint("merge"), F.col("part") == F.col("head_part"), "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("head", "key"))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def oracle(plan: Plan = Plan()) -> str:
    """DuckDB SQL over the shingles as text."""
    run = f"list_slice(w, i, i + {plan.words - 1})"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {plan.words - 1}, least(len(w), 1)) + 1)) AS i FROM words),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string({run}, ' ')) AS s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b USING (s)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= {plan.percent} * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(b)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""
