"""Language-model scoring by a hierarchical Pitman-Yor model.

Every token before another is a context with a Chinese restaurant of its own, END before a text's first. A customer is an
occurrence of a token there, a dish is a token. All contexts share the unigram restaurant as parent: each of their
tables is one of its customers. Its own parent is uniform over the training types and one event for all unknown words,
so the probabilities of a context sum to 1 over these events.

Seatings are sampled by Gibbs: a sweep draws the number of tables of every cell (a dish in a restaurant) given its
customers, the only thing of a seating that probabilities depend on (``Level.sweep``), and discount and strength from
their conditionals (``Level.resample``). Probabilities are averaged over the sweeps after the first ones.

Jobs:

1. Counts. Slices of the documents send their distinct pairs (context, token) with training counts, in compressed
   columns, to the bucket of the context. A bucket seats its contexts under a first guess of the parent and sends the
   counts and tables of each word to the word's group.
2. Words. Groups add them up, seat their share of the unigram restaurant and answer each bucket by position.
3. Scores. Slices send all occurrences; buckets seat their contexts anew under the sampled parent with the discount
   and strength that the first job found, and return sums by document.

Counts come from every training document, those too that choose the ``Plan.head`` words with short numbers, whose totals
are broadcast, split contexts and make the first guess. Words beyond are known by
63-bit hashes. Contexts that would fill a bucket are split by token over several; job 3 draws their parts' tables just as
job 1 did, under the first guess, and takes the context's customers and tables from job 1, so that they add up.
A bucket and a group hold bounded numbers of tokens, and nothing that grows with the corpus reaches the driver.

Texts are lower-cased (A-Z), words are what six ASCII blanks part, and one end follows. Defined results: null and empty
texts are their end alone; words of any length are taken whole; without training documents all words are unknown, which
is certain then; repeated rows count and are scored each; a null key is held out or not as the text ``""``; an empty table
gives an empty result; other columns are ignored. The documents are read twice and must read alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, give_back, mixed, slices, word_hashes

END = 0  # its number
_TAIL = 1 << 63  # numbers from here on are hashes


@dataclass(frozen=True)
class Plan:
    head: int = (1 << 16) - 1  #: words with numbers of two bytes
    sample: int = 0  #: without effect, for callers that give it: all training words choose them
    bucket: int = 1 << 19  #: tokens of a bucket of contexts, about
    group: int = 1 << 22  #: tokens of a group of words, about
    burn: int = 3
    sweeps: int = 6
    seed: int = 11
    slice_bytes: int = 4 << 20  #: text that a worker looks at at once
    partial: int = 1 << 20  #: documents whose sums a task holds


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0


# --- restaurants ------------------------------------------------------------------------------------------------------

_SMALL = 128  # customers up to which the tables of a dish are drawn from a list of all probabilities
_STEPS = 2  # Metropolis steps of larger dishes in a sweep
_TIERS = ((1, 2), (2, 4), (4, 8), (8, 16), (16, 48), (48, _SMALL))  # dishes drawn together: above, up to


def _falling(f, goal: np.ndarray) -> np.ndarray:
    """y in (0, 1) with f(y) = goal, for a falling f."""
    low, high = np.full(len(goal), -690.0), np.full(len(goal), -1e-13)  # logarithms
    for _ in range(42):
        mid = (low + high) / 2
        above = f(np.exp(mid)) > goal
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.exp((low + high) / 2)


def log_share(counts: np.ndarray, tables: np.ndarray, d: float, nodes: int = 28) -> np.ndarray:
    """log of what ``tables`` independent Sibuya numbers have for the sum ``counts``.

    Their generating function is 1 - (1 - x)^d, so t! d^t / c! of it is the generalised Stirling number that counts the
    seatings of c customers at t tables. Cauchy's integral, on a parabola in log x that runs near the saddle and
    around the branch point at 0, or on a circle through the saddle where sums vary little.
    """
    c, t = counts.astype(float), np.minimum(counts, tables).astype(float)
    with np.errstate(over="ignore"):
        y = _falling(lambda y: d * (1 - y) * y ** (d - 1) / -np.expm1(d * np.log(y)), np.maximum(c / t, 1 + 1e-9))
    near = np.maximum(-np.log1p(-y), 2 / c)
    varies = c * np.maximum(0.0, 1 + (1 - y) * (1 - d) / y - c / t)
    tight = varies < 25
    width = np.where(tight, np.pi, np.sqrt(80 / np.minimum(min(4 * (1 - d), 2) * c * near, 4 * near**2 * np.maximum(varies, 25))))
    u = width[:, None] * (np.arange(nodes + 1) / nodes)
    bent = np.where(tight[:, None], 1, 1 + 1j * u)
    z = np.where(tight[:, None], 1j * u - near[:, None], -near[:, None] * bent**2)
    power = t[:, None] * np.log(1 - (-np.expm1(z)) ** d) - c[:, None] * z
    top = power[:, 0].real
    terms = (np.exp(power - top[:, None]) * bent).real
    total = (terms.sum(axis=1) - (terms[:, 0] + terms[:, -1]) / 2) * width / nodes / np.pi * np.where(tight, 1.0, 2 * near)
    return np.where(t == c, c * np.log(d), top + np.log(np.maximum(total, 1e-300)))


class Level:
    """Restaurants with one discount and strength. A cell is a dish in a restaurant, with its customers and tables."""

    GRID = tuple(np.round(np.arange(0.05, 0.96, 0.05), 2))
    STRENGTHS = tuple(np.round(np.geomspace(0.02, 2000, 41), 6))

    def __init__(self, place: np.ndarray, counts: np.ndarray, n_places: int, rng: np.random.Generator,
                 discount: float | None = None, strength: float = 1.0):
        self.place, self.counts, self.n_places, self.rng = place, counts.astype(np.int64), n_places, rng
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        first = np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9)
        self.discount = float(self.GRID[int(np.abs(np.array(self.GRID) - first).argmin())] if discount is None else discount)
        self.strength = strength
        self.guests = np.bincount(place, self.counts, n_places)
        tables = np.minimum(self.counts, np.maximum(1, np.rint(self.counts**self.discount))).astype(np.int64)
        self.tables = np.where(self.counts > 0, tables, 0)
        # A cell of one customer has one table: only the others are ever drawn.
        self._many = np.flatnonzero(self.counts > 1)
        self._homes, many = place[self._many], self.counts[self._many]
        self._ones = np.bincount(place[self.counts == 1], minlength=n_places)
        self._tiers = [(high, np.flatnonzero((many > low) & (many <= high))) for low, high in _TIERS]
        self._large = np.flatnonzero(many > _SMALL)

    @staticmethod
    @lru_cache
    def small(d: float) -> np.ndarray:
        """[customers, tables - 1]: logarithm of ``log_share``'s share over the factorial of tables."""
        n = np.arange(1, _SMALL + 1)
        single = np.concatenate([[0.0], d * np.cumprod(np.append(1.0, (n[:-1] - d) / n[1:]))])
        shares = [np.append(1.0, np.zeros(_SMALL))]
        for _ in range(_SMALL):
            shares.append(np.convolve(shares[-1], single)[: _SMALL + 1])
        with np.errstate(divide="ignore"):
            return np.log(np.array(shares[1:])).T - np.cumsum(np.log(n))

    @property
    def total(self) -> np.ndarray:
        """Tables of each restaurant."""
        return self._ones + np.bincount(self._homes, self.tables[self._many], self.n_places)

    def resample(self) -> None:
        """Draw the discount, then the strength, each from its conditional on a grid."""
        counts, tables, n = _distinct(self.counts, self.tables)
        guests, total, places = _distinct(self.guests.astype(np.int64), self.total.astype(np.int64))
        low = counts <= _SMALL

        def room(d: float, a: np.ndarray | float) -> np.ndarray:
            """What tables of restaurants weigh, for one strength or several."""
            a = np.atleast_1d(a)[:, None]
            logs = (total - 1) * np.log(d) + _lgamma(a / d + total) - _lgamma(a / d + 1) + _lgamma(a + 1) - _lgamma(a + guests)
            return (logs * places).sum(axis=1)

        def weight(d: float) -> float:
            of = np.empty(len(counts))
            of[low] = self.small(d)[counts[low], tables[low] - 1] + _lgamma(tables[low] + 1.0)
            of[~low] = log_share(counts[~low], tables[~low], d) if not low.all() else 0.0
            return float((n * (of - tables * np.log(d))).sum() + room(d, self.strength)[0])

        self.discount = self._chosen(self.GRID, np.array([weight(d) for d in self.GRID]))
        self.strength = self._chosen(self.STRENGTHS, room(self.discount, np.array(self.STRENGTHS)))

    def _chosen(self, grid: tuple, logs: np.ndarray) -> float:
        ends = np.cumsum(np.exp(logs - logs.max()))
        return float(grid[int(np.searchsorted(ends, self.rng.random() * ends[-1], "right"))])

    def sweep(self, parent: np.ndarray) -> None:
        """Draw the tables of all cells given their customers; ``parent``: probabilities of all cells' dishes.

        A seating weighs as ``parent`` to the number of tables, the dishes' ways of seating, and a factor of all tables
        of the restaurant. That factor is a moment of a gamma variable; given this variable, dishes are independent.
        """
        many = self._many
        rate = np.maximum(self.rng.gamma(self.strength / self.discount + self.total)[self._homes] * parent[many], 1e-300)
        shares = self.small(self.discount)
        for high, here in self._tiers:
            if high == 2:  # one table or two
                odds = rate[here] * np.exp(shares[2, 1] - shares[2, 0])
                self.tables[many[here]] = 1 + (self.rng.random(len(here)) * (1 + odds) >= 1)
                continue
            step = (1 << 18) // high
            for at in range(0, len(here), step):
                some = here[at : at + step]
                weights = shares[self.counts[many[some]], :high] + np.log(rate[some])[:, None] * np.arange(1, high + 1)
                ends = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
                drawn = self.rng.random(len(some)) * ends[:, -1]
                self.tables[many[some]] = 1 + (ends <= drawn[:, None]).sum(axis=1)
        for at in range(0, len(self._large), 1 << 13):
            some = self._large[at : at + (1 << 13)]
            self._walk(many[some], rate[some])

    def _walk(self, cells: np.ndarray, rate: np.ndarray) -> None:
        """Metropolis steps with proposals around the mode, which may be anywhere else."""
        d, c = self.discount, self.counts[cells]
        with np.errstate(over="ignore"):
            y = _falling(lambda y: rate * d * (1 - y) * y ** (d - 1), c.astype(float))
        mode = rate * -np.expm1(d * np.log(y))
        spread = np.sqrt(np.maximum(1.0, mode - c * y / (y + (1 - y) * (1 - d))))
        mode = np.clip(np.rint(mode), 1, c).astype(np.int64)
        logs = np.append(0.0, np.cumsum(np.log(np.arange(1, int(c.max(initial=1)) + 1)))) if len(c) else np.zeros(1)

        def height(t: np.ndarray) -> np.ndarray:
            """Log weight over log density of the proposal."""
            return t * np.log(rate) - logs[t] + log_share(c, t, d) + np.abs(t - mode) / spread

        now = self.tables[cells]
        has = height(now)
        leave = -np.expm1(-1 / spread)
        for _ in range(_STEPS):
            new = mode + self.rng.geometric(leave) - self.rng.geometric(leave)
            inside = (new >= 1) & (new <= c)
            wants = height(np.clip(new, 1, c))
            takes = inside & (np.log(self.rng.random(len(c))) < wants - has)
            now, has = np.where(takes, new, now), np.where(takes, wants, has)
        self.tables[cells] = now

def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs with a > 0, and how often each occurs."""
    width = int(b.max(initial=0)) + 1
    pairs, n = np.unique((a * width + b)[a > 0], return_counts=True)
    return pairs // width, pairs % width, n


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Γ for x > 0: Stirling's series after eight steps up."""
    x = np.asarray(x, float)
    y = x + 8
    steps = sum(np.log(x + k) for k in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


# --- words and slices -------------------------------------------------------------------------------------------------


class Numbers:
    """The numbers of words, from 1, in a table by their hashes with open addressing."""

    def __init__(self, head: list[bytes]):
        own, _ = word_hashes(pa.array(head, pa.binary()).view(pa.string()))
        self.bits = max(8, 2 + len(head).bit_length())
        self.slots, self.number = np.zeros((1 << self.bits) + 1, np.uint64), np.zeros((1 << self.bits) + 1, np.uint64)
        own = own | np.uint64(_TAIL)
        left, at = np.arange(len(own)), self._first(own)
        while len(left):
            _, one = np.unique(at, return_index=True)  # of several for a slot, the first
            put = one[self.slots[at[one]] == 0]
            self.slots[at[put]], self.number[at[put]] = own[left[put]], left[put].astype(np.uint64) + np.uint64(1)
            again = self.slots[at] != own[left]
            left, at = left[again], (at[again] + 1) & ((1 << self.bits) - 1)

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return (mixed(codes) >> np.uint64(64 - self.bits)).astype(np.int64)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The number or hash of words with these hashes."""
        codes = hashes | np.uint64(_TAIL)
        at = self._first(codes)
        held = self.slots[at]
        same = held == codes
        out = np.where(same, self.number[at], codes)
        left = np.flatnonzero(~same & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[left]]
            same = held == codes[left]
            out[left[same]] = self.number[at[left[same]]]
            left = left[~same & (held != 0)]
        return out


@dataclass(frozen=True)
class Layout:
    head: list[bytes]  #: words numbered from 1
    parts: np.ndarray  #: over how many buckets each numbered context is split
    buckets: int
    groups: int
    guess: np.ndarray  #: probabilities of numbered words, a first guess
    rest: float  #: of any other word

    @property
    def numbers(self) -> Numbers:
        return Numbers(self.head)

    def guessed(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < _TAIL, self.guess[_number(words)], self.rest)

    def split(self, contexts: np.ndarray) -> np.ndarray:
        """Over how many buckets each context is split."""
        return np.where(contexts < _TAIL, self.parts[_number(contexts)], 1)

    def bucket(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        part = mixed(words ^ np.uint64(0x5851F42D4C957F2D)) % self.split(contexts).astype(np.uint64)
        return (mixed(contexts * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(self.buckets)).astype(np.int64)

    def order(self, buckets: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A key that sorts by bucket, and nearly always puts equal pairs of one context side by side."""
        free = 63 - self.buckets.bit_length()
        near = mixed(contexts) >> np.uint64(64 - free // 2) << np.uint64(free - free // 2)
        return (buckets.astype(np.uint64) << np.uint64(free)) | near | (mixed(words) >> np.uint64(64 - free + free // 2))

    def group(self, words: np.ndarray) -> np.ndarray:
        return (mixed(words ^ np.uint64(0x14057B7EF767814F)) % np.uint64(self.groups)).astype(np.int64)


def _number(codes: np.ndarray) -> np.ndarray:
    """Of words with numbers; 0 of others."""
    return np.where(codes < _TAIL, codes, 0).astype(np.int64)


def _codes(words: list[bytes], numbers: Numbers) -> np.ndarray:
    """The number or hash of each word."""
    return numbers.codes(word_hashes(pa.array(words, pa.binary()).view(pa.string()))[0])


def _words(texts: pa.Array) -> pa.Array:
    """Lists of words in lower case, empty ones where blanks begin or end a text."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    lists = _words(texts)
    hashes, sizes = word_hashes(lists.flatten())
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    real = sizes > 0
    if not real.all():  # blanks at an end of a text
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths))
        hashes = hashes[real]
    return hashes, lengths


def _sequence(texts: pa.Array, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens, an end after each text, and the number of tokens of each."""
    hashes, lengths = _hashes(texts)
    return np.insert(numbers.codes(hashes), np.cumsum(lengths), np.uint64(END)), lengths + 1


def _packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [np.frombuffer(raw[end - size : end], kind) for size, end, kind in zip(sizes, ends, kinds.split())]


_CODE_KINDS = "u1 <u2 <u8"


def _code_columns(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which codes are hashes, the numbers, the hashes."""
    hashed = codes >= _TAIL
    return np.packbits(hashed), codes[~hashed].astype("<u2"), codes[hashed].astype("<u8")


def _codes_of(bits: np.ndarray, numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hashed = np.unpackbits(bits, count=len(numbers) + len(hashes)).astype(bool)
    out = np.empty(len(hashed), np.uint64)
    out[~hashed], out[hashed] = numbers, hashes
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before, the first included."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(fresh)


def _spread(docs: DataFrame, layout: Layout, plan: Plan, whole: bool) -> DataFrame:
    """bucket, kind, place, blob of the pairs (context, token) of each slice, ``place``.

    ``whole``: with the documents of all occurrences, and rows of kind 2 for the documents themselves: place, at, key,
    n_tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    key_kind = docs.schema["key"].dataType
    fields = [("bucket", T.LongType()), ("kind", T.IntegerType()), ("place", T.LongType()), ("blob", T.BinaryType())]
    fields += [("at", T.IntegerType()), ("key", key_kind), ("n_tokens", T.LongType())] if whole else []
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", plan.slice_bytes):
                for at in range(0, rows.num_rows, 1 << 16):
                    yield rows.slice(at, 1 << 16)
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, place = shared.value, TaskContext.get().partitionId() << 32
        numbers = layout.numbers
        for rows in cut(batches):
            words, lengths = _sequence(rows.column("text"), numbers)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            contexts = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
            train = np.array(rows.column("train").to_pylist())[owner]
            bucket = layout.bucket(contexts, words)
            order = np.argsort(layout.order(bucket, contexts, words))
            bucket, contexts, words, train, owner = (x[order] for x in (bucket, contexts, words, train, owner))
            starts = _runs(bucket, contexts, words)
            n = np.diff(starts, append=len(words))
            counted = np.add.reduceat(train.astype(np.int64), starts)
            bucket, contexts, words = bucket[starts], contexts[starts], words[starts]
            first = _runs(bucket)
            blobs = []
            for a, b in zip(first, np.append(first[1:], len(bucket))):
                own = _runs(contexts[a:b])
                columns = [*_code_columns(contexts[a:b][own]), np.diff(own, append=b - a).astype("<u4")]
                columns += [*_code_columns(words[a:b]), counted[a:b].astype("<u4")]
                if whole:
                    columns += [n[a:b].astype("<u4"), owner[starts[a] : starts[b] if b < len(starts) else None].astype("<u2")]
                blobs.append(_packed(*columns))
            out = [pa.array(bucket[first]), pa.array(np.ones(len(first), np.int32)), pa.array(np.full(len(first), place)), pa.array(blobs, pa.binary())]
            if whole:
                m = len(first)
                out += [pa.nulls(m, pa.int32()), pa.nulls(m, rows.column("key").type), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names)
            if whole:
                m = len(lengths)
                out = [pa.array(np.full(m, place % layout.buckets)), pa.array(np.full(m, 2, np.int32)), pa.array(np.full(m, place)), pa.nulls(m, pa.binary())]
                out += [pa.array(np.arange(m, dtype=np.int32)), rows.column("key"), pa.array(lengths.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names)
            place += 1
        give_back()

    return docs.select("key", "text", (~held_out("key")).alias("train")).mapInArrow(run, schema)


def _pairs(blob: bytes, whole: bool) -> list[np.ndarray]:
    """Contexts, tokens, training counts, and (``whole``) occurrences and their documents."""
    kinds = f"{_CODE_KINDS} <u4 {_CODE_KINDS} <u4" + (" <u4 <u2" if whole else "")
    found = _unpacked(blob, kinds)
    return [np.repeat(_codes_of(*found[:3]), found[3]), _codes_of(*found[4:7]), *found[7:]]


class Cells:
    """The distinct pairs of a bucket with their training counts."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray):
        key = mixed(contexts ^ mixed(words + np.uint64(0x632BE59BD9B4E019)))
        order = np.argsort(key)
        starts = _runs(contexts[order], words[order])
        if len(starts) > len(_runs(key[order])):  # two pairs with one key
            order = np.lexsort((words, contexts))
            starts = _runs(contexts[order], words[order])
        self.contexts, self.words = contexts[order[starts]], words[order[starts]]
        self.counts = np.add.reduceat(counts[order].astype(np.int64), starts)
        self.of = np.empty(len(order), np.int64)  #: the cell of each pair given
        self.of[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        self.seen = np.flatnonzero(self.counts > 0)
        self.names, self.name = np.unique(self.contexts, return_inverse=True)
        self.place = self.name[self.seen]

    def level(self, some: np.ndarray, rng: np.random.Generator, **given) -> Level:
        """Of some of the seen cells."""
        return Level(self.place[some], self.counts[self.seen[some]], len(self.names), rng, **given)

    def divided(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Seen cells of contexts that are whole here, and of those that are split."""
        split = (layout.split(self.names) > 1)[self.place]
        return np.flatnonzero(~split), np.flatnonzero(split)

    def vocabulary(self, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words and split contexts by group and code, their groups, and where the cells' words and split contexts are."""
        split = self.names[layout.split(self.names) > 1]
        words, at = np.unique(np.concatenate([self.words, split]), return_inverse=True)
        group = layout.group(words)
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return words[order], group[order], place[at[: len(self.words)]], place[at[len(self.words) :]]


# --- the three jobs ---------------------------------------------------------------------------------------------------

_STATS = [f"x{n}" for n in range(6)]
_REPLY = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("place", T.LongType()),
     T.StructField("blob", T.BinaryType()), *[T.StructField(x, T.DoubleType()) for x in _STATS]]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Of _REPLY; stats may be left out."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.float64()] * len(_STATS)]
    whole = [(*r, *[None] * (len(kinds) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole), kinds)], _REPLY.names)


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that follow each other with one value of ``by``."""
    here, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if row[by] != here and rows:
                    yield here, rows
                    rows = []
                here = row[by]
                rows.append(row)
    if rows:
        yield here, rows


def _settled(level: Level, parent: np.ndarray, plan: Plan, free: bool = True) -> Iterator[None]:
    """Sweeps, the first ones left out; ``free``: discount and strength are drawn too."""
    for sweep in range(plan.burn + plan.sweeps):
        level.sweep(parent)
        if free and sweep % 3 == 0 and len(level.counts):
            level.resample()
        if sweep >= plan.burn:
            yield


def split_tables(cells: Cells, some: np.ndarray, layout: Layout, plan: Plan, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of cells of split contexts under the first guess, averaged and last. Jobs 1 and 3 draw the same."""
    contexts, words = cells.contexts[cells.seen[some]], cells.words[cells.seen[some]]
    names, place = np.unique(contexts, return_inverse=True)
    level = Level(place, cells.counts[cells.seen[some]], len(names), np.random.default_rng((plan.seed, 4, bucket)))
    mean = np.zeros(len(some))
    for _ in _settled(level, layout.guessed(words) * layout.split(contexts), plan):
        mean += level.tables / plan.sweeps
    return mean, level.tables


def count_tables(docs: DataFrame, layout: Layout, plan: Plan) -> DataFrame:
    """_REPLY rows for groups (in ``place``): kind 0 with words, counts, tables and contexts' tables; kind 3 with hyperparameters."""
    shared = docs.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for bucket, rows in _grouped(batches, "bucket"):
            parts = [_pairs(r["blob"], False) for r in rows]
            cells = Cells(*(np.concatenate(c) for c in zip(*parts)))
            whole, split = cells.divided(layout)
            level = cells.level(whole, np.random.default_rng((plan.seed, 1, bucket)))
            hyper = [(level.discount, level.strength) for _ in _settled(level, layout.guessed(cells.words[cells.seen[whole]]), plan)]
            mean, last = split_tables(cells, split, layout, plan, bucket)
            seated = np.zeros(len(cells.seen))
            seated[whole], seated[split] = level.tables, last
            words, group, at, named = cells.vocabulary(layout)
            counts = np.bincount(at, cells.counts, len(words))
            tables = np.bincount(at[cells.seen], seated, len(words))
            own = np.zeros(len(words))
            own[named] = np.bincount(cells.place[split], mean, len(cells.names))[layout.split(cells.names) > 1]
            out = []
            first = _runs(group)
            for a, b in zip(first, np.append(first[1:], len(group))):
                columns = (x[a:b].astype(kind) for x, kind in ((counts, "<u4"), (tables, "<u4"), (own, "<f8")))
                out.append((bucket, 0, int(group[a]), _packed(*_code_columns(words[a:b]), *columns)))
            d, a = np.mean(hyper, axis=0)
            n = float(level.guests.sum())
            out.append((bucket, 3, int(bucket % layout.groups), None, n * d, n * np.log(a), n))
            yield _rows(out)
        give_back()

    spread = _spread(docs, layout, plan, False).repartition("bucket").sortWithinPartitions("bucket", "place")
    return spread.mapInArrow(run, _REPLY)


def seat_words(counted: DataFrame, layout: Layout, plan: Plan) -> DataFrame:
    """_REPLY rows: kind 0 answers buckets; 1 has a group's sums, 2 numbered words, 3 hyperparameters passed on."""
    seed = plan.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _grouped(batches, "place"):
            out = [tuple(r[c] for c in _REPLY.names) for r in rows if r["kind"] == 3]
            asked = [r for r in rows if r["kind"] == 0]
            parts = [_unpacked(r["blob"], f"{_CODE_KINDS} <u4 <u4 <f8") for r in asked]
            listed = [_codes_of(*p[:3]) for p in parts]
            words, at = np.unique(np.concatenate(listed), return_inverse=True) if listed else (np.zeros(0, np.uint64), None)
            if len(words):
                counts, tables, own = (np.bincount(at, np.concatenate([p[n] for p in parts]), len(words)) for n in (3, 4, 5))
                level = Level(np.zeros(len(words), np.int64), tables, 1, np.random.default_rng((seed, 2, group)))
                types = max(1, int((counts > 0).sum()))
                mean, hyper = np.zeros(len(words)), []
                for _ in _settled(level, np.full(len(words), 1 / types), plan):
                    mean += level.tables / plan.sweeps
                    hyper.append((level.discount, level.strength))
                d, a = np.mean(hyper, axis=0)
                n = tables.sum()
                out.append((None, 1, group, None, counts.sum(), n, mean.sum(), float((counts > 0).sum()), n * d, n * np.log(a)))
                for w in np.flatnonzero(words < _TAIL):
                    out.append((None, 2, group, None, float(words[w]), counts[w], tables[w], mean[w], own[w]))
                ends = np.cumsum([len(x) for x in listed])
                for row, codes, end in zip(asked, listed, ends):
                    which = at[end - len(codes) : end][codes >= _TAIL]
                    if len(which):
                        columns = (counts[which].astype("<u4"), tables[which].astype("<u4"), mean[which].astype("<f4"))
                        out.append((row["bucket"], 0, group, _packed(*columns)))
            for start in range(0, len(out), 4096):
                yield _rows(out[start : start + 4096])
        give_back()

    return counted.repartition("place").sortWithinPartitions("place", "bucket", "kind").mapInArrow(run, _REPLY)


@dataclass(frozen=True)
class Model:
    """What all buckets need of the sampled model."""

    layout: Layout
    counts: np.ndarray  #: of numbered words
    tables: np.ndarray  #: of numbered words in all contexts
    means: np.ndarray  #: of tables of numbered words in the unigram restaurant
    totals: np.ndarray  #: tables of numbered contexts that are split
    n_train: int
    types: int
    customers: float  #: of the unigram restaurant
    rooms: float  #: its tables
    discounts: tuple[float, float]  #: of contexts and of the unigram restaurant
    strengths: tuple[float, float]

    def unigram(self, tables: np.ndarray, means: np.ndarray) -> np.ndarray:
        """Probabilities of words with so many tables in contexts and in the unigram restaurant."""
        d, a = self.discounts[1], self.strengths[1]
        left = (a + d * self.rooms) / (self.types + 1)
        return (tables - d * means + left) / (a + self.customers)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n_train + 0.1 * (self.types + 1)))


def predicted(cells: Cells, model: Model, parent: np.ndarray, plan: Plan, bucket: int) -> np.ndarray:
    """Averaged predictive probabilities of the cells, those without training customers included."""
    d, a = model.discounts[0], model.strengths[0]
    whole, split = cells.divided(model.layout)
    level = cells.level(whole, np.random.default_rng((plan.seed, 3, bucket)), discount=d, strength=a)
    seated, total = np.zeros(len(cells.seen)), np.zeros(len(cells.names))
    for _ in _settled(level, parent[cells.seen[whole]], plan, free=False):
        seated[whole] += level.tables / plan.sweeps
        total += level.total / plan.sweeps
    seated[split] = split_tables(cells, split, model.layout, plan, bucket)[0]
    parts, number = model.layout.split(cells.names) > 1, _number(cells.names)
    total = np.where(parts, model.totals[number], total)
    guests = np.where(parts, model.counts[number], level.guests)
    found = ((a + d * total) / (a + guests))[cells.name] * parent  # a context never met leaves all to its parent
    found[cells.seen] += (cells.counts[cells.seen] - d * seated) / (a + guests[cells.place])
    return found


def sum_scores(docs: DataFrame, replies: DataFrame, model: Model, plan: Plan) -> DataFrame:
    """place, at, key, n_tokens, or place and a blob of documents with known tokens, base and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spread = _spread(docs, model.layout, plan, True)
    answers = replies.filter("kind = 0").select("bucket", "kind", "place", "blob")
    both = spread.unionByName(answers, allowMissingColumns=True)
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "kind", "place")
    schema = T.StructType([f for f in spread.schema if f.name in ("place", "blob", "at", "key", "n_tokens")])

    def scored(bucket: int, rows: list[dict], model: Model) -> Iterator[tuple[int, np.ndarray]]:
        """Slice and, by document, known tokens, base and score."""
        blobs = [r for r in rows if r["kind"] == 1]
        if not blobs:
            return
        parts = [_pairs(r["blob"], True) for r in blobs]
        cells = Cells(*(np.concatenate([p[n] for p in parts]) for n in (0, 1, 2)))
        words, _, at, _ = cells.vocabulary(model.layout)
        counts, tables, means = (x[_number(words)].astype(float) for x in (model.counts, model.tables, model.means))
        hashed = words >= _TAIL
        answers = [_unpacked(r["blob"], "<u4 <u4 <f4") for r in rows if r["kind"] == 0]
        if hashed.any():
            counts[hashed], tables[hashed], means[hashed] = (np.concatenate(c) for c in zip(*answers))
        parent = model.unigram(tables, means)[at]
        found = predicted(cells, model, parent, plan, bucket)
        score, base, known = np.log10(found), model.base(counts[at]), counts[at] > 0
        start = 0
        for row, (contexts, _, _, n, owner) in zip(blobs, parts):
            cell = np.repeat(cells.of[start : start + len(contexts)], n)
            start += len(contexts)
            yield row["place"], np.stack([np.bincount(owner, x[cell], int(owner.max()) + 1) for x in (known, base, score)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums, held, key_type = shared.value, {}, 0, None

        def flushed() -> pa.RecordBatch:
            places = sorted(sums)
            blobs = []
            for place in places:
                some = np.flatnonzero(sums[place][2])
                known, base, score = sums[place][:, some]
                blobs.append(_packed(some.astype("<u2"), known.astype("<u4"), base.astype("<f8"), score.astype("<f4")))
            n = len(places)
            sums.clear()
            out = {"place": pa.array(places, pa.int64()), "blob": pa.array(blobs, pa.binary()), "at": pa.nulls(n, pa.int32()),
                   "key": pa.nulls(n, key_type), "n_tokens": pa.nulls(n, pa.int64())}
            return pa.RecordBatch.from_arrays([out[c] for c in schema.names], schema.names)

        def passed() -> Iterator[pa.RecordBatch]:
            """What is not a document goes on; documents are put out here."""
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("key").type
                documents = pc.equal(batch.column("kind"), 2)
                ready.append(batch.filter(documents).select(schema.names))
                yield batch.filter(pc.invert(documents)).select(["bucket", "kind", "place", "blob"])

        ready: list = []
        for bucket, rows in _grouped(passed(), "bucket"):
            for place, own in scored(bucket, rows, model):
                before = sums.get(place)
                if before is None:
                    sums[place] = own
                    held += own.shape[1]
                else:
                    if before.shape[1] < own.shape[1]:
                        before, own = own, before
                    before[:, : own.shape[1]] += own
                    sums[place] = before
            if held > plan.partial:
                yield flushed()
                held = 0
            yield from ready
            ready.clear()
        yield from ready
        if sums:
            yield flushed()
        give_back()

    return dealt.mapInArrow(run, schema)


def layout_of(docs: DataFrame, plan: Plan, scratch: Scratch) -> Layout:
    """From the size of the texts and the counts of all training words."""
    train = ~held_out("key")
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(train).alias("train")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", plan.slice_bytes):
                words = _words(rows.column("text")).flatten()
                _, first, n = np.unique(word_hashes(words)[0], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(first)), pa.array(n)], ["word", "n"])
        give_back()

    counted = docs.filter(train).select("text").mapInArrow(run, "word string, n long").filter("word <> ''")
    sums = scratch.table(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    heavy = sums.orderBy(F.desc("n"), "word").limit(plan.head).collect()
    whole = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
    ends = max(1, size["train"])
    scratch.drop("words")
    total, types = (whole["n"] or 0) + ends, whole["types"] + 1
    counts = np.array([ends, *[r["n"] for r in heavy]], float)
    expected = (size["bytes"] or 0) / 6 + size["rows"]
    parts = np.maximum(1, np.ceil(counts / total * expected / (plan.bucket / 4))).astype(np.int64)
    guess = counts**0.8  # about how many contexts a word has
    others = max(1, types - len(heavy))
    rest = 1 / (guess.sum() + others)
    guess = guess / (guess.sum() + others)
    return Layout(
        [r["word"].encode() for r in heavy], parts, 1 + int(expected // plan.bucket), 1 + int(expected // plan.group), guess, rest
    )


def fit(docs: DataFrame, layout: Layout, plan: Plan, scratch: Scratch) -> tuple[DataFrame, Model]:
    """docs: key, text. Answers to the buckets, and the model."""
    replies = scratch.table(seat_words(count_tables(docs, layout, plan), layout, plan), "replies")
    x = [F.sum(c).alias(c) for c in _STATS]
    sums = replies.filter("kind = 1").agg(*x).first()
    n_train, customers, rooms, types = (float(sums[c] or 0) for c in _STATS[:4])
    hyper = replies.filter("kind = 3").agg(*x).first()
    guests = max(1.0, hyper["x2"] or 0.0)
    counts, tables, means, totals = np.zeros((4, len(layout.head) + 1))
    for row in replies.filter("kind = 2").select(*_STATS[:5]).collect():  # one for each word with a number
        n = int(row["x0"])
        counts[n], tables[n], means[n], totals[n] = (row[c] for c in _STATS[1:5])
    discounts = (hyper["x0"] or 0.5) / guests if hyper["x0"] else 0.5, (sums["x4"] / customers) if customers else 0.5
    strengths = float(np.exp((hyper["x1"] or 0.0) / guests)), float(np.exp(sums["x5"] / customers)) if customers else 1.0
    return replies, Model(layout, counts, tables, means, totals, int(n_train), int(types), customers, rooms, discounts, strengths)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    scratch = Scratch(docs.sparkSession, "pitman-yor")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    replies, model = fit(chosen, layout_of(chosen, plan, scratch), plan, scratch)
    summed = sum_scores(chosen, replies, model, plan)
    dealt = summed.repartition("place").sortWithinPartitions("place", F.col("blob").isNotNull(), "at")
    names = ["key", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, lengths, sums, key_type = None, [], [], None, None

        def closed() -> pa.RecordBatch:
            known, base, score = sums
            columns = [pa.array(keys, key_type), pa.array(lengths, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            key_type = batch.schema.field("key").type
            for place, blob, name, n in zip(*(batch.column(c).to_pylist() for c in ("place", "blob", "key", "n_tokens"))):
                if place != here:
                    if here is not None:
                        yield closed()
                    here, keys, lengths, sums = place, [], [], None
                if blob is None:
                    keys.append(name), lengths.append(n)
                    continue
                if sums is None:
                    sums = np.zeros((3, len(keys)))
                at, *found = _unpacked(blob, "<u2 <u4 <f8 <f4")
                sums[:, at] += np.stack(found)
        if here is not None:
            yield closed()

    kinds = [chosen.schema["key"].dataType, T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    merged = dealt.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))
    found = scratch.table(merged, "scores")
    scratch.drop("replies")
    return found.select(
        F.col("key").alias(key),
        held_out("key").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
