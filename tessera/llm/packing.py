"""Packing token ids into sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A hash deals the documents to partitions and orders them there; each run of ``Plan.group`` documents (or of as many ids
as ``Plan.group_ids``) is a group and is packed on its own, so a task holds one group at a time, whatever a key's share
of the rows. A document's ids fill whole sequences first; the rest, shorter than a sequence, goes to the first open
sequence with room for it, longest rests first.

Texts are split at single blanks between other characters, where byte-level BPE never merges. A slice's distinct chunks
are looked up in a bounded table, so the tokenizer sees a frequent word once, and ids are gathered by offsets in numpy.

Defined results: a null or empty text is the closing id alone; texts of any length are encoded whole; repeated rows are
packed each; rests of one length are taken in the order of the group; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

#: Blanks other than the six of ASCII; a text that holds one is split by pattern, as is one with blanks side by side.
_RARE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_ODD = f"\\A | \\z|[ \t\n\r\x0b\x0c] | [ \t\n\r\x0b\x0c]|[{_RARE}]"
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_AT_ONCE = 1 << 17  # chunks whose ids are gathered together
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


@dataclass(frozen=True)
class Plan:
    length: int = 2048
    end_id: int = 1
    group: int = 4096
    group_ids: int = 1 << 23
    seed: str = "pack-1"
    chunks: int = 200_000  #: entries of each table of chunks, and of the old ones
    slice_bytes: int = 4 << 20  #: text that is split at once


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _byte_marks() -> list[str]:
    """The characters that byte-level BPE writes for the 256 bytes: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in plain else next(others)) for byte in range(256)]


class _Chunks(dict):
    """Chunk after ``lead`` → its ids as little-endian uint32 bytes.

    A run of letters ends where something else follows, and a line feed between other characters stands alone, so such
    chunks are put together from their parts, which are kept; letters alone go to the tokenizer's model. A full table becomes
    the old one, from which what is used again is taken over.
    """

    def __init__(self, tokenizer, lead: str, limit: int, plain: _Chunks | None = None):
        super().__init__()
        self.encode, self.word, self.lead, self.limit, self.old = tokenizer.encode, tokenizer.model.tokenize, lead, limit, {}
        self.plain = self if plain is None else plain  #: of what follows letters or a line feed
        self.marks = dict(enumerate(_byte_marks()))
        self.marked = lead.translate(self.marks)
        self.feed = self._encoded("\n")

    def _encoded(self, text: str) -> bytes:
        return pack_ids(self.encode(text, add_special_tokens=False).ids)

    def _parts(self, chunk: str) -> bytes:
        letters = _LETTERS.match(chunk)
        if letters:
            cut = letters.end()
            if cut == len(chunk):
                word = chunk
                if not chunk.isascii():
                    chunk = chunk.encode().decode("latin-1").translate(self.marks)
                return self._kept(word, pack_ids([token.id for token in self.word(self.marked + chunk)]))
            if not chunk[cut].isalpha():
                return self[chunk[:cut]] + self.plain.after(chunk[cut:])
        if "\n" in chunk:
            return self.after(chunk)
        return self._kept(chunk, self._encoded(self.lead + chunk))

    def after(self, rest: str) -> bytes:
        """The ids of a chunk, or of what follows letters in it."""
        head, feed, tail = rest.partition("\n")
        if feed and not head[-1:].isspace() and tail and not tail[0].isspace():
            return (self[head] if head else b"") + self.feed + self.plain[tail]
        return self._encoded(self.lead + rest) if feed else self[rest]

    def _kept(self, part: str, found: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(part) < 64:
            self[part] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is not None:
            return self._kept(chunk, found)
        return self._parts(chunk) if chunk else b""


class Encoder:
    def __init__(self, path: str, limit: int = Plan.chunks):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.first = _Chunks(tokenizer, "", limit)
        self.later = _Chunks(tokenizer, " ", limit, self.first)

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The uint32 ids of each text with ``end`` after them; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        found: list = [None] * len(texts)
        for places, lists in (
            (np.flatnonzero(~odd), pc.split_pattern(texts.filter(pa.array(~odd)), " ")),
            (np.flatnonzero(odd), pa.array(map(_SINGLE.split, texts.filter(pa.array(odd)).to_pylist()), pa.list_(pa.string()))),
        ):
            for place, ids in zip(places.tolist(), self._gathered(lists, end) if len(places) else ()):
                found[place] = ids
        return found

    def _gathered(self, lists: pa.ListArray, end: int) -> list[np.ndarray]:
        """Each distinct chunk is looked up once; ids are gathered by offsets."""
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum(sizes)
        openers, which = np.unique(codes[stops - sizes], return_inverse=True)
        codes[stops - sizes] = len(chunks) + 1 + which
        blobs = list(map(self.later.__getitem__, chunks))
        blobs.append(pack_ids([end]))
        blobs += [self.first[chunks[n]] for n in openers]
        codes = np.insert(codes, stops, len(chunks))
        stops += np.arange(1, len(stops) + 1)
        lengths = np.fromiter(map(len, blobs), np.int32, len(blobs)) // 4
        starts = (np.cumsum(lengths) - lengths).astype(np.int32)
        store = np.frombuffer(b"".join(blobs), "<u4")
        found, first = [], 0
        while first < len(stops):  # a bounded number of chunks at once
            begin = stops[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(stops, begin + _AT_ONCE, "right")))
            here = codes[begin : stops[last - 1]]
            each = lengths[here]
            upto = np.cumsum(each, dtype=np.int64)
            places = np.repeat((starts[here] - upto + each).astype(np.int32), each)
            places += np.arange(upto[-1], dtype=np.int32)
            found += np.split(store[places], upto[stops[first : last - 1] - begin - 1])
            first = last
        return found


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = Plan.chunks) -> Encoder:
    """One for each worker process."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]


class Tournament:
    """Winners over bins in order: each inner node holds the greatest room below it."""

    def __init__(self, bins: int, room: int):
        self.base = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.base)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``; its room shrinks."""
        best, node = self.best, 1
        while node < self.base:
            node *= 2
            if best[node] < size:
                node += 1
        found = node - self.base
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, none above ``room``."""
    tree, used = Tournament(max(1, len(sizes)), room), {}
    placed: list = [None] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        chosen = tree.take(sizes[at])
        placed[at] = (chosen, used.get(chosen, 0))
        used[chosen] = placed[at][1] + sizes[at]
    return placed


def pack_group(documents: list[np.ndarray], length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, size, bin, offset) of each piece; bins are numbered from 0 without gaps."""
    rests, bins = [], 0
    for n, ids in enumerate(documents):
        whole = len(ids) // length * length
        for start in range(0, whole, length):
            yield n, start, length, bins, 0
            bins += 1
        if whole < len(ids):
            rests.append((n, whole, len(ids) - whole))
    for (n, start, size), (chosen, offset) in zip(rests, first_fit_decreasing([r[2] for r in rests], length)):
        yield n, start, size, bins + chosen, offset


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """Pieces: key, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset."""
    seeded = F.xxhash64(F.lit(plan.seed), F.col(key))
    dealt = (
        docs.select(F.col(key), F.col(text), seeded.alias("pack_order"))
        .repartition("pack_order")
        .sortWithinPartitions("pack_order", key, text)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, plan.chunks)
        sequence = TaskContext.get().partitionId() << 40
        keys, group, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            pieces = list(pack_group(group, plan.length))
            for at in range(0, len(pieces), 1024):
                part = pieces[at : at + 1024]
                columns = [
                    pa.array([keys[p[0]] for p in part], key_type),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([group[p[0]][p[1] : p[1] + p[2]].tobytes() for p in part], pa.binary()),
                    pa.array([len(group[p[0]]) for p in part], pa.int64()),
                    pa.array([sequence + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
            sequence += 1 + max(p[3] for p in pieces)
            keys.clear(), group.clear()

        for batch in batches:
            key_type = batch.schema.field(key).type
            for rows in slices(batch, text, plan.slice_bytes):
                for name, ids in zip(rows.column(key).to_pylist(), tokens.encode(rows.column(text), plan.end_id)):
                    keys.append(name), group.append(ids)
                    held += len(ids)
                    if len(group) >= plan.group or held >= plan.group_ids:
                        yield from packed()
                        held = 0
        if group:
            yield from packed()

    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    names = schema.names
    return dealt.mapInArrow(run, schema)


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select(key, "start", "length", crc, "doc_tokens", "sequence_id", "offset")
