"""Quality rules: text statistics and bands of zstandard compression ratios.

A text compresses to a share of its UTF-8 bytes. Repetition makes that share tiny, random junk makes it large, tables and
sign-studded words move it too, and all depends on length, so each length has a band of its own. ``fit`` sets them from the
corpus: of all texts that pass the base rule, the median ratio of each tier of lengths and the median distance from it,
so the bands follow prose whatever share of junk there is below a half. The whole text must lie in the band of its length, and its
fixed chunks, the last partial one included, each in the band of theirs: chunks that leave it may hold at most
``Bands.bad_chunks`` of the text's bytes, which finds a text that is half junk.

Defined results: a null or empty text has no words and fails the base rule; texts of any length are compressed whole;
equal rows get equal verdicts; an empty table gives an empty result; other columns are ignored (``judge``) or passed
through unchanged, whatever their names (``keep``).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.llm.common import per_slice

_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
VERDICT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("ratio", pa.float64()),
        ("bad_chunks", pa.int64()),
        ("n_chunks", pa.int64()),
        ("kept", pa.bool_()),
    ]
)


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes from which it holds, least ratio, greatest ratio), ascending, for texts and for chunks.

    Those given here hold for tiers with too few texts to fit them: the 0.1 % quantile less 0.05 and the 99.9 % quantile
    plus 0.02 of the ratios of prose in four languages.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (64, 0.670, 1.160),
        (128, 0.623, 0.904),
        (192, 0.579, 0.825),
        (256, 0.476, 0.801),
        (320, 0.467, 0.766),
        (384, 0.470, 0.746),
        (512, 0.448, 0.715),
        (640, 0.435, 0.690),
        (768, 0.416, 0.661),
        (1024, 0.391, 0.612),
        (1536, 0.368, 0.578),
        (2048, 0.356, 0.563),
        (3072, 0.341, 0.534),
        (4096, 0.326, 0.517),
        (6144, 0.320, 0.495),
        (8192, 0.312, 0.483),
        (16384, 0.292, 0.460),
        (32768, 0.290, 0.453),
        (65536, 0.284, 0.428),
    )
    chunk_bytes: int = 4096
    bad_chunks: float = 0.34
    level: int = 3

    below: float = 3.5  #: a fitted band reaches so many deviations below the median
    above: float = 4.5
    least: int = 300  #: texts that a tier is fitted on, at least
    tiers: int = 4  #: to an octave of lengths

    @cached_property
    def _starts(self) -> list[int]:
        return [tier[0] for tier in self.limits]

    def hold(self, size: int, ratio: float) -> bool:
        _, low, high = self.limits[bisect_right(self._starts, size) - 1]
        return low <= ratio <= high

    def tier(self, size: int) -> int:
        return int(math.log2(size) * self.tiers) if size else 0

    def fitted(self, cells: dict[tuple[int, int], int]) -> Bands:
        """With bands from counts of texts by (tier, thousandths of the ratio)."""
        found = []
        for tier in range(max((t for t, _ in cells), default=-1) + 2):
            start = math.ceil(2 ** (tier / self.tiers)) if tier else 0
            own = sorted((cell, n) for (t, cell), n in cells.items() if t == tier)
            low, high = self.limits[bisect_right(self._starts, start) - 1][1:]
            if sum(n for _, n in own) >= self.least:
                middle = _median(own)
                spread = 1.4826 * max(1.0, _median(sorted((abs(cell - middle), n) for cell, n in own)))
                low, high = (middle - self.below * spread) / 1000, (middle + self.above * spread) / 1000
            found.append((start, low, high))
        beyond = [tier for tier in self.limits if tier[0] > found[-1][0]]
        return replace(self, limits=(*found, *beyond))


def _median(counted: list[tuple[float, int]]) -> float:
    """Of values with counts, ascending: the least that half of them don't exceed."""
    half, total = sum(n for _, n in counted) / 2, 0
    for value, n in counted:
        total += n
        if total >= half:
            return value
    raise ValueError("no values")


def measure(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """The values of VERDICT for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _SPACE)
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    failed = base_failed(n_words, n_repeat)
    ratio = len(packer.compress(raw)) / len(raw) if raw else 0.0
    bad = chunks = bad_bytes = 0
    for at in range(0, len(raw), bands.chunk_bytes):
        chunk = raw[at : at + bands.chunk_bytes]
        share = ratio if len(chunk) == len(raw) else len(packer.compress(chunk)) / len(chunk)
        chunks += 1
        if not bands.hold(len(chunk), share):
            bad += 1
            bad_bytes += len(chunk)
    kept = not failed and bands.hold(len(raw), ratio) and bad_bytes <= bands.bad_chunks * len(raw)
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, ratio, bad, chunks, kept


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def repeated_words(words: list) -> int:
    """How many words stand in a window of three words that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, upto)
            upto = at + 3
    return covered


def _verdicts(batch: pa.RecordBatch, text: str, bands: Bands) -> pa.RecordBatch:
    packer = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
    rows = [measure(value, bands, packer) for value in batch.column(text).to_pylist()]
    columns = zip(*rows) if rows else [[] for _ in VERDICT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, VERDICT)], schema=VERDICT)


def fit(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> Bands:
    """Bands from every text that passes the base rule. Their counts are cells of tiers and thousandths, bounded in number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, cells = zstandard.ZstdCompressor(level=bands.level, write_checksum=False), Counter()
        for batch in batches:
            for value in batch.column(0):
                raw = (value.as_py() or "").encode()
                words = raw.split()
                if not base_failed(len(words), repeated_words(words)):
                    cells[bands.tier(len(raw)), int(1000 * len(packer.compress(raw)) / len(raw))] += 1
        columns = [pa.array(c, pa.int64()) for c in ([t for t, _ in cells], [c for _, c in cells], list(cells.values()))]
        yield pa.RecordBatch.from_arrays(columns, ["tier", "cell", "n"])

    sums = docs.select(text).mapInArrow(run, "tier long, cell long, n long").groupBy("tier", "cell").agg(F.sum("n").alias("n"))
    return bands.fitted({(r["tier"], r["cell"]): r["n"] for r in sums.collect()})


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row per document: its key and VERDICT. Without ``bands`` they are fitted to the documents."""
    bands = fit(docs, text) if bands is None else bands

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _verdicts(batch, text, bands)
        return pa.RecordBatch.from_arrays([batch.column(key), *found.columns], [key, *found.schema.names])

    chosen = docs.select(key, text)
    schema = chosen.select(key).schema
    for field in from_arrow_schema(VERDICT):
        schema.add(field)
    return chosen.mapInArrow(per_slice(run, text), schema)


def keep(docs: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    bands = fit(docs, text) if bands is None else bands

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(_verdicts(batch, text, bands).column("kept"))

    return docs.mapInArrow(per_slice(run, text), docs.schema)
