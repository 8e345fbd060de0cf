"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags the blank-separated tokens of a text as begin, inside or outside of a secret. Features are the token's
shape, the words before and after it (hashed into ``Plan.words``), the kinds of the two tokens before and the one after, and
the file's; the state before the first and after the last token is outside. It is fitted by maximum likelihood on the
driver, on windows of a bounded sample of rows (``Plan.sample``) with secrets, and things that look like them, of many
forms planted with a fixed seed. Windows in which a fixed pattern matches are not used, so no label comes from those.

Decoding is exact and cheap: if outside beats the other tags of a token by more than any transitions can make good, the
best path has outside there. So Viterbi runs only over the stretches between such tokens. Scores of a token as itself
and as a neighbour are computed once for each distinct token and kept in a bounded table.

Defined results: null counts as empty; texts of any length are scanned whole; equal spans are reported once; a span of
the field that meets a pattern's is left out; repeated rows are scanned each; an empty table gives an empty result;
other columns are ignored (``find``) or passed through, whatever their names (``redact``).
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

# The base rule.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs are maximal, so a shorter one never hides a longer one
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FIELD = "crf"

_PROFILES = 50_000  # kinds of tokens whose sums a worker keeps
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`,;:()[]{}<>"
_MARKS = _EDGE + ".!?"
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


@dataclass(frozen=True)
class Plan:
    sample: int = 3000  #: rows that the field is fitted on
    window: int = 24
    rounds: int = 120
    rate: float = 0.15
    penalty: float = 1e-3
    table: int = 300_000  #: entries of a worker's table of tokens
    words: int = 1 << 12  #: hash values of neighbouring words
    seed: int = 7
    mark: str = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    rank = {kind: n for n, kind in enumerate((*KINDS, FIELD))}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


# --- features ---------------------------------------------------------------------------------------------------------

_PREFIX = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "sk-", "pk_", "xox", "eyJ", "AIza", "-----BEGIN")
_SHAPES = (
    "any", "len8", "len12", "len16", "len24", "len40", "letters", "digits", "hex", "letter+digit", "cases+digit",
    "sign", "assigned", "keyword", "keyword+value", "entropy2", "entropy3", "entropy4", "few vowels", "prefix",
    "quoted", "address", "pem", "dashes", "inner upper",
)
_NEAR = ("keyword", "equals", "keyword+sign", "bearer", "pem", "long mix", "plain")
_SPOKEN = ("bearer", "basic", "key", "authorization", "private")
_FILE = ("file: keyword", "file: signs", "file: short")
_WIDTH = len(_SHAPES) + 3 * len(_NEAR) + len(_FILE)


def _entropy(core: str) -> float:
    n = len(core)
    return -sum(c / n * math.log2(c / n) for c in Counter(core).values()) if n else 0.0


_KEY = re.compile("|".join(_KEYWORDS))


def _is_keyword(lowered: str) -> bool:
    return len(lowered) >= 5 and _KEY.search(lowered) is not None


def shape(token: str) -> list[int]:
    """Numbers of the features in _SHAPES."""
    n = len(token)
    on = [0, *range(1, 1 + bisect_right((8, 12, 16, 24, 40), n))]
    core = token if token.isalpha() else token.strip(_MARKS)
    if core.isalpha() and n < 16:
        on.append(6)
        lowered = core.lower()
        if lowered != core and not core.istitle() and not core.isupper():
            on.append(24)
        return on + [13] * _is_keyword(lowered)
    core = token.strip(_EDGE)
    lowered = core.lower()
    key, sign, value = re.match(r"([^=:]*)([=:]?)(.*)", core, re.S).groups()
    judged = value.strip(_EDGE) if sign and value and _is_keyword(key.lower()) else core
    letters = sum(c.isalpha() for c in judged)
    digits = sum(c.isdigit() for c in judged)
    upper, lower = judged != judged.lower(), judged != judged.upper()
    entropy = _entropy(judged)
    vowels = sum(c in "aeiouAEIOU" for c in judged)
    tests = {
        6: letters == len(judged),
        7: digits > 0 and not letters,
        8: len(judged) >= 8 and digits > 0 and letters > 0 and all(c in "0123456789abcdef" for c in judged),
        9: letters > 0 and digits > 0,
        10: upper and lower and digits > 0,
        11: any(c in "+/_" for c in judged),
        12: bool(sign and value),
        13: _is_keyword(lowered),
        14: judged is not core and len(judged) >= 12,
        15: entropy >= 2.5,
        16: entropy >= 3.2,
        17: entropy >= 3.8,
        18: letters >= 8 and vowels < 0.22 * letters,
        19: judged.startswith(_PREFIX),
        20: n >= 2 and token[0] in "\"'" and token.rstrip(",;)")[-1:] in "\"'",
        21: "@" in core or "://" in core or core.startswith("www."),
        22: "-----" in core,
        23: core.count("-") >= 2 or core.count(".") >= 2,
        24: judged[1:] != judged[1:].lower() and judged != judged.upper(),
    }
    return on + [number for number, yes in tests.items() if yes]


def near(token: str) -> list[int]:
    """Numbers of the features in _NEAR."""
    lowered = token.lower()
    core = lowered if lowered.isalpha() else lowered.strip(_MARKS)
    keyword = _is_keyword(lowered)
    if core.isalpha() and len(core) < 32 and not keyword and core not in _SPOKEN and lowered[-1] not in ":=":
        return [len(_NEAR) - 1]
    tests = (
        keyword,
        token in ("=", ":", ":=", "=>"),
        keyword and lowered[-1] in ":=",
        lowered.strip(_EDGE) in _SPOKEN[:4],
        "-----" in token or token == "PRIVATE" or token.startswith("KEY-"),
        len(token) >= 32 and not token.isalpha(),
        token.isalpha(),
    )
    return [number for number, yes in enumerate(tests) if yes]


def file_features(text: str) -> list[int]:
    lowered = text.lower()
    signs = sum(text.count(c) for c in "={};")
    return [n for n, yes in enumerate((_is_keyword(lowered), signs * 100 > len(text), len(text) < 400)) if yes]


def bucket(token: str, plan: Plan) -> int:
    """The hash value of a word; 0 of all that is no word."""
    core = token if token.isalpha() else token.strip(_MARKS + "=")
    return 1 + zlib.crc32(core.lower().encode()) % (plan.words - 1) if core.isalpha() and len(core) < 32 else 0


# --- the field --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  #: features × tags
    moves: np.ndarray  #: tag before × tag
    words: np.ndarray  #: (before, after) × hash values and none × tags

    @property
    def slack(self) -> float:
        """The most that transitions can gain by a tag other than outside at one token."""
        m = self.moves
        return max(
            m[p, k] - m[p, OUTSIDE] + m[k, n] - m[OUTSIDE, n] for p in range(3) for n in range(3) for k in (BEGIN, INSIDE)
        )

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights of shape, the token before, two before, after, and the file."""
        ends = np.cumsum([len(_SHAPES), len(_NEAR), len(_NEAR), len(_NEAR)])
        return tuple(np.split(self.weights, ends))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of a stretch between outside tags."""
    best, back = moves[OUTSIDE] + scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    tag = int((best + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return np.array(tags[::-1])


def _expectations(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of tags, expected transitions (the outer ones included) and log Z, of sequences × tokens × tags.

    Forward and backward sums of products, scaled to 1 at each token.
    """
    length = scores.shape[1]
    top = scores.max(axis=2, keepdims=True)
    own, step = np.exp(scores - top), np.exp(moves)
    ahead, behind, scale = np.empty_like(own), np.empty_like(own), np.empty(own.shape[:2])
    for t in range(length):
        now = own[:, t] * (ahead[:, t - 1] @ step if t else step[OUTSIDE])
        scale[:, t] = now.sum(axis=1)
        ahead[:, t] = now / scale[:, t, None]
    behind[:, -1] = step[:, OUTSIDE]
    for t in range(length - 1, 0, -1):
        behind[:, t - 1] = (own[:, t] * behind[:, t]) @ step.T / scale[:, t, None]
    tags = ahead * behind
    ends = tags[:, 0].sum(axis=1)  # the same at every token
    tags /= ends[:, None, None]
    into = own[:, 1:] * behind[:, 1:] / (scale[:, 1:] * ends[:, None])[:, :, None]
    pairs = np.einsum("ntp,ntk->pk", ahead[:, :-1], into) * step
    pairs[OUTSIDE] += tags[:, 0].sum(axis=0)
    pairs[:, OUTSIDE] += tags[:, -1].sum(axis=0)
    return tags, pairs, float(np.log(scale).sum() + top.sum() + np.log(ends).sum())


def _planted(rng: random.Random) -> tuple[list[str], list[int]]:
    """Tokens with a secret, or something that looks like one, and their tags."""
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, n: "".join(rng.choices(chars, k=n))
    kinds = [
        lambda: draw(hexes, rng.choice((20, 32, 40, 64))),
        lambda: draw(letters, rng.randint(20, 44)),
        lambda: draw(letters + "+/", rng.choice((24, 40, 44))) + "=" * rng.randint(0, 2),
        lambda: "AKIA" + draw(letters.upper(), 16),
        lambda: "ghp_" + draw(letters, 36),
        lambda: "sk_live_" + draw(letters, 24),
        lambda: "eyJ" + ".".join(draw(letters + "_-", k) for k in (20, 40, 30)),
    ]
    value, form = rng.choice(kinds)(), rng.randrange(12)
    key = rng.choice(("password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Secret"))
    quote = rng.choice(("", '"', "'"))
    if form < 3:
        return [f"{quote}{value}{quote}"], [BEGIN]
    if form < 5:
        return [key, rng.choice("=:"), f"{quote}{value}{quote}"], [OUTSIDE, OUTSIDE, BEGIN]
    if form == 5:
        return [f"{key}{rng.choice('=:')}{quote}{value}{quote}"], [BEGIN]
    if form == 6:
        return [key + rng.choice("=:"), value], [OUTSIDE, BEGIN]
    if form == 7:
        return ["Authorization:", "Bearer", value], [OUTSIDE, OUTSIDE, BEGIN]
    if form == 8:
        body = [draw(letters + "+/", 64) for _ in range(rng.randint(1, 3))]
        tokens = ["-----BEGIN", "PRIVATE", "KEY-----", *body, "-----END", "PRIVATE", "KEY-----"]
        return tokens, [BEGIN, *[INSIDE] * (len(tokens) - 1)]
    lower, digits = letters[26:52], "0123456789"
    word = lambda a, b: draw(lower, rng.randint(a, b))
    user = rng.choice([word(3, 9), f"{word(2, 7)}.{word(3, 9)}", f"{word(4, 10)}{rng.randint(1, 9999)}", f"{word(3, 6)}_{word(3, 6)}{draw(digits, 2)}", f"{word(3, 6)}+{word(3, 5)}"])
    end = rng.choice(["com", "org", "net", "example", "test", "io", "de", "co.uk"])
    harmless = [
        draw(digits, rng.randint(4, 16)),
        f"+{rng.randint(1, 99)}-{draw(digits, 3)}-{draw(digits, rng.randint(4, 7))}",
        f"({draw(digits, 3)})",
        f"{draw(digits, 3)}-{draw(digits, rng.choice((2, 4)))}-{draw(digits, 4)}",
        ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        f"{user}@{word(4, 10)}.{end}",
        f"{user}@{word(3, 6)}.{word(4, 8)}.{end}{rng.choice(['', '.', ',', ';'])}",
        f"{user}@{word(3, 6)}{rng.randint(1, 99)}.{word(4, 8)}.{end}",
        f"https://www.{word(4, 9)}.{end}/{word(4, 9)}/{rng.randint(1, 9999)}?{word(1, 4)}={rng.randint(1, 99)}",
        f"http://{word(4, 9)}.{end}/{word(3, 8)}-{word(3, 8)}.html",
        f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}",
        f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{draw(digits, 2)}:{draw(digits, 2)}",
        draw("abcdefghijklmnoprstu", rng.randint(16, 28)),
        word(3, 8) * rng.randint(2, 5),
        f"{word(2, 8)}{rng.choice('#*$%&|<>.-_')}{rng.choice('#*$%&|<>.-_') * rng.randint(2, 12)}",
        f"/{word(3, 7)}/{word(3, 9)}/{word(3, 9)}.{rng.choice(['py', 'txt', 'conf'])}",
        f"{word(3, 8)}_{word(3, 8)}_{word(2, 6)}({word(1, 4)})",
        word(4, 8) + word(3, 8).title() + word(3, 8).title() + rng.choice(["", str(rng.randint(1, 99))]),
        f"{word(2, 4).upper()}-{draw(digits, 4)}-{draw(digits, 4)}",
        f"{key}s",
    ]
    return [rng.choice(harmless)], [OUTSIDE]


def _row(features: np.ndarray, tokens: list[str], t: int, file: list[int]) -> None:
    features[shape(tokens[t])] = 1
    start = len(_SHAPES)
    for step in (-1, -2, 1):
        if 0 <= t + step < len(tokens):
            features[[start + n for n in near(tokens[t + step])]] = 1
        start += len(_NEAR)
    features[[start + n for n in file]] = 1


def fit(windows: list[tuple[list[str], list[int]]], plan: Plan = Plan()) -> Field:
    """windows: tokens and file features, all outside of secrets. Two of three get something planted."""
    rng = random.Random(plan.seed)
    x = np.zeros((len(windows), plan.window, _WIDTH), np.float32)
    y = np.zeros((len(windows), plan.window), np.int64)
    none = plan.words  # of a neighbour that isn't there
    near_ = np.full((2, len(windows), plan.window), none)
    for n, (tokens, file) in enumerate(windows):
        tokens = (tokens * plan.window)[: plan.window] if tokens else ["a"] * plan.window
        tags = [OUTSIDE] * plan.window
        if n % 3:
            fresh, fresh_tags = _planted(rng)
            at = rng.randint(0, plan.window - 1)
            tokens = (tokens[:at] + fresh + tokens[at:])[: plan.window]
            tags = (tags[:at] + fresh_tags + tags[at:])[: plan.window]
        y[n] = tags
        buckets = [bucket(t, plan) for t in tokens]
        near_[0, n, 1:], near_[1, n, :-1] = buckets[:-1], buckets[1:]
        for t in range(plan.window):
            _row(x[n, t], tokens, t, file)
    onehot = np.eye(3)[y]
    seen = np.einsum("ntf,ntk->fk", x, onehot)
    seen_moves = np.zeros((3, 3))
    bounded = np.pad(y, ((0, 0), (1, 1)))
    np.add.at(seen_moves, (bounded[:, :-1].ravel(), bounded[:, 1:].ravel()), 1)
    params = [np.zeros((_WIDTH, 3)), np.zeros((3, 3)), np.zeros((2, plan.words + 1, 3))]
    slopes = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    flat = x.reshape(-1, _WIDTH)
    sides = near_.reshape(2, -1)
    for step in range(1, plan.rounds + 1):
        scores = flat @ params[0] + params[2][0][sides[0]] + params[2][1][sides[1]]
        tags, moves, _ = _expectations(scores.reshape(*y.shape, 3), params[1])
        left = (onehot - tags).reshape(-1, 3)
        of_words = np.stack([np.stack([np.bincount(side, left[:, k], none + 1) for k in range(3)], axis=1) for side in sides])
        of_words[:, none] = 0
        for p, s, grad in zip(params, slopes, (seen - flat.T @ tags.reshape(-1, 3), seen_moves - moves, of_words)):
            grad = grad / len(windows) - plan.penalty * p
            s[0], s[1] = 0.9 * s[0] + 0.1 * grad, 0.99 * s[1] + 0.01 * grad**2
            p += plan.rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


class Tagger:
    """Scores tokens by a bounded table and decodes texts."""

    def __init__(self, field: Field, plan: Plan):
        self.field, self.plan = field, plan
        self.shape, self.before, self.before2, self.after, self.file = field.parts()
        self.slack = field.slack
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[str, int] = {}  # short tokens; bounded in entries and so in bytes
        self.profiles: dict[tuple, int] = {}  # tokens with the same features share a profile
        self.shared: list[np.ndarray] = []
        self.rows, self.used = np.zeros((1 << 14, 12), np.float32), 0
        self.fresh: tuple[list[int], list[int]] = ([], [])  # profiles and hash values of tokens without a row

    def _number(self, token: str) -> int:
        own, beside = shape(token), near(token)
        profile = (*own, -1, *beside)
        shared = self.profiles.get(profile)
        if shared is None:
            shared = self.profiles[profile] = len(self.shared)
            parts = (self.shape[own], self.before[beside], self.before2[beside], self.after[beside])
            self.shared.append(np.concatenate([p.sum(axis=0) for p in parts]))
        self.fresh[0].append(shared)
        self.fresh[1].append(bucket(token, self.plan))
        number = self.used + len(self.fresh[0]) - 1
        if len(token) < 64:
            self.numbers[token] = number
        return number

    def _fill(self) -> None:
        """Rows of the tokens that are new."""
        shared, hashed = map(np.array, self.fresh)
        if not len(shared):
            return
        end = self.used + len(shared)
        if end > len(self.rows):
            more = np.zeros((max(len(self.rows), end - len(self.rows)), 12), np.float32)
            self.rows = np.concatenate([self.rows, more])
        rows = np.array(self.shared)[shared]
        rows[:, 3:6] += self.field.words[0, hashed]
        rows[:, 9:12] += self.field.words[1, hashed]
        self.rows[self.used : end] = rows
        self.used, self.fresh = end, ([], [])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the secrets of each text, in code points."""
        if self.used > self.plan.table or len(self.shared) > _PROFILES:
            self._empty()
        get, new = self.numbers.get, self._number
        pieces = [text.split() for text in texts]
        pad = new("") if get("") is None else get("")
        numbers = []
        for tokens in pieces:  # two pads between texts: no neighbours
            found = list(map(get, tokens))
            if None in found:
                found = [new(t) if (n := get(t)) is None else n for t in tokens]
            numbers += found
            numbers += (pad, pad)
        self._fill()
        ids = np.array(numbers, np.int64)
        lengths = np.array([len(tokens) for tokens in pieces])
        starts = np.cumsum(lengths + 2) - lengths - 2
        real = np.ones(len(ids), bool)
        real[starts + lengths] = real[starts + lengths + 1] = False
        rows = self.rows[ids].astype(float)
        rows[~real, 3:] = 0
        scores = rows[:, :3].copy()
        scores[1:] += rows[:-1, 3:6]
        scores[2:] += rows[:-2, 6:9]
        scores[:-1] += rows[1:, 9:12]
        scores += np.repeat([self.file[file_features(t)].sum(axis=0) for t in texts], lengths + 2, axis=0)
        unsure = np.flatnonzero((scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) <= self.slack) & real)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        tagged: dict[int, list[tuple[int, int]]] = {}
        for run in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1) if len(unsure) else ():
            tags = viterbi(scores[run], self.field.moves)
            owner = int(np.searchsorted(starts, run[0], "right")) - 1
            open_ = False
            for t, tag in zip(run - starts[owner], tags):
                if tag == INSIDE and open_:
                    tagged[owner][-1] = (tagged[owner][-1][0], int(t))
                elif tag != OUTSIDE:
                    tagged.setdefault(owner, []).append((int(t), int(t)))
                open_ = tag != OUTSIDE
        for owner, runs in tagged.items():
            places = [m.span() for m in _TOKEN.finditer(texts[owner])]
            for first, last in runs:
                span = _trimmed(texts[owner], places[first][0], places[last][1])
                if span:
                    out[owner].append(span)
        return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Without quotes and brackets at its ends, and without a keyword before it."""
    key, sign, value = re.match(r"([^=:\s]*)([=:]?)(.*)", text[start:end], re.S).groups()
    if sign and value and _is_keyword(key.lower()):
        start += len(key) + 1
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE + ".":
        end -= 1
    return (start, end) if end - start >= 8 else None


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    found = []
    for text, extra in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        free = {(a, b) for a, b in extra if not any(s < b and a < e for _, s, e in base)}
        found.append(ordered(base + [(FIELD, a, b) for a, b in free]))
    return found


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> Field:
    """Fit on windows of about ``plan.sample`` rows that a hash chooses; the order of rows has no influence. A window has
    a bounded number of tokens, of which the driver gets 200 characters at most."""
    total = docs.count()
    chosen = docs.select(F.xxhash64(F.lit(plan.seed), F.col(key), F.col(text)).alias("draw"), F.col(text).alias("text"))
    every = max(1, total // plan.sample)
    chosen = chosen.filter(F.pmod("draw", F.lit(every)) == 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, tokens, files = [], [], []
            for draw, value in zip(batch.column("draw").to_pylist(), batch.column("text").to_pylist()):
                words = (value or "").split()
                at = max(0, min(draw % max(1, len(words)), len(words) - plan.window))
                cut_ = [w[:200] for w in words[at : at + plan.window]]
                if words and not base_spans(" ".join(words[max(0, at - 2) : at + plan.window + 2])):
                    draws.append(draw), tokens.append(cut_), files.append(file_features(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(draws, pa.int64()), pa.array(tokens, pa.list_(pa.string())), pa.array(files, pa.list_(pa.int32()))],
                ["draw", "tokens", "file"],
            )

    rows = chosen.mapInArrow(cut, "draw long, tokens array<string>, file array<int>")
    rows = rows.orderBy("draw", "tokens").limit(2 * plan.sample).collect()  # bounded by the parameter
    windows = [(list(r.tokens), list(r.file)) for r in rows]
    while len(windows) < 400:  # for tiny tables: planted examples in plain words
        windows.append((["the", "word", "of", "another", "file", "is", "here"], []))
    return fit(windows, plan)


def find(
    docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan(), field: Field | None = None
) -> DataFrame:
    """key, spans: array of (kind, start, end), in code points, by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, key, text, plan))  # a few hundred weights
    chosen = docs.select(key, text)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value, plan)
        for batch in batches:
            for rows in slices(batch, text):
                texts = [t or "" for t in rows.column(text).to_pylist()]
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in found] for found in all_spans(texts, tagger)]
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(spans, arrow)], [key, "spans"])

    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    return chosen.mapInArrow(run, T.StructType([chosen.schema[key], T.StructField("spans", T.ArrayType(span))]))


def redact(
    docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", plan: Plan = Plan(), field=None
) -> DataFrame:
    """The documents with ``plan.mark`` in place of each secret, and ``chars``, if there, counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, key, text, plan))

    def cleaned(value: str, spans: list[tuple[str, int, int]]) -> str:
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [value[at:start], plan.mark]
            at = max(at, end)
        return "".join([*parts, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value, plan)
        for batch in batches:
            for rows in slices(batch, text):
                values = rows.column(text).to_pylist()
                spans = all_spans([v or "" for v in values], tagger)
                fresh = [cleaned(v, s) if s else v for v, s in zip(values, spans)]
                columns = dict(zip(rows.schema.names, rows.columns))
                columns[text] = pa.array(fresh, rows.schema.field(text).type)
                if chars in columns:
                    counts = [len(f) if s else c for f, s, c in zip(fresh, spans, columns[chars].to_pylist())]
                    columns[chars] = pa.array(counts, rows.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), rows.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, a checksum of the fixed patterns' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS LONG) AS n_{kind}") for kind in KINDS]
    return found.select(key, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
