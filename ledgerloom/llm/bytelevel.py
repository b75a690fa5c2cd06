"""Byte-level BPE ids of whole texts, and the texts back from the ids.

Where a text is split is decided without a regular expression. Every character has
a class; a class is a function on the states of a small automaton; functions are
composed pairwise up a tree and states handed down again, so all characters of a
batch advance together. The slices between the cuts meet a cache of merged pieces,
one look a distinct slice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Text bytes that are scanned at once; cache of pieces in bytes, and the longest piece in it.
CHUNK_BYTES, CACHE_BYTES, LONGEST = 1 << 20, 1 << 26, 256
#: Ids of a block whose place in the text is kept.
BLOCK = 64

LETTER, E, L, RV, STMD, DIGIT, MARK, OTHER, SPACE, BLANK = range(10)
#: Added to the class of a text's first character; after the last text.
FIRST, DONE = 10, 20
#: States: nothing open, in letters, digits or others, a mark that may open a contraction,
#: one that waits for e or for l, one blank (a space or not), several (the last a space or not).
NONE, LETTERS, DIGITS, OTHERS, OPEN, WANTS_E, WANTS_L, ONE_SPACE, ONE_BLANK, SPACES, BLANKS = range(11)
CUT, CUT_BEFORE = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """State after a character, and whether it begins a slice or the one before it did."""
    if kind >= FIRST:
        late = CUT_BEFORE if state in (WANTS_E, WANTS_L) else 0
        after, out = (NONE, 0) if kind == DONE else _step(NONE, kind - FIRST)
        return after, out | late
    late = 0
    if state == OPEN:
        if kind in (STMD, RV, L):
            return {STMD: NONE, RV: WANTS_E, L: WANTS_L}[kind], 0
        state = OTHERS
    elif state in (WANTS_E, WANTS_L):
        if kind == (E if state == WANTS_E else L):
            return NONE, 0
        state, late = LETTERS, CUT_BEFORE
    if kind in (SPACE, BLANK):
        if state in (ONE_SPACE, ONE_BLANK, SPACES, BLANKS):
            return (SPACES if kind == SPACE else BLANKS), late
        return (ONE_SPACE if kind == SPACE else ONE_BLANK), late | CUT
    joined = state in (ONE_SPACE, SPACES)
    if state in (SPACES, BLANKS):
        late = CUT_BEFORE
    after = LETTERS if kind < DIGIT else DIGITS if kind == DIGIT else OTHERS
    if kind == MARK and not joined and state != OTHERS:
        return OPEN, late | CUT
    return after, late | (0 if joined or state == after else CUT)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """The classes' functions and all their compositions by number: compose, apply, outputs."""
    states, kinds = range(BLANKS + 1), range(DONE + 1)
    made = [tuple(_step(s, k)[0] for s in states) for k in kinds]
    known = {f: None for f in made}
    known.setdefault(tuple(states))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in made:
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = None
                todo.append(both)
    number = {f: i for i, f in enumerate(known)}
    compose = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
    out = np.array([[_step(s, k)[1] for k in kinds] for s in states], np.uint8)
    return (np.array([number[f] for f in made], np.uint16), compose, np.array(list(known), np.uint8), out,
            np.uint16(number[tuple(states)]))


def _states(kinds: np.ndarray) -> np.ndarray:
    """The state before each character: functions composed up a tree, states handed down."""
    function, compose, apply, _, same = _tables()
    compose, apply, n = compose.ravel(), apply.ravel(), len(compose)
    level, levels = function[kinds], []
    while len(level) > 1:
        if len(level) % 2:
            level = np.append(level, same)
        levels.append(level)
        level = compose[level[0::2].astype(np.int32) * n + level[1::2]]
    states = np.zeros(1, np.uint8)
    for level in reversed(levels):
        both = np.empty(len(level), np.uint8)
        states = states[:len(level) // 2]
        both[0::2] = states
        both[1::2] = apply[level[0::2].astype(np.int32) * (BLANKS + 1) + states]
        states = both
    return states[:len(kinds)]


@lru_cache(maxsize=1)
def _kind_of() -> np.ndarray:
    """Class of each code point; what is a letter, digit or blank is asked of the library."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    kind = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", BLANK)):
        asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        kept = bytes(asked.encode_ordinary(points)).decode()
        kind[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = value
    for chars, value in (("e", E), ("l", L), ("rv", RV), ("stmd", STMD), ("'", MARK), (" ", SPACE)):
        kind[[ord(c) for c in chars]] = value
    return kind


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where slices begin in the UTF-8 bytes of texts that begin at ``starts`` (none empty)."""
    kind_of = _kind_of()
    head = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[head].astype(np.int32)
    long = np.flatnonzero(point >= 0x80)
    if len(long):
        at, lead = head[long], point[long]
        tail = lambda i: data[np.minimum(at + i, len(data) - 1)].astype(np.int32) & 0x3F
        two = (lead & 0x1F) << 6 | tail(1)
        three = (lead & 0x0F) << 12 | tail(1) << 6 | tail(2)
        four = (lead & 0x07) << 18 | tail(1) << 12 | tail(2) << 6 | tail(3)
        point[long] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    kinds = np.append(kind_of[point], np.uint8(DONE))
    kinds[np.searchsorted(head, starts)] += FIRST
    out = _tables()[3].ravel()[_states(kinds).astype(np.int16) * (DONE + 1) + kinds]
    begins = (out[:-1] & CUT) > 0
    begins |= (out[1:] & CUT_BEFORE) > 0
    return head[begins]


class Pieces(dict):
    """Ids of slices by the ranks of a vocabulary; remembers a bounded number of bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The library merges the pairs of one slice; it is never given a text to split.
        self.merger = tiktoken.Encoding("slices", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.held = 0
        by_id = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece
        self.lengths = np.array([len(p) for p in by_id], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = tuple(self.merger.encode_ordinary(piece.decode()))
        if len(piece) <= LONGEST:
            self.held += 200 + len(piece) + 8 * len(ids)
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids

    def encoded(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the byte each one begins at, and the number of ids before each text, of texts in one buffer."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(starts), np.int64)
        filled = np.append(starts[1:], len(data)) > starts
        begin = cuts(data, starts[filled])
        bounds = pa.py_buffer(np.append(begin, len(data)).astype(np.int64).tobytes())
        slices = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        found = [self[p] for p in slices.dictionary.to_pylist()]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
        which = slices.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        upto = np.cumsum(counts)
        ids = flat[np.arange(upto[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - counts), counts)]
        ahead = np.append(0, upto)[np.searchsorted(begin, starts)]
        lengths = self.lengths[ids]
        return ids, np.cumsum(lengths) - lengths, ahead

    def decoded(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The bytes of ids, all put in their places at once; the blocks must begin where was noted."""
        sizes = self.lengths[ids]
        places = np.cumsum(sizes) - sizes
        if not np.array_equal(places[::BLOCK], starts - starts[:1]):
            raise ValueError("the ids do not fit their places in the text")
        return self.bytes[np.repeat(self.begins[ids] - places, sizes) + np.arange(sizes.sum())].tobytes()


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One for each file of ranks, kept while a Python worker lives."""
    return Pieces(path)


def _chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, starts) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last] - offsets[first]
        first = last


def encoded(docs: DataFrame, ranks: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, a struct of the columns in ``keep`` (all), and ``coded``, the ids of the text.

    ``coded.ids`` holds a text's ids and ``coded.starts`` the byte of the text at
    which ids 0, 64, 128 and so on begin, both as little-endian unsigned 32-bit
    integers: there are ``octet_length(coded.ids) / 4`` ids, and ``run_of`` takes
    some. ``ranks`` is the path of a file of ranks, present on every worker. A text
    is split by the rules of the vocabulary's pattern, without special tokens.

    Whole texts of any length are encoded, a batch of them in runs of bounded size.
    A null text is empty; an empty text has no ids; equal texts have equal ids and
    repeated rows stay. As the row is a struct, no column name can clash. An empty
    table gives no row.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    rows = docs.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(ranks)
        for batch in batches:
            for first, data, starts in _chunks(batch.column("text"), CHUNK_BYTES):
                ids, places, ahead = coder.encoded(data, starts)
                ids, places = ids.astype("<u4"), places.astype(np.int64)
                spans = list(zip(ahead, [*ahead[1:], len(ids)]))
                coded = pa.StructArray.from_arrays([
                    pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([(places[a:b:BLOCK] - at).astype("<u4").tobytes() for (a, b), at in zip(spans, starts)], pa.binary()),
                ], ["ids", "starts"])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, len(starts)), coded], ["row", "coded"])

    schema = T.StructType([rows.schema["row"], T.StructField("coded", T.StructType.fromDDL("ids binary, starts binary"))])
    return rows.mapInArrow(encode, schema)


def decoded(coded: Column, ranks: str) -> Column:
    """The bytes of encoded ids, or of a run of them; null and no ids give no bytes."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        coder = pieces(ranks)
        for ids, starts in batches:
            yield pa.array([
                coder.decoded(np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(s.as_buffer(), "<u4").astype(np.int64))
                for i, s in zip(ids, starts)], pa.binary())

    none = F.lit(b"")
    return decode(F.coalesce(coded["ids"], none), F.coalesce(coded["starts"], none))


def run_of(coded: Column, block: int, blocks: int = 1) -> Column:
    """``blocks`` blocks of 64 ids from a block on (0 is the first), to be decoded without the rest."""
    return F.struct(
        F.substring(coded["ids"], block * BLOCK * 4 + 1, blocks * BLOCK * 4).alias("ids"),
        F.substring(coded["starts"], block * 4 + 1, blocks * 4).alias("starts"))
