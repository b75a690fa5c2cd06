"""Token ids in Re-Pair compressed shards with random access."""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ledgerloom.llm.shared import shared_folder

END_ID = 2
#: Text bytes of a shard, about; least count of a pair.
SHARD_BYTES, LEAST = 1 << 21, 4
#: Shards' worth of text that is cut into pieces together: a piece is looked up once for all its places in it.
TOGETHER = 2
#: Pairs of a round that are looked at together before they are chosen one by one.
ROW = 1 << 11


#: Blanks to str.split that the tokenizer takes for characters.
ODD = re.compile("[\x1c-\x1f]")
#: What a tokenizer must do before the merges for its texts to be cut into pieces here, and that cut
#: where a text holds nothing but ``PLAIN`` signs: their small letters are one to one, composed already.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
SIGNS = "".join(map(chr, [*range(0x1C), *range(0x20, 0x7F), *range(0xA1, 0xAA), *range(0xAB, 0xB2), 0xB4, 0xB6, 0xB7, 0xB8,
                          0xBB, *range(0xBF, 0x100)])) + "\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac"
PLAIN = re.compile(f"[{re.escape(SIGNS)}]*")
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PIECE = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{LETTERS}0-9\t-\r ]+")


END = np.array([END_ID], "<i4").tobytes()


def gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of those that lie in ``flat`` one after the other, and where each ends."""
    count = size[which]
    upto = np.cumsum(count)
    first = np.cumsum(size) - size
    places = np.repeat(first[which] - upto + count, count)
    places += np.arange(len(places))
    return flat[places], upto


class WordIds(dict):
    """Ids of each piece of text, remembered for a bounded number.

    The tokenizer drops white space and no token crosses it, so a text's ids are
    those of its stretches without blanks in order. Plain signs are made small and
    cut into the tokenizer's pieces here, and only the merges of a piece not met
    before are left to the library's model; any other stretch goes through the whole
    tokenizer. So does one that holds a special token, which is matched as it is written.
    """

    #: Pieces remembered: when a half is full, the half before it is forgotten.
    LIMIT = 1 << 19
    #: Longer pieces are not remembered, so the memory held is bounded.
    LONGEST = 256

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given each core its task
        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")
        made = json.loads(self.tokenizer.to_str())
        self.cuts = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
        self.merges = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in SIGNS}
        self.before: dict[str, bytes] = {}
        # pieces of plain texts, their ids one after the other, and how many each has
        self.known = pa.array([], pa.large_string())
        self.flat, self.size = np.empty(0, np.int32), np.empty(0, np.int64)

    def _plain(self, text: str) -> bool:
        return self.cuts and PLAIN.fullmatch(text) is not None and not self.special.search(text)

    def __missing__(self, part: str) -> bytes:
        made = self.before.get(part)
        if made is None:
            if self._plain(part):
                made = array("i", [t.id for t in self.merges(part.translate(self.bytes))]).tobytes()
            else:
                made = array("i", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(part) <= self.LONGEST:
            if 2 * len(self) >= self.LIMIT:
                self.before = dict(self)
                self.clear()
            self[part] = made
        return made

    def _parts(self, text: str | None) -> list[str]:
        """Pieces of plain signs, and stretches that are not plain as they are."""
        if not text or ODD.search(text):
            return [text] if text else []
        if self._plain(text):
            return PIECE.findall(text.lower())
        parts = []
        for word in text.split():
            parts += PIECE.findall(word.lower()) if self._plain(word) else [word]
        return parts

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, and how many each has."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        made = [[t.id for t in self.merges(p if p.isascii() and p.isalpha() else p.translate(self.bytes))]
                for p in new.to_numpy(zero_copy_only=False).tolist()]
        size = np.concatenate([self.size, np.fromiter(map(len, made), np.int64, len(made))])
        flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(made), np.int32)])
        which = at.to_numpy(zero_copy_only=False) if at.null_count == 0 else pc.fill_null(at, 0).to_numpy()
        which = which.astype(np.int64)
        which[pc.is_null(at).to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(size))
        found, _ = gathered(flat, size, which)
        # what is remembered: all, or where that is too much the pieces of these texts
        full = len(size) > self.LIMIT
        text = pieces if full else pa.concat_arrays([self.known, new])
        kept = pc.less_equal(pc.utf8_length(text), self.LONGEST)
        if full:
            flat, size = found, size[which]
        if not pc.all(kept).as_py():
            stay = np.flatnonzero(kept.to_numpy(zero_copy_only=False))
            flat, size, text = gathered(flat, size, stay)[0], size[stay], text.filter(kept)
        if full or len(new):
            self.known, self.flat, self.size = text, flat, size
        return found, np.diff(_, prepend=0)

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        made: list[np.ndarray | None] = [None] * len(texts)
        plain = [n for n, t in enumerate(texts) if t and self._plain(t)]
        for n in set(range(len(texts))).difference(plain):
            made[n] = np.frombuffer(b"".join(map(self.__getitem__, self._parts(texts[n]))) + END, "<i4")
        if not plain:
            return made
        # each stretch is cut into pieces once for all its places in these texts; one of letters alone is a piece
        split = pc.ascii_split_whitespace(pa.array([texts[n].lower() for n in plain], pa.large_string()))
        stretches = split.flatten().dictionary_encode()
        whole = pc.utf8_is_alpha(stretches.dictionary)
        mixed = stretches.dictionary.filter(pc.invert(whole))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(mixed, PIECE.pattern, r"\0 "))
        pieces = pa.concat_arrays([stretches.dictionary.filter(whole), cut.flatten()]).dictionary_encode()
        whole = whole.to_numpy(zero_copy_only=False)
        place = np.where(whole, np.cumsum(whole), whole.sum() + np.cumsum(~whole)) - 1
        count = np.r_[np.ones(whole.sum(), np.int64), cut.value_lengths().to_numpy()]
        flat, size = self._pieces(pieces.dictionary)
        flat, upto = gathered(flat, size, pieces.indices.to_numpy())
        size = np.diff(np.r_[0, upto][np.r_[0, np.cumsum(count)]])
        ends = np.cumsum(split.value_lengths().to_numpy())
        which = np.insert(place[stretches.indices.to_numpy()], ends, len(size))
        ids, upto = gathered(np.r_[flat, np.int32(END_ID)], np.r_[size, 1], which)
        for n, part in zip(plain, np.split(ids, upto[ends + np.arange(len(plain))][:-1])):
            made[n] = part
        return made


#: One for each tokenizer file, kept while a Python worker lives.
_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def by_pair(left: np.ndarray, right: np.ndarray, near: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols below ``2 ** width`` as numbers in ascending order, and the ascending places of each."""
    keys = left.astype(np.int64)
    keys <<= width
    keys |= right
    places = int(near[-1]).bit_length() if len(near) else 0
    if 2 * width + places < 64:  # one number holds both: sorting it is faster than sorting by it
        keys <<= places
        keys |= near
        keys.sort()
        near = keys & ((1 << places) - 1)
        keys >>= places
        return keys, near
    order = np.argsort(keys, kind="stable")
    return keys[order], near[order]


def compressed(ids: np.ndarray, least: int = LEAST, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols) and the sequence that expands to ``ids``.

    Symbols from ``base`` (the highest id and one) on are rules, in order; a rule
    holds earlier symbols only. Each round replaces, all at once, the pairs seen at
    least ``least`` times, the most frequent first, as long as no symbol that ends
    one begins another, so that no two occurrences overlap; in a run of one symbol
    every second place counts. Pairs never hold the end id, so no rule crosses a
    document. It ends when no pair is left that is seen so often, or after ``rounds``.

    A pair of older symbols is never seen more often than before, so a round looks
    only at places of pairs that were frequent, or that hold a symbol of the round
    before. Until the end, ids are numbered in order without gaps, so that a pair and
    its place fit one number: pairs are counted by sorting these, which gives their
    places too.
    """
    base = int(ids.max(initial=0)) + 1
    own = np.flatnonzero(np.bincount(ids, minlength=base))
    number = np.full(base, -1, np.int32)
    number[own] = np.arange(len(own), dtype=np.int32)
    sequence = number[ids]
    end = number[END_ID] if END_ID < base else -1
    rules: list[np.ndarray] = []
    symbols = len(own)
    live = np.ones(max(len(sequence) - 1, 0), bool)
    for _ in itertools.count() if rounds is None else range(rounds):
        ordinary = sequence != end
        near = np.flatnonzero(live & ordinary[:-1] & ordinary[1:])
        width = symbols.bit_length()
        keys, near = by_pair(sequence[near], sequence[1:][near], near, width)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        counts = np.diff(first, append=len(keys))
        often = counts >= least
        near, first, counts = near[np.repeat(often, counts)], first[often], counts[often]
        if not len(first):
            break
        found = keys[first]
        most = np.argsort(-counts, kind="stable")
        # a symbol begins pairs or ends them in this round, as its best pair has it
        known = bytearray(symbols)
        role = np.frombuffer(known, np.int8)
        chosen = []
        # roles stay once given: what they decide of the next pairs needs no look at each
        for at in range(0, len(most), ROW):
            which = most[at : at + ROW]
            a, b = found[which] >> width, found[which] & ((1 << width) - 1)
            begin, finish = role[a], role[b]
            open_ = np.where(a == b, begin == 0, (begin <= 1) & ((finish == 0) | (finish == 2)))
            done = open_ & (begin == 1) & (finish == 2)
            chosen.append(which[done])
            open_ &= ~done
            taken = []
            for x, y, n in zip(a[open_].tolist(), b[open_].tolist(), which[open_].tolist()):
                if x != y and known[x] in (0, 1) and known[y] in (0, 2):
                    known[x], known[y] = 1, 2
                    taken.append(n)
                elif x == y and not known[x]:
                    known[x] = 3
                    taken.append(n)
            chosen.append(np.array(taken, np.int64))
        which = np.sort(np.concatenate(chosen))
        pairs = np.stack([found[which] >> width, found[which] & ((1 << width) - 1)], axis=1)
        hit, _ = gathered(near, counts, which)
        made = np.repeat(np.arange(len(which)), counts[which])
        same = np.flatnonzero((pairs[:, 0] == pairs[:, 1])[made])
        if len(same):  # every second place of a run
            places = hit[same]
            run = np.r_[0, np.cumsum(np.diff(places) != 1)]
            odd = same[(places - places[np.searchsorted(run, run)]) % 2 == 1]
            hit, made = np.delete(hit, odd), np.delete(made, odd)
        sequence[hit] = symbols + made
        live = np.zeros(len(sequence), bool)
        live[near] = True
        kept = np.ones(len(sequence), bool)
        kept[hit + 1] = False
        sequence, live = sequence[kept], live[kept][:-1]
        new = sequence >= symbols
        live |= new[:-1] | new[1:]
        rules.append(pairs)
        symbols += len(pairs)
    # symbols by the numbers that they have outside: ids, and rules from the base on
    names = np.r_[own, base + np.arange(symbols - len(own))]
    return names[np.concatenate(rules)] if rules else np.empty((0, 2), np.int64), names.astype(np.int32)[sequence]


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to: rules of known symbols first, then those that hold them."""
    made = np.zeros(base + len(rules), np.int64)
    made[:base] = 1
    left = np.arange(len(rules))
    while len(left):
        a, b = made[rules[left, 0]], made[rules[left, 1]]
        known = (a > 0) & (b > 0)
        made[base + left[known]] = (a + b)[known]
        left = left[~known]
    return made[base:]


def expanded(symbols: np.ndarray, rules: np.ndarray, base: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids of some symbols: rules are opened level by level, each in its place of the result.

    ``sizes``: how many ids each rule expands to, where that is known.
    """
    size = np.ones(base + len(rules), np.int64)
    size[base:] = lengths(rules, base) if sizes is None else sizes
    ends = np.cumsum(size[symbols])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    at = ends - size[symbols]
    while len(symbols):
        open_ = symbols >= base
        out[at[~open_]] = symbols[~open_]
        pairs, at = rules[symbols[open_] - base], at[open_]
        symbols = np.concatenate([pairs[:, 0], pairs[:, 1]])
        at = np.concatenate([at, at + size[pairs[:, 0]]])
    return out


def opened(sequence: np.ndarray, rules: np.ndarray, base: int, size: np.ndarray) -> np.ndarray:
    """The ids of a whole sequence: each symbol is opened once for all its places. ``size``: ids of every symbol."""
    used = np.flatnonzero(np.bincount(sequence, minlength=len(size)))
    number = np.zeros(len(size), np.int64)
    number[used] = np.arange(len(used))
    flat = expanded(used, rules, base, size[base:]).astype("<u4")
    return gathered(flat, size[used], number[sequence])[0]


FORMAT = (
    "shard bigint, base bigint, n_tokens bigint, doc_ids array<bigint>, n_symbols bigint, "
    "rules binary, lengths binary, starts binary, sequence binary"
)


def shard_of(ids: list[np.ndarray]) -> dict:
    """A shard's parts: little-endian uint32 rules, lengths, places of documents, sequence."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    rules, sequence = compressed(flat)
    base = int(flat.max(initial=0)) + 1
    ends = np.flatnonzero(sequence == END_ID)
    starts = np.r_[0, ends + 1]
    long = lengths(rules, base)
    # an end id may also be an ordinary token: documents are told by their lengths
    if len(starts) != len(ids) + 1:
        size = np.ones(base + len(rules), np.int64)
        size[base:] = long
        upto = np.r_[0, np.cumsum(size[sequence])]
        starts = np.searchsorted(upto, np.r_[0, np.cumsum([len(i) for i in ids])])
    pack = lambda x: np.ascontiguousarray(x, "<u4").tobytes()
    return {
        "base": base, "n_tokens": len(flat), "n_symbols": len(sequence), "rules": pack(rules),
        "lengths": pack(long), "starts": pack(starts), "sequence": pack(sequence),
    }


def document(shard: dict, n: int) -> np.ndarray:
    """Ids of the shard's document ``n``; only its own symbols are opened."""
    starts = np.frombuffer(shard["starts"], "<u4")
    sequence = np.frombuffer(shard["sequence"], "<u4", int(starts[n + 1] - starts[n]), 4 * int(starts[n]))
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    return expanded(sequence.astype(np.int64), rules, shard["base"], np.frombuffer(shard["lengths"], "<u4"))


def runs(rows: list[tuple], weight: int) -> Iterator[list[tuple]]:
    """Rows in runs of texts (the second field) of about ``weight`` characters, 4,096 rows at most."""
    at = sum_ = 0
    for n, (_, text) in enumerate(rows, 1):
        sum_ += len(text or "")
        if sum_ >= weight or n - at == 4096 or n == len(rows):
            yield rows[at:n]
            at, sum_ = n, 0


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Tokens of ``docs`` (doc_id, text) as a table of Re-Pair shards in ``folder``.

    One row is one shard: ``FORMAT`` with its documents in ascending doc_id, nulls
    last; equal doc_ids are ordered by text. Ranges of doc_id are dealt to tasks by
    sampling, and a task cuts its range after each ``shard_bytes`` of text, so
    shards are bounded but for a single longer document, and shard numbers ascend
    with doc_id. Null and empty texts have the end id only; an empty table has no
    shard.
    """
    weight = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-weight // (8 * shard_bytes)))
    # by doc_id alone: ranges come from a sample of keys, which no text should be in
    sorted_ = docs.select("doc_id", "text").repartitionByRange(ranges, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    numbered = sorted_.withColumn("_range", F.spark_partition_id())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(tokenizer)
        ids, docs_, size, n, range_ = [], [], 0, 0, 0

        def shard() -> pd.DataFrame:
            return pd.DataFrame([{"shard": (range_ << 32) + n, "doc_ids": docs_, **shard_of(ids)}])

        for batch in batches:
            if len(batch):
                range_ = int(batch["_range"].iloc[0])
            rows = [(None if pd.isna(d) else int(d), t if isinstance(t, str) else None) for d, t in zip(batch["doc_id"], batch["text"])]
            for part in runs(rows, TOGETHER * shard_bytes):
                for (doc, text), made in zip(part, known.texts([t for _, t in part])):
                    if ids and size + len(text or "") > shard_bytes:
                        yield shard()
                        ids, docs_, size, n = [], [], 0, n + 1
                    ids.append(made)
                    docs_.append(doc)
                    size += len(text or "")
        if ids:
            yield shard()

    numbered.mapInPandas(work, FORMAT).write.parquet(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """Per document of a folder of shards: doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` counts the ids of all documents before: shards are added up by their
    own counts, a row each, and documents inside their shard.
    """
    shards = spark.read.schema(FORMAT).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", "n_tokens").withColumn(
        "offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "offset")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.to_dict("records"):
                rules = np.frombuffer(s["rules"], "<u4").reshape(-1, 2).astype(np.int64)
                sequence = np.frombuffer(s["sequence"], "<u4").astype(np.int64)
                starts = np.frombuffer(s["starts"], "<u4").astype(np.int64)
                size = np.ones(s["base"] + len(rules), np.int64)
                size[s["base"]:] = np.frombuffer(s["lengths"], "<u4")
                upto = np.r_[0, np.cumsum(size[sequence])][starts]
                flat = opened(sequence, rules, s["base"], size)
                yield pd.DataFrame({
                    "doc_id": pd.array(s["doc_ids"], dtype="Int64"), "inner": upto[:-1], "n_tokens": np.diff(upto),
                    "ids_crc32": [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(upto, upto[1:])], "shard": s["shard"]})

    docs = shards.mapInPandas(work, "doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint, shard bigint")
    return docs.join(offsets, "shard").select(
        "doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "shard")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and reads them back."""
    folder = shared_folder(docs.sparkSession)
    write_tokens(docs, tokenizer, folder)
    return read_tokens(docs.sparkSession, folder)
