"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's state is two short contiguous rows: its parts and the merge ranks of adjacent parts. The row
of ranks is scanned for its minimum, that boundary is deleted, the parts behind it move up, and only
the two neighbouring ranks are looked up again. Words of the same length stand below each other in one
matrix, so a step serves all of them. Long words, where repeated scans would be quadratic, keep their
boundaries in a linked list and their ranks in a heap; the merges are the same.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern that splits text before merging, with its character classes to be filled
# in; letters, numbers and white space below U+0100; letters and numbers of Unicode versions later
# than the one the vocabulary's own splitter knows, where they count as symbols; printable bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "N": "0-9²³¹¼-¾", "S": "\t-\r \x85\xa0"}
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def _splitter(compile_, letters: str, numbers: str, spaces: str):
    return compile_(SPLIT.replace("{L}", letters).replace("{N}", numbers).replace("{S}", spaces))


NEVER = np.iinfo(np.int32).max
#: Bytes of a word up to which its ranks are scanned.
SHORT = 48
#: Words kept with their ids in a worker; the store starts anew when full.
STORE = 400_000
SLOTS = 1 << 18


def _byte_of() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A tokenizer from the bytes of its JSON file (byte-level, without normaliser)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        stand, vocab = _byte_of(), spec["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(stand.__getitem__, token))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.first = np.zeros(256, np.int32)
        for c, b in stand.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._index(np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.latin = _splitter(re.compile, *LATIN.values())
        self.any = _splitter(regex.compile, r"\p{L}", r"\p{N}", r"\s")
        self.newer = regex.compile(f"[{NEWER}]")
        self.older = _splitter(lambda p: regex.compile("(?V1)" + p), rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]", r"\s")
        self.forget()

    def forget(self) -> None:
        """Empty the store: from word to its place, and the ids of all places behind each other."""
        self.store: dict[str, int] = {}
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        """The words that are merged apart."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.older if self.newer.search(text) else self.any).findall(text)
        return self.latin.findall(text)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing from pair to rank; the first of equal pairs wins."""
        self.keys, self.rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NEVER, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) % SLOTS
            if self.keys[slot] == -1:
                self.keys[slot], self.rank[slot] = key, rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NEVER where they do not merge."""
        keys = left.astype(np.int64) * self.size + right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.rank[slots], NEVER)
        open_ = np.nonzero((found != keys) & (found != -1))[0]
        while len(open_):
            slots[open_] = (slots[open_] + 1) % SLOTS
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _scan(self, words: np.ndarray) -> list[list[int]]:
        """Ids of words of one length, given as a matrix of their bytes."""
        parts, out = self.first[words], [[]] * len(words)
        rows = np.arange(len(words))
        ranks = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
        while True:
            if parts.shape[1] == 1:
                at, least = np.zeros(len(rows), np.int64), np.full(len(rows), NEVER)
            else:
                at = ranks.argmin(axis=1)  # the leftmost of equal minima
                least = ranks[np.arange(len(rows)), at]
            done = least == NEVER
            for r, ids in zip(rows[done].tolist(), parts[done].tolist(), strict=True):
                out[r] = ids
            go = ~done
            if not go.any():
                return out
            rows, parts, ranks, at, least = rows[go], parts[go], ranks[go], at[go], least[go]
            line, width = np.arange(len(rows)), parts.shape[1]
            parts[line, at] = self.merged[least]
            place = np.arange(width - 1)
            parts = np.take_along_axis(parts, place + (place > at[:, None]), axis=1)
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            before, after = np.nonzero(at > 0)[0], np.nonzero(at < width - 2)[0]
            ranks[before, at[before] - 1] = self.ranks(parts[before, at[before] - 1], parts[before, at[before]])
            ranks[after, at[after]] = self.ranks(parts[after, at[after]], parts[after, at[after] + 1])

    def _heap(self, word: bytes) -> list[int]:
        """Ids of one long word."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # a boundary that is gone
            parts[i], parts[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    new = int(self.ranks(np.array([parts[left]]), np.array([parts[right]]))[0])
                    if new != NEVER:
                        heapq.heappush(heap, (new, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def learn(self, new: list[str]) -> None:
        """Put the ids of words that are not in the store there."""
        by_length: dict[int, list[int]] = {}
        data = [w.encode() for w in new]
        for at, word in enumerate(data):
            by_length.setdefault(len(word), []).append(at)
        found: list[list[int]] = [[]] * len(new)
        for n, group in by_length.items():
            words = [data[at] for at in group]
            ids = map(self._heap, words) if n > SHORT else self._scan(np.frombuffer(b"".join(words), np.uint8).reshape(-1, n))
            for at, one in zip(group, ids, strict=True):
                found[at] = one
        self.store.update(zip(new, range(len(self.store), len(self.store) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an added token in a text gets its own id."""
        if len(self.store) > STORE:
            self.forget()
        pieces = [self.cut.split(t) if self.cut and any(a in t for a in self.added) else [t] for t in texts]
        words = [[w if w in self.added else self.split(w) for w in p if w] for p in pieces]
        new = set(chain.from_iterable(chain.from_iterable(p for p in doc if not isinstance(p, str)) for doc in words))
        self.learn(list(new - self.store.keys()))
        return [np.concatenate([self._ids(p) for p in doc]) if doc else np.empty(0, np.int32) for doc in words]

    def _ids(self, words: list[str] | str) -> np.ndarray:
        """Ids of an added token or of words in the store."""
        if isinstance(words, str):
            return np.array([self.added[words]], np.int32)
        places = np.fromiter(map(self.store.__getitem__, words), np.int64, len(words))
        start = self.start[places]
        size = self.start[places + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def _tokenizer(data: bytes) -> ByteBpe:
    """One tokenizer per file and worker."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(data)
    return _LOADED[key]


#: Characters encoded at a time, so that a batch of long texts needs little memory.
CHUNK = 500_000


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ``ids`` (array of int) and ``decoded`` (the text those ids stand for) per row of ``docs``.

    ``tokenizer`` is the path of the JSON file on the driver; its bytes are broadcast (a fixed file of
    one or two megabytes). Whole texts are encoded; null and empty texts give no ids and an empty text;
    repeated rows are encoded alike; an empty table gives an empty result. Only doc_id and text are read.
    """
    with open(tokenizer, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    schema = source.select("doc_id", F.array(F.lit(0)).alias("ids"), F.col("text").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared.value)
        for batch in batches:
            start = 0
            for texts in _chunks(t.as_py() for t in batch.column("text")):
                ids = bpe.encode_batch(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.empty(0, np.int32))
                decoded = pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), lists, decoded], ["doc_id", "ids", "decoded"])
                start += len(texts)

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
