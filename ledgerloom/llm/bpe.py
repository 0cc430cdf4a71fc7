"""BPE encoding and decoding: a minimal transducer of frequent words, exact merges for the rest."""

from __future__ import annotations

import bisect
import heapq
import json
import mmap
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, field, map_arrow, map_batches, materialize, plain

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts up to U+024F, whose letters, numbers and blanks are few enough to name.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_WIDE = regex.compile(WORD_PATTERN).findall
_BEYOND = re.compile("[^\x00-\u024f]").search


def split_words(text: str) -> list[str]:
    """The words of a text without special tokens; together they are the text."""
    return _NARROW(text) if _BEYOND(text) is None else _WIDE(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1
    bytes stand for themselves, the others get the letters from U+0100 on, in order."""
    plain_bytes = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain_bytes)]
    return {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Ranks of pairs of ids in an open hash table of arrays, to be asked for many pairs at once."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(4, (4 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        left = np.array(list(ranks), np.int64)
        values = np.array(list(ranks.values()), np.int64)
        at = self._home(left)
        while len(left):  # of those that want a place the first gets it, if it is free
            places, first = np.unique(at, return_index=True)
            free = first[self.keys[places] < 0]
            self.keys[at[free]], self.ranks[at[free]] = left[free], values[free]
            waits = np.ones(len(left), bool)
            waits[free] = False
            left, values, at = left[waits], values[waits], (at[waits] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        keys = a << 32 | b
        at, out = self._home(keys), np.full(len(keys), none, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, data: dict):
        letters = byte_letters()
        model, pre = data["model"], data["pre_tokenizer"]
        plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain_model or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or data["normalizer"] or data["decoder"]["type"] != "ByteLevel":
            raise ValueError("only plain byte-level BPE files are supported")
        ids = model["vocab"]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}  # both ids of a pair in one number
        self.made: list[int] = []  # by rank
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[a] << 32 | ids[b], len(self.made))
            self.made.append(ids[a + b])
        self._pairs = PairTable(self.ranks)
        self.special: dict[str, int] = {}
        for token in data.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("special tokens that take in white space are not supported")
            self.special[token["content"]] = token["id"]
            self.bytes[token["id"]] = token["content"].encode()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: again and again the adjacent pair of the lowest rank is merged, the
        first of equal ones. Long words use a heap over a linked list, which gives the same."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.ranks.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = new = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, as little-endian 32-bit integers. All words take a step
        together: in each the first pair of its lowest rank is merged, until none has a pair left.
        Long words are merged one by one."""
        out = [array("I", self.merge(w)).tobytes() if len(w) > 64 or not w else b"" for w in words]
        own = np.array([i for i, w in enumerate(words) if 0 < len(w) <= 64], np.int64)
        sizes = np.array([len(words[i]) for i in own.tolist()], np.int64)
        ids = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8)]
        word = np.repeat(np.arange(len(own)), sizes)  # the word of each token
        made, none = np.array([*self.made, 0], np.int64), len(self.made)

        def ranked(at: np.ndarray) -> np.ndarray:
            """The rank of the pair that begins at each place; ``none`` at the end of a word."""
            after = np.minimum(at + 1, len(ids) - 1)
            inside = (at + 1 < len(ids)) & (word[at] == word[after])
            return np.where(inside, self._pairs.get(ids[at], ids[after], none), none)

        rank = ranked(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            done = least == none
            if done.any():
                raw = ids.astype("<u4").tobytes()
                for i, a, n in zip(own[word[starts[done]]].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[i] = raw[4 * a : 4 * (a + n)]
                left = np.repeat(~done, sizes)
                ids, word, rank = ids[left], word[left], rank[left]
                if not len(ids):
                    break
                least, sizes = least[~done], sizes[~done]
            places = np.flatnonzero(rank == np.repeat(least, sizes))
            places = places[np.append(True, word[places][1:] != word[places][:-1])]  # the first of each word
            ids[places] = made[rank[places]]
            kept = np.ones(len(ids), bool)
            kept[places + 1] = False
            ids, word, rank = ids[kept], word[kept], rank[kept]
            places -= np.arange(len(places))  # so many tokens went before
            rank[places] = ranked(places)
            before = places[(places > 0) & (word[places - 1] == word[places])] - 1
            rank[before] = ranked(before)
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j], self.made[rank]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Lexicon:
    """Minimal acyclic transducer from words to id sequences, in one block of bytes.

    The automaton shares prefixes and suffixes: equal rests of words are one state. Each edge
    carries a number; their sum along a word is the word's rank, which names its id sequence in
    the output table. ``build`` lays everything out in flat arrays, so the block can be mapped
    into memory and used as it lies.
    """

    MAGIC = b"LEX1"

    def __init__(self, block: bytes | memoryview | mmap.mmap):
        view = memoryview(block)
        if bytes(view[:4]) != self.MAGIC:
            raise ValueError("not a lexicon")
        states, edges, words, ids, self.root = struct.unpack_from("<5I", view, 4)
        at = 24

        def part(kind: str, n: int) -> memoryview:
            nonlocal at
            size = n * (4 if kind == "I" else 1)
            out = view[at : at + size].cast(kind)
            at += (size + 3) // 4 * 4
            return out

        self.first, self.final = part("I", states + 1), part("B", states)
        self.label, self.target, self.number = part("B", edges), part("I", edges), part("I", edges)
        self.offset, self.ids = part("I", words + 1), part("I", ids)
        self.states, self.words = states, words
        self._edges: tuple[np.ndarray, ...] | None = None

    @classmethod
    def mapped(cls, block: bytes) -> Lexicon:
        """The lexicon over an anonymous memory map, which needs no file on any machine."""
        area = mmap.mmap(-1, max(1, len(block)))
        area.write(block)
        return cls(area)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> bytes:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        made: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, edges, words below

        def close(final: bool, edges: list[tuple[int, int]]) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(made)
                made.append((final, tuple(edges), final + sum(made[t][2] for _, t in edges)))
            return register[key]

        open_states: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # along the last word
        last = b""

        def shrink(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, edges = open_states.pop()
                open_states[-1][1].append((last[len(open_states) - 1], close(final, edges)))

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            shrink(same)
            open_states += [(False, []) for _ in word[same:]]
            open_states[-1] = (True, open_states[-1][1])
            last = word
        shrink(0)
        root = close(*open_states[0])
        first, final, label, target, number = [0], [], [], [], []
        for is_final, edges, _ in made:
            before = int(is_final)
            for byte, to in edges:
                label.append(byte)
                target.append(to)
                number.append(before)
                before += made[to][2]
            first.append(len(label))
            final.append(is_final)
        offsets = np.cumsum([0, *(len(entries[w]) for w in words)])
        flat = [i for w in words for i in entries[w]]
        out = cls.MAGIC + struct.pack("<5I", len(made), len(label), len(words), len(flat), root)
        for kind, values in (("<u4", first), ("u1", final), ("u1", label), ("<u4", target), ("<u4", number), ("<u4", offsets), ("<u4", flat)):
            raw = np.asarray(values, kind).tobytes()
            out += raw + b"\0" * (-len(raw) % 4)
        return out

    def rank(self, word: bytes) -> int:
        """The word's place among all sorted words; -1 if it isn't one."""
        state, total = self.root, 0
        first, label, number, target = self.first, self.label, self.number, self.target
        for byte in word:
            edge, end = first[state], first[state + 1]
            if end - edge > 8:
                edge = bisect.bisect_left(label, byte, edge, end)
            while edge < end and label[edge] < byte:
                edge += 1
            if edge == end or label[edge] != byte:
                return -1
            total += number[edge]
            state = target[edge]
        return total if self.final[state] else -1

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """``get`` of many words: all walk the automaton together, a byte at a time."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.label):
            return out
        if self._edges is None:
            first = np.frombuffer(self.first, np.uint32).astype(np.int64)
            states = np.repeat(np.arange(self.states, dtype=np.int64), np.diff(first))
            # the edges of a state are in order of their labels
            self._edges = (states << 8 | np.frombuffer(self.label, np.uint8), np.frombuffer(self.target, np.uint32), np.frombuffer(self.number, np.uint32), np.frombuffer(self.final, np.uint8))
        keys, target, number, final = self._edges
        sizes = np.array([len(w) for w in words], np.int64)
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        walking = np.flatnonzero(sizes > 0)
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(walking):
            wanted = state[walking] << 8 | data[starts[walking] + depth]
            edge = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            goes = keys[edge] == wanted
            walking, edge = walking[goes], edge[goes]
            state[walking] = target[edge]
            total[walking] += number[edge]
            depth += 1
            there = sizes[walking] == depth
            for i in walking[there][final[state[walking[there]]] != 0].tolist():
                rank = int(total[i])
                out[i] = self.ids[self.offset[rank] : self.offset[rank + 1]].tobytes()
            walking = walking[~there]
        return out

    def get(self, word: bytes) -> bytes | None:
        """Ids of a word as little-endian 32-bit integers; None if the lexicon hasn't the word."""
        rank = self.rank(word)
        return None if rank < 0 else self.ids[self.offset[rank] : self.offset[rank + 1]].tobytes()


class Encoder:
    """Encodes whole texts: special tokens first, then words, by memo, lexicon or exact merges."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memo_words: int = 300_000, chunk_words: int = 200_000):
        self.vocabulary, self.lexicon, self.memo_words, self.chunk_words = vocabulary, lexicon, memo_words, chunk_words
        self.memo: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.table = vocabulary.bytes

    def _learn(self, distinct: set[str]) -> None:
        """Bring the words of a chunk into the memo. If that makes it too large, it keeps only them:
        what is kept for speed is bounded, by ``memo_words`` or by what a chunk has."""
        new = [w for w in distinct if w not in self.memo]
        if len(self.memo) + len(new) > self.memo_words:
            self.memo = {w: self.memo[w] for w in distinct if w in self.memo}
        data = [w.encode() for w in new]
        found = self.lexicon.get_all(data) if self.lexicon is not None else [None] * len(new)
        unseen = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(unseen, self.vocabulary.merge_all([data[i] for i in unseen]), strict=True):
            found[i] = ids
        self.memo.update(zip(new, found, strict=True))

    def split(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, is it a special token) of a text."""
        if self.cut is None or not any(s in text for s in self.vocabulary.special):
            yield text, False
            return
        for i, piece in enumerate(self.cut(text)):
            yield piece, i % 2 == 1

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers. Texts go in chunks of ``chunk_words`` words
        or one text, whose distinct words are looked up together."""
        out: list[bytes] = []
        chunk: list[list[tuple[list[str], int | None]]] = []  # the pieces of each text: words, or a special token
        held = 0

        def flush() -> None:
            nonlocal held
            self._learn(set().union(*[words for pieces in chunk for words, _ in pieces]))
            get = self.memo.__getitem__
            for pieces in chunk:
                out.append(b"".join([struct.pack("<I", token) if token is not None else b"".join(map(get, words)) for words, token in pieces]))
            chunk.clear()
            held = 0

        for text in texts:
            chunk.append([([], self.vocabulary.special[piece]) if special else (split_words(piece), None) for piece, special in self.split(text)])
            held += sum(len(words) for words, _ in chunk[-1])
            if held >= self.chunk_words:
                flush()
        flush()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, text_col: str, n: int, special: list[str], flush: int = 200_000) -> list[str]:
    """The ``n`` most frequent words over all texts that occur twice or more, of equal ones the smaller. Each task counts
    on its own and hands over what it has counted so far whenever it holds ``flush`` words."""
    source = plain(docs, text_col)
    schema = T.StructType([field("word", T.StringType()), field("times", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile("|".join(map(regex.escape, special))).split if special else lambda t: [t]
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "times"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in cut(text or ""):
                    counts.update(split_words(piece))
                if len(counts) >= flush:
                    yield out()
                    counts.clear()
        yield out()

    total = map_arrow(source, run, schema).groupBy("word").agg(F.sum("times").alias("times"))
    counted = materialize(total.filter((F.col("times") > 1) & F.octet_length("word").between(2, 64)))
    sizes = counted.groupBy(F.floor(F.log2("times")).alias("power")).count().orderBy(F.desc("power")).collect()
    least, held = 2, 0
    for row in sizes:  # only counts from this power of two on can be among the n, so only they are sorted
        least, held = 1 << row["power"], held + row["count"]
        if held >= n:
            break
    return [r["word"] for r in counted.filter(F.col("times") >= least).orderBy(F.desc("times"), "word").limit(n).collect()]


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 1 << 15) -> DataFrame:
    """The id, n_tokens, ids (little-endian unsigned 32-bit integers in one binary) and decoded
    text of every row.

    Ids are those that the tokenizers library gives for the file ``tokenizer`` without adding
    special tokens; special tokens that stand in a text count as such; truncation and padding
    are not applied. ``decoded`` is what the ids decode to, special tokens included.

    The ``lexicon_words`` most frequent words of all texts are compiled on the driver, so lexicon
    and vocabulary that reach the executors have a size that doesn't follow the data; any other
    word is merged exactly, so the lexicon changes the speed and never the result.

    Null and empty texts have no tokens and decode to an empty text; a null id stays null;
    repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    vocabulary = Vocabulary.load(tokenizer)
    words = frequent_words(docs, text_col, lexicon_words, list(vocabulary.special))
    block = Lexicon.build({w.encode(): vocabulary.merge(w.encode()) for w in words})
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, block))

    def make():
        known, data = sent.value
        encoder = Encoder(known, Lexicon.mapped(data))

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = encoder.encode_all(t.decode("utf-8", "replace") for t in as_bytes(batch.column(batch.schema.get_field_index(text_col))))
            return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.decode(i) for i in ids], pa.string())]

        return run

    added = [field("n_tokens", T.LongType()), field("ids", T.BinaryType()), field("decoded", T.StringType())]
    return map_batches(plain(docs, id_col, text_col), added, make, [id_col])
