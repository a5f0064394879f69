"""BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the corpus, with their ids, are compiled into a minimal
acyclic automaton whose arcs carry outputs; the outputs on a word's path add up
to its number, and numbers index the table of ids.  The file is memory-mapped by
each worker.  Words that are not in it are merged exactly.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, give_back, read_table, stage, text_or_empty

#: Words are compiled if they make at least this share of all; so there are at most as many as its inverse.
LEAST_SHARE = 1 / (1 << 20)
#: Distinct words that a worker counts before it hands them on, or their bytes if those are many.
HELD, HELD_BYTES = 200_000, 32 << 20
#: Bytes of words that a worker remembers, with what each costs, before it forgets them all.
REMEMBERED, COST = 160 << 20, 400
#: Characters of text that are encoded together, and new words that are looked up together.
GROUP, TOGETHER = 1_000_000, 1 << 13
#: Bytes of remembered words for each character of such a group, at least: where few are remembered, groups are small.
ROOM = 64

COUNTED = "word binary, n long"
#: What is surely white space, what one of two definitions alone takes for it, and what single spaces and line ends are not.
SURE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNSURE = "\x1c-\x1f\u180e\u200b\ufeff"
ODD = ("  ", " \n", "\n ", "\n\n", "\0", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
BORDER = re.compile(f"(?<=[^{SURE}{UNSURE}])(?=[{SURE}])")
#: Letters and symbols (neither letters, numbers nor white space to the tokenizer) of plain words, and the pieces it cuts these into.
LETTERS, SYMBOLS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-/:-@\\[-`{-~\u2010-\u2027"
PLAIN = re.compile(f"[ \n][{LETTERS}0-9{SYMBOLS}]+")
PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[{SYMBOLS}]+|\n")
HEADER = 4
#: Cells of pieces that merge together; bytes beyond which a piece merges alone, and bits of a place in one that does not.
CELLS = 1 << 17
LONG, PLACE = 64, 6


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, take the
    letters from U+0100 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def take(flat: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The named rows of ragged rows, one after the other; row ``i`` has ``counts[i]`` of the flat values."""
    own = counts[rows]
    ends = np.cumsum(own)
    shift = (np.cumsum(counts) - counts)[rows] - (ends - own)
    return flat[np.repeat(shift, own) + np.arange(own.sum())]


def sizes(rows: list) -> np.ndarray:
    return np.fromiter(map(len, rows), np.int64, len(rows))


class Table:
    """Places of distinct keys, looked up many at a time: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.keys = np.append(keys.astype(np.int64), np.iinfo(np.int64).min)  # the last one is no key: free slots name it
        bits = max(4, (4 * self.size).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, self.size, np.int32)
        at, left = self.slot(self.keys), np.arange(self.size)
        while len(left):
            free = left[self.slots[at[left]] == self.size]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key (64 bits); ``size`` for others."""
        at = self.slot(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((self.keys[found] != keys) & (found < self.size))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            next_ = self.slots[at[open_]]
            found[open_] = next_
            open_ = open_[(self.keys[next_] != keys[open_]) & (next_ < self.size)]
        return found


class Vocabulary:
    """Merges and ids of a byte-level tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        self._check(data)
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        raw = lambda token: bytes(map(byte.__getitem__, token))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        id_of = {raw(t): i for t, i in data["model"]["vocab"].items()}
        rank_of = dict(sorted((id_of[raw(a)] << 32 | id_of[raw(b)], r) for r, (a, b) in enumerate(pairs)))
        self.pair = Table(np.array(list(rank_of), np.int64))
        # ranks leave room for a place in a piece, and those of pairs that never merge have all bits
        kind = np.int32 if len(pairs) < 1 << 31 - PLACE - 1 else np.int64
        self.never = np.iinfo(kind).max
        self.rank = np.array([r << PLACE for r in rank_of.values()] + [self.never], kind)
        self.merged = np.array([id_of[raw(a + b)] for a, b in pairs], np.int32)
        self.of_byte = np.array([id_of[bytes([b])] for b in range(256)], np.int32)
        self.byte_rank = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokens = [b""] * (max([*id_of.values(), *self.special.values()]) + 1)
        for t, i in id_of.items():
            tokens[i] = t
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.bytes, self.size = np.frombuffer(b"".join(tokens), np.uint8), sizes(tokens)
        self.name = [*map(str, range(len(tokens))), " "]  # the last one stands between words
        self.cut = Tokenizer.from_str(json.dumps(data | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})).pre_tokenizer  # its own vocabulary is not needed
        self.byte = byte

    @cached_property
    def rank_of(self) -> dict[int, int]:
        """The rank of each pair that merges; only long pieces need it."""
        return dict(zip(self.pair.keys[:-1].tolist(), (self.rank[:-1] >> PLACE).tolist()))

    @staticmethod
    def _check(data: dict) -> None:
        """Raise on what is not done here: other models, normalizers, cutting or options."""
        model, cut = data["model"], data.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("lstrip", "rstrip", "single_word") if any(t.get(k) for t in data["added_tokens"])]
        if model.get("type", "BPE") != "BPE" or data.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            odd.append("model, normalizer or pre-tokenizer")
        if odd:
            raise ValueError(f"this tokenizer needs what is not supported: {', '.join(odd)}")

    def pieces(self, word: str) -> list[bytes]:
        """The pieces within which bytes may merge, cut as the tokenizer does."""
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.cut.pre_tokenize_str(word)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, moved up by ``PLACE`` bits; ``never``, if they don't merge or one is negative."""
        return self.rank[self.pair.find(left.astype(np.int64) << 32 | right)]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact byte-pair merges of many pieces: in each, the pair of lowest rank first, the leftmost of equals.

        Gives the ids of all pieces, one after the other, and each one's number
        of ids.  Pieces of like length go together, so many that their cells are
        bounded; in each step every piece that still has a pair merges one.  Long
        pieces merge alone.
        """
        size = sizes(pieces)
        order = np.argsort(size, kind="stable")
        length = size[order]
        counts, parts = np.zeros(len(pieces), np.int64), []
        low, long = np.searchsorted(length, [1, LONG + 1]).tolist()
        while low < long:
            high = min(long, low + max(1, CELLS // (int(length[low]) + 1)))
            high = min(high, low + max(1, CELLS // (int(length[high - 1]) + 1)))
            own = order[low:high]
            ids, counts[own] = self.merge_rows([pieces[i] for i in own.tolist()], length[low:high])
            parts.append(ids)
            low = high
        for i in order[long:].tolist():
            parts.append(np.array(self.merge_long(pieces[i]), np.int32))
            counts[i] = len(parts[-1])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return take(np.concatenate([np.zeros(0, np.int32), *parts]), counts[order], back), counts

    def merge_rows(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of some pieces of at most ``LONG`` bytes, the longest last.

        Cells lie by place and piece.  A cell has the id of the token that starts
        there, or -1, the places of the tokens after and before it, and a key: the
        rank of its pair with the next one, then its place.  The last row is never
        used, so place -1 may stand for it.
        """
        n, width = len(pieces), int(size[-1])
        inside = np.arange(width + 1) < size[:, None]
        raw = np.zeros((n, width + 1), np.int32)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(width + 1)[:, None]
        ids = np.where(inside, self.of_byte[raw], np.int32(-1)).T.reshape(-1)
        key = np.full((width + 1, n), self.never, self.rank.dtype)
        key[:-1] = np.where(inside[:, 1:], self.byte_rank[raw[:, :-1] << 8 | raw[:, 1:]], self.never).T | place[:-1].astype(key.dtype)
        after = np.repeat((place + 1).astype(np.int8), n)
        before = np.repeat((place - 1).astype(np.int8), n)
        cells = key.reshape(-1)
        while True:
            best = key.min(0)
            column = np.flatnonzero(best != self.never)
            if not len(column):
                break
            best = best[column]
            i = (best & LONG - 1).astype(np.int64)
            here = i * n + column
            gone = after[here].astype(np.int64) * n + column
            k = after[gone].astype(np.int64)
            right = k * n + column
            h = before[here].astype(np.int64)
            left = h * n + column
            new = self.merged[best >> PLACE]
            ids[here], ids[gone], cells[gone] = new, -1, self.never
            after[here], before[right] = k, i
            rank = self.ranks(np.concatenate([new, ids[left]]), np.concatenate([ids[right], new]))
            cells[here] = rank[: len(i)] | i
            cells[left] = rank[len(i) :] | (h & LONG - 1)
        ids = ids.reshape(width + 1, n).T
        open_ = ids >= 0
        return ids[open_], open_.sum(1)

    def merge_long(self, piece: bytes) -> list[int]:
        """The merges of one piece, by a heap of pairs and links between its tokens."""
        first = self.of_byte[np.frombuffer(piece, np.uint8)]
        rank = self.ranks(first[:-1], first[1:]).astype(np.int64)
        at = np.flatnonzero(rank < self.never)
        heap = ((rank[at] >> PLACE << 32) | at).tolist()
        heapq.heapify(heap)
        ids, n = first.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, merged = self.rank_of, self.merged
        while heap:
            x = heapq.heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has merged since
            ids[i], ids[j] = int(merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank_of.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, s << 32 | i)
            h = before[i]
            if h >= 0 and (s := rank_of.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, s << 32 | h)
        return [x for x in ids if x >= 0]

    def word_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (or whole texts), one after the other, and each one's number of ids.

        Plain words are cut together, as white space opens each of them; equal
        pieces merge once.
        """
        plain = np.fromiter((PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        own = [words[i] for i in first.tolist()]
        cut = PIECE.findall("".join(own))
        ends = np.searchsorted(np.cumsum(sizes(cut)), np.cumsum(sizes(own)), "left") + 1
        number = {p: i for i, p in enumerate(dict.fromkeys(cut))}
        other = [self.pieces(words[i]) for i in rest.tolist()]
        which = np.fromiter(chain(map(number.__getitem__, cut), range(len(number), len(number) + sum(map(len, other)))), np.int64)
        ids, counts = self.merge([*(p.encode() for p in number), *chain.from_iterable(other)])
        flat = take(ids, counts, which)
        sums = np.concatenate([[0], np.cumsum(counts[which])])
        of_word = np.diff(sums[np.concatenate([ends, len(cut) + np.cumsum(sizes(other))])], prepend=0)
        back = np.empty(len(words), np.int64)
        back[np.concatenate([first, rest])] = np.arange(len(words))
        return take(flat, of_word, back), of_word[back]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words (or whole texts)."""
        flat, counts = self.word_tokens(words)
        ids, ends = flat.tolist(), np.cumsum(counts).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def cut_words(text: str) -> list[str]:
    """Words that never share a token: white space opens the next one.

    A pre-token holds white space only at its start, so a boundary between a
    character that is surely none and a following one that surely is always lies
    between tokens.
    """
    if any(map(text.__contains__, ODD)):
        return BORDER.split(text)
    words = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    return words if words[0] else words[1:]


def build_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file of the transducer for distinct words with their ids.

    Words go in sorted; a state that can no longer change is replaced by an
    equal one that exists (same finality and arcs), which keeps the automaton
    minimal at each step.  Counts of words below each state then give the arcs'
    outputs.  Layout: numbers of states and arcs, ids and words; first arc of
    each state with its finality; label, target and output of each arc; offset
    of each word's ids; ids.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    before = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(node)))

    for word, _ in entries:
        same = len(os.path.commonprefix([before, word]))
        close(same)
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        before = word
    close(0)
    root = settle(path[0])
    below = np.zeros(len(states), np.int64)
    for i, (final, arcs) in enumerate(states):  # targets come before their sources
        below[i] = int(final) + sum(below[t] for _, t in arcs)
    first, final_, label, target, output = [], [], [], [], []
    for final, arcs in states:
        first.append(len(label))
        final_.append(int(final))
        passed = int(final)
        for c, t in arcs:
            label.append(c)
            target.append(t)
            output.append(passed)
            passed += int(below[t])
    first.append(len(label))
    ids = [i for _, x in entries for i in x]
    offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in entries])]) if entries else np.zeros(1)
    parts = [[len(states), len(label), len(entries), root], first, final_, label, target, output, offsets, ids]
    return b"".join(np.asarray(p, dtype="<i4").tobytes() for p in parts)


class Lexicon:
    """A memory-mapped transducer: ``get(words)`` gives the ids of those it holds."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing is left when the worker ends
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        data_ = np.frombuffer(self.map, dtype="<i4")
        n, arcs, words, self.root = map(int, data_[:HEADER])
        at = HEADER
        parts = []
        for size in (n + 1, n, arcs, arcs, arcs, words + 1):
            parts.append(data_[at : at + size])
            at += size
        first, self.final, label, self.target, self.output, offset = parts
        self.ids, self.counts = data_[at:], np.diff(offset[: words + 1]).astype(np.int64)
        self.arc = Table(np.repeat(np.arange(n, dtype=np.int64), np.diff(first)) << 8 | label)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words follow their arcs together, a byte at a time."""
        size = sizes(words)
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(words), -1, np.int64)
        alive = np.flatnonzero(size)
        state, number, i = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive):
            at = self.arc.find(state << 8 | raw[start[alive] + i])
            hit = at < self.arc.size
            alive, number, at = alive[hit], number[hit], at[hit]
            number += self.output[at]
            state = self.target[at].astype(np.int64)
            i += 1
            ends = size[alive] == i
            done = ends & (self.final[state] == 1)
            out[alive[done]] = number[done]
            alive, state, number = alive[~ends], state[~ends], number[~ends]
        return out

    def get(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, or None."""
        ends = np.cumsum(self.counts)
        return [self.ids[ends[i] - self.counts[i] : ends[i]].tolist() if i >= 0 else None for i in self.find(words)]


class Encoder:
    """Encodes and decodes words, through the lexicon or exact merges; remembers a bounded number of them.

    Of each remembered word it holds the ids, as text, and what they decode to
    where that is not the word itself.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, remembered: int = REMEMBERED):
        self.vocabulary, self.lexicon, self.remembered = vocabulary, lexicon, remembered
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.held = 0

    def forget(self) -> None:
        self.held = 0
        self.ids.clear()
        self.decoded.clear()

    def learn(self, words: set[str]) -> None:
        """Make room if need be, and look up what is not remembered: the lexicon first, exact merges for the rest."""
        new = list(words.difference(self.ids))
        more = sum(map(len, new)) * 6 + len(new) * COST
        if self.held and self.held + more > self.remembered:
            self.forget()
            new = list(words)
            more = sum(map(len, new)) * 6 + len(new) * COST
        self.held += more
        for low in range(0, len(new), TOGETHER):
            self.look_up(new[low : low + TOGETHER])

    def look_up(self, words: list[str]) -> None:
        """Remember some distinct words."""
        v, raw = self.vocabulary, [w.encode() for w in words]
        number = self.lexicon.find(raw)
        order = np.argsort(number < 0, kind="stable")  # those of the lexicon first
        words, raw = [words[i] for i in order.tolist()], [raw[i] for i in order.tolist()]
        known = number[number >= 0]
        ids, counts = v.word_tokens(words[len(known) :])
        flat = np.concatenate([take(self.lexicon.ids, self.lexicon.counts, known), ids]).astype(np.int64)
        counts = np.concatenate([self.lexicon.counts[known], counts])
        starts = np.cumsum(counts) - counts
        marked = np.insert(flat, starts[1:], len(v.name) - 1).tolist()
        self.ids.update(zip(words, ",".join(map(v.name.__getitem__, marked)).split(", ,"), strict=True))
        tokens, size = take(v.bytes, v.size, flat).tobytes(), np.add.reduceat(v.size[flat], starts)
        if tokens != b"".join(raw) or (size != sizes(raw)).any():
            ends = np.cumsum(size).tolist()
            for w, a, b in zip(words, [0, *ends], ends):
                text = tokens[a:b].decode("utf-8", "replace")
                if text != w:
                    self.decoded[w] = text

    def parts(self, text: str) -> list[str]:
        """Words of a text, and special tokens."""
        v = self.vocabulary
        special = v.special_cut is not None and any(s in text for s in v.special)
        out: list[str] = []
        for part in v.special_cut.split(text) if special else [text]:
            if part in v.special:
                out.append(part)
            elif part:
                out += cut_words(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Ids of some texts, joined by commas, and what they decode to; the texts are held together with their words."""
        cut = list(map(self.parts, texts))
        words = set().union(*cut)
        special = self.vocabulary.special
        self.learn({w for w in words if w not in special} if any(s in words for s in special) else words)
        for s in special:
            self.ids[s] = self.vocabulary.name[special[s]]
        ids, decoded = self.ids.__getitem__, self.decoded.get
        return [(",".join(map(ids, x)), "".join(map(decoded, x, x) if self.decoded else x).encode()) for x in cut]


def groups(texts, most: int = GROUP) -> Iterator[list[str]]:
    """An Arrow column of texts in groups of bounded size."""
    group, size = [], 0
    for x in texts:
        group.append(x.as_py())
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_corpus_words(texts: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Counts of all words of ``text``; each task adds up before the shuffle, in bounded memory."""
    most, most_bytes = min(HELD, remembered // COST), min(HELD_BYTES, remembered)

    def count(batches):
        held: Counter = Counter()
        size = 0

        def flush():
            nonlocal size
            size = 0
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                held.update(cut_words(text) if text else ())
                size += len(text)
                if len(held) > most or size > most_bytes and sum(map(len, held)) > most_bytes:
                    yield flush()
                elif size > most_bytes:
                    size = 0
        if held:
            yield flush()
        give_back()

    return texts.mapInArrow(count, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


_WORKERS: dict[bytes, Encoder] = {}


def _encoder(spec: str, lexicon: bytes, remembered: int = REMEMBERED) -> Encoder:
    """One encoder a worker process, for as long as vocabulary, lexicon and bound are the same."""
    key = hashlib.sha256(b"%d " % remembered + spec.encode() + lexicon).digest()
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Encoder(Vocabulary(spec), Lexicon(lexicon), remembered)
        give_back()  # what reading the vocabulary took
    return _WORKERS[key]


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, least_share: float = LEAST_SHARE, remembered: int = REMEMBERED) -> bytes:
    """Count all words of the corpus and compile those of at least ``least_share``.

    Their number is at most the share's inverse at any size of the corpus; so is
    what comes to the driver and what is broadcast.
    """
    counts = count_corpus_words(docs.select(text_or_empty().cast("string").alias("text")), remembered)
    counts = stage(counts.where("n > 1"), "bpe-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") >= max(2.0, total * least_share)).select("word").toLocalIterator()
    words = [bytes(r["word"]).decode() for r in frequent]
    return build_lexicon([(w.encode(), ids) for w, ids in zip(words, vocabulary.word_ids(words), strict=True)])


def encode(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, with_ids: bool = False, least_share: float = LEAST_SHARE, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the whole text (and ``ids``).

    ``tokenizer`` is the path of a byte-level tokenizer file; the driver reads it
    and workers get its content.  Special tokens' strings in a text are those
    tokens; none are added.  A null or empty text has no ids and decodes to the
    empty string.  ``keep`` names the columns to carry along (all, if not given);
    columns named like the results are replaced, any other name is the user's.
    Repeated rows are encoded alike; empty tables give empty results.  A worker
    holds a batch of rows, the ids of a group of texts and words up to
    ``remembered`` bytes, while it counts them too; with fewer, groups are
    smaller and words are merged more often.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    carried = Carried(docs, keep, names)
    lexicon = spark.sparkContext.broadcast(compile_lexicon(docs, Vocabulary(spec), least_share, remembered))
    shared = spark.sparkContext.broadcast(spec)

    def run(batches):
        enc = _encoder(shared.value, lexicon.value, remembered)
        gc.disable()  # ids and words refer to nothing: there are no cycles to look for
        for batch in batches:
            texts, start = batch.column("bpe_text"), 0
            for group in groups(texts, min(GROUP, remembered // ROOM)):
                n, a, b, all_ids = [], [], [], []
                for ids, decoded in enc.encode(group):
                    n.append(ids.count(",") + 1 if ids else 0)
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids.split(",") if ids else [], np.int32))
                rows = batch.slice(start, len(group))
                start += len(group)
                more = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([rows.column("carried"), *more], ["carried", *names])
        enc.forget()
        gc.enable()
        give_back()

    kinds = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>"] if with_ids else [])]
    rows = docs.select(carried.column, text_or_empty().cast("string").alias("bpe_text"))
    return rows.mapInArrow(run, carried.schema(", ".join(kinds))).select(*carried.fields(), *names)


def op6_query(spark, sf_dir):
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
