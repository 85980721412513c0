"""Packing token streams into windows: cuts at document or sentence ends, found by dynamic programming.

Documents are dealt out by ranges of doc_id and sorted, so every task packs one stretch of the corpus in order, a few
million tokens at a time; the last window of a stretch is carried over into the next one. Tokens never leave the task.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix, powers, prefix_sums, utf8_rows

#: Costs in tokens of padding: a cut at a sentence end, a cut elsewhere. Stretches without a sentence end of more than GAP
#: tokens may be cut every GAP // 2 tokens.
SENTENCE_CUT, HARD_CUT, GAP = 8, 64, 64
#: Tokens that one dynamic programme covers, characters encoded together, words a task remembers, end-of-document id.
STRETCH, GROUP, REMEMBERED, END_ID = 1 << 20, 3 << 20, 1_000_000, 1
#: Marks that never join the letters before them in one token.
_MARKS = ".,!?;:*$%&#"


class WordTable:
    """Numbers of words by their hashes, in an open table; a hit must also have the word's last eight bytes."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.tails, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Numbers; -1: unknown, -2: another word has the hash."""
        at = self._places(keys)
        out = self.numbers[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[left] = self.numbers[at]
            on = (out[left] >= 0) & (self.keys[at] != keys[left])
            left, at = left[on], at[on]
        known = np.flatnonzero(out >= 0)
        clash = known[self._tails_of(keys[known]) != tails[known]]
        out[clash] = -2
        return out

    def _tails_of(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            left = left[self.keys[at[left]] != keys[left]]
        return self.tails[at]

    def add(self, keys: np.ndarray, tails: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            held = np.flatnonzero(self.numbers >= 0)
            old = self.keys[held], self.tails[held], self.numbers[held]
            self.__init__(max(self.bits + 1, int(4 * (self.used + len(keys))).bit_length()))
            self._place(*old)
        self._place(keys, tails, numbers)

    def _place(self, keys: np.ndarray, tails: np.ndarray, numbers: np.ndarray) -> None:
        self.used += len(keys)
        at, left = self._places(keys), np.arange(len(keys))
        while len(left):
            free = left[self.numbers[at[left]] < 0]
            spots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[spots], self.tails[spots], self.numbers[spots] = keys[won], tails[won], numbers[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


class WordEncoder:
    """Token ids of texts by way of their words; exact where the tokenizer never joins characters across a space or newline.

    Distinct words are encoded by the tokenizer once and remembered. Many go into one call, with the special token
    ``separator`` between them. When too many are remembered, those that were met only once are forgotten.

    Texts are cut into words as bytes, and words are looked up by hash: only new ones become strings.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.separator = Tokenizer.from_file(path), separator
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.plain = self._plain(path)
        self.table = WordTable()  # words to their numbers
        self.words: dict[bytes, int] = {}  # words whose hash belongs to another one
        self.pieces: dict[str, tuple[int, int]] = {"": (0, 0)}  # to a place in flat and a number of ids
        # By number: place and count of its two pieces, whether it closes a sentence, how often it was met.
        self.flat, self.codes, self.closes, self.met = array("I"), array("q"), bytearray(), np.zeros(1, np.int64)

    def _plain(self, path: str):  # noqa: ANN202
        """The same merges without normaliser, for lower-case words of Latin-1 letters, which it would leave as they are; None
        where words do not end in tokens of their own kind."""
        from tokenizers import Tokenizer

        made = json.loads(Path(path).read_text())
        suffix = made["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for t, i in made["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_]}, "post_processor": None}))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts without special tokens go many to a call."""
        found: dict[str, np.ndarray] = {}
        others = [] if self.separator_id is None else [t for t in texts if t not in found and "<|" not in t]
        for lo in range(0, len(others), 500):
            ids = np.array(self.tokenizer.encode_batch_fast([self.separator.join(others[lo : lo + 500])], add_special_tokens=False)[0].ids, np.uint32)
            cuts = [-1, *np.flatnonzero(ids == self.separator_id).tolist(), len(ids)]
            found.update(zip(others[lo : lo + 500], [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return [found[t] if t in found else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]

    def _forget(self) -> None:
        """Keep the words that were met again since the last time, or none if those are too many as well."""
        again = np.flatnonzero(self.met[: len(self.closes)] > 1)
        again = again if len(again) < REMEMBERED // 2 else again[:0]
        number = np.full(len(self.closes), -1)
        number[again] = np.arange(len(again))
        codes = np.frombuffer(self.codes, np.int64).reshape(-1, 2, 2)[again]
        place, count = codes[:, :, 0].ravel(), codes[:, :, 1].ravel()
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.frombuffer(self.flat, np.uint32)[np.repeat(place - (ends - count), count) + np.arange(total)]
        codes = np.stack([ends - count, count], 1).ravel()
        closes = np.frombuffer(self.closes, np.uint8)[again].tobytes()
        held = np.flatnonzero(self.table.numbers >= 0)
        held = held[number[self.table.numbers[held]] >= 0]
        old, self.table = self.table, WordTable()
        self.table.add(old.keys[held], old.tails[held], number[old.numbers[held]])
        self.words = {w: int(number[k]) for w, k in self.words.items() if number[k] >= 0}
        self.flat, self.codes, self.closes, self.pieces = array("I"), array("q"), bytearray(closes), {"": (0, 0)}
        self.flat.frombytes(flat.tobytes())
        self.codes.frombytes(codes.astype(np.int64).tobytes())
        self.met = np.zeros(len(again) + 1, np.int64)

    def _learn(self, words: list[bytes], easy: np.ndarray) -> np.ndarray:
        """Numbers of new words. Easy ones, lower-case words of Latin-1 letters, are one piece and need no second look; others are
        two: letters and what else comes first, and marks that end them."""
        numbers = np.arange(len(self.closes), len(self.closes) + len(words))
        codes = np.zeros((len(words), 2, 2), np.int64)
        hard = np.arange(len(words)) if self.plain is None else np.flatnonzero(~easy)
        easy = np.flatnonzero(easy) if self.plain is not None else hard[:0]
        for lo in range(0, len(easy), 500):
            group = easy[lo : lo + 500]
            text = b" ".join([words[k] for k in group.tolist()]).decode()
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.concatenate([[0], np.flatnonzero(self.closing[ids]) + 1])
            codes[group, 0, 0], codes[group, 0, 1] = cuts[:-1] + len(self.flat), np.diff(cuts)
            self.flat.frombytes(ids.tobytes())
        texts = [words[k].decode() for k in hard.tolist()]
        pieces, flat = self.pieces, self.flat
        firsts: list[str] = []
        lasts: list[str] = []
        for w in texts:
            first = w.rstrip(_MARKS)
            if not first[-1:].isalpha():
                first = w
            firsts.append(first)
            lasts.append(w[len(first) :])
        new = [t for t in dict.fromkeys(chain(firsts, lasts)) if t not in pieces]
        for piece, ids in zip(new, self._encode(new), strict=True):
            pieces[piece] = len(flat), len(ids)
            flat.frombytes(ids.tobytes())
        if len(hard):
            codes[hard] = np.array([(pieces[a], pieces[b]) for a, b in zip(firsts, lasts, strict=True)])
        self.codes.frombytes(codes.tobytes())
        closes = np.zeros(len(words), np.uint8)
        closes[hard] = [w[-1] in ".!?" for w in texts]
        self.closes.extend(closes.tobytes())
        return numbers

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, how many each text has, and the positions behind words that close a sentence."""
        return self.encode_bytes(*utf8_rows(pa.array(texts, pa.large_string())))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for texts given as UTF-8 bytes and the offsets of the rows."""
        if len(self.closes) > REMEMBERED:
            self._forget()
        start, end, row, plain, folded = words_of(data, offsets)
        sums = prefix_sums(folded)
        key = mix((sums[end] - sums[start]) * powers(len(folded) + 1)[1][start] + (end - start).astype(np.uint64))
        padded = np.concatenate([np.zeros(8, np.uint8), folded])
        tail = np.lib.stride_tricks.as_strided(padded[: len(folded) + 1].view(np.uint8), (len(folded) + 1, 8), (1, 1))[end].view(np.uint64).ravel() if len(end) else key
        # Bytes in front of a word of less than eight are not its own.
        tail &= ~np.uint64(0) << ((8 - np.minimum(end - start, 8)) * 8).astype(np.uint64)
        at = self.table.find(key, tail)
        new = np.flatnonzero(at == -1)
        if len(new):
            names, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            alike = tail[new] == tail[new[first]][back]
            raw, lo, hi = folded.tobytes(), start[new[first]], end[new[first]]
            other = np.concatenate([[0], np.cumsum(~_LETTER[folded])])
            numbers = self._learn([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], (other[hi] == other[lo]) & plain[new[first]])
            self.table.add(names, tail[new[first]], numbers)
            at[new] = np.where(alike, numbers[back], -2)
        clash = np.flatnonzero(at == -2).tolist()
        at[clash] = self._by_text([folded[start[k] : end[k]].tobytes() for k in clash])
        if len(self.met) < len(self.closes) + 1:
            self.met = np.concatenate([self.met, np.zeros(len(self.closes) + 1, np.int64)])
        self.met += np.bincount(at, minlength=len(self.met))
        code = np.frombuffer(self.codes, np.int64).reshape(-1, 2, 2)[at]
        place, length = code[:, :, 0].ravel(), code[:, :, 1].ravel()
        second = length[1::2].any()
        if not second:
            place, length = place[::2], length[::2]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(place - (ends - length), length) + np.arange(total)]
        ends = ends[1::2] if second else ends
        at_word = np.searchsorted(row, np.arange(len(offsets)))
        at_id = np.concatenate([[0], ends])[at_word]
        return ids, np.diff(at_id), ends[np.frombuffer(self.closes, bool)[at]]

    def _by_text(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            self.words.update(zip(new, self._learn(new, np.zeros(len(new), bool)).tolist(), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))


# Kinds of bytes of plain words: 0 others, 1 letters and digits, 2 spaces, 3 marks, 4 first and 5 second byte of a letter.
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[[32, 10]] = 2
_KIND[[44, 46]] = 3
_KIND[0xC3] = 4
_KIND[0x80:0xC0] = 5
#: Bytes of letters within plain words.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:0xC0] = _LETTER[0xC3] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of what the tokenizer can encode apart, in order; whether they are of plain runs; and the bytes, in lower case where it makes no
    difference (every character of Latin-1 has its lower case whatever stands next to it; special tokens stay as they are).

    Runs between spaces and newlines are plain if they consist of ASCII letters and digits, letters from À to ÿ, and points and
    commas that do not stand next to each other: then every mark and every run between marks is a word. Other runs are one word.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none.astype(bool), data
    kind = _KIND[data]
    before = np.concatenate([[np.uint8(2)], kind[:-1]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    bad = (kind == 0) | ((kind == 5) & ((before != 4) | (data == 0x97) | (data == 0xB7))) | ((kind == 3) & (before == 3) & ~edge[:-1])
    folded = _SMALL[data]
    folded[np.flatnonzero((kind == 5) & (before == 4) & (data < 0x9F) & (data != 0x97))] += 32
    word, mark = (kind == 1) | (kind >= 4), kind == 3
    first = mark | (word & (edge[:-1] | (before == 2) | (before == 3)))
    following = np.append(kind[1:], np.uint8(2))
    last = mark | (word & (edge[1:] | (following == 2) | (following == 3)))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    plain = np.ones(len(start), bool)
    if bad.any():
        solid = kind != 2
        run_start = np.flatnonzero(solid & (edge[:-1] | (before == 2)))
        run_end = np.flatnonzero(solid & (edge[1:] | (following == 2))) + 1
        odd = np.unique(np.searchsorted(run_start, np.flatnonzero(bad), "right") - 1)
        is_odd = np.zeros(len(run_start), bool)
        is_odd[odd] = True
        start = start[~is_odd[np.searchsorted(run_start, start, "right") - 1]]
        end = end[~is_odd[np.searchsorted(run_start, end - 1, "right") - 1]]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for k in np.unique(np.searchsorted(run_start, special, "right") - 1).tolist():
            folded[run_start[k] : run_end[k]] = data[run_start[k] : run_end[k]]
        place = np.searchsorted(start, run_start[odd])
        plain = np.insert(np.ones(len(start), bool), place, False)
        start, end = np.insert(start, place, run_start[odd]), np.insert(end, place, run_end[odd])
    return start, end, np.searchsorted(offsets, start, "right") - 1, plain, folded


def best_cuts(ends: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Cut positions from 0 to the last of ``ends`` with the least padding plus penalties; neighbours are at most ``size`` apart.

    cost[j] = penalty[j] + min over i of cost[i] + size - (ends[j] - ends[i]); the minimum of cost[i] + ends[i] over the sliding
    window of possible i is the head of a monotone queue.
    """
    at, back = [0, *ends.tolist()], [0]
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost[i] + ends[i], increasing; i; ends[i]
    for j, (here, fee) in enumerate(zip(at[1:], penalty.tolist(), strict=True), 1):
        while queue[0][2] < here - size:
            queue.popleft()
        key, i, _ = queue[0]
        back.append(i)
        key += fee + size  # cost[j] + ends[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, here))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return [0, *cuts[::-1]]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct values of two sorted arrays, sorted."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts and their penalties: document ends are free, sentence ends cheap, and long stretches get hard cuts."""
    natural = merged(doc_ends, sentence_ends)
    before = np.concatenate([[0], natural[:-1]])
    wide = np.flatnonzero(natural - before > GAP)
    extra = [np.arange(before[k] + GAP // 2, natural[k], GAP // 2) for k in wide]
    ends = merged(natural, np.concatenate(extra)) if extra else natural
    penalty = np.full(len(ends), HARD_CUT, np.int64)
    penalty[np.searchsorted(ends, natural)] = SENTENCE_CUT
    penalty[np.searchsorted(ends, doc_ends)] = 0
    return ends, penalty


def last_cuts(begin: int, end: int, size: int) -> list[int]:
    """Cuts of the last window: whole, or in powers of two, which need no padding, where that costs less."""
    length = end - begin
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    if size - length <= HARD_CUT * (len(bits) - 1):
        return [end]
    return (begin + np.cumsum(bits)).tolist()


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Stretch:
    """The tokens of consecutive documents that wait for a window."""

    def __init__(self, size: int, first_id: int):
        self.size, self.sequence = size, first_id
        self.ids: list[np.ndarray] = []
        self.closes: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # doc_id, its tokens before, tokens here, all its tokens
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, closes: np.ndarray) -> None:
        self.ids.append(ids)
        self.closes.append(closes + self.tokens)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.tokens += len(ids)

    def close(self, final: bool) -> pa.RecordBatch:
        """Pieces of all windows; but for the last stretch, the last window stays."""
        ids, closes = np.concatenate(self.ids), np.concatenate(self.closes)
        before, here, total = (np.array([d[k] for d in self.docs], np.int64) for k in (1, 2, 3))
        doc_ends = np.cumsum(here)
        ends, penalty = candidates(doc_ends, closes[(closes > 0) & (closes < self.tokens)])
        cuts = best_cuts(ends, penalty, self.size)
        cuts = [*cuts[:-1], *last_cuts(cuts[-2], cuts[-1], self.size)] if final else cuts[:-1]
        done = cuts[-1]
        doc_starts = doc_ends - here
        edges = merged(np.array(cuts), doc_starts[doc_starts < done])
        begin, end = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(doc_starts, begin, "right") - 1, np.searchsorted(cuts, begin, "right") - 1
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        columns = [
            pa.array([self.docs[k][0] for k in doc], pa.int64()), pa.array(before[doc] + begin - doc_starts[doc], pa.int64()), pa.array(end - begin, pa.int64()), pa.array(crc, pa.int64()),
            pa.array(total[doc], pa.int64()), pa.array(self.sequence + seq, pa.int64()), pa.array(begin - np.array(cuts)[seq], pa.int64()),
        ]
        self.sequence += len(cuts) - 1
        k = int(np.searchsorted(doc_ends, done, "right"))
        if k < len(self.docs):
            name, offset, length, whole = self.docs[k]
            gone = done - int(doc_starts[k])
            self.docs = [(name, offset + gone, length - gone, whole), *self.docs[k + 1 :]]
        else:
            self.docs = []
        self.ids, self.closes, self.tokens = [ids[done:]], [closes[closes > done] - done], self.tokens - done
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


_encoders: dict[str, WordEncoder] = {}


def _cut_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of about GROUP bytes; a longer text comes in pieces that end in front of a space."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= GROUP:
            yield lo, hi - lo, data[a:b], offsets[lo : hi + 1] - a
        else:  # one row
            while a < b:
                cut = min(a + GROUP, b)
                while cut < b and data[cut] not in (32, 10):
                    gap = np.flatnonzero((data[cut : min(cut + 4096, b)] == 32) | (data[cut : min(cut + 4096, b)] == 10))
                    cut = cut + int(gap[0]) if len(gap) else min(cut + 4096, b)
                yield lo, 1, data[a:cut], np.array([0, cut - a])
                a = cut
        lo = hi


def _packer(path: str, size: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        stretch = Stretch(size, TaskContext.get().partitionId() << 40)
        closing = np.array([end_id], np.uint32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            waiting: list[tuple[int, np.ndarray, np.ndarray]] = []  # pieces of one text

            def flush() -> Iterator[pa.RecordBatch]:
                if waiting:
                    before = np.cumsum([0, *[len(ids) for _, ids, _ in waiting]])
                    stretch.add(names[waiting[0][0]], np.concatenate([*[ids for _, ids, _ in waiting], closing]), np.concatenate([c + b for (_, _, c), b in zip(waiting, before[:-1], strict=True)]))
                    waiting.clear()
                    if stretch.tokens >= STRETCH:
                        yield stretch.close(final=False)

            for first, rows, data, offsets in _cut_rows(*utf8_rows(batch.column("text"))):
                ids, counts, closes = encoder.encode_bytes(data, offsets)
                ends = np.cumsum(counts)
                marks = np.searchsorted(closes, np.concatenate([[0], ends]), "right")
                for k in range(rows):
                    if waiting and waiting[0][0] != first + k:
                        yield from flush()
                    begin = int(ends[k] - counts[k])
                    waiting.append((first + k, ids[begin : ends[k]], closes[marks[k] : marks[k + 1]] - begin))
            yield from flush()
        if stretch.tokens:
            yield stretch.close(final=True)

    return pack_batches


def pack(documents: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a window of at most ``size`` tokens.

    Every row of ``documents`` is a document of its own, ended by ``end_id``; null and empty texts are that id alone. A null doc_id
    stays null. Documents keep the order of doc_id within a range; rows with one doc_id, or without one, are ordered by a hash of
    the text, which also deals very many of them over several ranges. An empty
    table gives an empty table. Other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("place", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").select("doc_id", "text")
    return ranged.mapInArrow(_packer(tokenizer_path, size, end_id), SCHEMA)
