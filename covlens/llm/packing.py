"""Vector bin packing of examples into training sequences.

A sequence has three simultaneous limits: tokens, segments (pieces) and
loss-bearing tokens. Open sequences take, of the waiting pieces that fit, the
one whose demand vector has the largest dot product with the room left
(dot-product heuristic); when none fits, the best one is cut to fill the room.
An example is ``tokens`` long and its first ``prompt`` tokens bear no loss, as
in instruction data.

Examples are packed inside the partitions that hold them, in blocks of bounded
size, so nothing is shuffled; what a block leaves in an unfilled sequence goes
on to the next block. A sequence that ends up short is cut into lengths that
are powers of two, which need no padding.

Defined results: null or empty text is one end token; null doc_id is kept;
repeated rows are packed one by one; an empty table gives an empty result; only
the named columns are read, so other columns never clash.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS = 4096
#: Waiting examples at which a block is packed.
BLOCK = 1024
#: Bytes of text cut into words at once.
CHUNK_BYTES = 2 << 20
#: Words whose ids a Python worker remembers, their bytes with their ids, and characters of the longest.
KNOWN_WORDS, KNOWN_BYTES, LONG_WORD = 400_000, 16 << 20, 64
#: Words that are one part for the tokenizer, and a mark right after a letter.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKED = "([a-zß-öø-ÿ])([.,;:!?])"
END_ID = 2

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


class WordIds(dict):
    """Ids of space-separated words, encoded once each: the tokenizer drops white space and never joins words.

    A word's value is its number; the ids of all words stand one after another in ``flat``. The table holds at most
    KNOWN_WORDS words and KNOWN_BYTES bytes of words and ids; beyond either, the half met in fewer chunks is forgotten.
    Words of more than LONG_WORD characters are encoded whenever they occur.
    """

    def __init__(self, tokenizer_path: str, plain_specials: bool = False) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = plain_specials
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_part = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends_part[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.flat, self.used, self.size = np.empty(1 << 18, np.int32), 0, 0
        self.first, self.length, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self) + len(words) > len(self.first):
            self.first, self.length, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.length, self.met))
        self.flat[self.used:self.used + len(ids)] = ids
        n = len(self)
        self.first[n:n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + len(words)] = lengths
        self.met[n:n + len(words)] = 0
        self.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(ids)
        self.size += sum(map(len, words)) + 4 * len(ids)

    def _learn(self, words: list[str]) -> None:
        """Encode new words: those of letters many at once, their ends told by the ids that end a part."""
        simple = [w for w in words if SIMPLE.fullmatch(w)]
        rest = [w for w in words if not SIMPLE.fullmatch(w)]
        if simple:
            groups = [" ".join(simple[i:i + 256]) for i in range(0, len(simple), 256)]
            coded = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in coded])
            self._store(simple, ids, np.diff(np.flatnonzero(self.ends_part[ids]), prepend=-1))
        if rest:
            self._store(rest, *self._coded(rest))

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        coded = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(coded) if coded else np.zeros(0, np.int32), np.array([len(c) for c in coded], np.int64)

    def _forget(self) -> None:
        """Keep the half met in most chunks, in the order learned."""
        n = len(self)
        keep = np.sort(np.argsort(-self.met[:n], kind="stable")[:n // 2])
        words = list(self)
        words, lengths, met = [words[i] for i in keep.tolist()], self.length[keep], self.met[keep]
        ids = self.flat[_places(self.first[keep], lengths)]
        self.clear()
        self.flat, self.used, self.size = np.empty(1 << 18, np.int32), 0, 0
        self._store(words, ids, lengths)
        self.met[:len(words)] = met // 2

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of whole texts (none null)."""
        # The tokenizer reads small letters, and a mark after a letter as a word of its own.
        texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " ")) if not self._special(texts) else pc.replace_substring(texts, "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(texts, MARKED, "\\1 \\2"), " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        if len(self) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self._forget()
        number = np.fromiter(map(self.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = [i for i in np.flatnonzero(number < 0).tolist() if len(distinct[i]) <= LONG_WORD]
        if new:
            self._learn([distinct[i] for i in new])
            number[new] = [self[distinct[i]] for i in new]
        known = np.flatnonzero(number >= 0)
        self.met[number[known]] += 1
        length = np.zeros(len(distinct), np.int64)
        length[known] = self.length[number[known]]
        here = self.flat[_places(self.first[number[known]], length[known])]  # the distinct words' ids, one after another
        first = np.zeros(len(distinct), np.int64)
        first[known] = np.cumsum(length[known]) - length[known]
        if len(known) < len(distinct):
            others = np.flatnonzero(number < 0)
            ids, length[others] = self._coded([distinct[i] for i in others.tolist()])
            first[others] = len(here) + np.cumsum(length[others]) - length[others]
            here = np.concatenate([here, ids])
        occurs = coded.indices.to_numpy()
        ids = here[_places(first[occurs], length[occurs])]
        ends = np.cumsum(length[occurs])
        return np.split(ids, ends[np.cumsum(counts)[:-1] - 1])

    def _special(self, texts: pa.Array) -> bool:
        """A text may spell a special token, in which capitals count."""
        return not self.tokenizer.encode_special_tokens and pc.any(pc.match_substring(texts, "<|")).as_py()


def _places(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first``, one run after another."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _word_ids(tokenizer_path: str, plain_specials: bool) -> WordIds:
    """The word table of this Python worker, kept from task to task."""
    home = sys.modules.setdefault("_covlens_word_ids", ModuleType("_covlens_word_ids"))
    if getattr(home, "path", None) != (tokenizer_path, plain_specials):
        home.path, home.words = (tokenizer_path, plain_specials), WordIds(tokenizer_path, plain_specials)
    return home.words


def pack_block(
    tokens: np.ndarray, prompt: np.ndarray, limits: tuple[int, int, int], last: bool
) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(sequences, rest): lists of (example, first token, tokens taken).

    A sequence is closed when its tokens, segments or loss-bearing tokens are
    used up; ``rest`` is what an unfilled sequence holds when the examples run
    out, unless this is the last block. An example cut in two keeps its order.
    """
    most, segments, most_loss = limits
    left, skip, first = tokens.astype(np.int64).copy(), prompt.astype(np.int64).copy(), np.zeros(len(tokens), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    waiting = len(left)
    while waiting:
        room, seats, gain, seq = most, segments, most_loss, []
        while room and seats and waiting:
            loss = np.maximum(left - skip, 0)
            score = left * (room / most**2) + loss * (gain / most_loss**2) + (left > 0) * (seats / segments**2)
            fits = np.where((left > 0) & (left <= room) & (loss <= gain), score, -1.0)
            i = int(fits.argmax())
            if fits[i] < 0:
                i = int(np.where(left > 0, score, -1.0).argmax())
                take = min(room, int(left[i]), int(skip[i]) + gain)
                if take <= 0:
                    break
            else:
                take = int(left[i])
            seq.append((i, int(first[i]), take))
            room, seats, gain = room - take, seats - 1, gain - max(0, take - int(skip[i]))
            first[i], left[i], skip[i] = first[i] + take, left[i] - take, max(0, skip[i] - take)
            waiting -= not left[i]
        if not seq:  # no example can start a sequence of its own under these limits
            raise ValueError("an example does not fit an empty sequence")
        if not waiting and room and not last and seats:
            return out, seq
        out += [seq] if not room else powers_of_two(seq)
    return out, []


def powers_of_two(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short sequence as sequences whose lengths are powers of two, largest first."""
    total = sum(take for _, _, take in seq)
    out, queue = [], list(reversed(seq))
    for bit in reversed(range(total.bit_length())):
        room, part = (1 << bit) & total, []
        while room:
            i, first, take = queue.pop()
            used = min(room, take)
            part.append((i, first, used))
            room -= used
            if used < take:
                queue.append((i, first + used, take - used))
        if part:
            out.append(part)
    return out


class _Packer:
    """Packs a partition's examples as they come; yields rows of PIECES."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int) -> None:
        self.limits, self.sequence = limits, first_sequence
        self.waiting: list[tuple] = []  # (doc_id, doc_tokens, start, prompt left, ids)
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, prompt: int) -> None:
        most = min(self.limits[0], self.limits[2])
        n, whole = len(ids), len(ids) // most * most
        for start in range(0, whole, most):
            self._emit([((doc_id, n, start, max(0, prompt - start), ids[start:start + most]), 0, most)])
        if n > whole:
            self.waiting.append((doc_id, n, whole, max(0, prompt - whole), ids[whole:].copy()))
        if len(self.waiting) >= BLOCK:
            self.flush(last=False)

    def _emit(self, seq: list[tuple]) -> None:
        offset = 0
        for (doc_id, n, start, prompt, ids), first, take in seq:
            crc = zlib.crc32(ids[first:first + take].astype("<u4").tobytes())
            loss = max(0, first + take - max(prompt, first))
            self.rows.append((doc_id, start + first, take, crc, n, self.sequence, offset, loss))
            offset += take
        self.sequence += 1

    def flush(self, last: bool) -> None:
        if not self.waiting:
            return
        tokens = np.array([len(w[4]) for w in self.waiting])
        prompt = np.array([w[3] for w in self.waiting])
        done, rest = pack_block(tokens, prompt, self.limits, last)
        for seq in done:
            self._emit([(self.waiting[i], first, take) for i, first, take in seq])
        self.waiting = [
            (w[0], w[1], w[2] + first, max(0, w[3] - first), w[4][first:first + take])
            for w, first, take in ((self.waiting[i], first, take) for i, first, take in rest)
        ]

    def batch(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in PIECES.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about CHUNK_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        done = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, done + CHUNK_BYTES)))
        yield batch.slice(first, end - first)
        first = end


def _pack_partition(tokenizer_path: str, limits: tuple[int, int, int], prompt_column: bool, plain_specials: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _word_ids(tokenizer_path, plain_specials)
        packer = _Packer(limits, TaskContext.get().partitionId() << 40)
        for part in (part for batch in batches for part in _chunks(batch)):
            prompts = part.column("prompt").to_pylist() if prompt_column else [1] * part.num_rows
            coded = words.encode(pc.fill_null(part.column("text"), ""))
            for doc_id, prompt, ids in zip(part.column("doc_id").to_pylist(), prompts, coded, strict=True):
                packer.add(doc_id, np.append(ids, np.int32(END_ID)), prompt or 0)
            if len(packer.rows) > 50_000:
                yield packer.batch()
        packer.flush(last=True)
        yield packer.batch()

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS, prompt: str | None = None, plain_specials: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    ``prompt`` names a column with the number of leading tokens that bear no
    loss; without it only the first token, which nothing precedes, bears none.
    ``plain_specials`` cuts a special token's name in a text into ordinary
    pieces; else it becomes the special token's id, as by the tokenizer's default.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompt:
        columns.append(F.col(prompt).cast("long").alias("prompt"))
    run = _pack_partition(tokenizer_path, (max_tokens, max_segments, max_loss), prompt is not None, plain_specials)
    return docs.select(*columns).mapInArrow(lean(run), PIECES)
