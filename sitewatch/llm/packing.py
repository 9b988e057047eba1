"""Token pieces and sum-of-squares packing (operator 5).

``pieces`` tokenizes whole texts.  The vocabulary's normalizer and pattern never
look across white space, so a text's ids are those of its blank-separated words
in order; each distinct word goes through the tokenizer once a worker (words of
plain letters, with ASCII marks behind them or without, through its model alone:
normalizer and pattern leave them whole).

``pack`` deals the pieces into shards of a set size by a hash of their place in
the written piece table, and packs each shard alone: a piece goes where the sum
over residual gaps of the squared number of open sequences with that gap becomes
smallest (an open sequence of any gap that fits, or a new one; ties go to the
smallest gap, then to an open one).  A shard is packed in hash order and in
order of falling length, and the better result is kept; then the pieces of the
sequences left open are taken out and packed again while that saves sequences.
Every shard leaves some open sequences, so ``SHARD`` is large.

Defined cases: null and empty texts are one piece with the end id alone; rows
that repeat are packed each; an empty table gives no pieces; other columns of
the table stay out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, filterfalse
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize

from .common import in_arrow, ship_package, strings, table

CAPACITY = 2048
SHARD = 60_000             # pieces packed together
KNOWN_WORDS = 1_000_000     # words a worker remembers; beyond it starts anew (only speed depends on it)
TOGETHER = 1 << 20         # characters whose new words are learned together
_BEYOND = re.compile(r"[^\x00-įı-ɏ]")
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower() and not _BEYOND.search(c))
_PLAIN = re.compile(rf"([{_LATIN}]+)([!-/:-@\[-`{{-~]*)").fullmatch      # plain small letters, ASCII marks behind them
_SEPARATORS = re.compile(r"[\x1c-\x1f]")    # white space to str.split, not to the vocabulary


def _byte_letters() -> dict[int, str]:
    """The plain letters beyond ASCII as the letters that stand for their bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {ord(c): "".join(letter[b] for b in c.encode()) for c in _LATIN if not c.isascii()}


_BYTES = _byte_letters()


def _ends_in_a_letter(word: str) -> bool:
    """True if no normal form turns the last letter into one with a mark behind it."""
    return not _BEYOND.search(word) or all(
        unicodedata.normalize(form, w)[-1].isalpha() for w in (word[-1], word[-1].lower()) for form in ("NFC", "NFKC"))


class Words:
    """Ids of words by one tokenizer file, as bytes of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True     # their strings are ordinary text
        # words of plain small letters are what normalizer and pattern make of them: the model takes their bytes
        self.letters = Tokenizer.from_file(path).model
        self.letters._resize_cache(0)                   # each word comes once
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        # lower case letter by letter, as the vocabulary's normalizer does, where both agree for certain
        text = text if _BEYOND.search(text) else text.lower()
        return regex.findall(r"\P{White_Space}+", text) if _SEPARATORS.search(text) else text.split()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(self.split(text))
            size += len(text)
            if size >= TOGETHER or i == len(texts) - 1:
                self._learn(set(filterfalse(self.known.__contains__, chain.from_iterable(group))))
                for words in group:
                    yield b"".join(map(self.known.__getitem__, words))
                group, size = [], 0

    def _learn(self, new: set[str]) -> None:
        # marks behind letters are a token run of their own: any in ASCII where the letters are plain,
        # a full stop or comma where the normal form ends in a letter, too
        marked, plain, rest = [], set(), []
        for w in new:
            if m := _PLAIN(w):
                stem, marks = m.groups()
                plain.add(stem)
                if marks:
                    marked.append((w, stem, marks))
                    rest.append(marks)
            elif w[-1] in ".," and w[:-1].isalpha() and _ends_in_a_letter(w[:-1]):
                marked.append((w, w[:-1], w[-1]))
                rest += [w[:-1], w[-1]]
            else:
                rest.append(w)
        known, tokenize = self.known, self.letters.tokenize
        for w in plain.difference(known):
            known[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(_BYTES))]).tobytes()
        words = list(set(rest).difference(known))
        for a in range(0, len(words), 4096):
            part = words[a:a + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        for w, stem, marks in marked:
            known[w] = known[stem] + known[marks]


_words: dict[str, Words] = {}


def pieces(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place[, ids]): each text's ids and ``end_id``, cut at ``capacity``.

    ``place`` numbers the pieces by task and row, in the order of the input's files.
    """
    given = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _words:
            _words[tokenizer_path] = Words(tokenizer_path)
        first = TaskContext.get().partitionId() << 33
        n = 0
        for batch in batches:
            docs, rows, data = [], [], []
            for i, ids in enumerate(_words[tokenizer_path].ids(strings(batch.column(1)))):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a:a + 4 * capacity]
                    docs.append(i)
                    rows.append((k, a // 4, len(part) // 4, zlib.crc32(part), first + n))
                    n += 1
                    if with_ids:
                        data.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            cols = list(zip(*rows)) or [()] * 5
            out = [batch.column(0).take(pa.array(docs, pa.int64())), pa.array(cols[0], pa.int32()),
                   *(pa.array(c, pa.int64()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(data, pa.list_(pa.int64()))] if with_ids else []), names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long"
    return in_arrow(given, run, schema + ", ids array<long>" * with_ids)


def _place_all(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers, pieces taken in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)      # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out: list[list[int]] = []
    for n, s in enumerate(lengths):
        gaps = count[s:capacity]
        change = 2 * (count[:capacity - s] - gaps) + 2
        if s < capacity:
            change[0] = 1 - 2 * gaps[0]                 # fills it: no gap is left
            change[gaps == 0] = 1 << 60
            at = int(change.argmin())
        if s < capacity and change[at] <= 2 * count[capacity - s] + 1:
            seq = open_[s + at].pop()
            count[s + at] -= 1
            left = at
        else:
            seq = len(out)
            out.append([])
            left = capacity - s
        out[seq].append(n)
        if left:
            open_[left].append(seq)
            count[left] += 1
    return out


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of piece numbers."""
    def packed(numbers: np.ndarray) -> list[list[int]]:
        orders = (numbers, numbers[np.argsort(-lengths[numbers], kind="stable")])
        tries = [[[int(o[i]) for i in seq] for seq in _place_all(lengths[o].tolist(), capacity)] for o in orders]
        return min(tries, key=len)

    done = packed(np.arange(len(lengths)))
    while True:
        fill = np.array([lengths[seq].sum() for seq in done])
        again = [i for i in range(len(done)) if fill[i] < capacity]
        if not again:
            return done
        redone = packed(np.concatenate([done[i] for i in again]).astype(np.int64))
        if len(redone) >= len(again):
            return done
        done = [seq for i, seq in enumerate(done) if fill[i] == capacity] + redone


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``parts`` (columns length and place at least) with sequence_id and offset."""
    parts = materialize(parts, "pieces")        # from here on a piece has one place, whatever is computed anew
    n = max(1, ceil(parts.count() / shard))
    ship_package(parts.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__order", kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        seq = np.empty(len(frame), dtype=np.int64)
        offset = np.empty(len(frame), dtype=np.int64)
        for i, members in enumerate(sum_of_squares(lengths, capacity)):
            seq[members] = i
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        frame["sequence_id"] = (frame["__shard"].to_numpy().astype(np.int64) << 32) + seq
        frame["offset"] = offset
        return frame.drop(columns=["__shard", "__order"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    dealt = parts.withColumns({"__order": F.xxhash64("place"), "__shard": F.pmod(F.xxhash64("place", F.lit(1)), F.lit(n))})
    return dealt.groupBy("__shard").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P
    return pack(pieces(docs, P.path("word_bpe_49k.json"))).drop("place")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
