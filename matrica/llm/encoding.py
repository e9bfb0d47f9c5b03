"""Encoding and decoding with the files of public tokenizers: byte-pair merges run as a finite-state transducer."""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: how byte_bpe_50k parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a task remembers, and the longest of them in characters.
MEMO_WORDS, MEMO_CHARS = 400_000, 200


#: Token pairs that a transducer remembers.
PAIRS = 2_000_000


class MergeTransducer:
    """Byte-pair merging as a transducer over bytes whose states are made when first met.

    A merge sequence is right exactly if every two neighbours stay apart when merged on their own, so the last
    token of every prefix is the one suffix token that may follow the last token of what is left. A state is the
    last token that was emitted and the bytes since; tokens are emitted as soon as all positions at which a longer
    token may still begin descend from them, which is at most the longest token's length away.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begun = {b[:i] for b in ranks for i in range(1, len(b))}
        self.longest = max(map(len, ranks))
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: list[tuple[int, bytes, tuple]] = [(-1, b"", ((0, -1),))]
        self.numbers: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.endings: dict[int, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank first. Used on the bytes of at most two tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        if b not in self.whole:
            self.whole[b] = self.merged(self.bytes_of[b]) == [b]
        if a < 0 or not self.whole[b]:
            return self.whole[b]
        if (a, b) not in self.apart:
            if len(self.apart) >= PAIRS:  # forget pairs, so that a worker's memory stays bounded
                self.apart.clear()
            self.apart[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.apart[a, b]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and emitted tokens. lasts[i]: (start, last token) of the merged prefix of length i."""
        anchor, pending, lasts = self.states[state]
        pending += bytes((byte,))
        n = len(pending)
        for start in range(max(0, n - self.longest), n):
            token = self.ranks.get(pending[start:])
            if token is not None and lasts[start] is not None and self.may_follow(lasts[start][1] if start else anchor, token):
                lasts = (*lasts, (start, token))
                break
        else:
            lasts = (*lasts, None)  # no token ends here
        live = {n} | {i for i in range(n) if lasts[i] is not None and pending[i:] in self.begun}
        if lasts[n] is None:
            live.discard(n)
        path = set()
        for k, i in enumerate(live):  # positions that all live ones descend from
            up = {i}
            while i:
                i = lasts[i][0]
                up.add(i)
            path = up if not k else path & up
        cut = max(path)
        emitted, i = [], cut
        while i:
            emitted.append(lasts[i][1])
            i = lasts[i][0]
        emitted.reverse()
        if cut:
            anchor, pending = emitted[-1], pending[cut:]
            lasts = ((0, anchor), *((None if x is None or x[0] < cut else (x[0] - cut, x[1])) for x in lasts[cut + 1 :]))
        key = (anchor, pending)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((anchor, pending, lasts))
        return self.numbers[key], tuple(emitted)

    def _ending(self, state: int) -> tuple[int, ...]:
        _, pending, lasts = self.states[state]
        out, i = [], len(pending)
        while i:
            start, token = lasts[i]
            out.append(token)
            i = start
        return tuple(reversed(out))

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one word, in one pass over its bytes."""
        out, state, moves = [], 0, self.moves
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > 1_000_000:  # forget the states of an unusual text
                    kept = self.ranks, self.apart, self.whole, self.begun
                    out_state = self.states[state]
                    self.states, self.numbers = [(-1, b"", ((0, -1),)), out_state], {(-1, b""): 0, out_state[:2]: 1}
                    self.moves.clear(), self.endings.clear()
                    self.ranks, self.apart, self.whole, self.begun = kept
                    state = 1
                move = moves[state << 8 | byte] = self._step(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        if state not in self.endings:
            self.endings[state] = self._ending(state)
        return (*out, *self.endings[state])


class _Words(dict):
    """Tokens of words, made by the transducer when missing."""

    def __init__(self, transducer: MergeTransducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> tuple[int, ...]:
        tokens = self.transducer.encode(word.encode())
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = tokens
        return tokens


class Codec:
    """Texts to ids and back. The empty text and None have no ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.split = regex.compile(pattern).findall
        self.transducer = MergeTransducer(ranks)
        self.words = _Words(self.transducer)

    def stream(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(map(self.words.__getitem__, self.split(text))) if text else iter(())

    def encode(self, text: str | None) -> list[int]:
        return list(self.stream(text))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as soon as their bytes make whole characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.transducer.bytes_of[i]):
                yield piece
        if rest := machine.decode(b"", True):
            yield rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=4)
def load_codec(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Codec:
    """The codec of ``<folder>/<name>.tiktoken``, kept per worker process."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return Codec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode_texts(df: DataFrame, row_id: str, text: str, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """row_id and ids (array<int>) of each row; null and empty texts have the empty array, repeated rows their own.

    Texts stream through Arrow batches; nothing is shuffled. The tokenizer's files must lie in ``folder`` on every
    executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(tokenizer, folder)
        words, split = codec.words.__getitem__, codec.split
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, ends = [], [0]
                for value in part.column(1).to_pylist():
                    if value:
                        ids.extend(chain.from_iterable(map(words, split(value))))
                    ends.append(len(ids))
                values = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(ids, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=[row_id, "ids"])

    rows = df.select(row_id, text)
    return rows.mapInArrow(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, ids array<int>")


def decode_ids(df: DataFrame, row_id: str, ids: str, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """row_id and text of each row of ids; a null array and an empty one give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(tokenizer, folder)
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[row_id, "text"])

    rows = df.select(row_id, ids)
    return rows.mapInArrow(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, text string")
