"""Problem 7: the whole corpus as token ids of a public byte-level BPE, and back."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: States kept before the lazily built transducer is cleared, also inside a piece.
MAX_STATES = 200_000
#: Whole pieces kept with their ids; longer pieces are always walked.
MAX_PIECES, PIECE_BYTES = 200_000, 48


#: The bytes since the first open place; of each open place its distance, its last token (-1 at the start) and its tokens not emitted yet.
State = tuple[bytes, tuple[tuple[int, int, tuple[int, ...]], ...]]


class MergeTransducer:
    """The merges of a byte-level BPE as a finite-state transducer, determinised on demand.

    A sequence of tokens is the one that the merges give exactly if each pair of neighbours stays a pair when it is
    encoded alone. So the last token after a prefix is settled by the prefix: it is the longest token that ends there and
    agrees with the last token before it. A later token can begin only at a place from which what has been read so far is
    the beginning of some token; these open places, each with its distance, its last token and the tokens up to it that
    are not emitted yet, make a state, whatever was read before. A transition is worked out when it is first taken.
    Tokens on which all open places agree are emitted at once: a place stays open for less than longest bytes, and
    the paths to open places part only shortly before them (bounded lookahead of merge tokenisers is known in the
    literature). All states but the current one are dropped when there are more than max_states.
    """

    def __init__(self, vocabulary: str, max_states: int = MAX_STATES):
        with open(vocabulary, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.longest = max(map(len, self.ids))
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.max_states = max_states
        self.agrees = lru_cache(maxsize=1_000_000)(self._agrees)
        self.whole = {b: i for b, i in self.ids.items() if self._merged(b) == [b]}
        self.begun = {b[:n] for b in self.whole for n in range(1, len(b))}
        self._clear()

    def _clear(self) -> None:
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.open: list[State] = []
        self.states: dict[State, int] = {}
        self._state((b"", ((0, -1, ()),)))

    def _state(self, key: State) -> int:
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = len(self.open)
            self.step.append({})
            self.open.append(key)
        return known

    def _merged(self, text: bytes) -> list[bytes]:
        """The merges applied in order of rank to a short string."""
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            ranked = [(self.ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(ranked)
            if best == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _agrees(self, left: int, right: int) -> bool:
        a, b = self.bytes_of[left], self.bytes_of[right]
        return self._merged(a + b) == [a, b]

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after the byte and the tokens emitted on the way."""
        tail, places = self.open[state]
        tail += bytes([byte])
        ended = None
        still = []
        for size, last, waiting in places:
            piece = tail[len(tail) - size - 1 :]
            token = self.whole.get(piece)
            if ended is None and token is not None and (last < 0 or self.agrees(last, token)):
                ended = (0, token, (*waiting, token))
            if piece in self.begun:
                still.append((size + 1, last, waiting))
        if ended is None:
            raise ValueError("a byte is missing in the vocabulary")
        still.append(ended)
        paths = [waiting for _, _, waiting in still]
        n = 0
        while all(len(w) > n for w in paths) and len({w[n] for w in paths}) == 1:
            n += 1
        key = (tail[len(tail) - still[0][0] :] if still[0][0] else b"", tuple((size, last, w[n:]) for size, last, w in still))
        if len(self.open) > self.max_states:
            self._clear()
            return self._state(key), paths[0][:n]
        self.step[state][byte] = to = self._state(key), paths[0][:n]
        return to

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state = 0
        for byte in piece:
            state, emitted = self.step[state].get(byte) or self._advance(state, byte)
            if emitted:
                out += emitted
        out += self.open[state][1][-1][2]
        return out


class Encoder:
    """Splits a text into pieces and sends each through the transducer; short pieces are remembered."""

    def __init__(self, vocabulary: str):
        import regex

        self.split = regex.compile(SPLIT)
        self.transducer = MergeTransducer(vocabulary)
        self.pieces: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.pieces
        for m in self.split.finditer(text):
            piece = m.group()
            got = known.get(piece)
            if got is None:
                raw = piece.encode("utf-8", "surrogatepass")
                got = self.transducer.encode(raw)
                if len(raw) <= PIECE_BYTES:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[piece] = got
            out += got
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One to a Python worker."""
    return Encoder(vocabulary)


def token_ids(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The ids of a text without special tokens, whose strings are ordinary text; an empty and a null text give an empty list."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([own.ids(t) for t in texts], dtype=object)

    return encode(text)


def token_text(ids: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a list of ids: bytes go through an incremental UTF-8 state machine, token by token; a null list gives null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary).transducer.bytes_of
        for lists in batches:
            out = []
            for x in lists:
                machine = codecs.getincrementaldecoder("utf-8")("replace")
                out.append(None if x is None else "".join(machine.decode(own[i]) for i in x) + machine.decode(b"", True))
            yield pd.Series(out, dtype=object)

    return decode(ids)


def encode_corpus(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids of every row; repeated rows count each, an empty table gives an empty result, other columns are ignored."""
    return documents.select(key, token_ids(F.col(text), vocabulary).alias("ids"))
