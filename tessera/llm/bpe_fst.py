"""Byte-level BPE encoding and decoding by lazily determinised transducers.

Encoding.  Every prefix of a byte string has exactly one BPE encoding, and
two neighbouring tokens of an encoding are always the encoding of their own
bytes.  So the last token of each prefix is the one vocabulary entry that
ends there and whose pair with the last token before it re-encodes to
itself.  Reading bytes left to right, a boundary stays open as long as some
vocabulary entry may still extend from it; what follows depends only on the
bytes since the earliest open boundary and on the last token before each
open one, and that is a state.  A transition reads a byte and gives the next
state and the token that ends there.  The chains of last tokens behind the
open boundaries meet within bounded lookahead; the tokens up to that place
are certain and emitted, and the end of the input emits the chain that is
left.  States and transitions are made when first met, in a bounded table.

Decoding.  The state of the decoder is the unfinished UTF-8 sequence;
a token is one transition that yields text and the next state.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tessera.llm.base import id_text, per_process
from tessera.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_STATES = 300_000
MAX_PIECES = 50_000
MAX_WORDS = 300_000
#: Marks that end many words and, after a letter, are a match of their own.
MARKS = frozenset(".,;:!?")
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Merges:
    """How entries of a rank table are merged together; judges token pairs.

    Merging goes by rank, lowest first and leftmost on a tie, so the entry
    at the right edge of a token grows in the order of ranks, and so does
    the one at the left edge of its right neighbour.  Two tokens stay apart
    if at no time the two entries at the seam would merge with each other
    before either of them is merged away from it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two entries whose merge makes ``token``; None if merging its
        bytes never makes it."""
        if token not in self._halves:
            parts = [token[i:i + 1] for i in range(len(token))]
            get, never = self.ranks.get, 1 << 40
            while len(parts) > 2:
                rank, at = min((get(parts[i] + parts[i + 1], never), i) for i in range(len(parts) - 1))
                if rank == never:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def stable(self, before: int, token: int) -> bool:
        """Do the two tokens, side by side, encode to themselves?  With
        ``before`` = -1: does the token alone?"""
        key = (before + 1 << 32) + token
        if key not in self._pairs:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            right = self.bytes_of[token]
            alone = len(right) == 1 or self.halves(right) is not None
            self._pairs[key] = alone and (before < 0 or self._apart(self.bytes_of[before], right))
        return self._pairs[key]

    def _apart(self, left: bytes, right: bytes) -> bool:
        ranks = self.ranks
        left_goes = right_goes = 1 << 40  # rank of the merge that takes the edge entry away
        while True:
            seam = ranks.get(left + right)
            if seam is not None and seam < left_goes and seam <= right_goes:
                return False
            left_made = ranks[left] if len(left) > 1 else -1
            right_made = ranks[right] if len(right) > 1 else -1
            if left_made < 0 and right_made < 0:
                return True
            if left_made > right_made:  # go back to before the younger of the two was made
                left_goes, left = left_made, self.halves(left)[1]
            else:
                right_goes, right = right_made, self.halves(right)[0]


class State(dict):
    """Maps a byte to (next state, token that ends there); fills itself.

    ``key`` is one tuple, as a worker holds very many: the bytes since the
    earliest open boundary (the tail), then for each open boundary its place
    in the tail and the last token before it."""

    __slots__ = ("machine", "key")

    def __init__(self, machine, key: tuple):
        self.machine = machine
        self.key = key

    def __missing__(self, byte: int):
        step = self[byte] = self.machine.advance(self, byte)
        return step


class Encoder:
    """The lazily determinised transducer for one rank table."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, window: int = 4096):
        self.ranks, self.max_states, self.window = ranks, max_states, window
        self.merges = Merges(ranks)
        self.length = {r: len(t) for t, r in ranks.items()}
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}  # proper prefixes of tokens
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(self, (b"", 0, -1))

    def advance(self, state: State, byte: int):
        before, ranks, stable, open_ = state.key, self.ranks, self.merges.stable, self.open
        tail, end, live = before[0] + bytes((byte,)), None, []
        for k in range(1, len(before), 2):
            at, last = before[k], before[k + 1]
            part = tail[at:]
            if end is None:  # exactly one token of the right kind ends here
                token = ranks.get(part)
                if token is not None and stable(last, token):
                    end = token
            if part in open_:
                live += (at, last)
        if end is None:
            raise ValueError(f"no token of the rank table ends at {tail!r}")
        live += (len(tail), end)
        first = live[0]
        if first:
            live[::2] = [at - first for at in live[::2]]
        key = (tail[first:], *live)
        nxt = self.states.get(key)
        if nxt is None:
            nxt = self.states[key] = State(self, key)
        return nxt, end

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-split piece; a piece that is itself an entry
        is that entry."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        out: list[int] = []
        ends: list[int] = []  # the last token of each prefix since the last sure boundary
        state = self.start
        for byte in piece:
            state, token = state[byte]
            ends.append(token)
            if len(ends) >= self.window:
                ends = self.settle(out, ends, state)
                if len(self.states) > self.max_states:
                    self.states = {}  # states in use live on; the rest goes
        return out + self._chain(ends, len(ends))

    def _chain(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.length[ends[at - 1]]
        return out[::-1]

    def settle(self, out: list[int], ends: list[int], state: State) -> list[int]:
        """Emits the tokens up to the boundary where the chains of all open
        boundaries meet: what comes later cannot change them."""
        n = len(ends)
        chains = {n - len(state.key[0]) + at for at in state.key[1::2]}
        while len(chains) > 1:
            top = max(chains)
            chains.remove(top)
            chains.add(top - self.length[ends[top - 1]])
        cut = chains.pop()
        if cut <= 0:
            return ends
        out += self._chain(ends, cut)
        return ends[cut:]


class Pieces(dict):
    """Bounded table of piece -> ids in front of the transducer; frequent
    pieces come early, and what comes once it is full goes through."""

    def __init__(self, encoder: Encoder, limit: int = MAX_PIECES):
        self.encoder, self.limit = encoder, limit

    def __missing__(self, piece: str):
        ids = tuple(self.encoder.encode(piece.encode()))
        if len(piece) <= 64 and len(self) < self.limit:
            self[piece] = ids
        return ids


class Words(dict):
    """Bounded table of what stands between two single spaces -> ids, with
    the space before it; None where the spaces around are not single."""

    def __init__(self, split, pieces: Pieces, limit: int = MAX_WORDS):
        self.split, self.pieces, self.limit = split, pieces, limit

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word.isalpha():  # one match of the pattern
            ids = tuple(self.pieces.encoder.encode(b" " + word.encode()))
        elif word[-1] in MARKS and word[:-1].isalpha():  # two
            return self[word[:-1]] + self.pieces[word[-1]]
        else:
            ids = tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(" " + word))))
        if len(word) <= 64 and len(self) < self.limit:
            self[word] = ids
        return ids


class DecoderState(dict):
    """Maps a token to (text, next state); the state is the unfinished
    UTF-8 sequence read so far."""

    __slots__ = ("machine", "pending")

    def __init__(self, machine, pending: bytes):
        self.machine, self.pending = machine, pending

    def __missing__(self, token: int):
        step = self[token] = self.machine.advance(self.pending, token)
        return step


class Decoder:
    """Streaming decode: ids in, text out, any split of the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.states: dict[bytes, DecoderState] = {}

    def state(self, pending: bytes = b"") -> DecoderState:
        if pending not in self.states:
            self.states[pending] = DecoderState(self, pending)
        return self.states[pending]

    def advance(self, pending: bytes, token: int):
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = machine.decode(pending + self.bytes_of[token])
        return text, self.state(machine.getstate()[0])

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = self.state()
        for token in ids:
            text, state = state[token]
            yield text
        if state.pending:
            yield "\N{REPLACEMENT CHARACTER}"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


class TextEncoder:
    """text -> list of ids, each match of the pattern encoded on its own.

    With the fixed pattern of the public rank files, a single space between
    two characters that are no white space always begins a match, so the
    matches of a text are those of its words, each with its space before
    it.  Texts with other spacing are split as a whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(Encoder(ranks))
        self.words = Words(self.split, self.pieces)

    def __call__(self, text: str) -> list[int]:
        first, *words = text.split(" ")
        if first and not first[0].isspace() and not first[-1].isspace():
            by_word = list(map(self.words.__getitem__, words))
            if None not in by_word:
                head = map(self.pieces.__getitem__, self.split(first))
                return list(chain.from_iterable(chain(head, by_word)))
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = True) -> DataFrame:
    """Ids of every whole text and what they decode to.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (decimal
    ids joined by commas), decoded_sha256 (bytes of the decoded text) and,
    with ``with_ids``, token_ids array<int>.  A null text is encoded as the
    empty one: no ids, digests of nothing.  Null or repeated doc_ids are
    kept as they are; other columns are ignored.  Rows are handled one by
    one without a shuffle, so long texts cost their own length only."""
    schema = DIGEST_SCHEMA + (", token_ids array<int>" if with_ids else "")
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, decoder, names = per_process(
            ("bpe", hash(frozenset(ranks.items())), pattern),
            lambda: (TextEncoder(ranks, pattern), Decoder(ranks), {r: str(r) for r in ranks.values()}))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, ids_hash, text_hash, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = to_ids(text or "")
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decoder.decode(ids).encode()).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = pa.array([0, *_running(counts)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
                    fields.append("token_ids")
                yield pa.RecordBatch.from_arrays(cols, fields)

    return id_text(docs).mapInArrow(encode, schema)


def _running(counts: list[int]) -> list[int]:
    out, total = [], 0
    for c in counts:
        total += c
        out.append(total)
    return out
