"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Merging by rank has a left-to-right form: the last token of the encoding of each prefix is the
one vocabulary suffix that may follow the last token of the prefix before it, where two tokens
may follow each other if merging their joint bytes gives just the two back. The transducer
reads bytes and keeps those last tokens only for the bytes that a later token could still
reach. Once all such places agree on a boundary, the tokens before it are emitted; what is
pending is never longer than the longest run of vocabulary prefixes. A state is the last
emitted token and the pending bytes; states and moves are made when first needed and kept.

Whether two tokens may follow each other is found by undoing their merges, latest first, until
one across the boundary would have come earlier, or none is left.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx

#: States, pairs and pieces that a Python worker keeps at most.
MAX_STATES = 20_000
MAX_PAIRS = 100_000
MAX_PIECES = 340_000
#: Longer pieces are not kept.
LONG_PIECE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class _State:
    __slots__ = ("final", "last", "live", "moves", "pending", "tails")

    def __init__(self, last: int, pending: bytes, tails: list[int], live: list[tuple[int, int]]):
        #: tails[i]: last token of the encoding of the first i + 1 pending bytes. live: the pending places from which a token goes on, first ones first, each with its node.
        self.last, self.pending, self.tails, self.live, self.moves, self.final = last, pending, tails, live, {}, None


class Transducer:
    """Encodes one piece (a match of the split pattern) of bytes.

    At most ``MAX_STATES`` states are made; from there on a run that meets a missing move goes
    on over the undetermined places themselves, with the same result.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tokens that merging their own bytes gives; no other can stand in an encoding.
        tokens, halves = {}, {}
        for token, rank in ranks.items():
            last: list[bytes] = []
            if self._merged(token, last) == [rank]:
                tokens[token] = rank
                if last:
                    halves[rank] = tuple(ranks[x] for x in last)
        #: The last merge of each such token, and what it gives; unless merges always come in the order of ranks, none are used.
        self.halves, self.joint = halves, {a << 32 | b: rank for rank, (a, b) in halves.items()}
        self.ordered = all(rank > max(pair) for rank, pair in halves.items())
        #: A trie of them: node and byte to the next node, or to the inverted token where none is longer; of each node the token that ends there, or -1.
        trie: dict[int, int] = {}
        self.token_at, goes_on = array("i", (-1,)), bytearray(1)
        for token, rank in tokens.items():
            node = 0
            for byte in token:
                goes_on[node] = 1
                node = trie.setdefault(node << 8 | byte, len(goes_on))
                if node == len(goes_on):
                    self.token_at.append(-1)
                    goes_on.append(0)
            self.token_at[node] = rank
        self.trie = {key: node if goes_on[node] else ~self.token_at[node] for key, node in trie.items()}
        self.states: dict[tuple[int, bytes], _State] = {}
        self.pairs: dict[int, bool] = {}
        self.start = _State(-1, b"", [], [])

    def _merged(self, raw: bytes, last: list[bytes] | None = None) -> list[int]:
        """Plain merging by rank, for the short strings of one or two tokens; ``last`` gets the two parts of the last merge."""
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        joint = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while joint:
            least = min(joint)
            if least == none:
                break
            at = joint.index(least)
            if last is not None:
                last[:] = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at < len(joint):
                joint[at] = get(parts[at] + parts[at + 1], none)
            if at:
                joint[at - 1] = get(parts[at - 1] + parts[at], none)
        return [get(p) for p in parts]

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self._stay_apart(a, b) if self.ordered else self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across the boundary comes before those that make ``a`` and ``b``.

        Of equal merges the left one comes first, so one across the boundary precedes an equal one in ``b`` and follows one in ``a``.
        """
        joint, halves, limit = self.joint.get, self.halves.get, 1 << 60
        while True:
            across = joint(a << 32 | b)
            if across is not None and across < limit:
                return False
            left, right = halves(a), halves(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def _extend(self, last: int, pending: bytes, tails: list[int], live: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Adds the missing last tokens, one for each prefix of ``pending``, and gives what ``live`` is then."""
        step, token_at, pair = self.trie.get, self.token_at, self.pairs.get
        for end in range(len(tails), len(pending)):
            byte = pending[end]
            reach, token = [], -1
            for lo, node in live:
                node = step(node << 8 | byte)
                if node is None:
                    continue
                if node >= 0:
                    reach.append((lo, node))
                    here = token_at[node]
                else:
                    here = ~node
                if token < 0 <= here:
                    before = tails[lo - 1] if lo else last
                    if before >= 0:
                        ok = pair(before << 32 | here)
                        if not (self._may_follow(before, here) if ok is None else ok):
                            continue
                    token = here
            node = step(byte)
            if node is None:
                raise ValueError("the vocabulary lacks a byte")
            if node >= 0:
                reach.append((end, node))
                node = ~token_at[node]
            if token < 0:  # no longer token may stand here, so the byte does
                token = ~node
                if token < 0:
                    raise ValueError("the vocabulary lacks a byte")
            tails.append(token)
            live = reach
        return live

    def _bounds(self, tails: list[int], end: int) -> list[int]:
        """The token boundaries of the encoding of the first ``end`` pending bytes, last first."""
        out = [end]
        while end > 0:
            end -= len(self.bytes_of[tails[end - 1]])
            out.append(end)
        return out

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple]:
        pending, tails = state.pending + bytes((byte,)), list(state.tails)
        live = self._extend(state.last, pending, tails, state.live)
        chain = self._bounds(tails, len(pending))
        agreed = set(chain)
        for lo, _ in live:
            agreed &= set(self._bounds(tails, lo))
        cut = max(agreed)
        emitted = tuple(tails[b - 1] for b in reversed(chain) if 0 < b <= cut)
        last = emitted[-1] if emitted else state.last
        key = (last, pending[cut:])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = _State(last, pending[cut:], tails[cut:], [(lo - cut, node) for lo, node in live])
        move = state.moves[byte] = (to, emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = self.start, []
        for at, byte in enumerate(piece):
            move = state.moves.get(byte)
            if move is None:
                if len(self.states) >= MAX_STATES and len(piece) <= LONG_PIECE:
                    pending, tails = state.pending + piece[at:], list(state.tails)
                    self._extend(state.last, pending, tails, state.live)
                    out += [tails[b - 1] for b in reversed(self._bounds(tails, len(pending))) if b]
                    return out
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        if len(self.states) > 2 * MAX_STATES:  # only long pieces get here
            self.states.clear()
            self.start = _State(-1, b"", [], [])
        if state.final is None:
            state.final = tuple(state.tails[b - 1] for b in reversed(self._bounds(state.tails, len(state.pending))) if b)
        out += state.final
        return out


class Encoder(dict):
    """Pieces of text to their ids as bytes of 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        found = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(self) < MAX_PIECES and len(piece) <= LONG_PIECE:
            self[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([self[p] for p in self.split(text)]), "<i4")


class Utf8Machine:
    """Incremental UTF-8: gives the text of all complete characters and keeps the rest.

    The state is the bytes of a character begun but not ended. A byte that cannot go on is
    replaced by U+FFFD, as Python's decoder does.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(raw: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could end."""
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 1
            if need <= back:
                return 0
            after = raw[-back + 1] if back > 1 else None
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
            return back if after is None or low <= after <= high else 0
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        cut = len(raw) - self._unfinished(raw)
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to text, a run of ids at a time."""

    RUN = 1 << 16

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.body = np.frombuffer(b"".join(tokens), np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.body[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        machine = Utf8Machine()
        parts = [machine.feed(self.raw(ids[i : i + self.RUN])) for i in range(0, len(ids), self.RUN)]
        return "".join([*parts, machine.end()])


_workers: dict = {}


def _worker(kind: type, path: str, *more: str):
    """One encoder or decoder for each Python worker."""
    key = (kind, path, *more)
    if key not in _workers:
        _workers[key] = kind(load_ranks(path), *more)
    return _workers[key]


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    ids = [encoder.encode(t or "") for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _decoded(decoder: Decoder, ids: pa.Array) -> pa.Array:
    return pa.array([decoder.decode(np.zeros(0, np.int64) if x is None or not x.is_valid else x.values.to_numpy(zero_copy_only=False)) for x in ids], pa.string())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs``, as merging by the ranks in ``path`` gives.

    Each match of ``pattern`` is encoded by itself; strings of special tokens are ordinary
    text. Defined cases: a null or empty text has no ids; doc_id passes through whatever it
    is; other columns are ignored; no rows give no rows. ``path`` is read by each worker.
    """

    def run(batches):
        encoder = _worker(Encoder, path, pattern)
        for batch in batches:
            for lo, hi, _ in tx.chunks(tx.column_texts(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _encoded(encoder, batch.column(1).slice(lo, hi - lo))], ["doc_id", "ids"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with the decoded ``text``; null ids are none."""

    def run(batches):
        decoder = _worker(Decoder, path)
        for batch in batches:
            column = batch.column(1)
            for lo in range(0, len(column), 512):
                part = column.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), part, _decoded(decoder, part)], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, text) per row of ``docs``: what ``decode`` makes of what ``encode`` gives, by one Python worker."""

    def run(batches):
        encoder, decoder = _worker(Encoder, path, pattern), _worker(Decoder, path)
        for batch in batches:
            for lo, hi, _ in tx.chunks(tx.column_texts(batch.column(1))):
                rows = _encoded(encoder, batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rows, _decoded(decoder, rows)], ["doc_id", "ids", "text"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids joined by commas and of the decoded text; then ``more`` columns."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
        *more,
    )
