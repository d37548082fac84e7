"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

The merges of a rank table are compiled into a nondeterministic transducer over bytes. One of its threads is a
pair (tokens settled so far and not yet emitted, place in the trie of the token that is being read). A thread may
end its token t after the last settled token s only if the byte pair encoding of s and t together is exactly
(s, t); that local test decides which of the possible segmentations is the encoding, because a sequence of tokens
is the encoding of its bytes exactly if each adjacent pair is (Berglund and van der Merwe, "Formalizing BPE
Tokenization", 2023). The deterministic states are sets of threads. They are built when a text first reaches
them, and what all threads of a state have in common is emitted on the way in, so that a token comes out after a
lookahead that the longest token bounds. At most one thread of a state stands at the trie's root: the
segmentation of the bytes so far, which the end of a piece flushes.

The states are a memo with a bound on their number, looked at every STRIDE bytes, within a piece too: when it is reached the memo is dropped and built anew from the threads of the current state,
which are all that the rest of the piece needs. So there are never more than the bound and STRIDE states, whatever the length of a piece. The memo of whole pieces is bounded likewise within a text.

Decoding streams: token bytes go through an incremental UTF-8 state machine that holds back an incomplete
character between chunks.

Defined results: a null text is an empty one, with no ids; very long texts are encoded piece by piece; repeated rows
repeat; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, keyed_texts, map_batches, table

MAX_STATES = 200_000
MAX_PIECES = 800_000
MAX_PAIRS = 250_000
DECODE_CHUNK = 8192
STRIDE = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes, a space, the rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the adjacent pair of lowest rank, the leftmost first, until no pair has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        joined = parts[best] + parts[best + 1]
        if joined not in ranks:
            break
        parts[best : best + 2] = [joined]
    return [ranks[p] for p in parts]


class MergeTransducer:
    """The transducer of a rank table. encode_piece() is exact for every byte string."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.trie[node].get(byte)
                if nxt is None:
                    nxt = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = rank
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.regular = True
        self._reset()

    def _reset(self) -> None:
        start = (((), -1, 0),)
        self.threads = [start]
        self.index = {start: 0}
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.flush: list[tuple[int, ...]] = [()]

    def _restart(self, state: int) -> int:
        """Drop all states but the start and this one; its new number."""
        key = self.threads[state]
        self._reset()
        if key not in self.index:
            self._add(key)
        return self.index[key]

    def _add(self, key: tuple) -> int:
        to = self.index[key] = len(self.threads)
        self.threads.append(key)
        self.arcs.append({})
        self.flush.append(next((p for p, _, node in key if node == 0), ()))
        return to

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens that the token's last merge joins; (-1, -1) for a single byte."""
        pair = self.parts.get(token)
        if pair is None:
            raw = self.bytes_of[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            pair = (self.ranks.get(parts[0], -1), self.ranks.get(parts[1], -1)) if len(parts) == 2 else (-1, -1)
            if len(parts) == 2 and max((x if len(p) > 1 else -1) for x, p in zip(pair, parts, strict=True)) >= token or -1 in pair and len(parts) == 2:
                self.regular = False  # a part of higher rank: merges don't run in the order of ranks
            self.parts[token] = pair
        return pair

    def _stay_apart(self, left: int, right: int) -> bool:
        """Does no merge cross from left to right? Walks back in time: the side whose outermost merge is the later is split, until a joint would have come first."""
        before_left = before_right = 1 << 60  # what next consumes the piece at the border, on either side
        while True:
            joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joint is not None and joint < before_left and joint <= before_right:
                return False
            made_left = left if len(self.bytes_of[left]) > 1 else -1
            made_right = right if len(self.bytes_of[right]) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                before_left, left = left, self._split(left)[1]
            else:
                before_right, right = right, self._split(right)[0]
            if not self.regular:
                return False

    def _may_follow(self, left: int, right: int) -> bool:
        ok = self.adjacent.get((left, right))
        if ok is None:
            if len(self.adjacent) > MAX_PAIRS:
                self.adjacent.clear()
            reached = self.alone.get(right)
            if reached is None:
                reached = self.alone[right] = merge_by_rank(self.bytes_of[right], self.ranks) == [right]
            if left < 0 or not reached:
                ok = reached
            else:
                ok = self._stay_apart(left, right)
                if not self.regular:
                    ok = merge_by_rank(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
            self.adjacent[left, right] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one arc: the next state and what is emitted on the way. A thread: tokens settled and not emitted, the last settled token, trie node."""
        moved, settled = [], None
        for pending, last, node in self.threads[state]:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            token = self.ends[node]
            if token >= 0 and settled is None and self._may_follow(last, token):
                settled = ((*pending, token), token, 0)
            if self.trie[node]:
                moved.append((pending, last, node))
        if settled is not None:
            moved.append(settled)
        if not moved:
            raise ValueError(f"the rank table has no token for byte {byte}")
        first, common = moved[0][0], 0
        while common < len(first) and all(len(p) > common and p[common] == first[common] for p, _, _ in moved):
            common += 1
        out = first[:common]
        key = tuple((p[common:], last, node) for p, last, node in moved) if common else tuple(moved)
        to = self.index.get(key)
        if to is None:
            to = self._add(key)
        arc = self.arcs[state][byte] = (to, out)
        return arc

    def encode_piece(self, piece: bytes) -> list[int]:
        step, state, out = self._step, 0, []
        for at in range(0, len(piece), STRIDE):
            if len(self.threads) > self.max_states:
                state = self._restart(state)
            arcs = self.arcs
            for byte in piece[at : at + STRIDE]:
                arc = arcs[state].get(byte) or step(state, byte)
                state = arc[0]
                if arc[1]:
                    out += arc[1]
        out += self.flush[state]
        return out


class BpeCodec:
    """A pattern that cuts texts into pieces, and the transducer that encodes each."""

    def __init__(self, ranks_path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.ranks, self.max_pieces = read_ranks(ranks_path), max_pieces
        self.fst = MergeTransducer(self.ranks, max_states)
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.memo: dict[str, bytes] = {}

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, pieces = self.memo, self.pattern.findall(text)
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            packed = memo.get(p)
            if packed is None:
                packed = np.array(self.fst.encode_piece(p.encode()), "<u4").tobytes()
                if len(p) <= 64:
                    if len(memo) >= self.max_pieces:
                        memo.clear()
                    memo[p] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_chunks(self, ids: Iterable[int], chunk: int = DECODE_CHUNK) -> Iterator[str]:
        """Text in chunks, as tokens arrive."""
        machine, held = Utf8Machine(), []
        for i in ids:
            held.append(self.bytes_of[i])
            if len(held) >= chunk:
                yield machine.feed(b"".join(held))
                held.clear()
        yield machine.feed(b"".join(held)) + machine.finish()


class Utf8Machine:
    """Incremental UTF-8: the state is how many continuation bytes the open character still needs, and its bytes so far.

    Whole characters come out; malformed bytes become U+FFFD, as does a character still open at the end.
    """

    #: Continuation bytes that follow a lead byte; 0 for bytes that open nothing.
    NEEDS = [0] * 0xC2 + [1] * 0x1E + [2] * 0x10 + [3] * 5 + [0] * 11

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.NEEDS[byte] >= back:
                    cut = len(data) - back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> BpeCodec:
    """One for each worker process: its states and pieces serve all its tasks."""
    return BpeCodec(ranks_path, pattern, max_states, max_pieces)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES, keep_codec: bool = True) -> DataFrame:
    """For each document: doc_id, n_tokens, ids_sha256, decoded_sha256, decodes (the decoded text is the text), and the ids if asked for.

    ``ranks_path`` is a path on every executor. One pass, no shuffle. The transducer and the memos of a worker process stay until it ends; where it
    has other work too, ``keep_codec=False`` drops them after each task, and each task compiles its own.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path, pattern, max_states, max_pieces)
        n, ids_sha, dec_sha, same, all_ids = [], [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            packed = c.encode_packed(text)
            ids = np.frombuffer(packed, "<u4").tolist()
            decoded = hashlib.sha256()
            at, ok, lookup, machine = 0, True, c.bytes_of, Utf8Machine()
            for i in range(0, len(ids), DECODE_CHUNK):
                raw = b"".join(map(lookup.__getitem__, ids[i : i + DECODE_CHUNK]))
                decoded.update(raw)
                part = machine.feed(raw)
                ok = ok and text.startswith(part, at)
                at += len(part)
            rest = machine.finish()
            same.append(ok and not rest and at == len(text))
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            dec_sha.append(decoded.hexdigest())
            if with_ids:
                all_ids.append(packed)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(dec_sha), pa.array(same)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decodes"]
        if with_ids:
            ends = np.cumsum([0, *(len(p) // 4 for p in all_ids)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def drop() -> None:
        codec.cache_clear()
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decodes boolean"
    return map_batches(keyed_texts(docs), work, schema + (", ids array<int>" if with_ids else ""), give_back if keep_codec else drop)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), *default_tokenizer())


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
