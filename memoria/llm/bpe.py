"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of a text exactly if each neighbouring pair is the encoding of its own
bytes. So the merges define a non-deterministic transducer: its configurations are (last token, node of the
vocabulary's trie); a byte moves along the trie, and at a node that is a token the path may end one there, if
that token may follow the last one. Each prefix has one encoding, so one configuration at most ends at each byte.

A state of the deterministic transducer is the set of the trie's nodes that are live at a byte. They are suffixes of
the longest one, which names the state; so there are no more states than nodes, and texts share them. Beside the state
runs the token that ends at each byte which a live configuration may start from. Where all live configurations have
come by the same tokens, those are settled and emitted; none reaches further back than the longest token, which bounds the
lookahead. States, moves and suffix links are made when a text first needs them.
Short pieces run through the transducer in lock step, byte after byte; they too emit after every SETTLE bytes what is settled then.

Whether one token may follow another is read from their last merges: the merge that came last is taken back,
left or right of the border, until a merge over the border would have come before it, or single bytes are left.

Decoding joins the tokens' bytes and turns them into text by an incremental UTF-8 state machine, so that a
stream may be cut anywhere.

Defined cases: a null or empty text has no tokens; null ids decode to the empty text; extra columns are kept
(a column of the output's name is replaced); a vocabulary without all single bytes, or with tokens made of later ones, is refused.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import table, unused

#: Limits of a worker's tables, in entries, about 50 MB together; a full one starts again, which changes no result.
MAX_ENTRIES, MAX_PIECES = 20_000, 60_000
#: Entries of the tables of moves and pairs that short pieces share; a new entry takes an old one's place.
MOVE_BITS, PAIR_BITS = 16, 18
TOKEN_BITS = 20
TOKEN_MASK = (1 << TOKEN_BITS) - 1
#: Pieces of more bytes are encoded one by one; settled tokens are looked for after every SETTLE bytes.
SHORT = 256
SETTLE = 64
MAX_PIECE_CHARS = 32
#: Characters of texts whose pieces are encoded together; pieces of one lock step.
CHARS, ROWS = 1 << 20, 8192
#: A vocabulary is sent to every executor; larger files than this are refused.
MAX_VOCABULARY_BYTES = 64 << 20
NEVER = 1 << 60


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, from the driver's disk; its size is checked since it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}
    if not all(bytes([b]) in ranks for b in range(256)) or max(ranks.values()) > TOKEN_MASK:
        raise ValueError("the vocabulary lacks single bytes or has too large ids")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition of an encoding: again and again the pair of least rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Merges:
    """Of each token the two that its last merge joins, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        #: -1 for single bytes, which no merge made; NEVER for tokens that merges don't lead to.
        self.made = array("q", [NEVER]) * n
        self.left, self.right = array("i", [-1]) * n, array("i", [-1]) * n
        self.joined: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made[rank] = -1
                continue
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i], -1), ranks.get(token[i:], -1)
                if a >= 0 <= b and self.made[a] < rank > self.made[b] and self.apart(a, b, rank):
                    self.made[rank], self.left[rank], self.right[rank] = rank, a, b
                    self.joined[a << TOKEN_BITS | b] = rank
                    break
            else:
                if len(merge(token, ranks)) == 1:
                    raise ValueError(f"token {rank} is made of tokens of later ranks")

    def apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge goes over the border of tokens a and b, up to the merge of rank `before`."""
        made, joined = self.made, self.joined.get
        while True:
            if joined(a << TOKEN_BITS | b, NEVER) < before:
                return False
            if made[a] > made[b]:
                before, a = a, self.right[a]
            elif made[b] >= 0:
                # Of equal merges the left one comes first: that over the border before that to its right.
                before, b = b + 1, self.left[b]
            else:
                return True


class Follows(dict):
    """Of one token: last token to whether this one may follow it; -1 is the start."""

    def __init__(self, machine: Transducer, token: int):
        super().__init__()
        self.machine, self.token = machine, token

    def __missing__(self, last: int) -> bool:
        found = self[last] = last < 0 or self.machine.merges.apart(last, self.token)
        self.machine.count_entry()
        return found


class State(dict):
    """Moves by byte; `node` is the longest live node, `ends` are the tokens (and their lengths) that may end here, longest first."""

    def __init__(self, machine: Transducer, node: int):
        super().__init__()
        self.machine, self.node, ends = machine, node, []
        while node:
            if (token := machine.token_at[node]) >= 0:
                ends.append((token, machine.depth[node], machine.follows(token)))
            node = machine.suffix_of(node)
        self.ends = tuple(ends)

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.machine.state(self.machine.next(self.node, byte))
        self.machine.count_entry()
        return found


class Transducer:
    """Nodes of the trie are numbers, the root 0; what belongs to them lies in flat arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.below: dict[int, int] = {}
        self.token_at, self.inner = array("i", [-1]), bytearray(1)
        self.above, self.depth = array("i", [-1]), array("i", [0])
        last = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if (child := self.below.get(node << 8 | b)) is None:
                    child = self.below[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                    self.above.append(node)
                    self.depth.append(self.depth[node] + 1)
                    last.append(b)
                node = child
            self.token_at[node] = rank if self.merges.made[rank] < NEVER else -1
        self.last = bytes(last)
        #: Of each node the longest of its suffixes that is a node; -1 where it isn't known yet.
        self.suffix = array("i", [-1]) * len(self.token_at)
        self.begin()

    def begin(self) -> None:
        """Empty tables; states that are in use go on without them."""
        self.states: dict[int, State] = {}
        self.by_token: dict[int, Follows] = {}
        self.entries = 0
        self.start = self.state(0)

    def count_entry(self) -> None:
        self.entries += 1
        if self.entries > MAX_ENTRIES:
            self.begin()

    def state(self, node: int) -> State:
        if (found := self.states.get(node)) is None:
            found = self.states[node] = State(self, node)
        return found

    def follows(self, token: int) -> Follows:
        if (found := self.by_token.get(token)) is None:
            found = self.by_token[token] = Follows(self, token)
        return found

    def suffix_of(self, node: int) -> int:
        if (found := self.suffix[node]) < 0:
            up = self.above[node]
            found = self.suffix[node] = self.next(self.suffix_of(up), self.last[node]) if up > 0 else 0
        return found

    def next(self, node: int, byte: int) -> int:
        """The longest live node behind a byte."""
        while (child := self.below.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.suffix_of(node)
        return child

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of the piece, emitted as they are settled."""
        #: The token that ends at each byte since the last settled one, and that one; -1 is the start.
        state, told, out = self.start, [-1], []
        for at in range(0, len(piece), SETTLE):
            if at:
                out += self.settled(state.node, told)
            tell = told.append
            for byte in piece[at : at + SETTLE]:
                state = state[byte]
                for token, length, follows in state.ends:
                    if follows[told[-length]]:
                        tell(token)
                        break
                else:
                    raise ValueError("the ranks are no byte-level BPE vocabulary")
        return out + self.back(told, len(told) - 1)

    def settled(self, node: int, told: list[int]) -> list[int]:
        """Takes from `told` the tokens by which all live configurations have come."""
        at = len(told) - 1
        live = {at}
        while node:
            if self.inner[node]:
                live.add(at - self.depth[node])
            node = self.suffix_of(node)
        while len(live) > 1:
            at = max(live)
            live.remove(at)
            live.add(at - len(self.bytes_of[told[at]]))
        at = live.pop()
        out = self.back(told, at)
        del told[:at]
        return out

    def back(self, told: list[int], at: int) -> list[int]:
        out, bytes_of = [], self.bytes_of
        while at > 0:
            out.append(token := told[at])
            at -= len(bytes_of[token])
        out.reverse()
        return out


class LockStep:
    """The transducer over many short pieces at once, on flat arrays; what is settled is emitted every SETTLE bytes."""

    def __init__(self, machine: Transducer):
        self.token_at, self.depth = np.array(machine.token_at), np.array(machine.depth)
        self.length = np.zeros(len(machine.merges.made), np.int32)
        self.length[list(machine.bytes_of)] = [len(x) for x in machine.bytes_of.values()]
        keys = np.array(list(machine.below), np.int64)
        order = np.argsort(keys)
        self.below, self.child = keys[order], np.array(list(machine.below.values()), np.int32)[order]
        keys = np.array(list(machine.merges.joined), np.int64)
        order = np.argsort(keys)
        self.joined, self.joined_to = keys[order], np.array(list(machine.merges.joined.values()), np.int64)[order]
        self.made, self.left, self.right = (np.array(x) for x in (machine.merges.made, machine.merges.left, machine.merges.right))
        n = len(self.token_at)
        #: Of each node its longest suffix that is a node (-1 where no piece needed it yet), and the longest node that is itself or a suffix of it and a token.
        self.suffix, self.token_end, self.next_end = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.suffix[0] = 0
        self.above, self.last = np.array(machine.above), np.frombuffer(machine.last, np.uint8)
        self.inner = np.frombuffer(bytes(machine.inner), np.uint8).astype(bool)
        self.move_key, self.move_to = np.full(1 << MOVE_BITS, -1, np.int64), np.zeros(1 << MOVE_BITS, np.int32)
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def slot(key: np.ndarray, bits: int) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)

    def link(self, nodes: np.ndarray) -> None:
        """Makes the suffix links of nodes that haven't got them, and of the nodes that these lead to."""
        new = nodes[self.suffix[nodes] < 0]
        if not len(new):
            return
        new = np.unique(new)
        # Suffixes are shorter, so shorter nodes come first.
        for d in np.unique(self.depth[new]).tolist():
            own = new[(self.depth[new] == d) & (self.suffix[new] < 0)]
            if d == 1:
                self.suffix[own] = 0
            else:
                up = self.above[own]
                self.link(up)
                to = self.next(self.suffix[up], self.last[own])
                self.link(to)
                self.suffix[own] = to
            self.next_end[own] = self.token_end[self.suffix[own]]
            self.token_end[own] = np.where(self.token_at[own] >= 0, own, self.next_end[own])

    def next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The longest live nodes behind a byte each."""
        node, to = node.astype(np.int64), np.zeros(len(node), np.int32)
        left = np.arange(len(node))
        while len(left):
            key = node[left] << 8 | byte[left]
            at = np.minimum(np.searchsorted(self.below, key), len(self.below) - 1)
            found = self.below[at] == key
            to[left[found]] = self.child[at[found]]
            left = left[~found & (node[left] > 0)]
            self.link(node[left])
            node[left] = self.suffix[node[left]]
        return to

    def moved(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 8 | byte
        slot = self.slot(key, MOVE_BITS)
        to, new = self.move_to[slot], np.flatnonzero(self.move_key[slot] != key)
        if len(new):
            to[new] = self.next(state[new], byte[new])
            self.move_key[slot[new]], self.move_to[slot[new]] = key[new], to[new]
        return to

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As Merges.apart, for many pairs."""
        a, b, before, out = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NEVER), np.ones(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            key = x << TOKEN_BITS | y
            at = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
            over = (self.joined[at] == key) & (self.joined_to[at] < before[left])
            out[left[over]] = False
            made_x, made_y = self.made[x], self.made[y]
            back_a, back_b = ~over & (made_x > made_y), ~over & (made_x <= made_y) & (made_y >= 0)
            before[left[back_a]], a[left[back_a]] = x[back_a], self.right[x[back_a]]
            before[left[back_b]], b[left[back_b]] = y[back_b] + 1, self.left[y[back_b]]
            left = left[back_a | back_b]
        return out

    def may_follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = last.astype(np.int64) << TOKEN_BITS | token
        slot = self.slot(key, PAIR_BITS)
        ok, new = self.pair_ok[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            ok[new] = self.apart(last[new], token[new])
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece as packed ids."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]), reverse=True)
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            for i, packed in zip(own, self._encode([pieces[i] for i in own]), strict=True):
                out[i] = packed
        return out

    def settled(self, state: np.ndarray, told: np.ndarray, at: int) -> np.ndarray:
        """Of each row, with `at` bytes read, the place up to which all its live configurations have come by the same tokens.

        They start where an inner node among the state's suffixes begins, or here; the latest start that isn't the only one is taken back by its token, until one is left.
        """
        rows = np.arange(len(state))
        live, node = np.zeros((int(self.depth.max()) + 1 + int(self.length.max()), len(state)), bool), state.astype(np.int64)
        live[0] = True
        while node.any():
            own = rows[self.inner[node]]
            live[self.depth[node[own]], own] = True
            self.link(node)
            node = self.suffix[node].astype(np.int64)
        count = live.sum(0)
        to = np.full(len(state), -1, np.int64)
        for back in range(len(live)):
            here = rows[live[back] & (to < 0)]
            only = count[here] == 1
            to[here[only]] = at - back
            more = here[~only]
            if len(more):
                further = back + self.length[told[at - back, more]]
                count[more] -= live[further, more]
                live[further, more] = True
            if not (to < 0).any():
                break
        return to

    def emit(self, told: np.ndarray, base: np.ndarray, to: np.ndarray, found: list) -> None:
        """The tokens from `base` to `to` of the rows, from the last to the first."""
        rows, at, time = np.arange(len(to)), to.copy(), len(found)
        rows = rows[at > base[: len(to)]]
        while len(rows):
            token = told[at[rows], rows]
            found.append((time, rows, token))
            at[rows] -= self.length[token]
            rows = rows[at[rows] > base[rows]]

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces come longest first, so those that go on are the first ones."""
        sizes = np.array([len(x) for x in pieces])
        raw, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
        #: The token that ends at each byte; -1 is the start.
        told = np.full((int(sizes[0]) + 1, len(pieces)), -1, np.int32)
        state = np.zeros(len(pieces), np.int32)
        #: Where each row's tokens are emitted up to, and what was: rows, tokens, from the last to the first of each time.
        base, found = np.zeros(len(pieces), np.int64), []
        for i in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -i, "left"))
            state = state[:k]
            if i and i % SETTLE == 0:
                to = self.settled(state, told, i)
                self.emit(told, base, to, found)
                base[:k] = to
            state = self.moved(state, raw[starts[:k] + i])
            self.link(state)
            rows, end = np.arange(k), self.token_end[state]
            while len(rows):
                token, last = self.token_at[end], told[i + 1 - self.depth[end], rows]
                ok = last < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.may_follow(last[ask], token[ask])
                told[i + 1, rows[ok]] = token[ok]
                rows, end = rows[~ok], self.next_end[end[~ok]]
                if len(end) and not end.all():
                    raise ValueError("the ranks are no byte-level BPE vocabulary")
        self.emit(told, base, sizes, found)
        row, token, time = (np.concatenate(x) for x in zip(*((r, t, np.full(len(r), time)) for time, r, t in found), strict=True))
        order = np.lexsort((-np.arange(len(row)), time, row))
        packed = token[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(row, minlength=len(pieces)))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Texts to token ids; pieces are split by the pattern and encoded separately, each different one once where it is known."""

    def __init__(self, ranks: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = parse_ranks(ranks)
        self.machine = Transducer(self.ranks)
        self.lock_step = LockStep(self.machine)
        #: Packed ids of pieces, in two generations.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def know(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of these pieces at least."""
        if len(self.young) > MAX_PIECES:
            self.young, self.old = {}, self.young
        new, made, short = pieces.difference(self.young), {}, {}
        again = new.intersection(self.old)
        for piece in new.difference(again):
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                made[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short[piece] = raw
            else:
                made[piece] = np.array(self.machine.encode(raw), "<u4").tobytes()
        if short:
            made.update(zip(short, self.lock_step.encode(list(short.values())), strict=True))
        made.update((x, self.old[x]) for x in again)
        long = [x for x in made if len(x) > MAX_PIECE_CHARS]
        if long:
            known = self.young | made
            for x in long:
                del made[x]
            self.young.update(made)
            return known
        self.young.update(made)
        return self.young

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Pieces of a run of texts are encoded together, those of a long text part by part."""
        run, size = [], 0
        for text in texts:
            if len(text) > CHARS:
                yield from self._run(run)
                run, size = [], 0
                yield self._long(text)
                continue
            if size + len(text) > CHARS:
                yield from self._run(run)
                run, size = [], 0
            run.append(text)
            size += len(text)
        yield from self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        known = self.know(set().union(*split))
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def _long(self, text: str) -> bytes:
        found, parts = self.pattern.finditer(text), []
        while part := [m[0] for m in islice(found, CHARS // 8)]:
            parts.append(b"".join(map(self.know(set(part)).__getitem__, part)))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


class Utf8Machine:
    """Bytes to text, fed in any portions: holds back an unfinished character, replaces what can't be one."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead & 0xC0 == 0x80:
                    continue
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if lead & 0xF0 == 0xE0 else 4 if 0xF0 <= lead <= 0xF4 else 1
                cut -= back if need > back else 0
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], portion: int = 1 << 14) -> Iterator[str]:
    machine, ids = Utf8Machine(), iter(ids)
    while some := b"".join(map(bytes_of.__getitem__, islice(ids, portion))):
        yield machine.feed(some)
    yield machine.feed(b"", last=True)


_made: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    """One for each vocabulary in a worker process, so that its tables serve all its tasks."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks, pattern)
    return _made[key]


def _decoded(ids: bytes, bytes_of: dict[int, bytes]) -> str:
    return "".join(decode_stream(memoryview(ids).cast("I"), bytes_of))


def encode_column(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """Token ids as little-endian unsigned 32-bit integers in a binary value."""
    sent = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(_encoder(sent.value, pattern).encode_all(t.as_py() or "" for t in texts), pa.binary(), size=len(texts))

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, ranks_path: str) -> Column:
    """The text of token ids."""
    sent = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        bytes_of = {rank: token for token, rank in parse_ranks(sent.value).items()}
        return pa.array((_decoded(v.as_py() or b"", bytes_of) for v in values), pa.string(), size=len(values))

    return decode(ids)


def round_trip_column(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """Token ids and the text decoded from them, made in one go: as two functions they would take the ids to Python and back."""
    sent = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("struct<token_ids:binary,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        encoder = _encoder(sent.value, pattern)
        ids = pa.array(encoder.encode_all(t.as_py() or "" for t in texts), pa.binary(), size=len(texts))
        back = pa.array((_decoded(v.as_py(), encoder.machine.bytes_of) for v in ids), pa.string(), size=len(ids))
        return pa.StructArray.from_arrays([ids, back], names=["token_ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    return docs.withColumn(ids_col, encode_column(docs.sparkSession, F.col(text_col), ranks_path, pattern))


def decode_documents(docs: DataFrame, ranks_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    return docs.withColumn(out, decode_column(docs.sparkSession, F.col(ids_col), ranks_path))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with token_ids, and decoded from them."""
    (name,) = unused(docs, "_both")
    df = docs.drop("token_ids", "decoded").withColumn(name, round_trip_column(docs.sparkSession, F.col(text_col), ranks_path, pattern))
    return df.withColumns({c: F.col(name)[c] for c in ("token_ids", "decoded")}).drop(name)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = round_trip(docs, *vocabulary())
    return df.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
