"""Removal of repeated strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or earlier in the
document). Every window of LENGTH bytes has an anchor: of its GRAM-byte grams the one with the least hash (the
leftmost of equals), which depends on the window's bytes alone, so equal windows have equal anchors. An item is a run
of consecutive windows with one anchor; items part a text's windows, some forty to an item.

1. Duplicate detection: only hashes of the items' grams are exchanged. An item whose gram occurs nowhere else has no
   repeated window, and its text is never sent.
2. Each task sorts its remaining items by their suffix at the anchor (then what is left of it), drops items equal to
   an earlier one of the task, and sends front-coded runs: length of the prefix shared with the item before, and the rest.
3. Runs of one part of the hash range meet in one task, which merges them by a loser tree. The players keep the
   prefix length they share with the last winner; longer ones win unseen and equal ones are compared behind it, so no
   known prefix is read again. The merged order has all items of one gram together. Neighbours' common prefixes tell which
   windows agree behind their anchors: those of a stretch of items none of which shares less. Of these only the bytes
   before the anchors are compared.
4. Removed ranges go back to their documents.

Texts cross the network twice, compressed. A hot copy group shrinks in step 1 and 2 to an item for each task. A task of step 3 holds
one part's runs, compressed, of each a block of RUN_BLOCK items unpacked, and up to GROUP_ITEMS different surroundings of one gram; of a gram with more of them the windows are
dealt by their own hashes and meet by aggregation.

Defined cases: a null text counts as empty; matches never cross documents; rows that share doc_id and text count as one
document (each gets its result); rows that share only doc_id are ordered by a hash of the text; a null doc_id is the
smallest; extra columns are kept, those named as the results replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.arrays import text_slices
from memoria.llm.common import NULL_ID, joined_by_key, shuffle_width, table, unused, written

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
SEGMENT = 1 << 20
PLACE_BITS = 22
#: Parts of the hash range for each shuffle partition, so that parts differ little.
PARTS_PER_TASK = 8
#: Items of a run that are packed, and unpacked, together.
RUN_BLOCK = 1024
#: Different items of one gram that a task compares at once.
GROUP_ITEMS = 4096

_random = np.random.default_rng(5)
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of each place, and the inverses, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + LENGTH)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def _items_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, gram hash) of each item; places are in `raw`."""
    n = len(raw)
    rows = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not len(rows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    up, down = powers(n)
    sums = np.r_[np.uint64(0), np.cumsum(BYTE_VALUE[raw] * up, dtype=np.uint64)]
    gram = (sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1]
    gram = (gram ^ (gram >> np.uint64(31))) * MIX_A
    gram = (gram ^ (gram >> np.uint64(29))) * MIX_B
    gram ^= gram >> np.uint64(32)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
    starts = np.zeros(len(least) + 1, np.int8)
    starts[offsets[rows]] = 1
    np.add.at(starts, offsets[rows + 1] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(starts[:-1], dtype=np.int8))
    anchor = (least[window] & place).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.r_[first[1:], len(window)] - 1
    a = anchor[first]
    return np.searchsorted(offsets, window[first], "right") - 1, window[first], window[last], a, gram[a]


def items(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, tuple[np.ndarray, ...]]]:
    """(bytes, their place in the row, items); a long row comes in segments, by its own length alone."""
    if len(offsets) > 2 or len(raw) <= SEGMENT:
        yield raw, 0, _items_of(raw, offsets)
        return
    for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
        part = raw[at : at + SEGMENT + LENGTH - 1]
        yield part, at, _items_of(part, np.array([0, len(part)]))


def _zip(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays) + data)


def _unzip(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    """Arrays come back as unsigned integers."""
    whole = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(whole, np.int64, 1)[0])
    head = np.frombuffer(whole, np.int64, 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for size, count in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(whole, f"<u{size}", count, at))
        at += size * count
    return out, whole[at:]


def _pack(texts: pa.Array) -> pa.Array:
    zip_ = zstandard.ZstdCompressor(1)
    return pa.array([None if t is None else zip_.compress(t.encode()) for t in texts.to_pylist()], pa.binary())


def _unpack(values: pa.Array) -> pa.Array:
    unzip = zstandard.ZstdDecompressor()
    return pa.array([unzip.decompress(v) for v in values.to_pylist()], pa.large_binary()).cast(pa.large_string())


BLOBS = "part bigint, kind int, blob binary"
SEARCH, KNOWN = 0, 1


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["part", "kind", "blob"])


def _send_grams(parts: int):
    """Each gram of a batch once to its part; anchors whose gram repeats in the batch are known to be candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "tag"))
            rows, anchors, grams = [], [], []
            for first, raw, offsets in text_slices(batch.column("text")):
                for _, base, (row, _, _, anchor, gram) in items(raw, offsets):
                    rows.append(row + first)
                    anchors.append(anchor - offsets[row] + base)
                    grams.append(gram)
            if not rows or not sum(map(len, rows)):
                continue
            row, anchor, gram = np.concatenate(rows), np.concatenate(anchors), np.concatenate(grams)
            order = np.argsort(gram, kind="stable")
            row, anchor, gram = row[order], anchor[order], gram[order]
            new = np.r_[True, gram[1:] != gram[:-1]]
            twice = ~np.r_[new[1:], True]  # the next one is the same
            out = []

            def blob(chosen: np.ndarray, kind: int, part: int, flags: np.ndarray) -> None:
                docs, doc = np.unique(row[chosen], return_inverse=True)
                low = (gram[chosen] & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((part, kind, _zip(ids[docs], tags[docs], doc.astype(np.uint32), anchor[chosen].astype(np.uint32), np.packbits(flags), np.ascontiguousarray(low).reshape(-1))))

            at = np.flatnonzero(new)
            part = (gram[at] >> np.uint64(40)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(part[by]) != 0, True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                blob(at[by[a:b]], SEARCH, int(part[by[a]]), twice[at[by[a:b]]])
            rest = np.flatnonzero(~new)
            for a in range(0, len(rest), 1 << 16):
                chosen = rest[a : a + (1 << 16)]
                blob(chosen, KNOWN, int(gram[chosen[0]] % np.uint64(parts)), np.zeros(len(chosen), bool))
            yield _blobs(out)

    return run


PLACES = "doc_id bigint, tag bigint, places binary"


def _by_document(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One row for each document with its values side by side."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, np.int64)
    side = np.stack([v[order] for v in values], 1).astype(np.uint32) if len(doc) else np.zeros((0, len(values)), np.uint32)
    at = doc[cuts[:-1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at].astype(np.int64)), pa.array(tags[at].astype(np.int64)), pa.array([side[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
        names=["doc_id", "tag", "places"],
    )


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, blobs) of rows that come sorted by part: known ones one by one, the others of a part together."""
    now, held = None, []
    for batch in batches:
        for part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if kind == KNOWN:
                yield KNOWN, [blob]
                continue
            if part != now and held:
                yield SEARCH, held
                held = []
            now = part
            held.append(blob)
    if held:
        yield SEARCH, held


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors whose gram another blob of the part has as well, or that are known."""
    for kind, packed in _by_part(batches):
        blobs = [_unzip(blob)[0] for blob in packed]
        shift = np.cumsum([0, *(len(b[0]) for b in blobs)])
        ids, tags = (np.concatenate([b[i] for b in blobs]).view(np.int64) for i in (0, 1))
        doc = np.concatenate([b[2].astype(np.int64) + s for b, s in zip(blobs, shift, strict=False)])
        anchor = np.concatenate([b[3] for b in blobs])
        if kind == KNOWN:
            yield _by_document(ids, tags, doc, anchor)
            continue
        flag = np.concatenate([np.unpackbits(b[4])[: len(b[2])].astype(bool) for b in blobs])
        wide = np.zeros((len(doc), 8), np.uint8)
        wide[:, :5] = np.concatenate([b[5] for b in blobs]).reshape(-1, 5)
        _, at, n = np.unique(wide.reshape(-1).view(np.uint64), return_inverse=True, return_counts=True)
        chosen = (n[at] > 1) | flag
        if chosen.any():
            yield _by_document(ids, tags, doc[chosen], anchor[chosen])


def _shared(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before."""
    wide = 2 * LENGTH
    m = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(-1, wide)
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(1), differ.argmax(1), wide)
    sizes = np.array([len(s) for s in strings])
    return np.r_[0, np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))].astype(np.uint8)


def _send_runs(parts: int):
    """Sorted front-coded runs of the candidates' items, one for each part; items equal to an earlier one of the batch are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            wanted = [np.unique(np.frombuffer(b"".join(x), np.uint32)) for x in batch.column("places").to_pylist()]
            found: dict[int, list] = {}
            for first, raw, offsets in text_slices(_unpack(batch.column("packed"))):
                rows = np.arange(len(offsets) - 1)
                keys = np.concatenate([(r << 32) | wanted[first + r].astype(np.int64) for r in rows.tolist()])
                for data, base, (row, start, last, anchor, gram) in items(raw, offsets):
                    mine = np.isin((row << 32) | (anchor - offsets[row] + base), keys)
                    text = data.tobytes()
                    part = ((gram[mine] >> np.uint64(40)) % np.uint64(parts)).tolist()
                    own = [x[mine].tolist() for x in (row + first, start, last, anchor, start - offsets[row] + base)]
                    for p, r, s, e, a, place in zip(part, *own, strict=True):
                        found.setdefault(p, []).append((text[a : e + LENGTH] + text[s:a], a - s, ids[r], tags[r], place, r))
            out, again = [], []
            for part, own in found.items():
                own.sort()
                kept = [own[0]]
                for x in own[1:]:
                    y = kept[-1]
                    if x[0] == y[0] and x[1] == y[1]:
                        if x[2:5] != y[2:5]:
                            again.append((x[5], x[4], x[4] + len(x[0])))
                            continue
                    kept.append(x)
                strings = [x[0] for x in kept]
                shared = _shared(strings)
                sizes = np.array([len(s) for s in strings], np.uint8)
                blocks = []
                for i in range(0, len(kept), RUN_BLOCK):
                    own_ = kept[i : i + RUN_BLOCK]
                    docs, doc = np.unique([x[5] for x in own_], return_inverse=True)
                    rest = b"".join(s[n:] for s, n in zip(strings[i : i + RUN_BLOCK], shared[i : i + RUN_BLOCK].tolist(), strict=True))
                    place, left = np.array([x[4] for x in own_], np.uint32), np.array([x[1] for x in own_], np.uint8)
                    packed = _zip(ids[docs], tags[docs], doc.astype(np.uint32), place, left, shared[i : i + RUN_BLOCK], sizes[i : i + RUN_BLOCK], data=rest)
                    blocks.append(len(packed).to_bytes(8, "little") + packed)
                out.append((part, SEARCH, b"".join(blocks)))
            if again:
                rows, start, end = np.array(again).T
                docs, doc = np.unique(rows, return_inverse=True)
                out.append((int(again[0][1]) % parts, KNOWN, _zip(ids[docs], tags[docs], doc.astype(np.uint32), start.astype(np.uint32), end.astype(np.uint32))))
            yield _blobs(out)

    return run


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the one before, string, (bytes left of the anchor, doc_id, tag, first window)) in order; one block is unpacked at a time."""
    begin, string = 0, b""
    while begin < len(blob):
        end = begin + 8 + int.from_bytes(blob[begin : begin + 8], "little")
        (ids, tags, doc, place, left, shared, sizes), rest = _unzip(blob[begin + 8 : end])
        ids, tags = ids.view(np.int64)[doc].tolist(), tags.view(np.int64)[doc].tolist()
        at = 0
        for i, (n, size) in enumerate(zip(shared.tolist(), sizes.tolist(), strict=True)):
            string = string[:n] + rest[at : at + size - n]
            at += size - n
            yield n, string, (int(left[i]), ids[i], tags[i], int(place[i]))
        begin = end


def merged(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """One sorted run from many, with shared prefixes, by a loser tree that knows its players' prefixes."""
    size = 1
    while size < len(runs):
        size *= 2
    # A player is [prefix shared with the last winner, string, what belongs to it, run]; an ended run has no string.
    end = [-1, None, None, None]

    def advance(run: Iterator) -> list:
        x = next(run, None)
        return end if x is None else [x[0], x[1], x[2], run]

    def match(x: list, y: list) -> tuple[list, list]:
        """(winner, loser); the loser's prefix is then the one it shares with the winner."""
        if x[0] > y[0]:
            return x, y
        if y[0] > x[0]:
            return y, x
        if x[0] < 0:
            return x, y
        a, b, i = x[1], y[1], x[0]
        n = min(len(a), len(b))
        while i + 16 <= n and a[i : i + 16] == b[i : i + 16]:
            i += 16
        while i < n and a[i] == b[i]:
            i += 1
        if i < n and a[i] < b[i] or i == n and len(a) <= len(b):
            y[0] = i
            return x, y
        x[0] = i
        return y, x

    leaf = {id(run): size + i for i, run in enumerate(runs)}
    players = [advance(run) for run in runs] + [end] * (size - len(runs))
    losers: list[list] = [end] * size
    for node in range(size - 1, 0, -1):
        a, b = (players[c - size] if c >= size else winners[c] for c in (2 * node, 2 * node + 1))
        if node == size - 1:
            winners: dict[int, list] = {}
        winners[node], losers[node] = match(a, b)
    top = winners[1] if size > 1 else players[0]
    while top[1] is not None:
        yield top[0], top[1], top[2]
        node = leaf[id(top[3])] // 2
        top = advance(top[3])
        while node:
            top, losers[node] = match(top, losers[node])
            node //= 2


def repeats(strings: list[bytes], shared: list[int], of: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, tag, start, end) of what repeats in different items of one gram, which come in merged order.

    `shared` are the prefixes that items share with the one before; `of` are (bytes left of the anchor, doc_id, tag, first window).
    """
    least: dict[tuple[int, int, bytes], int] = {}
    #: Of each number of bytes the first item of the stretch that shares so many.
    stretch = [0] * (LENGTH + 1)
    again: dict[int, set[int]] = {}
    for i, (string, (left, *_)) in enumerate(zip(strings, of, strict=True)):
        if i and shared[i] < LENGTH:
            stretch[shared[i] + 1 :] = [i] * (LENGTH - shared[i])
        # A window with so many bytes before its anchor is another's only if a neighbour shares the rest.
        most = min(len(string) - left, max(shared[i] if i else 0, shared[i + 1] if i + 1 < len(shared) else 0), LENGTH)
        for before in range(max(0, LENGTH - most), min(left, GRAMS - 1) + 1):
            key = (before, stretch[LENGTH - before], string[len(string) - before :])
            j = least.setdefault(key, i)
            if j != i:
                later = i
                if of[i][1:] < of[j][1:]:
                    later, least[key] = j, i
                again.setdefault(later, set()).add(before)
    for i, befores in again.items():
        left, doc_id, tag, place = of[i]
        for before in befores:
            start = place + left - before
            yield doc_id, tag, start, start + LENGTH


MERGED = "window string, doc_id bigint, tag bigint, places binary"


def _told(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    ids, tags, start, end = np.array(found, np.int64).T
    docs, doc = np.unique(np.stack([ids, tags], 1), axis=0, return_inverse=True)
    return _by_document(docs[:, 0], docs[:, 1], doc.reshape(-1), start, end)


def _as_merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.string()), *batch.columns], names=["window", *batch.schema.names])


def _windows(strings: list[bytes], of: list[tuple]) -> pa.RecordBatch:
    """Each window of the items by its own hash; places are its start."""
    hashes, ids, tags, starts = [], [], [], []
    for string, (left, doc_id, tag, place) in zip(strings, of, strict=True):
        text = string[len(string) - left :] + string[: len(string) - left]
        n = len(text) - LENGTH + 1
        hashes += [xxhash.xxh3_128_hexdigest(text[j : j + LENGTH]) for j in range(n)]
        ids += [doc_id] * n
        tags += [tag] * n
        starts += [np.uint32(place + j).tobytes() for j in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(starts, pa.binary())], names=["window", "doc_id", "tag", "places"])


def _merge(most: int):
    """Ranges to remove; of grams with more than `most` different items their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, blobs in _by_part(batches):
            if kind == KNOWN:
                (ids, tags, doc, start, end), _ = _unzip(blobs[0])
                yield _as_merged(_by_document(ids.view(np.int64), tags.view(np.int64), doc, start, end))
                continue
            found, large = [], False
            strings, prefixes, of = [], [], []
            for shared, string, own in merged([read_run(b) for b in blobs]):
                if strings and shared < GRAM:
                    if large:
                        yield _windows(strings, of)
                    elif len(strings) > 1:
                        found += repeats(strings, prefixes, of)
                    strings, prefixes, of, large = [], [], [], False
                    if len(found) > 1 << 16:
                        yield _as_merged(_told(found))
                        found = []
                if strings and string == strings[-1] and own[0] == of[-1][0]:
                    # The whole item repeats: the later one goes, the earlier one stands for both.
                    if own[1:] == of[-1][1:]:
                        continue
                    first, second = sorted([of[-1], own], key=lambda x: x[1:])
                    of[-1] = first
                    found.append((second[1], second[2], second[3], second[3] + len(string)))
                    continue
                strings.append(string)
                prefixes.append(shared)
                of.append(own)
                if len(strings) > most:
                    yield _windows(strings, of)
                    strings, prefixes, of, large = strings[-1:], prefixes[-1:], of[-1:], True
            if large:
                yield _windows(strings, of)
            elif len(strings) > 1:
                found += repeats(strings, prefixes, of)
            if found:
                yield _as_merged(_told(found))

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of windows to their ranges."""
    for batch in batches:
        if batch.num_rows:
            start = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint32).astype(np.int64)
            yield _told(list(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), start.tolist(), (start + LENGTH).tolist(), strict=True)))


def _keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Bytes outside the spans, number of removed bytes, of removed runs; null where there are no spans."""
    out = []
    for blob, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if blob is None or own is None:
            out.append(None)
            continue
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        pairs = np.frombuffer(b"".join(own), np.uint32).reshape(-1, 2)
        change = np.zeros(len(raw) + 1, np.int64)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1], -1)
        gone = np.cumsum(change[:-1]) > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append({"kept": raw[~gone].tobytes(), "n_removed": int(gone.sum()), "n_spans": runs})
    return pa.array(out, pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]))


def once_each(rows: DataFrame) -> DataFrame:
    """rows(doc_id, tag, text) with each doc_id and tag once. Texts move only where rows repeat, and of those one for each task."""
    keys = ["doc_id", "tag"]
    again = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*keys), "suffix-repeated-rows")
    if again.isEmpty():
        return rows
    one = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text"))
    return rows.join(again, keys, "left_anti").unionByName(one)


def repeated_ranges(docs: DataFrame, text_col: str = "text", most: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, tag, places): for each document with repeats, start and end of ranges as pairs of 32-bit integers; ranges may overlap."""
    width = shuffle_width(docs.sparkSession)
    parts = width * PARTS_PER_TASK
    dealt = lambda df: df.repartition(width, "part").sortWithinPartitions("part")
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= LENGTH)
    own = once_each(own)
    known = dealt(own.mapInArrow(_send_grams(parts), BLOBS)).mapInArrow(_candidates, PLACES)
    wanted = known.groupBy("doc_id", "tag").agg(F.collect_list("places").alias("places"))
    packed = own.select("doc_id", "tag", F.arrow_udf(_pack, "binary")("text").alias("packed"))
    runs = packed.join(wanted, ["doc_id", "tag"]).mapInArrow(_send_runs(parts), BLOBS)
    found = written(dealt(runs).mapInArrow(_merge(most), MERGED), "suffix-ranges")
    ranges = found.filter("window is null").select("doc_id", "tag", "places")
    windows = found.filter("window is not null")
    if windows.isEmpty():
        return ranges
    at = F.struct("doc_id", "tag", F.reverse("places").alias("start"))
    first = written(windows.groupBy("window").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1"), "suffix-windows")
    later = joined_by_key(windows, first, "window").filter(F.col("first").isNotNull() & (at != F.col("first")))
    return ranges.unionByName(later.select("doc_id", "tag", "places").mapInArrow(_starts, PLACES))


def without_repeats(docs: DataFrame, text_col: str = "text", most: int = GROUP_ITEMS) -> DataFrame:
    """`docs` with kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    id_, tag, packed, places, part, whole = unused(docs, "_id", "_tag", "_packed", "_places", "_part", "_whole")
    ranges = repeated_ranges(docs, text_col, most).groupBy("doc_id", "tag").agg(F.collect_list("places").alias(places))
    ranges = ranges.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), places)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), tag: F.xxhash64(text_col), packed: F.arrow_udf(_pack, "binary")(text)}).drop(text_col)
    joined = keyed.join(ranges, [id_, tag], "left")
    kept = F.arrow_udf(_keep, "struct<kept:binary,n_removed:bigint,n_spans:bigint>")(packed, places)
    df = joined.withColumns({part: kept, whole: F.arrow_udf(_whole, "binary")(F.when(F.col(places).isNull(), F.col(packed)))})
    count = lambda name: F.coalesce(F.col(part)[name], F.lit(0).cast("bigint"))
    df = df.withColumns({"kept": F.coalesce(F.col(part)["kept"], F.col(whole)), "n_removed": count("n_removed"), "n_spans": count("n_spans")})
    return df.withColumn("n_bytes", F.octet_length("kept").cast("bigint") + F.col("n_removed")).drop(id_, tag, packed, places, part, whole)


def _whole(values: pa.Array) -> pa.Array:
    unzip = zstandard.ZstdDecompressor()
    return pa.array([None if v is None else unzip.decompress(v) for v in values.to_pylist()], pa.binary())


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, what was removed, and the digest of what is left."""
    df = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
