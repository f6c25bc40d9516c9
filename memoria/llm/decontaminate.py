"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case ASCII letters, digits and other bytes with single blanks. An item of m bytes
may have e = ERROR_RATE * m errors (rounded down); it is split into e + 1 pieces, of which one at least must
occur unchanged wherever the item occurs with so few errors. Exact piece hits come from one automaton over all
pieces. Around a hit larger and larger parts of the item are verified, each with its share of the errors, and at last the
item, with Myers' bit-parallel distance, whose words are as wide as the part.

Items are taken in blocks of bounded bytes, each of which is broadcast and held against all documents; a longer item
is a block of its own, so neither side has a limit. Items of one text are searched once.

Defined cases: null and blank texts match nothing; items of fewer than `min_bytes` such bytes (MIN_BYTES unless said otherwise) are too
common to count and match nothing; with a limit of 0 all items are matched, the short ones as whole words; null ids are carried through; repeated documents match repeatedly, repeated items once; extra columns are never
read by `matches` and kept by `decontaminated`; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import table, written

ERROR_RATE = 0.1
MIN_BYTES = 16
#: Bytes of items that are broadcast at once, about; longer items come alone.
BLOCK_BYTES = 4 << 20
#: Masks of parts up to this size are kept.
KEPT_BYTES = 4096

PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def plain(text: str | None) -> str:
    """Words joined by single blanks, one character for each byte."""
    return b" ".join((text or "").encode().translate(PLAIN).split()).decode("latin-1")


def budget(item: str) -> int:
    """Short items, which stand between blanks, must occur unchanged."""
    return int(ERROR_RATE * len(item)) if len(item.strip(" ")) >= MIN_BYTES else 0


def as_asked(item: str) -> str:
    """A short item counts only as whole words, between blanks."""
    return item if len(item) >= MIN_BYTES else f" {item} "


def reaches(masks: dict[str, int], m: int, window: str, enough: int) -> int:
    """Least edit distance of a pattern of m characters to any part of the window (Myers 1999, blocks as one wide integer).

    Ends at the first distance of at most `enough`.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best = m
    for c in window:
        same = masks.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (every & ~(across | up)), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
                if best <= enough:
                    return best
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(vertical | plus)) & every, plus & vertical & every
    return best


def masks_of(text: str) -> dict[str, int]:
    """Of each character the places where the text has it, as bits."""
    places: dict[str, bytearray] = {}
    for i, c in enumerate(text):
        if c not in places:
            places[c] = bytearray(-(-len(text) // 8))
        places[c][i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(bits, "little") for c, bits in places.items()}


class Part:
    """A part of an item, the errors it may have, and the part that it is half of. Its masks are made when they are first needed."""

    __slots__ = ("around", "errors", "high", "kept", "low", "text")

    def __init__(self, text: str, low: int, high: int, errors: int, around: Part | None):
        self.text, self.low, self.high, self.errors, self.around, self.kept = text, low, high, errors, around, None

    def distance(self, window: str, enough: int) -> int:
        masks = self.kept or masks_of(self.text[self.low : self.high])
        if self.high - self.low <= KEPT_BYTES:
            self.kept = masks
        return reaches(masks, self.high - self.low, window, enough)

    def near(self, text: str, at: int) -> bool:
        """Whether the text has this part, with its errors at most, where the item would begin at `at`."""
        start = max(0, at + self.low - self.errors)
        return self.distance(text[start : max(0, at + self.high + self.errors)], self.errors) <= self.errors


class Item:
    """An item, split in two again and again until no error is left to give.

    A part that may have k errors has two that may have k - 1 together, one of which must keep to its share; so from any
    piece (a part without errors) the larger parts around it can be tested one after the other, the smallest first.
    """

    def __init__(self, item_id: int | None, text: str):
        self.id, self.text, self.errors = item_id, text, budget(text)
        #: Place of each piece, and the smallest part around it.
        self.pieces: list[tuple[int, int, Part | None]] = []
        self.whole: Part | None = None
        self._split(0, len(text), self.errors, None)

    def _split(self, low: int, high: int, errors: int, around: Part | None) -> None:
        if not errors:
            self.pieces.append((low, high, around))
            return
        around = Part(self.text, low, high, errors, around)
        self.whole = self.whole or around
        left = (errors - 1) // 2
        middle = low + (high - low) * (left + 1) // (errors + 1)
        self._split(low, middle, left, around)
        self._split(middle, high, errors - 1 - left, around)

    def distance(self, window: str) -> int:
        """Least edit distance of the item to any part of the window."""
        if not self.errors:
            return 0 if self.text in window else len(self.text)
        return self.whole.distance(window, 0)


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [Item(i, t) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        for k, item in enumerate(self.items):
            for low, high, around in item.pieces:
                piece = item.text[low:high]
                if piece not in self.automaton:
                    self.automaton.add_word(piece, (high - low, []))
                self.automaton.get(piece)[1].append((k, low, around))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """{item number: least distance} of the items within their budgets."""
        text = f" {text} "
        seen: set[tuple[int, int]] = set()
        found: dict[int, int] = {}
        for end, (length, of) in self.automaton.iter(text):
            at = end - length + 1
            for k, low, around in of:
                # Places of one item that are close share a window.
                place = (at - low) >> 6
                if (k, place) in seen:
                    continue
                part = around
                while part is not None and part.near(text, at - low):
                    part = part.around
                if part is None:
                    seen.add((k, place))
                    item = self.items[k]
                    window = text[max(0, place * 64 - item.errors) : place * 64 + 63 + len(item.text) + item.errors]
                    if (d := item.distance(window)) <= min(item.errors, found.get(k, item.errors)):
                        found[k] = d
        return found


OUT = "doc_id bigint, tag bigint, item bigint, distance bigint, budget bigint"


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            rows = []
            for doc_id, tag, text in zip(*(batch.column(c) for c in ("doc_id", "tag", "text")), strict=True):
                for k, d in matcher.find(plain(text.as_py())).items():
                    item = matcher.items[k]
                    rows.append((doc_id.as_py(), tag.as_py(), item.id, d, item.errors))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "tag", "item", "distance", "budget"])

    return run


def _has_item(sent):
    matchers: list[Matcher] = []

    def found(texts: pa.Array) -> pa.Array:
        if not matchers:
            matchers.append(Matcher(sent.value))
        return pa.array([bool(matchers[0].find(plain(t.as_py()))) for t in texts], pa.bool_())

    return F.arrow_udf(found, "boolean")


def blocks(items: DataFrame, item_col: str, min_bytes: int = MIN_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(number, plain text) of the different item texts, in lists of about BLOCK_BYTES; the number is a hash of the text."""
    least = max(min_bytes, 1)
    texts = items.select(F.xxhash64(item_col).alias("item"), F.col(item_col).alias("text")).filter(F.octet_length("text") >= least)
    texts = written(texts.groupBy("item", "text").count(), "benchmark-items")
    size = F.octet_length("text").cast("bigint")
    small, large = texts.filter(size <= BLOCK_BYTES // 4), texts.filter(size > BLOCK_BYTES // 4)
    # With no item over a quarter of a block, blocks by hash differ little in size.
    n = 1 + (small.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES
    parts = [small.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]
    parts += [large.filter(F.col("item") == r["item"]) for r in large.select("item").distinct().orderBy("item").toLocalIterator()]
    for part in parts:
        rows = [(r["item"], plain(r["text"])) for r in part.select("item", "text").toLocalIterator()]
        rows = sorted((i, as_asked(text)) for i, text in rows if len(text) >= least)
        if rows:
            yield rows


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, tag, item_id, distance, budget) of each document and benchmark item in it; tag tells rows of one doc_id apart.

    Items of fewer than `min_bytes` such bytes are left out; with 0 all are searched, those of fewer than MIN_BYTES as whole words without errors.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], OUT)
    for rows in blocks(items, item_col, min_bytes):
        found = found.unionByName(own.mapInArrow(_scan(spark.sparkContext.broadcast(rows)), OUT))
    ids = items.select(F.xxhash64(item_col).alias("item"), F.col("item_id").cast("bigint").alias("item_id")).distinct()
    return found.join(ids, "item").select("doc_id", "tag", "item_id", "distance", "budget")


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """`docs` without the documents in which a benchmark item (of `min_bytes` at least) occurs. No row leaves its task."""
    spark = docs.sparkSession
    for rows in blocks(items, "text", min_bytes):
        docs = docs.filter(~_has_item(spark.sparkContext.broadcast(rows))(F.col(text_col)))
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item found in it, its edit distance and the item's budget."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "budget")
