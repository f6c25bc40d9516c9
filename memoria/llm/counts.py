"""Token counts of a byte-pair vocabulary with word ends, by rank-synchronous merging of arrays.

The texts of a batch are cut into pre-tokens, and each different pre-token is held once, as a row of a ragged array of symbols: its bytes,
the last one marked as a word's end. In every round each row's adjacent pair of lowest rank is merged, everywhere in the row (left to right
where the pair overlaps itself) and in all rows at once; a row without a known pair is done, and the symbols that are left are its
tokens. Every merge's parts are made by earlier merges (checked when a vocabulary is read), so what a merge makes new is of a later rank, and all places of the lowest rank
come before it, as if merged one by one. Rows of over LONG symbols, which would need many rounds, are merged one by one from a heap of their pairs.

The cutting is the library's: NFC, lower case letter by letter, then runs of letters, single digits, runs of other characters, and English
endings behind an apostrophe. Which code points are letters, digits and blanks is asked of the library, code point by code point, once for each vocabulary;
texts with code points that Python's own Unicode tables don't know yet are normalised by the library.
Special strings in a text are one token each and part what stands around them, as is the library's default.

Defined cases: a null or empty text has no tokens; extra columns are kept, those named as the results replaced; repeated rows get the same counts; texts
and pre-tokens are whole however long; an empty table gives an empty result; a vocabulary file of another build is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.arrays import numbered, slices_of
from memoria.llm.bpe import read_ranks
from memoria.llm.common import table

#: The only way of cutting that this counts for, as the vocabulary file states it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Documents of more tokens are over the limit.
LIMIT = 2048
#: Characters of texts taken together; symbols of a row that is merged in step with the others.
CHARS, LONG = 1 << 20, 256
BLANK, LETTER, DIGIT, OTHER, STRANGE = 0, 1, 2, 3, 4
NEVER = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it is visible, or else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


def classes_of(tokenizer) -> np.ndarray:
    """Of each code point: blank, letter, digit or other, as the library cuts; STRANGE besides if Python's tables may lack it."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for begin in range(0, 0x110000, 4096):
        points = [chr(c) for c in range(begin, begin + 4096) if not 0xD800 <= c < 0xE000]
        known = [unicodedata.category(c) for c in points]
        # Ranges for private use are others, and so are the planes that no version of Unicode assigns.
        if set(known) != {"Co"} and not 0x40000 <= begin < 0xE0000:
            # Between dots, which are others: a blank leaves two pieces, an other joins all into one, a run of letters is a third, two digits are two more.
            pieces = tokenizer.pre_tokenizer.pre_tokenize_str("\n".join(f".{c}{c}." for c in points))
            made = np.bincount([at // 5 for _, (at, _) in pieces], minlength=len(points))
            own = np.array([OTHER, BLANK, LETTER, DIGIT], np.uint8)[made - 1]
            kinds[[ord(c) for c in points]] = own | np.array([STRANGE * (k == "Cn") for k in known], np.uint8)
    return kinds


class Vocabulary:
    """Merges by rank, symbols of single bytes, classes of code points, special strings."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model, cutters = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        built = (
            spec["normalizer"] == NORMALIZER
            and cutters[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
            and (cutters[1]["type"], cutters[1]["add_prefix_space"], cutters[1]["use_regex"]) == ("ByteLevel", False, False)
            and (model["type"], model["end_of_word_suffix"], model["continuing_subword_prefix"], model["dropout"], model["ignore_merges"]) == ("BPE", "</w>", None, None, False)
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not built:
            raise ValueError("the vocabulary file isn't of the build that is counted here")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.kinds = classes_of(self.tokenizer)
        ids = model["vocab"]
        alphabet = byte_characters()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.last = np.array([ids[c + "</w>"] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if any(made.get(part, -1) >= rank for rank, pair in enumerate(pairs) for part in pair) or len(made) < len(pairs):
            raise ValueError("a merge joins what later ones make")
        self.n = max(ids.values()) + 1
        keys = np.array([ids[a] * self.n + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], NEVER), np.append(order, NEVER)
        self.joined = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))

    def normalised(self, text: str) -> str:
        """The text as it is cut; blanks stay as they are, which part pre-tokens all the same."""
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if (self.kinds[points] & STRANGE).any():
            return self.tokenizer.normalizer.normalize_str(text)
        # Python would lower a sigma by where it stands.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token (a byte at least)."""
        size = np.diff(offsets)
        symbols = self.inner[raw]
        symbols[offsets[1:] - 1] = self.last[raw[offsets[1:] - 1]]
        out = np.zeros(len(size), np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.merged_singly(symbols[offsets[i] : offsets[i + 1]].tolist())
        row = np.repeat(np.arange(len(size)), size)
        short = (size <= LONG)[row]
        self.merge_in_step(symbols[short], row[short], out)
        return out

    def merge_in_step(self, symbols: np.ndarray, row: np.ndarray, out: np.ndarray) -> None:
        """Into `out`, the symbols that are left of each row."""
        rank = np.full(len(symbols), NEVER)
        inside = np.flatnonzero(row[1:] == row[:-1])
        rank[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(row)))
            least = np.minimum.reduceat(rank, first)
            done = least == NEVER
            out[row[first[done]]] = size[done]
            hit = (rank == np.repeat(least, size)) & (rank != NEVER)
            # Of a pair that overlaps itself every other place, from the left.
            at = np.flatnonzero(hit)
            begins = np.append(True, np.diff(at) != 1)
            at = at[(at - np.repeat(at[begins], np.diff(np.append(np.flatnonzero(begins), len(at))))) % 2 == 0] if len(at) else at
            symbols[at] = self.joined[rank[at]]
            stay = ~np.repeat(done, size)
            stay[at + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            fresh[np.maximum(at - 1, 0)] = True  # the pair to the left; what stands a merged symbol further is merged itself
            fresh[np.maximum(at - 2, 0)] = True
            symbols, row, rank, fresh = symbols[stay], row[stay], rank[stay], np.flatnonzero(fresh[stay])
            rank[fresh] = NEVER
            fresh = fresh[fresh + 1 < len(row)]
            fresh = fresh[row[fresh] == row[fresh + 1]]
            rank[fresh] = self.pair_ranks(symbols[fresh], symbols[fresh + 1])

    def merged_singly(self, symbols: list[int]) -> int:
        """The number of symbols that are left of one row, its pairs taken from a heap by rank, then place."""
        n, rank_of = len(symbols), self.rank_of
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        rank = lambda i: rank_of.get(symbols[i] * self.n + symbols[after[i]], -1) if after[i] < n else -1
        heap = [(r, i) for i in range(n) if (r := rank(i)) >= 0]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if symbols[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            symbols[i], symbols[gone], after[i] = int(self.joined[r]), -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for j in (before[i], i):
                if j >= 0 and (s := rank(j)) >= 0:
                    heappush(heap, (s, j))
        return left

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of every pre-token of a normalised text in its UTF-8 bytes, and the place of its first character."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points] & ~np.uint8(STRANGE)
        first = np.ones(len(points), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        mark = np.flatnonzero((points == ord("'")) & first)
        for ending in ENDINGS:
            here = mark[mark + len(ending) < len(points)]
            for k, letter in enumerate(ending, 1):
                here = here[points[here + k] == ord(letter)]
            first[here + 1] = False
            behind = here[here + len(ending) + 1 < len(points)] + len(ending) + 1
            first[behind] |= kinds[behind] == LETTER
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=place[1:])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(points))
        own = kinds[begin] != BLANK
        return place[begin[own]], place[end[own]], begin[own]

    def token_counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for special in self.specials:
                if special in text:
                    out[i] += text.count(special)
                    texts[i] = text = text.replace(special, "\n")
        texts = [self.normalised(t) for t in texts]
        joined = "\n".join(texts)
        if not joined:
            return out
        start, end, character = self.cut(joined)
        number, pieces = numbered(*slices_of(np.frombuffer(joined.encode(), np.uint8), start, end))
        if len(pieces):
            _, where, data = pieces.buffers()
            each = self.counts(np.frombuffer(data, np.uint8), np.frombuffer(where, np.int64)[: len(pieces) + 1])
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            row = np.searchsorted(begins, character, "right") - 1
            out += np.bincount(row, each[number], len(texts)).astype(np.int64)
        return out


_made: dict[str, Vocabulary] = {}


def _vocabulary(data: bytes) -> Vocabulary:
    """Read once in a worker process, which serves many tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Vocabulary(data)
    return _made[key]


def token_count_column(spark: SparkSession, text: Column, path: str) -> Column:
    """The number of tokens by the vocabulary file at `path` on the driver's disk."""
    sent = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        vocabulary, out, some, size = _vocabulary(sent.value), [np.zeros(0, np.int64)], [], 0
        for text in texts:
            some.append(text.as_py() or "")
            size += len(some[-1])
            if size >= CHARS:
                out.append(vocabulary.token_counts(some))
                some, size = [], 0
        return pa.array(np.concatenate([*out, vocabulary.token_counts(some)]))

    return count(text)


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    return docs.withColumn(out, token_count_column(docs.sparkSession, F.col(text_col), path))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, and whether these are over the limit."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
