"""Language identification by a convolutional network over bytes, in numpy.

Byte embeddings, filters of several widths, maximum over places, softmax; trained on labelled windows and
applied to all windows of every text in batches. A filter bank over embedded bytes is a sum of table look-ups
(one table for each place in the filter), which is how it is computed.

The fit uses a bounded sample of labelled windows: all windows of all labelled texts are drawn from, each with the same chance within
its language, by a hash of its document and place, about WINDOWS_PER_LANG of each of the MAX_LANGS most frequent languages
and never more than MAX_WINDOWS together. A text's scores are the means over all its windows.

Defined cases: a null text, one without any letter, or a corpus without languages to learn gives `und` with score 0; a null lang
isn't learned from; a null doc_id is in the learning fold; extra columns are kept, those named as the results replaced; repeated rows get the same
prediction; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.arrays import text_slices
from memoria.llm.common import below_share, bound, table, unused, written

FOLDS, HELD_FOLD = 3, 1
WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS, EMBEDDING = 10, 8
#: Bounds of the sample that the network is fitted on.
WINDOWS_PER_LANG, MAX_LANGS, MAX_WINDOWS = 2_000, 2_000, 100_000
EPOCHS, BATCH, RATE = 14, 128, 0.01
UNKNOWN = "und"


class ByteCnn:
    """Parameters: embedding; for each width kernels by place and biases; dense layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = [r.normal(0, 0.5, (256, EMBEDDING))]
        self.p += [r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS]
        self.p += [np.zeros(FILTERS) for _ in WIDTHS]
        self.p += [r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs))]
        self.p = [x.astype(np.float32) for x in self.p]
        self.tables: list[np.ndarray] | None = None

    def kernels(self, i: int) -> np.ndarray:
        """Look-up tables of the i-th width: place, byte, filter."""
        if self.tables is not None:
            return self.tables[i]
        return np.einsum("be,pef->pbf", self.p[0], self.p[1 + i])

    def pooled(self, x: np.ndarray, where: bool = False):
        """Maximum of each filter over a window's places (and its place)."""
        values, places = [], []
        for i, w in enumerate(WIDTHS):
            t, n = self.kernels(i), x.shape[1] - w + 1
            y = t[0][x[:, :n]]
            for o in range(1, w):
                y += t[o][x[:, o : o + n]]
            if where:
                best = y.argmax(1)
                places.append(best)
                values.append(np.take_along_axis(y, best[:, None], 1)[:, 0] + self.p[1 + len(WIDTHS) + i])
            else:
                values.append(y.max(1) + self.p[1 + len(WIDTHS) + i])
        return np.maximum(np.concatenate(values, 1), 0), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x)[0] @ self.p[-2] + self.p[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        hidden, places = self.pooled(x, where=True)
        z = hidden @ self.p[-2] + self.p[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        out = [np.zeros_like(p) for p in self.p]
        out[-2], out[-1] = hidden.T @ d, d.sum(0)
        back = (d @ self.p[-2].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            out[1 + len(WIDTHS) + i] = g.sum(0)
            for o in range(w):
                seen = x[np.arange(len(x))[:, None], places[i] + o]
                dt = np.zeros((256, FILTERS), np.float32)
                np.add.at(dt, (seen, np.arange(FILTERS)[None, :]), g)
                out[1 + i][o] = self.p[0].T @ dt
                out[0] += dt @ self.p[1 + i][o].T
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                for k, g in enumerate(self.gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.tables = [np.einsum("be,pef->pbf", self.p[0], self.p[1 + i]) for i in range(len(WIDTHS))]


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, their rows): every row cut into windows of WINDOW bytes, the last one filled up with zeros."""
    n = np.maximum(-(-np.diff(offsets) // WINDOW), 1)
    row = np.repeat(np.arange(len(n)), n)
    begin = offsets[:-1][row] + WINDOW * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    at = begin[:, None] + np.arange(WINDOW)[None, :]
    inside = at < offsets[1:][row][:, None]
    return np.where(inside, raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else 0, 0).astype(np.uint8), row


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled_windows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, piece): about WINDOWS_PER_LANG windows of each language, cut as `windows_of` cuts them, wherever that is within a letter."""
    own = docs.filter(fold_of(F.col("doc_id")) != HELD_FOLD).select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    windows = F.ceil(F.octet_length("text") / WINDOW).cast("int")
    counts = own.groupBy("lang").agg(F.sum(windows.cast("bigint")).alias("windows")).orderBy(F.desc("windows"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return own.select("lang", F.col("text").cast("binary").alias("piece")).limit(0)
    most = min(WINDOWS_PER_LANG, MAX_WINDOWS // (2 * len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, most / r["windows"]))])
    row = F.struct(F.element_at(share, F.col("lang")).alias("share"), F.xxhash64("doc_id", "text").alias("tag"))
    chosen = bound(row, lambda r: F.filter(F.sequence(F.lit(0), windows - 1), lambda i: below_share(F.xxhash64(r["tag"], i), r["share"])))
    piece = lambda i: F.substring(F.col("text").cast("binary"), i * WINDOW + 1, F.lit(WINDOW))
    pieces = own.filter(F.col("lang").isin([r["lang"] for r in counts])).select("lang", F.explode(F.transform(chosen, piece)).alias("piece"))
    pieces = written(pieces, "language-windows")
    # Rows that share id and text are all chosen or none: should they be too many, some are taken.
    total = pieces.count()
    return pieces if total <= MAX_WINDOWS else pieces.filter(below_share(F.xxhash64(F.monotonically_increasing_id()), MAX_WINDOWS / (2 * total)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """The network from the learning fold's labelled documents, or None if there are none."""
    rows = sorted((r["lang"], bytes(r["piece"])) for r in sampled_windows(docs, text_col, lang_col).collect())
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, piece) in enumerate(rows):
        x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    model = ByteCnn(langs)
    model.fit(x, np.array([number[lang] for lang, _ in rows]))
    return model


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.p, model.tables))

    @F.arrow_udf("struct<lang:string,score:double>")
    def best(texts: pa.Array) -> pa.Array:
        langs, p, tables = sent.value
        net = ByteCnn(langs)
        net.p, net.tables = p, tables
        names, scores = [], []
        for _, raw, offsets in text_slices(texts, 1 << 18):
            total = np.zeros((len(offsets) - 1, len(langs)))
            x, row = windows_of(raw, offsets)
            for at in range(0, len(x), 256):
                np.add.at(total, row[at : at + 256], net.probabilities(x[at : at + 256]))
            total /= total.sum(1, keepdims=True)
            top = total.argmax(1)
            names += [langs[i] for i in top]
            scores += total[np.arange(len(top)), top].tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    text = F.col(text_col)
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    (name,) = unused(docs, "_best")
    df = docs.withColumn(name, best(text))
    return df.withColumns(
        {"lang_pred": F.when(known, F.col(name)["lang"]).otherwise(F.lit(UNKNOWN)), "score": F.when(known, F.least(F.col(name)["score"], F.lit(1.0))).otherwise(F.lit(0.0))}
    ).drop(name)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was withheld from learning, predicted language, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    df = predict(docs.select("doc_id", "text"), train(docs))
    return df.select("doc_id", (fold_of(F.col("doc_id")) == HELD_FOLD).alias("held_out"), "lang_pred", "score")
