"""Language ID: a byte convolutional network (several filter widths, max pooling, softmax), trained in numpy on labelled texts.

Filters read one-hot bytes, so a filter of width w is w tables of 256 weights, and its output the sum of w look-ups. A text is cut into windows of
WINDOW bytes; each window is pooled and classified; a text's log probabilities are the mean of its windows', by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, lean, text_runs

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
#: Labelled texts to learn from, dealt evenly over the labels.
SAMPLE = 2000


class ByteConvNet:
    def __init__(self, classes: list[str], seed: int = 0):
        r = np.random.Generator(np.random.PCG64(seed))
        self.classes = classes
        self.tables = [r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out = np.zeros(len(classes), np.float32)

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled and rectified outputs of windows (n, WINDOW) of bytes, and where each filter was largest."""
        pooled, places = [], []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            span = x.shape[1] - w + 1
            s = t[0][x[:, :span]]
            for j in range(1, w):
                s += t[j][x[:, j : j + span]]
            at = s.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(s, at[:, None], 1)[:, 0])
        return np.maximum(np.concatenate(pooled, 1) + self.bias, 0), places

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.pool(x) @ self.dense + self.out
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def pool(self, x: np.ndarray) -> np.ndarray:
        """features without places, faster: two neighbouring bytes are looked up at once."""
        if not hasattr(self, "_pairs"):
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
            t2, t3, t4 = self.tables
            self._pairs = (pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3]))
        q = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        a, b, c, d = self._pairs
        two = a[q].max(1)
        three = (b[q[:, :-1]] + self.tables[1][2][x[:, 2:]]).max(1)
        four = (c[q[:, :-2]] + d[q[:, 2:]]).max(1)
        return np.maximum(np.concatenate([two, three, four], 1) + self.bias, 0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the cross entropy."""
        r = np.random.Generator(np.random.PCG64(seed))
        params = [*self.tables, self.bias, self.dense, self.out]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            turn = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                pick = turn[lo : lo + batch]
                xb, yb = x[pick], y[pick]
                f, places = self.features(xb)
                z = f @ self.dense + self.out
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.dense.T) * (f > 0)
                grads = []
                for k, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                    g, part = np.zeros_like(self.tables[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                    col = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, at + j, 1), col), part)
                    grads.append(g)
                grads += [back.sum(0), f.T @ p, p.sum(0)]
                t += 1
                for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    q -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, score) of each text, from all its windows; und and 0 without a letter."""
        live = [i for i, t in enumerate(texts) if any(map(str.isalpha, t.decode("utf-8", "ignore")))]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.classes:
            return out
        lo = 0
        while lo < len(live):
            hi, size = lo, 0
            while hi < len(live) and (hi == lo or size < 1 << 20):
                size += len(texts[live[hi]])
                hi += 1
            part = live[lo:hi]
            n = np.array([-(-len(texts[i]) // WINDOW) for i in part])
            buf = np.zeros((int(n.sum()), WINDOW), np.uint8)
            weight = np.full(len(buf), float(WINDOW))
            at = 0
            for i, k in zip(part, n.tolist(), strict=True):
                t = np.frombuffer(texts[i].translate(ASCII_LOWER), np.uint8)
                buf[at : at + k].reshape(-1)[: t.size] = t
                weight[at + k - 1] = t.size - (k - 1) * WINDOW
                at += k
            logs = np.concatenate([self.log_probs(buf[j : j + 512]) for j in range(0, len(buf), 512)]) * weight[:, None]
            first = np.cumsum(n) - n
            mean = np.add.reduceat(logs, first, 0) / np.add.reduceat(weight, first)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, row in zip(part, p, strict=True):
                out[i] = (self.classes[int(row.argmax())], float(row.max()))
            lo = hi
        return out


def is_held_out(ids: list) -> list[bool]:
    return [zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2 for d in ids]


def _windows(text: bytes) -> np.ndarray:
    """All windows of a text, A-Z lower-cased, the last one filled with zeros."""
    out = np.zeros((max(1, -(-len(text) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(text)] = np.frombuffer(text.translate(ASCII_LOWER), np.uint8)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 0) -> ByteConvNet:
    """A network from at most about `sample` labelled texts that are not held out (crc32 of the id modulo 4 is 2): as many of each label, one at least, or all that a label has.

    Texts are chosen by a hash of id and text, so that rows of one id, or without ids, are as good as others; rows that repeat both count once. All windows of a chosen
    text are learned from. Null and empty texts and null labels teach nothing. Every label that has a text is learned, up to `sample` labels: beyond that the
    most frequent ones (of equally frequent ones the first by name). Without any label the network has no classes. The driver gets the labels and the chosen texts.
    """
    text, label = F.col(text_col), F.col(lang_col).cast("string")
    rows = docs.where(text.isNotNull() & (text != "") & label.isNotNull() & (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2))
    seen = rows.select(F.xxhash64(F.col(id_col), text).alias("o"), label.alias("lang"), text.alias("x"))
    labels = {r[0]: r[1] for r in rows.groupBy(label.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    quota, share = max(1, -(-sample // max(1, len(labels)))), 1.5 * sample / max(1, len(labels))
    got, short = [], dict(labels)
    first = Window.partitionBy("lang").orderBy("o", "x")
    while short:
        # hashes below a bound a label: what tasks send does not grow with their number
        bounds = [(lang, min(2**63 - 1, int(min(1.0, share / n) * 2**64) - 2**63)) for lang, n in short.items()]
        limits = docs.sparkSession.createDataFrame(bounds, "lang string, most long")
        some = seen.join(F.broadcast(limits), "lang").where("o <= most").dropDuplicates(["lang", "o"])
        more = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= quota).select("o", "lang", "x").collect()
        found = {lang: sorted((r for r in more if r.lang == lang), key=lambda r: r.o) for lang in short}
        done = [lang for lang, most in bounds if len(found[lang]) >= quota or most == 2**63 - 1]
        got += [r for lang in sorted(done) for r in found[lang]]
        short = {lang: n for lang, n in short.items() if lang not in done}  # few by chance, or by repeated rows: look further
        share *= 8
    classes = sorted(labels)
    parts = [_windows(r.x.encode()) for r in got]
    net = ByteConvNet(classes, seed)
    if classes:
        net.fit(np.concatenate(parts), np.repeat([classes.index(r.lang) for r in got], [len(p) for p in parts]), seed=seed)
    return net


def identify(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Reads the whole of every text, and nothing else.

    A null text, or one without a letter, is `und` with score 0; so is every text where the network has no classes. Repeated rows get equal answers. Of labels that are
    equally probable the first by name is told.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # the weights: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_runs(b, text_col):
                got, ids = shared.value.predict(texts), b.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(is_held_out(ids.to_pylist()), pa.bool_()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteConvNet, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """docs without the rows whose text is `und`, or whose language is not told with a score of `least`. Columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_runs(b, text_col):
                yield b.slice(at, len(texts)).filter(pa.array([g[0] != "und" and g[1] >= least for g in shared.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
