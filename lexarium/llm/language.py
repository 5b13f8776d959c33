"""Language identification by a byte convolutional network.

Filters of several widths run over embedded bytes, each keeps its largest response in a window (max pooling), and a
softmax over languages follows. It is trained in numpy on a bounded sample of labelled texts and then applied to all
windows of every text; a text's probabilities are the means of its windows', weighted by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Window length in bytes, size of a byte's embedding, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
#: Texts of a language that the sample has about (fewer if there are fewer), and characters taken of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 600
EPOCHS, BATCH, RATE = 14, 64, 4e-3
UNKNOWN = "und"


def windows(text: bytes) -> np.ndarray:
    """All bytes of a text in rows of fixed length, the last filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class ByteCNN:
    """The network. All widths are one product: a narrow filter is a wide one whose last rows stay zero."""

    def __init__(self, n_classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.mask = np.zeros((wide * EMBED, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "w": (rng.normal(0, 0.25, self.mask.shape) * self.mask).astype(np.float32),
            "b": np.zeros(self.mask.shape[1], np.float32),
            "u": rng.normal(0, 0.2, (self.mask.shape[1], n_classes)).astype(np.float32),
            "c": np.zeros(n_classes, np.float32),
        }
        self.p["e"][0] = 0

    def _context(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes with those after them: (places, wide * EMBED)."""
        wide = max(WIDTHS)
        e = self.p["e"][x].reshape(len(x), -1)
        n = x.shape[1] - wide + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), n, wide * EMBED), (s[0], EMBED * s[1], s[1])).reshape(-1, wide * EMBED)

    def _pooled(self, x: np.ndarray):
        context = self._context(x)
        responses = (context @ self.p["w"]).reshape(len(x), -1, self.mask.shape[1])
        return context, responses, np.maximum(responses.max(axis=1) + self.p["b"], 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows, some at a time."""
        out = []
        for at in range(0, len(x), 128):
            z = self._pooled(x[at : at + 128])[2] @ self.p["u"] + self.p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.empty((0, len(self.p["c"])), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        context, responses, pooled = self._pooled(x)
        z = pooled @ self.p["u"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"u": pooled.T @ dz, "c": dz.sum(axis=0)}
        dp = (dz @ self.p["u"].T) * (pooled > 0)
        g["b"] = dp.sum(axis=0)
        n = responses.shape[1]
        best = responses.argmax(axis=1) + np.arange(len(x))[:, None] * n  # the place that each filter chose
        chosen = context[best]  # (windows, filters, wide * EMBED)
        g["w"] = np.einsum("bf,bfk->kf", dp, chosen) * self.mask
        back = dp[:, :, None] * self.p["w"].T[None]
        wide = max(WIDTHS)
        row, place = best // n, best % n
        g["e"] = np.zeros_like(self.p["e"])
        for o in range(wide):
            np.add.at(g["e"], x[row, place + o], back[:, :, o * EMBED : (o + 1) * EMBED])
        g["e"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 1) -> ByteCNN:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                own = order[at : at + BATCH]
                t += 1
                for k, g in self.gradients(x[own], y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _held_out(id_):
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(rows: DataFrame) -> tuple[list[str], ByteCNN | None]:
    """Languages and network from ``rows`` (id, text, lang): a sample by hash of about SAMPLE_TEXTS texts a language."""
    own = rows.filter(F.col("lang").isNotNull() & ~_held_out(F.col("id")))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], None
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE_TEXTS / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
    sample = own.filter((draw < share * (1 << 30)) & F.col("text").rlike(r"\p{L}"))
    # a passage of each, from anywhere in the text
    start = F.pmod(F.xxhash64(F.lit("start"), "id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    got = sorted((r.lang, r.id if r.id is not None else -1, r.passage) for r in sample.select("id", "lang", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("passage")).collect())
    langs = sorted({r[0] for r in got})
    if not langs:
        return [], None
    rng = np.random.default_rng(5)
    x, y = [], []
    for lang, _, passage in got:
        data = passage.encode()
        parts = windows(data)[: max(1, len(data) // WINDOW)]
        cut = rng.integers(0, max(1, len(data) - 20))
        short = windows(data[cut : cut + int(rng.integers(15, 120))])[:1]  # texts may be short
        for part in (*parts, *short):
            x.append(part)
            y.append(langs.index(lang))
    return langs, ByteCNN(len(langs)).fit(np.array(x), np.array(y))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row.

    Learns from rows with a language and crc32 of the id as text not divisible by 5; the others are held out.
    ``score`` is the probability of ``lang_pred``.

    Nulls: a null text and one without a letter are ``und`` with score 0; so are all if nothing could be learned. A
    null language is not learned from; a row with a null id neither, and counts as held out. Repeated rows each get
    their row; ties go to the language first by name. An empty table gives no rows. Every byte of a text is in a
    window. Further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col)
    langs, net = train(rows)
    kind = dict(rows.dtypes)["id"]
    asked = rows.select("id", "text", _held_out(F.col("id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            texts = batch.column("text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, has in enumerate(letters) if has and net is not None]
            while at:
                some, size = [], 0
                while at and size < 4_000_000:
                    some.append(at.pop())
                    size += len(texts[some[-1]])
                data = [texts[i].encode() for i in some]
                parts = [windows(d) for d in data]
                weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(w))) for d, w in zip(data, parts)]).astype(np.float64)
                first = np.cumsum([0, *[len(w) for w in parts[:-1]]])
                p = net.predict(np.concatenate(parts)) * weight[:, None]
                p = np.add.reduceat(p, first, axis=0) / np.add.reduceat(weight, first)[:, None]
                for i, row in zip(some, p):
                    best = int(row.argmax())
                    names[i], scores[i] = langs[best], min(1.0, max(0.0, float(row[best])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return asked.mapInArrow(run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
