"""Language identification by a byte convolutional network (operator 6).

Bytes (A-Z lower-cased) have learned embeddings; filters of widths 2, 3 and 4 slide over
windows of ``WINDOW`` bytes; each filter's maximum over the window (max pooling, then ReLU)
feeds a softmax. Training is plain numpy (Adam, back-propagation through the positions of the
maxima) on a bounded sample: at most about ``sample`` labelled documents, chosen by hash, and
``per_doc`` windows of each. Whole texts are classified: all consecutive windows, batched in
one matrix product, and the windows' logits averaged by their bytes.

Learned from: text and non-null lang of rows whose crc32(doc_id) mod 4 is not 2. Nothing but
the text is an input of a prediction.

Defined results: null text, or text without any letter, is ``und`` with score 1; with no
labelled row at all every text is ``und`` with score 0; very long texts are classified in
slices; repeated rows repeat; an empty table gives an empty result; ties go to the first
language in order. The model (about 20 kB) travels to the tasks with the code.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import common as c

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
SAMPLE = 6_000
NAMES = ("embed", "filters", "bias", "out", "out_bias")
MAYBE_LETTER = re.compile(r"[^\W\d_]")  # also other numbers, such as fractions
OUT = "doc_id long, lang_pred string, score double"


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L."""
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


class ByteCnn:
    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        wide = max(WIDTHS)
        self.mask = np.zeros((wide * DIM, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters = rng.normal(0, 0.3, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, wide * DIM) of (windows, WINDOW) bytes."""
        wide = max(WIDTHS)
        e = self.embed[x].reshape(len(x), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, wide * DIM, axis=1)[:, ::DIM]
        return np.ascontiguousarray(view)

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self._patches(x)
        top = (p.reshape(-1, p.shape[2]) @ self.filters).reshape(len(x), p.shape[1], -1).max(1)
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the mean cross-entropy; a filter learns at the place of its maximum."""
        wide = max(WIDTHS)
        p = self._patches(x)
        conv = (p.reshape(-1, p.shape[2]) @ self.filters).reshape(len(x), p.shape[1], -1)
        where = conv.argmax(1)
        top = np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        soft = np.exp(z)
        soft /= soft.sum(1, keepdims=True)
        soft[np.arange(len(y)), y] -= 1
        soft /= len(y)
        d_hidden = (soft @ self.out.T) * (top > 0)
        chosen = p[np.arange(len(x))[:, None], where]  # (windows, filters, wide * DIM)
        d_filters = np.einsum("bf,bfi->if", d_hidden, chosen) * self.mask
        d_patch = (d_hidden[:, :, None] * self.filters.T[None]).reshape(len(x), -1, wide, DIM)
        d_embed = np.zeros_like(self.embed)
        places = where[:, :, None] + np.arange(wide)
        np.add.at(d_embed, x[np.arange(len(x))[:, None, None], places].ravel(), d_patch.reshape(-1, DIM))
        d_embed[0] = 0  # padding
        return dict(embed=d_embed, filters=d_filters, bias=d_hidden.sum(0), out=hidden.T @ soft, out_bias=soft.sum(0))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.004, least_steps: int = 400, seed: int = 9) -> None:
        epochs = max(epochs, -(-least_steps * batch // max(1, len(x))))
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        second = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                grads = self.gradients(x[own], y[own])
                step += 1
                for k in NAMES:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - change).astype(np.float32))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        n = [(len(r) + WINDOW - 1) // WINDOW for r in raw]
        doc = np.repeat(np.arange(len(raw)), n)
        buf = np.zeros((len(doc), WINDOW), np.uint8)
        weight = np.full(len(doc), float(WINDOW))
        at = 0
        for r, k in zip(raw, n):
            if k:
                flat = buf[at : at + k].reshape(-1)
                flat[: len(r)] = np.frombuffer(r, np.uint8)
                weight[at + k - 1] = len(r) - (k - 1) * WINDOW
                at += k
        buf = c.LOWER[buf]
        sums = np.zeros((len(raw), len(self.classes)))
        for i in range(0, len(buf), 128):
            z = self.logits(buf[i : i + 128]).astype(np.float64)
            np.add.at(sums, doc[i : i + 128], z * weight[i : i + 128, None])
        out = []
        for t, r, s in zip(texts, raw, sums):
            if not t or not has_letter(t):
                out.append(("und", 1.0))
                continue
            z = s / len(r)
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p.argmax())
            out.append((self.classes[k], float(p[k])))
        return out


def _windows(per_doc: int):
    """Up to ``per_doc`` evenly spread windows of each text, as bytes."""

    def run(batches):
        for batch in batches:
            lang, found = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n = max(1, min(per_doc, len(raw) // WINDOW))
                for k in range(n if raw else 0):
                    at = (len(raw) - WINDOW) * k // max(1, n - 1) if len(raw) > WINDOW else 0
                    lang.append(label)
                    found.append(raw[at : at + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    return run


def remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def train(docs: DataFrame, sample: int = SAMPLE, per_doc: int = 4) -> ByteCnn | None:
    known = docs.where(F.col("lang").isNotNull() & (F.coalesce(remainder(), F.lit(2)) != 2)).select("doc_id", "lang", "text")
    total = known.select("doc_id").count()
    if not total:
        return None
    share = int(min(1.0, sample / total) * (1 << 20))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < share)
    rows = chosen.select("text", "lang").mapInArrow(_windows(per_doc), "lang string, window binary").toPandas()  # sample * per_doc windows
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "window"], kind="stable")
    classes = sorted(rows["lang"].unique())
    x = c.LOWER[np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)]
    y = rows["lang"].map({k: i for i, k in enumerate(classes)}).to_numpy()
    model = ByteCnn(classes)
    model.train(x, y)
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                got = model.predict(texts) if model else [("und", 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
