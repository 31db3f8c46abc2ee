"""Language identification by a byte convolutional network trained in numpy.

One-hot bytes go through filters of several widths, so a filter's answer at a place is a sum of one table row per byte
of its width; the answers are max-pooled over a fixed-length window and a softmax layer gives the languages. A whole
text is cut into consecutive windows, all of which count by their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (2, 3, 4)
WINDOW = 256
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """tables[w][k] is 256 x filters: what byte k of a width-w place adds; dense is (filters * widths + 1) x classes."""

    classes: list[str]
    tables: dict[int, np.ndarray]
    dense: np.ndarray

    def __post_init__(self):
        self._pairs: dict[int, list[np.ndarray]] | None = None

    def __getstate__(self):
        return self.classes, self.tables, self.dense

    def __setstate__(self, state):
        self.classes, self.tables, self.dense = state
        self._pairs = None

    def _pair_tables(self) -> dict[int, list[np.ndarray]]:
        """Two bytes' rows added in advance, so a width takes half as many look-ups."""
        if self._pairs is None:
            self._pairs = {
                w: [
                    (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < w else t[k]
                    for k in range(0, w, 2)
                ]
                for w, t in self.tables.items()
            }
        return self._pairs

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """windows: n x WINDOW bytes; the greatest answer of each filter in each window."""
        pairs = self._pair_tables()
        out = []
        for at in range(0, len(windows), 32):
            x = windows[at : at + 32].astype(np.int32)
            two = (x[:, :-1] << 8) | x[:, 1:]
            parts = []
            for w, tables in pairs.items():
                places = x.shape[1] - w + 1
                z = None
                for j, t in enumerate(tables):
                    index = (two if 2 * j + 1 < w else x)[:, 2 * j : 2 * j + places]
                    z = t.take(index, axis=0) if z is None else np.add(z, t.take(index, axis=0), out=z)
                parts.append(z.max(axis=1))
            out.append(np.maximum(np.concatenate(parts, axis=1), 0))
        return np.concatenate(out)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        h = self.pooled(windows) @ self.dense[:-1] + self.dense[-1]
        h -= h.max(axis=1, keepdims=True)
        return h - np.log(np.exp(h).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability of each whole text; UNKNOWN and 0 for a null or a text without a letter, and for
        every text if no language was learned."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if self.classes and t and LETTER.search(t)]
        at = 0
        while at < len(todo):
            some, windows, weights, counts = [], [], [], []
            while at < len(todo) and len(windows) < 4096:
                x, n = windows_of(texts[todo[at]].encode("utf-8", "surrogatepass"))
                some.append(todo[at])
                windows.extend(x)
                weights.append(n)
                counts.append(len(n))
                at += 1
            logp = self.log_probabilities(np.stack(windows)) * np.concatenate(weights)[:, None]
            first = np.cumsum(counts) - counts
            total = np.add.reduceat(logp, first, axis=0) / np.add.reduceat(np.concatenate(weights), first)[:, None]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i, b, row in zip(some, best, p, strict=True):
                labels[i], scores[i] = self.classes[b], float(row[b])
        return labels, scores


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All bytes as rows of WINDOW, the last filled up with zeros, and each row's share of real bytes."""
    n = max(1, -(-len(data) // WINDOW))
    x = np.zeros(n * WINDOW, dtype=np.uint8)
    x[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    share = np.ones(n)
    share[-1] = max(1, len(data) - (n - 1) * WINDOW) / WINDOW
    return x.reshape(n, WINDOW), share


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], filters: int = 12, epochs: int = 8, batch: int = 64, rate: float = 0.05, seed: int = 7) -> ByteCnn:
    """Adagrad on the cross-entropy; only the places that win the pooling have gradients."""
    rng = np.random.default_rng(seed)
    tables = {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
    dense = rng.normal(0, 0.1, (filters * len(WIDTHS) + 1, len(classes))).astype(np.float32)
    seen_t = {w: np.full_like(t, 1e-4) for w, t in tables.items()}
    seen_d = np.full_like(dense, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows].astype(np.int32), labels[rows]
            # a window of a random length is a short text
            if rng.random() < 0.5:
                x = x.copy()
                x[:, int(rng.integers(16, WINDOW)) :] = 0
            b = len(rows)
            wins, parts = {}, []
            for w, t in tables.items():
                places = WINDOW - w + 1
                z = sum(t[k].take(x[:, k : k + places], axis=0) for k in range(w))
                wins[w] = z.argmax(axis=1)
                parts.append(np.take_along_axis(z, wins[w][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(parts, axis=1)
            h = np.maximum(raw, 0)
            logits = h @ dense[:-1] + dense[-1]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(b), y] -= 1
            p /= b
            grad = np.concatenate((h.T @ p, p.sum(axis=0, keepdims=True)))
            back = (p @ dense[:-1].T) * (raw > 0)
            seen_d += grad * grad
            dense -= rate * grad / np.sqrt(seen_d)
            for j, (w, t) in enumerate(tables.items()):
                own = back[:, j * filters : (j + 1) * filters]
                g = np.zeros_like(t)
                f = np.broadcast_to(np.arange(filters), own.shape)
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(x, wins[w] + k, axis=1), f), own)
                seen_t[w] += g * g
                t -= rate * g / np.sqrt(seen_t[w])
    return ByteCnn(classes, tables, dense)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 1200, max_labels: int = 2000, max_rows: int = 240_000) -> ByteCnn:
    """Trains on about ``per_label`` rows of each label (chosen by a hash of the id and the text; fewer where all labels
    together would pass ``max_rows``), a window of each from a hashed place in its text. So what comes to the driver stays
    near max_rows * WINDOW bytes. Every label is learned; more than max_labels distinct ones are refused. Without any
    labelled text that has a letter, an empty table included, the model knows no language and identify() gives UNKNOWN.
    Rows that repeat an id are rows of their own; null ids count like others.
    """
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(
        F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text"), F.col(label_col).alias("label")
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return ByteCnn([], {}, np.zeros((1, 0), dtype=np.float32))
    per_label = min(per_label, max_rows // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    at = F.pmod(F.xxhash64("doc", F.lit(2)), F.greatest(F.length("text") - F.lit(WINDOW // 2), F.lit(1)))
    # rows alike in id and text are taken together: the second bound holds whatever repeats there are
    rows = (
        known.where((F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(1_000_000)) / 1_000_000) < share[F.col("label")])
        .select("doc", "label", F.substring("text", (at + 1).cast("int"), F.lit(WINDOW)).alias("part"))
        .distinct()
        .orderBy("doc", "label", "part")
        .limit(2 * max_rows)
        .collect()
    )
    rows = [r for r in rows if r["part"]]
    classes = sorted(counts)
    if not rows:
        return ByteCnn([], {}, np.zeros((1, 0), dtype=np.float32))
    number = {c: i for i, c in enumerate(classes)}
    windows = np.stack([windows_of(r["part"].encode("utf-8", "surrogatepass")[:WINDOW])[0][0] for r in rows])
    return train(windows, np.array([number[r["label"]] for r in rows]), classes)


def identify(docs: DataFrame, model: ByteCnn, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (columns of these names are replaced); each row by its whole text alone. A null, empty or
    letterless text gets UNKNOWN and 0. Every input row gives one row, equal texts have equal results; an empty table gives
    none. Other columns stay, whatever their names."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        labels, scores = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    held = F.struct(*[F.col(c) for c in own]) if own else F.struct(F.lit(0).alias("none"))
    found = docs.select(held.alias("_docs"), predict(F.col(text_col)).alias("_found"))
    return found.select(*[F.col("_docs")[c].alias(c) for c in own], "_found.lang_pred", "_found.score")
