"""Language identification by a byte convolutional network trained in numpy.

A window of bytes is embedded, convolved with filters of several widths, max-pooled over the window
and classified by softmax.  A text is cut into fixed-length windows that cover all its bytes; its
class probabilities are the mean of its windows' by their bytes.  Because the input is bytes, a
filter's response is a sum of table entries per byte pair, so that scoring needs no products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import add_by_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 6
#: At most about so many labelled windows per language are fitted.
SAMPLE = 500
EPOCHS = 12
SEED = 7
UNDECIDED = "und"
_BATCH_WINDOWS = 256


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]  # per width: width x EMBED x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> ByteCnn:
        kernels = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS]
        return cls(langs, rng.normal(0, 0.5, (256, EMBED)), kernels, [np.zeros(FILTERS) for _ in WIDTHS],
                   rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs)))

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.biases, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, the responses of each byte pair (65536 x FILTERS) and of a last odd byte (256 x FILTERS)."""
        made = []
        for k, b in zip(self.kernels, self.biases):
            by_byte = [(self.embed @ k[j]).astype(np.float32) for j in range(len(k))]
            by_byte[0] = by_byte[0] + b.astype(np.float32)
            made.append([(by_byte[j][:, None] + by_byte[j + 1][None]).reshape(-1, FILTERS) if j + 1 < len(k) else by_byte[j]
                         for j in range(0, len(k), 2)])
        return made

    def pooled(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pairs = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
        out = []
        for w, parts in zip(WIDTHS, tables):
            n, total = windows.shape[1] - w + 1, None
            for j, part in enumerate(parts):
                got = part[(pairs if len(part) > 256 else windows)[:, 2 * j:2 * j + n]]
                total = got if total is None else np.add(total, got, out=total)
            out.append(total.max(1))
        return np.maximum(np.concatenate(out, 1), 0)

    def predict(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        z = self.pooled(windows, tables) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of params(); only the pooled places pass anything back."""
        n, embedded = len(windows), self.embed[windows]
        wide, best, pooled = [], [], []
        for k, b in zip(self.kernels, self.biases):
            w = len(k)
            cols = np.lib.stride_tricks.sliding_window_view(embedded, w, 1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
            r = cols @ k.reshape(-1, FILTERS) + b
            at = r.argmax(1)
            wide.append(cols)
            best.append(at)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ self.out.T) * (h > 0)
        d_embed, d_kernels, d_biases = np.zeros_like(self.embed), [], []
        for x, (k, cols, at) in enumerate(zip(self.kernels, wide, best)):
            g = back[:, x * FILTERS:(x + 1) * FILTERS]
            picked = cols[np.arange(n)[:, None], at]
            d_kernels.append(np.einsum("nf,nfc->cf", g, picked).reshape(k.shape))
            d_biases.append(g.sum(0))
            for j in range(len(k)):
                np.add.at(d_embed, windows[np.arange(n)[:, None], at + j], g[..., None] * k[j].T[None])
        return [d_embed, *d_kernels, *d_biases, h.T @ p, p.sum(0)]


def fit(texts: list[bytes], labels: list[str], seed: int = SEED, epochs: int = EPOCHS) -> ByteCnn:
    """Adam on cross entropy over one window per text."""
    rng, langs = np.random.default_rng(seed), sorted(set(labels))
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for row, t in zip(x, texts):
        row[:len(t[:WINDOW])] = np.frombuffer(t[:WINDOW], np.uint8)
    y = np.array([langs.index(v) for v in labels])
    model = ByteCnn.fresh(langs, rng)
    first, second, step = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            pick, step = order[at:at + 64], step + 1
            for p, g, m, v in zip(model.params(), model.gradients(x[pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, seed: int = SEED) -> ByteCnn | None:
    """Fits on at most about ``sample`` windows per language, each at a place drawn from the id; None without labels.

    Rows with a null text, language or id are left out of the fit.
    """
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30))
    below = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(int((1 << 30) * min(1.0, sample / n)))) for k, n in counts.items()])
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.greatest(F.length(text_col) - WINDOW // 2, F.lit(1))) + 1
    window = F.substring(F.col(text_col), start.cast("int"), F.lit(WINDOW))
    rows = usable.filter(draw < below).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), window.alias("window")).collect()
    rows.sort(key=lambda r: (r["id"], r["window"]))
    return fit([r["window"].encode() for r in rows], [r["lang"] for r in rows], seed)


def document_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts in ``data``: bytes (0 past a text's end), each one's text and its number of bytes."""
    sizes = ends - starts
    per = np.maximum(-(-sizes // WINDOW), 1)
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[text] + nth * WINDOW
    used = np.clip(ends[text] - begin, 0, WINDOW)
    inside = np.arange(WINDOW)[None] < used[:, None]
    windows = np.zeros((len(text), WINDOW), np.uint8)
    windows[inside] = data[(begin[:, None] + np.arange(WINDOW)[None])[inside]]
    return windows, text, used


def identify(docs: DataFrame, model: ByteCnn | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with the predicted language and its probability.

    A null text, one without a letter, and any text where no language could be learned get ``und``
    and score 0.  Ties go to the first language by name; repeated rows get equal results; columns of
    ``docs`` named like the new ones are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(model: ByteCnn, tables, texts: pa.Array) -> list[pa.Array]:
        raw = texts.fill_null("").cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
        windows, text, used = document_windows(data, bounds[:-1], bounds[1:])
        probs = np.concatenate([model.predict(windows[i:i + _BATCH_WINDOWS], tables) for i in range(0, len(windows), _BATCH_WINDOWS)])
        total = np.zeros((len(texts), len(model.langs)))
        np.add.at(total, text, probs * np.maximum(used, 1)[:, None])
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        letters = pc.match_substring_regex(texts.cast(pa.large_string()), r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
        names = [model.langs[b] if ok else UNDECIDED for b, ok in zip(best, letters)]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, total[np.arange(len(best)), best], 0.0))]

    def start():
        model = shared.value
        if not model:
            return lambda texts: [pa.array([UNDECIDED] * len(texts)), pa.array([0.0] * len(texts))]
        tables = model.tables()
        return lambda texts: scored(model, tables, texts)

    return add_by_text(docs, text_col, {lang_out: "string", score_out: "double"}, start, keep_text=keep_text)
