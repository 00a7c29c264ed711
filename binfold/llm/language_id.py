"""Language ID by interpolated Kneser-Ney character models kept in sorted hash arrays.

Texts are lower-cased, every run of non-letters becomes one space, and four-character windows are packed into 64-bit
keys. All training texts are counted in the cluster; only the grouped key counts come to the driver, every one of
them: the model grows with the distinct four-grams of the input, not with its rows. The lower orders
follow from the distinct four-grams by continuation counts. Languages are fitted in groups of ``GROUP``: a group has
one sorted key array per order with a row of log-probabilities per key and a column per language, so a position costs
one binary search a group, and no language pays for the four-grams of all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
BITS = np.uint64(16)
UNDETERMINED = "und"
GROUP = 8
USUAL = 0.99  # quantile of calibration texts that the rejection threshold is a multiple of
FEW = 10  # calibration texts below which a language takes the pooled range
_LETTER = None


def _letters() -> np.ndarray:
    """Code point to model symbol: letters map to themselves, all else to space (32)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)], dtype=np.uint16)
    return _LETTER


def symbols(text: str | None) -> np.ndarray:
    """Normalised symbols of a whole text between single spaces; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint16)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Letters beyond the basic plane share one symbol; there the distinction between them is not modelled.
    sym = _letters()[np.minimum(cp, 0xFFFF)]
    if cp.size and cp.max() > 0xFFFF:
        sym = np.where((cp > 0xFFFF) & np.array([chr(c).isalpha() for c in cp]), np.uint16(0xFFFE), sym)
    if not (sym != 32).any():
        return np.empty(0, np.uint16)
    sym = np.concatenate(([np.uint16(32)], sym, [np.uint16(32)]))
    return sym[np.concatenate(([True], ~((sym[1:] == 32) & (sym[:-1] == 32))))]


def windows(sym: np.ndarray) -> np.ndarray:
    """Packed windows of ORDER symbols, one for each symbol after the first; the text start is padded with spaces."""
    s = np.concatenate((np.full(ORDER - 2, 32, np.uint64), sym.astype(np.uint64)))
    key = np.zeros(len(s) - ORDER + 1, np.uint64)
    for j in range(ORDER):
        key = (key << BITS) | s[j : len(s) - ORDER + 1 + j]
    return key


def _suffix(key: np.ndarray, n: int) -> np.ndarray:
    return key & np.uint64((1 << (16 * n)) - 1)


@dataclass
class Part:
    """Up to ``GROUP`` languages in dense rows over the keys that one of them has."""

    keys: list[np.ndarray]  # per order 1..ORDER, sorted
    logp: list[np.ndarray]  # per order, rows = keys, columns = languages; interpolated log-probabilities
    context: list[np.ndarray]  # per context length 0..ORDER-1, sorted context keys
    log_backoff: list[np.ndarray]  # per context length, log of the interpolation weight (0 for an unseen context)
    log_unseen: float

    def at(self, key: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Rows of log-probabilities for packed windows, by their last n symbols."""
        if n == 0:
            return np.full((len(key), self.logp[0].shape[1]), self.log_unseen, np.float32)
        own = _suffix(key, n) if n < ORDER else key
        at = np.minimum(np.searchsorted(self.keys[n - 1], own), len(self.keys[n - 1]) - 1)
        hit = self.keys[n - 1][at] == own
        out = self.logp[n - 1][at]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            ctx = own[miss] >> BITS
            c = np.minimum(np.searchsorted(self.context[n - 1], ctx), len(self.context[n - 1]) - 1)
            weight = np.where((self.context[n - 1][c] == ctx)[:, None], self.log_backoff[n - 1][c], np.float32(0))
            out[miss] = weight + self.at(key[miss], n - 1)
        return out


@dataclass
class Model:
    langs: list[str]
    parts: list[Part]  # the languages in order, GROUP by GROUP
    mean: np.ndarray | None = None  # of the cross-entropy per language, on calibration texts
    per_symbol: np.ndarray | None = None  # variance that falls with the length
    floor: np.ndarray | None = None  # variance that stays
    max_z: np.ndarray | None = None  # rejection threshold per language
    temperature: float = 1.0
    rejected_share: float = 0.0  # of the calibration texts: the measured rate of false rejection

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        """Rows of log-probabilities for packed windows, a column per language."""
        return self.parts[0].at(key) if len(self.parts) == 1 else np.concatenate([p.at(key) for p in self.parts], axis=1)

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: nats per symbol for each language, and the number of symbols (0: no letter)."""
        syms = [symbols(t) for t in texts]
        n = np.array([max(0, len(s) - 1) for s in syms], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        has = np.flatnonzero(n)
        start = 0
        while start < len(has):  # blocks of whole texts bound the memory
            end, size = start, 0
            while end < len(has) and (end == start or size + n[has[end]] <= 1_000_000):
                size += n[has[end]]
                end += 1
            block = has[start:end]
            if len(block) == 1 and size > 4_000_000:  # one very long text: summed piece by piece
                key = windows(syms[block[0]])
                out[block[0]] = sum(self.log_probs(key[i : i + 1_000_000]).sum(axis=0, dtype=np.float64) for i in range(0, len(key), 1_000_000))
            else:
                lp = self.log_probs(np.concatenate([windows(syms[i]) for i in block]))
                out[block] = np.add.reduceat(lp, np.concatenate(([0], np.cumsum(n[block])[:-1])), axis=0, dtype=np.float64)
            start = end
        return -out / np.maximum(n, 1)[:, None], n

    def rejects(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """No letters, or a cross-entropy beyond the calibrated range of the best language."""
        best = h.argmin(axis=1)
        z = (h[np.arange(len(h)), best] - self.mean[best]) / np.sqrt(self.per_symbol[best] / np.maximum(n, 1) + self.floor[best])
        return (n == 0) | (z > self.max_z[best])


def fit(langs: list[str], lang_of: np.ndarray, key: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from four-gram counts: absolute discount n1 / (n1 + 2 n2) per order and language."""
    order = np.lexsort((key, lang_of))
    key, count = key[order], count[order]
    ends = np.searchsorted(lang_of[order], np.arange(len(langs) + 1))
    alphabet = len(np.unique(_suffix(key, 1)))
    return Model(langs, [_fit_part([(key[a:b], count[a:b]) for a, b in zip(ends[lo : lo + GROUP], ends[lo + 1 : lo + GROUP + 1])], -np.log(alphabet + 1.0)) for lo in range(0, len(langs), GROUP)])


def _fit_part(counts: list[tuple[np.ndarray, np.ndarray]], unseen: float) -> Part:
    """One part from sorted four-gram keys and their counts, per language."""
    grams = []
    for k, c in counts:
        own = [(k, c.astype(np.float64))]
        while len(own) < ORDER:  # continuation counts: distinct one-symbol extensions to the left
            shorter, times = np.unique(_suffix(own[0][0], ORDER - len(own)), return_counts=True)
            own.insert(0, (shorter, times.astype(np.float64)))
        grams.append(own)
    keys, logp, context, log_backoff = [], [], [], []
    below_keys, below_p = None, None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([own[n - 1][0] for own in grams]))
        ctx_union = np.unique(union >> BITS) if n > 1 else np.zeros(1, np.uint64)
        union_ctx = np.searchsorted(ctx_union, union >> BITS) if n > 1 else np.zeros(len(union), np.int64)
        p = np.full((len(union), len(grams)), np.exp(unseen)) if below_p is None else below_p[np.searchsorted(below_keys, _suffix(union, n - 1))]
        back = np.zeros((len(ctx_union), len(grams)), np.float32)
        for i, own in enumerate(grams):
            k, c = own[n - 1]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx_of = np.searchsorted(ctx_union, k >> BITS) if n > 1 else np.zeros(len(k), np.int64)
            total = np.bincount(ctx_of, c, len(ctx_union))
            kinds = np.bincount(ctx_of, minlength=len(ctx_union))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            back[:, i] = np.log(weight)
            p[:, i] *= weight[union_ctx]
            p[np.searchsorted(union, k), i] += np.maximum(c - d, 0) / total[ctx_of]
        keys.append(union)
        logp.append(np.log(p).astype(np.float32))
        context.append(ctx_union)
        log_backoff.append(back)
        below_keys, below_p = union, p
    return Part(keys, logp, context, log_backoff, float(unseen))


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def count_windows(rows: DataFrame) -> DataFrame:
    """``lang, key, n`` over all rows of ``lang, text``; tasks merge their batches before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge(lang: str, k: np.ndarray, c: np.ndarray) -> None:
            if lang in held:
                k, c = np.concatenate((held[lang][0], k)), np.concatenate((held[lang][1], c))
            u, inv = np.unique(k, return_inverse=True)
            held[lang] = (u, np.bincount(inv, c).astype(np.int64))

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (k, c) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "key", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            pending: dict[str, list[np.ndarray]] = {}
            size = 0
            for i, lang in enumerate(langs):
                s = symbols(texts[i].as_py())
                if not len(s):
                    continue
                pending.setdefault(lang, []).append(windows(s))
                size += len(s)
                if size > 4_000_000 or i == len(langs) - 1:
                    for name, parts in pending.items():
                        u, c = np.unique(np.concatenate(parts), return_counts=True)
                        merge(name, u, c)
                    pending, size = {}, 0
            for name, parts in pending.items():
                u, c = np.unique(np.concatenate(parts), return_counts=True)
                merge(name, u, c)
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from out()
                held.clear()
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibration_rows: int = 20_000, margin: float = 2.0) -> Model:
    """Fit on all labelled rows outside fold 0; fold 4 is kept from the counts and calibrates.

    Every counted four-gram enters the model. Bound (of the classifier, not of the rows it predicts):
    ``calibration_rows`` calibration texts chosen by hash. A text is rejected when its cross-entropy
    lies above the mean of its language by more than ``margin`` times a high quantile of that language's calibration
    texts, in units of a deviation that is fitted against length. Only texts whose label scores best count; languages
    with few of them take what holds over all languages. So texts like those seen are kept.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("fold", fold("id"))
    counts = count_windows(rows.where("fold in (1, 2, 3)")).persist()
    try:
        langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
        if not langs:
            raise ValueError("no labelled text with letters outside fold 0")
        code = {name: i for i, name in enumerate(langs)}
        names = counts.sparkSession.createDataFrame(list(code.items()), "lang string, code int")
        pdf = counts.join(F.broadcast(names), "lang").select("code", "key", "n").toPandas()
    finally:
        counts.unpersist()
    model = fit(langs, pdf["code"].to_numpy(), pdf["key"].to_numpy().view(np.uint64), pdf["n"].to_numpy())
    cal = rows.where("fold = 4")
    n_cal = cal.count()
    part = min(1.0, calibration_rows / max(n_cal, 1))
    cal = cal.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000))
    shared = cal.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = shared.value.cross_entropies(batch.column(1).to_pylist())
            truth = [code.get(x, -1) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(truth, pa.int32()), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], ["lang", "n", "h"])

    scored = cal.select("lang", "text").mapInArrow(run, "lang int, n long, h array<double>").where("n > 0 and lang >= 0").toPandas()
    shared.unpersist()
    _calibrate(model, scored["lang"].to_numpy(), scored["n"].to_numpy(), np.array(scored["h"].tolist()).reshape(len(scored), len(langs)), margin)
    return model


def _calibrate(model: Model, truth: np.ndarray, n: np.ndarray, h: np.ndarray, margin: float) -> None:
    k = len(model.langs)
    model.mean, model.per_symbol, model.floor = np.full(k, np.inf), np.ones(k), np.full(k, 0.01)
    model.max_z = np.full(k, 3.0 * margin)
    right = h.argmin(axis=1) == truth if len(h) else np.zeros(0, bool)  # else mislabelled or mixed: no measure of the language
    x, size = (h[right, truth[right]], n[right].astype(float)) if right.any() else (np.zeros(0), np.zeros(0))

    def shape(x: np.ndarray, size: np.ndarray) -> tuple[float, float, float, np.ndarray]:
        mean = np.average(x, weights=size)
        dev = (x - mean) ** 2
        per_symbol = max(1e-6, np.median(dev * size) / 0.4549)  # the median of a squared normal deviate
        floor = max(1e-4, float(np.median(dev[size >= np.median(size)])))
        return mean, per_symbol, floor, (x - mean) / np.sqrt(per_symbol / size + floor)

    if len(x) < FEW:
        return  # too few texts of any language to tell what is usual: nothing but letterless texts is rejected
    mean, per_symbol, floor, pooled = shape(x, size)
    model.mean[:], model.per_symbol[:], model.floor[:] = mean, per_symbol, floor
    usual = max(3.0, float(np.quantile(pooled, USUAL)))
    model.max_z[:] = margin * usual
    for i in range(k):
        own = truth[right] == i
        if own.sum() >= FEW:
            model.mean[i], model.per_symbol[i], model.floor[i], z = shape(x[own], size[own])
            high = max(3.0, float(np.quantile(z, USUAL)))
            model.max_z[i] = margin * (high if len(z) * (1 - USUAL) >= 1 else max(high, usual))  # a thin tail says little
    if len(h):
        gap = (h - h.min(axis=1, keepdims=True)) * n[:, None]
        grid = [0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]
        nll = [np.mean(np.log(np.exp(-t * gap).sum(axis=1)) + t * gap[np.arange(len(h)), truth]) for t in grid]
        model.temperature = grid[int(np.argmin(nll))]
        model.rejected_share = float(model.rejects(h, n).mean())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, lang_pred, score, rejected``; only the text is read for a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n = m.cross_entropies(batch.column(1).to_pylist())
            best = h.argmin(axis=1)
            gap = (h - h.min(axis=1, keepdims=True)) * n[:, None]
            score = np.where(n > 0, 1 / np.exp(-m.temperature * gap).sum(axis=1), 0.0)
            rejected = m.rejects(h, n)
            names = [m.langs[b] if size else UNDETERMINED for b, size in zip(best, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text the model does not reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~shared.value.rejects(*shared.value.cross_entropies(batch.column(at).to_pylist()))))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a name with a dot can't go through
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row.

    Learns from rows whose crc32(id) mod 5 is not 0 and whose text and label are present. ``lang_pred`` is the
    learned language of lowest cross-entropy, ``und`` for null, empty or letterless texts; ``score`` is its
    calibrated share of the probability (0 for ``und``). ``rejected``: ``und``, or a cross-entropy beyond the
    calibrated range. Ties go to the language first in order; repeated rows get equal results; a null id is in no
    training fold and counts as held in (``held_out`` false). With no usable label every row is ``und``. Empty
    input gives an empty result. Other columns are not read.
    """
    held = F.coalesce(fold(id_col) == 0, F.lit(False))
    try:
        model = train(docs, id_col, text_col, lang_col)
    except ValueError:
        return docs.select(id_col, held.alias("held_out"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return predict(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score", "rejected")
