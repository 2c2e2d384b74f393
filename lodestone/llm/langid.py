"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax reads the language off it. As both are
linear, a trained model is one table of scores per hash bucket, and a prediction the mean of the rows that a text's
n-grams point at. Confidence is calibrated by a temperature. A softmax is sure of texts in no learned language too, so
rejection looks at familiarity: the mean log-frequency of a text's n-grams in training, 0 being that of uniform buckets.
Its limit depends on the number of n-grams and is one that hardly any calibration row, whole or cut short, falls below,
and lower yet where the same rows with shuffled letters leave room.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hash_unit
from lodestone.llm.textbatch import as_strings, slices

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
DIM = 16
#: The bounds of the training sample: this many different rows of each language at most, drawn by hash, none of more bytes
#: than this, and the languages of most rows.
SAMPLE_PER_LANG = 400
SAMPLE_BYTES = 1 << 16
LANGUAGES = 200
EPOCHS = 6
#: A small sample gets more epochs, up to this many steps.
STEPS = 600
#: About this share of the calibration rows may be rejected at most.
REJECT_SHARE = 0.001
#: Cuts of every calibration row, in words, and the fewest rows and cuts of a size that set a limit of their own.
CUTS = (1, 1, 2, 2, 3, 4, 6, 8, 12, 20, 40)
LEAST_CUTS = 100
#: Cuts of few rows do not show how low clean texts go; a limit is this many standard deviations below their mean or lower.
SPREAD = 4
#: The size of a text is the whole part of the binary logarithm of its n-grams, up to this.
SIZES = 16
UNKNOWN = "und"
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def _byte_classes() -> np.ndarray:
    """A-Z to a-z; bytes beyond ASCII as they are; all else one gap."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


def ngrams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram that lies within a text and isn't all gap, each text being padded by a gap at either end."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(body) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), lengths + 2)
    inside = np.ones(len(padded), bool)
    edge = np.cumsum(lengths + 2)
    inside[edge - 1] = False
    inside[edge - lengths - 2] = False
    padded[inside] = _byte_classes()[body]
    # Runs of gap are one gap, so that markup and numbers weigh little.
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (row[1:] != row[:-1])
    padded, row = padded[keep].astype(np.uint32), row[keep]
    buckets, rows = [], []
    for order in ORDERS:
        if len(padded) < order:
            continue
        h = padded[: len(padded) - order + 1].copy()
        for k in range(1, order):
            h = h * np.uint32(0x01000193) ^ padded[k : len(padded) - order + 1 + k]
        h = (h * np.uint32(_MULTIPLIERS[order])) >> np.uint32(17)
        same = row[: len(h)] == row[order - 1 :]
        buckets.append(h[same])
        rows.append(row[: len(h)][same])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(rows)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags of the texts: bucket ids, weights that sum to 1 per text, and where each text begins."""
    ids, weights, starts = [], [], [0]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        bucket, _ = ngrams(raw, np.array([0, len(raw)]))
        at, count = np.unique(bucket, return_counts=True)
        ids.append(at.astype(np.int64))
        weights.append(count / max(1, count.sum()))
        starts.append(starts[-1] + len(at))
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(weights) if ids else np.zeros(0), np.array(starts)


def sizes_of(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), SIZES)


def log_frequency(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each bucket, relative to uniform; every text weighs 1."""
    count = np.bincount(ids, weights=weights, minlength=BUCKETS)
    return np.log((count / max(count.sum(), 1e-9) + 1e-6) * BUCKETS)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs: the logits that an n-gram stands for
    bias: np.ndarray
    usual: np.ndarray  # the log-frequency of each bucket in training
    limits: np.ndarray  # by size: texts less familiar are rejected
    temperature: float = 1.0

    def read(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, familiarity and number of n-grams of each text."""
        n = len(offsets) - 1
        bucket, row = ngrams(body, offsets)
        total = np.bincount(row, minlength=n)
        sums = np.stack([np.bincount(row, weights=column[bucket], minlength=n) for column in (*self.table.T, self.usual)], 1) / np.maximum(total, 1)[:, None]
        return sums[:, :-1] + self.bias, sums[:, -1], total

    def strange(self, familiar: np.ndarray, total: np.ndarray) -> np.ndarray:
        return familiar < self.limits[sizes_of(total)]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, dim: int = DIM, rate: float = 0.5, seed: int = 7) -> Model:
    """SGD over minibatches of whole texts and of one short snippet of each, so that short texts are known too.

    Every fifth row is left for calibration. Rows must come in a fixed order; nothing else is random but for the seed.
    """
    langs = sorted(set(labels))
    y_of = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 10 else np.zeros(len(texts), bool)

    def snippet(text: str) -> str:
        words = text.split()
        k = int(rng.integers(2, 9))
        at = int(rng.integers(0, max(1, len(words) - k)))
        return " ".join(words[at : at + k])

    fit = [i for i in range(len(texts)) if not held[i]]
    bags = [(texts[i], labels[i]) for i in fit] + [(snippet(texts[i]), labels[i]) for i in fit]
    ids, weights, starts = features([t for t, _ in bags])
    y = np.array([y_of[x] for _, x in bags], np.int64)
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    out, bias = rng.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    order = np.arange(len(bags))
    epochs = max(epochs, -(-STEPS // max(1, -(-len(order) // 32))))
    for epoch in range(epochs):
        rng.shuffle(order)
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            spans = [np.arange(starts[i], starts[i + 1]) for i in batch]
            pos, who = np.concatenate(spans), np.repeat(np.arange(len(batch)), [len(x) for x in spans])
            i, w = ids[pos], weights[pos]
            mean = np.stack([np.bincount(who, weights=w * emb[i, k], minlength=len(batch)) for k in range(dim)], 1)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ out.T
            out -= step * (mean.T @ p) / len(batch) * 8
            bias -= step * p.mean(0)
            # Buckets are rarely shared inside a batch; the sum per bucket is what add.at gives.
            np.add.at(emb, i, -step * 25 * w[:, None] * back[who] / np.sqrt(len(batch)))
    model = Model(langs, emb @ out, bias, log_frequency(ids, weights), np.full(SIZES + 1, -np.inf))
    if not held.any():
        # Too few rows to leave some out of training: each is held against the n-grams of the others.
        spans = [slice(starts[i], starts[i + 1]) for i in range(len(texts))]
        others = [log_frequency(np.concatenate([ids[x] for x in spans if x != own]), np.concatenate([weights[x] for x in spans if x != own])) for own in spans] if len(texts) > 1 else []
        cuts = [calibration_cuts([t], rng) for t in texts[: len(others)]]
        parts = [tuple(familiarity(model, side, usual) for side in both) for both, usual in zip(cuts, others, strict=True)]
        model.limits = limits_of(*[tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in zip(*parts, strict=True)]) if parts else model.limits
        return model
    rest = [t for t, h in zip(texts, held, strict=True) if h]
    model.limits = limits_of(*[familiarity(model, side, model.usual) for side in calibration_cuts(rest, rng)])
    return calibrate(model, rest, [x for x, h in zip(labels, held, strict=True) if h])


def calibration_cuts(texts: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """The texts and cuts of them that hold letters, and the same with their letters shuffled."""
    clean = []
    for text in texts:
        words = text.split()
        for k in CUTS:
            at = int(rng.integers(0, max(1, len(words) - k + 1)))
            clean.append(" ".join(words[at : at + k]))
        clean.append(text)
    clean = [t for t in clean if any(map(str.isalpha, t))]
    noise = []
    for text in clean:
        chars = np.array(list(text), object)
        at = np.flatnonzero([c.isalpha() for c in text])
        chars[at] = chars[rng.permutation(at)]
        noise.append("".join(chars))
    return clean, noise


def familiarity(model: Model, texts: list[str], usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(familiarity, n-grams) of each text; texts are read in runs of bounded size."""
    out, run, size = [], [], 0
    for i, text in enumerate(texts):
        run.append(text)
        size += len(text)
        if size > 1 << 20 or i == len(texts) - 1:
            bucket, row = ngrams(*packed(run))
            total = np.bincount(row, minlength=len(run))
            out.append((np.bincount(row, weights=usual[bucket], minlength=len(run)) / np.maximum(total, 1), total))
            run, size = [], 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0, np.int64))


def limits_of(clean: tuple[np.ndarray, np.ndarray], noise: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By size: the familiarity that REJECT_SHARE of clean texts stay below, SPREAD deviations below their mean at least, or halfway to what noise reaches if that is lower.

    A size of too few clean texts has the limit of the nearest shorter size, or else the lowest of all.
    """
    out = np.full(SIZES + 1, np.nan)
    for size in range(SIZES + 1):
        x, y = np.sort(clean[0][sizes_of(clean[1]) == size]), np.sort(noise[0][sizes_of(noise[1]) == size])
        if len(x) >= min(LEAST_CUTS, len(clean[0]) / 20 + 1):
            low = min(x[int(len(x) * REJECT_SHARE)], x.mean() - SPREAD * x.std())
            out[size] = min(low, (low + y[int(len(y) * (1 - REJECT_SHARE))]) / 2) if len(y) and len(x) else low
    if np.isnan(out).all():
        return np.full(SIZES + 1, -np.inf)
    last = np.nanmin(out)
    for size in range(SIZES + 1):
        last = out[size] = last if np.isnan(out[size]) else out[size]
    return out


def calibrate(model: Model, texts: list[str], labels: list[str]) -> Model:
    y = np.array([model.langs.index(x) if x in model.langs else -1 for x in labels])
    logits = np.concatenate([model.read(*packed([t]))[0] for t in texts])[y >= 0]
    y = y[y >= 0]
    if not len(y):
        return model

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    return model


def held_out(id_col: Column) -> Column:
    """Rows that no training sees: CRC-32 of the id as text leaves 1 by 3. A null id is the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, most_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> Model | None:
    """Trains on per_lang rows of each language at most, those of the smallest hash of id and text; None without labelled rows.

    Rows that are alike in id, text and language are one. Texts of more than most_bytes aren't drawn, and of more than
    `languages` languages only those of most different rows are learned; so the sample is bounded in rows and bytes, whatever the table.
    """
    size = F.octet_length(F.col(text_col))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (size <= most_bytes) & ~held_out(F.col(id_col)))
    different = F.approx_count_distinct(F.xxhash64(F.col(id_col), F.col(text_col)))
    counts = rows.groupBy(F.col(lang_col).alias("__lang")).agg(different.alias("__count")).orderBy(F.desc("__count"), "__lang").limit(languages)
    shares = [(r["__lang"], min(1.0, 2 * per_lang / r["__count"])) for r in counts.collect()]
    if not shares:
        return None
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "__lang string, __share double"))
    unit = hash_unit(F.lit("langid"), F.col(id_col), F.md5(F.col(text_col).cast("binary")))
    # Twice as many as are due are let through, then cut: rows that are drawn by chance are rarely fewer than per_lang.
    drawn = rows.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), unit.alias("u")).join(shares, F.col("l") == F.col("__lang")).where("u < __share")
    once = drawn.groupBy("l", "u").agg(F.first("t").alias("t"))
    sample = once.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("u"))).where(F.col("n") <= per_lang)
    got = sorted(sample.select("u", "l", "t").collect(), key=lambda r: (r["u"], r["l"]))
    return train([r["t"] for r in got], [r["l"] for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row, and the columns of `keep`.

    A text that is null or has no letter is `und` with score 0 and rejected, and so is every text without a model.
    Any other text has a learned language, its calibrated probability, and is rejected only if it is less familiar than
    the model's limit for its size; a model of a single training row has no limits. Repeated rows are predicted alike; very long texts are read whole; other columns are ignored.
    """
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("__t"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, letters = as_strings(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            names, scores, rejected = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), ~letters
            if model is not None:
                for at, body, offsets in slices(text):
                    logits, familiar, total = model.read(body, offsets)
                    p = model.probabilities(logits)
                    rejected[at : at + len(p)] |= model.strange(familiar, total)
                    names[at : at + len(p)] = np.array(model.langs, object)[p.argmax(1)]
                    scores[at : at + len(p)] = np.clip(p.max(1), 0, 1)
                names[~letters], scores[~letters] = UNKNOWN, 0.0
            else:
                rejected[:] = True
            rest = [batch.column(i) for i in range(4, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected), *rest], names=out_names)

    kept = [f for f in out.schema.fields if f.name.startswith("__keep_")]
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    out_names = ["doc_id", "held_out", "lang_pred", "score", "rejected", *[f.name for f in kept]]
    found = out.mapInArrow(run, schema)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", *[F.col(f"__keep_{c}").alias(c) for c in keep])


def identify(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trains on docs (doc_id, text, lang) and predicts them all."""
    return predict(docs, fit(docs, per_lang=per_lang), keep=keep)
