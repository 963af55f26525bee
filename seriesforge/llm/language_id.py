"""Language identification by error-correcting output codes.

Every language gets a codeword.  For each bit a binary logistic classifier over hashed
character trigrams predicts it; decoding adds up, for each codeword, the logistic losses of the
bits' margins, each weighted by how often the bit was right on documents kept out of its fit,
and takes the nearest codeword.  A document whose two nearest codewords are about equally near
is flagged as ambiguous.

Defined results: a text that is null or has no letter is ``und`` with score 0; labels that are
null teach nothing; if no label is left to learn from, every text is ``und``; repeated rows are
judged each; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_batches

UNDETERMINED = "und"
#: Buckets for character trigrams.
BUCKETS = 4096
#: The classifiers are fitted on this many documents of a language at most, and of all together.
SAMPLE, SAMPLE_ROWS = 240, 4800
#: Languages that are learned at most, the most frequent ones.
LANGUAGES = 200
#: Least probability of the nearest codeword for a prediction that isn't flagged.
CLEAR = 0.6


@dataclass
class EcocModel:
    languages: list[str]
    code: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed trigrams of the whole text."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keys = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA6B) + points[2:] * np.uint32(0xC2B2AE35)
    keys ^= keys >> np.uint32(15)
    keys *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(keys >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(1, len(keys))).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords far from each other: all splits for few languages, else the best of many random codes."""
    if n <= 6:
        splits = [k for k in range(1, 1 << max(0, n - 1))]
        return np.array([[1 if i == n - 1 or not k >> i & 1 else -1 for k in splits] for i in range(n)], dtype=np.float32).reshape(n, -1)
    rng, bits, best, least = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits)).astype(np.float32)
        apart = (bits - code @ code.T) / 2
        near = (apart + np.eye(n) * bits).min()
        if near > least and (abs(code.sum(0)) < n).all():
            best, least = code, near
    return best


def fit(x: np.ndarray, labels: list[str], rounds: int = 300) -> EcocModel:
    """Fits the bits' classifiers; every fifth row is kept out to measure how far each bit can be trusted."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(k) for k in labels]]
    out = np.arange(len(labels)) % 5 == 4 if len(labels) >= 50 else np.zeros(len(labels), dtype=bool)

    def descend(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient descent on the rows' multipliers: the weights are sums of rows, and rows are fewer than buckets."""
        z, t, n = x[rows], y[rows], max(1, int(rows.sum()))
        gram, a, b = z @ z.T, np.zeros_like(t), np.zeros(code.shape[1], dtype=np.float32)
        for _ in range(rounds):
            pull = t / (1 + np.exp(np.clip(t * (gram @ a + b), -30, 30)))
            a += 8.0 * (pull / n - 1e-4 * a)
            b += pull.mean(0)
        return z.T @ a, b

    w, b = descend(~out)
    tested = out if out.any() else ~out
    right = (np.sign(x[tested] @ w + b) == y[tested]).mean(0)
    w, b = descend(np.ones(len(labels), dtype=bool))
    return EcocModel(languages, code, w, b, np.maximum(right - 0.5, 0.01).astype(np.float32))


def decode(model: EcocModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest codeword, its probability) of each row of margins."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None])
    distance = (loss * model.trust).sum(-1) / model.trust.sum() * model.code.shape[1] if model.code.shape[1] else np.zeros((len(margins), len(model.languages)))
    near = np.exp(distance.min(1, keepdims=True) - distance)
    near /= near.sum(1, keepdims=True)
    return near.argmax(1), near.max(1)


def sample_labelled(docs: DataFrame, lang_col: str, learn_from) -> DataFrame:
    """At most SAMPLE documents of each language, those whose ids hash lowest: counted first, so that no group is sorted whole."""
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("doc_id"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    each = min(SAMPLE, SAMPLE_ROWS // max(1, len(counts)))
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 3.0 * each / n))]) if counts else F.create_map().cast("map<string,double>")
    order = F.xxhash64("doc_id")
    place = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    # thinned out where they are: only about three samples of each language are shuffled
    picked = rows.where(place < F.element_at(shares, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))
    return picked.withColumn("rank", rank).where(F.col("rank") <= each)


def train(docs: DataFrame, learn_from, lang_col: str = "lang") -> EcocModel | None:
    """Fits a model on a bounded sample; only feature vectors come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, features(text).tobytes()) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], ["lang", "x"])

    rows = map_batches(sample_labelled(docs, lang_col, learn_from).select("lang", "text"), run, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    order = np.random.default_rng(11).permutation(len(rows))
    x = np.stack([np.frombuffer(rows[k]["x"], dtype=np.float32) for k in order])
    return fit(x, [rows[k]["lang"] for k in order])


def predict(model: EcocModel | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    rows = [k for k, t in enumerate(texts) if model is not None and has_letter(t.as_py())]
    names = np.full(len(texts), UNDETERMINED, dtype=object)
    score = np.zeros(len(texts))
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        best, near = decode(model, np.stack([features(texts[k].as_py()) for k in part]) @ model.weights + model.bias)
        names[part] = [model.languages[b] for b in best]
        score[part] = near
    return names, score


def identify(docs: DataFrame, model: EcocModel | None) -> DataFrame:
    """docs with lang_pred, score and ambiguous added; columns of docs with these names give way to them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x bits
    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = pa_schema(kept, "lang_pred string, score double, ambiguous boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(score < CLEAR, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return map_batches(kept, run, schema)


def keep_identified(docs: DataFrame, model: EcocModel | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns as they are, that have a language with such a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict(shared.value, batch.column("text"))
            yield batch.filter(pa.array((names != UNDETERMINED) & (score >= least)))

    return map_batches(docs, run, docs.schema)


def pa_schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(more)
    return StructType([*df.schema.fields, *extra.fields])


def held_out(id_col: str = "doc_id"):
    """Whether a document's label is kept out of learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
