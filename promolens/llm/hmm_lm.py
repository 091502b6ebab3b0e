"""Operator 6: a hidden Markov language model.

A text is its words and one end token.  ``states`` hidden states emit word
buckets (``buckets`` hash buckets, and one for the end); within its bucket a
word has its smoothed share of the training counts:

    P(text) = sum over state paths of prod A(s', s) B(s, bucket(w)) * prod P(w | bucket(w))

Only the bounded part (A, B, start) is iterated; the counts of single words,
which grow with the corpus, enter through P(w | bucket(w)).

* Training: Baum-Welch.  Every training text is cut into stretches of
  ``STRETCH`` tokens, all of which are used; each task runs scaled forward and
  backward passes over its stretches side by side and sends one vector of
  expected counts; the vectors are added up in slices.
* Scoring: exact likelihood of the whole text by the scaled forward recursion.
  A long text is cut into segments whose K x K transfer matrices are computed
  side by side and then multiplied in order, which is the same recursion.
* Word counts: grouped over all training texts.  Words with a share of at least
  ``SHARE`` of the tokens (so at most ``1 / SHARE`` words) are given to every
  task; each other token meets its count in a join and the logarithms are
  summed per text.  No vocabulary goes through the driver as a whole.

Defined results: a null or empty text is just its end token; a null id is never
held out; repeated rows are counted and scored one by one; extra columns are
not read; with no training text every count is 0 and the model stays at its
seeded start.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import U, Words, arrow_map, documents, mix, shared_table, summed_vectors, text_blocks

STATES, BUCKETS, ROUNDS, SEED = 6, 1 << 14, 4, 7
STRETCH, SEGMENT = 64, 128
SHARE = 1.0 / (1 << 20)
PRIOR = 50.0                    # weight of the corpus-wide bucket shares in each state
END = U(0x454E44)               # the end token's word hash; texts cannot hold it as a word but by a hash collision
LOG10 = math.log(10.0)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block with an end token after each text, and where each text begins."""
    words = Words(data, offsets, lower=True)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hash
    return out, first


def _buckets(words: np.ndarray, buckets: int) -> np.ndarray:
    return np.where(words == END, buckets, (mix(words) % U(buckets)).astype(np.int64))


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """h (word hash), c of the training tokens, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                kept.append(_tokens(data, offsets)[0])
                size += len(kept[-1])
                if size > 4_000_000:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return arrow_map(train.select(text_col), count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Model:
    """Start, transition and bucket probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit       # (K,), (K, K), (buckets + 1, K)

    @staticmethod
    def initial(states: int, share: np.ndarray, seed: int) -> "Model":
        noise = np.random.default_rng(seed).normal(0, 0.5, (len(share), states))
        emit = share[:, None] * np.exp(noise)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def expected(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of the texts' stretches, and their log likelihood."""
        k = len(self.start)
        starts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first[:-1], first[1:], strict=True)])
        ends = np.append(starts[1:], len(tokens))
        order = np.argsort(starts - ends, kind="stable")            # longest first: the live ones are a prefix
        starts, size = starts[order], (ends - starts)[order]
        steps = int(size[0])
        live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]
        at = [tokens[starts[:n] + t] for t, n in enumerate(live)]
        alpha, scale = [], []
        for t, n in enumerate(live):
            a = (self.start if t == 0 else alpha[-1][:n] @ self.move) * self.emit[at[t]]
            c = a.sum(axis=1, keepdims=True)
            alpha.append(a / c)
            scale.append(c)
        emits = np.zeros((len(self.emit), k))
        moves = np.zeros((k, k))
        beta = np.ones((live[-1], k))
        for t in range(steps - 1, -1, -1):
            if len(beta) < live[t]:
                beta = np.concatenate([beta, np.ones((live[t] - len(beta), k))])
            gamma = alpha[t] * beta
            for s in range(k):
                emits[:, s] += np.bincount(at[t], weights=gamma[:, s], minlength=len(emits))
            if t:
                back = self.emit[at[t]] * beta / scale[t]
                moves += alpha[t - 1][:live[t]].T @ back
                beta = back @ self.move.T
        return gamma.sum(axis=0), moves * self.move, emits, float(sum(np.log(c).sum() for c in scale))

    def log_likelihood(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each text's bucket sequence, exact."""
        k = len(self.start)
        n = np.diff(first)
        per = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), per)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        starts = first[:-1][text] + rank * SEGMENT
        size = np.minimum(SEGMENT, first[1:][text] - starts)
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        m = np.broadcast_to(np.eye(k), (len(starts), k, k)).copy()
        log = np.zeros(len(starts))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            e = self.emit[tokens[starts[:live] + t]]
            # a text's first token has no move before it
            step = (m[:live].reshape(-1, k) @ self.move).reshape(live, k, k)
            if t == 0:
                fresh = rank[order][:live] == 0
                step[fresh] = m[:live][fresh]
            step *= e[:, None, :]
            c = step.sum(axis=(1, 2))
            m[:live] = step / c[:, None, None]
            log[:live] += np.log(c)
        out = np.zeros(len(n))
        state = np.tile(self.start, (len(n), 1))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        base = np.cumsum(per) - per
        for r in range(int(per.max()) if len(per) else 0):
            rows = np.flatnonzero(per > r)
            seg = back[base[rows] + r]
            v = np.einsum("ij,ijk->ik", state[rows], m[seg])
            c = v.sum(axis=1)
            state[rows] = v / c[:, None]
            out[rows] += np.log(c) + log[seg]
        return out


def train(texts: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED,
          text_col: str = "text") -> tuple[Model, list[float]]:
    """The model after ``rounds`` of Baum-Welch, and the log likelihood before each."""
    model, n, trace = Model.initial(states, share, seed), len(share), []
    for _ in range(rounds):
        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> np.ndarray:
            total = np.zeros(states + states * states + n * states + 1)
            for batch in batches:
                for _, _, data, offsets in text_blocks(batch.column(0), 1 << 20):
                    words, first = _tokens(data, offsets)
                    s, m, e, log = model.expected(_buckets(words, n - 1), first)
                    total += np.concatenate([s, m.ravel(), e.ravel(), [log]])
            return total

        total = summed_vectors(texts.select(text_col), states + states * states + n * states + 1, count)
        s, m, e = total[:states], total[states:states + states * states].reshape(states, states), total[states + states * states:-1].reshape(n, states)
        if not s.sum():
            break
        trace.append(float(total[-1]))
        e, m, s = e + PRIOR * share[:, None], m + 1.0, s + 1.0
        model = Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))
    return model, trace


def score(docs: DataFrame, states: int = STATES, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = SEED,
          text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    texts = rows.where(~F.col("held_out")).select("text")
    vocabulary = shared_table(word_counts(texts), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()

    # bucket totals (bounded) and the words that every task gets (at most 1 / SHARE)
    def totals(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, buckets + 1))
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            b = _buckets(h, buckets)
            out += np.array([np.bincount(b, weights=c, minlength=buckets + 1), np.bincount(b, minlength=buckets + 1)])
        return out.ravel()

    tokens, types = summed_vectors(vocabulary.select("h", "c"), 2 * (buckets + 1), totals).reshape(2, buckets + 1)
    mass = tokens + 0.5 * (types + 1)                                # one unseen word a bucket
    share = mass / mass.sum()
    least = max(1, math.ceil(SHARE * n))
    # the end token is always looked up here, also when it was never seen
    common = vocabulary.where((F.col("c") >= least) & (F.col("h") != int(END))).toArrow()          # at most 1 / SHARE rows
    end = vocabulary.where(F.col("h") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    h = np.append(common.column("h").to_numpy().view(np.uint64), END)
    c = np.append(common.column("c").to_numpy(), end)
    order = np.argsort(h)
    h, c = h[order], c[order]
    model, _ = train(texts, share, states, rounds, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_c, log_mass = np.log10(c + 0.5), np.log10(mass)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column("text"), 1 << 20):
                words, first = _tokens(data, offsets)
                bucket = _buckets(words, buckets)
                row = np.repeat(np.arange(b - a), np.diff(first))
                place = np.minimum(np.searchsorted(h, words), len(h) - 1)
                here = h[place] == words
                sums = np.bincount(row[here], weights=log_c[place[here]], minlength=b - a)
                known = np.bincount(row[here & (c[place] > 0)], minlength=b - a)
                path = model.log_likelihood(bucket, first) / LOG10 - np.bincount(row, weights=log_mass[bucket], minlength=b - a)
                part = batch.slice(a, b - a)
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[~here], np.arange(b - a + 1)).astype(np.int32)),
                                                pa.array(words[~here].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), pa.array(known.astype(np.int64)),
                                                  pa.array(sums), pa.array(path), rare], names=["doc_id", "held_out", "n_tokens", "known", "sums", "path", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = arrow_map(rows, run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, path double, rare array<long>")
    scored = shared_table(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("k"))
    rare = rare.join(vocabulary.where(F.col("c") < least), "h", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("seen"))
    total = F.col("sums") + F.coalesce("more", F.lit(0.0))
    return scored.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (v + 1)))).alias("base_score"), (total + F.col("path")).alias("score"))


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and HMM log10 probability of every document."""
    return score(documents(spark, sf_dir, "doc_id", "text"))
