"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are a text's lower-cased words and the shapes of its blank-parted tokens (letters and
digits folded to classes, runs to one), hashed to TERMS dimensions each. A bounded sample of
labelled documents gives inverse document frequencies and, by a truncated singular value
decomposition, the latent space. The sample's latent vectors are broadcast; every document is
projected, its exact cosines with all of them are blocked matrix products, and its NEIGHBOURS
nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import free_name, normal_words, string_slices, text_or_empty, word_hashes

TERMS, RANK, NEIGHBOURS = 2048, 48, 25
#: Labelled documents that the classifier is fitted on at most (those of least hash).
SAMPLE = 2048
THRESHOLD = 0.3
#: Similarities are raised to this power as votes; PRIOR_VOTE is the weight of the sample's mean.
POWER, PRIOR_VOTE = 8, 0.02

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58], _CLASS[:33] = 65, 97, 97, 48, 32


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with bytes folded to classes (A, a, 0, blank, other signs themselves) and runs to one."""
    folded = _CLASS[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = folded[1:] != folded[:-1]
    begins = offsets[:-1]
    keep[begins[begins < len(folded)]] = True
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def term_counts(raw: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts (texts, 2 * TERMS): words first, then shapes."""
    texts = len(raw[1]) - 1
    out = []
    for data, offsets in (words, shapes(*raw)):
        hashes, begin = word_hashes(data, offsets)
        owner = np.repeat(np.arange(texts), np.diff(begin))
        out.append(np.bincount(owner * TERMS + (hashes % np.uint64(TERMS)).astype(np.int64), minlength=texts * TERMS).reshape(texts, TERMS))
    return np.concatenate(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Voters:
    """The fitted classifier: what is broadcast (bounded by SAMPLE, TERMS and RANK)."""

    idf: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Voters:
        n, d = counts.shape
        idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = cls.weigh(counts, idf)
        r = min(rank, max(1, min(n, d)))
        random = np.random.default_rng(11).standard_normal((d, r + 16)).astype(np.float32)
        y = x @ random
        for _ in range(3):  # subspace iteration of the truncated SVD
            q, _ = np.linalg.qr(y)
            y = x @ (x.T @ q)
        q, _ = np.linalg.qr(y)
        _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        basis = np.ascontiguousarray(vt[:r].T.astype(np.float32))
        return cls(idf, basis, _unit(x @ basis), labels.astype(np.float32))

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * idf
        half = x.shape[1] // 2
        return np.concatenate([_unit(x[:, :half]), _unit(x[:, half:])], axis=1)

    def scores(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior, out = float(self.labels.mean()), np.zeros(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        rare = np.sqrt(max(prior, 1e-3) / max(1 - prior, 1e-3))  # votes of the rarer label count for more
        for a in range(0, len(counts), block):
            z = _unit(self.weigh(counts[a : a + block], self.idf) @ self.basis)
            cosines = z @ self.latent.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** POWER
            votes *= np.where(self.labels[near] > 0, 1.0, rare)
            out[a : a + block] = ((votes * self.labels[near]).sum(axis=1) + PRIOR_VOTE * prior) / (votes.sum(axis=1) + PRIOR_VOTE)
        return np.clip(out, 0, 1)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _slices(texts, terms) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) of slices of a batch's texts and their terms."""
    for first, data, offsets in string_slices(texts):
        rows = len(offsets) - 1
        (_, w, o), *_ = string_slices(terms.slice(first, rows), limit=1 << 40)
        for a in range(0, rows, 256):
            b = min(rows, a + 256)
            raw = (data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield first + a, term_counts(raw, (w[o[a] : o[b]], o[a : b + 1] - o[a]))


def _features(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        at, value = [], []
        for _, counts in _slices(batch.column(2), batch.column(3)):
            for row in counts:
                some = np.flatnonzero(row)
                at.append(some.astype(np.int32))
                value.append(row[some].astype(np.int32))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, kind), pa.array(value, kind)], names=["id", "quality", "at", "value"])


def _score(voters, text: str, name: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        held = voters.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, counts in _slices(batch.column(text), batch.column(batch.num_columns - 1)):
                out[first : first + len(counts)] = held.scores(counts)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names=[*batch.schema.names[:-1], name])

    return run


def fit_voters(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Voters:
    """Fit on at most ``sample`` labelled documents that aren't held out, those of least hash of id.

    Null or other labels than 0 and 1 are ignored, several labels of a document count as the least.
    Null ids have no label, null and empty texts count with their labels, repeated rows each as far as the sample goes,
    ids may have any type, other columns are ignored. Without labelled documents the voters give every text 0.5.
    """
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    chosen = known.groupBy(id_column).agg(F.min(label_column).cast("int").alias("_label")).orderBy(F.xxhash64(id_column), id_column).limit(sample)
    chosen = chosen.select(F.col(id_column).alias("_id"), "_label")
    texts = docs.select(F.col(id_column).alias("_doc"), text_or_empty(text_column).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    texts = texts.select(F.col("_id").cast("string"), "_label", "_text", normal_words("_text").alias("_terms"))
    rows = texts.mapInArrow(_features, "id string, quality int, at array<int>, value array<int>").orderBy("id", "at", "value").limit(sample).collect()
    counts = np.zeros((len(rows), 2 * TERMS), np.int32)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["value"]
    if not rows:
        return Voters(np.ones(2 * TERMS, np.float32), np.zeros((2 * TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    return Voters.fit(counts, np.array([r["quality"] for r in rows]))


def with_quality(docs: DataFrame, voters: Voters, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher where label 1 is likelier.

    Whole texts are scored, map-side; nothing is shuffled. Null and empty texts, and any text far
    from all labelled ones, get about the sample's mean. A column named ``score_column`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(voters)
    rest = docs.drop(score_column) if score_column in docs.columns else docs
    schema = T.StructType([*rest.schema.fields, T.StructField(score_column, T.DoubleType())])
    terms = free_name(rest, "terms")
    return rest.withColumn(terms, normal_words(text_column)).mapInArrow(_score(held, text_column, score_column), schema)
