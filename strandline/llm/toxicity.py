"""Operator 8: multiple-instance toxicity scores, sentence scores combined by noisy-or."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import crc32_mod

#: Labelled documents that the model is fitted on, at most: those with the least hashes.
TRAIN_DOCUMENTS = 12_000
FEATURE_BITS = 20
#: Besides whole words, their first so many bytes are features, which catch inflected forms.
PREFIXES = (4, 6, 8)
#: Words that enter the model: at least so many documents, and so far from chance.
MIN_DOCUMENTS, MIN_Z, MAX_FEATURES = 6, 6.5, 4096
#: Log-odds of a sentence without any known word; a leak that the model learns stands for the
#: label rate of documents in which nothing is seen.
SILENT = -13.0
OFFENDING = 0.5

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_SIGMOID = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sentences(texts: list[str | None]) -> Iterator[tuple]:
    """(first row, end row, text bytes, feature and sentence of each word or prefix, row, start and
    end of each sentence); a sentence ends after . ! ? or at a line's end."""
    for lo, hi, joined, at in textkernel.chunks(texts):
        buf = np.frombuffer(joined.translate(textkernel._LOWER), np.uint8)
        h, starts, _, more = textkernel.word_hashes(buf, textkernel._NO_LETTER, PREFIXES)
        starts = np.concatenate([starts, *(starts[at_] for at_, _ in more)])
        h = np.concatenate([h, *(x for _, x in more)])
        stops = np.flatnonzero(_ENDS[buf]) + 1
        begins = np.concatenate([[0], stops[:-1]])
        feature = (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        row = np.searchsorted(at, begins, side="right") - 1
        yield lo, hi, buf, feature, np.searchsorted(stops, starts, side="right"), row, begins, stops


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A training document as one row: its label, and (sentence, word) pairs without repeats."""
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        y, bags = [], []
        for lo, hi, _, feature, sentence, row, *_ in _sentences(batch.column(1).to_pylist()):
            pair = np.unique((sentence.astype(np.int64) << FEATURE_BITS) | feature)
            own = row[pair >> FEATURE_BITS]
            cut = np.searchsorted(own, np.arange(hi - lo + 1))
            first = np.searchsorted(row, np.arange(hi - lo))
            for r in range(hi - lo):
                y.append(int(labels[lo + r]))
                bags.append(pair[cut[r] : cut[r + 1]] - (np.int64(first[r]) << FEATURE_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(bags, pa.list_(pa.int64()))], names=["y", "bag"])


def fit_noisy_or(y: np.ndarray, bags: list[np.ndarray], rounds: int = 300, rate: float = 0.3, decay: float = 1e-4):
    """(feature ids, weights, leak) that fit labels of bags: P = 1 - (1 - leak) * prod(1 - p)."""
    y = np.asarray(y, dtype=np.float64)
    docs = len(y)
    mask = (1 << FEATURE_BITS) - 1
    row = np.repeat(np.arange(docs), [len(b) for b in bags]) if docs else np.empty(0, np.int64)
    pair = np.concatenate(bags) if docs else np.empty(0, np.int64)
    word, sentence = pair & mask, pair >> FEATURE_BITS
    seen = np.unique((row << FEATURE_BITS) | word)
    df = np.bincount(seen & mask, minlength=mask + 1)
    pos = np.bincount(seen & mask, weights=y[seen >> FEATURE_BITS] if docs else None, minlength=mask + 1)
    rate0 = y.mean() if docs else 0.0
    z = (pos - df * rate0) / np.sqrt(np.maximum(df * rate0 * (1 - rate0), 1e-9))
    ok = np.flatnonzero((df >= MIN_DOCUMENTS) & (z >= MIN_Z))
    ids = np.sort(ok[np.argsort(-z[ok], kind="stable")[:MAX_FEATURES]])
    leak = float(np.clip(rate0, 1e-3, 0.5))
    if not len(ids):
        return ids, np.empty(0), leak
    place = np.full(mask + 1, -1)
    place[ids] = np.arange(len(ids))
    keep = place[word] >= 0
    row, sentence, f = row[keep], sentence[keep], place[word[keep]]
    key, inst = np.unique((row << 32) | sentence, return_inverse=True)
    owner = key >> 32
    w, l0 = np.full(len(ids), -SILENT / 2), np.log(leak / (1 - leak))
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for t in range(1, rounds + 1):
        p = _SIGMOID(SILENT + np.bincount(inst, weights=w[f], minlength=len(key)))
        lk = _SIGMOID(l0)
        none = np.log1p(-np.minimum(p, 1 - 1e-9))
        quiet = np.exp(np.bincount(owner, weights=none, minlength=docs)) * (1 - lk)
        slope = np.where(y > 0, -quiet / np.maximum(1 - quiet, 1e-9), 1.0)
        g = np.append(np.bincount(f, weights=(slope[owner] * p)[inst], minlength=len(ids)) / docs + decay * w, (slope * lk).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, l0 = w - step[:-1], l0 - step[-1]
    return ids, w, float(_SIGMOID(l0))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, bags = [], []
    for b in batches:
        y += b.column(0).to_pylist()
        flat, off = b.column(1).flatten().to_numpy(), b.column(1).offsets.to_numpy()
        bags += [flat[i:j] for i, j in zip(off[:-1] - off[0], off[1:] - off[0], strict=True)]
    ids, w, leak = fit_noisy_or(np.array(y), bags)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1).astype(np.int64)), pa.array(np.append(w, leak).astype(np.float64))], names=["feature", "weight"])


_OUT = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, w, leak = model.value
        weight = np.zeros(1 << FEATURE_BITS)
        weight[ids] = w
        known = np.zeros(1 << FEATURE_BITS, dtype=bool)
        known[ids] = True
        silent = np.log1p(-_SIGMOID(np.float64(SILENT)))
        for batch in batches:
            scores, found = [], []
            for lo, hi, buf, feature, sentence, row, begin, end in _sentences(batch.column(2).to_pylist()):
                hit = known[feature]
                # A word counts once in a sentence, as in training.
                pair = np.unique((sentence[hit].astype(np.int64) << FEATURE_BITS) | feature[hit])
                z = SILENT + np.bincount(pair >> FEATURE_BITS, weights=weight[pair & ((1 << FEATURE_BITS) - 1)], minlength=len(row))
                p = _SIGMOID(z)
                loud = np.flatnonzero(z > SILENT)
                quiet = np.bincount(row, minlength=hi - lo) * silent
                quiet += np.bincount(row[loud], weights=np.log1p(-np.minimum(p[loud], 1 - 1e-12)) - silent, minlength=hi - lo)
                scores.append(1 - np.exp(quiet) * (1 - leak))
                own: list[list] = [[] for _ in range(hi - lo)]
                bad = loud[p[loud] >= OFFENDING]
                if len(bad):
                    point = np.cumsum((buf & 0xC0) != 0x80)
                    first = np.searchsorted(row, np.arange(hi - lo))
                    at = lambda b: int(point[b - 1]) if b else 0
                    for s in bad:
                        zero = at(int(begin[first[row[s]]]))
                        own[row[s]].append({"begin": at(int(begin[s])) - zero, "end": at(int(end[s])) - zero, "score": float(p[s])})
                found += own
            s = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array(found, _OUT)], names=["doc_id", "held_out", "score", "offending"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, offending by row.

    Only labels of ids whose crc32 mod ``fold`` is not ``held`` are learnt from, at most
    ``TRAIN_DOCUMENTS`` of them (the least hashes of the id; a fixed bound, so they may be
    broadcast and fitted in one task). Several labels of an id count as their greatest.

    A sentence's score is a logistic function of its words; a document is toxic unless all its
    sentences and the leak are silent: score = 1 - (1 - leak) * prod(1 - p). offending lists the
    sentences with p >= 0.5: begin, end (code points, end exclusive, with the mark that ends it)
    and score. Texts are read whole.

    Null and empty texts get the leak as score. Null labels and labels without a document are
    ignored; without any label the score is a constant. Repeated rows are scored each.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_mod(id_col, fold) == held).alias("held_out"), F.col(text_col).alias("text"))
    known = (
        labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("l_id").isNotNull() & F.col("y").isNotNull() & (crc32_mod("l_id", fold) != held))
        .groupBy("l_id").agg((F.max("y") > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_DOCUMENTS)
    )
    bags = rows.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("y", "text").mapInArrow(_bags, "y int, bag array<long>")
    # The bags alone meet in one task, ``TRAIN_DOCUMENTS`` of them; the documents stay where they are.
    fitted = bags.repartition(1).mapInArrow(_train, "feature long, weight double").toPandas()
    leak = fitted.loc[fitted["feature"] == -1, "weight"]
    at = fitted[fitted["feature"] >= 0]
    model = sc.broadcast((at["feature"].to_numpy(np.int64), at["weight"].to_numpy(np.float64), float(leak.iloc[0]) if len(leak) else 0.05))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, offending array<struct<begin:long,end:long,score:double>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
