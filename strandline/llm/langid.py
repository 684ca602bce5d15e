"""Operator 4: language identification as inference of a document's mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import crc32_mod

#: Labelled documents of each language whose n-grams are counted, about. The model has ``CELLS``
#: numbers for each language (half a megabyte) and goes to every task.
TRAIN_DOCUMENTS = 5_000
#: Byte trigrams are hashed to so many cells.
CELLS = 1 << 16
SMOOTH = 0.5
ROUNDS = 25
#: Languages below this share are dropped before any are tested.
FLOOR = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _cells(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, trigram cells, first of each row): trigrams of bytes in lower case,
    where all that is no letter is a space; those with two spaces in a row are left out."""
    for lo, hi, joined, at in textkernel.chunks(texts):
        b = _FOLD[np.frombuffer(b"\n" + joined, np.uint8)].astype(np.uint64)
        code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        ok = ~(((b[:-2] == 32) & (b[1:-1] == 32)) | ((b[1:-1] == 32) & (b[2:] == 32)))
        place = np.flatnonzero(ok)
        cell = (textkernel.mix64(code[place]) >> np.uint64(48)).astype(np.int64)
        yield lo, hi, cell, np.append(np.searchsorted(place, at), len(place))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, cell, first in _cells(batch.column(1).to_pylist()):
            for r in range(hi - lo):
                t = total.setdefault(langs[lo + r], np.zeros(CELLS, np.int64))
                t += np.bincount(cell[first[r] : first[r + 1]], minlength=CELLS)
    for lang, t in total.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["lang", "cell", "n"])


def _em(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture shares by expectation-maximisation, and their log-likelihood."""
    for _ in range(ROUNDS):
        q = p @ share
        share = share * (p.T @ (n / q)) / n.sum()
    return share, float(n @ np.log(p @ share))


def mixture(p: np.ndarray, n: np.ndarray, always: int) -> np.ndarray:
    """Shares of the components (columns of ``p``) for n-grams that occur ``n`` times.

    Starting from all, the least component goes as long as that costs less log-likelihood than
    its penalty, log(sum n) (a component's two parameters: presence and share). The column
    ``always`` (text in no known language) stays.
    """
    full = np.zeros(p.shape[1])
    share, best = _em(p, n, np.full(p.shape[1], 1 / p.shape[1]))
    keep = np.flatnonzero((share >= FLOOR) | (np.arange(len(share)) == always))
    if not (keep != always).any():
        keep = np.sort([int(np.argmax(np.where(np.arange(len(share)) == always, -1, share))), always])
    if len(keep) < len(share):
        share, best = _em(p[:, keep], n, np.full(len(keep), 1 / len(keep)))
    else:
        share = share[keep]
    penalty = np.log(max(n.sum(), 2))
    while (keep != always).sum() > 1:
        tested = np.where(keep == always, 2, share)
        rest = np.delete(np.arange(len(keep)), int(np.argmin(tested)))
        less, ll = _em(p[:, keep[rest]], n, np.full(len(rest), 1 / len(rest)))
        if best - ll > penalty:
            break
        keep, share, best = keep[rest], less, ll
    full[keep] = share
    return full


def _predict(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        always = len(langs)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, score, other, mix = [], [], [], []
            for lo, hi, cell, first in _cells(texts):
                for r in range(hi - lo):
                    t, own = texts[lo + r], cell[first[r] : first[r + 1]]
                    if not langs or not t or not _LETTER.search(t) or not len(own):
                        lettered = bool(langs and t and _LETTER.search(t))
                        pred.append(langs[0] if lettered else UNKNOWN)
                        score.append(0.0)
                        other.append(1.0)
                        mix.append([])
                        continue
                    counts = np.bincount(own, minlength=CELLS)
                    at = np.flatnonzero(counts)
                    share = mixture(table[at], counts[at].astype(np.float64), always)
                    best = int(np.argmax(share[:always]))
                    pred.append(langs[best])
                    score.append(float(min(max(share[best], 0.0), 1.0)))
                    other.append(float(share[always]))
                    mix.append([{"lang": langs[i], "share": float(share[i])} for i in np.flatnonzero(share[:always] > 0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(other, pa.float64()),
                 pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "held_out", "lang_pred", "score", "unknown_share", "mix"],
            )

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, unknown_share, mix by row.

    Trigram likelihoods of each language are counted over labelled documents (crc32(id) mod
    ``fold`` not ``held``, language and text not null): of each language all, or a share picked by
    the hash of the id that is expected to hold ``TRAIN_DOCUMENTS``, so a rare language is learnt
    as well as a common one. The table has ``CELLS`` cells a language.

    Each whole text is then explained as a mixture of the languages and of an unknown one, whose
    trigrams are all alike: shares by expectation-maximisation, languages dropped while that
    costs less likelihood than their penalty. lang_pred is the largest language left, score its
    share, mix all that are left.

    Texts that are null or have no letter get 'und', score 0 and unknown_share 1, as do all texts
    where no language is known. Letters that leave no trigram can't be told apart and get the
    first language with score 0. A null id counts as ''. Repeated rows are predicted each. The
    language, source and id of a row play no part in its prediction.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_mod(id_col, fold) == held).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(_model(docs, id_col, text_col, lang_col, fold, held)), "doc_id long, held_out boolean, lang_pred string, score double, unknown_share double, mix array<struct<lang:string,share:double>>")


def _model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: int, held: int) -> Broadcast:
    """(languages, likelihood of each trigram cell by language and last under none), for every task."""
    known = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .where((crc32_mod("doc_id", fold) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    )
    # One row for each language; the hash's 62 bits are wide enough for a share of any corpus.
    share = known.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), F.lit(float(TRAIN_DOCUMENTS)) / F.count(F.lit(1))).alias("part"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 2).cast("double") / F.lit(float(1 << 62))
    some = known.join(F.broadcast(share), F.col("lang") == F.col("of")).where(place < F.col("part")).select("lang", "text")
    cells = some.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(cells["lang"].unique())
    table = np.full((len(langs) + 1, CELLS), SMOOTH)
    for i, (_, own) in enumerate(cells.groupby("lang", sort=True)):
        table[i, own["cell"].to_numpy(np.int64)] += own["n"].to_numpy(np.float64)
    return docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray((table / table.sum(1, keepdims=True)).T)))


#: A document goes if no known language explains at least this share of it.
LEAST_KNOWN = 0.5


def known_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in known languages, all columns.

    Rejected are texts without a letter (null too) and texts more than half of which no known
    language explains, whatever their id; every row is judged by its own text. Where no language
    is known at all, only texts without a letter are rejected.
    """
    model = _model(docs, id_col, text_col, lang_col, 3, 1)
    judge = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            if not model.value[0]:
                yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in text.to_pylist()], pa.bool_()))
                continue
            for told in judge([pa.RecordBatch.from_arrays([text, text, text], names=["doc_id", "held_out", "text"])]):
                good = [lang != UNKNOWN and other <= 1 - LEAST_KNOWN for lang, other in zip(told.column("lang_pred").to_pylist(), told.column("unknown_share").to_pylist(), strict=True)]
                yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
