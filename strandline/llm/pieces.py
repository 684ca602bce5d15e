"""Operator 1: sampled SentencePiece segmentations, forward filtering and backward sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import mix64

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 1_000_000
#: log weight of a byte that stands for part of a character without a piece.
BYTE_LOG = -16.0
_SPACE = 0x2581
#: The space mark itself, where a text has it: it has no piece and is written in bytes.
_MARK = 0x110000
#: Random numbers have so many bits; thresholds are whole numbers of as many.
_BITS = 36


def _weights(n: int) -> np.ndarray:
    """Odd weights of the first n places, for hashes of code points."""
    return mix64(np.arange(7001, 7001 + n, dtype=np.uint64)) | np.uint64(1)


class Vocabulary:
    """Pieces of a model: ids, log weights, and the bytes each stands for.

    A BPE model scores pieces by the order of their merges; that rank r gives the weight
    1 / (r + 2.7), a Zipf law, raised to ``alpha``. A unigram model's scores are log weights.
    """

    def __init__(self, model_file: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(size)])
        ranked = bool(len(plain) and (score[plain] == np.round(score[plain])).all())
        logs = -np.log(np.maximum(-score, 0) + 2.7) if ranked else score
        self.byte_ids = np.zeros(256, np.int32)
        spelled = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:-1], 16)] = i
                spelled[i] = bytes([int(pieces[i][3:-1], 16)])
        for i in plain:
            spelled[i] = pieces[i].replace(chr(_SPACE), " ").encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(b) for b in spelled], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        # For each length, all prefixes of pieces: hash, the piece that it is (or -1), its weight.
        entry: list[dict[int, tuple[int, float]]] = []
        self.weights = _weights(max((len(pieces[i]) for i in plain), default=0))
        for i in plain:
            code = np.array([ord(c) for c in pieces[i]], np.uint64)
            h = np.cumsum((code + np.uint64(1)) * self.weights[: len(code)], dtype=np.uint64)
            while len(entry) < len(code):
                entry.append({})
            for n in range(len(code)):
                entry[n].setdefault(int(h[n]), (-1, 0.0))
            entry[len(code) - 1][int(h[-1])] = (i, float(alpha * logs[i]))
        self.tables = []
        for d in entry:
            key = np.array(sorted(d), np.uint64)
            maybe = np.zeros(1 << 18, bool)  # most hashes that are no prefix are told by their top bits
            maybe[(key >> np.uint64(46)).astype(np.int64)] = True
            self.tables.append((key, np.array([d[int(k)][0] for k in key], np.int32), np.array([d[int(k)][1] for k in key]), maybe))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    end = np.cumsum(length)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)


class Lattice:
    """The lattices of distinct words, forward-filtered: for each node the pieces that end there,
    with the probability of each given all that comes before."""

    def __init__(self, v: Vocabulary, code: np.ndarray, start: np.ndarray, length: np.ndarray):
        """code: code points of all words; start, length: where each word stands."""
        words = len(start)
        word = np.repeat(np.arange(words), length)
        stop = np.repeat(start + length, length)
        value = code.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        first, end, piece, logw = [], [], [], []
        single = np.zeros(len(code), bool)
        for n, (key, ids, logs, maybe) in enumerate(v.tables):
            h = h + value[at + n] * v.weights[n]
            ok = maybe[(h >> np.uint64(46)).astype(np.int64)]
            at, h = at[ok], h[ok]
            place = np.minimum(np.searchsorted(key, h), len(key) - 1)
            ok = key[place] == h
            at, h, place = at[ok], h[ok], place[ok]
            hit = ids[place] >= 0
            first.append(at[hit])
            end.append(at[hit] + n + 1)
            piece.append(ids[place[hit]])
            logw.append(logs[place[hit]])
            if n == 0:
                single[at[hit]] = True
            more = at + n + 1 < stop[at]
            at, h = at[more], h[more]
            if not len(at):
                break
        bare = np.flatnonzero(~single)
        point = np.where(code[bare] == _MARK, _SPACE, code[bare])
        n_bytes = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        first.append(bare)
        end.append(bare + 1)
        piece.append(-1 - np.arange(len(bare), dtype=np.int32))
        logw.append(BYTE_LOG * n_bytes)
        first, end, piece, logw = (np.concatenate(x) for x in (first, end, piece, logw))
        # The ids that an edge stands for: one, or the bytes of a character.
        self.bare_ids = v.byte_ids[np.frombuffer("".join(map(chr, point)).encode(), np.uint8)]
        self.bare_len, self.bare_off = n_bytes, np.cumsum(n_bytes) - n_bytes
        # Nodes: one before each character and one at the end of each word.
        owner = word[first]
        self.root, self.leaf = start + np.arange(words), start + length + np.arange(words)
        src, dst, level = first + owner, end + owner, end - start[owner]
        order = np.argsort(dst, kind="stable")
        self.src, self.piece, dst, level, logw = src[order], piece[order], dst[order], level[order], logw[order]
        deepest = int(length.max())
        rise = np.argsort(level.astype(np.uint16 if deepest < 1 << 16 else np.int64), kind="stable")
        alpha = np.full(len(code) + words, -np.inf)
        alpha[self.root] = 0
        edge_of = np.concatenate([[0], np.cumsum(np.bincount(level, minlength=deepest + 1))])
        joint = np.empty(len(dst))
        for lo, hi in zip(edge_of[1:-1], edge_of[2:], strict=True):
            if lo == hi:
                continue
            own = rise[lo:hi]
            joint[own] = alpha[self.src[own]] + logw[own]
            d = dst[own]
            new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            alpha[d[new]] = np.logaddexp.reduceat(joint[own], new)
        p = np.exp(joint - alpha[dst])
        new = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.empty(0, bool)
        # Whole numbers add up to the same whatever stands before, so a word's thresholds are the
        # same in every chunk.
        begin = np.flatnonzero(new)
        part = (p * (1 << _BITS)).astype(np.int64)
        run = np.cumsum(part)
        self.upto = run - np.repeat((run - part)[begin], np.diff(np.append(begin, len(dst))))
        self.upto[np.append(begin[1:] - 1, len(dst) - 1) if len(dst) else begin] = 1 << _BITS
        self.upto += dst << _BITS

    def sample(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all occurrences in order of the text, number of edges of each occurrence)."""
        count = np.zeros(len(word), np.int64)
        active = np.argsort(word, kind="stable")  # words together, so that tables are read in order
        node, root = self.leaf[word[active]], self.root[word]
        steps = []
        while len(active):
            t = np.uint64(((len(steps) + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            u = (mix64(key[active] + t) >> np.uint64(64 - _BITS)).astype(np.int64)
            edge = np.searchsorted(self.upto, (node << _BITS) + u, side="right")
            steps.append((active, edge))
            count[active] += 1
            node = self.src[edge]
            go = node != root[active]
            active, node = active[go], node[go]
        after = np.cumsum(count)
        out = np.empty(int(after[-1]) if len(after) else 0, np.int64)
        for t, (who, edge) in enumerate(steps):
            out[after[who] - 1 - t] = edge
        return out, count

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of the edges, number of ids of each edge)."""
        piece = self.piece[edges]
        bare = piece < 0
        width = np.ones(len(piece), np.int64)
        width[bare] = self.bare_len[-1 - piece[bare]]
        out = np.repeat(piece, width)
        if bare.any():
            b = -1 - piece[bare]
            first = (np.cumsum(width) - width)[bare]
            out[_ranges(first, width[bare])] = self.bare_ids[_ranges(self.bare_off[b], width[bare])]
        return out, width


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def segment(v: Vocabulary, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each): one sampled segmentation a text. Each text gets
    a space in front, as the model expects; empty texts get no ids."""
    full = np.array([len(t) > 0 for t in texts], bool)
    counts = np.zeros(len(texts), np.int64)
    if not full.any():
        return np.empty(0, np.int32), counts
    code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32).copy()
    lengths = np.array([len(t) + 1 for t in texts if t], np.int64)
    at = np.cumsum(lengths) - lengths
    code[code == _SPACE] = _MARK
    code[code == 0x20] = _SPACE
    space = code == _SPACE
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[at] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(code)))
    value = (code.astype(np.uint64) + np.uint64(1)) * _weights(int(length.max()))[np.arange(len(code)) - np.repeat(start, length)]
    h = mix64(np.add.reduceat(value, start) + length.astype(np.uint64))
    _, sample, word = np.unique(h, return_index=True, return_inverse=True)
    own = length[sample]
    lattice = Lattice(v, code[_ranges(start[sample], own)], np.cumsum(own) - own, own)
    row = np.searchsorted(at, start, side="right") - 1
    ordinal = np.arange(len(start)) - np.searchsorted(start, at)[row]
    key = mix64(keys[full][row] + ordinal.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    edges, count = lattice.sample(word, key)
    ids, width = lattice.ids(edges)
    counts[full] = np.bincount(np.repeat(row, count), weights=width, minlength=len(at)).astype(np.int64)
    return ids, counts


def spell(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, number of bytes of each): the pieces' bytes without the space in front."""
    n = v.length[ids]
    raw = v.spelled[_ranges(v.offset[ids], n)]
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=n, minlength=len(counts)).astype(np.int64)
    keep = np.ones(len(raw), bool)
    first = (np.cumsum(total) - total)[total > 0]
    keep[first[raw[first] == 0x20]] = False
    lost = np.zeros(len(counts), np.int64)
    lost[total > 0] = raw[first] == 0x20
    return raw[keep], total - lost


def _encode(vocabulary, seed: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi in _chunks(texts):
                own = [t or "" for t in texts[lo:hi]]
                ids, counts = segment(v, own, mix64(keys[lo:hi] ^ mix64(np.uint64(seed))))
                raw, size = spell(v, ids, counts)
                text, edge = raw.tobytes(), np.cumsum(size)
                same = [text[e - n : e] == t.encode() for t, e, n in zip(own, edge.tolist(), size.tolist(), strict=True)]
                off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32())), pa.array(counts), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "lossless"],
                )

    return run


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, lossless by row: a segmentation sampled from the piece lattice.

    Pieces never hold a space but in front, so a text's lattice falls into those of its words. Of
    each distinct word of a chunk the lattice is built and forward-filtered once; every
    occurrence then samples its pieces backwards, each with its exact posterior probability
    (however long the word is: a lattice's work grows with the length of words and pieces)
    under the unigram weights of ``Vocabulary``. Random numbers are hashes of seed, row key (the
    id), place of the word and step: a text gets the same pieces wherever and whenever it runs.
    ``alpha`` above 1 favours likely segmentations, below 1 evens them out.

    Characters without a piece are written in their bytes, as is a literal space mark, so decoding
    gives the text back; lossless says that it did. Null and empty texts have no ids. A null id
    is keyed as 0; rows that repeat an id are segmented alike where their texts are. Other
    columns are not looked at. The vocabulary (its file is the only bound) goes to every task.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file, alpha))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("row_key")
    )
    return rows.mapInArrow(_encode(vocabulary, seed), "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, model_file: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text``: the text its ids spell; a null list spells null.

    Null elements and ids that the vocabulary doesn't have spell nothing; bytes that form no
    character spell U+FFFD. An empty table gives no rows; other columns stay, but one named text.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    fields = [f for f in encoded.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            lists = batch.column(ids_col).to_pylist()
            counts = np.array([len(x or ()) for x in lists], np.int64)
            flat = np.fromiter((-1 if i is None else i for x in lists for i in x or ()), np.int64, int(counts.sum()))
            known = (flat >= 0) & (flat < len(v.length))
            counts = np.bincount(np.repeat(np.arange(len(lists)), counts)[known], minlength=len(lists))
            raw, size = spell(v, flat[known], counts)
            text, edge = raw.tobytes(), np.cumsum(size)
            own = [None if x is None else text[e - n : e].decode(errors="replace") for x, e, n in zip(lists, edge.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(own, pa.string())], names=[*(f.name for f in fields), "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return encoded.mapInArrow(run, f"{schema}, text string")
