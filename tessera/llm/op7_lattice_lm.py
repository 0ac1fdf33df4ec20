"""Language-model scores by a subword lattice.

A fixed vocabulary of pieces (a sentencepiece file with scores; it is not
trained here) spans a lattice over each word: every way to cut the word into
pieces is a path, and every path is such a cut. A piece's probability starts
from its score in the file (see Lattice.from_scores) and is re-estimated on all
words of the training texts, each as often as it occurs, by `ROUNDS` rounds of
expectation maximisation over all cuts, in which the file's probabilities stay
as a prior: they count as PRIOR times as many uses as the training texts have,
so the file's scores keep their weight however large the corpus is. A word's probability is the sum over
all its cuts, by the forward recursion, in plain products where they stay in range
and in log space elsewhere; a text's is the product
over its words and one end piece. No piece joins two words, so that is the sum
over all segmentations of the whole text. Characters without a piece are
spelled in byte pieces.

Beside it stands a word model: log10((c+1)/(N+V+1)) of each token, with c its
count, N all and V distinct tokens in training; the end counts as a token.

Word counts are never gathered or broadcast. Tasks deal the documents into
blocks of BLOCK_BYTES and write, in one pass, each document as the numbers of
its words within its block, and each block's distinct words with their numbers
and counts. Counts are added up by word with a partial aggregate before the
shuffle, each distinct word is scored once, and the answers are joined back to
the blocks, where documents are scored by their numbers alone. Block numbers
are written with the rows, so a task that is run again reads the same blocks.
Pieces, whose number is fixed, are all that the driver sees.

Defined results: null and empty texts are the end alone; repeated rows count
each and give repeated results; a null key is not held out. Very long texts are
read whole (a longer text is a block of its own), and so are very long words.
Without training rows N and V are 0 and pieces keep the file's scores; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, fold, materialize, table

#: Rounds of expectation maximisation, what each piece's count gets added, and the uses that the file's scores stand for, for each use in training.
ROUNDS, ADDED, PRIOR = 2, 0.05, 0.5
#: Bytes of text and distinct words that close a block; letters from which a word is read alone; words read side by side.
BLOCK_BYTES, BLOCK_WORDS, LONG, TOGETHER = 32 << 20, 2_000_000, 48, 20_000
#: Words, and their bytes, that a task reads at once.
GATHERED, GATHERED_BYTES = 50_000, 8 << 20
#: The least probability of a word that is a sum of plain products; what such products lose below 1e-308 is nothing beside it.
SMALLEST = 1e-250
_START = "▁"
_G = 0x9E3779B97F4A7C15


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> tuple[list[str], list[float], str]:
    """(pieces, scores, the end piece) of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not model.is_unknown(i) and i != model.bos_id()]
    return [model.id_to_piece(i) for i in kept], [model.get_score(i) for i in kept], model.id_to_piece(model.eos_id())


class PieceTable:
    """Pieces by a hash of their code points, for many substrings at a time."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.array([pow(_G, i, 1 << 64) for i in range(LONG + 2)], np.uint64)
        hashes = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            hashes[k] = self.of([ord(c) for c in piece])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.shift = np.uint64(64 - max(12, (8 * len(pieces)).bit_length()))
        slots = (self.hashes >> self.shift).astype(np.int64)
        self.slot = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.chain = int(np.unique(slots, return_counts=True)[1].max(initial=0))

    @staticmethod
    def of(codes: list[int]) -> int:
        value = 0
        for c in codes:
            value = (value * _G + c + 1) & 0xFFFFFFFFFFFFFFFF
        return value * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        row = self.slot[(hashes >> self.shift).astype(np.int64)]
        at = np.flatnonzero(row >= 0)
        row, want = row[at], hashes[at]
        for _ in range(self.chain):
            same = self.hashes[row] == want
            out[at[same]] = self.order[row[same]]
            at, row, want = at[~same], row[~same] + 1, want[~same]
            inside = row < len(self.hashes)
            at, row, want = at[inside], row[inside], want[inside]
        return out


class Lattice:
    """Log probabilities of pieces, and sums over all cuts of a word.

    Pieces are read along a tree of characters, so each place of a word costs
    a step for each character that some piece still matches.
    """

    def __init__(self, pieces: list[str], log_p: list[float], end: str):
        self.pieces, self.weights, self.end = pieces, np.array(log_p, np.float64), end
        self.log_p, self.number = dict(zip(pieces, log_p, strict=True)), {p: i for i, p in enumerate(pieces)}
        self._root, self._table, self._chances = None, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_root": None, "_table": None, "_chances": None}

    @classmethod
    def from_scores(cls, pieces: list[str], scores: list[float], end: str) -> Lattice:
        """The one mapping of scores to probabilities.

        The file's scores are merge ranks, not log probabilities: they order
        the pieces. By Zipf's law a piece's weight is 1 / (rank + 10), rank 0
        being the highest score and equal scores following the file's order;
        weights are divided by their sum.
        """
        order = sorted(range(len(pieces)), key=lambda i: -scores[i])
        weight = [0.0] * len(pieces)
        for rank, i in enumerate(order):
            weight[i] = 1 / (rank + 10)
        total = sum(weight)
        return cls(pieces, [math.log(w / total) for w in weight], end)

    @property
    def root(self) -> list:
        """Nodes are [children by character, log p or None, p, piece]."""
        if self._root is None:
            self._root = [{}, None, 0.0, ""]
            for piece, log_p in self.log_p.items():
                node = self._root
                for c in piece:
                    node = node[0].setdefault(c, [{}, None, 0.0, ""])
                node[1:] = log_p, math.exp(log_p), piece
        return self._root

    def _spelled(self, c: str) -> list[str]:
        return [f"<0x{b:02X}>" for b in c.encode("utf-8", "surrogatepass")]

    def _spelling(self, c: str) -> float:
        return sum(self.log_p.get(b, -20.0) for b in self._spelled(c))

    def log_probability(self, word: str) -> float:
        """ln of the sum over all cuts, forward in log space; 0 for an empty word."""
        if not word:
            return 0.0
        s, root, exp, log = _START + word, self.root, math.exp, math.log
        n = len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n + 1):
            terms = into[i]
            if len(terms) == 1:
                a = terms[0]
            elif terms:
                top = max(terms)
                a = top + log(sum([exp(t - top) for t in terms]))
            else:
                continue
            if i == n:
                return a
            children, j, alone = root[0], i, False
            while j < n:
                node = children.get(s[j])
                if node is None:
                    break
                j += 1
                if node[1] is not None:
                    into[j].append(a + node[1])
                    alone |= j == i + 1
                children = node[0]
            if not alone:
                into[i + 1].append(a + self._spelling(s[i]))
        return -math.inf

    def expect(self, word: str, count: float, into: dict[str, float]) -> None:
        """Add the expected uses of each piece in `count` such words.

        Forward and backward by plain products, rescaled wherever they grow small.
        """
        s, root = _START + word, self.root
        n = len(s)
        forward, scale = [0.0] * (n + 1), [0.0] * (n + 1)  # true value: forward[i] * exp(scale[i])
        forward[0] = 1.0
        edges: list[tuple[int, int, float, str | None]] = []
        shift = 0.0
        for i in range(n):
            if 0.0 < forward[i] < 1e-100:  # move the scale: all that lies ahead grows alike
                up = 1 / forward[i]
                for j in range(i, min(n, i + 64) + 1):
                    forward[j] *= up
                shift -= math.log(up)
            scale[i] = shift
            a, children, j, alone = forward[i], root[0], i, False
            while j < n:
                node = children.get(s[j])
                if node is None:
                    break
                j += 1
                if node[1] is not None:
                    forward[j] += a * node[2]
                    edges.append((i, j, node[2], node[3]))
                    alone |= j == i + 1
                children = node[0]
            if not alone:
                p = math.exp(self._spelling(s[i]))
                forward[i + 1] += a * p
                edges.append((i, i + 1, p, None))
        scale[n] = shift
        if not forward[n]:
            return
        # share[j]: expected visits of place j; an edge's share is its part of what flows into its end.
        share = [0.0] * n + [count]
        for i, j, p, piece in reversed(edges):
            if not share[j]:
                continue
            part = share[j] * forward[i] * p / forward[j]
            if scale[i] != scale[j]:
                part *= math.exp(scale[i] - scale[j])
            share[i] += part
            for used in (piece,) if piece is not None else self._spelled(s[i]):
                into[used] = into.get(used, 0.0) + part

    @property
    def table(self) -> PieceTable:
        if self._table is None:
            self._table = PieceTable(self.pieces)
        return self._table

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, int]]]:
        """Words of one length side by side: their numbers, code points, the piece that starts at each place with each length (-1: none), and the spelling's log p of letters without a piece."""
        codes = np.frombuffer("\n".join(map(_as_text, words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes = ends - starts
        for size in np.unique(sizes[(sizes > 0) & (sizes <= LONG)]).tolist():
            members = np.flatnonzero(sizes == size)
            for low in range(0, len(members), TOGETHER):
                who = members[low : low + TOGETHER]
                s = np.empty((size + 1, len(who)), np.uint64)
                s[0] = ord(_START)
                s[1:] = codes[starts[who][None, :] + np.arange(size)[:, None]]
                n, longest, powers = size + 1, self.table.longest, self.table.powers
                piece = np.full((n, longest + 1, len(who)), -1, np.int32)
                prefix = np.zeros((n + 1, len(who)), np.uint64)
                for i in range(n):
                    prefix[i + 1] = prefix[i] * np.uint64(_G) + s[i] + np.uint64(1)
                for l in range(1, min(longest, n) + 1):
                    part = (prefix[l:] - prefix[: n + 1 - l] * powers[l]) * np.uint64(0xD6E8FEB86659FD93)
                    piece[: n + 1 - l, l] = self.table.find(part.ravel()).reshape(part.shape)
                alone = piece[:, 1] < 0
                spelled = np.zeros((n, len(who)))
                if alone.any():
                    letters, back = np.unique(s[alone], return_inverse=True)
                    spelled[alone] = np.array([self._spelling(chr(c)) for c in letters.tolist()])[back]
                yield who, s, piece, alone, spelled

    def _edges(self, piece: np.ndarray, alone: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        log_p = np.where(piece >= 0, self.weights[piece], -np.inf)
        log_p[:, 1] = np.where(alone, spelled, log_p[:, 1])
        return log_p

    @staticmethod
    def _forward(log_p: np.ndarray) -> np.ndarray:
        """ln of the sum over all cuts of each word's beginnings, for words side by side."""
        n, longest = log_p.shape[0], log_p.shape[1] - 1
        a = np.full((n + 1, log_p.shape[2]), -np.inf)
        a[0] = 0.0
        for j in range(1, n + 1):
            terms = np.stack([a[j - l] + log_p[j - l, l] for l in range(1, min(longest, j) + 1)])
            top = terms.max(axis=0)
            a[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return a

    def _products(self, piece: np.ndarray, alone: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """The probability of the piece that starts at each place with each length, 0 where there is none."""
        p = self.chances[piece]
        if alone.any():
            p[:, 1] += np.where(alone, np.exp(spelled), 0.0)
        return p

    @property
    def chances(self) -> np.ndarray:
        """Probabilities of the pieces, and 0 for none, which is number -1."""
        if self._chances is None:
            self._chances = np.append(np.exp(self.weights), 0.0)
        return self._chances

    @staticmethod
    def _sums(p: np.ndarray) -> np.ndarray:
        """The sum over all cuts of each word's beginnings, by plain products."""
        n, longest = p.shape[0], p.shape[1] - 1
        a = np.zeros((n + 1, p.shape[2]))
        a[0] = 1.0
        for i in range(n):
            most = min(longest, n - i)
            a[i + 1 : i + 1 + most] += a[i] * p[i, 1 : most + 1]
        return a

    @staticmethod
    def _sums_back(p: np.ndarray) -> np.ndarray:
        """The sum over all cuts of each word's endings, by plain products."""
        n, longest = p.shape[0], p.shape[1] - 1
        b = np.zeros((n + 1, p.shape[2]))
        b[n] = 1.0
        for i in range(n - 1, -1, -1):
            most = min(longest, n - i)
            b[i] = np.einsum("lw,lw->w", p[i, 1 : most + 1], b[i + 1 : i + 1 + most])
        return b

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """ln of the sum over all cuts of each word."""
        out = np.zeros(len(words))
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.log_probability(_as_text(w))
        for who, _, piece, alone, spelled in self._groups([w if len(w) <= LONG else b"" for w in words]):
            whole = self._sums(self._products(piece, alone, spelled))[-1]
            small = whole < SMALLEST
            out[who] = np.log(np.where(small, 1.0, whole))
            if small.any():
                out[who[small]] = self._forward(self._edges(piece[..., small], alone[:, small], spelled[:, small]))[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The expected uses of each piece, in order, in so many of each word, over all cuts."""
        out, other = np.zeros(len(self.pieces) + 1), {}
        for w, c in zip(words, counts.tolist(), strict=True):
            if len(w) > LONG:
                self.expect(_as_text(w), c, other)

        def add(uses: np.ndarray, own: np.ndarray) -> None:
            nonlocal out
            out += np.bincount(own.ravel() + 1, uses.ravel(), len(out))  # none is number -1

        def spell(s: np.ndarray, alone: np.ndarray, uses: np.ndarray) -> None:
            letters, back = np.unique(s[alone], return_inverse=True)
            for c, u in zip(letters.tolist(), np.bincount(back, uses[alone]).tolist(), strict=True):
                for byte in self._spelled(chr(c)):
                    other[byte] = other.get(byte, 0.0) + u

        for who, s, piece, alone, spelled in self._groups([w if len(w) <= LONG else b"" for w in words]):
            n, longest = piece.shape[0], piece.shape[1] - 1
            p = self._products(piece, alone, spelled)
            a = self._sums(p)
            small = a[-1] < SMALLEST
            if small.any():
                keep = ~small
                self._expected_small(who[small], s[:, small], piece[..., small], alone[:, small], spelled[:, small], counts, add, spell)
                who, s, piece, alone, p, a = who[keep], s[:, keep], piece[..., keep], alone[:, keep], p[..., keep], a[:, keep]
            if not len(who):
                continue
            b = self._sums_back(p)
            share = counts[who] / a[-1]
            for i in range(n):
                most = min(longest, n - i)
                uses = p[i, 1 : most + 1]
                uses *= b[i + 1 : i + 1 + most]
                uses *= a[i] * share
                add(uses, piece[i, 1 : most + 1])
            if alone.any():
                spell(s, alone, p[:, 1])
        out = out[1:]
        for piece, u in other.items():
            if piece in self.number:
                out[self.number[piece]] += u
        return out

    def _expected_small(self, who: np.ndarray, s: np.ndarray, piece: np.ndarray, alone: np.ndarray, spelled: np.ndarray, counts: np.ndarray, add: Callable, spell: Callable) -> None:
        """The same in log space, for words whose probability is too small for plain products."""
        log_p = self._edges(piece, alone, spelled)
        a = self._forward(log_p)
        b = self._forward(_mirrored(log_p))[::-1]  # the sum over all cuts of each word's endings
        n, longest = piece.shape[0], piece.shape[1] - 1
        whole = a[-1] - np.log(counts[who])
        for l in range(1, min(longest, n) + 1):
            uses = np.exp(a[: n + 1 - l] + log_p[: n + 1 - l, l] + b[l:] - whole)
            add(uses, piece[: n + 1 - l, l])
            if l == 1 and alone.any():
                spell(s, alone, uses)


def _mirrored(log_p: np.ndarray) -> np.ndarray:
    """The edges of the words read from their ends."""
    n, longest = log_p.shape[0], log_p.shape[1] - 1
    out = np.full_like(log_p, -np.inf)
    for l in range(1, min(longest, n) + 1):
        out[: n + 1 - l, l] = log_p[: n + 1 - l, l][::-1]
    return out


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at the six white-space bytes of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _as_text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


class _Numbers(dict):
    """A number for each word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Block:
    def __init__(self, number: int):
        self.number, self.words, self.counts, self.bytes = number, _Numbers(), np.zeros(0, np.int64), 0

    def read(self, texts: list[str | None], held: list[bool]) -> list[bytes]:
        """Each text as the numbers of its words; words of texts that are not held out are counted."""
        parts, look = [], self.words.__getitem__
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter(map(look, words), np.int32, len(words)))
            self.bytes += len(text or "")
        seen = np.concatenate([np.zeros(0, np.int32), *(p for p, h in zip(parts, held, strict=True) if not h)])
        grown = np.bincount(seen, minlength=len(self.words))
        grown[: len(self.counts)] += self.counts
        self.counts = grown
        return [p.tobytes() for p in parts]


def _deal(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Documents (_key, _held, block, ids) and, where word is not null, blocks' words (block, id, word, n)."""
    kind = rows.schema["_key"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_held", "block", "ids", "word", "id", "n"]
        block = _Block(TaskContext.get().partitionId() << 32)
        key_type = None

        def words() -> Iterator[pa.RecordBatch]:
            known = list(block.words)
            for at in range(0, len(known), 50_000):
                part = known[at : at + 50_000]
                size = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(size, key_type), pa.nulls(size, pa.bool_()), pa.array(np.full(size, block.number)), pa.nulls(size, pa.binary()), pa.array(part, pa.binary()), pa.array(np.arange(at, at + size, dtype=np.int32)), pa.array(block.counts[at : at + size])], names=names)

        for whole in batches:
            key_type = whole.schema.field(0).type
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                ids = block.read(batch.column(2).to_pylist(), batch.column(1).to_pylist())
                size = len(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(size, block.number)), pa.array(ids, pa.binary()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64())], names=names)
                if block.bytes > block_bytes or len(block.words) > BLOCK_WORDS:
                    yield from words()
                    block = _Block(block.number + 1)
        if block.words:
            yield from words()

    return rows.select("_key", "_held", "_text").mapInArrow(deal, f"_key {kind}, _held boolean, block long, ids binary, word binary, id int, n long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of words put together, as many words of one length side by side cost little more than one."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= GATHERED or size >= GATHERED_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def train(words: DataFrame, documents: int, vocabulary: str, rounds: int = ROUNDS) -> Lattice:
    """Re-estimate the pieces on (word, c): the training words with their counts. A training text ends once."""
    pieces, scores, end = load_vocabulary(vocabulary)
    model = Lattice.from_scores(pieces, scores, end)
    told = np.exp(model.weights)
    spark = words.sparkSession
    for _ in range(rounds if documents else 0):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, uses = shared.value, 0.0
            for batch in _gathered(batches):
                uses = uses + own.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64))
            used = np.flatnonzero(uses) if isinstance(uses, np.ndarray) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(uses[used] if len(used) else [], pa.float64())], names=["piece", "n"])

        used = words.select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.full(len(pieces), ADDED)
        for r in used.collect():  # pieces of the fixed vocabulary at most
            counts[r["piece"]] += r["n"]
        counts[pieces.index(end)] += documents
        counts += PRIOR * counts.sum() * told
        model = Lattice(pieces, np.log(counts / counts.sum()).tolist(), end)
        shared.unpersist()
    return model


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of `sizes` values."""
    out, starts = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some])
    return out


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; `held_out` rows train nothing."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    dealt = materialize(_deal(rows, block_bytes), "dealt")
    texts, words = dealt.where(F.col("word").isNull()).select("_key", "_held", "block", "ids"), dealt.where(F.col("word").isNotNull()).select("block", "id", "word", "n")
    known = texts.groupBy("block").agg(F.count_if(~F.col("_held")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    documents, parts = known["n"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), known["blocks"])

    distinct = materialize(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    learned = distinct.where(F.col("c") > 0)
    found = learned.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = found["n"] + documents, found["v"] + (documents > 0)
    model = spark.sparkContext.broadcast(train(learned, documents, vocabulary or default_vocabulary(), rounds))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in _gathered(batches):
            out = batch.append_column("log_p", pa.array(own.log_probabilities(batch.column(0).to_pylist())))
            yield from out.rename_columns(["word", "c", "log_p"]).to_batches()

    answers = words.drop("n").join(distinct.mapInArrow(answer, "word binary, c long, log_p double"), "word").select(F.col("block").alias("_of"), "id", "c", "log_p")
    kind = rows.schema["_key"].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(answers_: pa.Table, docs_: pa.Table) -> pa.Table:
        own = model.value
        size = answers_.num_rows
        order, counts, log_p = np.empty(size, np.int64), np.empty(size), np.empty(size)
        order[:] = answers_.column("id").to_numpy()
        counts[order], log_p[order] = answers_.column("c").to_numpy(), answers_.column("log_p").to_numpy()
        base, seen = np.log10(counts + 1), (counts > 0).astype(np.float64)
        ids = [np.frombuffer(x, np.int32) for x in docs_.column("ids").to_pylist()]
        sizes, every = np.array([len(x) for x in ids], np.int64), np.concatenate([np.zeros(0, np.int32), *ids])
        tokens = sizes + 1
        columns = [
            docs_.column("_key").combine_chunks(),
            docs_.column("_held").combine_chunks(),
            pa.array(tokens),
            pa.array(_sums(seen[every], sizes).astype(np.int64) + (documents > 0)),
            pa.array(np.full(len(ids), n, np.int64)),
            pa.array(_sums(base[every], sizes) + math.log10(documents + 1) - tokens * math.log10(n + v + 1)),
            pa.array((_sums(log_p[every], sizes) + own.log_p[own.end]) / math.log(10)),
        ]
        return pa.Table.from_arrays(columns, names=names)

    grouped = answers.repartition(parts, "_of").groupBy("_of").cogroup(texts.repartition(parts, "block").groupBy("block"))
    return grouped.applyInArrow(score, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: scores of every document, learned off the fold that is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fold("doc_id", 7) == 2)
