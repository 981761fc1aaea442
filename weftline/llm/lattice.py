"""Language-model scores by subword lattice likelihood.

The pieces of an existing vocabulary get unigram probabilities from the distinct training words: counts of the
vocabulary's own segmentation, then rounds of expected counts over all segmentations. A text's probability is the sum
over all its segmentations, by forward recursion in log space. Pieces do not cross white space, so the lattice of a text
falls apart at its words: each distinct word is run through the recursion once, and a text's score is a sum over its
words and an end. Beside its pieces a word seen in training has one arc for itself: with absolute discount D,
P(word) = max(c - D, 0) / N + (D V / N) P(pieces), which sums to one over all words and the end.

Word counts, piece counts and distinct words cover the whole corpus and stay in distributed tables; what tasks get whole
is the piece table (bounded by the vocabulary) and the HEAD most frequent words. All other words are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch
from weftline.llm.text import chunks, mix, utf8, word_hashes

HEAD = 400_000  # most words that are sent to every task
MERGE = 1_000_000  # word entries gathered in a task before they are added up
MERGE_BYTES = 16 << 20  # and bytes of their words
PRIOR = 0.1  # added to every piece count
EM_ROUNDS = 2
MARK = "▁".encode()
LONG = 64  # bytes from which a word gets a recursion of its own
_ODD = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def ragged(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of raw one after the other, and the offsets where each begins."""
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], raw.dtype)
    for i, j in chunks(at):  # a byte's index takes 24 bytes meanwhile
        out[at[i] : at[j]] = raw[np.repeat(start[i:j] - at[i:j], size[i:j]) + np.arange(at[i], at[j])]
    return out, at


def count_words(batches):
    """Arrow batches of (text, train) to batches of hash, word, n_train.

    At most MERGE entries and MERGE_BYTES of words (or one text's) are held. A word may come in several rows.
    """
    held: list[tuple] = []

    def merged():
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        words = np.concatenate([x[2] for x in held])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[3]) for x in held]))])
        held.clear()
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(back, n, len(uniq)).astype(np.int64)
        held.append((uniq, count, *ragged(words, at[first], at[first + 1] - at[first])))
        return held[0]

    def rows():
        h, n, words, at = merged()
        held.clear()
        for a, b in chunks(at):
            text = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer((at[a : b + 1] - at[a]).astype(np.int32).tobytes()), pa.py_buffer(words[at[a] : at[b]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h[a:b].view(np.int64)), text, pa.array(n[a:b])], names=["hash", "word", "n_train"])

    def over(most: int, most_bytes: int) -> bool:
        return sum(len(x[0]) for x in held) > most or sum(len(x[2]) for x in held) > most_bytes

    for batch in batches:
        data, at = utf8(batch.column("text"))
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for i, j in chunks(at):
            h, first, start, end, raw = word_hashes(data, at, i, j)
            if not len(h):
                continue
            n = np.repeat(train[i:j], np.diff(first)).astype(np.int64)
            uniq, pick, back = np.unique(h, return_index=True, return_inverse=True)
            held.append((uniq, np.bincount(back, n, len(uniq)).astype(np.int64), *ragged(raw, start[pick], (end - start)[pick])))
            if over(MERGE, MERGE_BYTES):
                merged()
                if over(MERGE // 2, MERGE_BYTES // 2):
                    yield from rows()
    if held:
        yield from rows()


def word_table(docs: DataFrame) -> DataFrame:
    """(text, train) to one row per distinct word: hash, word, n_train (its count in training documents)."""
    parts = docs.select(F.col("text").cast("string").alias("text"), "train").mapInArrow(count_words, "hash bigint, word string, n_train bigint")
    return parts.groupBy("hash", "word").agg(F.sum("n_train").alias("n_train"))


def vocabulary(path: str | None = None):
    """The SentencePiece model, its pieces as bytes and their ids; byte pieces stand for their byte, control pieces for none."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, texts = [], []
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        p = model.id_to_piece(i)
        texts.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode())
        ids.append(i)
    return model, np.array(ids), texts


class Lattice:
    """Forward (and backward) recursion over all segmentations of words into pieces with log probabilities."""

    def __init__(self, log_p: np.ndarray, path: str | None = None):
        self.model, ids, texts = vocabulary(path)
        self.n = self.model.vocab_size()
        self.log_p = log_p
        self.pieces: dict[bytes, list[int]] = {}
        for i, t in zip(ids.tolist(), texts):
            self.pieces.setdefault(t, []).append(i)
        self.sizes = sorted({len(t) for t in self.pieces})
        top = LONG + len(MARK) + 1
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(top, _ODD, dtype=np.uint64)]))
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(top, inverse, dtype=np.uint64)]))
        self.byte = mix(np.arange(1, 257, dtype=np.uint64))
        short = [t for t in self.pieces if len(t) <= top]
        keys = np.array([(self.byte[np.frombuffer(t, np.uint8)] * self.power[: len(t)]).sum() for t in short], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        # pieces of equal bytes (a letter and its byte piece) act as one edge
        self.same = [self.pieces[short[k]] for k in order]
        self.index = {short[k]: e for e, k in enumerate(order)}
        self.edge = np.array([np.logaddexp.reduce(log_p[s]) for s in self.same])
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.keys * _SPREAD) >> np.uint64(42)] = True

    def _edges(self, words: np.ndarray):
        """For words of one size (rows of bytes): (a, b, rows, edges) for every piece that spells bytes a to b."""
        m, n = words.shape
        prefix = np.zeros((n + 1, m), dtype=np.uint64)
        np.cumsum((self.byte[words] * self.power[:n]).T, axis=0, out=prefix[1:])
        for b in range(1, n + 1):
            for size in self.sizes:
                if size > b:
                    break
                a = b - size
                h = (prefix[b] - prefix[a]) * self.inverse[a]
                rows = np.flatnonzero(self.maybe[(h * _SPREAD) >> np.uint64(42)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                    hit = self.keys[at] == h[rows]
                    if hit.any():
                        yield a, b, rows[hit], at[hit]

    def forward(self, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word; with counts, also expected edge counts over all segmentations."""
        m, n = words.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        kept = []
        for a, b, rows, edges in self._edges(words):
            alpha[b, rows] = np.logaddexp(alpha[b, rows], alpha[a, rows] + self.edge[edges])
            if counts is not None:
                kept.append((a, b, rows, edges))
        if counts is None:
            return alpha[n], None
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0.0
        for a, b, rows, edges in reversed(kept):
            beta[a, rows] = np.logaddexp(beta[a, rows], self.edge[edges] + beta[b, rows])
        expected = np.zeros(len(self.edge))
        for a, b, rows, edges in kept:
            expected += np.bincount(edges, np.exp(alpha[a, rows] + self.edge[edges] + beta[b, rows] - alpha[n, rows]) * counts[rows], len(self.edge))
        return alpha[n], expected

    def long_word(self, word: bytes, expected: np.ndarray | None = None) -> float:
        """The same recursion for one word of any length; its expected edge counts are added to expected."""
        edge = {t: float(np.logaddexp.reduce(self.log_p[s])) for t, s in self.pieces.items()} if not hasattr(self, "_edge") else self._edge
        self._edge = edge
        alpha = [0.0] + [float("-inf")] * len(word)
        for b in range(1, len(word) + 1):
            terms = [alpha[b - s] + edge[p] for s in self.sizes if s <= b and (p := word[b - s : b]) in edge]
            alpha[b] = float(np.logaddexp.reduce(terms))
        if expected is not None and alpha[-1] > float("-inf"):
            beta = [float("-inf")] * len(word) + [0.0]
            for a in range(len(word) - 1, -1, -1):
                out = [(p, edge[p] + beta[a + s]) for s in self.sizes if a + s <= len(word) and (p := word[a : a + s]) in edge]
                beta[a] = float(np.logaddexp.reduce([x for _, x in out]))
                for p, x in out:
                    if p in self.index:
                        expected[self.index[p]] += np.exp(alpha[a] + x - alpha[-1])
        return alpha[-1]

    def groups(self, words: pa.Array):
        """(rows, bytes matrix) for the marked words of each size up to LONG; (row, bytes) for each longer one."""
        data, at = utf8(words)
        size = np.diff(at)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n > LONG:
                for r in rows:
                    yield r, MARK + data[at[r] : at[r + 1]].tobytes()
                continue
            for part in np.array_split(rows, max(1, len(rows) * int(n) >> 20)):
                body = data[at[part][:, None] + np.arange(n)]
                yield part, np.concatenate([np.broadcast_to(np.frombuffer(MARK, np.uint8), (len(part), len(MARK))), body], axis=1)

    def piece_counts(self, expected: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for e, s in zip(expected, self.same):
            p = np.exp(self.log_p[s] - np.logaddexp.reduce(self.log_p[s]))
            out[s] += e * p
        return out


def _gather(rows: DataFrame, size: int) -> np.ndarray:
    """Counts per piece, added up on the executors; at most one row per piece reaches the driver."""
    out = np.zeros(size)
    for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def train_pieces(words: DataFrame, path: str | None = None, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probability of every piece from the distinct training words in words (hash, word, n_train)."""
    model, ids, _ = vocabulary(path)
    size = model.vocab_size()
    trained = words.where("n_train > 0").select("word")
    allowed = np.zeros(size, dtype=bool)
    allowed[ids] = True

    def log_of(counts: np.ndarray) -> np.ndarray:
        counts = np.where(allowed, counts + PRIOR, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(counts / counts.sum())

    def segmented(batches):
        own = vocabulary(path)[0]
        total = np.zeros(size)
        for batch in batches:
            found = own.encode(batch.column("word").to_pylist(), num_threads=1)
            total += np.bincount(np.fromiter((i for f in found for i in f), np.int64), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    log_p = log_of(_gather(trained.mapInArrow(segmented, "piece bigint, n double"), size))
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(log_p)

        def expect(batches):
            lattice = Lattice(shared.value, path)
            total = np.zeros(len(lattice.edge))
            for batch in batches:
                for _, matrix in lattice.groups(batch.column("word")):
                    if isinstance(matrix, bytes):
                        lattice.long_word(matrix, total)
                    else:
                        total += lattice.forward(matrix, np.ones(len(matrix)))[1]
            counts = lattice.piece_counts(total)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

        log_p = log_of(_gather(trained.mapInArrow(expect, "piece bigint, n double"), size))
    return log_p


def score_words(words: DataFrame, log_p: np.ndarray, n: int, v: int, discount: float, path: str | None = None) -> DataFrame:
    """words (hash, word, n_train) to hash, n_train, lp: log10 of the sum over all segmentations and the word's own arc."""
    shared = words.sparkSession.sparkContext.broadcast(log_p)

    def run(batches):
        lattice = Lattice(shared.value, path)
        for batch in batches:
            lp = np.zeros(batch.num_rows)
            for rows, matrix in lattice.groups(batch.column("word")):
                lp[rows] = lattice.long_word(matrix) if isinstance(matrix, bytes) else lattice.forward(matrix)[0]
            with np.errstate(divide="ignore"):
                arc = np.log(np.maximum(batch.column("n_train").to_numpy() - discount, 0.0) / max(n, 1))
            lp = np.logaddexp(arc, lp + np.log(discount * v / n if v else 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("n_train"), pa.array(lp / np.log(10))], names=["hash", "n_train", "lp"])

    return words.mapInArrow(run, "hash bigint, n_train bigint, lp double")


def score_documents(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for docs(doc_id, text, held_out).

    A null text is empty: only its end counts. Rows are told apart even if they repeat. Without any training document
    piece probabilities are uniform, the pieces have all the weight and base scores are those of unseen words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "held_out")
    n_docs = docs.where("not held_out").count()
    words = scratch.put(word_table(docs.select("text", (~F.col("held_out")).alias("train"))))
    seen = words.where("n_train > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") == 1), F.count_if(F.col("n_train") == 2)).first()
    discount = min(0.95, max(0.05, seen[2] / max(seen[2] + 2 * seen[3], 1)))
    v, n = seen[0] + (n_docs > 0), seen[1] + n_docs
    log_p = train_pieces(words, path)
    end_lp = float(np.log10(max(n_docs, 1) / max(n, 1)))
    table = scratch.put(score_words(words, log_p, n, seen[0], discount, path))
    scratch.drop(words)

    # The head: all words whose count is above a level chosen from a histogram of counts, at most `head` of them.
    level = F.floor(F.log2("n_train") * 8)
    steps = {r["l"]: r["n"] for r in table.where("n_train > 0").groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = None, head
    for step in sorted(steps, reverse=True):
        if steps[step] > room:
            break
        least, room = step, room - steps[step]
    is_head = (F.col("n_train") > 0) & (level >= (least if least is not None else 1 << 30))
    top = table.where(is_head).toArrow()
    order = np.argsort(h := top.column("hash").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((h[order], top.column("n_train").to_numpy()[order], top.column("lp").to_numpy()[order]))
    unit = float(n + v + 1)

    def run(batches):
        known, count, lp = shared.value
        known, count, lp = np.append(known, ~np.uint64(0)), np.append(count, 0), np.append(lp, 0.0)
        base = np.log10((count + 1) / unit)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in chunks(at):
                hs, first, *_ = word_hashes(data, at, i, j)
                owner = np.repeat(np.arange(j - i), np.diff(first))
                uniq, back = np.unique(hs, return_inverse=True)
                where = np.minimum(np.searchsorted(known, uniq), len(known) - 1)
                found = known[where] == uniq
                found[where == len(known) - 1] = False
                own = found[back]
                w, o = where[back[own]], owner[own]
                sums = [np.bincount(o, x[w], j - i).astype(np.float64) for x in (np.ones(len(known)), base, lp)]
                pair, times = np.unique(np.stack([owner[~own].astype(np.uint64), hs[~own]]), axis=1, return_counts=True) if (~own).any() else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
                offs = np.searchsorted(pair[0], np.arange(j - i + 1, dtype=np.uint64)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(times)], names=["hash", "c"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid + np.arange(j - i)), *(batch.column(c).slice(i, j - i) for c in ("doc_id", "held_out")),
                    pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), tail,
                ], names=["rid", "doc_id", "held_out", "n_words", "known", "base", "lp", "tail"])
                rid += j - i

    kind = dict(docs.dtypes)["doc_id"]
    rows = scratch.put(docs.mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, n_words bigint, known bigint, base double, lp double, tail array<struct<hash:bigint,c:bigint>>"))
    rest = rows.select("rid", F.inline("tail")).join(table.where(~is_head), "hash")
    unseen = F.log10((F.col("n_train") + 1) / F.lit(unit))
    rest = rest.groupBy("rid").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("c")).otherwise(0)).alias("t_known"),
        F.sum(F.col("c") * unseen).alias("t_base"), F.sum(F.col("c") * F.col("lp")).alias("t_lp"),
    )
    end_base = float(np.log10((n_docs + 1) / unit))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("tail").join(rest, "rid", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + zero("t_known") + int(n_docs > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base") + end_base).alias("base_score"), (F.col("lp") + zero("t_lp") + end_lp).alias("score"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_documents(docs.withColumn("held_out", held))
