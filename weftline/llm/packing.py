"""Best-fit packing of token pieces into sequences: length patterns fitted to the histogram by non-negative least squares.

Only the histogram of piece lengths (at most LIMIT rows) reaches the driver. There, patterns of one to three lengths that
fill a sequence exactly are enumerated, repeat counts are fitted by non-negative least squares, rounded, and the lengths
left over are packed best fit first. Pieces then find their place by the rank within their length.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch
from weftline.llm.text import chunks, mix, powers, release, utf8

LIMIT = 2048
STEPS = 200  # of the least-squares fit
CHUNK_BYTES = 1 << 18  # of texts that are encoded together
CACHE_WORDS = 100_000  # words a worker keeps between chunks, some 40 bytes each
SAFE = 0x300  # below this code point NFC changes nothing and lower case is one to one, but for those marked unsafe

# ---- tokens -----------------------------------------------------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSAFE = range(5)

_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_CUT = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(SAFE + 1, _OTHER, np.uint8), np.arange(SAFE + 1, dtype=np.uint32)
    for c in range(SAFE):
        ch, low = chr(c), chr(c).lower()
        cat = unicodedata.category(ch)
        kind[c] = _SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else _LETTER if cat[0] == "L" else _NUMBER if cat[0] == "N" else _OTHER
        if len(low) != 1 or 0x1C <= c <= 0x1F or c == 0:
            kind[c] = _UNSAFE
        else:
            lower[c] = ord(low)
    kind[SAFE] = _UNSAFE
    return kind, lower


def _of_words(tok):
    """The tokenizer for lower-cased pre-tokens between blanks, which needs no expressions; None if it does not cut as this module does."""
    from tokenizers import normalizers, pre_tokenizers

    form = json.loads(tok.to_str())
    steps = [json.dumps(form[k], sort_keys=True) for k in ("normalizer", "pre_tokenizer")]
    if steps != [json.dumps(k, sort_keys=True) for k in (_NORMAL, _CUT)]:
        return None
    tok.normalizer = normalizers.Sequence([])
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
    return tok


class Tokens:
    """Token ids of whole texts: pre-tokens are found and hashed in bulk, and each distinct one is encoded once.

    Texts with characters whose normalisation depends on context, or with what may be a special token (<|), go to the
    tokenizer whole. Ids are the tokenizer's own, special tokens in a text included.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.one = _of_words(Tokenizer.from_file(path))
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind, self.lower = _classes()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode words whose hashes, in order, are not known yet."""
        tok, step = self.tok, 2000
        if self.one is not None:
            tok, step, words = self.one, 200, [w.lower() for w in words]
        lines = tok.encode_batch_fast([" ".join(words[i : i + step]) for i in range(0, len(words), step)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, dtype=np.uint32) for e in lines])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words) or (len(stop) and stop[-1] != len(ids)):  # some word is no single pre-token: one by one
            each = [np.asarray(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            ids, stop = np.concatenate(each), np.cumsum([len(x) for x in each])
        size = np.diff(stop, prepend=0)
        where = np.searchsorted(self.hashes, hashes)
        self.at = np.insert(self.at, where, len(self.ids) + stop - size)
        self.size = np.insert(self.size, where, size)
        self.hashes, self.ids = np.insert(self.hashes, where, hashes), np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; memory grows with all of them together."""
        whole = "\n".join(texts) + "\n"
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        raw = np.minimum(raw, SAFE)
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        kind, low = self.kind[raw], self.lower[raw]
        odd = np.add.reduceat(kind == _UNSAFE, begins) > 0
        if "<|" in whole:
            odd |= np.array(["<|" in t for t in texts])
        solid = kind != _SPACE
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        for q in np.flatnonzero(start & (raw == 39)):  # contractions: an apostrophe that begins a token
            two = whole[q + 1 : q + 3].lower()
            k = 1 if two[:1] in ("s", "t", "m", "d") else 2 if two in ("re", "ve", "ll") else 0
            if k and kind[q + 1] == _LETTER:
                start[q + 1] = False
                if kind[q + 1 + k] == _LETTER:
                    start[q + 1 + k] = True
        start[np.repeat(odd, np.diff(begins, append=len(raw)))] = False
        s = np.flatnonzero(start)
        if len(s):
            place = np.arange(len(raw)) - np.maximum.accumulate(np.where(start | ~solid, np.arange(len(raw)), 0))
            value = mix(low.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
            value[~solid] = 0
            h = mix(np.add.reduceat(value, s))
            stop = np.append(s[1:], len(raw))
            uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
            if len(self.hashes) > CACHE_WORDS:
                self._forget()
            where = np.searchsorted(self.hashes, uniq)
            new = np.flatnonzero(self.hashes[np.minimum(where, len(self.hashes) - 1)] != uniq) if len(self.hashes) else np.arange(len(uniq))
            if len(new):
                self._learn(uniq[new], [whole[s[f] : stop[f]].split(None, 1)[0] for f in first[new]])
                where = np.searchsorted(self.hashes, uniq)
            at, size = self.at[where][back], self.size[where][back]
            gaps = np.cumsum(size)
            flat = self.ids[np.repeat(at - (gaps - size), size) + np.arange(gaps[-1])]
            gaps = np.concatenate([[0], gaps])
            cut = gaps[np.searchsorted(s, np.concatenate([begins, [len(raw)]]))]
        else:
            flat, cut = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        if odd.any():
            which = np.flatnonzero(odd)
            for k, e in zip(which, self.tok.encode_batch_fast([texts[k] for k in which], add_special_tokens=False)):
                out[k] = np.asarray(e.ids, dtype=np.uint32)
        return out


_READY: dict[str, Tokens] = {}


def token_pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """(doc_id, text) to one row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A document is its token ids, then end_id; only documents longer than limit are cut. A null text is empty: one piece
    that holds end_id. tokenizer names a file of the public tokenizers.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        name = tokenizer
        if name is None:
            import public_tokenizers

            name = public_tokenizers.path("word_bpe_49k.json")
        if name not in _READY:
            _READY[name] = Tokens(name)
        for batch in batches:
            for i, j in chunks(utf8(batch.column("text"))[1], CHUNK_BYTES):
                part, rows = batch.slice(i, j - i), ([], [], [], [], [])
                for k, ids in enumerate(_READY[name].encode([t or "" for t in part.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, a in enumerate(range(0, len(ids), limit)):
                        cut = ids[a : a + limit]
                        for col, v in zip(rows, (k, p, a, len(cut), cut.tobytes())):
                            col.append(v)
                doc = part.column("doc_id").take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])
            release()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


# ---- plan -------------------------------------------------------------------------------------------------------------


def enumerate_patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """All patterns of one to three of these lengths that fill a sequence exactly, as rows padded with 0."""
    have = np.zeros(limit + 1, dtype=bool)
    have[lengths] = True
    rows = [np.array([[limit, 0, 0]])] if have[limit] else []
    a = lengths[lengths <= limit // 2]
    two = a[have[limit - a]]
    rows.append(np.stack([limit - two, two, np.zeros_like(two)], 1))
    for c in lengths[lengths <= limit // 3]:
        b = lengths[(lengths >= c) & (lengths <= (limit - c) // 2)]
        b = b[have[limit - c - b]]
        rows.append(np.stack([limit - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(rows).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares, min |A x - histogram| with x >= 0, by accelerated projected gradient steps.

    A counts lengths in patterns; long lengths weigh more, since they are harder to place afterwards.
    """
    if not len(patterns):
        return np.zeros(0)
    limit = len(histogram) - 1
    weight = np.arange(limit + 1) / limit
    weight[0] = 0.0
    flat = patterns.T
    into = lambda x: sum(np.bincount(c, x, limit + 1) for c in flat)
    back = lambda r: sum(r[c] for c in flat)
    v = np.ones(len(patterns))
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(weight**2 * into(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.05 * np.linalg.norm(back(weight**2 * into(v))) + 1e-12)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(weight**2 * (into(y) - histogram)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_packing(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, how many such sequences)] that hold the histogram exactly."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for k, n in histogram.items():
        left[k] = n
    patterns = enumerate_patterns(np.flatnonzero(left), limit)
    x = fit_repeats(patterns, left.astype(np.float64))
    plan: dict[tuple[int, ...], int] = {}
    for k in np.argsort(-x, kind="stable"):
        want = int(np.floor(x[k] + 0.5))
        if not want:
            break
        parts = [int(v) for v in patterns[k] if v]
        n = min(want, *(int(left[v]) // parts.count(v) for v in set(parts)))
        if n:
            plan[tuple(parts)] = plan.get(tuple(parts), 0) + n
            for v in parts:
                left[v] -= n
    # Residuals, longest first, into the fullest sequence that has room; sequences of equal content go together.
    room: dict[int, dict[tuple[int, ...], int]] = {}
    spaces: list[int] = []
    for length in range(limit, 0, -1):
        n = int(left[length])
        while n:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                many = limit // length
                for parts, count in (((length,) * many, n // many), ((length,) * (n % many), 1 if n % many else 0)):
                    if count:
                        _open(room, spaces, limit - length * len(parts), parts, count)
                n = 0
                continue
            space = spaces[k]
            parts, count = next(iter(room[space].items()))
            each = min(space // length, n)  # several into one sequence, then the rest elsewhere
            m = min(count, n // each)
            _close(room, spaces, space, parts, m)
            _open(room, spaces, space - each * length, parts + (length,) * each, m)
            n -= m * each
    for groups in room.values():
        for parts, count in groups.items():
            plan[parts] = plan.get(parts, 0) + count
    return sorted(plan.items(), reverse=True)


def _open(room, spaces, space, parts, count):
    if space not in room:
        room[space] = {}
        bisect.insort(spaces, space)
    room[space][parts] = room[space].get(parts, 0) + count


def _close(room, spaces, space, parts, count):
    room[space][parts] -= count
    if not room[space][parts]:
        del room[space][parts]
        if not room[space]:
            del room[space]
            spaces.remove(space)


# ---- placement --------------------------------------------------------------------------------------------------------


def place_pieces(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (a written table with doc_id, piece, length) plus sequence_id and offset; a column _salt goes.

    _salt, if there, differs in rows that are else equal, so that they too spread over slices.

    The rank of a piece within its length, in an order of hashed slices that are counted first, tells which repeat of
    which pattern takes it. The plan, whose size does not depend on the number of pieces, is a closure of the tasks.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    slices = max(8, min(1 << 16, n // 50_000))
    names = [c for c in pieces.columns if c != "_salt"]
    other = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    # hashed by all columns: copies of one doc_id spread too
    sliced = pieces.withColumn("_s", F.pmod(F.xxhash64(F.lit(3), *pieces.columns), F.lit(slices)))
    scratch = Scratch(spark, "pack")
    counts = scratch.put(sliced.groupBy("length", "_s").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_packing(histogram, limit)

    # For each length: from which rank on which pattern, place in it and sequence.
    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for parts, count in plan:
        offset, k = 0, 0
        while k < len(parts):
            v = parts[k]
            times = 1
            while k + times < len(parts) and parts[k + times] == v:
                times += 1
            starts.setdefault(v, []).append((used.get(v, 0), base, offset, times))
            used[v] = used.get(v, 0) + count * times
            offset += v * times
            k += times
        base += count
    table = {v: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for v, rows in starts.items()}
    shared = spark.sparkContext.broadcast(table)

    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_s")) - F.col("_n")
    froms = counts.withColumn("_from", before).select("length", "_s", "_from")
    ranked = sliced.join(froms, ["length", "_s"])
    order = Window.partitionBy("length", "_s").orderBy("doc_id", "piece", *other)
    ranked = ranked.withColumn("_rank", F.col("_from") + F.row_number().over(order) - 1).select(*names, "_rank")

    def place(batches):
        plan_of = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                own = np.flatnonzero(length == v)
                first, base_of, at, times = plan_of[int(v)]
                e = np.searchsorted(first, rank[own], side="right") - 1
                k = rank[own] - first[e]
                seq[own] = base_of[e] + k // times[e]
                off[own] = at[e] + k % times[e] * v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """Placed pieces that still have ids to (sequence_id, ids): at most LIMIT tokens a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids unless keep_ids is false.

    Tokens are made once: pieces go to the shared folder, without their ids if these are not kept. Rows that repeat are
    packed one by one; ties in length go by hash. Very long texts are encoded whole, one at a time, and cut into pieces of
    at most limit. Columns other than doc_id and text are left out. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    cut = token_pieces(docs, tokenizer, limit).withColumn("ids_crc32", F.crc32("ids"))
    cut = cut.withColumn("_salt", F.monotonically_increasing_id())  # kept as it is written
    return place_pieces(scratch.put(cut if keep_ids else cut.drop("ids")), limit)


def op5(spark, sf_dir: str) -> DataFrame:
    """The registered query: pieces of all documents with their sequence and place."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_ids=False)
