"""Quality rules by tokenizer fertility: what public vocabularies make of a text, judged by bands of its language or script.

Pass one counts words, repeats and tokens of whole texts; the bands are quantiles of all documents of a language and size,
counted in bins; pass two joins them. Measures of texts are made in NumPy over Arrow batches, everything else by Spark.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.packing import Tokens
from weftline.llm.shared import Scratch, broadcast_if_small
from weftline.llm.text import _BYTE, _M1, chunks, mix, powers, release, utf8, word_hashes

# All public vocabularies (byte_bpe_50k.json is the same as its .tiktoken); the first has byte fallback.
VOCABULARIES = ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
WINDOW = 8  # words of a window that may repeat
CHUNK_BYTES = 1 << 20
LONG_WORD = 4096  # bytes of a word that are encoded at a time
KNOWN_WORDS = 500_000  # whose tokens a worker remembers
BATCH_WORDS = 4096  # that are encoded together by the steps of packing
# The base rules.
MIN_WORDS, MAX_REPEAT = 20, 30
# Bands: quartiles are widened by FENCE times their distance from the median, and at least by
# FLOOR and one over the root of the size of the median, which short texts vary by. A language and
# size of fewer than ENOUGH documents has the band of the language over all sizes, but none for the entropy, which grows with
# size; a language of fewer has the outer limits alone.
BINS, FENCE, FLOOR, ENOUGH = 200, 6.0, 0.02, 100  # bins per unit of a measure
ENTROPY = "_e"
# Outer limits for every script, and for those whose words the vocabularies hardly know.
OUTER = {"min_chars": 0.25, "max_chars": 12.0, "max_bytes": 0.5, "min_entropy": 1.5}
OUTER_RARE = {"min_chars": 0.1, "max_chars": 12.0, "max_bytes": 1.0, "min_entropy": 1.5}
# Scripts by ranges of code points; capitals and small letters of ASCII are latin too.
SCRIPTS = [
    (0x00C0, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0E00, 0x0E7F, "thai"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
COMMON = ("latin", "cyrillic", "greek")
MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_tokens:array<bigint>,byte_share:double,entropies:array<double>,script:string>"
_NAMES = [*dict.fromkeys(name for _, _, name in SCRIPTS), "none"]
_FROM, _TO = (np.array([x[k] for x in SCRIPTS]) for k in (0, 1))
_OF = np.array([_NAMES.index(x[2]) for x in SCRIPTS])
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row of bytes."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def scripts(raw: np.ndarray, off: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """The script that most letters of each row have (ties: the first of _NAMES), as its place in _NAMES."""
    n = len(off) - 1
    count = np.zeros((n, len(_NAMES)), np.int64)
    count[:, 0] = _per_row(_LETTER[raw], off)
    lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xF0))
    if len(lead):
        b = [raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 0x3F for k in (1, 2)]
        point = np.where(raw[lead] < 0xE0, ((raw[lead].astype(np.int64) & 0x1F) << 6) | b[0], ((raw[lead].astype(np.int64) & 0x0F) << 12) | (b[0] << 6) | b[1])
        k = np.searchsorted(_FROM, point, side="right") - 1
        inside = (k >= 0) & (point <= _TO[k])
        count += np.bincount(row_of[lead[inside]] * len(_NAMES) + _OF[k[inside]], minlength=n * len(_NAMES)).reshape(n, -1)
    count[:, -1] = count[:, :-1].max(1) == 0
    return np.argmax(count, 1)


def duplicate_lines(raw: np.ndarray, off: np.ndarray, row_of: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of it."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros(n, np.int64)
    line = raw == 10
    begins = np.zeros(len(raw), bool)
    begins[off[:-1][off[:-1] < len(raw)]] = True
    begins[1:] |= line[:-1]
    s = np.flatnonzero(begins)
    size = np.diff(s, append=len(raw))
    place = np.arange(len(raw)) - np.repeat(s, size)
    value = _BYTE[raw] * powers(int(size.max()))[place]
    value[line] = 0
    h = mix(np.add.reduceat(value, s) + np.add.reduceat((~line).astype(np.uint64), s) * _M1)
    full = np.add.reduceat(solid.astype(np.int64), s) > 0
    row = row_of[s][full]
    key = mix(h[full] ^ mix((row + 1).astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def repeated_words(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that stand in a window that the row has twice or more."""
    if len(h) < WINDOW:
        return np.zeros(n, np.int64)
    m = len(h) - WINDOW + 1
    key = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        key = mix(key + h[k : k + m])
    whole = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
    key = mix(key[whole] ^ mix((row[whole] + 1).astype(np.uint64)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    again = whole[count[back] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    edge[again] += 1
    edge[again + WINDOW] -= 1
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


class Vocabulary:
    """encode() gives the ids of words, each encoded alone; is_byte marks ids of byte fallback."""

    def __init__(self, name: str):
        if not name.startswith("/"):
            import public_tokenizers

            name = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=name)
            self.is_byte = np.array([model.is_byte(k) for k in range(model.get_piece_size())])
            self.encode = lambda words: model.encode(words, num_threads=1)
        elif name.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(name, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.encode = lambda words: [model.encode_ordinary(w) for w in words]
        else:
            model = Tokens(name)
            model.tok.encode_special_tokens = True
            self.is_byte = np.zeros(model.tok.get_vocab_size(), bool)
            if model.one is None:  # cut in another way than the steps of packing cut
                self.encode = lambda words: [e.ids for e in model.tok.encode_batch_fast(words, add_special_tokens=False)]
            else:
                self.encode = lambda words: [ids for a in range(0, len(words), BATCH_WORDS) for ids in model.encode(words[a : a + BATCH_WORDS])]


class Known:
    """Token ids of words in several vocabularies; those met last are remembered up to KNOWN_WORDS."""

    def __init__(self, names: tuple[str, ...]):
        self.vocabularies = [Vocabulary(name) for name in names]
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.at = ([np.zeros(n, kind) for _ in self.vocabularies] for n, kind in ((0, np.uint32), (1, np.int64)))

    def tokens(self, h: np.ndarray, words) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vocabulary all ids of words with distinct hashes h and where each word's begin; words(k) gives the texts of the k-th ones."""
        if len(self.index) > KNOWN_WORDS:
            self.forget()
        where = np.fromiter(map(self.index.get, h.tolist(), repeat(-1)), np.int64, len(h))
        new = np.flatnonzero(where < 0)
        if len(new):
            texts, cut = words(new), LONG_WORD // 4
            parts = [len(t) // cut + (len(t) % cut > 0) for t in texts] if max(map(len, texts)) > cut else None
            short = texts if parts is None else [t[a : a + cut] for t in texts for a in range(0, len(t), cut)]
            where[new] = np.arange(len(new)) + len(self.index)
            self.index.update(zip(h[new].tolist(), where[new].tolist()))
            for v, vocabulary in enumerate(self.vocabularies):
                found = vocabulary.encode(short)
                size = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
                if parts is not None:
                    size = np.add.reduceat(size, np.concatenate([[0], np.cumsum(parts)[:-1]]))
                self.ids[v] = np.concatenate([self.ids[v], ids])
                self.at[v] = np.concatenate([self.at[v], self.at[v][-1] + np.cumsum(size)])
        out = []
        for ids, at in zip(self.ids, self.at):
            size = at[where + 1] - at[where]
            out.append((ids[_spread(at[where], size)], np.concatenate([[0], np.cumsum(size)])))
        return out


_READY: dict[tuple[str, ...], Known] = {}


def _entropy(row: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Bits of the distribution of ids in each row."""
    key, count = np.unique(row * (1 << 32) + ids, return_counts=True)
    of, total = key >> 32, np.maximum(np.bincount(row, minlength=n), 1)
    p = count / total[of]
    return np.bincount(of, weights=-p * np.log2(p), minlength=n) + 0.0


def measure(data: np.ndarray, at: np.ndarray, i: int, j: int, vocabularies: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of MEASURES for rows i to j; n_tokens and entropies are matrices with a column for each vocabulary."""
    n, off = j - i, at[i : j + 1] - at[i]
    h, first, start, end, raw = word_hashes(data, at, i, j, lower=False)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    solid = np.zeros(len(raw) + 1, np.int8)
    solid[start] = 1
    solid[end] -= 1  # where a word begins as one ends (at a row's end) it goes on
    solid = np.cumsum(solid[:-1]) > 0
    row_of = np.repeat(np.arange(n), np.diff(off))
    out = [words, _per_row(solid & ((raw & 0xC0) != 0x80), off), _per_row(_SYMBOL[raw], off), duplicate_lines(raw, off, row_of, solid), repeated_words(h, row, n)]
    kind = scripts(raw, off, row_of)
    distinct, at_first, back = np.unique(h, return_index=True, return_inverse=True)
    tokens = np.zeros((n, len(vocabularies)), np.int64)
    share, entropy = np.zeros(n), np.zeros((n, len(vocabularies)))

    def words_of(k):
        begin, size = start[at_first[k]], end[at_first[k]] - start[at_first[k]] + 1
        joined = raw[np.minimum(_spread(begin, size), len(raw) - 1)]
        joined[np.cumsum(size) - 1] = 10  # no word holds a line end
        return joined.tobytes().decode("utf-8", "replace").split("\n")[:-1]

    if vocabularies not in _READY:
        _READY[vocabularies] = Known(vocabularies)
    known = _READY[vocabularies]
    for v, (ids, cut) in enumerate(known.tokens(distinct, words_of)):
        size = np.diff(cut)[back]
        tokens[:, v] = np.bincount(row, weights=size, minlength=n)
        flat = ids[_spread(cut[:-1][back], size)].astype(np.int64)
        of = np.repeat(row, size)
        entropy[:, v] = _entropy(of, flat, n)
        if v == 0:
            share = np.bincount(of, weights=known.vocabularies[0].is_byte[flat], minlength=n) / np.maximum(tokens[:, 0], 1)
    return [*out, tokens, share, entropy, kind]


def measures(vocabularies: tuple[str, ...] = VOCABULARIES):
    """An Arrow function from texts to MEASURES. The byte share is that of the first vocabulary."""

    @F.arrow_udf(MEASURES)
    def run(text: pa.Array) -> pa.Array:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        data, at = utf8(text)
        columns = [[np.zeros((0, len(vocabularies)) if k in (5, 7) else 0, float if k in (6, 7) else np.int64)] for k in range(9)]
        for i, j in chunks(at, CHUNK_BYTES):
            for c, x in zip(columns, measure(data, at, i, j, vocabularies)):
                c.append(x)
        whole = [np.concatenate(c) for c in columns]
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * len(vocabularies), pa.int32()), pa.array(x.ravel(), kind))
        names = [x.split(":")[0] for x in MEASURES[7:-1].split(",")]
        arrays = [pa.array(x, pa.int64()) for x in whole[:5]] + [lists(whole[5], pa.int64()), pa.array(whole[6], pa.float64()), lists(whole[7], pa.float64()), pa.array(_NAMES).take(pa.array(whole[8]))]
        release()
        return pa.StructArray.from_arrays(arrays, names)

    return run


def bands(scratch: Scratch, rows: DataFrame, measure_cols: list[str]) -> DataFrame:
    """(band, size, measure, lo, hi) from all rows(band, size, measures): widened quartiles, counted in bins, so that runs agree.

    Size -1 stands for all sizes; entropies (ENTROPY and a number) have none.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * BINS).alias("bin")) for m in measure_cols])).alias("m")
    bins = scratch.put(rows.select("band", "size", each).groupBy("band", "size", "m.measure", "m.bin").agg(F.count(F.lit(1)).alias("n")))
    bins = bins.union(bins.where(~F.col("measure").startswith(ENTROPY)).groupBy("band", F.lit(-1).alias("size"), "measure", "bin").agg(F.sum("n")))
    key = ["band", "size", "measure"]
    total = F.sum("n").over(Window.partitionBy(*key))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
    ranked = bins.withColumns({"total": total, "upto": upto})
    q = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), (F.col("bin") + 0.5) / BINS))
    out = ranked.groupBy(*key).agg(F.first("total").alias("total"), q(0.25).alias("a"), q(0.5).alias("b"), q(0.75).alias("c")).where(F.col("total") >= ENOUGH)
    noise = FLOOR + F.pow(F.lit(2.0), -F.when(F.col("size") < 0, 4).otherwise(F.col("size")) / 2)
    wide = lambda d: F.greatest(FENCE * d, noise * F.col("b"))
    return out.select(*key, (F.col("a") - wide(F.col("b") - F.col("a"))).alias("lo"), (F.col("c") + wide(F.col("c") - F.col("b"))).alias("hi"))


def quality(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """docs, without its text, plus the measures, script, base_failed, band, size, chars_per_token (array), reasons and
    kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT percent of them in repeated windows of WINDOW words. Else a
    document is kept unless its characters per token or token entropy (of each vocabulary), or byte share (of the first) leave the band of
    its language (its script, where that is null) and size, the power of two of its words. An entropy has a lower bound only,
    the byte share an upper one; entropy is entropies' first. Columns of docs with these names are replaced. A null or empty text has no words and fails;
    equal texts of one language are judged alike; texts of any length are read whole, words over LONG_WORD bytes in parts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "byte_share", "entropy", "entropies", "script"]
    extra = ["base_failed", "band", "size", "chars_per_token", "reasons", "kept", "_m", "_limits", "_whole"]
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in (*names, *extra, text_col)]
    out = docs.select(*keep, measures(vocabularies)(text).alias("_m"), lang.alias("_lang"))
    band = F.coalesce(F.concat(F.lit("lang:"), "_lang"), F.concat(F.lit("script:"), "_m.script")).alias("band")
    out = out.select(*keep, *[(F.element_at("_m.entropies", 1) if n == "entropy" else F.col(f"_m.{n}")).alias(n) for n in names], band)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    chars = F.transform("n_tokens", lambda t: F.when(t > 0, F.col("word_chars") / t))
    out = out.withColumns({"base_failed": failed, "chars_per_token": chars, "size": F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")})
    out = scratch.put(out)
    lists = {"_c": "chars_per_token", ENTROPY: "entropies"}
    per = {f"{c}{k}": F.element_at(of, k + 1) for c, of in lists.items() for k in range(len(vocabularies))}
    limits = bands(scratch, out.where("not base_failed").withColumns(per), [*per, "byte_share"])
    limits = limits.groupBy("band", "size").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("lo", "hi")))).alias("_limits"))
    limits = scratch.put(limits)
    out = out.join(broadcast_if_small(limits, 1 << 16), ["band", "size"], "left")
    whole = scratch.put(limits.where("size = -1").select("band", F.col("_limits").alias("_whole")))
    out = out.join(broadcast_if_small(whole, 1 << 16), "band", "left").withColumn("_limits", F.coalesce("_limits", "_whole"))
    lo, hi = (lambda m, f=f: F.coalesce(F.try_element_at("_limits", F.lit(m))[f], F.lit(-1e9 if f == "lo" else 1e9)) for f in ("lo", "hi"))
    common = F.col("script").isin(*COMMON)
    outer = lambda k: F.when(common, OUTER[k]).otherwise(OUTER_RARE[k])
    rules = []
    for k, name in enumerate(vocabularies):
        c = per[f"_c{k}"]
        rules.append(F.when((c < F.greatest(lo(f"_c{k}"), outer("min_chars"))) | (c > F.least(hi(f"_c{k}"), outer("max_chars"))), f"characters per token of {name}"))
        rules.append(F.when(per[f"{ENTROPY}{k}"] < F.greatest(lo(f"{ENTROPY}{k}"), outer("min_entropy")), f"token entropy of {name}"))
    rules.append(F.when(F.col("byte_share") > F.least(F.greatest(hi("byte_share"), F.lit(0.05)), outer("max_bytes")), "byte share"))
    reasons = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*rules)))
    out = out.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)
    return out.select(*keep, *names, "base_failed", "band", "size", "chars_per_token", "reasons", "kept")


def op12(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures in all public vocabularies and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return quality(docs).drop("lang")
