"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds labelled text. A text is cut greedily into the longest phrases that occur there; the
language whose phrase count, normalised by text length and by log2 of the size of its labelled text, is smallest wins.

A text is one parse from its first letter to its last, however long. Only the way there is cut up: parses begin side by
side at every SEGMENT-th letter, and then each segment is entered again where the parse of the one before really leaves
it, until this meets a phrase start of the segment's own parse, from where on both are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import small_batches
from weftline.llm.text import chunks, release, utf8

SEGMENT = 256
LANES = 1 << 14  # segments and languages parsed side by side
CHUNK_BYTES = 1 << 19  # of texts parsed together; a longer one comes alone
PASSAGE = 1000  # characters of a passage of labelled text
SAMPLE_PASSAGES = 64  # passages per language, at most
SAMPLE_ALL = 4000  # passages of all languages together; with many languages each has fewer, but one at least


def _lower_letters() -> np.ndarray:
    """For every code point: its lower-case letter, or 0 if it is no letter."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Which codes stay if a run of zeros becomes one and leading zeros go."""
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    return keep


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions per state of the smallest automaton of all factors of codes; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        new = len(goto)
        goto.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(goto)
                goto.append(dict(goto[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return goto


def _displaced(goto: list[dict[int, int]], width: int) -> tuple[np.ndarray, int]:
    """Edges as one array and the start state: the edge of state s by code c is at place s + c if the upper half there is
    s; the lower half is the state it leads to.

    Rows of edges are laid over each other where they do not collide, so memory grows with edges, not states x codes. Where
    a row begins is the name of its state, so no two begin at one place.
    """
    edges = sum(map(len, goto))
    cap = 5 * (edges + len(goto)) // 2 + width
    taken, begun, name = bytearray(cap + 2 * width), bytearray(cap + 2 * width), [0] * len(goto)
    at, free = 0, width
    for s in sorted(range(len(goto)), key=lambda s: -len(goto[s])):
        codes = list(goto[s])
        if len(codes) > 1:
            while begun[at] or any(taken[at + c] for c in codes):
                at = at + 1 if at < cap else 0
            place = at
        else:
            c = codes[0] if codes else 0
            while (codes and taken[free]) or begun[free - c]:
                free += 1
            place = free - c
        name[s] = place
        begun[place] = 1
        for c in codes:
            taken[place + c] = 1
    table = np.full(len(taken), -1, dtype=np.int64)
    for s, row in enumerate(goto):
        for c, t in row.items():
            table[name[s] + c] = name[s] << 32 | name[t]
    return table, name[0]


class CrossParser:
    """Automata of labelled texts {language: text}. Built once on the driver; its size is bounded by that of the texts."""

    def __init__(self, labelled: dict[str, str]):
        self.languages = sorted(labelled)
        lower = _lower_letters()
        letters = [low[_squeezed(low)] for low in (lower[_points(labelled[k])] for k in self.languages)]
        known = np.unique(np.concatenate([*letters, np.zeros(1, np.uint32)]))  # begins with 0
        at = np.minimum(np.searchsorted(known, lower), len(known) - 1)
        kind = np.uint16 if len(known) < 65_535 else np.uint32
        self.code = np.where(known[at] == lower, at, len(known)).astype(kind)  # the last code is for letters never seen
        tables = [_displaced(suffix_automaton(np.searchsorted(known, own).tolist()), len(known) + 1) for own in letters]
        at = [0, *np.cumsum([len(t) for t, _ in tables])]
        moved = [np.where(t >= 0, t + (int(k) << 32) + int(k), -1) for (t, _), k in zip(tables, at)]
        self.table = np.concatenate([*moved, np.full(1, -1, np.int64)])
        self.roots = np.array([root + k for (_, root), k in zip(tables, at)], dtype=np.int64)
        self.scale = np.array([np.log2(max(len(own), 2)) for own in letters])

    def _walk(self, code, start, root, limit, stop, mark, line, record: bool):
        """Parse from start: to the first phrase start at or after limit, to stop, or (unless record) to a marked phrase start.

        Returns the phrases begun before that, where it is, and whether it was a marked one. record marks phrase starts.
        """
        low = np.int64(0xFFFFFFFF)
        count, leaves, met = np.zeros(len(start), np.int64), stop.copy(), np.zeros(len(start), bool)
        lane = np.flatnonzero(start < stop)
        p, s, r, lim, end, row = start[lane].copy(), root[lane].copy(), root[lane], limit[lane], stop[lane], line[lane]
        while len(lane):
            c = code[p]
            edge = self.table[s + c]
            b = np.flatnonzero(((edge >> 32) != s) | (s == r))
            s = edge & low
            out = p[b] >= lim[b]
            if not record:
                inner = np.flatnonzero(~out)
                seen = inner[mark[(row + p)[b[inner]]]]
                met[lane[b[seen]]] = True
                out[seen] = True
            leaves[lane[b[out]]] = p[b[out]]
            go = b[~out]
            count[lane[go]] += 1
            if record:
                mark[row[go] + p[go]] = True
            edge = self.table[r[go] + c[go]]
            s[go] = np.where((edge >> 32) == r[go], edge & low, r[go])
            p = p + 1
            gone = p >= end
            gone[b[out]] = True
            if gone.any():
                keep = ~gone
                lane, p, s, r, lim, end, row = (x[keep] for x in (lane, p, s, r, lim, end, row))
        return count, leaves, met

    def phrases(self, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(languages, texts): phrases of the greedy parse of each text code[begin : begin + size]."""
        out = np.zeros((len(self.languages), len(size)), np.int64)
        pieces = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[text] + nth * SEGMENT
        stop = (begin + size)[text]
        limit = np.minimum(start + SEGMENT, stop)
        group = max(1, min(len(self.languages), LANES // 64))
        for g in range(0, len(self.languages), group):
            roots = self.roots[g : g + group]
            many = len(roots)
            left = np.full(many, -1, np.int64)  # where the parses left the last segment of the batch before
            step = max(1, LANES // many)
            for k in range(0, len(text), step):
                t, a, z, lim, inner = text[k : k + step], start[k : k + step], stop[k : k + step], limit[k : k + step], nth[k : k + step] > 0
                n, width = len(t), int(lim[-1] - a[0])
                tile = lambda x: np.tile(x, many)
                line = np.repeat(np.arange(many) * width, n) - a[0]
                mark = np.zeros(many * width, dtype=bool)
                lanes = tile(a), np.repeat(roots, n), tile(lim), tile(z)
                count, leaves, _ = self._walk(code, *lanes, mark, line, True)
                before = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
                own = leaves.copy()
                entered = np.where(tile(inner), -1, lanes[0])
                while True:
                    prior = np.concatenate([[-1], leaves[:-1]])
                    prior[::n] = left
                    entry = np.where(tile(inner), prior, lanes[0])
                    todo = np.flatnonzero(entry != entered)
                    entered = entry
                    if not len(todo):
                        break
                    at, lim_of = entry[todo], lanes[2][todo]
                    c, to, met = self._walk(code, at, lanes[1][todo], lim_of, lanes[3][todo], mark, line[todo], False)
                    c += np.where(met, before[line[todo] + lim_of] - before[line[todo] + np.minimum(to, lim_of)], 0)
                    count[todo], leaves[todo] = c, np.where(met, own[todo], np.maximum(to, at))
                left = leaves[n - 1 :: n].copy()
                for i in range(many):
                    out[g + i] += np.bincount(t, count[i * n : (i + 1) * n], len(size)).astype(np.int64)
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, margin) of each text."""
        if not texts or not self.languages:
            return [("und", 0.0)] * len(texts)
        code = self.code[_points("\n".join(t or "" for t in texts) + "\n")]
        length = np.array([len(t or "") + 1 for t in texts])
        ends = np.cumsum(length)
        starts = ends - length
        keep = _squeezed(code)
        keep[starts] = code[starts] > 0
        before = np.concatenate([[0], np.cumsum(keep)])
        n = before[ends] - before[starts]
        cost = self.phrases(code[keep], before[starts], n) * self.scale[:, None] / np.maximum(n, 1)
        best, ranked = cost.argmin(0), np.sort(cost, 0)
        margin = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(ranked) > 1 else np.ones(len(texts))
        return [(self.languages[b], float(m)) if k else ("und", 0.0) for b, m, k in zip(best, np.clip(margin, 0, 1), n)]


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_PASSAGES, total: int = SAMPLE_ALL, seed: int = 5) -> dict[str, str]:
    """Labelled text per language: passages of whole labelled documents with the smallest seeded hashes, each passage once.

    Every document is cut into passages of PASSAGE characters from its first to its last, so that any part of a text of any
    length can be drawn and none is left out for its size. per_language of them are taken, or with many languages an equal
    share of total; only these reach the driver. Rows without language or text teach nothing.
    """
    known = docs.where("lang is not null and text is not null")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(PASSAGE)))
    cut = known.select("lang", "text", start.alias("_at")).select("lang", F.substring("text", F.col("_at") + 1, F.lit(PASSAGE)).alias("passage"))
    each = max(1, min(per_language, total // max(1, known.select("lang").distinct().count())))
    # equal passages stand next to each other, so that a passage in many documents is taken once
    hashed = cut.select("lang", F.xxhash64(F.lit(seed), "passage").alias("_h")).distinct()
    first = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= each).drop("_r")
    chosen = first.collect()
    if not chosen:
        return {}
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, _h bigint"))  # at most total rows, or one a language
    texts = cut.withColumn("_h", F.xxhash64(F.lit(seed), "passage")).join(picked, ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("passage").alias("passage"))
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["_h"])):
        out.setdefault(r["lang"], []).append(r["passage"])
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, labelled: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score (margin over the second language, 0 to 1).

    und with score 0 for a null text, one without letters, or if no language was learned. Ties go to the first language
    by code point. Rows that repeat are each predicted; columns named like the new ones are replaced; an empty table gives
    no rows. Scoring needs no shuffle; other columns stay in the JVM.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(labelled))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        names, scores = [], []
        for i, j in chunks(utf8(text)[1], CHUNK_BYTES):
            for name, score in shared.value.scores(text.slice(i, j - i).to_pylist()):
                names.append(name)
                scores.append(score)
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    out = docs.drop("lang_pred", "score", "_lang").withColumn("_lang", predict(F.col(text_col)))
    return out.select(*[c for c in out.columns if c != "_lang"], F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"))


def held_out(doc_id, modulus: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op9(spark, sf_dir: str) -> DataFrame:
    """The registered query: the language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4))
    model = labelled_sample(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
