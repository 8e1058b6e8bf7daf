"""Quality rules with an n-gram language model: modified Kneser-Ney bigrams for each language.

Counts come from the whole corpus: each chunk sends its distinct bigrams with counts to buckets
of the hash space, a bucket sums them and answers the chunks with the corpus counts; from these
the chunks derive what Kneser-Ney needs of each word (count as a history, how many words follow
it once, twice, more often, how many different words it follows), again summed in buckets; nothing of it is broadcast.
`train_model` stores the model instead: each bucket's sorted hashes with their counts, from which `score_with_model` scores any
documents. `score_perplexity` scores a corpus by its own model and gives the same numbers, without keeping
the arrays, which would not fit beside its shuffles in the disk that it may use. Hashes have ten bits more than
the corpus has words, so that about one key in a thousand shares its hash, at any size.

The order is two. The corpus that is scored is the one that is counted, so a third order probably knows a text's rare trigrams from the text itself: at 0.1,
with the same fences, it rejects 68 of the 301 labelled junk documents that pass the base rules, two orders 249 (and 163 against 137 of
3,330 clean ones).

A document's perplexity is judged against its language's lower and upper fence: quartiles of the
log perplexity in that language, widened by `fence` times their distance.

Defined results: null or empty texts have no words, fail the base rules and have null
perplexity; a null language is a language of its own; repeated rows count each; a language
whose quartiles coincide rejects nothing; extra columns are ignored; an empty table gives an
empty result. Keys that share a hash share counts in the model only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piispan.llm import exchange as X
from piispan.llm import words as W
from piispan.llm.common import cut, fresh_path, n_partitions, stored, stored_alone, text_bytes

#: At 0.1 a document scored without its own counts tells less: copies go, and junk of rare words stays inside the fences.
FENCE = 2.0
SPARE_BITS = 10
#: Continuations of a word that the model has not seen.
UNSEEN = 0.5
CHUNK_BYTES = 8 << 20
#: Of a chunk, bytes of text (whole texts, one at least) and distinct bigrams that are computed on at a time: temporary arrays are many times what they come from.
RUN_BYTES, RUN_PAIRS = 1 << 20, 1 << 17
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
SCORED = "doc_id {id}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_ppl double"
BIGRAMS, WORDS, TOTALS = 0, 1, 2
#: Of a word: its count as a history, how many words follow it once, twice, more often, how many it follows.
STATS = ("c", "n1", "n2", "n3", "cont")
#: Of a language: bigrams that occur once to four times, and all.
LANG_STATS = ("t1", "t2", "t3", "t4", "all")
_LINE_SPACE = b" \t\n\v\f\r"
_START = np.uint64(0x5DEECE66D1CE4E5B)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique returns (distinct, first place, inverse, counts), with 32-bit places and few temporary arrays."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    keys, at = ordered[new], order[new].astype(np.int32)
    del ordered
    inverse = np.empty(len(x), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys, at, inverse, np.diff(np.flatnonzero(new), append=len(x)).astype(np.int32)


class _Chunk:
    """Words, languages and bigrams of a chunk; the same from each call on the same rows."""

    def __init__(self, t: pa.Table, bits: int):
        rows = X.unpacked(t)
        self.texts = X.texts(rows)
        self.rows = rows.drop_columns("text")
        del rows
        self.w = W.split(self.texts)
        names = ["" if x is None else "=" + x for x in self.rows["lang"].to_pylist()]
        self.langs, lang_of = np.unique(np.array(names, dtype=object).astype(str), return_inverse=True)
        self.lang_keys = W.hashes(W.split([x.encode() or b"-" for x in self.langs.tolist()])) if len(self.langs) else np.zeros(0, W.U)
        self.plain = W.hashes(self.w)
        lang_of_word = lang_of.astype(np.int32)[self.w.text_of()]
        target = W.mix(self.plain ^ self.lang_keys[lang_of_word])
        history = np.empty_like(target)
        history[1:] = target[:-1]
        begin = self.w.first[:-1][self.w.counts() > 0]
        history[begin] = W.mix(_START ^ self.lang_keys[lang_of_word[begin]])
        self.keys, at, self.inverse, self.counts = _distinct(W.mix(history * np.uint64(3) + target) >> np.uint64(64 - bits))
        self.lang_of_pair = lang_of_word[at]
        history, target = history[at], target[at]
        self.word_keys, _, ids, _ = _distinct(np.concatenate((history, target)) >> np.uint64(64 - bits))
        self.history, self.target = ids[: len(at)], ids[len(at) :]


def _bigram_answers(t: pa.Table, n: int, bits: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corpus counts of a chunk's bigrams, and which of them this chunk has to count as distinct."""
    edge, total, own = X.bounds(keys, n, bits), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for kind, b, body in zip(t["kind"].to_pylist(), t["bucket"].to_pylist(), t["body"].to_pylist(), strict=True):
        if kind == BIGRAMS:
            counts, m = X.unpack_counts(body[4:])[0], int.from_bytes(body[:4], "little")
            first = np.unpackbits(np.frombuffer(body[len(body) - m :], np.uint8), count=edge[b + 1] - edge[b]) if m else []
            total[edge[b] : edge[b + 1]], own[edge[b] : edge[b + 1]] = counts, first
    return total, own


def _with_keys(keys: np.ndarray, arrays: list[np.ndarray]) -> bytes:
    packed = X.pack_keys(keys)
    return len(packed).to_bytes(4, "little") + packed + X.pack_counts(arrays)


def _keys_and_counts(b: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    m = int.from_bytes(b[:4], "little")
    return X.unpack_keys(b[4 : 4 + m]), X.unpack_counts(b[4 + m :])


def _langs_and_counts(b: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    m = int.from_bytes(b[:4], "little")
    return np.frombuffer(b, np.uint64, m, 4), X.unpack_counts(b[4 + 8 * m :])


def _log_ppl(c: _Chunk, count: np.ndarray, stats: dict[str, np.ndarray], totals: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log perplexity of each text of a chunk, and its words, by a model's counts of the chunk's bigrams, words and languages."""
    t1, t2, t3, t4 = (np.maximum(totals[f"t{i}"], 1) for i in (1, 2, 3, 4))
    y = t1 / (t1 + 2 * t2)
    d = [np.clip(x, 0.05, top) for x, top in ((1 - 2 * y * t2 / t1, 1), (2 - 3 * y * t3 / t2, 2), (3 - 4 * y * t4 / t3, 3))]
    every = np.maximum(totals["all"], 1)
    surprise = np.empty(len(count))
    for a in range(0, len(count), RUN_PAIRS):
        part = slice(a, a + RUN_PAIRS)
        n, lang, history = count[part], c.lang_of_pair[part], c.history[part]
        of = {k: stats[k][history] for k in ("c", "n1", "n2", "n3")}
        d1, d2, d3 = (x[lang] for x in d)
        discount = np.where(n == 1, d1, np.where(n == 2, d2, d3))
        left = d1 * of["n1"] + d2 * of["n2"] + d3 * of["n3"]
        # a word that the model has not seen counts as half a continuation; after a history that it has not seen, continuations alone tell
        base = np.maximum(stats["cont"][c.target[part]], UNSEEN) / every[lang]
        p = np.where(of["c"] > 0, (np.maximum(n - discount, 0) + left * base) / np.maximum(of["c"], 1), base)
        surprise[part] = -np.log(np.maximum(p, 1e-12))
    n_words = c.w.counts()
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(c.w.text_of(), weights=surprise[c.inverse], minlength=len(c.texts)) / n_words, n_words


def train_model(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The model of a corpus, stored: for each bucket of the hash space, sorted bigram hashes with their counts, and sorted word
    hashes with what Kneser-Ney needs of each; the languages' totals in a bucket of their own.

    Rows (kind, bucket, keys, counts, bits, buckets) as Parquet in `path` (a folder of its own in the shared one if none is given).
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    n = max(1, n_partitions(spark), math.ceil(size / CHUNK_BYTES))
    bits = min(60, SPARE_BITS + max(28, (size // 4).bit_length()))

    def send(key, t):
        c = _Chunk(t, bits)
        edge = X.bounds(c.keys, n, bits)
        full = [b for b in range(n) if edge[b + 1] > edge[b]]
        arrays = [c.counts, c.word_keys[c.history], c.word_keys[c.target], c.lang_keys[c.lang_of_pair]]
        bodies = [_with_keys(c.keys[edge[b] : edge[b + 1]], [x[edge[b] : edge[b + 1]] for x in arrays]) for b in full]
        return X.cell_table(full, [0] * len(full), [BIGRAMS] * len(full), bodies)

    def sums(keys: np.ndarray, arrays: list[np.ndarray]) -> bytes:
        own, inverse = np.unique(keys, return_inverse=True)
        return _with_keys(own, [np.bincount(inverse, weights=x, minlength=len(own)).astype(np.int64) for x in arrays])

    def sum_bigrams(key, t):
        cells = [_keys_and_counts(b) for b in t["body"].to_pylist()]
        keys, at, inverse = np.unique(np.concatenate([k for k, _ in cells]), return_index=True, return_inverse=True)
        count, history, target, lang = (np.concatenate([x[i] for _, x in cells]) for i in range(4))
        count = np.bincount(inverse, weights=count).astype(np.int64)
        history, target, lang = history[at], target[at], lang[at]
        zero = np.zeros(len(keys), np.int64)
        words = np.concatenate((history, target))
        stats = [np.concatenate(p) for p in ((count, zero), (count == 1, zero), (count == 2, zero), (count >= 3, zero), (zero, zero + 1))]
        order = np.argsort(words, kind="stable")
        words, stats = words[order], [x[order] for x in stats]
        edge = X.bounds(words, n, bits)
        full = [b for b in range(n) if edge[b + 1] > edge[b]]
        parts = [sums(words[edge[b] : edge[b + 1]], [x[edge[b] : edge[b + 1]] for x in stats]) for b in full]
        totals = sums(lang, [count == 1, count == 2, count == 3, count == 4, zero + 1])
        return X.cell_table([key[0].as_py(), *full, -1], [0] * (len(full) + 2), [BIGRAMS, *[WORDS] * len(full), TOTALS], [_with_keys(keys, [count]), *parts, totals])

    def merged(key, t):
        cells = [_keys_and_counts(b) for b in t["body"].to_pylist()]
        body = sums(np.concatenate([k for k, _ in cells]), [np.concatenate([x[i] for _, x in cells]) for i in range(len(cells[0][1]))])
        return X.cell_table([key[0].as_py()], [0], [key[1].as_py()], [body])

    cells = X.chunked(docs, n, "lang").groupBy("chunk").applyInArrow(send, X.CELLS)
    counted = stored(cells.groupBy("bucket").applyInArrow(sum_bigrams, X.CELLS), "counted")
    words = counted.filter(F.col("kind") != BIGRAMS).groupBy("bucket", "kind").applyInArrow(merged, X.CELLS)
    model = counted.filter(F.col("kind") == BIGRAMS).unionByName(words).select("kind", "bucket", "body", F.lit(bits).alias("bits"), F.lit(n).alias("buckets"))
    path = path or fresh_path(spark, "model")
    model.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def score_with_model(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, base measures and log_ppl of any documents by a stored model (those of `score_perplexity`, if the model is of these documents).

    Chunks ask buckets for the counts of their keys; a bucket finds them in its sorted arrays by binary search. Words and
    languages that the model has not seen are unlikely, not impossible. A model of an empty corpus has no rows and scores nothing.
    """
    spark, size = docs.sparkSession, text_bytes(docs)
    first = model.select("bits", "buckets").first()
    if first is None:
        return score_perplexity(docs.limit(0))
    bits, n = first
    chunks = X.chunked(docs, max(1, n_partitions(spark), math.ceil(size / CHUNK_BYTES)), "lang")
    widths = {BIGRAMS: 1, WORDS: len(STATS), TOTALS: len(LANG_STATS)}

    def wanted(c: _Chunk) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        for kind, keys in ((BIGRAMS, c.keys), (WORDS, c.word_keys)):
            edge = X.bounds(keys, n, bits)
            yield from ((kind, b, slice(edge[b], edge[b + 1]), keys[edge[b] : edge[b + 1]]) for b in range(n) if edge[b + 1] > edge[b])
        order = np.argsort(c.lang_keys, kind="stable")
        yield TOTALS, -1, order, c.lang_keys[order]

    def ask(key, t):
        rows = [(b, key[0].as_py(), kind, X.pack_sorted(keys)) for kind, b, _, keys in wanted(_Chunk(t, bits))]
        return X.cell_table(*map(list, zip(*rows, strict=True)))

    def answer(key, cells, own):
        kind = key[1].as_py()
        keys, counts = _keys_and_counts(own["body"][0].as_py()) if len(own) else (np.zeros(0, W.U), [np.zeros(0, np.int64)] * widths[kind])
        bodies = []
        for body in cells["body"].to_pylist():
            asked = X.unpack_sorted(body)
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            known = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
            bodies.append(X.pack_counts([np.where(known, x[at] if len(keys) else 0, 0) for x in counts]))
        m = len(bodies)
        return X.cell_table([key[0].as_py()] * m, cells["chunk"].to_pylist(), [kind] * m, bodies)

    def score(key, t, answers):
        c = _Chunk(t, bits)
        got = {(k, b): X.unpack_counts(x) for k, b, x in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True)}
        count = np.zeros(len(c.keys), np.int64)
        stats, totals = {k: np.zeros(len(c.word_keys)) for k in STATS}, {k: np.zeros(len(c.langs)) for k in LANG_STATS}
        for kind, b, place, _ in wanted(c):
            into = {BIGRAMS: [count], WORDS: list(stats.values()), TOTALS: list(totals.values())}[kind]
            for x, v in zip(into, got[kind, b], strict=True):
                x[place] = v
        log_ppl, n_words = _log_ppl(c, count, stats, totals)
        return pa.table({"doc_id": c.rows["doc_id"], "lang": c.rows["lang"], **base_measures(c.w, c.plain, c.texts), "log_ppl": pa.array(log_ppl, mask=n_words == 0)})

    asked = chunks.groupBy("chunk").applyInArrow(ask, X.CELLS)
    by = lambda df: df.groupBy("bucket", "kind")
    answers = by(asked).cogroup(by(model.select("bucket", F.lit(0).alias("chunk"), "kind", "body"))).applyInArrow(answer, X.CELLS)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def score_perplexity(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base measures and log_ppl (log of the perplexity, null without words)."""
    size = text_bytes(docs)
    n = max(1, n_partitions(docs.sparkSession), math.ceil(size / CHUNK_BYTES))
    bits = min(60, SPARE_BITS + max(28, (size // 4).bit_length()))
    id_name = docs.schema["doc_id"].dataType.simpleString()
    chunks = X.dealt(X.chunked(docs, n, "lang"), n, "chunk")

    def send(key, t):
        c = _Chunk(t, bits)
        edge = X.bounds(c.keys, n, bits)
        full = [b for b in range(n) if edge[b + 1] > edge[b]]
        bodies = [_with_keys(c.keys[edge[b] : edge[b + 1]], [c.counts[edge[b] : edge[b + 1]]]) for b in full]
        return X.cell_table(full, [key[0].as_py()] * len(full), [BIGRAMS] * len(full), bodies)

    def sum_bigrams(key, t):
        t = t.sort_by("chunk")
        cells = [_keys_and_counts(b) for b in t["body"].to_pylist()]
        keys, counts = [k for k, _ in cells], [x[0] for _, x in cells]
        sizes = np.cumsum([len(x) for x in keys])[:-1]
        _, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)[inverse]
        own = np.zeros(len(inverse), bool)
        own[at] = True  # of the first chunk that has it
        bodies = []
        for a, o in zip(np.split(total, sizes), np.split(own, sizes), strict=True):
            first = np.packbits(o).tobytes()
            bodies.append(len(first).to_bytes(4, "little") + X.pack_counts([a]) + first)
        return X.cell_table([key[0].as_py()] * len(t), t["chunk"].to_pylist(), [BIGRAMS] * len(t), bodies)

    def word_stats(key, t, answers):
        c = _Chunk(t, bits)
        total, own = _bigram_answers(answers, n, bits, c.keys)
        m = len(c.word_keys)
        add = lambda of, w: np.bincount(of, weights=w, minlength=m).astype(np.int64)
        stats = {"c": add(c.history, c.counts)}
        for i, is_n in enumerate((total == 1, total == 2, total >= 3), 1):
            stats[f"n{i}"] = add(c.history, own & is_n)
        stats["cont"] = add(c.target, own)
        edge = X.bounds(c.word_keys, n, bits)
        full = [b for b in range(n) if edge[b + 1] > edge[b]]
        bodies = [_with_keys(c.word_keys[edge[b] : edge[b + 1]], [stats[k][edge[b] : edge[b + 1]] for k in STATS]) for b in full]
        k = len(c.langs)
        of = lambda w: np.bincount(c.lang_of_pair, weights=w, minlength=k).astype(np.int64)
        totals = c.lang_keys.tobytes() + X.pack_counts([*[of(own & (total == i)) for i in (1, 2, 3, 4)], of(own)])
        totals = len(c.lang_keys).to_bytes(4, "little") + totals
        return X.cell_table([*full, -1], [key[0].as_py()] * (len(full) + 1), [WORDS] * len(full) + [TOTALS], [*bodies, totals])

    def sum_words(key, t):
        kind = t["kind"][0].as_py()
        cells = [_keys_and_counts(b) if kind == WORDS else _langs_and_counts(b) for b in t["body"].to_pylist()]
        sizes = np.cumsum([len(k) for k, _ in cells])[:-1]
        _, inverse = np.unique(np.concatenate([k for k, _ in cells]), return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([x[i] for _, x in cells])).astype(np.int64)[inverse] for i in range(len(cells[0][1]))]
        parts = [np.split(v, sizes) for v in sums]
        bodies = [X.pack_counts([v[i] for v in parts]) for i in range(len(cells))]
        return X.cell_table([key[0].as_py()] * len(t), t["chunk"].to_pylist(), [kind] * len(t), bodies)

    def score(key, t, answers):
        c = _Chunk(t, bits)
        count, _ = _bigram_answers(answers, n, bits, c.keys)
        edge = X.bounds(c.word_keys, n, bits)
        stats = {k: np.zeros(len(c.word_keys)) for k in STATS}
        totals = {k: np.zeros(len(c.langs)) for k in LANG_STATS}
        for kind, b, body in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True):
            if kind == WORDS:
                for k, v in zip(STATS, X.unpack_counts(body), strict=True):
                    stats[k][edge[b] : edge[b + 1]] = v
            elif kind == TOTALS:
                for k, v in zip(LANG_STATS, X.unpack_counts(body), strict=True):
                    totals[k][:] = v
        log_ppl, n_words = _log_ppl(c, count, stats, totals)
        return pa.table({"doc_id": c.rows["doc_id"], "lang": c.rows["lang"], **base_measures(c.w, c.plain, c.texts), "log_ppl": pa.array(log_ppl, mask=n_words == 0)})

    # a bucket is little work: a task for each core, or as many as keep a task's share bounded, so that few files are written
    cores = min(n_partitions(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism)
    by_bucket = lambda df: df.repartition(max(cores, -(-n // X.CHUNKS_A_TASK)), "bucket").groupBy("bucket")
    by_chunk = lambda df: df.groupBy("chunk")
    # three jobs, the first two written to the shared folder: each holds the shuffled texts and one exchange
    counted = stored_alone(by_bucket(by_chunk(chunks).applyInArrow(send, X.CELLS)).applyInArrow(sum_bigrams, X.CELLS), "bigrams")
    summed = stored_alone(by_bucket(by_chunk(chunks).cogroup(by_chunk(counted)).applyInArrow(word_stats, X.CELLS)).applyInArrow(sum_words, X.CELLS), "words")
    return by_chunk(chunks).cogroup(by_chunk(counted.unionByName(summed))).applyInArrow(score, SCORED.format(id=id_name))


def base_measures(w: W.Words, h: np.ndarray, texts: list[bytes | None]) -> dict[str, pa.Array]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n = w.counts()
    out = {"n_words": n, **{k: np.zeros(len(texts), np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}}
    edges = np.unique(np.append(np.searchsorted(w.offsets, np.arange(0, w.offsets[-1], RUN_BYTES)), len(texts)))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        data, begin, first = w.data[w.offsets[a] : w.offsets[b]], w.offsets[a:b] - w.offsets[a], w.first[a : b + 1]
        own = slice(first[0], first[-1])
        first = first - first[0]
        length = np.concatenate(([0], np.cumsum(w.ends[own] - w.starts[own])))[first]
        # bytes within a character are within words, and each text has a byte at least, that of its end
        out["word_chars"][a:b] = np.diff(length) - np.add.reduceat((data & 0xC0) == 0x80, begin, dtype=np.int64)
        out["n_symbols"][a:b] = np.add.reduceat(symbol[data], begin, dtype=np.int64)
        k, at = W.windows(h[own], first, REPEAT_WINDOW)
        text_of = np.repeat(np.arange(b - a), n[a:b])
        _, inverse, counts = np.unique(W.mix(k + text_of[at].astype(W.U) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        again = W.covered(at[counts[inverse] > 1], REPEAT_WINDOW, first[-1])
        out["n_repeat_words"][a:b] = np.diff(np.concatenate(([0], np.cumsum(again)))[first])
    for i, x in enumerate(texts):
        lines = [y for y in (x or b"").split(b"\n") if y.strip(_LINE_SPACE)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return {k: pa.array(v, pa.int64()) for k, v in out.items()}


def quality_filter(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """Each document's measures, base_failed, its perplexity with its language's fences, and kept."""
    scored = cut(score_perplexity(docs)).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    quartiles = scored.filter(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    wide = fence * (F.col("q")[1] - F.col("q")[0])
    bands = quartiles.select(F.col("lang").alias("band_lang"), (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"), (wide > 0).alias("usable"))
    joined = scored.join(bands, scored["lang"].eqNullSafe(bands["band_lang"]), "left")
    outside = F.coalesce(F.col("usable") & ((F.col("log_ppl") < F.col("low")) | (F.col("log_ppl") > F.col("high"))), F.lit(False))
    return joined.select(
        *[c for c in scored.columns if c not in ("log_ppl", "base_failed")],
        "base_failed", (~F.col("base_failed") & ~outside).alias("kept"),
        F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("lower_perplexity"), F.exp("high").alias("upper_perplexity"),
    )
