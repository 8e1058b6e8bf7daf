"""The registered queries without SQL, and the pipeline, on a small folder of tables against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from piispan.llm import queries, secret_scan, toxicity
from piispan.llm.tokenizing import public_path
from tests.llm import test_operators as O

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """A part of the smallest tables with rows of edge cases, planted secrets, toxic and contaminated texts."""
    path = tmp_path_factory.mktemp("tables")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in read("documents").orderBy("doc_id").limit(70).collect()]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").orderBy("item_id").collect()] + [(9001, None), (9002, "")]
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(9000))
    texts = [None, "", " \t\n ", "one two", long, rows[5][1], rows[6][1] + " end", "lead " + items[0][1] + " tail", items[1][1].upper(), f"mail {O.SECRET} here", "x " + O.encoded(O.SECRET, ["gzip"]) + " y"]
    texts += [f"you are such a stupid pathetic idiot, {a} loser {b}" for a in ("what a", "total", "big", "sad", "loud", "tiny") for b in ("and moron", "today", "again", "here")]
    rows += [(100_000 + i, t, "en", "made", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(r[0], 1, int("stupid pathetic" in (r[1] or ""))) for r in rows]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    read("pages").limit(40).write.parquet(f"{path}/pages.parquet")
    read("conversations").write.parquet(f"{path}/conversations.parquet")
    return str(path), rows, items


def run(name, spark, folder):
    out = queries.queries()[name](spark, folder[0])
    return [r.asDict() for r in out.collect()]


def test_all_are_registered():
    assert len([k for k in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", k)]) == 11


def pieces(rows, vocabulary="word_bpe_49k.json", end=1, capacity=4096):
    """By the library: (doc_id, piece, start, length, crc of the ids)."""
    t, out = Tokenizer.from_file(public_path(vocabulary)), []
    for doc_id, text in rows:
        ids = (t.encode(text, add_special_tokens=False).ids if text else []) + [end]
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            out.append((doc_id, at // capacity, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def assert_packed(got, want, capacity=4096):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= capacity
    assert len(bins) <= math.ceil(sum(w[3] for w in want) / capacity) + 1


def test_op3(spark, folder):
    assert_packed(run("op3_best_fit_packing", spark, folder), pieces([r[:2] for r in folder[1]]))


def test_op4(spark, folder):
    _, rows, items = folder
    got = {(r["doc_id"], r["item_id"]) for r in run("op4_decontamination", spark, folder)}
    want = {(rows[i][0], items[j][0]) for i, j in O.brute_contaminated([r[1] for r in rows], [x[1] for x in items])}
    assert got == want and len(got) > 1


def test_op5(spark, folder):
    rows = folder[1]
    got = {r["doc_id"]: r for r in run("op5_ngram_perplexity", spark, folder)}
    assert len(got) == len(rows)
    for r, log_ppl in zip(rows, O.brute_log_ppl([r[1] for r in rows], [r[2] for r in rows]), strict=True):
        g = got[r[0]]
        base = O.brute_base(r[1])
        assert tuple(g[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert g["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and not (g["kept"] and g["base_failed"])
        assert (g["perplexity"] is None) if log_ppl is None else g["perplexity"] == pytest.approx(math.exp(log_ppl), rel=1e-6)
        if not g["base_failed"]:
            assert g["kept"] == (g["lower_perplexity"] == g["upper_perplexity"] or g["lower_perplexity"] <= g["perplexity"] <= g["upper_perplexity"])


def near(rows):
    prints = [O.brute_fingerprint(r[1]) for r in rows]
    return prints, O.brute_components([r[0] for r in rows], prints)


def test_op6(spark, folder):
    rows = folder[1]
    want = {r[0]: (f"{p:016x}", c) for r, p, c in zip(rows, *near(rows), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run("op6_simhash", spark, folder)} == want


def test_op7(spark, folder):
    got = {r["doc_id"]: r for r in run("op7_secret_scan", spark, folder)}
    added = 0
    for doc_id, text, *_ in folder[1]:
        base, g = O.brute_secrets(text or ""), got[doc_id]
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert g["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [x for x in g["spans"].split(",") if x]
        assert set(listed) <= set(spans) and [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
        added += len(spans) - len(listed)
    assert added > 0


def test_op8(spark, folder):
    path, rows, _ = folder
    got = {r["doc_id"]: r for r in run("op8_toxicity", spark, folder)}
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    scores = model.scores([r[1] for r in rows])
    for r, s in zip(rows, scores, strict=True):
        g = got[r[0]]
        assert g["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2)
        assert g["score"] == pytest.approx(float(s)) and 0 <= s <= 1 and g["predicted"] == int(s >= 0.3)
    toxic = [r[0] for r in rows if "stupid pathetic" in (r[1] or "")]
    assert np.mean([got[i]["predicted"] for i in toxic]) > 0.9 and np.mean([g["predicted"] for i, g in got.items() if i not in toxic]) < 0.1


def test_op9(spark, folder):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder[0]}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in run("op9_html_extraction", spark, folder)}
    plain = lambda t: collections.Counter(re.sub(r"(?m)^\s*(?:- |\d+\. )", " ", t).split())
    assert set(got) == set(pages)
    for i, page in pages.items():
        assert plain(got[i]) == plain("\n".join(O.SlowWords(page).words))


def test_op10(spark, folder):
    got = sorted(run("op10_sorted_string_tables", spark, folder), key=lambda r: r["start"])
    t, start = Tokenizer.from_file(public_path("byte_bpe_50k.json")), 0
    for r, (doc_id, text, *_) in zip(got, sorted(folder[1]), strict=True):
        ids = (t.encode(text, add_special_tokens=False).ids if text else []) + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline(spark, folder):
    path, rows, items = folder
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    left = [r for r, s in zip(rows, model.scores([r[1] for r in rows]), strict=True) if s < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(left)
    _, component = near(left)
    left = [r for r, c in zip(left, component, strict=True) if r[0] == c]
    dirty = {i for i, _ in O.brute_contaminated([r[1] for r in left], [x[1] for x in items])}
    assert dirty
    left = [r for i, r in enumerate(left) if i not in dirty]
    clean = [(r[0], secret_scan.redact(r[1], secret_scan.scan(r[1])[1]) if r[1] else r[1]) for r in left]
    assert any("[SECRET:" in (t or "") for _, t in clean) and not any(O.SECRET in (t or "") for _, t in clean)
    assert_packed([r.asDict() for r in corpus_pipeline.run(spark, path).collect()], pieces(clean))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
    n_chars = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert {i: t for i, (t, _) in n_chars.items()} == dict(clean) and all(n == (None if t is None else len(t)) for t, n in n_chars.values())
