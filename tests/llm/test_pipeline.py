"""The pipeline's stages on a small corpus against brute force: what goes, what stays, and that they follow one another."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import gram_links, least_edits, lines_left, plain_features
from tokenizers import Tokenizer

import corpus_pipeline as P
from reportlake.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(90_000, None, None, None, None), (90_001, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs, before = out, after
        else:
            assert after == before and out.where(~F.col("exact")).count() == 0
        assert stage(spark, docs.where("false"), SF).count() == 0


def corpus():
    """Documents, labels and a benchmark in which every stage finds something."""
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [prose(30) for _ in range(3)] + ["Which way is north?"]
    texts = [prose(rng.randint(5, 60)) + "\n" + prose(20) for _ in range(120)]
    for k in range(0, 60, 3):
        texts[k] += " vile filth scum"
    line = prose(12)
    for k in range(61, 80, 4):
        texts[k] += "\n" + line.replace(line.split()[k % 12], "edited") + "\n" + prose(8)
    near = prose(200).split()
    for k in range(5):
        w = list(near)
        w[7 * k + 3] = "changed"
        texts[100 + k] = " ".join(w) + "\n" + prose(1)
    texts[110] += "\n" + items[0].upper()
    texts[111] += "\nbefore " + items[1].replace("w1", "v1", 1) + " after"
    texts[112] += "\nso: which way IS north"
    texts += ["", None, texts[90], texts[90]]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows, [(k, int(k % 3 == 0 and k < 60)) for k in range(90)], list(enumerate(items))


def test_run_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    for name, df in (("documents", docs), ("labels", labelled), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    # 1: the scores of the trained model, by plain Python.
    model = toxicity.train(docs, labelled)
    weights = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))
    words = sorted({w for _, t, *_ in rows if t for w in t.lower().replace("?", " ").replace(":", " ").split()})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    left = [(i, t) for i, t, *_ in rows if sum(weights.get(f, 0.0) for f in plain_features(t, model["bits"], hashes.__getitem__)) + model["bias"] < 0]
    assert 15 <= len(rows) - len(left) <= 25
    # 2: lines.
    th = {r["doc_id"]: r["t"] for r in docs.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    cut = lines_left([(i, t, th[i]) for i, t in left])
    lines = [(i, cut[i, th[i]]) for i, t in left]
    lines = [(i, t) for (i, t), (_, before) in zip(lines, left, strict=True) if t == before or t.strip()]
    assert len(lines) < len(left) and sum(map(len, (t or "" for _, t in lines))) < sum(map(len, (t or "" for _, t in left)))
    # 3: near copies.
    heads = {i: h for i, _, h in gram_links(lines)}
    apart = [(i, t) for i, t in lines if heads[i] in (None, i)]
    assert len(apart) < len(lines)
    # 4: the benchmark; its items are whole pieces here, or excerpts that stand unedited.
    s = decontaminate.Settings()
    plain = {i: decontaminate.normal(t) for i, t in items}

    def holds(text, item):
        if len(item) < s.q + 8:
            return f" {item.decode()} " in f" {text.decode()} "
        pieces = decontaminate.segments(item, s)
        return any(p in text for p, _ in pieces) or any(k and set(p.split()) & set(text.split()) and least_edits(p, text) <= k for p, k in pieces)

    clean = [(i, t) for i, t in apart if not any(holds(decontaminate.normal(t), x) for x in plain.values())]
    assert {i for i, _ in apart} - {i for i, _ in clean} == {110, 111, 112}
    # 5: ids and decoded texts by the library.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in clean:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.run(spark, str(tmp_path)).collect()} == want
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe"] and P.ORACLE_SQL is None
