import hashlib
import re

import corpus_pipeline
import tiktoken
from pyspark.sql import functions as F
from tallyloom.llm import bpe, mixing, nbsvm, secrets

from .test_near_dedup import by_hand
from .test_secrets import TEXTS


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, corpus, labels, tmp_path):
    extra = spark.createDataFrame([(500 + i, t, "en", "hot", len(t)) for i, t in enumerate(TEXTS)], corpus.schema)
    docs = corpus.unionByName(extra)
    sf = tables(spark, tmp_path, docs, labels)
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, sf)
        path = str(tmp_path / f"out{i}")
        out.write.parquet(path)
        seen[name], d = d, spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert d.columns == docs.columns
        seen[f"{name}>"] = d
    rows = lambda n: seen[n].collect()
    verdict = {r["doc_id"]: r["predicted"] for r in nbsvm.score(seen["quality classifier"], nbsvm.train(docs, labels)).collect()}
    assert {r["doc_id"] for r in rows("quality classifier>")} == {i for i, v in verdict.items() if v}
    near = by_hand([(r["doc_id"], r["text"]) for r in rows("MinHash near-dedup")], 5, 80)
    assert sorted(r["doc_id"] for r in rows("MinHash near-dedup>")) == sorted({low for _, low in near.values()})
    for r in rows("secret scans>"):
        assert r["n_chars"] == len(r["text"])
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"])
    before = {r["doc_id"]: r["text"] for r in rows("secret scans")}
    hit = {r["doc_id"] for r in secrets.scan(seen["secret scans"]).where("size(secret_spans) > 0").collect()}
    assert all((r["text"] != before[r["doc_id"]]) == (r["doc_id"] in hit) for r in rows("secret scans>")) and hit
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(seen["mixing sources"]).collect()}
    mixed = [r["doc_id"] for r in rows("mixing sources>")]
    assert all(mixed.count(i) == n for i, n in copies.items()) and len(mixed) == sum(copies.values())
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_bpe(*bpe.tokenizer_file("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in rows("byte-level BPE")}
    for r in rows("byte-level BPE>"):
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_run(spark, awkward_docs, empty_docs, labels, no_labels, tmp_path):
    sf = tables(spark, tmp_path / "a", awkward_docs.selectExpr("*", "1 as alone", "2 as nth", "3 as mix_u", "4 as extra"), labels)
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() >= 0
    sf = tables(spark, tmp_path / "b", empty_docs, no_labels)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_near_dedup_stage_with_a_hot_group_and_repeated_ids(spark, corpus):
    """A third of the rows are near copies of one text, others repeat an id or have none: by brute force over rows."""
    import random

    rnd, rows = random.Random(21), [tuple(r) for r in corpus.collect()]
    base = [f"b{rnd.randrange(500)}" for _ in range(90)]
    for i in range(60):
        t = list(base)
        t[rnd.randrange(90)] = f"e{rnd.randrange(9)}"
        rows.append((1000 + i, " ".join(t), "en", "hot", 0))
    rows.append((1000, rows[-1][1], "en", "hot", 0))  # a near copy that shares an id
    rows += [(3, "z other text of the same id", "en", "s", 0)] * 2  # stays beside the document 3, once
    rows += [(None, "no id", "en", "s", 0)] * 2 + [(None, " ".join(base), "en", "hot", 0)]
    rows += [(4000, None, "en", "s", 0)] * 2 + [(4001, "", "en", "s", 0), (None, "", "en", "s", 0), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, corpus.schema).repartition(5).withColumns({"row": F.lit(1), "mark": F.lit(2)})
    out = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert out.columns == docs.columns
    groups: dict = {}
    for i, (n, low) in by_hand([(i, r[1]) for i, r in enumerate(rows)], 5, 80).items():
        groups.setdefault((low, None) if n or rows[i][0] is None else (None, rows[i][0]), []).append(rows[i])
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted((str(min(g, key=key)[0]) for g in groups.values()))
    got = [tuple(r)[:5] for r in out.collect()]
    assert sorted(str(r[0]) for r in got) == want and set(got) <= set(rows)
    assert sum(r[1] == "z other text of the same id" for r in got) == 1 and sum(r[1] == "no id" for r in got) == 1
