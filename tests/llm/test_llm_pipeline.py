from __future__ import annotations

import collections

import corpus_pipeline
from cellweave.llm import cotrain_quality, pivotal_mix, suffix_merge_dedup, suffix_sentencepiece, tensor_minhash


def test_stages_do_their_work(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    tables = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], small)
        out.write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        counts.append(tables[-1].count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == columns, name
    _, quality, near, cut, mixed, encoded = tables
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rejected = {r.doc_id for r in cotrain_quality.score(docs, labels).where("not kept").collect()}
    assert {r.doc_id for r in quality.collect()} == {r.doc_id for r in docs.collect()} - rejected
    kept = {r.doc_id for r in tensor_minhash.near_duplicates(quality, 5, 80).where("kept").collect()}
    assert {r.doc_id for r in near.collect()} == kept
    removed = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_merge_dedup.cut_repeats(near).collect()}
    assert all(0 <= removed[r.doc_id] - len((r.text or "").encode()) <= 3 * 60 for r in cut.collect())
    taken = {r.doc_id: r.copies for r in pivotal_mix.plan_mix(cut).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
    assert encoded.count() == mixed.count() and encoded.where("not round_trip").count() == 0


def brute_force(rows):
    """Texts by doc_id that the mix may take, when the classifier keeps all rows: one of each near-copy group, without its repeats."""
    import numpy as np
    from test_llm_operators import jaccard_classes

    found = jaccard_classes(rows, 5, 80)
    kept = list(dict.fromkeys((r[0], r[1]) if n else (i, r[0], r[1]) for i, (r, (_, n, c)) in enumerate(zip(rows, found, strict=True)) if r[0] == c))
    texts = [(k[-2], (k[-1] or "").encode()) for k in kept]
    seen = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for name, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((name, bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_run_on_odd_rows(spark, tmp_path):
    import sentencepiece
    from test_llm_operators import SCHEMA, corpus, words

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=suffix_sentencepiece.default_model())
    may = {(name, tuple(sp.encode(text))): len(words(text)) for name, text in brute_force(rows)}
    times = collections.Counter((r.doc_id, tuple(r.pieces)) for r in got)
    assert set(times) <= set(may) and all(r.round_trip for r in got) and all(times[k] <= 3 for k, n in may.items() if n)
    lang = {r[0]: r[2] for r in rows}
    assert all(r.lang == lang[r.doc_id] for r in got)
    total = sum(may.values())
    assert abs(sum(may[k] * n for k, n in times.items()) - total) <= max(may.values())


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
