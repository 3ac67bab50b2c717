"""The five stages against plain versions of what each has to do."""

import random

import corpus_pipeline
from evalmill.llm import minhash


def test_stages_keep_columns_and_drop_what_they_must(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["an", "ti", "re", "on", "es", "the", "wh"], k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(40, 90))) for _ in range(120)]
    texts += [" ".join(f"{word().upper()}!!" for _ in range(60)) for _ in range(60)]
    texts += [texts[0], texts[1]]
    item = " ".join(word() for _ in range(25)) + ". " + " ".join(word() for _ in range(8)) + "."
    texts += [texts[2] + " " + item]
    rows = [(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)]
    put = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int", "labels")
    put([(0, item)], "item_id long, text string", "benchmark")

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good, single, clean, mixed = kept
    assert len(good & set(range(120))) >= 115 and not good & set(range(120, 180))
    sets = {i: minhash.shingle_set(texts[i], 5) for i in good}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert single == {i for i in good if not any(j < i and near(i, j) for j in good)}
    assert clean == single - {182} and mixed == clean
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == mixed
    ends = sorted((r.start, r.n_tokens) for r in out)
    assert all(s + n == t for (s, n), (t, _) in zip(ends, ends[1:])) and ends[0][0] == 0


def test_stages_take_odd_rows(spark, tmp_path):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    texts = [(1, a), (5, a), (5, b), (9, b), (3, b), (3, b), (None, a), (None, None), (7, ""), (8, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, epoch long, score double, record string"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put([(i, t, "en", None if i == 9 else "s", 0, 4, 4, 0.5, "r") for i, t in texts], schema, "documents")
    put([], "doc_id long, quality int, toxic int", "labels")
    put([], "item_id long, text string", "benchmark")
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        counts.append(sorted((r.doc_id is None, r.doc_id) for r in docs.collect()))
    assert len(counts[0]) == 10
    assert [i for _, i in counts[1]] == [1, 7, 8, None, None] and counts[2] == counts[1] and set(counts[3]) == set(counts[1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(counts[3])
    empty = tmp_path / "empty"
    put([], schema, "empty/documents"), put([], "doc_id long, quality int, toxic int", "empty/labels"), put([], "item_id long, text string", "empty/benchmark")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
