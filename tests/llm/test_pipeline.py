from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from terrafold.llm.common import stored
from terrafold.llm.quality import fit_quality, quality_score

from .helpers import DOCS, components, words
from .test_line_dedup import brute as brute_lines
from .test_quality import corpus


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    rows += [(1000 + i, r[1], *r[2:]) for i, r in enumerate(rows[:60])]  # copies
    passage = "alpha beta gamma delta\nepsilon zeta eta theta\niota kappa lambda mu\nnu xi omicron pi"
    rows += [(2000 + i, f"{rows[i][1]} {i}\n{passage}\nend {i} of {i}", *rows[i][2:]) for i in range(60, 90)]
    rows += [(3000, None, "en", "t", None), (3001, "", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: r[1] for r in rows}
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stored(stages[0](spark, docs, str(tmp_path)))
    assert good.columns == docs.columns
    score = quality_score(fit_quality(docs, lab))
    kept = {r["doc_id"] for r in docs.select("doc_id", score(F.col("text")).alias("s")).collect() if r["s"] >= 0.5}
    assert {r["doc_id"] for r in good.collect()} == kept and 0 < len(kept) < len(rows)

    lines = stored(stages[1](spark, good, str(tmp_path)))
    want = brute_lines([(i, text[i]) for i in kept])
    clean = {i: want.get((i, text[i])) for i in kept}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == clean
    assert sum(len(clean[i] or "") < len(text[i] or "") for i in kept) >= 20

    one = stored(stages[2](spark, lines, str(tmp_path)))
    comp = components(clean)
    assert {r["doc_id"] for r in one.collect()} == {i for i in comp if comp[i] == i}

    mix = stored(stages[3](spark, one, str(tmp_path)))
    assert mix.columns == docs.columns
    size = {i: len(words(clean[i])) for i in comp if comp[i] == i}
    got = Counter()
    for r in mix.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert all(got[i] <= 2 * size[i] for i in got)
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())

    packed = stages[4](spark, mix, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in packed) == Counter((r["doc_id"], len(words(r["text"]))) for r in mix.collect())

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))
