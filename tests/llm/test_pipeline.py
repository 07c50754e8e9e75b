"""The pipeline's stages against brute force, one after the other."""

from collections import Counter, defaultdict

import corpus_pipeline
from larkspur.llm import mixing, pieces, quality_rules
from tests.llm.test_operators import SCHEMA, brute_components, brute_lines, brute_measures, corpus, words


def test_stages(spark, tmp_path):
    rows = corpus(11, 150)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = stages[name](spark, df, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        return spark.read.parquet(path)

    one = step("quality_rules", docs)
    kept = [r for r in rows if (m := brute_measures(r[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    got = {r.doc_id for r in one.collect()}
    assert got <= {r[0] for r in kept} and one.columns == docs.columns
    strict = quality_rules.ledger(docs).filter(quality_rules.passes("v2", quality_rules.F.col("ledger")["fail_bits"]))
    assert got == {r.doc_id for r in strict.collect()}

    two = step("line_dedup", one)
    texts = [(r.doc_id, r.text) for r in one.collect()]
    gone = brute_lines(sorted(texts))
    expect = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in texts}
    assert {r.doc_id: r.text for r in two.collect()} == {i: t for i, t in expect.items() if words(t)}
    assert all(r.n_chars == len(r.text) for r in two.collect()) and two.columns == docs.columns

    three = step("ngram_jaccard_join", two)
    first = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in two.collect()]) if i == c}
    assert {r.doc_id for r in three.collect()} == first

    four = step("mixing", three)
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(three).collect()}
    taken = defaultdict(int)
    for r in four.collect():
        taken[r.doc_id] += len(words(r.text))
    assert dict(taken) == {i: t for i, t in plan.items() if t} and four.columns == docs.columns

    five = step("sentencepiece", four)
    table = pieces.ChunkTable(pieces.default_model())
    want = Counter((r.doc_id, table.encode_decode([r.text])[0][0]) for r in four.collect())
    assert Counter((r.doc_id, " ".join(map(str, r.ids))) for r in five.collect()) == want
    assert all(r.decoded is not None for r in five.collect())

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in five.collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
