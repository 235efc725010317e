"""Queries with a SQL twin against it, and the pipeline on a small table against brute force of its stages."""

import check
import pytest

import corpus_pipeline
from tidepair.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    folder = "/root/testdata/sf0.001"
    assert check.compare(spark, check.oracle_session(folder), folder, name) is None


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidepair.llm import tokens
    from test_operators import link_groups

    folder = "/root/testdata/sf0.001"
    kept, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    before, after = sorted(kept[0]), sorted(kept[1])
    _, root = link_groups([t for _, t in before], 5)
    assert after == [before[i] for i, k in enumerate(root) if i == k]
    items = [r.text.lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = [d for d in after if any(i in d[1].lower() for i in items)]
    assert not set(leaks) & set(kept[2]) and set(kept[2]) <= set(after)
    assert len(after) - len(kept[2]) <= 2 * len(leaks) + 2
    rows = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r.start)
    tokenizer, start = Tokenizer.from_file(tokens.default_tokenizer()), 0
    for r, (doc_id, text) in zip(rows, sorted(kept[3]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(tokenizer.encode(text, add_special_tokens=False).ids) + 1)
        start += r.n_tokens
