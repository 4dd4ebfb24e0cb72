"""Each stage against a plain version on its own input."""

import corpus_pipeline
from tillbook.llm import pii, quality_rules, tokens
from tillbook.session import written

from . import test_exact_dedup, test_packing
from .conftest import ODD


def pairs(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf_dir), "stage")
        assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        rows, kept = pairs(before), pairs(after)
        ids = {i for i, _ in kept}
        if name == names[0]:
            model = quality_rules.estimate(dict(_counted(quality_rules.votes(t)[1] for _, t in rows)))
            good = {i for i, t in rows if _passes(*quality_rules.votes(t), model)}
            assert ids == good and len(kept) == len(ids)
        elif name == names[1]:
            assert ids == {r[0] for r in test_exact_dedup.plain(rows) if r[3]}
        elif name == names[2]:
            assert ids <= {i for i, _ in rows} and len(kept) == len(ids)
            assert set(kept) <= set(rows)
        else:
            assert ids == {i for i, _ in rows}
            for i, t in rows:
                assert not pii.base_spans(dict(kept)[i])
                if not pii.base_spans(t):
                    assert dict(kept)[i] == t
            lengths = {r.doc_id: r.n_chars for r in after.collect()}
            assert all(lengths[i] == len(t) for i, t in kept)
        before = after
    test_packing.check(pairs(before), corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect())


def _counted(patterns):
    from collections import Counter

    return Counter(patterns)


def _passes(counts, pattern, model):
    n = counts["n_words"]
    return n >= 50 and 100 * counts["n_repeat_words"] <= 50 * n and model.posterior(pattern) >= quality_rules.THRESHOLD


def test_run_equals_the_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    assert rows and all(r.offset + r.length <= 2048 for r in rows)


def test_every_stage_takes_odd_and_empty_tables(spark, frame):
    for rows in (ODD, []):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame(rows), "nowhere").count() <= 2 * len(rows) + 10


def test_tokenizer_path_is_a_parameter():
    assert tokens.tokenizer_path("word_bpe_49k.json").endswith("word_bpe_49k.json")
