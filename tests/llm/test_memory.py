"""What tasks hold at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from jobtrail.llm import jaccard, perplexity


def test_a_block_is_cut_in_a_few_times_its_size(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task())

        def partitionId(self):
            return 0

    monkeypatch.setattr(jaccard, "TaskContext", Task)
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 10**6, 700_000)]
    texts = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    whole = [part.to_pylist() for part in jaccard._cut(5, 5)(iter([batch]))]
    del whole
    tracemalloc.clear_traces()
    assert len(list(jaccard._cut(5, 5)(iter([batch])))) == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * batch.nbytes


def test_slices_of_a_block_give_the_same_sets(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bb", "c", "d"], rng.integers(0, 40))) for _ in range(300)] + [None, ""]
    block = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    whole = jaccard.distinct(*jaccard.shingles(*jaccard.word_hashes(*jaccard._flat(block.column(1))), 5), len(block))
    for size in (1, 200, 1 << 19):
        monkeypatch.setattr(jaccard, "SLICE", size)
        for one, other in zip(jaccard._sets(block, 5), whole, strict=True):
            assert np.array_equal(one, other)


def test_scoring_moves_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(perplexity, "map_rows", lambda rows, run, *added: seen.append(rows) or rows)
    docs = spark.createDataFrame([(1, "one text", "en")], "doc_id long, text string, lang string")
    perplexity.scored(docs, "text", [lambda: None], list(perplexity.MEASURES))
    assert [kind for _, kind in seen[0].dtypes].count("string") == 2
