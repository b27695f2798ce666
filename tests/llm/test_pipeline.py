from __future__ import annotations

import corpus_pipeline
from panelspark.llm.common import saved, table
from panelspark.llm.queries import oracle_sql, queries


def test_stages_keep_columns_and_rows_shrink(spark, folder):
    docs = table(spark, folder, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_names():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries())
    assert numbers == list(range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_a_worker_holds_the_cache_of_one_operator():
    """Hashes, tokenizers and subwords of all stages stayed in every reused worker."""
    import gc
    import weakref

    from panelspark.llm.common import Bounded, forget_caches, worker_cache

    first = worker_cache("one", lambda: Bounded(len, 10))
    assert worker_cache("one", lambda: None) is first
    held = weakref.ref(first)
    del first
    second = worker_cache("two", lambda: Bounded(len, 10))
    gc.collect()
    assert held() is None and second is worker_cache("two", lambda: None)
    forget_caches()
    assert worker_cache("two", lambda: "new") == "new"
    forget_caches()
