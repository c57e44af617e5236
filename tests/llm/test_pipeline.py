"""The pipeline against its stages' rules applied plainly."""

from tests.llm.test_operators import shingle_sets
from tripweave.llm import pii, quality


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = P.table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    field = quality.fit_field(docs, P.table(spark, sf, "labels"))
    kept = {}
    for i, t in rows.items():
        base, x, sizes = quality.examine(t)
        if not quality.base_fails(base[0], base[4]) and field.content_share(x, sizes) >= quality.CONTENT_SHARE:
            kept[i] = t
    sets, parent = shingle_sets(kept.items(), 5), {i: i for i in kept}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in kept:
        for j in kept:
            x = len(sets[i] & sets[j])
            if i < j and 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    kept = {i: t for i, t in kept.items() if top(i) == i}
    items = shingle_sets([(r.item_id, r.text) for r in P.table(spark, sf, "benchmark").collect()], 5)
    kept = {i: t for i, t in kept.items() if not any(q and len(q & sets[i]) >= 0.8 * len(q) for q in items.values())}
    got = {r.doc_id: r for r in P.run(spark, sf).collect()}
    assert set(got) == set(kept) and all(r.round_trip for r in got.values())
    assert any(pii.base_spans(t) for t in kept.values())


def test_stages_on_empty_and_odd_tables(spark, odd, empty, tmp_path):
    """Each stage takes rows without id or text, repeated rows, extra columns and no rows at all; all but the last keep the columns."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    n = odd.count()
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and 0 < out.count() <= n
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, odd, str(tmp_path)).count() == n and P.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
