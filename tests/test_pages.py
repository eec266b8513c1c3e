"""Pages by place and by key against skipping."""

from __future__ import annotations

import random

from tallywood.operators.pages import SortedPages, ordering

ORDER = [("d", True, False), ("k", True, False)]


def test_pages_are_those_of_skipping(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), f"k{i:05d}", "x" * 20) for i in range(3000)]
    frame = spark.createDataFrame(rows, "d int, k string, v string").repartition(3)
    for order in (ORDER, [("d", False, True), ("k", True, False)]):
        all_rows = [tuple(r) for r in frame.orderBy(*ordering(order)).collect()]
        t = SortedPages(spark, f"file://{tmp_path}/{hash(str(order))}", order).write(frame, 20)
        for offset in (0, 1490, 2950, 3000):
            assert [tuple(r) for r in t.page(offset, 100).collect()] == all_rows[offset : offset + 100]
        for at in (0, 1499, 2950, 2999):
            assert [tuple(r) for r in t.after(all_rows[at][:2], 100).collect()] == all_rows[at + 1 : at + 101]
        assert [tuple(r) for r in t.after(None, 7).collect()] == all_rows[:7]


def test_a_deep_page_reads_as_few_files_as_the_first(spark, tmp_path):
    t = SortedPages(spark, f"file://{tmp_path}/t", [("id", False, False)]).write(spark.range(20_000), 40)
    files = lambda page: len(page.inputFiles())
    assert {files(t.page(n, 50)) for n in (0, 10_000, 19_900)} <= {1, 2} and files(t.after((10_000,), 50)) <= 3
    assert [r.id for r in t.page(10_000, 3).collect()] == [10_000, 10_001, 10_002]
    none = SortedPages(spark, f"file://{tmp_path}/none", [("id", False, False)]).write(spark.range(0), 4)
    assert none.page(0, 10).count() == 0 and none.after((1,), 10).count() == 0

