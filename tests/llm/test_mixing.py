import re
from collections import defaultdict

from tallymark.llm import mixing
from tests.llm.data import documents, near_copies


def filled(sizes):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[n] for n in free)
        over = {n for n in free if left * weight[n] / total > 2 * sizes[n]}
        if not over:
            return target | {n: left * weight[n] / total for n in free}
        for n in over:
            target[n] = 2 * sizes[n]
            left -= 2 * sizes[n]
        free -= over
    return target


def test_targets_and_takings(spark):
    texts = near_copies() + ["a b"] * 5
    sources = [None if i % 11 == 3 else f"s{i % 5}" if i % 3 else "hot" for i in range(len(texts))]
    docs = documents(spark, texts, sources=sources, ids=[None if i == 4 else i // 2 for i in range(len(texts))])
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += count(t)
    want, taken, longest = filled(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) == r["copies"]
        assert all(0 <= s < 8 for s in r["shards"])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    key = lambda r: tuple(map(str, r))
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(again, key=key) == sorted(rows, key=key)


def test_splitting_tree_gives_exact_quotas(spark):
    draws = spark.createDataFrame([(1, 40), (2, 13), (3, 0), (4, 11)], "source_no int, draws bigint")
    rows = mixing.split_draws(draws).collect()
    by_source, by_shard = defaultdict(list), defaultdict(int)
    for r in rows:
        by_source[r["source_no"]].append(r["draw"])
        by_shard[r["shard"]] += 1
    assert {k: sorted(v) for k, v in by_source.items()} == {
        1: list(range(1, 41)), 2: list(range(1, 14)), 4: list(range(1, 12))}
    assert set(by_shard.values()) == {8}


def test_no_words_and_no_rows(spark):
    rows = mixing.mix_sources(documents(spark, ["", None, " \t"])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in rows] == [(0, 0, 0.0)] * 3
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_what_is_taken_comes_from_the_tree(spark):
    docs = documents(spark, near_copies())
    narrow = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "block_shards" in plan and "LeftOuter" in plan
    for r in mixing.mix_sources(docs).collect():
        assert r["taken"] == len(r["shards"]) * r["size"] == r["copies"] * r["size"]
