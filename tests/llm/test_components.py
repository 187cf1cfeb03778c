"""Connected components: files of a round, and groups against a search."""

import random

from oscilla.llm.components import PARTS, components


def test_rounds_over_few_links_write_few_files(spark, monkeypatch):
    rng = random.Random(7)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    written = []
    import oscilla.llm.components as module

    real = module.durable
    monkeypatch.setattr(module, "durable", lambda df: written.append(real(df)) or written[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    # the first table is the links themselves
    assert max(len(t.inputFiles()) for t in written[1:]) <= PARTS
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert out[node] == min(seen)
    assert set(out) == set(near)
