"""Near duplicates by tensored banding against all pairs."""

import random
import re

import numpy as np
import pytest

from tests.llm.test_simhash import joined
from tripmill.llm import tensored
from tripmill.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + 2]) for i in range(len(words) - 1)} or ({tuple(words)} if words else set())


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgÀÉ", k=draw.randint(3, 6)))
    rows = []
    for size in (1, 2, 5, 6, 11, 30, 100, 300) * 4:
        words = [word() for _ in range(size)]
        for copy in range(draw.choice([1, 2, 4])):
            changed = list(words)
            for _ in range(int(size * copy * draw.choice([0, 0.02, 0.05, 0.08]))):
                changed[draw.randrange(size)] = word()
            rows.append((len(rows), "\n".join(changed).upper() if copy == 1 else " ".join(changed)))
    base = [word() for _ in range(200)]  # a chain: only neighbours are alike
    rows += [(1000 + k, " ".join(base[6 * k: 6 * k + 80])) for k in range(15)]
    rows += [(2000 + k, " ".join([*base[:120], *[word() for _ in range(draw.randint(0, 40))]])) for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, " \t "), (3003, "one"), (3004, "ONE"), rows[5], (3005, " ".join(base * 300))]
    return rows


def want_of(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = range(len(sets))
    linked = lambda a, b: sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])
    top = joined(ids, linked)
    least = {}
    for k in ids:
        least[top[k]] = min(least.get(top[k], sets[k][0]), sets[k][0])
    return sorted((i, len(s), least[top[k]], i == least[top[k]]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("group", [512, 6])
def test_groups(docs_of, monkeypatch, group):
    monkeypatch.setattr(tensored, "GROUP", group)  # 6: large trees go by hubs and in parts
    rows = corpus()
    assert sorted(tuple(r) for r in tensored.near_groups(docs_of(rows)).collect()) == want_of(rows)


def test_recall_of_the_keys():
    """Sets of exactly 0.8 share a key at least 99 times of 100."""
    draw = np.random.default_rng(3)
    shared = 0
    for _ in range(1000):
        values = draw.integers(0, 1 << 63, 100, dtype=np.uint64)
        both = np.concatenate((values[:90], values[10:]))  # 80 of 100
        left = tensored.half_keys(both, np.array([0, 90]))
        same = left[0] == left[1]
        shared += same[: tensored.M].any() and same[tensored.M:].any()
    assert shared >= 990


def test_parts_hold_all_pairs_outside_the_main_component(docs_of, monkeypatch):
    """A hub with many sets, only some of them linked with it: links between the others are found too."""
    monkeypatch.setattr(tensored, "GROUP", 8)
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    base = [word() for _ in range(150)]
    rows = [(k, " ".join([*base, *[word() for _ in range(k % 12 * 5)]])) for k in range(90)]
    far = [word() for _ in range(30)]
    rows += [(500 + k, " ".join([*base[:140], *far, *[word() for _ in range(k)]])) for k in range(20)]
    assert sorted(tuple(r) for r in tensored.near_groups(docs_of(rows)).collect()) == want_of(rows)


def test_null_ids_and_empty_tables(docs_of):
    found = tensored.near_groups(docs_of([(None, "a b c"), (7, "A b c"), (None, "x y"), (None, None)])).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [
        (None, 2, 7, False), (7, 2, 7, True), (None, 1, None, True), (None, 0, None, True)]))
    assert tensored.near_groups(docs_of([])).isEmpty()


def test_components_take_few_tasks(spark):
    """Chains, stars, loops and repeats as by a search from each node; a round of few links is few tasks whatever the partitions."""
    draw = random.Random(12)
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    pairs = [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(140)]
    rows = [draw.sample(x, 2) for x in chain + hub + pairs + pairs]
    near = {}
    for u, v in rows:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want, seen = set(), set()
    for node in near:
        if node not in seen:
            group, left = {node}, [node]
            while left:
                left += (more := near[left.pop()] - group)
                group |= more
            seen |= group
            want.add(frozenset(group))
    settings = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "0"}
    before, context = {k: spark.conf.get(k) for k in settings}, spark.sparkContext
    for k, v in settings.items():
        spark.conf.set(k, v)
    context.setJobGroup("few-tasks", "")
    try:
        got = {}
        for r in components(spark.createDataFrame(rows, "u bigint, v bigint").repartition(40)).collect():
            got.setdefault(r.root, set()).add(r.node)
        tracker = context.statusTracker()
        found = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds]
        assert sum(x.numCompletedTasks for x in found if x) < 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {frozenset(x) for x in got.values()} == want


def test_sets_of_a_key_meet_its_hub_whatever_their_tasks(spark):
    """Two tasks, one key: no set is tied to another than the smallest of all."""
    half = np.arange(2 * tensored.M, dtype=np.uint64).tobytes()
    rows = [[(1, half), (5, half)], [(3, half), (4, half)]]
    parts = spark.sparkContext.parallelize([x for p in rows for x in p], 2)
    kinds = spark.createDataFrame(parts, "node bigint, halves binary")
    assert {(r.u, r.v, r.n) for r in tensored.ties(kinds).collect()} == {(1, v, tensored.M ** 2) for v in (3, 4, 5)}


def test_sets_are_shuffled_once_and_repeated_rows_count_once(docs_of, spark, monkeypatch):
    """Whole sets of small trees go to their tree by one exchange, without a join before it."""
    plans, stage = {}, tensored.stage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return stage(df, name)

    monkeypatch.setattr(tensored, "stage", seen)
    rows = corpus() * 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sorted(tuple(r) for r in tensored.near_groups(docs_of(rows)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == want_of(rows)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plans["sets"] + plans["component-roots"])
    assert moved and sum("shingles#" in m or "first" in m for m in moved) == 1
