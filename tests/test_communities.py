import random
import zlib
from collections import defaultdict

import pytest

from memoria.operators.communities import LEAST_GAIN, communities, modularity


def plain(links, rounds=12, levels=8):
    """The same moves in plain Python."""
    weight = defaultdict(float)
    for a, b, w in links:
        weight[a, b] += w
        weight[b, a] += w
    total = sum(weight.values())
    result = {n: n for n, _ in weight}
    quality = lambda g, at: sum(w for (a, b), w in g.items() if at[a] == at[b]) / total - sum(v * v for v in _by(g, at).values()) / total**2
    reached = quality(weight, result)
    for _ in range(levels):
        degree = defaultdict(float)
        for (a, _), w in weight.items():
            degree[a] += w
        at, before, failed = {n: n for n in degree}, reached, 0
        for turn in range(rounds):
            sums = defaultdict(float)
            for n, d in degree.items():
                sums[at[n]] += d
            offers = {n: defaultdict(float, {at[n]: 0.0}) for n in degree}
            for (a, b), w in weight.items():
                if a != b:
                    offers[a][at[b]] += w
            new = {}
            for n, own in offers.items():
                gain = {c: round(w - degree[n] * (sums[c] - (degree[n] if c == at[n] else 0)) / total, 9) for c, w in own.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                goes = (zlib.crc32(f"{n}:{turn // 2}".encode()) + turn) % 2 == 0 and gain[best] > gain[at[n]] + LEAST_GAIN
                new[n] = best if goes else at[n]
            q = quality(weight, new)
            if q > reached + LEAST_GAIN:
                at, reached, failed = new, q, 0
            else:
                failed += 1
                if failed == 2:
                    break
        if reached <= before + LEAST_GAIN:
            break
        result = {n: at[c] for n, c in result.items()}
        merged = defaultdict(float)
        for (a, b), w in weight.items():
            merged[at[a], at[b]] += w
        weight = merged
    return result, reached


def _by(graph, at):
    sums = defaultdict(float)
    for (a, _), w in graph.items():
        sums[at[a]] += w
    return sums


def planted(rng, groups, size, inner, outer):
    nodes = [(g, f"n{g}_{i}") for g in range(groups) for i in range(size)]
    links = [(a, b, 1.0) for i, (g, a) in enumerate(nodes) for h, b in nodes[:i] if rng.random() < (inner if g == h else outer)]
    return {n: g for g, n in nodes}, links


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_moves_and_planted_groups_found(spark, seed):
    group, links = planted(random.Random(seed), 4, 12, 0.8, 0.03)
    expected, reached = plain(links)
    found, quality = communities(spark.createDataFrame(links, "src string, dst string, weight double"))
    got = {r.node: r.com for r in found.collect()}
    assert got == expected and abs(quality - reached) < 1e-9
    assert len({(group[n], c) for n, c in got.items()}) == 4 == len(set(got.values()))


def test_odd_graphs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    assert communities(frame([]))[0].count() == 0
    found, quality = communities(frame([(1, 1, 2.0), (2, 3, 1.0), (3, 2, 1.0), (None, 4, 1.0), (5, 6, 0.0), (7, 8, -1.0)]))
    got = {r.node: r.com for r in found.collect()}
    assert got[2] == got[3] != got[1] and set(got) == {1, 2, 3} and quality == 0.5
    both = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src bigint, dst bigint, weight double")
    assert modularity(both, spark.createDataFrame([(1, 1), (2, 1)], "node bigint, com bigint")) == 0
