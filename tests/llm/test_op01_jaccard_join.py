import random

import numpy as np
import pytest

from affilink.llm import op01_jaccard_join as join


def words_of(text):
    return (text or "").encode().lower().split()


def brute_force(rows, n=3, num=90, den=100):
    """(doc_id, set size, smallest id of the component) of each row, by all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, class_key string")
    return sorted(map(tuple, join.link_components(docs, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(rng, n):
    """Documents of all sizes, each with copies that differ in a few words, and chains of them."""
    rows = []
    while len(rows) < n:
        text = [f"w{rng.randrange(5000)}" for _ in range(int(2 ** rng.uniform(0, 9)))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.8:
                for _ in range(max(1, int(len(text) * rng.choice([0.003, 0.01, 0.03])))):
                    at = rng.randrange(len(text) + 1)
                    text = [*text[:at], f"w{rng.randrange(5000)}", *text[at + rng.randrange(2) :]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("num, seed", [(90, 1), (80, 2)])
def test_components_are_those_of_all_links(spark, num, seed):
    rows = near_copies(random.Random(seed), 260)
    expected = brute_force(rows, num=num)
    assert len({c for _, _, c in expected}) < 0.9 * len(rows)
    assert found(spark, rows, num=num) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(50, "One"), (51, "one"), (52, "one two"), (53, "ONE\x0btwo "), (54, "ein wort")]
    assert found(spark, rows) == brute_force(rows)
    assert join.link_components(no_docs).count() == 0


def test_a_large_group_of_near_copies_is_not_paired_out(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.randrange(12)):
            text[rng.randrange(300)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("n_docs", [10, 10**9])
def test_bands_hold_enough_units(n_docs):
    """Small sets of a large corpus take neighbourhoods short of one element; a small corpus takes plain segments. Spare segments come on top."""
    plan = join.bands({k: n_docs // 4 for k in range(60)})
    for band, above in zip(plan[:12], plan[1:]):
        most = max(join.difference(r, s, 90, 100) for r in range(band.least, above.least) for s in (r, r * 100 // 90))
        assert band.single + 2 * band.double == most + 1 + band.spare
    assert (plan[0].double > 0) == (n_docs > 10**6)


@pytest.mark.parametrize("n_docs", [10, 10**9])
def test_sets_within_the_difference_share_a_key(n_docs):
    rng = np.random.default_rng(3)
    plan = join.bands({k: n_docs // 4 for k in range(60)})
    least = np.array([b.least for b in plan])
    for _ in range(300):
        r = int(2 ** rng.uniform(3.2, 9))
        universe = rng.integers(0, 1 << 64, 2 * r + 20, dtype=np.uint64)
        shared = r
        s = r
        while 100 * (shared - 1) >= 90 * (r + s + 1 - (shared - 1)) and rng.random() < 0.9:
            shared -= 1
        while 100 * shared >= 90 * (r + s + 1 - shared) and rng.random() < 0.9:
            s += 1
        a, b = np.sort(universe[:r]), np.sort(np.concatenate([universe[:shared], universe[r : r + s - shared]]))
        if difference_ok(a, b):
            assert np.intersect1d(join.keys_of(a, plan, least, 90, 100), join.keys_of(b, plan, least, 90, 100)).size or (len(a) == len(b) == shared)


def test_sets_with_many_empty_segments_meet_too():
    """Elements crowd in few segments, so that more than the spare ones are empty: those are indexed then."""
    plan = join.bands({k: 1000 for k in range(60)}, 80, 100)
    least = np.array([b.least for b in plan])
    assert any(b.spare for b in plan[:12])
    rng = np.random.default_rng(4)
    for size in (20, 60, 150):
        a = np.sort(rng.integers(0, 1 << 58, size, dtype=np.uint64))
        b = np.sort(np.concatenate([a[size // 6 :], rng.integers(1 << 63, 1 << 64, 1, dtype=np.uint64)]))
        assert 100 * np.intersect1d(a, b).size >= 80 * np.union1d(a, b).size
        assert np.intersect1d(join.keys_of(a, plan, least, 80, 100), join.keys_of(b, plan, least, 80, 100)).size


def test_blobs_come_back():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 40, 1000, dtype=np.uint64))
    classes = rng.integers(-5, 1 << 40, 1000)
    assert all(np.array_equal(x, y) for x, y in zip(join.opened(join.packed(keys, classes)), (keys, classes)))


def test_buckets_are_keys_that_classes_share():
    keys = np.array([5, 1, 5, 9, 9, 7, 1, 1, 3, 3], dtype=np.uint64)
    classes = np.array([2, 4, 2, 8, 6, 1, 5, 4, 8, 6])
    name, who, low, high = join.shared_keys(keys, classes)
    # 5 and 7 have one class each; 3 and 9 have the same two, and count once
    assert sorted(zip(who.tolist(), low.tolist(), high.tolist())) == [(4, 4, 5), (5, 4, 5), (6, 6, 8), (8, 6, 8)] and len(set(name.tolist())) == 2


def difference_ok(a, b):
    shared = np.intersect1d(a, b).size
    return 100 * shared >= 90 * (len(a) + len(b) - shared)


def test_bands_of_all_sizes_are_planned_at_once():
    """The plan reaches sets of billions; its costs must not be sums over their segments."""
    import time

    start = time.monotonic()
    for num in (80, 90):
        assert join.bands({k: 1000 for k in range(60)}, num, 100)[-1].least * 2 > join.LARGEST_SET
    assert time.monotonic() - start < 10
    assert abs(join.above_poisson(50.0, 60) - join.above_poisson(50.0001, 60)) < 0.02 and join.above_poisson(0.0, 3) == 0


@pytest.mark.parametrize("paired", [1, 8192])
def test_buckets_of_any_size_give_all_links(spark, monkeypatch, paired):
    """Three groups share a passage, so buckets are of several components; compared in a task or sought by elements."""
    monkeypatch.setattr(join, "PAIRED", paired)
    monkeypatch.setattr(join, "STAR_ROUNDS", 1)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for _ in range(12):
        own = [f"g{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(5):
            text = list(own)
            text[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(passage + text)))
    rows += [rows[3]] * 3
    assert found(spark, rows, num=80) == brute_force(rows, num=80)


def test_close_pairs_are_those_of_all(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 80)], rng.integers(0, 1 << 64, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(60)]
    numbers, component, size = rng.permutation(60), rng.integers(0, 8, 60), np.array([len(s) for s in sets])
    sketch = np.array([join.odd_sketch(s) for s in sets]).view(np.uint64)
    expected = set()
    for i in range(60):
        for j in range(i):
            odd = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            if component[i] != component[j] and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j]) and odd <= (size[i] + size[j]) * 20 // 180:
                expected.add((min(numbers[i], numbers[j]), max(numbers[i], numbers[j])))
    for compared in (1, 200, 1 << 20):
        monkeypatch.setattr(join, "COMPARED", compared)
        assert expected and set(zip(*join.close_pairs(numbers, component, size, sketch, 80, 100))) == expected


def test_finer_sketches_rule_out_pairs_of_large_sets(spark):
    """Sets of 1,500 elements that share half pass the first sketch; they must not reach the exact check."""
    words = lambda p, n: [f"{p}{i}" for i in range(n)]
    texts = [words("a", 1500), words("a", 750) + words("b", 750), words("a", 1450) + words("c", 50)]
    chosen = spark.createDataFrame([(" ".join(t), k) for k, t in enumerate(texts)], "text string, class_no long")
    sets = join.sets_of(chosen, 1)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    few = join.possible(pairs, sets, 80, 100)
    assert few.count() == 3
    near = join.finely(few, sets, 80, 100)
    assert [tuple(r) for r in near.collect()] == [(0, 2)] == [tuple(r) for r in join.verified(near, sets, 80, 100).collect()]
