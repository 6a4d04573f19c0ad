"""Near-duplicates, components and mixing, against brute force."""

from __future__ import annotations

import functools
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlog.llm import mixing, near_dedup
from playlog.llm.components import components
from playlog.llm.tables import count_words
from playlog.session import work_folder


def brute_groups(rows, size, percent):
    """The smallest id reachable over links of whole sets."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        shingles = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        if doc_id is not None and shingles:
            sets[doc_id].append(shingles)
    parent = {doc_id: doc_id for doc_id, _ in rows if doc_id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {doc_id: find(doc_id) for doc_id in parent}


def changed(text, n, draw):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Groups of exact and near copies of several sizes and degrees, chains, short texts."""
    draw = random.Random(5)
    rows = []
    for size in (1, 1, 2, 3, 5, 60):
        base = " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.choice([30, 80, 200])))
        rows += [changed(base, draw.choice([0, 0, 1, 2, 4, 8]), draw) for _ in range(size)]
    chain = " ".join(f"c{draw.randrange(10**6)}" for _ in range(120))
    for _ in range(12):
        rows.append(chain)
        chain = changed(chain, 2, draw)
    rows += ["", None, " \n ", "one", "One", "one two", "ONE TWO", "one two three"]
    draw.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_of_copies(spark, copies, size, percent):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string")
    found = {row["doc_id"]: row for row in near_dedup.near_duplicates(docs, size, percent).collect()}
    expected = brute_groups(copies, size, percent)
    assert {doc_id: row["component_id"] for doc_id, row in found.items()} == expected
    assert all(row["kept"] == (row["doc_id"] == row["component_id"]) for row in found.values())
    kept = near_dedup.one_of_each(docs, size, percent)
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(set(expected.values()))


def test_large_group_of_near_copies(spark):
    draw = random.Random(1)
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(k, changed(base, 2, draw)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {row["doc_id"]: row["component_id"] for row in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert found == brute_groups(rows, 3, 85)


def test_star_around_a_middle_id(spark):
    """Copies that are linked with the original only, which is neither first nor last."""
    draw = random.Random(4)
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(k, base if k == 217 else changed(base, 2, draw)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {row["doc_id"]: row["component_id"] for row in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert found == brute_groups(rows, 3, 85)


def test_linked_sets_share_a_start():
    draw = np.random.default_rng(6)
    none = near_dedup.Order(np.empty(0, np.uint64), np.empty(0, np.int64))
    bitmap = draw.integers(0, 256, (1 << near_dedup.MOVED_BITS) // 8, np.uint8)
    moved = near_dedup.Order(none.known, none.counts, (bitmap, bitmap & 0x55, bitmap & 0x11))
    for _ in range(300):
        both = draw.integers(0, 1 << 63, draw.integers(1, 60), np.uint64)
        some = [np.unique(np.append(both, draw.integers(0, 1 << 63, draw.integers(0, 9), np.uint64))) for _ in range(2)]
        common = near_dedup.Order(np.sort(both[: len(both) // 2]), np.full(len(both) // 2, 3), moved.moved)
        if 100 * len(both) >= 80 * len(np.union1d(*some)):
            for order in (none, moved, common):
                assert len(np.intersect1d(*[order.start_of(own, 80) for own in some]))
        parities = [near_dedup.parity_of(own) for own in some]
        assert near_dedup.at_most_common(*parities, sum(map(len, some))) >= len(np.intersect1d(*some))


def test_sets_that_share_little_do_not_meet(spark):
    draw = np.random.default_rng(8)
    passage = draw.integers(0, 1 << 63, 20, np.uint64)
    sets = [np.unique(np.append(passage, draw.integers(0, 1 << 63, 40 + 3 * k, np.uint64))) for k in range(60)]
    sets += [sets[0][1:], np.append(sets[1], np.uint64(1 << 63)), passage[:2], passage[:1]]
    starts = [np.intersect1d(own, passage).tobytes() for own in sets]
    rows = [(k, len(own), k, starts[k], near_dedup.parity_of(own)) for k, own in enumerate(sets)]
    vertices = spark.createDataFrame(rows, "id long, n long, component long, start binary, parity binary")
    every = np.full((1 << near_dedup.MOVED_BITS) // 8, 255, np.uint8)
    firsts = functools.partial(near_dedup._firsts, bitmap=every)
    members = vertices.mapInArrow(firsts, getattr(near_dedup, "MEETING", near_dedup.FIRSTS))
    found = {tuple(row) for row in near_dedup._meeting(members, members, 85).collect()}
    assert {(0, 60), (1, 61)} <= found
    assert len(found) < 30  # of 1,891 pairs that share the passage


def test_contested_shingles_are_told_from_others_at_a_start(spark):
    """The shingles at the start of a set are small numbers, contested or not."""
    shingles = spark.range(300_200).select(F.shiftrightunsigned(F.xxhash64("id"), 3).alias("shingle"), "id")
    bitmap = near_dedup._bitmap(shingles.where("id < 300000").select("shingle"))
    contested = shingles.where("id BETWEEN 299900 AND 299999").toPandas()["shingle"].to_numpy()
    others = np.random.default_rng(3).integers(0, 1 << 61, 20_000, np.uint64)
    starts = [contested.view(np.uint64), *np.split(others, 100)]
    rows = [(k, len(own), k, own.tobytes(), near_dedup.parity_of(own)) for k, own in enumerate(starts)]
    vertices = spark.createDataFrame(rows, "id long, n long, component long, start binary, parity binary")
    told = vertices.mapInArrow(functools.partial(near_dedup._firsts, bitmap=bitmap), near_dedup.MEETING)
    counts = {row["found"]: row["count"] for row in told.groupBy((F.col("id") == 0).alias("found")).count().collect()}
    assert counts[True] == 100
    assert counts.get(False, 0) < 100  # of 20,000


def test_bitmap_grows_with_contested_shingles(spark):
    assert [near_dedup.contested_bits(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 23, 1 << 40)] == [24, 24, 25, 27, 29]
    shingles = spark.range(50_000).select(F.xxhash64("id").alias("shingle"))
    bitmap = near_dedup._bitmap(shingles, 26)
    own = shingles.toPandas()["shingle"].to_numpy().view(np.uint64)
    assert len(bitmap) == 1 << 23
    assert len(near_dedup._told(bitmap, own)) == len(own)
    assert len(near_dedup._told(bitmap, np.random.default_rng(4).integers(0, 1 << 63, 50_000, np.uint64))) < 50


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_odd_rows(request, table):
    rows = request.getfixturevalue(table)
    found = near_dedup.near_duplicates(rows, 3, 85).collect()
    assert len(found) == 10
    assert all(row["component_id"] == row["doc_id"] and row["kept"] for row in found)
    assert {row["doc_id"]: row["n_shingles"] for row in found}[2] == 0
    kept = near_dedup.one_of_each(rows, 3, 85)
    assert kept.columns == rows.columns
    assert Counter(row["doc_id"] for row in kept.collect()) == Counter({k: 1 for k in (1, 2, 3, 4, 5, 6, 7, 8, None)})


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l"), (4, "m n o")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(row["doc_id"], row["component_id"]) for row in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_no_documents(spark, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.one_of_each(no_docs).count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    links = spark.createDataFrame(chain + star + [(5000, 5000)], "a bigint, b bigint")
    found = {row["id"]: row["component"] for row in components(links).collect()}
    assert found == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)}


def test_words_of_a_column():
    import pyarrow as pa

    texts = ["a b", None, "", "  x\ty ", "é\xa0z w", "\n", "end"]
    column = pa.array(["skipped row", *texts])[1:]
    assert count_words(column).tolist() == [2, 0, 0, 2, 2, 0, 1]
    assert count_words(pa.array([], pa.string())).tolist() == []


def shares(sizes, weights, most=3):
    """Targets by sharing out again and again."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        weight = sum(weights[k] for k in range(len(sizes)) if k not in capped)
        target = [most * sizes[k] if k in capped else rest * weights[k] / weight for k in range(len(sizes))]
        over = {k for k in range(len(sizes)) if k not in capped and target[k] > most * sizes[k]}
        if not over:
            return target
        capped |= over


def test_targets(spark):
    draw = random.Random(2)
    for _ in range(3):
        sizes = [draw.choice([1, 5, 100, 4000]) for _ in range(draw.randrange(2, 9))]
        names = [f"s{k}" for k in range(len(sizes))]
        rows = [(False, name, size) for name, size in zip(names, sizes, strict=True)]
        frame = spark.createDataFrame(rows, "no_source boolean, name string, source_size bigint")
        found = {row["name"]: row["target"] for row in mixing.source_targets(frame).collect()}
        expected = shares(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
        assert np.allclose([found[name] for name in names], expected)


def test_mix(spark):
    draw = random.Random(3)
    rows = [
        (k, "w " * draw.randrange(0, 60), draw.choice(["hot", "hot", "hot", "b", "c", "d", None]), "x") for k in range(3000)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    found = mixing.mix(docs).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert len(found) == 3000
    by_source = defaultdict(list)
    for row in found:
        assert row["taken"] == row["copies"] * row["size"] <= 3 * row["size"]
        by_source[row["source"]].append(row)
    for own in by_source.values():
        assert sum(row["size"] for row in own) == own[0]["source_size"]
        assert abs(sum(row["taken"] for row in own) - own[0]["target"]) <= 3 * 60
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(row["doc_id"] for row in mixed.collect()) == Counter({row["doc_id"]: row["copies"] for row in found if row["copies"]})


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_mix_of_odd_rows(request, table):
    found = mixing.mix(request.getfixturevalue(table)).collect()
    assert len(found) == 10
    assert {row["source"] for row in found} == {None, "", "a", "b", "c"}
    assert all(row["taken"] <= 3 * row["size"] for row in found)
    assert mixing.mixed_documents(request.getfixturevalue(table)).count() == sum(row["copies"] for row in found)


@pytest.mark.parametrize("ids", ["null", "one", "some"])
def test_mix_of_rows_that_share_an_id(spark, ids):
    """Every row has its own decision, and the mix meets its targets, also where rows are equal in everything."""
    draw = random.Random(6)
    doc_id = {"null": lambda _: None, "one": lambda _: 1, "some": lambda k: k % 3}[ids]
    rows = [(doc_id(k), "w " * draw.randrange(1, 30), draw.choice("aab")) for k in range(80)]
    docs = spark.createDataFrame([(*row, 70, 7, None) for row in rows], "doc_id bigint, text string, source string, _copy int, Copies int, _source string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = mixed.collect()
    assert {(row["_copy"], row["Copies"], row["_source"]) for row in found} == {(70, 7, None)}
    words = Counter()
    for row in found:
        words[row["source"]] += len(row["text"].split())
    expected = Counter()
    for row in mixing.mix(docs).collect():
        expected[row["source"]] += row["taken"]
        assert abs(expected[row["source"]]) <= 1e9
    assert words == expected
    assert sorted(found) == sorted(mixing.mixed_documents(docs.repartition(5)).collect())


def test_columns_of_any_name_stay(clashing):
    rows = clashing.withColumn("_bit", F.lit(7)).withColumn("BIT", F.lit("x"))
    for kept in (near_dedup.one_of_each(rows, 3, 85), mixing.mixed_documents(rows)):
        assert kept.columns == rows.columns
        assert {(row["_bit"], row["BIT"], row["_copies"]) for row in kept.collect()} == {(7, "x", 0)}


def test_hashed_words_are_not_kept():
    tracemalloc.start()
    try:
        for text in range(100):
            words = [b"%d-%d" % (text, word) for word in range(500)] * 2
            found = near_dedup.shingle_set(b" ".join(words), 3)
            assert len(found) == 500 and (found[1:] > found[:-1]).all()
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()


def test_large_tables_go_when_they_are_used(spark, monkeypatch):
    paths = {}

    def noted(spark, name):
        paths.setdefault(name, []).append(work_folder(spark, name))
        return paths[name][-1]

    monkeypatch.setattr(near_dedup, "work_folder", noted)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 50 + k % 8], f"x{k}"])) for k in range(40)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == brute_groups(rows, 5, 80)
    gone = [path for name in ("dedup-signed", "dedup-same", "dedup-sets") for path in paths[name]]
    gone += paths["dedup-starts"][:-1]
    assert all(spark.read.parquet(path).columns == ["gone"] for path in gone)
