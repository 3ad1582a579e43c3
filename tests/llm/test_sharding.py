import random
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

from quarry.llm import queries, sharding


def table(spark, path, n=3000):
    random.seed(9)
    rows = [(i, f"text {i}") for i in range(n)]
    rows += [(n + i, "hot") for i in range(n // 2)]
    rows += [(2 * n + i, f"copy {i % 150}") for i in range(600)]
    rows += [(7, "repeated"), (7, "repeated"), (None, None), (9001, None), (9002, ""), (9003, "é" * 50_000)]
    random.shuffle(rows)
    spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, shard string, size int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return rows


def test_counts_slots_and_groups(spark, tmp_path):
    rows = table(spark, tmp_path)
    found = queries.op1_balanced_shards(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == sorted(((i, size(t), crc(t)) for i, t in rows), key=str)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(40)]
    assert set(by) == set(range(40)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    places = defaultdict(Counter)
    for r in found:
        places[r.text_crc32][r.shard] += 1
    small = [places[zlib.crc32(f"copy {i}".encode())] for i in range(150)]
    assert sum(len(p) == 1 for p in small) >= 140  # copies stand together
    hot = places[zlib.crc32(b"hot")]
    assert len(hot) < 40 and sum(sorted(hot.values())[-26:]) > 0.8 * 1500


def test_links_of_any_kind_pull_together(spark):
    links = [(i * 10 + j, i * 10 + j - 1) for i in range(60) for j in range(1, 10)]  # paths of ten
    df = spark.createDataFrame(links, "a long, b long")
    state = sharding.propagated(df, 4, 160, rounds=12)
    placed = {r.uid: r.shard for r in state.collect()}
    assert max(Counter(placed.values()).values()) <= 170 and len(placed) == 600
    cut = sum(placed[a] != placed[b] for a, b in links)
    assert cut < 0.4 * len(links)  # a hash leaves three quarters cut
    assert sharding.cut_links(df, state).first().cut == cut


def test_few_rows_and_none(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_balanced_shards(spark, str(tmp_path)).collect()
    assert len(found) == 3 and len({r.shard for r in found}) == 3 and {r.slot for r in found} == {0}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op1_balanced_shards(spark, f"{tmp_path}/e").count() == 0


def test_a_table_of_copies_stays_together(spark, tmp_path):
    rows = [(i, f"copy {i * 7919 % 4000 // 10}") for i in range(4000)]  # all rows in groups of ten, 40 shards of 100
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    places = defaultdict(set)
    for r in queries.op1_balanced_shards(spark, str(tmp_path)).collect():
        places[r.text_crc32].add(r.shard)
    assert len(places) == 400 and sum(len(p) == 1 for p in places.values()) >= 390


def test_departures_make_room():
    full = [10, 10, 10, 5]
    asked = {(0, 1): 4, (1, 2): 3, (2, 0): 6, (0, 3): 2, (1, 3): 9}
    made = sharding.admitted(asked, full, 10)
    after = [n + sum(m for (_, t), m in made.items() if t == s) - sum(m for (f, _), m in made.items() if f == s) for s, n in enumerate(full)]
    assert max(after) <= 10 and sum(made.values()) >= 12 and all(made[k] <= n for k, n in asked.items())


def test_groups_are_packed_whole_where_they_fit():
    found, room = sharding.packed([(1, 250), (2, 60), (3, 50), (4, 40), (5, 50)], 5, 100)
    by = defaultdict(set)
    for g, a, b, s in found:
        by[g].add(s)
    assert {g: len(s) for g, s in by.items()} == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1} and sum(room) == 50
    assert sharding.packed([(1, 30), (2, 20)], 3, 100, [25, -5, 40]) == ([(1, 0, 30, 2), (2, 0, 20, 0)], [5, 0, 10])


def test_rounds_gather_what_a_hash_has_scattered(spark, tmp_path):
    rows = [(i, f"copy {i * 7919 % 6000 // 12}") for i in range(6000)] + [(10_000 + i, f"own {i}") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    report = []
    found = sharding.assign(spark.read.parquet(f"{tmp_path}/documents.parquet"), report=report).collect()
    (_, before), *later = report
    assert before > 0.9 * 5500  # 39 of 40 links, by the scattering
    assert later[0][0] > 0.6 * 5500 and sum(m for m, _ in later) > 0.8 * 5500  # joins and quotas make the moves
    assert later[-1][1] < 0.15 * 5500
    places = defaultdict(set)
    for r in found:
        places[r.text_crc32].add(r.shard)
    assert sum(len(p) == 1 for p in places.values()) >= 2500 - 10


def test_the_start_is_even_and_the_repair_leaves_whole_groups(spark):
    near = [(u, u // 8 * 8) for u in range(800)]
    start = {r.uid: r.shard for r in sharding._started(spark.createDataFrame(near, "uid long, near long"), 4, 250).collect()}
    order = sorted(range(800), key=lambda u: hashed((u, "<q")) % 2**64)
    assert start == {u: i * 1000 // 800 // 250 for i, u in enumerate(order)}
    state = [(u, 0 if n < 400 else u % 4, n) for u, n in near]
    found = {r.uid: r.shard for r in sharding.repaired(spark.createDataFrame(state, "uid long, shard int, near long"), 4, 420).collect()}
    assert len(found) == 800 and all(found[u] == 0 for u, n in near if n < 400)
    assert all(len({found[u] for u in range(n, n + 8)}) == 1 for n in range(0, 800, 8)) and max(Counter(found.values()).values()) <= 420


def test_groups_over_a_quarter_of_a_shard_stand_together(spark):
    keys = [f"own {i}" for i in range(1100)] + [f"large {g}" for g in range(10) for _ in range(60)] + ["hot"] * 300  # 20 shards of 100
    random.seed(3)
    random.shuffle(keys)
    nodes = spark.createDataFrame(list(enumerate(keys)), "uid long, key string").repartition(3)
    state = sharding.propagated(sharding.equal_text_links(nodes, "key", 25), 20, 100)
    placed = sharding.balanced(nodes.drop("key"), state, 20, 2000, ["uid"])
    spread = {r.key: (r.rows, r.shards, r.cut) for r in sharding.group_spread(nodes, placed).collect()}
    assert spread == {"hot": (300, 3, 200)} | {f"large {g}": (60, 1, 0) for g in range(10)}


def hashed(*values):
    """Spark's xxhash64 over longs and ints, unsigned."""
    h = 42
    for v, kind in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return h


def simulated(links, start, shards, capacity, rounds):
    """The rounds of propagation in plain Python; start: uid to (shard, near)."""
    state = {u: s for u, (s, _) in start.items()}
    near = {u: n for u, (_, n) in start.items()}
    still = 0
    for i in range(rounds):
        ways = [(a, b) for a, b in links] if i == 0 else [(b, a) for a, b in links] if i == 1 else [(a, b) for a, b in [*links, *((y, x) for x, y in links)] if hashed((a, "<q"), (i, "<i")) % 2 ** 64 % 2 == 0]
        votes = defaultdict(Counter)
        for u, by in ways:
            votes[u][state[by]] += 1
        asked = []
        for u, v in votes.items():
            best = max(v, key=lambda s: (v[s], -s))
            if v[best] > v[state[u]]:
                asked.append((state[u], best, v[best] - v[state[u]], u))
        pairs = Counter((s, t) for s, t, _, _ in asked)
        full = Counter(state.values())
        made = sharding.admitted(dict(pairs), [full[s] for s in range(shards)], capacity) if pairs else {}
        for (s, t), n in made.items():
            own = sorted((x for x in asked if x[:2] == (s, t)), key=lambda x: (-x[2], hashed((near[x[3]], "<q")), near[x[3]], x[3]))
            for x in own[:n]:
                state[x[3]] = t
        still = still + 1 if sum(made.values()) <= 0 else 0
        if still == 2:
            break
    return state


def test_propagation_equals_a_plain_simulation(spark):
    random.seed(21)
    links = sorted({(max(p), min(p)) for _ in range(900) for p in [random.sample(range(400), 2)]})
    df = spark.createDataFrame(links, "a long, b long")
    near = defaultdict(lambda: 10**9)
    for a, b in links:
        near[a], near[b] = min(near[a], b, a), min(near[b], a, b)
    start = sharding._started(spark.createDataFrame(sorted(near.items()), "uid long, near long"), 5, 90)
    start = {r.uid: (r.shard, r.near) for r in start.collect()}
    want = simulated(links, start, 5, 90, 6)
    for buckets in (1, 8):
        assert {r.uid: r.shard for r in sharding.propagated(df, 5, 90, rounds=6, buckets=buckets).collect()} == want


def test_shards_do_not_depend_on_files(spark, tmp_path):
    rows = table(spark, tmp_path)
    spark.createDataFrame([(*r, "x", 0) for r in reversed(rows)], "doc_id long, text string, shard string, size int").repartition(2).write.parquet(f"{tmp_path}/other/documents.parquet")
    one, other = ([tuple(r) for r in queries.op1_balanced_shards(spark, p).collect()] for p in (str(tmp_path), f"{tmp_path}/other"))
    assert sorted(one, key=str) == sorted(other, key=str)
