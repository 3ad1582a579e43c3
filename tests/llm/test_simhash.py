import random
import re

import numpy as np
import xxhash

from quarry.llm import queries, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(prints):
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ps = list(up)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    return {p: root(p) for p in ps}


def test_query_matches_brute_force(spark, tmp_path):
    random.seed(3)
    vocabulary = [f"w{i}É" for i in range(300)]
    base = [" ".join(random.choices(vocabulary, k=random.randint(0, 400))) for _ in range(40)]
    texts = [None, "", " \t", "a", "A b", "a b c", *base]
    for t in base[:20]:
        for _ in range(8):
            w = t.split()
            for _ in range(random.randint(0, 2)):
                if w:
                    w[random.randrange(len(w))] = random.choice(vocabulary)
            texts.append("\n".join(w))
    texts += [base[0]] * 30 + [" ".join(vocabulary * 700)]
    ids = list(range(len(texts)))
    random.shuffle(ids)
    spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string, anchor int").write.parquet(f"{tmp_path}/documents.parquet")
    prints = {i: brute_print(t) for i, t in zip(ids, texts)}
    root = brute_components(set(prints.values()))
    first = {}
    for i, p in prints.items():
        first[root[p]] = min(i, first.get(root[p], i))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, f"{p:016x}", first[root[p]]) for i, p in prints.items()}


def test_large_groups_are_dealt_in_blocks(spark):
    random.seed(5)
    centre = random.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 4))) for _ in range(300)} | {random.getrandbits(64) for _ in range(200)}
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    want = brute_components(prints)
    for block in (8, 8192):
        found = {r.node: r.root for r in simhash.components(simhash.links(classes, block=block)).collect()}
        found = {p % 2**64: found.get(p, p) for p in signed}
        assert len(set(found.values())) == len(set(want.values()))
        assert len({(found[p], want[p]) for p in prints}) == len(set(want.values()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op9_simhash_near_dedup(spark, str(tmp_path)).count() == 0


def jaccard5(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_are_found_and_others_left_alone(spark):
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(2000)]
    base = [random.choices(vocabulary, k=random.randint(120, 400)) for _ in range(120)]
    texts, planted = [" ".join(w) for w in base], []
    for n, w in enumerate(base):
        w = list(w)
        for _ in range(max(1, len(w) // 60) if n < 80 else len(w) // 8):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        planted.append((n, len(texts)))
        texts.append(" ".join(w))
    hub = random.choices(vocabulary, k=300)
    first = len(texts)
    for i in range(700):  # a large group of near copies, more than one block of comparisons
        w = list(hub)
        w[i % 300] = f"x{i}"
        texts.append(" ".join(w))
    texts += ["", None, "one two", "ONE  two", texts[0].upper()]
    rows = list(enumerate(texts))
    found = {r.id: r.group for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", block=128).collect()}
    close = [(a, b) for a, b in planted if jaccard5(texts[a], texts[b]) >= 0.8]
    assert len(close) > 60 and sum(found[a] == found[b] for a, b in close) >= 0.95 * len(close)
    assert all(found[b] == b for a, b in planted if jaccard5(texts[a], texts[b]) < 0.8)
    assert {found[first + i] for i in range(700)} == {first}
    n = len(texts)
    assert found[n - 1] == 0 and found[n - 2] == found[n - 3] == n - 3 and found[n - 4] == found[n - 5] == n - 5
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0


def whole_components(texts, least=0.8):
    """Component of each text under links of similarity `least`, all pairs compared."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= least * (len(a) + len(sets[j]) - shared):
                links.append((j, i))
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], links


def copies_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.id: r.group for r in simhash.near_copies(docs, "doc_id", **options).collect()}
    return [found[i] for i in range(len(texts))]


def test_repeated_filler_makes_no_copies(spark):
    random.seed(21)
    words = iter(random.sample(range(10**6), 3000))
    texts = ["| " * 130 + " ".join(f"u{next(words)}" for _ in range(100)) for _ in range(12)]
    texts += ["spam " * 4, "spam " * 50, " ".join(f"u{next(words)} | | | | |" for _ in range(60)), " ".join(f"u{next(words)} | | | | |" for _ in range(60))]
    assert copies_of(spark, texts) == whole_components(texts)[0] == list(range(len(texts)))


def test_families_at_the_border_are_joined_by_confirmed_links_alone(spark):
    random.seed(22)
    texts = []
    for _ in range(12):
        base = random.choices([f"v{i}" for i in range(3000)], k=200)
        for _ in range(30):
            w, n = list(base), random.randint(5, 40)
            at = random.randrange(len(w) - n)
            w[at : at + n] = random.choices([f"y{i}" for i in range(3000)], k=n)
            texts.append(" ".join(w))
    want, _ = whole_components(texts)
    for block in (16, 8192):
        got = copies_of(spark, texts, block=block)
        assert all(want[a] == want[b] for b, a in enumerate(got)), "groups hold confirmed links alone"
        assert len(set(got)) <= len(set(want)) + 0.03 * len(texts)


def test_recall_by_kind_of_change_and_similarity(spark):
    random.seed(23)
    fresh = lambda n: [f"z{random.randrange(10**7)}" for _ in range(n)]
    texts, kinds = [], {}
    for n in range(1200):
        w, kind = fresh(random.randint(80, 300)), ("stretch", "appended", "prepended", "scattered")[n % 4]
        some = int(len(w) * random.uniform(0.01, 0.12 if kind == "stretch" else 0.24))
        if kind == "stretch":
            at = random.randrange(len(w) - some)
            other = w[:at] + fresh(some) + w[at + some :]
        elif kind == "scattered":
            other = list(w)
            for at in random.sample(range(len(w)), max(1, some // 10)):
                other[at] = fresh(1)[0]
        else:
            other = w + fresh(some) if kind == "appended" else fresh(some) + w
        texts += [" ".join(w), " ".join(other)]
        alike = jaccard5(*texts[-2:])
        kinds.setdefault((kind, "0.8" if alike < 0.85 else "0.85" if alike < 0.9 else "0.9") if alike >= 0.8 else None, []).append(2 * n)
    got = copies_of(spark, texts)
    share = {k: (sum(got[i] == got[i + 1] for i in at) / len(at), len(at)) for k, at in kinds.items()}
    print(share)
    assert share.pop(None, (0, 0))[0] == 0, "what is less alike stays apart"
    assert all(s >= 0.9 for s, _ in share.values()) and len(share) == 12


def test_a_large_group_costs_about_as_many_comparisons_as_it_has_members(spark, monkeypatch):
    random.seed(24)
    hub = random.choices([f"v{i}" for i in range(3000)], k=200)
    texts = []
    for i in range(600):
        w = list(hub)
        for at in random.sample(range(200), 2):
            w[at] = f"x{i}_{at}"
        texts.append(" ".join(w))
    made, stored = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, *a: made.append((name, stored(df, name, *a))) or made[-1][1])
    looked = []
    monkeypatch.setattr(simhash, "components", lambda edges, of=simhash.components: looked.append(sum(df.count() for name, df in made if name == "copies-checked")) or of(edges))
    assert set(copies_of(spark, texts)) == {0}
    assert looked[-1] < 3 * len(texts)
