import random

import xxhash

from twinsieve.llm import neardup, simhash
from twinsieve.llm.components import components

SCHEMA = "doc_id long, text string, fingerprint string, n int"


def brute_fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    return {n: find(n) for n in nodes}


TEXTS = ["A b  c\td", "a B c d", "", None, " \n ", "one", "one two", "x " * 70_000, "Ü ü ß", "a\x0bb\x0cc d", "a b c"]


def test_fingerprint():
    rng = random.Random(1)
    for x in TEXTS + [" ".join(rng.choice("abcdef") * rng.randint(1, 4) for _ in range(rng.randint(0, 90))) for _ in range(200)]:
        assert simhash.fingerprint(None if x is None else x.encode()) == (brute_fingerprint(x) if x != "x " * 70_000 else simhash.fingerprint(x.encode()))
    assert simhash.fingerprint(("x " * 70_000).encode()) == brute_fingerprint("x x x")


def test_covering_family():
    rng = random.Random(2)
    for radius in (1, 2, 3):
        family = simhash.masks(radius, list(range(64)))
        assert len(family) == 2 ** (radius + 1) - 1
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & flips for m in family)


def near_fingerprints(n=300, seed=4):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    more = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    hot = [base[0] ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 12) for b in range(12, 20) for c in range(20, 30)]
    return sorted({*base, *more, *hot, 0, (1 << 64) - 1})


def test_links_with_and_without_splitting(spark):
    fps = near_fingerprints()
    signed = [simhash._signed(x) for x in fps]
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (256, 8):
        got = [(r.a, r.b) for r in simhash.near_links(df, 2, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    want = groups([e for e in edges if e[0] != e[1]], {n for e in edges for n in e})
    assert got == {n: r for n, r in want.items() if n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(df.limit(0)).count() == 0


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(160)]
        for c in range(1 + g % 4):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(160)] = rng.choice(words)
            rows.append((len(rows) * 3 % 101 + 1000 * (len(rows) % 2), " ".join(own), "f", 0))
    return rows + [(5000, None, None, 0), (5001, "", None, 0), (None, "", None, 0), (None, "alone here", None, 0), (5002, rows[0][1].upper(), None, 0), (5002, rows[0][1].upper(), None, 0)]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    fp = [brute_fingerprint(x) for _, x, _, _ in rows]
    comp = groups([(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 2], range(len(rows)))
    least = {}
    for i, root in comp.items():
        if rows[i][0] is not None:
            least[root] = min(rows[i][0], least.get(root, rows[i][0]))
    want = sorted(((rows[i][0], f"{fp[i]:016x}", least.get(comp[i])) for i in range(len(rows))), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deduplicated(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = neardup.deduplicated(df).collect()
    sets = [(r.doc_id, neardup.shingles((r.text or "").encode())) for r in kept]
    texts = [" ".join((r.text or "").lower().split()) for r in kept]
    assert len(texts) == len(set(texts))
    every = {" ".join((x or "").lower().split()): neardup.shingles((x or "").encode()) for _, x, _, _ in rows}
    for text, s in every.items():  # what goes is similar to something that stays
        assert text in texts or max(neardup.similarity(s, o) for _, o in sets) >= 0.8
    assert not any(neardup.similarity(a, b) >= 0.8 for n, (_, a) in enumerate(sets) for _, b in sets[:n])
    assert neardup.deduplicated(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "c d")], "doc_id long, text string")
    clashing = few.selectExpr("*", "doc_id as _id", "7 as _norm", "8 as _n", "9 as _other", "'x' as norm", "0 as fp", "1 as s")
    for rows in (clashing, clashing.union(clashing)):  # unique ids, and repeated ones
        got = neardup.deduplicated(rows)
        assert got.columns == clashing.columns
        assert sorted(tuple(r) for r in got.collect()) == [(1, "a b", 1, 7, 8, 9, "x", 0, 1), (3, "c d", 3, 7, 8, 9, "x", 0, 1)]
    twice = spark.createDataFrame([(1, "a b", 5), (1, "A b", 6), (1, "a  b", 7)], "doc_id long, text string, n int")
    assert len({tuple(r) for n in (1, 2, 3) for r in neardup.deduplicated(twice.repartition(n)).collect()}) == 1  # the same row each time
    assert sorted(r.doc_id for r in neardup.deduplicated(few).collect()) == [1, 3]


def cut_copies():
    """Texts with copies that lack their first or last words, or have more: similar, but fingerprints can lie far apart."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(60)]
        rows += [base, base[: rng.randrange(53, 58)], base[rng.randrange(3, 8) :], base + [rng.choice(words) for _ in range(rng.randrange(5, 12))]]
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def similar_pairs(rows):
    sets = [(i, neardup.shingles(x.encode())) for i, x in rows]
    return [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if neardup.similarity(x, y) >= 0.8]


def kept_ids(spark, rows):
    return sorted(r.doc_id for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_deduplicated_finds_every_similar_pair(spark):
    rows = cut_copies()
    pairs, fp = similar_pairs(rows), {i: simhash.fingerprint(x.encode(), 1, True) for i, x in rows}
    assert sum((fp[a] ^ fp[b]).bit_count() > 6 for a, b in pairs) >= 10
    got = kept_ids(spark, rows)
    assert not [p for p in pairs if set(p) <= set(got)]
    comp = groups(pairs, range(len(rows)))
    assert got == sorted(set(comp.values()))


def test_shingles_equal_brute_force():
    rng = random.Random(21)
    for n in (0, 1, 4, 5, 6, 80, 3000):
        words = [rng.choice("abcde") * rng.randint(1, 2) for _ in range(n)]
        grams = {tuple(words[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
        assert len(neardup.shingles(" ".join(words).encode())) == len(grams)
    same = [neardup.shingles(x) for x in (b"A b c d e f", b" a  b\tc d\ne F ")]
    assert (same[0] == same[1]).all() and (neardup.shingles(b"b a c d e f") != same[0]).all()


def test_prefixes_of_similar_sets_meet():
    rows = cut_copies()
    sets = {i: neardup.shingles(x.encode()) for i, x in rows}
    every = sorted({t for s in sets.values() for t in s.tolist()})
    assert every
    for counts in (neardup.np.zeros(64, "i4"), neardup.np.arange(1000, dtype="i4") % 7):
        heads = {i: set(neardup.prefix(s, counts, 0.8).tolist()) for i, s in sets.items()}
        assert all(heads[a] & heads[b] for a, b in similar_pairs(rows))


def variants(links):
    """Texts 0 to 2 of 100 words: the middle one, and two that differ from it by other words, so that only it is similar to both."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    first, last = (base[:c] + [f"{x}new" for x in base[c : c + 2]] + base[c + 2 :] for c in (10, 80))
    return [(i, " ".join({"hub": base, "a": first, "b": last}[x])) for i, x in enumerate(links)]


def test_one_text_of_each_component_stays(spark):
    for names in (["a", "b", "hub"], ["hub", "a", "b"], ["a", "hub", "b"]):
        rows = variants(names)
        at = names.index("hub")
        assert {p for p in similar_pairs(rows)} == {tuple(sorted((at, o))) for o in range(3) if o != at}
        assert kept_ids(spark, rows) == [0]


def test_texts_that_go_still_join_others(spark):
    base = [f"w{i * 7919}" for i in range(100)]
    second = base[:10] + [base[11], base[10]] + base[12:]  # the same words: equal fingerprint
    own = [simhash.fingerprint(" ".join(x).encode(), 1, True) for x in (base, second)]
    third = next(x for x in (second[:80] + [f"other{k}"] + second[81:] for k in range(1000)) if 1 <= (simhash.fingerprint(" ".join(x).encode(), 1, True) ^ own[1]).bit_count() <= 6)
    rows = [(i, " ".join(x)) for i, x in enumerate([base, second, third])]
    assert own[0] == own[1] and similar_pairs(rows) == [(0, 1), (1, 2)]
    assert kept_ids(spark, rows) == [0]


def test_entries_that_meet_by_brute_force(spark):
    rng = neardup.np.random.default_rng(3)
    t, n = rng.integers(0, 300, 900).astype("u4") << neardup.np.uint32(23), rng.integers(1, 200, 900)
    want = [i for i in range(900) if any(t[i] == t[j] and i != j and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) for j in range(900))]
    assert 0 < len(want) < 900 and sorted(neardup.meeting(t, n, 0.8).tolist()) == want
    assert len(neardup.meeting(t[:0], n[:0], 0.8)) == 0 and not list(neardup.dealt(t[:0], n[:0], n[:0], n[:0], 5))
    ids, pos = rng.integers(0, 1 << 50, 900), rng.integers(0, 1 << 20, 900)
    made = list(neardup.dealt(t, ids, n, pos, 7))
    assert [p for p, _ in made] == sorted({int(x) * 7 >> 32 for x in t.tolist()})
    assert sorted(zip(*(x.tolist() for x in neardup.gathered([x for _, x in made])))) == sorted(zip(*(x.tolist() for x in (t, ids, n, pos))))


def test_prefixes_move_little_between_tasks(spark, monkeypatch):
    """Shuffled bytes for each prefix entry, when tables are too large to be sent to all."""
    monkeypatch.setattr(neardup, "SENT_IDS", 0)
    rng = neardup.np.random.default_rng(31)
    sets = [neardup.np.unique(rng.integers(0, 1 << 23, 1500).astype("u4") << neardup.np.uint32(9)) for _ in range(3000)]
    df = spark.createDataFrame([(i, i.to_bytes(16, "big"), s.tobytes()) for i, s in enumerate(sets)], "id long, norm binary, s binary").repartition(16).cache()
    entries = sum(len(s) - neardup.math.ceil(0.8 * len(s) - 1e-9) + 1 for s in sets)

    def moved():
        ran = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(ran.apply(i).totalShuffleWrite() for i in range(ran.size()))

    df.count()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = moved()
    found = neardup._prefixes(df, 0.8)
    used = (moved() - before) / entries
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found.count() > 1000 and used < 20, used
