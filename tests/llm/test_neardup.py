import random
import re

from lodestrata.llm import neardup
from lodestrata.llm.graph import components


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randint(0, 400)}" for _ in range(n)]


def edited(base, seed, share):
    r = random.Random(seed)
    return [f"e{r.randint(0, 999)}" if r.random() < share else w for w in base]


def brute(rows, similarity=0.6):
    sets = {}
    for i, _, content in rows:
        w = re.findall("[a-z0-9_]+", (content or "").lower())
        sets.setdefault(i, set()).update(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12:
                up[root(a)] = root(b)
    return {(a, b) for a in ids for b in ids if a < b and root(a) == root(b)}


def found(chunks, rows):
    return {tuple(r) for r in neardup.pairs_of(neardup.near_duplicate_groups(chunks(rows), bits=12)).collect()}


def test_against_brute_force(chunks):
    rows, k = [], 0
    for family in range(12):
        base = words(family, random.Random(family).randint(4, 60))
        for copy in range(random.Random(family + 50).randint(1, 12)):
            rows.append((f"c{k:03}", "f", " ".join(edited(base, k, 0.03 * (copy % 4)))))
            k += 1
    rows += [("n", "f", None), ("e", "f", ""), ("two", "f", "a b"), ("two2", "f", "a b"), rows[0], ("copy", "f", rows[5][2].upper())]
    want = brute(rows)
    assert len(want) > 20 and found(chunks, rows) == want


def test_long_lists_keep_links_across_components(chunks):
    # all share rare runs, so that every list is long, but only neighbours in the chain are similar
    common = words(1, 30)
    rows = [(f"x{i:02}", "f", " ".join(common + words(100 + i // 2, 22) + words(500 + i, 4))) for i in range(70)]
    assert found(chunks, rows) == brute(rows)


def test_subsets_of_a_frequent_pool(chunks):
    """Every run is in a long list, so that only the guaranteed minimum of frequent entries tells pairs apart."""
    pool = [" ".join(words(k, 9)) for k in range(16)]
    rows = []
    for i in range(120):
        r = random.Random(i)
        size = r.choice([3, 6, 10, 14])
        rows.append((f"s{i:03}", "f", " . ".join(pool[k] for k in sorted(r.sample(range(16), size)))))
    rows += [(f"b{i}", "f", " ".join(words(99, 40) + words(1000 + i, r))) for i, r in enumerate([10, 20, 25, 30, 60] * 12)]
    want = brute(rows)
    assert len(want) > 100 and found(chunks, rows) == want


def test_shared_boilerplate_makes_no_pairs(chunks):
    """Chunks of four runs that share two, so are not similar (1 / 3), become no candidates, whatever their number."""
    for n in (400, 1600):
        rows = [(f"d{i:05}", "f", f"alpha beta gamma delta own{i} end{i}") for i in range(n)]
        vectors = neardup._vectors(chunks(rows), 3)
        lists = neardup._lists(vectors, neardup._frequencies(vectors, 18), 18, 0.6)
        assert lists.where("kind = 1 or tally >= 2").count() <= n // 100


def test_empty_table(chunks):
    assert found(chunks, []) == set()
    assert found(chunks, [("a", "f", None)]) == set()


def test_copies_and_ids(chunks):
    rows = [("a", "f", "one two three four"), ("b", "f", "ONE two, three four"), ("a", "f", "five six seven eight"), ("c", "f", "five six seven eight")]
    assert found(chunks, rows) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert set(got.values()) == {0, 100} and got[60] == 0 and got[139] == 100 and len(got) == 101
