import itertools
import random

import pytest
import xxhash
from data_llm import odd_rows

from foliomill.llm import components as comps
from foliomill.llm import simhash
from foliomill.llm.components import labels


def plain_fingerprint(text):
    words = []
    for c in (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).replace(b"\t", b" ").replace(b"\n", b" ").split(b" "):
        if c:
            words.append(c)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_fingerprints_and_components(spark, odd):
    rows = odd_rows()
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = components(set(fps))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    want = sorted(((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps, strict=True)), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == want


def test_empty(spark, empty):
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_is_near(spark, bits):
    """Random fingerprints, chains, and hundreds within a few bits of one, which makes variants with many members."""
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    for _ in range(600):
        f = centre
        for _ in range(rng.randrange(4)):
            f ^= 1 << rng.choice([*range(12), *range(40, 52)])
        fps.add(f)
    chain = rng.getrandbits(64)
    for i in range(40):
        chain ^= 1 << i
        fps.add(chain)
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    found = labels(simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), bits)).collect()
    got = {r.v: r.label for r in found}
    want = components(fps, bits)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(got.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_link_is_near(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(62)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(4))) for _ in range(400)}
    for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect():
        assert (r.a ^ r.b).bit_count() <= 2


def test_max_bits_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    odd = [(5000, 5000), (None, 3), (0, 1), (0, 1)]
    got = {r.v: r.label for r in labels(spark.createDataFrame([*chain, *star, *odd], "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1
    assert len({got[1000 + i] for i in range(80)}) == 1
    assert got[0] != got[1000] and 5000 not in got
    assert labels(spark.createDataFrame([], "a long, b long")).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_plans(monkeypatch, module):
    """Plans of the tables that ``module`` stores from now on, by name."""
    plans, store = {}, module.written

    def written(df, name):
        plans[name] = plan(df)
        return store(df, name)

    monkeypatch.setattr(module, "written", written)
    return plans


def test_no_table_of_fingerprints_is_broadcast(spark, monkeypatch):
    """Spark takes the exploded variants for as small as the fingerprints, so at these sizes it would broadcast them."""
    monkeypatch.setattr(comps, "MAX_BROADCAST_ROWS", 0, raising=False)
    rng = random.Random(4)
    base = [f"w{rng.randrange(50)}" for _ in range(60)]
    texts = [" ".join([*base, *(["end"] * (i % 3))]) for i in range(30)] + [f"a{i} b{i} c{i} d{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans = stored_plans(monkeypatch, simhash)
    results = [simhash.near_duplicates(docs), simhash.without_near_duplicates(docs), simhash.links(simhash.fingerprints(docs).select("fp").distinct())]
    assert all("SortMergeJoin" in plans[name] for name in ("variants", "labelled"))
    for made in [*plans.values(), *map(plan, results)]:
        assert "Broadcast" not in made
    fps = [plain_fingerprint(t) for t in texts]
    assert results[1].count() == len(set(components(set(fps)).values()))


@pytest.mark.parametrize("most", [0, 10, 20_000])
def test_only_few_adopted_vertices_are_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(comps, "MAX_BROADCAST_ROWS", most)
    plans = stored_plans(monkeypatch, comps)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {r.v: r.label for r in labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(80)}) == 1
    assert len(got) == 141 and got[0] != got[1000]
    assert ("Broadcast" in "".join(plans.values())) == (most > 0)
