import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from planaudit.llm import hard_negatives, language_id, mixing, prefix_trie, simhash

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(500)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


# conversation prefix trie


def by_hand(sequences):
    """Nodes of (role, text) sequences by conv_id."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, held in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.add((held[0], len(p), members[p[:-1]][0] if p else None, len(held), children[p], sum(not children[q] for q in below), saved, digest))
    return out


def rebuilt_by_hand(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, ())[:h] + turns[h:]
    return out


def talks():
    """Conversations with shared openings, copies, one that begins another, long ones, ties, nulls."""
    opening = [("system", "be kind"), ("user", "one two"), ("assistant", "three"), ("user", "four five six")]
    rows = [(c, t, *opening[t]) for c in range(30) for t in range(c % 5)] + [(c, t, "user", f"say {t // 40} {c % 3}") for c in range(40, 46) for t in range(90)]
    rows += [(50 + c, 0, "user", "alone") for c in range(60)] + [(130, 1, None, "b"), (130, None, "user", None), (131, 5, "user", "late"), (131, -1, "user", "early"), (132, 0, "b", "x"), (132, 0, "a", "x")]
    return rows + [(None, 0, "user", "no conversation"), (133, 0, "user", "same"), (133, 0, "user", "same")]


def sequences_of(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: tuple((r, x) for _, _, r, x in sorted(turns)) for c, turns in own.items()}


TURNS = "conv_id long, turn long, role string, text string, depth string, k1 int, turns string"


@pytest.mark.parametrize("batches", [(1, 4, 16), (16,), (5, 6, 7, 8, 16)])
def test_trie_agrees_with_brute_force(spark, batches):
    rows = talks()
    turns = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], TURNS).repartition(3)
    plain = prefix_trie.sequences(turns)
    assert {tuple(r) for r in prefix_trie.prefix_nodes(plain, batches).collect()} == by_hand(sequences_of(rows))
    again = prefix_trie.prefix_nodes(prefix_trie.reopened(plain), batches).collect()
    assert {tuple(r) for r in again} == by_hand(rebuilt_by_hand(sequences_of(rows))) and len(again) == len(set(map(tuple, again)))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_nodes(prefix_trie.reopened(prefix_trie.sequences(empty))).count() == 0
    # conversation 7 has no base and fewer turns than it leaves out
    assert zlib.crc32(b"7") % 4 > 0
    only = spark.createDataFrame([(7, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_nodes(prefix_trie.reopened(prefix_trie.sequences(only))).collect()
    assert [tuple(r) for r in got] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


# SimHash


def fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """Smallest index reachable over pairs within two bits."""
    u = np.array(values, np.uint64)
    seen, out = np.zeros(len(u), bool), np.zeros(len(u), int)
    for i in range(len(u)):
        if not seen[i]:
            front = seen[i : i + 1] = True
            front, group = [i], []
            while front:
                j = front.pop()
                group.append(j)
                near = np.flatnonzero((np.bitwise_count(u ^ u[j]) <= 2) & ~seen)
                seen[near] = True
                front += near.tolist()
            out[group] = min(group)
    return out.tolist()


@pytest.mark.parametrize("crowded", [2, 128])
def test_simhash_agrees_with_brute_force(spark, crowded):
    base = sentence(900).split()
    texts = [None, "", " \n", "one", "One", "two words", "ÄÖ  ü x\tY", sentence(20_000), "x " * 500]
    for i in range(120):
        copy = list(base)
        copy[RNG.randrange(len(copy))] = f"n{i}"
        texts.append(" ".join(copy))
    texts += [sentence(RNG.randint(1, 60)) for _ in range(150)] + [texts[7], texts[20]]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, crowded=crowded).collect()}
    want = [fingerprint(t) for t in texts]
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in enumerate(want)}
    assert [got[i][1] for i in range(len(texts))] == classes(want)
    assert len({c for _, c in got.values()}) < len(texts) - 100


@pytest.mark.parametrize(("parts", "crowded"), [((2,), 128), ((3,), 128), ((4,), 128), ((2, 3, 4), 3)])
def test_links_of_any_parts_join_all_pairs_within_two_bits(spark, parts, crowded):
    rng = np.random.default_rng(5)
    # two bits that go together, two that rarely change, families, and what is alone
    seeds = rng.integers(0, 1 << 62, 60, dtype=np.uint64) & ~np.uint64(0xFF00)
    members = [int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for s in seeds for _ in range(12)]
    values = sorted(set(members))
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    leader = {v: v for v in values}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for r in simhash.links(table, crowded, parts).collect():
        a, b = (int(np.int64(x).view(np.uint64)) for x in r)
        assert (a ^ b).bit_count() <= (2 if parts else 0)
        leader[find(a)] = find(b)
    want = classes(values)
    assert {frozenset(v for v in values if find(v) == f) for f in map(find, values)} == {frozenset(v for v, c in zip(values, want, strict=True) if c == g) for g in want}


def test_thresholds_are_unequal_and_always_suffice():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    values[:2000] &= np.uint64(0xFFFFFFFFFFE00000)  # 21 bits that half of them share
    bits = simhash.unpacked(values).astype(np.int64)
    groups = simhash.parted(bits.T @ bits, len(values), 3)
    assert sorted(np.concatenate(groups).tolist()) == list(range(64)) and [len(g) for g in groups] == [21, 21, 22]
    hists = [np.bincount(simhash.picked(values, b).astype(np.int64), minlength=256) for g in groups for b in simhash._blocks(g)]
    units, cost = simhash.Plan(groups, hists, len(values)).allocate(values)
    assert (units.sum(axis=1) == 3).all() and (cost > 0).all()
    assert len(np.unique(units, axis=0)) > 1


def test_simhash_of_ids_that_are_null_or_repeated_and_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "x y z w"), (2, "A  b\nc")], "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    a, b = f"{fingerprint('a b c'):016x}", f"{fingerprint('x y z w'):016x}"
    assert got == sorted([(None, a, 2), (5, a, 2), (5, b, 5), (2, a, 2)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# hard negatives


def mined(rows, every, positives, k):
    """By hand, from (id, vector, label)."""
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v):
            whole = (label, [int(np.floor(256 * x)) for x in v])
            kept[i] = min(kept.get(i, whole), whole)
    out = set()
    for a, (label, v) in kept.items():
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in kept.items() if i != a)
            for s, p, _ in [x for x in scored if x[2] == label][:positives]:
                good = [(-n, i) for n, i, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s]
                out |= {(a, p, rank, i, -s, n) for rank, (n, i) in enumerate(good[:k], 1)}
    return out


def test_hard_negatives_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(6, 5))
    rows = [(i, (centers[i % 6] + rng.normal(size=5) * 0.2).round(2).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(700 + i, rows[0][1], i % 4) for i in range(60)]  # ties
    rows += [(800, [0.0] * 5, 1), (801, None, 1), (802, [1.0, None, 0.0, 0.0, 0.0], 1), (803, [float("nan")] * 5, 1), (804, [1.0] * 5, None), (None, [1.0] * 5, 1), (10, [0.5] * 5, 0), (900, [-x for x in rows[3][1]], 2)]
    rows = [(*r, "clash") for r in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, anchor string").repartition(3)
    for block, crowd, step in ((131_072, 8192, 4096), (200, 7, 16)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "CROWD", crowd)
        monkeypatch.setattr(hard_negatives, "STEP", step)
        got = hard_negatives.hard_negatives(table, every=10).collect()
        assert {tuple(r) for r in got} == mined([r[:3] for r in rows], 10, 5, 10) and len(got) == len(set(got))


def test_a_list_ends_before_its_end():
    rng = np.random.default_rng(2)
    near = np.array([10.0, 0, 0, 0]) + rng.normal(size=(50, 4))
    far = np.concatenate([near[:, :], np.floor(rng.normal(size=(20_000, 4)))])
    unit, norm = hard_negatives._directions(far)
    bound = hard_negatives._bounds(unit, norm, near[:5])
    scores = far @ near[:5].T
    assert (scores <= bound[:, None] * np.sqrt((near[:5] ** 2).sum(axis=1)) + 1e-6).all()
    best = np.sort(scores[:, 0])[-10]
    assert (bound * np.sqrt((near[0] ** 2).sum()) >= best).mean() < 0.2


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], schema)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (3, [0.5], 2)], schema)).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (100, [1.0, 2.0], 2), (5, [1.0], 1)], schema)).collect()
    with pytest.raises(Exception, match="exceed"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1), (100, [1e9], 1)], schema)).collect()


# earlier operators: plans and ids


def test_profiles_are_cut_before_they_are_gathered(spark):
    docs = spark.createDataFrame([(i, sentence(30), f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    plan = language_id.train_profiles(docs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_languages_in_passes_agree_with_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(chr(97 + (i * 7 + j) % 26) * 2 + sentence(1) for j in range(30)), f"l{i % 23:02d}") for i in range(230)] + [(500, None, "l00"), (501, "123", None)], "doc_id long, text string, lang string")
    want = sorted(map(tuple, language_id.identify_languages(docs).collect()))
    monkeypatch.setattr(language_id, "LANGUAGES_PER_PASS", 5)
    assert sorted(map(tuple, language_id.identify_languages(docs).collect())) == want and len({r[2] for r in want}) > 10


def test_mix_with_outlying_null_and_repeated_ids(spark):
    rows = [(i * 3, "w " * (i % 7), "hot") for i in range(600)] + [(1 << 60, "w w", "hot"), (-(1 << 60), "w " * 5000, "hot"), (7, "w " * 4999, "hot"), (None, "w", "hot"), (None, "w w", None), (3, "w", "small"), (3, "w w", "small"), (4, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = [tuple(r) for r in mixing.plan_mix(docs).collect()]
    assert sorted(plan, key=str) == sorted([tuple(r) for r in mixing.plan_mix(docs.repartition(5)).collect()], key=str) and len(plan) == len(rows)
    for r in mixing.plan_mix(docs).groupBy("source_size").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 3 * max(r["max(size)"], 1)
    alone = mixing.plan_mix(docs.where("source = 'small'")).collect()
    assert {(r.doc_id, r.size, r.taken) for r in alone} == {(3, 1, 1), (3, 2, 2)}
