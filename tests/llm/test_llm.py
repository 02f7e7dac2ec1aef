import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from planaudit.llm import ann, common, decontaminate, language_id, line_dedup, mixing, near_dedup, preference_chat, quality, substring_dedup, textops, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, component_id string, a string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def corpus():
    base = sentence(80)
    near = base.split()
    near[40] = "changed"
    shared = sentence(60)
    texts = [None, "", " \t\n ", "two words", "Two  WORDS", base, base, " ".join(near), sentence(70) + "\n" + shared, shared + "\n" + sentence(90), sentence(3000), "x " * 60, "é▁ <s> 😀\n" + sentence(20)]
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 1, "clash", "clash") for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_packed_values_round_trip():
    for n in (0, 1, 2, 1000):
        x = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert (textops.unpack_sorted(textops.pack_sorted(x)) == x).all()


def test_components_of_a_star_and_a_chain(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 140), 100)}


def test_near_duplicates_match_brute_force(docs, empty):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in ROWS:
        w = words((t or "").translate(table))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {k: new if v == old else v for k, v in comp.items()}
    got = near_dedup.near_duplicates(docs, hot=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_repeats_match_brute_force(docs, empty, spark):
    first, want = {}, {}
    for i, t, *_ in ROWS:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, batch_bytes=2000, group_suffixes=500).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0
    long = sentence(40)
    rows = [(None, long, "clash"), (2, long, "clash"), (3, long, "clash"), (3, f"x {long}", "clash"), (None, None, "clash")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, batch string"), texts=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in got) == [(0, 0, 0, ""), (0, 40, 0, long), (2, 40, 0, long), (3, 40, 40, ""), (3, 41, 40, "x")]


def test_token_counts_match_the_library(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 900)
    monkeypatch.setattr(token_counts, "SHARD_BYTES", 300)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "b", " ", "the", "\n", "é", "▁", "<s>", "😀", "\x00", "\t", "ing", "　"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "null id"), (3, "again")]
    rows += [(1000 + i, rng.choice(["the same words", " the same", "", "the  same words the"])) for i in range(300)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, limit=5).collect()
    key = lambda i, n, b: (-1 if i is None else i, n, b)
    assert sorted(key(r.doc_id, r.n_tokens, r.n_bytes) for r in got) == sorted(key(i, len(sp.encode(t)), len(t.encode())) for i, t in rows)
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == {i: len(sp.encode(t or "")) for i, t, *_ in ROWS}
    assert token_counts.count_tokens(empty, path).count() == 0


def test_languages(spark, empty):
    rows = [(i, "the cat and the dog with this house" if i % 2 else "der hund und die katze mit dem haus", "en" if i % 2 else "de") for i in range(200)] + [(900, None, None), (901, "12 34", "en")]
    got = {r.doc_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(200))
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0), ("und", 0.0)]
    assert 0 < sum(got[i].held_out for i in range(200)) < 200
    assert language_id.identify_languages(empty).count() == 0


class KneserNey:
    """The quality model by its definition, in dictionaries."""

    def __init__(self, texts):
        fold = lambda c: "\x1a" if c == "\x02" else "0" if c.isdigit() else "\n" if c == "\n" else " " if c.isspace() else c
        self.plain = lambda t: "\x02" * 3 + "".join(map(fold, t))
        top = Counter(p[i - 3 : i + 1] for p in map(self.plain, texts) for i in range(3, len(p)))
        self.counts = {4: top}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.less, self.rows = {}, {}
        for k, counts in self.counts.items():
            n1, n2, n3, n4 = (sum(n == i for n in counts.values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else None
            raw = [0.5, 0.75, 0.9] if y is None else [min(max(d, 0.05), i - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
            self.less[k] = raw
            for g, n in counts.items():
                self.rows.setdefault(g[:-1], []).append((n, raw[min(n, 3) - 1]))

    def p(self, gram):
        k, rows = len(gram), self.rows.get(gram[:-1])
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        if rows is None:
            return self.p(gram[1:])
        total, n = sum(x for x, _ in rows), self.counts[k].get(gram, 0)
        own = n - self.less[k][min(n, 3) - 1] if n else 0
        return own / total + sum(d for _, d in rows) / total * self.p(gram[1:])

    def perplexity(self, text):
        t = self.plain(text)
        return math.exp(-sum(math.log(self.p(t[i - 3 : i + 1])) for i in range(3, len(t))) / (len(t) - 3))


def test_perplexities_match_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    odd = ["Привет мир 123", "交易记录二〇二五年", "a\u00a0b\tc\x02d", "x", "\n\n  7", "UPPER lower", "😀" * 30]
    rows = [(i, sentence(rng.randint(1, 60)), "en", "c", 1) for i in range(120)] + [(200 + i, t, None, "c", 1) for i, t in enumerate(odd)] + [(300, None, "en", "c", 1), (301, "", "en", "c", 1), (5, "the same id again", "en", "c", 1), (None, sentence(5), "en", "c", 1), (302, sentence(4000), "xx", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string, part int").repartition(3)
    trusted = docs.where("doc_id < 60 or doc_id = 200").select("doc_id")
    monkeypatch.setattr(quality, "SLICE", 3000)
    monkeypatch.setattr(quality, "PART", 500)
    monkeypatch.setattr(quality, "CHUNK", 2)
    monkeypatch.setattr(quality, "SHARD_GRAMS", 700)
    got = quality.score(docs, trusted).collect()
    assert len(got) == len(rows)
    held = {r.doc_id for r in got if r.part == quality.HELD_OUT}
    trains = {r.doc_id for r in got if r.part == quality.TRAINS}
    assert len(held) > 0 and len(trains) > 40 and not held & trains
    model = KneserNey([t for i, t, *_ in rows if i in trains and t])
    want = sorted((-1 if i is None else i, len(t or ""), model.perplexity(t) if t else -1.0) for i, t, *_ in rows)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, -1.0 if r.perplexity is None else r.perplexity) for r in got)
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in have], [x[2] for x in want], rtol=1e-4)
    table, unseen = quality.train(quality.pack(docs, trusted, "doc_id", "text", "lang"))
    known = {r.gram: r for r in table.collect()}
    letters = [g for g in known if len(g) == 1 and known[g].log_p is not None]

    def share(gram):
        if gram in known and known[gram].log_p is not None:
            return known[gram].log_p
        if len(gram) == 1:
            return unseen
        back = known[gram[:-1]].log_back if gram[:-1] in known else None
        return (back or 0.0) + share(gram[1:])

    for context in ("", "a", "ab", "abc", "\x02\x02\x02", "qqq", "мир"):
        assert math.isclose(sum(math.exp(share(context + c)) for c in [*letters, "\U0001f600\u0301"[:1]]), 1.0, abs_tol=1e-6)


def test_languages_match_brute_force(spark):
    rng = random.Random(31)
    letters = {"aa": "abcdeé", "bb": "efghiß", "cc": "жзикл", "dd": "語言學日本"}
    texts = [(lang, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40)))) for lang in letters for _ in range(40)]
    texts += [("aa", "ab ab " * 20_000), ("aa", "ab ab " * 20_000), (None, "abc abd"), ("bb", None), ("cc", ""), ("aa", "1 2 3"), (None, "ééé ßß")]
    rows = [(i if i % 37 else None, t, lang, "clash", "clash", 7) for i, (lang, t) in enumerate(texts)] + [(3, "again hig", "bb", "clash", "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram string, score string, rank int").repartition(3)

    def grams(text):
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        found = Counter()
        for word in plain.split():
            found.update(word)
            marked = f" {word} "
            found.update(marked[i : i + 2] for i in range(len(marked) - 1))
            found.update(marked[i : i + 3] for i in range(len(marked) - 2))
        return found

    code = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    totals = {}
    for i, t, lang, *_ in rows:
        if t is not None and lang is not None and not is_held(i):
            totals.setdefault(lang, Counter()).update(grams(t))
    size = 60
    rank = lambda c: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:size])}
    profiles = {lang: rank(c) for lang, c in totals.items()}
    want = Counter()
    for i, t, *_ in rows:
        own = rank(grams(t or ""))
        if not own:
            want[i, is_held(i), "und", 0.0] += 1
            continue
        far, lang = min((sum(abs(r - p[g]) if g in p else size for g, r in own.items()), lang) for lang, p in profiles.items())
        want[i, is_held(i), lang, round(1 - far / (len(own) * size), 9)] += 1
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify_languages(docs, size).collect())
    assert got == want


def test_quality_rejects_junk(spark, empty):
    rows = [(i, sentence(60), "en") for i in range(80)] + [(100, "#### $$$$ %%%% " * 30, "en"), (101, None, "en"), (102, "", None), (103, sentence(50), "xx"), (104, "случайный текст других букв " * 10, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.keep for r in quality.classify(docs, docs.where("doc_id < 60").select("doc_id")).collect()}
    assert all(got[i] for i in range(80)) and got[103] and not any(got[i] for i in (100, 101, 102, 104))
    assert all(r.keep for r in quality.classify(docs.where("text <> ''"), docs.limit(0).select("doc_id")).collect())
    assert quality.classify(empty, docs.select("doc_id")).count() == 0


def test_lines(docs, empty, spark):
    line = sentence(40)
    near = line.replace(line.split()[20], "other", 1)
    rows = [(1, f"{line}\nonly here\n\n{line}"), (2, f"{near}\nunique text of two"), (3, None), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_components(df).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 3): False, (2, 0): False, (2, 1): True}
    assert sorted((r.doc_id or 0, r.text or "") for r in line_dedup.drop_repeated_lines(df).collect()) == [(0, line), (1, f"{line}\nonly here\n"), (2, "unique text of two"), (3, "")]
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns
    assert line_dedup.line_components(empty).count() == 0


def test_preferences(spark):
    turns = [(1, "chosen", 10, 0, "user", "q"), (1, "chosen", 10, 1, "assistant", "yes"), (1, "rejected", 11, 0, "user", "q"), (1, "rejected", 11, 1, "assistant", None), (2, "chosen", 12, 0, "user", "alone"), (3, "chosen", 14, 0, "user", "s"), (3, "rejected", 15, 0, "user", "s")]
    got = {r.pair_id: r for r in preference_chat.preference_pairs(spark.createDataFrame(turns, "pair_id long, side string, conv_id long, turn int, role string, text string")).collect()}
    assert (got[1].n_prompt_turns, got[1].prompt) == (1, "<|user|>\nq\n")
    m = got[1].chosen_mask[0]
    assert got[1].chosen[m.start : m.start + m.length] == "yes" and got[1].rejected_mask == []
    assert (got[2].n_prompt_turns, got[2].rejected, got[2].rejected_id) == (0, None, None)
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")


def test_decontamination(spark, empty):
    items = [(i, sentence(30) + ". " + sentence(6) + ".") for i in range(30)] + [(30, None), (31, "")]
    leak = items[4][1].upper()
    rows = [(1, sentence(200) + " " + leak + " " + sentence(200)), (2, sentence(300)), (3, None), (4, items[5][1][:60])]
    bench = decontaminate.split_items(spark.createDataFrame(items, "item_id long, text string"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 4)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECES_PER_PASS", 9)
    rng = random.Random(41)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 150))), " ".join(rng.choice(VOCAB) for _ in range(rng.randint(0, 8))), "clash") for i in range(24)]
    items += [(24, items[3][1], items[3][2], "clash"), (25, items[4][1], items[4][2], "clash"), (26, None, None, "clash"), (None, "x", "y", "clash"), (27, "", "only answer", "clash")]

    def altered(text, share):
        return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split())

    texts = [None, "", sentence(2000)]
    for i in range(40):
        _, q, a, _ = items[i % 24]
        texts.append(" ".join([sentence(rng.randint(0, 200)), altered(q, (i % 5) / 20), altered(a, (i % 4) / 20).upper(), sentence(rng.randint(0, 200))]))
    rows = [(i if i % 17 else None, t, 1.0, 3) for i, t in enumerate(texts)] + [(5, texts[4], 1.0, 3), (5, texts[4], 1.0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, question string, answer string, score string")
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    pieces = []
    for i, q, a, _ in items:
        if i is None:
            continue
        q, a = plain(q), plain(a)
        both = q + a
        grams = lambda w: {tuple(w[k : k + min(3, len(w))]) for k in range(len(w) - min(3, len(w)) + 1)} if w else set()
        pieces += [(i, k, both[k : k + 64], grams(q[k : k + 64]), grams(both[max(k, len(q)) : k + 64])) for k in range(0, len(both), 64)]
    df = Counter(w for p in pieces for w in set(p[2]))
    mean = sum(len(p[2]) for p in pieces) / len(pieces)

    def weights(words):
        idf = {w: math.log(1 + (len(pieces) - df[w] + 0.5) / (df[w] + 0.5)) for w in words}
        own = {w: idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w, n in Counter(words).items()}
        return {w: x / sum(own.values()) for w, x in own.items()}

    known, best = [(*p, weights(p[2])) for p in pieces], {}
    for i, t, *_ in rows:
        if i is None:
            continue
        words = plain(t)
        for at in range(0, max(len(words), 1), 64):
            passage = words[at : at + 128]
            have = {tuple(passage[k : k + m]) for m in (1, 2, 3) for k in range(len(passage) - m + 1)}
            for item, k, _, qg, ag, weight in known:
                score = sum(x for w, x in weight.items() if w in set(passage))
                if score >= 0.6 - 1e-9:
                    old = best.get((i, item, k), (0, 0, 0))
                    best[i, item, k] = tuple(map(max, old, (score, len(qg & have), len(ag & have))))
    size = {i: (sum(len(p[3]) for p in pieces if p[0] == i), sum(len(p[4]) for p in pieces if p[0] == i)) for i in {p[0] for p in pieces}}
    total = {}
    for (d, item, _), (score, q, a) in best.items():
        old = total.get((d, item), (0, 0, 0))
        total[d, item] = (max(old[0], score), old[1] + q, old[2] + a)
    want = {(d, i, round(s, 6), q / size[i][0] if size[i][0] else 1.0, a / size[i][1] if size[i][1] else 1.0) for (d, i), (s, q, a) in total.items()}
    want = {x for x in want if x[3] >= 0.6 and x[4] >= 0.6}
    got = [(r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_mixing(docs, empty, spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 15 and math.isclose(sum(got.values()), 1015)
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
    assert mixing.mix(docs).count() == sum(r.copies for r in rows)
    assert mixing.plan_mix(empty).count() == 0


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[5] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4020, [0.0] * 16), (4040, [math.nan] * 16)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    scores = x[::20].astype(float) @ x.astype(float).T
    hits = 0
    for k in range(len(scores)):
        scores[k, 20 * k] = -np.inf
        best = set(np.lexsort((np.arange(3000), -scores[k]))[:20].tolist())
        hits += len(best & {r.vec_id for r in got if r.query_id == 20 * k})
    assert len(got) == 20 * len(scores) and hits / len(got) >= 0.9
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_small_and_odd_tables(spark):
    rows = [(20 * i, [1.0, float(i % 3)], "clash") for i in range(6)] + [(21, [1.0, 2.0], "clash"), (22, [1.0, 2.0], "clash"), (22, [0.5, 9.0], "clash"), (23, [math.inf, 1.0], "c"), (24, [None, 1.0], "c"), (None, [1.0, 1.0], "c"), (25, [0.0, 0.0], "c")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = {i: v for i, v, _ in reversed(rows[:9])} | {22: [0.5, 9.0]}
    want = []
    for q in range(0, 120, 20):
        near = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:20]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(docs).collect())
    assert got == sorted(want)


def test_lines_of_one_band_all_meet(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]

    def edited(line, n):
        out = list(line)
        for at in rng.sample(range(len(out)), n):
            out[at] = "".join(rng.choice("ijklmnop") for _ in range(6))
        return out

    own = [edited(base, 6) for _ in range(300)]
    lines = [" ".join(x) for x in own] + [" ".join(edited(x, 2)) for x in own]
    sets = [set(re.findall(r"(?s)(?<!\S)(?=(\S.{0,8}))", x)) for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.keeper_doc_id for r in line_dedup.line_components(df).collect()}
    # two lines of 0.87 and more share no band with a chance below 0.002
    assert len(set(root)) == 300 and 0 <= len(set(got.values())) - 300 <= 2


def test_lines_of_a_family_meet_few_others(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, others = [word() for _ in range(60)], [[word() for _ in range(4)] for _ in range(60)]
    lines = []
    for _ in range(600):
        out = list(base)
        for at in rng.sample(range(60), rng.randint(1, 3)):
            out[at] = rng.choice(others[at])
        lines.append(" ".join(out))
    pairs, plain = [], line_dedup._verified

    def counted(fresh, sets, percent):
        pairs.append(fresh.count())
        return plain(fresh, sets, percent)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.keeper_doc_id for r in line_dedup.line_components(df).collect()}
    assert set(got.values()) == {0}
    # without the round of heads 6141 pairs are compared
    assert sum(pairs) < 8 * len(lines)


def test_band_signatures(spark):
    points = line_dedup._points()
    rows = [[5], [points[0], points[3]], sorted(random.Random(16).randrange(-(1 << 63), 1 << 63) for _ in range(40)), [-(1 << 63), points[5], (1 << 63) - 1]]
    df = spark.createDataFrame([(x, sorted(x + points)) for x in rows], "h array<long>, places array<long>")
    want = [[F.xxhash64(F.lit(i), F.array(*[F.lit(v).cast("long") for v in ([v for v in x if v >= p][:3] + x[:3])[:3]])) for i, p in enumerate(points)] for x in rows]
    got = df.select("h", *[line_dedup._signature(F.col("h"), F.col("places"), i) for i in range(len(points))]).collect()
    known = {tuple(x): list(spark.range(1).select(*w).first()) for x, w in zip(rows, want, strict=True)}
    assert all(list(r[1:]) == known[tuple(r[0])] for r in got)


def test_lines_are_compared_whole(spark):
    rng = random.Random(12)
    far = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(80))
    chinese = [far[:9] + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60)) for _ in range(20)]
    lines = [*chinese, "https://example.org/a1", "https://example.org/b2", "equal words  and then xxxxxxxxxyyyyyyyyy", "equal words  and then xxxxxxxxxzzzzzzzzz", far, "x" + far[1:], "inserted" + far]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.keeper_doc_id for r in line_dedup.line_components(df).collect()}
    assert got == {i: min(i, 24) for i in range(len(lines))}
    for line in ("a", "  a\t bc", "abcdefghi jklmnopqrs\ttuvwxyzab", far, " " * 30 + "x" + " " * 30):
        marked = [line[:i] + "\u2603" + line[i + 1 :] for i in range(len(line))]
        rows = spark.createDataFrame([(x,) for x in [line, *marked]], "line string").select(line_dedup.shingles(F.col("line"))).collect()
        assert all(r[0] != rows[0][0] for r in rows[1:])


def test_quality_limits_reject_a_third_of_random_words(spark):
    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def mixed(share):
        return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) if rng.random() < share else rng.choice(vocab) for _ in range(200))

    rows = [(i, mixed(rng.random() * 0.1), "en") for i in range(200)] + [(1000 + i, mixed(i / 100), "en") for i in range(0, 60, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.keep for r in quality.classify(docs, docs.where("doc_id < 150").select("doc_id")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(1034, 1060, 2))


def test_components_with_more_links_are_those_of_all_links(spark):
    rng = random.Random(5)
    first, more = ([(rng.randrange(-40, 80), rng.randrange(-40, 80)) for _ in range(n)] for n in (45, 30))
    frames = [spark.createDataFrame(x, "a long, b long") for x in (first, more, first + more)]
    got = common.merged_components(common.connected_components(frames[0]), frames[1])
    wanted = {tuple(r) for r in common.connected_components(frames[2]).collect()}
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_shingles_of_odd_lines_are_those_of_the_plain_pattern(spark):
    plain = r"(?s)(?=(.{1,9}))(?:\S{1,8}+\s|\S{1,9}+\z|.)"
    rng = random.Random(9)
    lines = ["", " ", "123456789", "12345678", "1234567890", "12345678 ", "123456789 x", "\x85  a"] + ["".join(rng.choice("abé\U0001f600 \t\r\x0b\x0c\x1c\x85 ") for _ in range(rng.randrange(40))) for _ in range(300)]
    lines += ["".join(rng.choice("abcdefg中 ") * rng.randrange(1, 12) for _ in range(9)) for _ in range(300)]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    both = [F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in (plain, line_dedup.SHINGLE)]
    assert frame.where(~both[0].eqNullSafe(both[1])).count() == 0


def test_keepers_are_looked_up_without_a_sort(spark):
    """Each key is in the table once, so the lines need no order for it."""
    lines = line_dedup.line_components(spark.createDataFrame([(1, "one line\nand another")], "doc_id long, text string"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan


def test_lines_are_moved_once_and_only_those_of_like_size_are_looked_at(spark, monkeypatch):
    rng = random.Random(17)
    short = [[f"{rng.randrange(1 << 40):x}" for _ in range(20)] for _ in range(20)]
    long = [[*x, *(f"{rng.randrange(1 << 40):x}" for _ in range(10))] for x in short]
    near = [[*x[:-1], "changed"] for x in short[:5]]
    frames, plain, hits = {}, line_dedup.materialize, []

    def written(df):
        frames[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df)

    def linked(found, sets, percent):
        hits.extend(r.id for r in found.select("id").distinct().collect())
        return linked_plain(found, sets, percent)

    linked_plain = line_dedup._linked
    monkeypatch.setattr(line_dedup, "materialize", written)
    monkeypatch.setattr(line_dedup, "_linked", linked)
    texts = [" ".join(x) for x in short[5:] + long[5:]] + ["\n".join(" ".join(x) for x in pair) for pair in zip(short, near, strict=False)]
    got = line_dedup.line_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == 35 and len(got) == 40
    # a line and one half as long again share a band as a rule, but cannot be alike
    assert len(hits) <= 10
    # the shingles that are compared come from the buckets, without another shuffle of the lines
    assert "Bucketed: true" in frames["id", "h"]
