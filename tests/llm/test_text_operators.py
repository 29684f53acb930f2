"""Lines, benchmark items, near copies, fingerprints, toxicity, scores and pieces on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import components, decontaminate, lines, minhash, pieces, simhash, suffix_tree, toxicity
from tests.llm.helpers import docs, prose, shingles, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(None, "no id"), (901, None), (902, ""), (903, " \n\t "), (904, "one"), (904, "one"), (905, prose(9, 30_000))]


def native(frame):
    return not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())


# ----------------------------------------------------------------------------------------- lines


def test_boilerplate_goes_and_the_rest_stays(spark):
    rows = [(i, f"Menu\n{prose(i, 5)}\n\n{prose(i + 1000, 5)}", "a") for i in range(30)]
    rows += [(100 + i, f"Menu\nown {i}", "b") for i in range(3)]  # too few pages to tell
    rows += [(200, "Menu", "a"), (201, None, "a"), (202, "", "a"), (203, "Menu\nx", None), (1, rows[1][1], "a")]
    rows += [(300 + i, "copied page\nof two lines", "a") for i in range(40)]  # copies are no frame
    frame = docs(spark, rows).withColumn("host", F.lit("clash")).withColumn("lines", F.lit(0)).withColumn("n_lines", F.lit(9))
    cleaned = lines.drop_boilerplate(frame, counts=True)
    assert native(cleaned) and cleaned.columns == [*frame.columns, "_n_lines", "n_dropped"]
    got = sorted(map(repr, ((r.doc_id, r.text, r._n_lines, r.n_dropped) for r in cleaned.collect())))
    want = []
    for i, t, s in rows:
        parts = [] if t is None else t.split("\n")
        kept = [p for p in parts if not (s == "a" and p == "Menu")]
        want.append(repr((i, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept))))
    assert got == sorted(want)


def test_lines_of_nothing(spark):
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0


# ------------------------------------------------------------------------------- benchmark items


def contained(rows, items):
    out = Counter()
    for i, t in rows:
        own = words(t)
        for k, item in items:
            width = min(5, len(words(item)))
            if width:
                asked = shingles(item, width)
                hit = len(asked & {tuple(own[x:x + width]) for x in range(len(own) - width + 1)})
                if hit * 10 >= len(asked) * 8:
                    out[i, k, hit, len(asked)] += 1
    return out


def test_containment_equals_brute_force(spark, monkeypatch):
    items = [(k, prose(5000 + k, 6 + k, 10_000)) for k in range(12)] + [(50, "two words"), (51, None), (52, ""), (None, prose(77, 9))]
    rng = random.Random(3)
    rows = list(ODD)
    for i in range(60):
        item = words(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "edited"
        rows.append((i, f"{prose(i, 80)} {' '.join(item).upper()} {prose(i + 100, 500)}"))
    rows += [(70, "Two\nWORDS here"), (71, prose(77, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (2_000_000, 120):  # one block, and some
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", bound)
        got = decontaminate.contained_items(docs(spark, rows), bench).collect()
        assert Counter((r.doc_id, r.item_id, r.matched, r.item_shingles) for r in got) == contained(rows, items)
        frame = docs(spark, rows).withColumn("probe", F.lit(1))
        kept = decontaminate.drop_contaminated(frame, bench)
        hit = {x[0] for x in contained(rows, items)}
        assert kept.columns == frame.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in hit)
    assert decontaminate.contained_items(docs(spark, []), bench).count() == 0
    assert decontaminate.contained_items(docs(spark, rows), bench.limit(0)).count() == 0


# ----------------------------------------------------------------------------------- near copies


def own_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    size = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + size]).encode(), 42) for i in range(len(w) - size + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(codes, radius):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_forest_links_what_brute_force_links(radius):
    rng = random.Random(radius)
    codes = [rng.getrandbits(64) for _ in range(60)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes for _ in range(5)]
    codes = sorted(set(codes))
    a, b = simhash.forest(np.array(codes, np.uint64), radius)
    place = {c: i for i, c in enumerate(codes)}
    parent = np.arange(len(codes))
    parent = simhash.unite(parent, np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    want = linked(codes, radius)
    assert len(a) < len(codes) and [want.index(x) for x in want] == [list(parent).index(p) for p in parent]


def test_moved_bits_keep_differences_and_come_back():
    rng = random.Random(2)
    codes = np.array([rng.getrandbits(64) for _ in range(50)], np.uint64)
    order = np.array(rng.sample(range(64), 64))
    there = simhash.moved(codes, order)
    assert (simhash.moved(there, np.argsort(order)) == codes).all()
    assert (np.bitwise_count(there[1:] ^ there[:-1]) == np.bitwise_count(codes[1:] ^ codes[:-1])).all()


@pytest.mark.parametrize("radius,limit", [(2, 20_000), (2, 60), (3, 60)])
def test_forests_of_crowded_groups_link_what_brute_force_links(spark, radius, limit):
    """Codes that agree in most bits crowd one group of every part, which is dealt anew."""
    rng = random.Random(limit)
    codes = [rng.getrandbits(64) for _ in range(40)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes for _ in range(3)]
    codes += [0xABCD_0000_0000_0000 | rng.getrandbits(12) << rng.choice((0, 20, 30)) for _ in range(200)]
    codes = sorted(set(codes))
    frame = spark.createDataFrame([(t, c - 2**64 if c >= 2**63 else c) for t in (0, 4) for c in codes], "table int, fingerprint long")
    routed = simhash._routed(frame, radius, limit)
    if limit > len(codes):
        assert routed.count() == 2 * len(codes) * (radius + 1)
    else:
        assert routed.groupBy("table", "mask", "value").count().agg(F.max("count")).first()[0] <= limit
    place, want = {c: i for i, c in enumerate(codes)}, linked(codes, radius)
    links = simhash.link_forests(frame, radius, limit).collect()
    for table in (0, 4):
        own = [(r.a % 2**64, r.b % 2**64) for r in links if r.table == table]
        assert all((a ^ b).bit_count() > 0 for a, b in own)
        parent = simhash.unite(np.arange(len(codes)), np.array([place[a] for a, _ in own]), np.array([place[b] for _, b in own]))
        assert [want.index(x) for x in want] == [list(parent).index(p) for p in parent]


def test_components_are_those_of_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_simhash_components_equal_brute_force(spark):
    texts = [prose(i, 12 + i % 30, 60) for i in range(80)]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(i + 200, t + " end") for i, t in enumerate(texts)]
    rows += ODD + [(400 + i, texts[3]) for i in range(30)]
    got = simhash.near_components(docs(spark, rows).withColumn("fingerprint", F.lit(1)), limit=30).collect()
    codes = [own_fingerprint(t) for _, t in rows]
    roots = linked(codes, 2)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = Counter((i, c - 2**64 if c >= 2**63 else c, least[r]) for (i, _), c, r in zip(rows, codes, roots, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_components(docs(spark, [])).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(12):
        base = prose(g, 400, 5000).split()
        for k in range(20):
            own = list(base)
            for _ in range(k % 4):
                own[rng.randrange(400)] = f"edit{rng.randrange(9)}"
            rows.append((g * 100 + k, " ".join(own)))
            group[g * 100 + k] = g
    rows += [(5000 + i, prose(900 + i, 60, 5000)) for i in range(40)] + [(None, rows[0][1]), (7000, None), (7001, ""), (5000, prose(900, 60, 5000))]
    frame = docs(spark, rows).withColumn("gone", F.lit(1)).withColumn("node", F.lit(2))
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    left = [r.doc_id for r in kept.collect()]
    per_group = Counter(group[i] for i in left if i in group)
    assert len(per_group) == 12 and sum(per_group.values()) <= 13  # one candidate may be missed
    assert sum(i is not None and 5000 <= i < 6000 for i in left) == 41  # a repeated id is one document
    assert None in left and 7000 in left and 7001 not in left
    text = dict(rows)
    for r in simhash.near_copies(frame).collect():
        a, b = shingles(text[r.doc_id]), shingles(text[r.kept])
        assert r.kept in left and (text[r.doc_id] == "" or len(a & b) >= 0.8 * len(a | b))
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_added_cut_and_edited_copies_are_found(spark):
    rng = random.Random(12)
    rows, alike = [], []
    for g in range(240):
        size = 120 + g
        base, extra = prose(g, size, 5000).split(), prose(10_000 + g, size, 5000).split()
        part = size * (4, 8, 12, 16, 19)[g % 5] // 100
        copy = (base + extra[:part], base[: size - part], base[part:], extra[:part // 2] + base)[g % 4]
        if g % 6 == 5:
            copy = list(base)
            for at in rng.sample(range(size), size // 60):
                copy[at] = "edit"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            alike.append(2 * g + 1)
    gone = {r.doc_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert len(alike) > 180 and gone <= set(alike)
    assert len(gone) >= len(alike) - 1


# ---------------------------------------------------------------------------------- fingerprints


def test_fingerprints_estimate_resemblance(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rows = [(i * 3, prose(i, 3 + 9 * i % 800, 4000)) for i in range(60)] + ODD + [(906, prose(5, 48, 4000))]
    frame = docs(spark, rows).withColumn("block", F.lit("clash"))
    made = minhash.fingerprint_edits(frame)
    assert native(made)
    got = defaultdict(list)
    for r in made.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    named = sorted(((i, t or "") for i, t in rows if i is not None), reverse=True) + [(None, "no id")]
    off = []
    for k, (i, t) in enumerate(named):
        after = named[(k + 1) % len(named)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own = [r for r in got[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert own and own[0].n_chars == len(t)
        for near, other in ((own[0].near_edited, edited), (own[0].near_next, after)):
            a, b = shingles(t), shingles(other)
            truth = len(a & b) / len(a | b) if a or b else 1.0
            assert abs(near - truth) < 0.25
            off.append(near - truth)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t or ""] |= {r.fingerprint for r in got[i]}
    assert all(len(x) == 1 for t, x in by_text.items() if t not in ("one",)) and by_text[""] == {""}
    assert minhash.fingerprint_edits(docs(spark, [])).count() == 0
    (alone,) = minhash.fingerprint_edits(docs(spark, [(1, "only one here")])).collect()
    assert alone.near_next == 1.0


def test_bins_of_short_texts_are_as_likely_as_any_other(spark):
    frame = docs(spark, [(i, prose(i, 6, 5000)) for i in range(80)])  # two shingles
    shares = []
    for (signs,) in frame.select(minhash.signature(minhash.shingle_hashes(F.col("text")))).collect():
        assert len(signs) == minhash.BINS
        count = Counter(signs)
        if len(count) == 2:
            shares.append(count[min(count)] / minhash.BINS)
    # By chance the share varies by 0.03; behind long gaps of a ring it would by 0.2.
    assert len(shares) > 70 and abs(np.mean(shares) - 0.5) < 0.03 and np.std(shares) < 0.06


def signed(value):
    return value - 2**64 if value >= 2**63 else value


def hashed(*values):
    """Texts as UTF-8, pairs (number, bytes) as little-endian integers; each hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), seed=seed).intdigest()
    return signed(seed)


def own_minhash(text):
    """The fingerprint by its definition, one bin after the other."""
    known = words(text)
    if not known:
        return ""
    if len(known) < 5:
        values = {hashed(" ".join(known))}
    else:
        values = {hashed(*[(hashed(w), 8) for w in known[i:i + 5]]) for i in range(len(known) - 4)}
    least = {}
    for v in sorted(values, reverse=True):
        least[(v >> 56) + 128] = v
    rng = random.Random(minhash.BINS)
    tries = [[rng.randrange(minhash.BINS) for _ in range(sum(minhash.TRIES))] for _ in range(minhash.BINS)]
    out = ""
    for b in range(minhash.BINS):
        at = b
        if b not in least:
            hits = [t for t in tries[b] if t in least]
            at = hits[0] if hits else min(least, key=lambda t: hashed((b, 4), (t, 4)))
        out += f"{hashed((least[at], 8), (b, 4)) & 15:x}"
    return out


def test_fingerprints_equal_their_definition(spark):
    texts = [prose(i, n, 3000) for i, n in enumerate((1, 2, 4, 5, 6, 7, 9, 20, 60, 400, 3000))] + ["", " \n", "Ünï Wörd A", "a a a a a a a"]
    frame = docs(spark, list(enumerate(texts)))
    got = dict(frame.select("doc_id", minhash.fingerprint(F.col("text"))).collect())
    assert [got[i] for i in range(len(texts))] == [own_minhash(t) for t in texts]


def test_unrelated_short_texts_are_unlike(spark):
    # One to five shingles; few values fill all bins.
    texts = [prose(1000 + i, 5 + i % 5, 10**6) for i in range(150)]
    frame = docs(spark, list(enumerate(texts))).select("doc_id", minhash.fingerprint(F.col("text")).alias("f"))
    prints = [f for _, f in sorted(frame.collect())]
    assert len(set(prints)) == len(texts)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i]]
    near = spark.createDataFrame(pairs, "a string, b string").select(minhash.likeness(F.col("a"), F.col("b")).alias("n"))
    assert near.agg(F.max("n")).first()[0] < 0.3


# -------------------------------------------------------------------------------------- toxicity


def toxic_corpus(n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        own, bad = prose(i, 60, 800).split(), rng.random() < 0.25
        if bad:
            for _ in range(2):
                own[rng.randrange(60)] = rng.choice(["Nasty", "vilest", "vilely,", "rotten!"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    return rows, labels


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(400):
        at = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        value = rng.random(len(at))
        vectors.append((at, value / np.sqrt((value ** 2).sum())))
    dense = np.zeros((400, 40))
    for i, (a, v) in enumerate(vectors):
        dense[i, a] = v
    index = toxicity.BlockIndex(vectors, np.zeros(400), np.ones(400), np.arange(400), 40)
    for i in range(60):
        places, cosines = index.nearest(vectors[i], k=10)
        want = np.sort(dense @ dense[i])[::-1][:10]
        assert np.allclose(cosines, want[want > 0])
        assert np.allclose(dense[index.ids[places]] @ dense[i], cosines)


def test_held_out_labels_are_predicted(spark):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (3, 1, None), (9999, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    frame = docs(spark, rows + ODD).withColumn("score", F.lit("clash")).withColumn("probe", F.lit(0))
    model = toxicity.fit(frame, table)
    got = toxicity.score(frame, model)
    assert got.columns == [*frame.columns, "_score", "neighbours", "cosines", "neighbour_labels"]
    scored = got.collect()
    assert all(0 <= r._score <= 1 for r in scored) and len(scored) == len(rows) + len(ODD)
    score, truth = {r.doc_id: r._score for r in scored}, dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.7) == bool(truth[i]) for i in held]) > 0.97
    assert all(score[i] < 0.7 for i in (901, 902, 903, 904, 905))
    kept = toxicity.drop_toxic(frame, table)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in scored if r._score < 0.7)
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels] + [(9999, 1)], "doc_id long, toxic int")
    assert {r.doc_id: r._score for r in toxicity.score(frame, toxicity.fit(frame, other)).collect()} == pytest.approx(score)


def test_toxicity_without_examples(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs(spark, ODD), toxicity.fit(docs(spark, ODD), none)).collect()} == {0.0}
    assert toxicity.drop_toxic(docs(spark, []), none).count() == 0


# ---------------------------------------------------------------------------------- suffix tree


def test_scores_and_base(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 3_000)
    rng = random.Random(2)
    stem = [["ka", "ri", "to"], ["zum", "fel", "gor"]]
    rows = []
    for i in range(300):
        own = stem[i % 2]
        rows.append((i, " ".join(("the", "das")[i % 2] if rng.random() < 0.3 else "".join(rng.choice(own) for _ in range(rng.randrange(1, 5))) for _ in range(40))))
    rows += ODD
    got = suffix_tree.score_texts(docs(spark, rows).withColumn("block", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    count, tokens = Counter(), []
    for i, t in rows:
        w = [*words(t), None]
        out = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        tokens.append((i, out, w))
        if not out:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, out, len(w), sum(count[x] > 0 for x in w), n,
                   round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, out, w in tokens)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_tree.score_texts(docs(spark, [])).count() == 0
    (alone,) = suffix_tree.score_texts(docs(spark, [(1, "a b")])).collect()
    assert math.isfinite(alone.score)


def test_spelling_probabilities_add_up_to_one(spark):
    rows = [(bytes(random.Random(i).choices(b"abc", k=1 + i % 6)), 1 + i % 2) for i in range(2000)]
    tree = suffix_tree.grow_tree(spark.createDataFrame(rows, "word binary, state long"), depth=4, least=1e-3, gain=5.0)
    assert len(tree.keys) > 5
    for state in tree.keys:
        own = tree.log(np.full(suffix_tree.SYMBOLS, state), np.arange(suffix_tree.SYMBOLS))
        assert abs((10 ** own).sum() - 1) < 1e-9


def test_contexts_of_rare_words_predict(spark):
    # 1,500 words, none among the 256 frequent ones that name a state more than another; the next
    # word follows from the last one, or, after "x", from the last two.
    rng = random.Random(4)
    kinds = [f"{a}{b}{c}" for a in "bdfgklmnprstvz" for b in "aeiou" for c in "bdfgklmnprstvzcqhjwy"]
    after = dict(zip(kinds, rng.sample(kinds, len(kinds)), strict=True))
    rows = []
    for i in range(600):
        own = [rng.choice(kinds)]
        while len(own) < 120:
            own += [after[own[-1]]] if len(own) % 4 else ["x", after[after[own[-1]]]]
        rows.append((i, " ".join(own)))
    got = suffix_tree.score_texts(docs(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.5


def test_word_probabilities_add_up_to_one(spark):
    # Texts that differ in the last word only: probabilities of all last words are a distribution.
    rng = random.Random(3)
    kinds = ["a", "b", "c", "d"]
    rows = [(i, f"u v {rng.choices(kinds, (9, 4, 2, 1))[0]}") for i in range(10_000) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    probes = dict(zip(held, [*kinds, "", "u", "v", "new"], strict=False))
    probes = {i: f"u v {w}".strip() for i, w in probes.items()}
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(docs(spark, rows + list(probes.items()))).collect()}
    count = Counter(t.split()[2] for _, t in rows)
    total = sum(count.values())
    score = {t: got[i] for i, t in probes.items()}
    shares = {w: 10 ** (score[f"u v {w}"] - score["u v a"]) for w in kinds}
    for w in kinds:
        # What follows u v is the counted share, and the end is as sure after each.
        assert abs(shares[w] / sum(shares.values()) - count[w] / total) < 0.01
    assert sum(10 ** x for t, x in score.items()) <= 1 + 1e-9


# ----------------------------------------------------------------------------------------- pieces


@pytest.mark.parametrize("chunk", [40, 700])
def test_pieces_equal_the_library_and_decode(spark, chunk):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(chunk)
    texts = [prose(1, 600), "a" * 900, "the" * 300, " " * 333, "x  y   z" * 60, "é漢字🙂\n\n b\tc" * 60,
             "".join(rng.choice("thein grsao") for _ in range(900)), "".join(rng.choice("etaonish") for _ in range(900))]
    rows = [(i, t) for i, t in enumerate(texts)] + ODD + [(None, texts[0])]
    frame = docs(spark, rows).withColumn("row", F.lit("clash")).withColumn("ids", F.lit("clash"))
    encoded = pieces.encode(frame, MODEL, chunk=chunk)
    assert encoded.columns == [*frame.columns, "_ids"]
    got = pieces.decode(encoded, MODEL, "_ids").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert r._ids == lib.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.encode(docs(spark, []), MODEL).count() == 0


def test_max_plus_scan_is_the_running_product():
    rng = np.random.default_rng(5)
    shapes = [1, 4, 3, 5, 2, 6, 1]
    mats = [np.where(rng.random((a, b)) < 0.3, -np.inf, rng.random((a, b))) for a, b in zip(shapes, shapes[1:], strict=False)]
    running = mats[0]
    for own, m in zip(pieces.scan(mats)[1:], mats[1:], strict=True):
        running = pieces.times(running, m)
        assert np.allclose(own, running)


def test_texts_are_sent_to_tasks_once(spark):
    rows = docs(spark, [(1, "one two three four five six"), (2, "poison " * 9), (3, None), (4, "")])
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (decontaminate.drop_contaminated, lambda d, _: toxicity.score(d, toxicity.fit(d, labels)),
                 lambda d, _: pieces.encode(d, MODEL)):
        out = made(rows, items)
        (sent,) = re.findall(r"MapInArrow [^\n]*\n[^\n]*Project \[([^\]]*)\]", out._jdf.queryExecution().analyzed().toString()) or [""]
        assert "probe" not in sent
        # Other kinds of columns are still read as strings.
        other = made(rows.withColumn("text", F.col("text").cast("binary")), items)
        same = other.withColumn("text", F.col("text").cast("string"))
        assert sorted(map(str, same.collect())) == sorted(map(str, out.collect()))
    assert {r.doc_id for r in decontaminate.drop_contaminated(rows, items).collect()} == {2, 3, 4}
