"""Importance resampling, spelling variants and license scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat, licenses, resample, spelling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n long, id long, weight long"
random.seed(11)


def lower(s):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in s)


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0, 7, -1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS).repartition(3)


# ------------------------------------------------------------------ importance resampling


def features(text, most):
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)


def drawn(rows, target, most, buckets, share, least, seed):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(crc(f) for x in texts for f in features(x, most)[0]) for texts in ([x for _, x in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f, n = features(x, most)
        weight = sum(gain[crc(y)] for y in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(may[: len(may) * share // 100]):
        ranks.setdefault(r[:4], []).append(k + 1)
    return sorted(repr((*r[:4], ranks[r[:4]].pop(0) if ranks.get(r[:4]) else None)) for r in sorted(out, key=repr))


@pytest.mark.parametrize("most, nodes", [(1, 400_000), (3, 400_000), (2, 5)])
def test_resample(spark, most, nodes):
    vocabulary = [f"w{i}" for i in range(40)] + ["ÉTÉ", "été", "日本", "A-b"]
    texts = [None, "", " .,;\n", "one", *(" ".join(random.choices(vocabulary, k=random.randint(1, 60))) for _ in range(80)), " ".join(random.choices(vocabulary, k=30_000))]
    rows = [*enumerate(texts), (None, texts[20]), (None, texts[20]), (4, texts[4]), (4, texts[4])]
    target = [None, "", *texts[30:40]]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(docs, items, most=most, buckets=97, share=30, least_words=10, seed=5, nodes=nodes).collect()
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in sorted(got, key=repr)) == drawn(rows, target, most, 97, 30, 10, 5)


def test_resample_empty_tables(spark):
    docs = documents(spark, ["a b c"] * 30)
    items = spark.createDataFrame([], "text string")
    assert resample.importance_resample(docs.limit(0), items).count() == 0
    got = resample.importance_resample(docs, items, least_words=1, share=10).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and {r.n_features for r in got} == {3}
    assert [f.name for f in resample.importance_resample(docs, docs).schema] == ["doc_id", "n_features", "weight", "score", "rank"]


# ------------------------------------------------------------------ spelling variants

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, least_length, least_count, every):
    n = Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def variants(n, ratio):
    by = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and near(w, x)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in by.items() if v}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(repr((w, n[w], form.get(w), n[form[w]] if w in form else None, root(w), len(by[w]))) for w in n)


@pytest.mark.parametrize("crowd, batch", [(20_000, 40_000), (4, 7), (1, 1000)])
def test_spelling(spark, crowd, batch):
    stems = ["gramatic", "aaaaaa", "aaaaaaa", "abababab", "été" * 3, "x" * 300, *("".join(random.choices("abc", k=random.randint(5, 8))) for _ in range(60))]
    words = list(stems)
    for w in stems:
        for _ in range(4):
            i, c = random.randrange(len(w) + 1), random.choice("abcé")
            words.append(random.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    texts = [None, "", "12 34", "ÉTÉété", *(" ".join(random.choice([x, x.upper()]) + random.choice("., 7") for x in random.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=90)) for _ in range(40))]
    rows = [*enumerate(texts), (None, texts[5]), (None, texts[5]), (3, texts[6])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = spelling.spelling_variants(docs, every=11, crowd=crowd, batch_rows=batch).collect()
    want = variants(counted(rows, 5, 3, 11), 2)
    assert sorted(repr((r.word, r.n, r.form, r.form_n, r.root, r.n_near)) for r in got) == want and len(want) > 50
    assert any(r.root not in (r.word, r.form) for r in got)


def test_spelling_long_words_and_no_words(spark):
    long = "".join(random.choices("ab", k=3000))
    other, longer = long[:2500] + "c" + long[2501:], long[:100] + "z" + long[100:]
    got = {r.word: r for r in spelling.spelling_variants(documents(spark, [f"{long} {other} {longer}"] * 3), every=10**9).collect()}
    assert {w: r.n_near for w, r in got.items()} == {long: 2, other: 1, longer: 1}
    assert spelling.spelling_variants(documents(spark, [None, "", "a b"])).count() == 0


# ------------------------------------------------------------------ license scans


def scanned(text):
    w = WORD.findall(lower(text or ""))
    templates = [(label, WORD.findall(lower(t)), base) for rows, base in ((licenses.PHRASES, True), (licenses.NOTICES, False)) for label, t in rows]
    starts, base_labels, labels, best = [], set(), set(), 0.0
    for label, own, base in templates:
        k = min(4, len(own))
        lines = {}
        for p in range(len(w) - k + 1):
            for a in range(len(own) - k + 1):
                if w[p : p + k] == own[a : a + k]:
                    lines.setdefault(p - a, set()).add(a)
        places, last = [], None
        for d in sorted(lines):
            if base or last is None or d - last > 8:
                places.append((d, set()))
            last = d
            places[-1][1].update(a + j for a in lines[d] for j in range(k))
        for d, held in places:
            share = len(held) / len(own)
            if base and share == 1:
                starts.append(d)
                base_labels.add(label)
            if (base and share == 1) or (not base and share >= 0.3):
                best = max(best, share)
                labels |= {label} if share >= 0.6 else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(best, 4)


def test_licenses(spark):
    notice = dict(licenses.NOTICES)
    filler = lambda n: " ".join(random.choices(["the", "of", "license", "mit", "cc", "this", "software", "x1"], k=n))
    gpl = WORD.findall(lower(notice["gpl"]))
    changed = " ".join(gpl[:20] + ["and", "so", "on"] + gpl[22:40] + gpl[44:])
    texts = [None, "", ".,;", "MIT", "MIT License", "the Apache-License; cc by! CC BY mit license, gnu general", "GNU General Public License" * 2, notice["mit"], notice["bsd"].upper(), filler(50) + " " + changed + " " + filler(30), " ".join(gpl[:35]), " ".join(gpl[:12]), " ".join(gpl[:25] + ["z"] * 40 + gpl[25:]), notice["apache"] + " " + notice["mpl"], "mıt license Key cc by", " mit license" * 3000 + " " + filler(20_000), "été cc by"]
    texts += [" ".join(random.choices(gpl, k=200)) for _ in range(5)]
    rows = [*enumerate(texts), (None, texts[7]), (None, texts[7]), (4, texts[4]), (0, texts[4])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = licenses.license_scan(docs).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *scanned(t))) for i, t in rows)
    found = {r.doc_id: r.labels for r in got}
    assert found[7] == "mit" and found[8] == "bsd" and "gpl" in found[9].split(",") and found[13] == "apache,mpl"


def test_licenses_without_templates_or_documents(spark):
    docs = documents(spark, ["mit license", None])
    assert [(r.n_words, r.n_base, r.labels) for r in licenses.license_scan(docs, phrases=[], notices=[]).orderBy("doc_id").collect()] == [(2, 0, ""), (0, 0, "")]
    assert [(r.n_base, r.labels) for r in licenses.license_scan(docs, phrases=[("x", "license")], notices=[]).orderBy("doc_id").collect()] == [(1, "x"), (0, "")]
    assert licenses.license_scan(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ levels of calls


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    """Longest ways, in plain Python: several predecessors, chains, cycles, calls behind cycles, unknown and repeated ids."""
    rng = random.Random(seed)
    rows, want = [], {}
    for conv in (1, 2, 3):
        n = 40
        after = {i: [f"c{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if i else [] for i in range(n)}
        after[5] = ["c5"] if conv == 1 else ["nowhere", None, "c1", "c1"]
        if conv == 2:
            after[10], after[12] = ["c12", "c1"], ["c10"]
        rows += [(conv, f"c{i}", a) for i, a in after.items()]

        def level(i, seen, after=after):
            known = {int(x[1:]) for x in after[i] if x and x != "nowhere"}
            if i in seen:
                return None
            below = [level(k, seen | {i}) for k in known]
            return None if None in below else 1 + max(below) if below else 0

        want |= {(conv, f"c{i}"): level(i, frozenset()) for i in range(n)}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls).collect()}
    assert got == want and max(x or 0 for x in want.values()) > 4 and None in want.values()
