"""Operators with exact results, against brute force on small tables with the odd cases."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat, decontam, exact, jaccard, pii, suffix
from quirelake.llm.common import whole
from quirelake.llm.graph import components

DOCS = "doc_id long, text string, n long, id long, digest string"
random.seed(5)
WORDS = [f"w{i}" for i in range(60)]


def ascii_lower(s):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in s)


def odd_texts():
    base = " ".join(random.choice(WORDS) for _ in range(60))
    near = base.split()
    near[30] = "other"
    long = " ".join(random.choice(WORDS) for _ in range(20_000))
    return [None, "", " \t\n", "one", "One", "ÉTÉ", "été", base, base, base.upper(), " ".join(near), long, long + " end", "a b c d", "x" * 900, "y" * 399, "z" * 400, *(" ".join(random.choice(WORDS[:5]) for _ in range(random.randint(1, 12))) for _ in range(40))]


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, i, i, "x") for i, t in enumerate(texts)], schema).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


def test_exact(spark, texts):
    docs = table(spark, texts).union(table(spark, ["base"] * 30).withColumn("doc_id", F.col("doc_id") + 500)).union(spark.createDataFrame([(None, "lone", 0, 0, "x"), (7, "twice", 0, 0, ""), (7, "twice", 0, 0, "")], DOCS))
    groups = defaultdict(list)
    for d, t in docs.select("doc_id", "text").collect():
        groups[ascii_lower(t or "")].append(d)
    for support in (1 / 3, 1 / 2000):
        got = exact.exact_dedup(docs, support=support).collect()
        assert len(got) == docs.count()
        for r in got:
            g = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
            keep = max((x for x in g if x is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(g), r.doc_id == keep)
    assert exact.exact_dedup(docs.limit(0)).count() == 0


def covered(data, size):
    """Of each text, which bytes lie in a string of `size` bytes that also starts elsewhere."""
    count = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k] += 1
                gone[k + size] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def fingerprints(t, words, passage):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    data = " ".join(w).encode()
    return w, suffix.fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]), words, passage)[1].tolist() if data else []


def test_suffix(spark, texts):
    docs = table(spark, texts)
    data = [(t or "").encode() for t in texts]
    prints = [fingerprints(t, suffix.WORDS, suffix.PASSAGE)[1] for t in texts]
    count = Counter(h for each in prints for h in each)
    for least, gram, crowd in ((40, 12, 256), (40, 12, 1), (400, 96, 256)):
        gone = covered(data, least)
        got = {r.doc_id: r for r in suffix.remove_repeats(docs, least=least, gram=gram, crowd=crowd, stride=8, keep_text=True).collect()}
        for i, b in enumerate(data):
            left = bytes(x for x, g in zip(b, gone[i], strict=True) if not g)
            assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept), got[i].kept_sha256) == (len(b), int(gone[i].sum()), left, hashlib.sha256(left).hexdigest())
            assert got[i].n_repeated == sum(count[h] > 1 for h in prints[i])
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_each_count_their_own_passages(spark):
    text = " ".join(f"v{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "lone " + text.replace("v", "u"))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_repeated) for r in suffix.remove_repeats(docs).collect())
    n = len(fingerprints(text, suffix.WORDS, suffix.PASSAGE)[1])
    assert n > 0 and got == [(1, n), (1, n), (2, 0)]


def test_passages_of_fifty_words_are_counted(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(50) for _ in range(20)]
    texts = [f"{say(80)} {p}, {say(i)}" for i, p in enumerate(passages)] + [f"{say(i)}. {p.upper()}; {say(60)}" for i, p in enumerate(passages)] + [say(150), say(300), f"{say(70)} {' '.join(passages[0].split()[:31])} {say(70)}"]
    assert all(len(p) < 390 for p in passages)
    got = {r.doc_id: r for r in suffix.remove_repeats(table(spark, texts)).collect()}
    assert all(r.n_removed == 0 for r in got.values())
    assert all(got[i].n_repeated > 0 for i in range(40)) and all(got[i].n_repeated == 0 for i in range(40, 43))


def test_fingerprints_against_brute_force():
    rng = random.Random(4)
    for n in (0, 4, 5, 9, 60):
        t = " ".join(rng.choice(WORDS[:6]) for _ in range(n))
        w, got = fingerprints(t, 5, 9)
        pairs = {}
        for k in range(len(w) - 4):
            data = " ".join(w[k : k + 9]).encode()
            if k + 9 <= len(w):
                pairs[k] = suffix.fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5, 9)[1].tolist()
        assert all(len(x) == 1 for x in pairs.values()) and set(got) == {x[0] for x in pairs.values()}


def test_repeated_windows_with_large_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", 200)
    shared = "".join(random.choice("abcdef") for _ in range(60))
    texts = [shared + "".join(random.choice("uvwxyz") for _ in range(50)) for _ in range(20)]
    gone = covered([t.encode() for t in texts], 50)
    for crowd in (1, 256):
        got = suffix.remove_repeats(table(spark, texts), least=50, gram=12, crowd=crowd, stride=4).collect()
        assert all(r.n_removed == gone[r.doc_id].sum() >= 60 for r in got)


def test_suffix_array_by_doubling_and_tripling():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 3, 3000).astype(np.uint8), np.uint8(0))
    text[1500:2000] = text[:500]
    want = sorted(range(len(text)), key=lambda i: text[i:].tobytes())
    assert suffix.suffix_array(text, 4000).tolist() == want


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def test_decontamination(spark, texts):
    items = [(0, " ".join(texts[7].split()[5:25])), (1, "a b c"), (2, None), (3, "!!!"), (4, "ÉTÉ"), (5, "One"), (6, " ".join(texts[11].split()[100:140])), (6, "a b c")]
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = brute_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    for d, t in enumerate(texts):
        w, hit, found = brute_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        r = got[d]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    clean = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_winnowing_finds_every_shared_span(spark):
    rng = random.Random(3)
    span = [f"s{i}" for i in range(10)]
    texts = [" ".join([rng.choice(WORDS) for _ in range(k)] + span + [rng.choice(WORDS) for _ in range(9)]) for k in range(25)]
    got = decontam.decontaminate(table(spark, texts), spark.createDataFrame([(0, " ".join(["p", *span, "q"]))], "item_id long, text string")).collect()
    assert all(r.n_hit == 10 for r in got)


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(t or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(spark, texts):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(120)]
    family = []
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
        family.append(" ".join(w))
    every = [*texts, *family]
    sets = {i: shingle_set(t) for i, t in enumerate(every)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(table(spark, every)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.jaccard_classes(table(spark, every).limit(0)).count() == 0


def test_jaccard_repeats_and_null_ids(spark):
    t = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (3, t.upper()), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (3, 3), (9, 9)], key=str)


def test_jaccard_near_copy_without_an_id(spark):
    w = [f"u{i}" for i in range(60)]
    # 4 and 2 are linked only through the row without an id.
    x, y = [f"x{i}" for i in range(6)], [f"y{i}" for i in range(6)]
    texts = [w, [*x, *w[6:]], [*x, *w[6:54], *y]]
    docs = [(4, " ".join(texts[0])), (None, " ".join(texts[1])), (2, " ".join(texts[2])), (None, "quite another text of some words"), (None, "quite another text of some words"), (8, "and one more text that is alone")]
    one, two = shingle_set(docs[0][1]), shingle_set(docs[2][1])
    assert 100 * len(one & two) < 75 * len(one | two)
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(4, 2), (None, 2), (2, 2), (None, None), (None, None), (8, 8)])


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, rng.randint(101, 140)) for _ in range(80)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(v == 100 for k, v in got.items() if 100 <= k < 200) and got[201] == 200


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in KINDS for m in re.finditer(p, t or "") if valid(k, m[0])]


ODD_PII = [
    "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.2.3 1..2.3.4.5 99999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 1 2 3",
    "+1 (415) 555-1234. +49 30 1234567890123456 ++1 23 4567 89", "", None, "a" * 3000 + "@", "x@y a@b.c@d.e.f é@b.co x%+-@d-.e-", "1 2 " * 4000, "+1" * 500, "7" * 30000, "4111111111111111 4111 1111  1111 1111 4111111111111111-", "😀 me@x.org 😀 10.0.0.1",
]


def test_base_spans(spark):
    got = {r.doc_id: r for r in pii.find_pii(table(spark, ODD_PII)).collect()}
    for i, t in enumerate(ODD_PII):
        spans = base_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k, _ in KINDS)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (r.spans + ",").startswith(said)
    assert pii.find_pii(table(spark, ODD_PII).limit(0)).count() == 0


def test_disclosing_terms(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    texts = [f"{filler()} ask Zorblatt at zed@firm.org {filler()}" for _ in range(6)] + [filler() for _ in range(80)]
    got = pii.find_pii(table(spark, texts), with_text=True).collect()
    marked = {r.doc_id: r for r in got if r.n_term}
    assert set(marked) == set(range(6))
    for i, r in marked.items():
        at = texts[i].index("Zorblatt")
        assert f"term:{at}:{at + 8}" in r.spans and "[TERM] at [EMAIL]" in r.sanitised
    assert all(r.sanitised == texts[r.doc_id] for r in got if not r.n_term and not r.n_email)
    # Copies of one text count once: what they alone say is known from one text, which is enough to put it down to a name, not to remove it.
    copies = [texts[0]] * 6 + texts[10:]
    got = pii.find_pii(table(spark, copies), with_text=True).collect()
    assert all("[WORD] [NAME] at [EMAIL]" in r.sanitised for r in got if r.n_email) and sum(r.n_term for r in got) == 12


def found_in(docs):
    return docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text", pii.base_spans(whole(F.col("text"))).alias("spans")).filter(F.size("spans") > 0)


def test_entities_of_every_frequency_are_rated(spark):
    texts = [f"all write here {i}" for i in range(400)] + ["Zorblatt write zed@firm.org here", "call +1 415 555 1234 write here", "qua here 10.0.0.1"]
    docs = table(spark, texts)
    best = pii.ratings(found_in(docs), docs, "text").groupBy("kind", "value").agg(F.max("disclosure").alias("most")).collect()
    assert len(best) == 3 and all(r.most >= pii.DISCLOSURE for r in best)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert "term:0:8" in got[400] and "term:0:4" in got[401] and "term:0:3" in got[402]
    assert not any("term" in got[i] for i in range(400))


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def disclosed(texts):
    """(ratings, spans by text): in plain Python, over distinct texts."""
    kinds = sorted({t for t in texts if t is not None})
    said = {t: [(ascii_lower(m[0]), m.start(), m.end(), m[0]) for m in TERM.finditer(t) if len(m[0]) >= 3 and re.search("[^0-9]", m[0])] for t in kinds}
    n_term = Counter(w for t in kinds for w in {x[0] for x in said[t]})
    n_both = Counter()
    for t in kinds:
        pairs = set()
        for kind, a, b in base_spans(t):
            value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
            pairs |= {(kind, value, w) for w, s, e, _ in said[t] if s < b + pii.CONTEXT and a - pii.CONTEXT < e and not (s < b and a < e)}
        n_both.update(pairs)
    z = pii.BOUND
    rated = {}
    for (kind, value, w), k in n_both.items():
        n, p = n_term[w], k / n_term[w]
        rated[kind, value, w] = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    bad = {w for (_, _, w), x in rated.items() if x >= pii.DISCLOSURE}
    spans = {t: [(s, e) for w, s, e, _ in said[t] if w in bad and not any(s < b and a < e for _, a, b in base_spans(t))] for t in kinds}
    return rated, spans


def test_ratings_and_term_spans_against_brute_force(spark):
    rng = random.Random(9)
    names = ["Ann", "Bo", "ÉTÉ", "x9y", "Carl", "日本語"]
    mail = lambda: rng.choice(["a@b.co", "c.d@e.org", "10.1.2.3", "+1 415 555 1234", "4111 1111 1111 1111"])
    texts = [" ".join(rng.choice([rng.choice(WORDS), rng.choice(names), f"h{rng.randrange(400)}"]) + rng.choice([" ", ", ", "  "]) for _ in range(rng.randrange(40))) + (f" {mail()} " if rng.random() < 0.3 else "") + rng.choice(["", "tail word", "a@b.co, c.d@e.org"]) for _ in range(150)]
    texts += [None, "", texts[3], texts[3], f"{'far ' * 60}a@b.co{' near' * 60}", "a@b.coa@b.co zorb 10.1.2.3"]
    rated, spans = disclosed(texts)
    docs = table(spark, texts)
    got = {(r.kind, r.value, r.term): r.disclosure for r in pii.ratings(found_in(docs), docs, "text").collect()}
    assert got.keys() == rated.keys() and all(abs(got[k] - v) < 1e-9 for k, v in rated.items())
    for r in pii.find_pii(docs).collect():
        t = texts[r.doc_id]
        assert [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")] == (spans[t] if t is not None else [])
    assert sum(map(len, spans.values())) > 20


def test_terms_of_a_very_long_text(spark):
    long = " ".join(f"q{i}z" for i in range(300_000)) + " me@x.org " + "again " * 1000
    got = pii.find_pii(table(spark, [long, "q299999z said", "other", None])).orderBy("doc_id").collect()
    assert got[0].n_term > 10 and got[1].spans == "" and got[0].n_email == 1


def test_disclosing_terms_are_marked_in_all_documents(spark):
    said = [f"Zorblatt write zed@firm.org here {i}" for i in range(9)]
    texts = [f"all write here {i}" for i in range(4000)] + [*said, "all say ZORBLATT here", "all say zorblatts here", "zorblatt, zorblatt 10.0.0.1", "all say ZORBLATT here", None]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts), with_text=True).collect()}
    assert got[4009].spans == got[4012].spans == "term:8:16" and got[4009].sanitised == got[4012].sanitised == "all say [NAME] here" and got[4009].n_term == 1
    assert got[4011].sanitised == "[WORD], [WORD] [IP]" and got[4000].sanitised == "[NAME] write [EMAIL] here 0"
    assert got[4010].n_term == 0 and not any(got[i].n_term for i in range(4000)) and got[4013].spans == ""
    assert {r.doc_id: r.spans for r in pii.find_pii(table(spark, texts)).collect()} == {i: r.spans for i, r in got.items()}


def test_all_entities_of_the_table_are_rated(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = found_in(docs).cache()
    entities = pii.held_entities(found).select("kind", "value").distinct().count()
    rated = pii.ratings(found, docs, "text").select("kind", "value").distinct().count()
    assert entities == rated == 593


def test_chat(spark):
    calls = [(1, "a", 0, "f", '{"y":"q","x":1}', None), (1, "b", 1, "f", '{"y": 3}', "a"), (1, "c", 2, "g", "{}", "b"), (1, "d", 3, "f", "nope", "e"), (1, "e", 4, "f", '{"x":1.5,"z":null}', "d"), (1, "a", 9, "f", '{"x":1}', None), (1, None, 5, "f", "[1]", None), (2, "a", 0, "h", "{}", "gone")]
    results = [(1, "a", 1, "r1"), (1, "a", 2, "r2"), (1, "zz", 3, "r3"), (1, "c", 4, None)]
    schemas = {"f": {"properties": {"x": {"type": "integer", "minimum": 1}, "y": {"type": "string", "minLength": 1}}, "required": ["x"]}, "g": {}}
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    got = chat.link_tool_calls(c, r, schemas).collect()
    said = {(x.conv_id, x.kind, x.call_id, x.turn): (x.depth, x.status, x.errors) for x in got}
    assert said[1, "call", "a", 0] == (0, "ok", []) and said[1, "call", "b", 1] == (2, "invalid", ["kind: y", "missing: x"]) and said[1, "call", "c", 2] == (4, "ok", [])
    assert said[1, "call", "d", 3] == (None, "invalid", ["not an object"]) and said[1, "call", "e", 4][2] == ["kind: x", "unknown: z"] and said[1, "call", "a", 9][1] == "duplicate"
    assert said[2, "call", "a", 0] == (0, "invalid", ["no such function"]) and said[1, "result", "c", 4] == (5, "ok", []) and said[1, "result", "zz", 3][1] == "orphan"
    assert next(x.json for x in got if x.call_id == "a" and x.turn == 0 and x.conv_id == 1 and x.kind == "call") == '{"arguments":{"x":1,"y":"q"},"depth":0,"id":"a","name":"f","type":"call"}'
    assert chat.link_tool_calls(c.limit(0), r.limit(0), schemas).count() == 0


def test_chat_depth_of_a_long_chain(spark):
    c = spark.createDataFrame([(1, f"c{i}", i, "g", "{}", f"c{i - 1}" if i else None) for i in range(70)], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    got = chat.link_tool_calls(c, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), {"g": {}}).collect()
    assert all(x.depth == 2 * x.turn for x in got)


def test_chat_order_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no tables here")
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    calls, results = chat.conversation_events(turns, span=2)
    got = chat.link_tool_calls(calls, results, chat.REPLY).collect()
    users = defaultdict(set)
    for r in turns.filter("role = 'user'").collect():
        users[r.conv_id].add(r.turn)
    level = {(c, t): k for c, at in users.items() for k, t in enumerate(sorted(at))}
    want = Counter((r.conv_id, "call", r.turn, 2 * level[r.conv_id, r.turn]) for r in turns.collect() if r.role == "user")
    want += Counter((r.conv_id, "result", r.turn, 2 * level[r.conv_id, r.turn - 1] + 1 if (r.conv_id, r.turn - 1) in level else None) for r in turns.collect() if r.role == "assistant")
    assert Counter((r.conv_id, r.kind, r.turn, r.depth) for r in got) == want and max(level.values()) > 1
