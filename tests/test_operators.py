import random
import zipfile
from collections import Counter
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from quirelake import config as C
from quirelake.operators import analytics as A
from quirelake.operators import dialog as G
from quirelake.operators import duplicates as D
from quirelake.operators import ingest as I
from quirelake.operators import retrieval as R
from quirelake.operators import store as S
from quirelake.plans import queries as Q
from quirelake.plans import views as V
from quirelake.sources import files
from quirelake.streaming import jobs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ------------------------------------------------------------------ retrieval


def ranked(spark, column, *ids):
    return spark.createDataFrame([(0, i, n + 1) for n, i in enumerate(ids)], f"query_id int, chunk_id int, {column} int")


def test_rrf_is_symmetric_and_keeps_missing_ranks(spark):
    a, b = ranked(spark, "dense_rank", 1, 2), ranked(spark, "sparse_rank", 2, 3)
    got = {r.chunk_id: r for r in R.rrf(a, b).collect()}
    assert got[2].fused_score == pytest.approx(1 / 62 + 1 / 61) and got[1].sparse_rank is None and got[3].dense_rank is None
    other = R.rrf(b.withColumnRenamed("sparse_rank", "dense_rank"), a.withColumnRenamed("dense_rank", "sparse_rank"))
    assert {r.chunk_id: r.fused_score for r in other.collect()} == {k: v.fused_score for k, v in got.items()}


def test_diversify_never_exceeds_the_cap(spark):
    fused = spark.createDataFrame([(0, i, 1.0 / i, None, None) for i in range(1, 9)], "query_id int, chunk_id int, fused_score double, dense_rank int, sparse_rank int")
    chunks = spark.createDataFrame([(i, 1 if i < 6 else i) for i in range(1, 9)], "chunk_id int, document_id int")
    assert [r[0] for r in rows(R.diversify(fused, chunks, 4, 2), "chunk_id")] == [1, 2, 6, 7]


def test_dense_blocks_equal_one_block(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(20)], "chunk_id int, vector array<float>")
    q = vectors.filter("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), "vector")
    assert rows(R.dense_search(q, vectors, 3), "query_id", "chunk_id", "dense_rank") == rows(R.dense_search(q, vectors, 3, query_rows=2), "query_id", "chunk_id", "dense_rank")


def test_gate_and_active_model(spark):
    q = spark.createDataFrame([(0,), (1,)], "query_id int")
    res = spark.createDataFrame([(0, 0.03)], "query_id int, fused_score double")
    assert rows(R.confidence_gate(q, res), "query_id", "refused") == [(0, False), (1, True)]
    v = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id int, model_id int")
    p = spark.createDataFrame([("embedding", True, '{"model_id": "2"}'), ("embedding", False, '{"model_id": 1}')], "category string, is_active boolean, config string")
    assert rows(R.active_model(v, p), "chunk_id") == [(2,)]


def test_sparse_takes_every_token(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("the", "a", "of", "lease", "notice", "12", "Ab")) for _ in range(rng.randint(1, 30))) for _ in range(205)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bags = {i: Counter((t or "").lower().split()) for i, t in enumerate(texts)}
    got = {(r.chunk_id, r.token): r.weight for r in V.sparse(spark, str(tmp_path)).collect()}
    assert got == {(i, w): n for i, b in bags.items() for w, n in b.items()}
    want = set()
    for q in (0, 100, 200):
        dots = sorted((-sum(n * bags[q][w] for w, n in b.items()), i) for i, b in bags.items())
        want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(x for x in dots[:20] if x[0])}
    for limit in (R.TOKEN_ROWS, 0):
        R.TOKEN_ROWS, before = limit, R.TOKEN_ROWS
        try:
            found = R.sparse_search(V.token_queries(spark, str(tmp_path)), V.sparse(spark, str(tmp_path)), 20).collect()
        finally:
            R.TOKEN_ROWS = before
        assert {(r.query_id, r.chunk_id, r.score, r.sparse_rank) for r in found} == want


# ------------------------------------------------------------------ duplicates


def test_duplicates(spark):
    base = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "Leave", base), (2, "leave!", "other words"), (3, "X", base.upper()), (4, "Y", base + " eleven twelve"), (5, "Z", "")], "document_id int, title string, text string")
    docs = docs.join(D.fingerprint(docs.withColumn("seq", F.lit(0))), "document_id")
    got = {(r.a, r.b): (r.jaccard, r.reasons) for r in D.pairwise(docs).collect()}
    assert got[1, 3] == (1.0, ["exact"]) and got[1, 2] == (0.0, ["title"]) and got[1, 4] == (0.75, ["near"]) and set(got) == {(1, 3), (1, 2), (1, 4), (3, 4)}
    assert all(0 <= j <= 1 for j, _ in got.values())


def test_shingles(spark):
    f = lambda s: spark.createDataFrame([(s,)], "t string").select(D.shingles(F.col("t"))).head()[0]
    assert f("a b c") == ["a b c"] and f("") == [] and f("a b c d e f") == ["a b c d e", "b c d e f"]


def test_chunk_diff(spark):
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    chunks = spark.createDataFrame([(1, 0, "same text here"), (1, 1, "only in a"), (2, 0, "Same text here"), (2, 1, "x y"), (2, 2, "z")], "document_id int, seq int, text string")
    assert rows(D.chunk_diff(pairs, chunks), "a", "b", "only_a", "only_b") == [(1, 2, 1, 2)]


def test_pairs_by_rare_shingles(spark):
    """Against all pairs in plain Python: copies, near copies, parts of others, short texts, texts without words."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    texts = [" ".join(x) for x in base] + ["", "  "]
    for x in base:
        for _ in range(4):
            y = x[rng.randrange(3) :] + [f"v{rng.randrange(9)}" for _ in range(rng.randrange(4))]
            if y and rng.random() < 0.5:
                y[rng.randrange(len(y))] = "new"
            texts.append(" ".join(y))
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in (t.split() for t in texts)]
    want = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            m = len(sets[a] & sets[b])
            if m:
                j, x, y = (float(Decimal(m / k).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for k in (len(sets[a] | sets[b]), len(sets[a]), len(sets[b])))
                if j >= 0.6 or max(x, y) >= 0.75:
                    want.add((a, b, j, x, y))
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    near = D.near_pairs(docs, 0.6).filter("jaccard >= 0.6 OR greatest(a_in_b, b_in_a) >= 0.75")
    assert set(rows(near, "a", "b", "jaccard", "a_in_b", "b_in_a")) == want and len(want) > 30
    more = spark.createDataFrame([(0, 1), (12, 13)], "a int, b int")
    assert {(0, 1), (12, 13)} <= set(rows(D.near_pairs(docs, 0.6, more), "a", "b"))
    assert D.near_pairs(docs.limit(0), 0.6).count() == 0


def test_chunk_diff_against_all_pairs_of_chunks(spark):
    """Equal chunks, repeated ones, near ones (one word more in many) and chunks of other documents, against each chunk with each."""
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (1, 3, 5, 12, 20, 30, 30, 40, 60)]
    pool += [t + " end" for t in pool] + ["start " + t for t in pool[-3:]] + [pool[7].replace(" ", " x ", 1), "a b a b a b a b", "a b a b a b a b a b", ""]
    held = {d: [rng.choice(pool) for _ in range(rng.randrange(9))] for d in range(12)}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}
    like = lambda x, y: len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) >= 0.9
    lone = lambda a, b: sum(1 for x in held[a] if x and not any(like(x, y) for y in held[b] if y))
    pairs = [(a, b) for a in held for b in held if a < b] + [(3, 99)]
    held[99] = []
    chunks = spark.createDataFrame([(d, i, t) for d, ts in held.items() for i, t in enumerate(ts)], "document_id int, seq int, text string")
    got = D.chunk_diff(spark.createDataFrame(pairs, "a int, b int"), chunks)
    assert rows(got, "a", "b", "only_a", "only_b") == sorted((a, b, lone(a, b), lone(b, a)) for a, b in pairs)
    near = lambda a, b: any(x != y and like(x, y) for x in held[a] for y in held[b] if x and y)
    assert any(near(a, b) for a, b in pairs)


def test_upload_candidates_by_every_reason(spark):
    base = "one two three four five six seven eight nine ten"
    made = lambda rows: (lambda x: x.join(D.fingerprint(x.withColumn("seq", F.lit(0))), "document_id"))(spark.createDataFrame(rows, "document_id int, source_file string, title string, text string, status string"))
    new = made([(1, "new/1", "Leave", base, "active"), (2, "new/2", None, " ", "active"), (3, "old/5", "Pay", "other", "active")])
    old = made([(1, "old/1", "leave!", "words of no kin", "active"), (2, "old/2", "X", base.upper(), "active"), (3, "old/3", "Leave", base, "superseded"), (4, "old/4", "", "", "active"), (5, "old/5", "pay", "other", "active"), (6, "old/6", "LEAVE", base + " eleven", "active")])
    assert rows(D.upload_candidates(new, old), "a", "b", "jaccard", "reasons") == [(1, 1, 0.0, ["title"]), (1, 2, 1.0, ["exact"]), (1, 6, 0.8571, ["near", "title"]), (2, 4, 0.0, ["exact"])]


def test_titles_are_whole_first_lines(spark):
    line = "x" * 70
    df = spark.createDataFrame([(f"{line} a\nb",)], "text string")
    assert df.select(V.title()).head()[0] == f"{line} a"


def test_chunk_diff_of_every_pair_with_a_reason(spark, tmp_path):
    long = "Leave policy " + "x" * 60
    texts = ["one two three four five six seven eight", "one two three four five six seven eight\n" + " ".join(f"w{i}" for i in range(40)), f"{long} a\nfirst words", f"{long} A!\nother things", f"{long} b\nno pair of these", "alone"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(Q.QUERIES["chunk_diff"](spark, str(tmp_path)), "a", "b", "only_a", "only_b") == [(0, 1, 0, 1), (2, 3, 2, 2)]


# ------------------------------------------------------------------ conversations


def turns(spark, *texts):
    return spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")


def test_plan(spark):
    t = turns(spark, "How many leave days do I get in a year as a permanent employee", "You get 21. Want me to go through the work from home option?", "yes", "Fine.", "what about interns", "None.", "Please describe the complete travel reimbursement policy for managers in Germany")
    got = {r.turn: r for r in G.plan_turns(t).collect()}
    assert not got[0].contextualized
    assert got[2].query == "Want me to go through the work from home option?" and got[2].expansions[0].startswith("How many")
    assert got[4].contextualized and got[4].query.endswith("yes what about interns") and (got[4].standalone_weight, got[4].ctx_weight) == (0.5, 1.0)
    assert not got[6].contextualized


def test_advisory(spark):
    t = turns(spark, "what are my options", "A.", "what else", "B.", "how is the weather in the mountains of Norway today")
    assert rows(G.plan_turns(t), "turn", "advisory") == [(0, True), (2, True), (4, False)]


def test_smalltalk(spark):
    phrases = {"greeting": ["hi", "hey", "heyy"], "how_are_you": ["how are you"], "ack": ["ok", "yes"]}
    cases = {"Heyyyy!": "greeting", "hi there": "greeting", "hi how are you": "how_are_you", "hi what is the leave policy": None, "ok": "ack", "": None, "hey yes": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", G.smalltalk(F.col("t"), phrases)).collect()} == cases


LOOKUP = {"max_words": 14, "fillers": ["ok", "please"], "forms": {"whats": "what"}, "source": ["where is this from"], "section": ["what section"], "page": ["page number"], "section_words": ["section", "part"], "page_words": ["page"], "wh": ["where", "which", "what", "from"], "you": ["you"], "verbs": ["get", "found"], "anaphors": ["this", "that"], "tail": ["is", "that", "in", "did", "you", "get", "it", "from"], "exclude": ["covers", "can", "i"]}


def test_lookup(spark):
    cases = {"ok where is this from please": "source", "What section?": "section", "page number": "page", "which part of the handbook is that in": "section", "what page is that": "page", "where did you get that": "source", "which part covers sick leave": None, "what section of the policy covers sick leave": None, "what is leave": None, "ok": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", G.lookup_intent(F.col("t"), LOOKUP)).collect()} == cases


def test_catalog(spark):
    rules = {"max_words": 12, "forms": {"u": "you", "docs": "documents", "rn": ""}, "stopwords": ["do", "to", "the"], "vocab": ["what", "which", "documents", "have", "access", "know"], "nouns": ["documents", "what do you know"]}
    cases = {"what docs do u have access to rn": True, "which documents have sick leave": False, "what do you know": True, "what do you have": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", G.is_catalog_question(F.col("t"), rules)).collect()} == cases


def test_replies(spark):
    r = spark.createDataFrame([(1, 1, 7, "LEAVE POLICY", "LEAVE POLICY > 2. Sick Leave"), (1, 2, 7, "LEAVE POLICY", "LEAVE POLICY > 2. Sick Leave"), (2, 1, 7, "LEAVE POLICY", "x"), (2, 2, 8, "Travel", "Travel > Scope")], "query_id int, rank int, document_id int, document_title string, section_path string")
    got = dict(rows(G.source_reply(r), "query_id", "reply"))
    assert got == {1: "That came from the Leave Policy, in the section 2. Sick Leave.", 2: "That drew on the Leave Policy and Travel."}
    where = dict(rows(G.location_reply(r, generic=["scope"]), "query_id", "reply"))
    assert where[1] == "That's in the Sick Leave section of the Leave Policy." and where[2] == "That's in the x section of the Leave Policy."


# ------------------------------------------------------------------ ingestion


BLOCKS = "document_id string, seq int, kind string, text string, level int, page int, source_type string, ocr_confidence double, row_mismatch boolean"


def block(seq, kind, text, level=None, source="digital_text", conf=None, bad=None):
    return ("d", seq, kind, text, level, 1, source, conf, bad)


def test_sections_follow_a_stack(spark):
    data = [block(0, "heading", "Title", 1), block(1, "paragraph", "intro"), block(2, "heading", "A", 1), block(3, "heading", "B", 3), block(4, "paragraph", "p"), block(5, "heading", "C", 2), block(6, "paragraph", "q"), block(7, "heading", "D", 1), block(8, "paragraph", "r")]
    titles = spark.createDataFrame([("d", "Title")], "document_id string, title string")
    assert rows(I.section_paths(spark.createDataFrame(data, BLOCKS), titles), "seq", "section_path") == [(1, "Title"), (4, "Title > A > B"), (6, "Title > A > C"), (8, "Title > D")]


def test_packing(spark):
    text = " ".join(f"w{i}." for i in range(30))
    df = spark.createDataFrame([(["a b c", "d e f", text],)], "p array<string>")
    got = df.select(I.pack(F.col("p"), F.lit(8))).head()[0]
    assert got[0] == "a b c\n\nd e f" and all(len(x.split()) <= 8 for x in got) and " ".join(got).split() == ["a", "b", "c", "d", "e", "f", *text.split()]


def test_process(spark):
    data = [block(0, "heading", "Leave Rules", 1), block(1, "paragraph", "All staff get twenty one days of leave in each year of work."), block(2, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |", bad=True), block(3, "heading", "Questions", 2), block(4, "paragraph", "Q: May I go?"), block(5, "paragraph", "A: Yes you may."), block(6, "paragraph", "Q: When?"), block(7, "paragraph", "A: Now."), block(8, "paragraph", "  ")]
    stems = spark.createDataFrame([("d", "leave rules")], "document_id string, stem string")
    got = I.process(spark.createDataFrame(data, BLOCKS), stems).orderBy("seq").collect()
    assert [r.chunk_type for r in got] == ["prose", "table", "qa_pair", "qa_pair"] and [r.chunk_id for r in got][:2] == ["leave_rules_0001", "leave_rules_0002"]
    assert "table_conversion_issue" in got[1].qa_flags and got[2].section_path == "Leave Rules > Questions" and got[2].text == "Q: May I go?\n\nA: Yes you may."


def test_summary_makes_chunks_once(spark):
    data = [block(0, "heading", "Rules", 1), block(1, "paragraph", "All staff get twenty one days of leave."), block(2, "table", "| a |", source="ocr", conf=0.5, bad=True)]
    blocks, stems = spark.createDataFrame(data, BLOCKS), spark.createDataFrame([("d", "rules")], "document_id string, stem string")
    got = I.ingestion_summary(I.process(blocks, stems), I.structure_status(blocks))
    assert rows(got, "documents", "chunks", "ocr_pages", "digital_pages", "to_review") == [(1, 2, 1, 1, 1)] and got.head().flags == {"low_ocr_confidence": 1, "table_conversion_issue": 1}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_lines(spark):
    pages = spark.createDataFrame([("d", p, f"Acme Corp\nbody {chr(97 + p) * 3}\nmore\nthings\nto say\nhere\nPage {p}") for p in range(4)], "document_id string, page int, text string")
    assert ("d", "Acme Corp", 4) in rows(I.repeated_lines(pages), "document_id", "key", "n")
    clean = I.strip_repeated(pages, I.repeated_lines(pages)).filter("page = 0").head().text
    assert "Acme" not in clean and "Page" not in clean and "body" in clean


def test_runs(spark):
    lines = spark.createDataFrame([("d", i, t, "paragraph", 1) for i, t in enumerate(["x", "1. a", "2. b", "3. c", "y", "1. z"])], "document_id string, seq int, text string, kind string, page int")
    assert rows(I.collapse_runs(lines), "seq", "kind") == [(0, "paragraph"), (1, "list"), (4, "paragraph"), (5, "paragraph")]


# ------------------------------------------------------------------ store and files


def test_one_active_version(spark):
    old = spark.createDataFrame([("a", "1", "h1"), ("b", "1", "h2"), ("c", "1", "h3")], "source_file string, chunk_id string, content_hash string")
    new = spark.createDataFrame([("a", "1", "h1"), ("b", "1", "other"), ("d", "1", "h4")], "source_file string, chunk_id string, content_hash string")
    actions = S.load_actions(new, old)
    assert rows(actions, "source_file", "action") == [("a", "unchanged"), ("b", "superseded"), ("c", "absent"), ("d", "inserted")]
    docs = old.select("source_file", F.lit(1).alias("version"), F.lit("active").alias("status"))
    after = S.supersede(docs, new.select("source_file"), actions)
    assert rows(after, "source_file", "version", "status") == [("a", 1, "active"), ("b", 1, "superseded"), ("b", 2, "active"), ("c", 1, "active"), ("d", 1, "active")]


def test_status_is_refused_for_a_second_active_version(spark):
    docs = spark.createDataFrame([(1, "a", "active"), (2, "a", "superseded"), (3, "b", "active")], "document_id int, source_file string, status string")
    chunks = spark.createDataFrame([(1, False), (2, True), (3, False)], "document_id int, is_superseded boolean")
    d, c, bad = S.set_status(docs, chunks, spark.createDataFrame([(2, "active"), (3, "superseded")], "document_id int, status string"))
    assert rows(bad, "document_id") == [(2,)] and (3, "superseded") in rows(d, "document_id", "status") and (3, True) in rows(c, "document_id", "is_superseded") and (2, True) in rows(c, "document_id", "is_superseded")


def test_prompts_and_config(spark):
    p = spark.createDataFrame([("core", "text", 1, "a", False), ("core", "text", 2, "b", True)], "name string, channel string, version int, content string, is_active boolean")
    after = S.add_prompts(p, spark.createDataFrame([("core", "text", "c")], "name string, channel string, content string"))
    assert rows(after, "version", "is_active") == [(1, False), (2, False), (3, True)]
    back = S.activate(after, ["name", "channel"], spark.createDataFrame([("core", "text", 1), ("core", "voice", 1)], "name string, channel string, version int"))
    assert rows(back, "version", "is_active") == [(1, True), (2, False), (3, False)]
    conf = spark.createDataFrame([("k", "1"), ("k.voice", "2"), ("j", "3")], "key string, value string")
    assert rows(S.resolve(conf, ["k", "j"], "voice"), "key", "value") == [("j", "3"), ("k", "2")]
    assert C.setting({"k": 1, "k.voice": 2}, "k", "voice") == 2
    with pytest.raises(C.ConfigError):
        C.Config(jaccard=1.5)


def test_tags(spark):
    bridge = spark.createDataFrame([(1, "country", "India")], "document_id int, tag_type string, tag_value string")
    found = spark.createDataFrame([(1, {"country": ["India", "Nepal"], "raw": ["x"]})], "document_id int, tags map<string,array<string>>")
    assert rows(S.add_tags(bridge, found), "tag_value") == [("India",), ("Nepal",)]
    tags = spark.createDataFrame([(d, "country", "India") for d in (1, 2, 3)] + [(4, "country", "Nepal"), (4, "employment_type", "intern")], "document_id int, tag_type string, tag_value string")
    assert rows(A.labels(tags), "document_id", "label") == [(1, None), (2, None), (3, None), (4, "Nepal")]


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('Top', '<w:pStyle w:val=&quot;Heading6&quot;/>').replace('&quot;', chr(34))}{p('text')}{p('item', '<w:numPr/>')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "good.DOCX", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "bad.docx").write_bytes(b"nope")
    (tmp_path / "other.txt").write_text("x")
    got = files.parse(files.scan(spark, str(tmp_path)), {"docx": files.docx_blocks})
    assert rows(got.filter("document_id = 'good.DOCX'"), "seq", "kind", "text", "level") == [(0, "heading", "Top", 4), (1, "paragraph", "text", None), (2, "list", "- item", None), (3, "table", "| a | b |\n| --- | --- |\n| 1 |  |", None)]
    assert got.filter("error IS NOT NULL").count() == 1
    chunks = spark.createDataFrame([("d", 1, "t")], "document_id string, seq int, text string")
    files.write_documents(chunks, str(tmp_path / "out"))
    assert files.read_documents(spark, str(tmp_path / "out")).count() == 1
    assert files.append_log(chunks, str(tmp_path / "log")) and not files.append_log(chunks, "nowhere://x/y")


def test_ocr_and_embedding(spark):
    words = spark.createDataFrame([("d", 1, 1, 1, 1, 1, "Hello", 90.0), ("d", 1, 1, 1, 1, 2, "you", 70.0), ("d", 1, 1, 1, 2, 1, "there", 80.0)], "document_id string, page int, block int, par int, line int, word int, text string, conf double")
    assert tuple(files.ocr_page(words).head())[2:] == ("Hello you\nthere", 0.8)
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    got = files.embed(df, lambda texts: ([[float(len(t))] for t in texts], [{t: 1.0} for t in texts], [len(t) for t in texts]))
    assert sorted(r.token_count for r in got.collect()) == [0, 2]


# ------------------------------------------------------------------ streams


def test_upload_stream(spark, tmp_path):
    schema = "source_file string, chunk_id string, content_hash string"
    src, out = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for n, data in enumerate([[("a", "1", "x"), ("b", "1", "y")], [("a", "1", "z"), ("b", "1", "y")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src / "x"))
        q = jobs.uploads(spark, str(src / "x"), schema).writeStream.foreachBatch(jobs.load_into(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    last = spark.read.parquet(f"{out}/snapshot=000000001")
    assert rows(last, "source_file", "version", "status", "content_hash") == [("a", 1, "superseded", "x"), ("a", 2, "active", "z"), ("b", 1, "active", "y")]


def test_usage_stream(spark, tmp_path):
    schema = "ts timestamp, response_type string, value double"
    spark.createDataFrame([(datetime(2024, 1, 1, 5), "view", 1.0), (datetime(2024, 1, 1, 6), "view", 2.0)], schema).write.parquet(str(tmp_path / "e"))
    q = jobs.usage_by_day(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.avg_value) for r in spark.sql("SELECT * FROM days").collect()] == [(2, 1.5)]


def test_context_stream(spark, tmp_path):
    turns(spark, "first", "a", "second", "b", "third").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "t"))
    q = jobs.followup_context(stream).writeStream.format("memory").queryName("context").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT * FROM context"), "turn", "query") == [(0, "first"), (2, "first second"), (4, "first second third")]


def test_lookup_replay(spark):
    t = turns(spark, "Please describe the complete travel reimbursement policy for managers in Germany", "It covers trains.", "thanks", "Sure.", "where is this from", "The travel policy.", "page number")
    rules = {"max_words": 12, "forms": {}, "stopwords": ["do"], "vocab": ["what", "documents"], "nouns": ["documents"]}
    got = {r.turn: r for r in G.lookup_replay(t, LOOKUP, {"thanks": ["thanks"]}, rules).collect()}
    assert set(got) == {4, 6} and [(r.intent, r.user_turn, r.documented) for r in (got[4], got[6])] == [("source", 0, True), ("page", 0, True)]
    assert got[4]["query"].startswith("Please describe")
    only = turns(spark, "thanks", "Sure.", "where is this from")
    assert [(r.user_turn, r.documented) for r in G.lookup_replay(only, LOOKUP, {"thanks": ["thanks"]}, rules).collect()] == [(0, False)]


def test_replies_do_not_repeat(spark):
    events = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 0), ("b", 1)], "category string, nth int")
    options = spark.createDataFrame([("a", i, f"r{i}") for i in range(3)] + [("b", 0, "only")], "category string, idx int, reply string")
    got = [r.reply for r in G.pick_replies(events, options).filter("category = 'a'").orderBy("nth").collect()]
    assert len(got) == 40 and all(x != y for x, y in zip(got, got[1:])) and len(set(got)) == 3
