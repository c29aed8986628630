"""Semantics that small fixtures show best."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import ids, models, render, text
from foliospark.operators import chunking, dense, hybrid, selection, sparse, structure
from foliospark.plans import retrieval
from foliospark.plans.skew import split_hot
from foliospark.sources import files, sinks


def test_fold_keeps_every_sentence_and_its_rules(spark):
    rng = random.Random(4)
    cases = [["w " * rng.randint(1, 9) + "." for _ in range(rng.randint(1, 12))] for _ in range(40)] + [["a b c d e f g h", "i j"], ["a", "b c d e f g h i j k", "l"]]

    def plain(sents, limit):
        out, cur, n = [], [], 0
        for s in sents:
            t = len(s.split())
            if n + t > limit:
                out.append(" ".join(cur))
                cur, n = ([cur[-1]], len(cur[-1].split())) if cur else ([], 0)
            cur, n = cur + [s], n + t
        return out + [" ".join(cur)] if cur else out

    cases = [[s.strip() for s in c] for c in cases]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>").withColumn("c", chunking.fold_sentences(F.col("s"), 6))
    got = {r["i"]: r["c"] for r in df.collect()}
    assert all(got[i] == plain(c, 6) for i, c in enumerate(cases))
    assert got[40][0] == ""  # an oversized first sentence


def test_fusion_ties_and_repeats(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, place int")
    b = spark.createDataFrame([(3, 1), (2, 2), (2, 3)], "id long, place int")
    rows = hybrid.fused(a, b, 10).orderBy("place").collect()
    assert [r["id"] for r in rows] == [2, 1, 3]
    assert abs(rows[0]["rrf_score"] - (2 / 62 + 1 / 63)) < 1e-12
    assert [r["id"] for r in hybrid.fused(a, b.limit(0), 1).collect()] == [1]


def test_search_mode_is_checked(spark):
    one = spark.createDataFrame([(1, 1, 0.5)], "id long, place int, score double")
    assert hybrid.search("dense", one, None, 3).count() == 1
    with pytest.raises(ValueError):
        hybrid.search("", one, one, 3)


def test_zero_scores_stay(spark):
    docs = spark.createDataFrame([(1, ["aa", "bb"]), (2, ["cc"]), (3, [])], "id long, tokens array<string>")
    q = spark.createDataFrame([(["aa", "zz"],)], "tokens array<string>")
    for scores in (sparse.tfidf_scores(docs, q), sparse.bm25_scores(docs, q)):
        got = {r["id"]: r["score"] for r in scores.collect()}
        assert got[2] == got[3] == 0.0 and got[1] != 0.0
        assert [r["id"] for r in sparse.top_k(scores, 3).orderBy("place").collect()] == [1, 2, 3]


def test_negative_idf_is_lifted(spark):
    docs = spark.createDataFrame([(i, ["common"] + (["rare"] if i == 0 else [])) for i in range(4)], "id long, tokens array<string>")
    q = spark.createDataFrame([(["common"],)], "tokens array<string>")
    assert all(r["score"] != 0 for r in sparse.bm25_scores(docs, q).collect())


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "chunk_id long, load_seq long, v string")
    for _ in range(2):
        sinks.upsert_table(rows, path, "chunk_id", "load_seq")
        assert sorted(tuple(r) for r in sinks.read_table(spark, path).collect()) == [(1, 2, "b"), (2, 3, "c")]
    sinks.upsert_table(spark.createDataFrame([(2, 9, "d")], rows.schema), path, "chunk_id", "load_seq")
    assert sorted(r["v"] for r in sinks.read_table(spark, path).collect()) == ["b", "d"]
    sinks.reset(spark, path)
    with pytest.raises(LookupError):
        sinks.read_table(spark, path)


def test_rerank_and_thresholds(spark):
    hits = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b a"), (4, None)], "id long, t string")
    assert [r["id"] for r in hybrid.reranked(hits, F.lit("a b"), "t", 2).collect()] == [1, 3]
    assert hybrid.reranked(hits, F.lit("a b"), "t", 0).count() == 4

    def broken(q, t):
        raise OSError

    assert {r["rerank_score"] for r in hybrid.reranked(hits, F.lit("a"), "t", 0, broken).collect()} == {0.0}
    assert [selection.threshold_or_zero(x) for x in (0.4, 1.0, 0, "0.4", None)] == [0.4, 0.0, 0.0, 0.0, 0.0]


def test_models_keep_rows_on_failure(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")

    def broken(_):
        raise OSError

    assert [r[0] for r in df.select(models.keep_udf(broken)(F.col("t"))).collect()] == [True] * 3
    assert [r[0] for r in df.select(models.text_udf(broken, "No summary.", 2)(F.col("t"))).collect()] == ["No summary."] * 3
    v = [r[0] for r in df.select(models.embed_udf()(F.col("t"))).collect()]
    assert len(v[0]) == 64 and v[2] is None


def test_ids_match_python(spark):
    import hashlib
    import uuid

    names = ["x", "पाठ", "", "book.pdf-1-text"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", ids.chunk_key(F.col("n")).alias("k"), ids.image_uuid(F.lit("c"), F.col("n")).alias("u")).collect()
    for r in rows:
        assert r["k"] == int(hashlib.md5(r["n"].encode()).hexdigest()[:16], 16) % 2**63
        assert r["u"] == str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_DNS, "c"), r["n"]))


def test_stems_and_ratio():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "relational": "relat", "happy": "happi", "probate": "probat", "controlling": "control", "adjustment": "adjust", "sky": "sky"}
    assert {w: text.stem(w) for w in pairs} == pairs
    assert text.partial_ratio("abc", "xxabcxx") == 100 and text.partial_ratio("", "a") == 0
    assert text.partial_ratio("Chapter One", "chapter one") < 100
    assert text.hindi_tokens("यह किताब का पाठ पाठ") == ["किताब", "पाठ", "पाठ"]
    assert text.language_tokens("Running dogs", "EN") == ["run", "dog"] and text.language_tokens(None, "en") == []


def test_font_levels_and_carry(spark):
    h = spark.createDataFrame([("d", 0, "A", 20.0), ("d", 1, "## B", 20.0), ("d", 2, "C", 15.0), ("d", 3, "D", None)], "doc_id string, pos int, text string, font_size double")
    assert [(r["text"], r["level"]) for r in structure.font_levels(h).orderBy("pos").collect()] == [("A", 1), ("B", 2), ("C", 2), ("D", 2)]
    t = spark.createDataFrame([("d", 0, 1, "a"), ("d", 1, 2, "b"), ("d", 2, None, "x"), ("d", 3, 0, "z"), ("d", 4, 1, "c")], "doc_id string, pos int, level int, title string")
    got = [tuple(r)[4:] for r in structure.carried_titles(t, "level", "title").orderBy("pos").collect()]
    assert got == [("a", "", "", ""), ("a", "b", "", ""), ("a", "b", "", ""), ("a", "b", "", "z"), ("c", "", "", "")]


def test_header_sizes_from_lines(spark):
    h = spark.createDataFrame([("d", 0, 1, "Intro"), ("d", 1, 1, "Nowhere to be found")], "doc_id string, block_idx int, page int, text string")
    lines = spark.createDataFrame([("d", 1, "Intro", 14.0), ("d", 1, "Intro to it", 12.0), ("d", 2, "Intro", 99.0)], "doc_id string, page int, text string, font_size double")
    assert [(r["text"], r["font_size"]) for r in structure.header_font_sizes(h, lines).collect()] == [("Intro", 13.0)]


def test_context_counts_from_the_end_when_nothing_is_left(spark):
    df = spark.createDataFrame([(["a b c d", "e"],)], "t array<string>")
    cut = lambda q, budget: df.select(hybrid.context(F.col("t"), F.lit(q), budget, 0)).first()[0]
    assert cut(1, 3) == "a b" and cut(5, 4) == "a b c" and cut(90, 1) == ""


def test_partitioned_index_finds_near_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 0.1) for _ in range(8)]) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embeddings array<float>")
    ivf = dense.PartitionedIndex.fit(df, "embeddings", 10)
    q = rows[7][1]
    exact = {r["chunk_id"] for r in dense.top_k(df, spark.createDataFrame([(q,)], "q array<double>"), 5).collect()}
    found = {r["chunk_id"] for r in ivf.search(ivf.assign(df, "embeddings"), q, 5, 4).collect()}
    assert len(exact & found) >= 4


def test_batch_top_k_of_repeated_ids(spark):
    rows = [(1, [0.1, 0.0])] * 40 + [(2, [9.0, 9.0]), (2, [0.2, 0.0])] + [(i, [0.1 * i, 0.0]) for i in range(3, 30)] + [(99, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embeddings array<float>").coalesce(1)
    near = dense.batch_top_k(df, spark.createDataFrame([(5, [0.0, 0.0])], "query_id long, q array<double>"), 4)
    assert [(r["id"], round(r["distance"], 4)) for r in near.orderBy("place").collect()] == [(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)]


def test_batch_query_takes_the_last_delivery(spark, tmp_path):
    chunks = [(1, n, [0.0, 0.1]) for n in range(30)] + [(2, 0, [0.0, 0.0]), (2, 1, [5.0, 5.0])] + [(i, 0, [0.0, 0.1 * i]) for i in range(3, 15)]
    spark.createDataFrame(chunks, "chunk_id long, load_seq long, embeddings array<float>").coalesce(1).write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = retrieval.dense_batch_topk(spark, str(tmp_path)).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_hot_groups_meet_once(spark):
    rows = spark.createDataFrame([(7 if i < 40 else i, i) for i in range(60)], "k long, id long")
    parts = split_hot(rows, "k", "id", 10).collect()
    groups = {}
    for r in parts:
        groups.setdefault(r["k"], []).append(r)
    met = set()
    for g in groups.values():
        ask, other = [r["id"] for r in g if r["asks"]], [r["id"] for r in g if not r["asks"]]
        for a in ask or other:
            for b in other:
                if a != b:
                    met.add((min(a, b), max(a, b)))
    assert {(a, b) for a in range(40) for b in range(a + 1, 40)} <= met
    assert max(map(len, groups.values())) < 40


def test_sources(spark, tmp_path):
    import io
    import json
    import zipfile

    d = tmp_path / "in" / "English" / "b"
    d.mkdir(parents=True)
    (d / "chunks.json").write_text(json.dumps([{"chunk_id": "a", "page_content": "x", "page_numbers": [2, 1]}, {"chunk_id": "b"}]))
    rows = {r["chunk_id"]: r for r in files.chunk_files(spark, str(tmp_path / "in")).collect()}
    assert rows["a"]["page_numbers"] == "[2,1]" and rows["b"]["page_numbers"] == "[]" and rows["b"]["filename"] == "" and rows["b"]["page_content"] is None
    arr = files.json_array(spark, str(d / "chunks.json"), files.CHUNK_FILE).orderBy("pos").collect()
    assert [r["chunk_id"] for r in arr] == ["a", "b"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in ("ok/a.txt", "__MACOSX/a", "../evil", "/abs"):
            z.writestr(n, n)
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    z = files.archive_members(files.binary_files(spark, str(tmp_path), "*.zip")).collect()
    assert [r["member"] for r in z] == ["ok/a.txt"]
    words = files.parsed(files.binary_files(spark, str(tmp_path), "*.zip"), lambda b: [{"page": 1, "text": "w"}] if b[:2] == b"PK" else 1 / 0, files.WORDS)
    assert [(r["doc_id"], r["text"]) for r in words.collect()] == [("a.zip", "w")]
    html = spark.createDataFrame([("<html><head><title>t</title></head><body><script>x<1</script>A &amp; <b>B</b></body></html>",)], "h string")
    assert html.select(files.html_text(F.col("h"))).first()[0] == "A & B"
    assert files.Settings.load(env={"FOLIO_K": "7", "FOLIO_SCORE_THRESHOLD": "3", "FOLIO_TOP_R": "x"}) == files.Settings(k=7)


def test_images_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("c", "n", "data:image/png;base64,aGk=")], "collection string, name string, uri string")
    path = sinks.export_images(rows, str(tmp_path / "img")).first()["path"]
    assert open(path, "rb").read() == b"hi"
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    cache = spark.createDataFrame([(1, "old")], "k long, v string")
    got = files.cached(keys, cache, lambda m: m.withColumn("v", F.lit("new")), "k").collect()
    assert sorted(map(tuple, got)) == [(1, "old"), (2, "new")]


def test_changed_files_and_kept(spark):
    files_ = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    man = spark.createDataFrame([("a", "1", True, True, True), ("b", "2", True, None, True), ("c", "9", True, True, True)], "path string, sha256 string, has_text boolean, has_tables boolean, has_images boolean")
    assert sorted(r["path"] for r in selection.changed_files(files_, man).collect()) == ["b", "c"]
    assert render.filled("x {a} {b}", a=F.lit("1")) is not None


def test_empty_tables(spark):
    v = spark.createDataFrame([], "chunk_id long, embeddings array<float>")
    q = spark.createDataFrame([], "query_id long, q array<float>")
    assert dense.batch_top_k(v, q, 3).count() == 0
    docs = spark.createDataFrame([], "id long, tokens array<string>")
    one = spark.createDataFrame([(["a"],)], "tokens array<string>")
    assert sparse.tfidf_scores(docs, one).count() == 0 and sparse.bm25_scores(docs, one).count() == 0


def test_stored_index_scores_as_the_fit(spark, tmp_path):
    rows = [(1, ["aa", "bb", "bb"]), (2, ["cc", "aa"]), (3, []), (4, ["dd", "bb", "aa", "aa"]), (5, ["aa"])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    sparse.save_index(docs, str(tmp_path / "ix"))
    index = sparse.SparseIndex.load(spark, str(tmp_path / "ix"))
    for tokens in (["bb", "cc", "bb", "zz"], ["aa"], ["zz"], []):
        q = spark.createDataFrame([(tokens,)], "tokens array<string>")
        for fit, stored in ((sparse.tfidf_scores, sparse.indexed_tfidf), (sparse.bm25_scores, sparse.indexed_bm25)):
            a, b = ({r["id"]: round(r["score"], 9) for r in x.collect()} for x in (fit(docs, q), stored(index, q)))
            assert a == b and len(a) == 5
    plan = sparse.indexed_bm25(index, spark.createDataFrame([(["aa"],)], "tokens array<string>"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,aa)" in plan


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).selectExpr("id AS chunk_id", "id AS load_seq", "cast(id as string) AS v")
    sinks.upsert_table(rows, path, "chunk_id", "load_seq", 8)
    first = sinks._folders(spark, path, 1)
    sinks.upsert_table(spark.createDataFrame([(7, 900, "new")], rows.schema), path, "chunk_id", "load_seq", 8)
    second = sinks._folders(spark, path, 2)
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    got = {r["chunk_id"]: r["v"] for r in sinks.read_table(spark, path).collect()}
    assert len(got) == 200 and got[7] == "new" and got[8] == "8"
    with pytest.raises(RuntimeError):
        sinks._commit(spark, path, 2, {})


def test_titles_match_without_regard_to_case(spark):
    headers = spark.createDataFrame([("d", 1, 0, "INTRODUCTION TO OPTICS"), ("d", 2, 0, "Nothing alike")], "doc_id string, block_idx int, page int, text string")
    toc = spark.createDataFrame([("d", 0, "Introduction to Optics", 2), ("d", 1, None, 1)], "doc_id string, pos int, title string, level int")
    assert {r["block_idx"]: r["level"] for r in structure.toc_matches(headers, toc).collect()} == {1: 2, 2: None}
    lines = spark.createDataFrame([("d", 0, "introduction to optics", 14.0), ("d", 0, "another line", 9.0)], "doc_id string, page int, text string, font_size double")
    assert [(r["block_idx"], r["font_size"]) for r in structure.header_font_sizes(headers, lines).collect()] == [(1, 14.0)]


def test_event_lines(spark):
    lines = ['data: {"choices":[{"delta":{"content":"Hel"}}]}', 'data: {"choices":[{"text":"lo"}]}', 'data: {"text":"x"}', "data: [DONE]", ": ping", 'data: {"n":1,"a":" ","b":"first","c":"second"}', "data: plain", 'data: "quoted"', 'data: {"choices":[{"delta":{"role":"a"}}]}', 'data: {"n":1}', 'data: {"choices":[],"b":"y"}', None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r["t"] for r in df.select("i", render.sse_text(F.col("line")).alias("t")).collect()}
    assert [got[i] for i in range(len(lines))] == ["Hel", "lo", "x", None, None, "first", "plain", "quoted", None, None, "y", None, None]


def test_service_and_command_line(spark, tmp_path, capsys):
    import json

    from foliospark import service
    from foliospark.__main__ import main
    from foliospark.plans.search import Store

    folder, store = tmp_path / "in" / "a", Store(str(tmp_path / "store"))
    folder.mkdir(parents=True)
    texts = ["The river runs past the stone bridge", "Copper is sold at the market", "Flüsse fließen im Winter", "The lens bends the light", ""]
    (folder / "chunks.json").write_text(json.dumps([{"page_content": t, "filename": f"f{i % 2}.pdf", "type": "text", "language": "German" if "ü" in t else "English", "page_numbers": [i]} for i, t in enumerate(texts)]))
    svc = service.Service(spark, store, lambda body: iter(["It is ", "here."]), lambda: {"data": [{"id": "m"}]}, slots=1)
    assert svc.reference({"prompt": "river"})[1] == 503 and svc.db_status() == ({"ready": False, "message": service.NOT_INGESTED}, 200)
    assert main(["ingest", "--path", str(tmp_path / "in"), "--store", store.path], spark) == 0
    assert "TOTAL" in capsys.readouterr().out and svc.db_status() == ({"ready": True}, 200) and svc.health()[1] == 200
    body, status = svc.reference({"prompt": "the stone bridge", "num_docs_reranker": 2})
    assert status == 200 and len(body["documents"]) == 2 and body["documents"][0]["page_content"] == texts[0]
    assert [d["language"] for d in svc.reference({"prompt": "the river in Winter", "language": "German"})[0]["documents"]] == ["German"]
    for mode in ("dense", "sparse", "hybrid"):
        got = store.search(spark, "copper market", mode, k=3, r=1, use_reranker=mode == "hybrid").collect()
        assert [r["page_content"] for r in got] == [texts[1]]
    assert store.search(spark, "copper market", threshold=0.99).count() == 1
    assert svc.chat({"messages": []}) == ({"error": service.EMPTY_MESSAGES}, 200)
    ask = {"messages": [{"content": "where?"}], "retrieved_documents": body["documents"]}
    lines, status = svc.chat(ask)
    assert svc.chat(ask)[1] == 429 and "".join(lines).count("data: ") == 3 and svc.chat(ask)[1] == 200
    assert service.NOTHING_FOUND in next(svc.chat({"messages": [{"content": "x"}]})[0]) and svc.models()[0]["data"]
    assert list(service.tail(iter(["a\n", "b\n"]), len)) == [("a\n", 2), ("a\nb\n", 4)]
    assert main(["clean-db", "--store", store.path], spark) == 0 and svc.reference({"prompt": "x"})[1] == 503


def test_conversion_in_page_order():
    tasks, tries = {}, []

    def submit(a, b):
        tries.append(a)
        if len(tries) == 1:
            raise OSError
        tasks[f"t{a}"] = [None, {"pages": (a, b)}]
        return f"t{a}"

    got = files.converted_in_ranges([(16, 30), (1, 15), (31, 40)], submit, lambda t: tasks[t].pop(0), delay=0.01)
    assert [g["pages"] for g in got] == [(1, 15), (16, 30), (31, 40)]
    with pytest.raises(TimeoutError):
        files.converted_in_ranges([(1, 2)], lambda a, b: "t", lambda t: None, wait=0.02, delay=0.01)


def test_outputs_join_by_document(spark):
    t, b, i = (spark.createDataFrame([(d, f"{k}{d}") for d in ids], f"doc_id string, {k} string") for k, ids in (("t", "abc"), ("b", "bc"), ("i", "cab")))
    assert sorted(map(tuple, selection.joined_outputs(t, b, i).collect())) == [("b", "tb", "bb", "ib"), ("c", "tc", "bc", "ic")]
