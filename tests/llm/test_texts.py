import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import languages, leakage, lookalikes, near_duplicates, packing, queries, scans, splitting, subjects
from foliospark.llm.samples import bounded_sample

WORDS = "river stone garden window paper silver mountain bridge yellow winter engine village candle market forest thunder pocket ladder marble copper".split()


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- look-alikes ---


def test_same_look():
    same = ["paper café", "рареr café", "pa\u200bper café", "ｐａｐｅｒ café", "paper cafe\u0301", "paper\u00ad café"]
    assert len({lookalikes.canonical(t) for t in same}) == 1
    for other in ("paper  café", "paper cafe", "Paper café", "papers café"):
        assert lookalikes.canonical(other) != lookalikes.canonical(same[0])
    assert lookalikes.canonical("") == "" and lookalikes.plain("⼀ﬁ①Å") == "一fi1Å"


def test_automaton():
    t = lookalikes.Trie({"language": 5, "Ianguage": 9, "index": 2, "lndex": 1, "fill": 2, "fell": 3, "2019": 4, "once": 1})
    read = lambda w: t.read(lookalikes.pattern(w))
    assert read("ӏаnguаge") == "Ianguage" and read("ӏndех") == "lndex"  # the palochka looks like both; the more frequent word
    assert read("2О19") == "2019" and read("ӏike") is None
    assert read("fжll") == "fell"  # an unlisted letter: the more frequent of fill and fell
    assert read("onжe") is None  # met once only
    assert lookalikes.pattern("café") is None and lookalikes.pattern("жжll") is None and lookalikes.pattern("Δt") is None
    for w in ("ӏаnguаge", "2О19", "fжll", "lоnжer"):
        p = lookalikes.pattern(w)
        assert lookalikes.shard_of(p) in lookalikes.shards_of({"ӏаnguаge": "language", "2О19": "2019", "fжll": "fell", "lоnжer": "longer"}[w])


def test_tries_decide(spark):
    rows = [(1, "a language of stone, garden"), (2, "a Ӏanguage of stone, garden"), (3, "(in 2019) river"), (4, "(in 2О19) river"), (5, "the village market"), (6, "the viꓲlage market"), (7, "the vжllage market"), (8, "the village fair village")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("word", F.lit("x"))
    by_table = {tuple(r) for r in lookalikes.lookalike_pairs(df, "id", "t", tries=False).collect()}
    by_tries = {tuple(r) for r in lookalikes.lookalike_pairs(df, "id", "t").collect()}
    assert by_table == set() and by_tries == {(1, 2), (3, 4), (5, 6), (5, 7), (6, 7)}


def test_lookalike_pairs(spark):
    rows = [(1, "paper", 0), (2, "рaper", 0), (2, "рaper", 1), (3, "paper", 0), (4, None, 0), (5, "", 0), (6, "​", 0), (7, "stone", 0)]
    df = spark.createDataFrame(rows, "id long, t string, looks int")
    got = {tuple(r) for r in lookalikes.lookalike_pairs(df, "id", "t").collect()}
    assert got == {(1, 2), (2, 3), (5, 6)}
    assert lookalikes.lookalike_pairs(df.limit(0), "id", "t").count() == 0


# --- near duplicates ---


def brute_similarity(a, b):
    wa = {a[i : i + 20] for i in range(len(a) - 19)}
    wb = {b[i : i + 20] for i in range(len(b) - 19)}
    return len(wa & wb) / len(wa | wb)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        base = prose(rng).split()
        texts.append(" ".join(base))
        for _ in range(i % 4):
            edit = list(base)
            for _ in range(rng.randint(0, 9)):
                edit[rng.randrange(len(edit))] = rng.choice(WORDS)
            texts.append(" ".join(edit))
    texts += [texts[0], texts[0].upper(), "short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("same", F.lit(1))
    norm = {i: near_duplicates.normalized(t) for i, t in enumerate(texts) if t and len(near_duplicates.normalized(t)) >= 120}
    true = {(a, b) for a in norm for b in norm if a < b and brute_similarity(norm[a], norm[b]) >= 0.6}
    got = [tuple(r) for r in near_duplicates.similar_pairs(df, "id", "t").collect()]
    assert set(got) == true and len(got) == len(true) > 60
    groups = {r["id"]: r for r in near_duplicates.similar_groups(df, "id", "t").collect()}
    assert set(groups) == set(norm) and groups[len(texts) - 5]["class_id"] == 0
    assert near_duplicates.similar_pairs(df.limit(0), "id", "t").count() == 0


def test_hot_shards(spark, monkeypatch):
    rng = random.Random(2)
    base = prose(rng, 80)
    rows = [(i, base + " " + WORDS[i % 20] + str(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string")
    monkeypatch.setattr(near_duplicates.shard_rows, "__defaults__", (0, 30))
    assert near_duplicates.similar_pairs(df, "id", "t", 0.6).count() == 120 * 119 // 2


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, (700, 2), dtype=np.uint64)
    s[300:] = s[:400] ^ (np.uint64(1) << rng.integers(0, 63, (400, 2), dtype=np.uint64))
    tree = near_duplicates.BKTree(s, leaf=16)
    got = {(int(a), int(b)) for qa, mb in tree.within(s, np.arange(700), 10) for a, b in zip(qa, mb)}
    d = np.bitwise_count(s[:, None, 0] ^ s[None, :, 0]).astype(int) + np.bitwise_count(s[:, None, 1] ^ s[None, :, 1])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 10))}


def test_window_hashes_are_per_window():
    t = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"
    h = near_duplicates.window_hashes(t)
    assert len(h) == len(t) - 19 and h[0] == h[26] and len(set(h.tolist())) == 26


# --- splitting ---


@pytest.mark.parametrize("limit", [3, 7, 25, 400])
def test_pieces(limit):
    rng = random.Random(limit)
    text = "\n".join(" ".join(prose(rng, rng.randint(1, 12)).capitalize() + "." for _ in range(rng.randint(1, 5))) + ("\n" if rng.random() < 0.4 else "") for _ in range(12))
    units = splitting.split_sentences(text)
    n = lambda s, e: len(splitting.TOKEN.findall(text[s:e]))
    pieces = splitting.pack(text, units, limit)
    assert all(n(s, e) <= limit for s, e in pieces)
    covered = sorted(pieces)
    assert covered[0][0] == units[0][0] and covered[-1][1] == units[-1][1]
    starts = {s for s, _ in units}
    whole = [p for p in pieces if p[0] in starts]
    for (s1, e1), (s2, _) in zip(whole, whole[1:]):
        nxt = next((u for u in units if u[0] >= e1), None)
        if nxt and n(*nxt) <= limit:
            assert n(s1, nxt[1]) > limit  # the longest run
        assert s2 > s1
    assert splitting.pack("", [], 5) == []


def test_pieces_of_table(spark):
    rows = [(1, "Ax be cy. Dx ex fy. Gx hx iy.", "", "text", False, "[3]", "c"), (1, "Ax be cy. Dx ex fy. Gx hx iy.", "", "text", False, "[3]", "c"), (2, None, "", "text", False, None, "c"), (3, "A b c d e f g h.", "", "text", False, "[]", "none")]
    df = spark.createDataFrame(rows, "chunk_id long, page_content string, source string, type string, ocr boolean, page_numbers string, collection string")
    st = spark.createDataFrame([("c", 6, 1), ("x", None, 1)], "collection string, emb_max_tokens int, overlap_sentences int")
    got = sorted(map(tuple, splitting.piece_rows(df, st).collect()))
    assert got == [(1, 0, 19, "[3]", False), (1, 10, 29, "[3]", True)]
    assert splitting.piece_rows(df.limit(0), st).count() == 0


def test_pieces_overlap_as_set(spark):
    text = "Ax be. Cx de. Ex fe. Gx he. Ix je."  # sentences begin at 0, 7, 14, 21 and 28
    sets = {"none": 0, "null": None, "one": 1, "two": 2, "many": 9}
    df = spark.createDataFrame([(i, text, "", "text", False, "[]", c) for i, c in enumerate(sets)], "chunk_id long, page_content string, source string, type string, ocr boolean, page_numbers string, collection string")
    st = spark.createDataFrame([(c, 6, n) for c, n in sets.items()], "collection string, emb_max_tokens int, overlap_sentences int")
    got = {}
    for r in splitting.piece_rows(df, st).orderBy("chunk_id", "piece_start").collect():
        got.setdefault(list(sets)[r["chunk_id"]], []).append((r["piece_start"], r["piece_end"], r["repeated"]))
    apart, one, two = [(0, 20, False), (21, 34, False)], [(0, 20, False), (14, 34, True)], [(0, 20, False), (7, 27, True), (14, 34, True)]
    assert got == {"none": apart, "null": apart, "one": one, "two": two, "many": two}
    fixed = splitting.piece_rows(df, st, 1).orderBy("chunk_id", "piece_start").collect()
    assert [(r["piece_start"], r["piece_end"], r["repeated"]) for r in fixed] == one * 5
    assert splitting.pack("Ax be. Cx de. A b c d e f g. Hx ie.", [(0, 6), (7, 13), (14, 28), (29, 35)], 4, 2) == [(0, 13), (14, 21), (22, 28), (29, 35)]


def test_structure_has_sections_and_lists():
    text = "# One\nFirst text. More text.\n\n- item a\n- item b\nafter.\n## Two\nInner.\n# Three\nLast.\n3.1 Sub heading\nEnd."
    units = splitting.split_sentences(text)
    tree = splitting.structure(text, units)

    def shown(node):
        s, e, children = node
        return [shown(c) for c in children] if children else text[s:e].strip()

    one = [["# One", ["First text.", "More text."]], [["- item a", "- item b"], "after."], ["## Two", "Inner."]]
    assert shown(tree) == [one, [["# Three", "Last."], ["3.1 Sub heading", "End."]]]
    flat = lambda n: [tuple(n[:2])] if not n[2] else [x for c in n[2] for x in flat(c)]
    assert flat(tree) == units and splitting.structure("", []) == [0, 0, []]


def plain_pieces(text, units, limit, overlap):
    """The rule read off word by word, one sentence after the other."""
    n = lambda s, e: len(splitting.TOKEN.findall(text[s:e]))
    pieces, k, first, fresh = [], 0, 0, True
    while k < len(units):
        s, e = units[k]
        if n(s, e) > limit:
            marks = [m.span() for m in splitting.TOKEN.finditer(text, s, e)]
            for i in range(0, len(marks), limit):
                part = marks[i : i + limit]
                pieces.append((s if i == 0 else part[0][0], e if i + limit >= len(marks) else part[-1][1]))
            k, fresh = k + 1, True
            continue
        at = k
        if not fresh:
            while at > first and k - at < overlap and n(units[at - 1][0], e) <= limit:
                at -= 1
        first, start, fresh = at, units[at][0], False
        while k < len(units) and n(start, units[k][1]) <= limit:
            k += 1
        pieces.append((start, units[k - 1][1]))
    return pieces


def test_pieces_of_whole_tables_against_the_plain_rule(spark):
    import os

    from foliospark.llm import queries

    sf = os.environ.get("FOLIO_TEST_SF", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    chunks = {r["chunk_id"]: r for r in splitting.clean_text(spark.read.parquet(f"{sf}/chunks.parquet")).collect()}
    limits = {r["collection"]: r for r in spark.read.parquet(f"{sf}/settings.parquet").collect()}
    want = set()
    for cid, r in chunks.items():
        st = limits.get(r["collection"])
        off = splitting.content_offset(r["page_content"], r["source"])
        body = r["page_content"][off:]
        if st and st["emb_max_tokens"] and len(splitting.TOKEN.findall(body)) > st["emb_max_tokens"]:
            want |= {(cid, s + off, e + off) for s, e in plain_pieces(body, splitting.split_sentences(body), st["emb_max_tokens"], st["overlap_sentences"] or 0)}
    assert {tuple(r)[:3] for r in queries.p4_pieces(spark, sf).collect()} == want and want


# --- languages ---

TEXTS = {
    "English": ["The river runs past the old stone bridge in winter.", "She sold copper and silver at the village market.", "They walked through the forest with a candle and a ladder."],
    "German": ["Der Fluss fließt im Winter an der alten Brücke vorbei.", "Sie verkaufte Kupfer und Silber auf dem Markt im Dorf.", "Er ging mit einer Kerze und einer Leiter durch den Wald."],
    "Chinese": ["河水在冬天流过古老的石桥。", "她在村里的市场上卖铜和银。", "他们带着蜡烛和梯子走过森林。"],
}


def label_table(spark):
    return spark.createDataFrame([("English", "en", "English"), ("German", "de", "Deutsch"), ("Chinese", "zh", "中文")], "language string, iso_code string, native_name string")


def test_segments(spark):
    rng = random.Random(6)
    rows = [(len(TEXTS) * i + j, " ".join(rng.sample(t, 3)), "", "text", n) for i in range(40) for j, (n, t) in enumerate(TEXTS.items())]
    e, g, c = (TEXTS[n] for n in ("English", "German", "Chinese"))
    extra = [(1001, " ".join(e), "", "text", None), (1002, " ".join(g), "", "text", " DE "), (1003, " ".join(g), "", "text", "english"), (1004, e[0] + " " + g[0] + " " + g[1] + " " + c[0], "", "text", "German"), (1005, None, "", "text", None), (1006, "  ", "", "text", None), (1003, " ".join(g), "", "text", "english"), (1007, "12, 13, 14.", "", "text", None)]
    df = spark.createDataFrame(rows + extra, "chunk_id long, page_content string, source string, type string, language string")
    got = sorted(tuple(r)[:3] for r in languages.language_segments(df, label_table(spark)).where("chunk_id > 1000").collect())
    a, b = len(e[0]) + 1, len(e[0] + g[0] + g[1]) + 3
    assert got == [(1001, 0, "English"), (1003, 0, "German"), (1004, 0, "English"), (1004, a, "German"), (1004, b, "Chinese")]
    assert languages.language_segments(df.limit(0), label_table(spark)).count() == 0


def test_models_are_distributions():
    m = languages.Models({"English": [languages.folded(t) for t in TEXTS["English"]], "German": [languages.folded(t) for t in TEXTS["German"]]})
    seen = sorted({ord(c) for t in TEXTS["English"] for c in t.lower()})
    ctx = "the"
    total = sum(np.exp(m.score(languages.folded(ctx + chr(c)))[-1, m.names.index("English")]) for c in seen)
    assert 0.97 < total < 1.001


LANGUAGE_WORDS = {
    "English": WORDS,
    "German": "fluss stein garten fenster papier silber gebirge brücke winter maschine dorf kerze markt wald donner tasche leiter marmor kupfer gelb".split(),
    "Chinese": "河水 石桥 花园 窗户 纸张 白银 高山 冬天 机器 村庄 蜡烛 市场 森林 雷声 口袋 梯子 大理石 铜".split(),
}


def spoken(rng, name, n=9):
    gap, end = ("", "。") if name == "Chinese" else (" ", ". ")
    return "".join(gap.join(rng.choice(LANGUAGE_WORDS[name]) for _ in range(n)).capitalize() + end for _ in range(4)).strip()


def test_languages_without_labels_are_rejected(spark):
    rng = random.Random(4)
    rows = [(3 * i + j, spoken(rng, n), "", "text", n) for i in range(120) for j, n in enumerate(LANGUAGE_WORDS)]
    strange = ["Река течёт зимой мимо старого каменного моста.", "Το ποτάμι κυλά δίπλα στην παλιά πέτρινη γέφυρα.", "강물은 겨울에 오래된 돌다리를 지나 흐른다.", "Il fiume scorre accanto al vecchio ponte di pietra.", "xqzj wvkp ttrq lmnb zxcv qqwp kjhg fdsa", "12 34 567"]
    rows += [(1000 + i, t, "", "text", None) for i, t in enumerate(strange)] + [(2000 + i, spoken(rng, n), "", "text", None) for i, n in enumerate(LANGUAGE_WORDS)]
    df = spark.createDataFrame(rows, "chunk_id long, page_content string, source string, type string, language string")
    got = {r["chunk_id"]: r for r in languages.language_segments(df, label_table(spark)).where("chunk_id >= 1000").collect()}
    assert {k: r["language"] for k, r in got.items()} == {2000 + i: n for i, n in enumerate(LANGUAGE_WORDS)}
    assert all(r["confidence"] > 0.9 for r in got.values())


def test_confidence_is_a_hit_rate():
    rng = random.Random(5)
    m = languages.fit([(n, spoken(rng, n), None) for _ in range(150) for n in LANGUAGE_WORDS])
    seg = languages.Segmenter(m)
    said, right = [], []
    for _ in range(400):
        n = rng.choice(["English", "German"])
        c = languages.folded(spoken(rng, n)[:8])
        name, confidence = seg._named(m.sentence_scores(c, np.array([[0, 8]]))[0], 8)
        said.append(confidence)
        right.append(name == n)
    assert abs(np.mean(said) - np.mean(right)) < 0.1
    assert np.all(np.diff(m.rates) >= 0) and m.rates[-1] > 0.95


# --- packing ---


@pytest.mark.parametrize("capacity", [10, 64])
def test_containers(capacity):
    rng = np.random.default_rng(5)
    ids, tokens = np.arange(300), np.minimum(rng.geometric(0.08, 300), 150)
    tokens[:3] = 0
    rows = packing.assignment(ids, tokens, capacity)
    room = {}
    got = {}
    for w, i, part, s, e in rows:
        room[w] = room.get(w, 0) + e - s
        got.setdefault(i, []).append((part, s, e))
    assert max(room.values()) <= capacity and sum(room.values()) == tokens.sum()
    for i, parts in got.items():
        assert sorted(parts)[0][1] == 0 and max(e for _, _, e in parts) == tokens[i]
        assert len(parts) == max(1, -(-int(tokens[i]) // capacity))
    assert 1 - tokens.sum() / (len(room) * capacity) < 0.08


def test_fill_containers(spark):
    try:
        packing.encoder()
    except OSError:
        pytest.skip("no tokenizer file")
    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, ""), (3, None), (4, "word " * 90)], "doc_id long, text string")
    c = spark.createDataFrame([("small", 32), ("none", None)], "container_type string, capacity_tokens int")
    rows = packing.fill_containers(df, c).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 4} and sum(r["doc_id"] == 1 for r in rows) == 1
    assert max(r["part"] for r in rows) == 2
    assert packing.fill_containers(df.limit(0), c).count() == 0


def test_lookalike_classes_meet_before_their_members(spark):
    rows = [(i, "fee of a cat") for i in range(30)] + [(100 + i, "fee of a c\u0430t") for i in range(20)] + [(200, "f\u0435e of a cat"), (201, "dog"), (201, "dog")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert lookalikes.class_pairs(lookalikes.canonical_keys(df, "id", "text")).count() == 3
    got = [tuple(r) for r in lookalikes.lookalike_pairs(df, "id", "text").collect()]
    assert len(got) == len(set(got)) == 30 * 20 + 30 + 20
    assert set(got) == {(a, b) for a, t in rows for b, u in rows if a < b and t != u and "dog" not in (t, u)}


# --- leakage ---


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    items = [(i, f"If Bob{i} sells {rng.randint(2, 99)} sacks of {rng.choice(WORDS)} to Ann{i} for {rng.randint(2, 99)} coins, how many are left by {1900 + i}?") for i in range(30)] + [(98, None), (99, "too short")]
    docs = []
    for d in range(80):
        q = items[d % 30][1].split()
        kind = d % 4
        body = q if kind == 0 else q[3:13] if kind == 1 else q[:9] if kind == 2 else [w.replace("Bob", "Tom").replace("2", "7") for w in q]
        docs.append((d, prose(rng, 8) + ".  " + " - ".join(body).upper() + " " + prose(rng, 5)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]

    find = leakage._words()

    def brute(d, q):
        a, b = find((d or "").lower()), find((q or "").lower())
        runs = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
        return any(tuple(a[i : i + 10]) in runs for i in range(len(a) - 9))

    true = {(d, i) for d, t in docs for i, q in items if brute(t, q)}
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    ii = spark.createDataFrame(items, "item_id long, question string")
    got = [tuple(r) for r in leakage.leaks(dd, ii).collect()]
    assert set(got) == true and len(got) == len(true) >= 30
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0
    other = {r["doc_id"] for r in leakage.reparameterised(dd, ii).collect()}
    assert {d for d in range(80) if d % 4 == 3} <= other


def test_every_template_of_a_document(spark, monkeypatch):
    cart = "the cart of {} rolls {} metres down the long wet ramp behind the old mill of {} before noon"
    vessel = "a vessel named {} carries {} barrels of salted fish past the white cliffs toward the harbour of {} each week"
    tower = "when the tower bell in {} strikes {} times every single clerk inside the town hall of {} stands up"
    name = lambda i: "xyz" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    forms = [cart, vessel, tower]
    items = [(i, forms[i % 3].format(name(i), 100 + i, name(i + 30))) for i in range(30)]
    docs = [(1, cart.format("qqa", 7, "qqb") + ". " + vessel.format("qqc", 8, "qqd")), (2, tower.format("qqe", 9, "qqf")), (3, ". ".join(f.format("qqg", 5, "qqh") for f in forms)), (4, "nothing of it")]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string")
    right = [(1, 0), (1, 1), (2, 2), (3, 0), (3, 1), (3, 2)]
    assert sorted(map(tuple, leakage.reparameterised(dd, ii).collect())) == right
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 7)  # the same from blocks too small to tell template words
    assert sorted(map(tuple, leakage.reparameterised(dd, ii).collect())) == right


def test_placeholders_alone_are_no_template(spark):
    rng = random.Random(4)
    rare = lambda: "".join(rng.choice("bcdfghjklmnp") + rng.choice("aeiou") for _ in range(5))
    ii = spark.createDataFrame([(i, " ".join(rare() for _ in range(14))) for i in range(200)], "item_id long, question string")
    dd = spark.createDataFrame([(i, " ".join(rare() for _ in range(40))) for i in range(200)], "doc_id long, text string")
    assert leakage.reparameterised(dd, ii).count() == 0


CART = "the cart of {} rolls {} metres down the long wet ramp behind the old mill of {} before noon"


def _as_in_sql(spark, docs, items):
    """Rows of the three queries on these tables, each the same as by its SQL twin."""
    con = duckdb.connect()
    for name, cols, rows in (("documents", "doc_id BIGINT, text VARCHAR", docs), ("eval_items", "item_id BIGINT, question VARCHAR", items)):
        con.execute(f"CREATE TABLE {name} ({cols})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string")
    out = {}
    for name, run in (("p9_found", leakage.leaks), ("p9_templates", leakage.reparameterised), ("p9_links", leakage.reparameterised_items)):
        out[name] = sorted(map(tuple, run(dd, ii).collect()), key=str)
        assert out[name] == sorted(con.execute(queries.oracle_sql()[name]).fetchall(), key=str), name
    return out


def test_every_item_of_a_template(spark):
    items = [(i, CART.format("xy" + "abcdef"[i], 10 + i, "zy" + "abcdef"[i])) for i in range(6)] + [(7, CART.format("same", 3, "same"))]
    docs = [(1, CART.format("ab", 5, "cd")), (2, "so: " + items[4][1]), (3, "the cart of ab rolls home")]
    out = _as_in_sql(spark, docs, items)
    assert out["p9_templates"] == [(1, 0), (2, 0)]
    assert {i for d, i in out["p9_links"] if d == 1} == {0, 1, 2, 3, 4, 5, 7} and {i for d, i in out["p9_links"] if d == 2} >= {0, 1, 2, 3, 5}


def test_odd_letters_and_ids_leave_no_item_out(spark):
    plain = [(900 + i, "zz " + " ".join(CART.replace("{}", "").split()[::-1])) for i in range(3)]  # its words are template words
    one = lambda doc, item: _as_in_sql(spark, [doc], [item, *plain])
    text = CART.format("ab", 4, "cd")
    for doc, item in (
        (text.upper().replace("I", "\u0130"), CART.format("ix", 5, "y")),  # dotted capital I
        (CART.format("ab", 4, "\u2460x"), CART.format("ab", 5, "x")),  # a circled digit is no number
        ("the cart of ab rolls down the old mill before", "the cart of \u2460 rolls down the old mill before"),
    ):
        assert one((1, doc), (0, item))["p9_templates"] == [(1, 0)]
    greek = text.replace("down", "\u03c0\u03c1\u03bf\u03c3").upper()
    assert one((1, greek.replace("\u03a3 ", "\u03a3'")), (0, greek))["p9_found"] == [(1, 0)]  # a final sigma by its neighbours
    assert one((None, text), (0, CART.format("x", 5, "y")))["p9_links"] == [(None, 0)]
    assert one((1, text), (None, text))["p9_found"] == [(1, None)]


def test_several_questions_of_one_item(spark):
    dd = spark.createDataFrame([(1, CART.format("ab", 4, "cd")), (2, "a quite different text " + " ".join("klmnopqrstuv"))], "doc_id long, text string")
    items = [(5, " ".join("klmnopqrstuv")), (5, CART.format("ab", 4, "cd")), (5, CART.format("ab", 4, "cd")), (6, CART.format("x", 7, "y")), (8, CART.format("u", 7, "v"))]
    ii = spark.createDataFrame(items, "item_id long, question string")
    assert sorted(map(tuple, leakage.leaks(dd, ii).collect())) == [(1, 5), (1, 6), (1, 8), (2, 5)]
    assert sorted(map(tuple, leakage.reparameterised_items(dd, ii).collect())) == [(1, 6), (1, 8)]


def test_template_words_of_other_blocks(spark, monkeypatch):
    items = [(i, CART.format("xy" + "abcdef"[i], 10 + i, "zy" + "abcdef"[i])) for i in range(6)]
    items += [(10 + i, CART.replace("ramp", "{}").format("ab", 7, "rs" + "abcd"[i], "cd")) for i in range(4)]
    docs = [(1, CART.replace("ramp", "white").format("ab", 7, "cd")), (2, CART.format("ab", 7, "cd"))]
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 4)  # blocks of which some lack the word ramp
    _as_in_sql(spark, docs, items)


# --- scans ---


def test_scanned_text():
    rng = random.Random(9)
    ed = scans.fit([(". ".join(prose(rng, 9).capitalize() for _ in range(6)) + ".", ["Stone Bridge of Talo", "Copper Market"]) for _ in range(300)])
    text = (
        "The rnarket and the paper engine of the candle river and the wind-\now near the ladder thunder with a pocket marble silver yellow\n[75] STONE BRIDGE OF TALO\n"
        "garden c0pper 17O of the winter bridge and the mountain of the for-\n- 76 -\nest villoge."
    )
    found, out = scans.repairs(ed, text, ["stone bridge of talo", "copper market"])
    assert (text.index("[75]"), "") in found and (text.index("- 76"), "") in found
    for damage, good in (("rnarket", "market"), ("wind-", "window"), ("c0pper", "copper"), ("17O", "170"), ("for-\n", "forest"), ("villoge", "village")):
        assert (text.index(damage), good) in found
    assert "\n" not in out and "of the candle river and the window near the ladder" in out and out.endswith("of the forest village.")
    clean = prose(rng, 20)
    assert scans.repairs(ed, clean, []) == ([], clean)


def test_scans_table(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40) + ".", "", "text", False, "b.pdf") for i in range(60)] + [(100, "river\n- 12 -\nstone", "", "text", True, "b.pdf"), (101, None, "", "text", True, "b.pdf"), (102, "", "", "text", True, None), (100, "river\n- 12 -\nstone", "", "text", True, "b.pdf")]
    df = spark.createDataFrame(rows, "chunk_id long, page_content string, source string, type string, ocr boolean, filename string").withColumn("pos", F.lit("x"))
    toc = spark.createDataFrame([("b.pdf", 0, "River Bridge", 1), ("b.pdf", 1, None, None)], "doc_id string, pos int, title string, level int")
    assert [tuple(r) for r in scans.scan_repairs(df, toc).collect()] == [(100, 6, "")]
    assert [tuple(r) for r in scans.scan_texts(df, toc).collect()] == [(100, "river stone")]
    assert scans.scan_repairs(df.limit(0), toc.limit(0)).count() == 0


def test_scan_counts_cover_the_whole_corpus(spark):
    rng = random.Random(12)
    rows = [(i, "text", False, ". ".join(prose(rng, 9).capitalize() for _ in range(4)) + ".", "s", "f") for i in range(120)]
    rows += [(200 + i, "text", False, "Behold quernstead quernstead lorimer-hall everywhere.", "s", "f") for i in range(2)] + [(200, "text", False, "Behold quernstead quernstead lorimer-hall everywhere.", "s", "f")] * 3
    rows += [(300 + i, "text", True, "river zyglophane stone", "s", "f") for i in range(4)] + [(400, "text", True, "the quemstead of the river by the lorimer-\nhall stone garden window paper silver mountain.", "s", "f")]
    df = spark.createDataFrame(rows, "chunk_id long, type string, ocr boolean, page_content string, source string, filename string")
    toc = spark.createDataFrame([], "doc_id string, title string, pos int")
    clean = {r[0]: r[3] for r in rows if not r[2]}
    right = scans.Editor(list(clean.values()), [r[3] for r in rows if r[2]])
    counts = {r["h"]: r["n"] for r in scans.corpus_counts(df).collect()}
    for kind, table in (("w", right.lexicon), ("l", right.low), ("g", right.grams), ("c", dict.fromkeys(right.compounds, 1))):
        assert {scans._key(kind, t): min(n, scans.MOST) for t, n in table.items() if n} == {h: counts.get(h) for h in (scans._key(kind, t) for t, n in table.items() if n)}
    assert len(counts) == sum(len([1 for n in t.values() if n]) for t in (right.lexicon, right.low, right.grams)) + len(right.compounds)
    sample = scans.bounded_sample(scans.clean_text(df), "chunk_id", scans._label_group(), ["page_content"], 8)
    assert not any("quernstead" in r["page_content"] for r in sample)  # neither the word nor the compound
    assert {r["chunk_id"]: r["text"] for r in scans.scan_texts(df, toc, 8).collect()}[400] == "the quernstead of the river by the lorimer-hall stone garden window paper silver mountain."
    assert (400, 4, "quernstead") in {tuple(r) for r in scans.scan_repairs(df, toc, 8).collect()}


# --- subjects ---

TERMS = {"law": "court judge verdict tenant contract", "sport": "goal referee match league athlete", "physics": "lens magnet pendulum voltage photon"}


def make_docs(rng, n):
    docs, labels = [], []
    for d in range(n):
        areas = rng.sample(sorted(TERMS), rng.choice([1, 1, 2]))
        sents = []
        for k in range(8):
            a = areas[k % len(areas)]
            w = TERMS[a].split()
            sents.append(f"Notes from {rng.choice(WORDS)} explain why the {rng.choice(w)} needs the {rng.choice(w)}.")
        sents.append("This page was left blank on purpose.")
        docs.append((d, " ".join(sents), "src", "c"))
        labels += [(d, a) for a in areas]
    return docs, labels


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(5)
    docs, labels = make_docs(rng, 160)
    seen = {d for d in range(80)}
    docs += [(900, "This page was left blank on purpose. Readers may skip it.", "src", "c"), (901, None, None, None), (902, "", "", ""), (5, docs[5][1], "src", "c")]
    dd = spark.createDataFrame(docs, "doc_id long, text string, source string, collection string").withColumn("subject_area", F.lit(1))
    ll = spark.createDataFrame([x for x in labels if x[0] in seen] + [(3, "unknown"), (4, None)], "doc_id long, subject_area string")
    aa = spark.createDataFrame([(a, "") for a in TERMS], "subject_area string, description string")
    got = {tuple(r) for r in subjects.document_subjects(dd, aa, ll).collect()}
    held = {x for x in labels if x[0] not in seen}
    assert {x for x in got if x[0] >= 80} == held
    assert subjects.document_subjects(dd.limit(0), aa, ll).count() == 0 and subjects.document_subjects(dd, aa, ll.limit(0)).count() == 0


def test_posterior_decides_where_words_disagree():
    m = subjects.Subjects(["law", "sport"])
    m.lexicon = {"judge": (0, 1.0), "court": (0, 1.0), "goal": (1, 1.0), "match": (1, 1.0)}
    m.speaks, m.strays = np.array([0.6, 0.3, 0.5, 0.8, 0.8, 0.8]), np.array([0.02, 0.1, 0.02, 0.8, 0.8, 0.8])
    m.right = np.array([0.97, 0.6, 0.95, 0.9, 0.5, 0.5])
    mixed = "The judge saw a goal."  # one word of each: the lexicon alone takes the first area
    text = f"A goal ended the match. {mixed} {mixed} {mixed} A match has a goal. A match has a goal."
    assert m.document_areas(text, None, None, {}) == ["sport"]
    without = np.array([[v if f != 3 else subjects.SILENT for f, v in enumerate(v)] for v in m.votes(text, None, None)])
    assert m.posteriors(without)[:, :2].argmax(axis=1).tolist() == [1, 0, 0, 0, 1, 1]
    assert m.document_areas("This page was left blank. " * 5, None, None, {}) == [] == m.document_areas("", None, None, {})


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id", "id % 2 AS g", "cast(id as string) AS v")
    a = bounded_sample(df, "id", "g", ["v"], 64)
    assert a == bounded_sample(df.repartition(7), "id", "g", ["v"], 64) and 100 < len(a) <= 128
