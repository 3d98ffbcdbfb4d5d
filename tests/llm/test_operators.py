"""The training-data operators against brute force, libraries, round trips and held-out labels."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, embeddings, fingerprint, html_text, jaccard, language, packing, passages, quality, url_filter
from tessera.llm.hashing import shingle_set
from tessera.llm.queries import remainder

DATA = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a", "a  b", "a \n b", "x<|endoftext|> y", "don't we'll 12 é ñ", "\n\na\n\nb \t c", " a ", "word" * 300, "ΑΣ ΣΑΣ", "a\x1cb", "日本語"]
DOCS = "doc_id long, text string, lang string, score double, x string"  # columns that could clash with an operator's own


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 0.0, "z") for i, t in enumerate(texts)], DOCS)


def some_texts(n=60, seed=5):
    r = random.Random(seed)
    words = ["the", "ing", "ander", "on", "att", "est", "stion", "a", "eé", "zz"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(r.randint(1, 120))) for _ in range(n)]
    near = [t.replace(" ", "  ", 1) if i % 2 else t + " extra" for i, t in enumerate(base[: n // 3])]
    return [*base, *near, *base[:5], "", None, "one", "One", "two words"]


def test_byte_bpe_equals_library():
    own, lib = packing.ByteBpe(open(BYTE, "rb").read()), Tokenizer.from_file(BYTE)
    for t in [*ODD, *filter(None, some_texts(20))]:
        assert own(t) == array("I", lib.encode(t, add_special_tokens=False).ids).tobytes()


def test_packing_places_every_id_once(spark):
    texts = some_texts()
    rows = packing.pack(frame(spark, texts), BYTE, packing.Limits(tokens=64, segments=4, loss=64)).collect()
    lib = Tokenizer.from_file(BYTE)
    ids = {i: array("I", [*lib.encode(t or "", add_special_tokens=False).ids, 0]).tobytes() for i, t in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(ids[d][4 * at : 4 * (at + r["length"])]) == r["ids_crc32"]
            at += r["length"]
        assert 4 * at == len(ids[d])
    for pieces in by_seq.values():
        assert len(pieces) <= 4
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(frame(spark, texts).where("false"), BYTE).count() == 0


def test_packing_holds_all_three_limits(spark):
    r = random.Random(2)
    rows = [(i, " ".join("word%d" % r.randint(0, 99) for _ in range(r.randint(0, 60))), r.choice([None, 0, 3, 20, 500])) for i in range(150)]
    limits = packing.Limits(tokens=64, segments=5, loss=24)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, prompt int"), BYTE, limits, loss_from_col="prompt").collect()
    starts = {i: p or 0 for i, _, p in rows}
    by_seq, ids = {}, {}
    for x in out:
        by_seq.setdefault(x["sequence_id"], []).append(x)
        ids[x["doc_id"]] = ids.get(x["doc_id"], 0) + x["length"]
    assert ids == {x["doc_id"]: x["doc_tokens"] for x in out} and len(ids) == len(rows)
    loss = lambda x: max(0, x["start"] + x["length"] - max(x["start"], starts[x["doc_id"]]))
    full = [(sum(x["length"] for x in s), len(s), sum(map(loss, s))) for s in by_seq.values()]
    assert all(t <= 64 and n <= 5 and v <= 24 for t, n, v in full)
    assert any(v == 24 and t < 64 for t, _, v in full) and any(t == 64 for t, _, v in full)  # each limit is met somewhere
    least = max(sum(t for t, _, _ in full) / 64, sum(v for _, _, v in full) / 24, sum(n for _, n, _ in full) / 5)
    assert len(full) <= 1.25 * least + 8


def test_chat_counts_by_a_tokenizer(spark):
    lib = Tokenizer.from_file(BYTE)
    turns = [(1, i, ("user", "assistant")[i % 2], "word " * (i * 7)) for i in range(30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    budget = chat.Budget(300, 60)
    got = chat.format_windows(df, budget, BYTE).orderBy("window").collect()
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = list(chat.windows(((role, text) for _, _, role, text in turns), budget, count))
    assert [(w["text"], w["tokens"]) for w in got] == [(w["text"], w["tokens"]) for w in want] and len(got) > 5
    assert all(w["tokens"] <= 300 or w["turns"] == 1 for w in got)


def test_transducer_equals_library():
    own, lib = bpe.Transducer(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    r = random.Random(1)
    long = ["".join(r.choice(["the", "ing", "a", "e", "t", "st"]) for _ in range(900)) for _ in range(8)] + ["a" * 3000, "#" * 4000]
    for t in [*ODD, *long]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == want
        assert own.joined(want) == lib.decode(want, skip_special_tokens=False)
    d = bpe.Decoder()
    assert "".join(d.feed(own.token_of[i]) for i in own.ids("héllo wörld 日本")) + d.close() == "héllo wörld 日本 "


def test_round_trip_rows(spark):
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, [None, "Hi there"]), WORD).collect()}
    lib = Tokenizer.from_file(WORD)
    ids = lib.encode("Hi there", add_special_tokens=False).ids
    assert got[0]["n_tokens"] == 0 and got[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_round_trip_decodes_the_ids():
    own, lib = bpe.Transducer(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    assert own.spaced
    for t in ODD:
        want = lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)
        assert bpe.digests(own, t)[2:] == (hashlib.sha256(want.encode()).hexdigest(), len(want))
    right = own.pieces("there")
    own.pieces = lambda text: [(str(own.vocab["a</w>"]), right[0][1], 1)]
    assert bpe.digests(own, "there")[2] == hashlib.sha256(b"a</w>").hexdigest()
    d = bpe.Decoder(spaced=True)
    assert d.feed_all([]) + d.feed("a") + d.feed_all(["b", "c"]) + d.close() == "a b c"


def test_transducer_needs_its_lookahead_and_no_more_memory():
    data, lib = open(WORD, "rb").read(), Tokenizer.from_file(WORD)
    own, hasty = bpe.Transducer(data), bpe.Transducer(data, look=0)
    r = random.Random(2)
    words = ["".join(r.choice(["the", "ing", "a", "e", "tion", "st", "un"]) for _ in range(500)) for _ in range(10)]
    assert [own.ids(w) for w in words] == [lib.encode(w, add_special_tokens=False).ids for w in words] != [hasty.ids(w) for w in words]
    given, read = 0, []
    for t in own.stream(read.append(1) or s for s in own._word_symbols(words[0])):
        given += len(t)
        assert len(read) - given <= own.look + own.STEP  # what is held


def test_digests_do_not_depend_on_parts():
    own, lib = bpe.Transducer(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    text = " ".join(filter(None, [*ODD, *some_texts(20)])) + " "
    ids = lib.encode(text, add_special_tokens=False).ids
    want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert all(bpe.digests(own, text, size)[:3] == want for size in (1, 7, 100, 1 << 18))
    long = "naïve words, again " * 300_000  # 5.7 million characters
    ids = lib.encode(long[:19], add_special_tokens=False).ids
    assert bpe.digests(own, long)[:2] == (300_000 * len(ids), hashlib.sha256(" ".join(map(str, ids * 300_000)).encode()).hexdigest())


def test_chat_round_trip(spark):
    r = random.Random(0)
    parts = ["<|", "[INST]", "</s>", "\\", "|>", "ok ", "\n", "<|end|>\n", "<|turn|>", "é", "\r"]
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "system", "a\nb"]), "".join(r.choice(parts) for _ in range(r.randint(0, 50)))) for _ in range(r.randint(0, 10))]
        ws = list(chat.windows(iter(turns), chat.Budget(100, 40)))
        assert [t for w in ws for t in chat.parse(w["text"])[w["repeated"] :]] == turns
        loss = "".join(chat.unescape(w["text"][s["start"] : s["start"] + s["length"]]) for w in ws for s in w["loss"])
        assert loss == "".join(t for role, t in turns if role == "assistant")
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    assert {x["conv_id"]: x["n_turns"] for x in chat.read_back(chat.format_windows(df)).collect()} == {1: 2, None: 1}


def components_of(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, k, percent, monkeypatch):
    texts = some_texts(40)
    r = random.Random(9)
    seedling = texts[0].split() + texts[1].split() + texts[2].split()
    for _ in range(30):  # near copies of one text
        w = list(seedling)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = str(r.random())
        texts.append(" ".join(w))
    sets = [set(shingle_set(t, k).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = components_of(links, range(len(texts)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # so that groups have several blocks
    monkeypatch.setattr(jaccard, "SHARD", 900)  # and the texts several shards and ranges
    monkeypatch.setattr(jaccard, "RANGE", 500)
    got = {x["doc_id"]: x for x in jaccard.components(frame(spark, texts), k, percent).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) for i, s in enumerate(sets))


def test_jaccard_repeated_ids_and_odd_rows(spark):
    a, b = " ".join(map(str, range(60))), " ".join(map(str, range(100, 160)))
    rows = [(1, a), (5, a + " x"), (5, b), (None, a), (7, None), (8, ""), (9, b)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, text_hash=jaccard.F.xxhash64("text")).collect()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert {k: r["component_id"] for k, r in by.items()} == {(1, 56): 1, (5, 57): 1, (5, 56): 5, (None, 56): None, (7, 0): 7, (8, 0): 8, (9, 56): 5}
    assert by[1, 56]["component"] == by[5, 57]["component"] != by[5, 56]["component"] == by[9, 56]["component"]
    assert by[None, 56]["component"] is None and by[7, 0]["component"] is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(empty).collect() == [] and jaccard.components(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1


def test_segments_and_prefixes():
    t = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    values, counts = jaccard.Segment.unpack(jaccard.Segment.pack(t, np.arange(len(t))), len(t))
    assert (values == t >> np.uint64(16)).all() and (counts == np.arange(len(t))).all()
    r = jaccard.range_of(t, 7)
    assert (np.diff(r) >= 0).all() and set(r) == set(range(7))
    for percent in (80, 90):
        for a in range(1, 200):
            for b in range(a, a * 100 // percent + 1):
                x, y = jaccard.size_class(np.array([a, b]), percent)
                assert y - x <= 1


def test_embeddings_against_brute_force(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(150, 16))
    x[100:130] = x[0] + 0.1 * g.normal(size=(30, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(200, x[3].tolist(), 1), (201, None, 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [1.0], 1)]
    u = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i < 201}
    links = [(i, j) for i in u for j in u if i != j and u[i] @ u[j] >= 0.9]
    comp = components_of(links, [r[0] for r in rows])
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(a == i for a, _ in links), comp[i], comp[i] == i)


def test_embeddings_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "STRIP", 5)
    monkeypatch.setattr(embeddings, "HELD", 3)
    r = random.Random(3)
    x = [[r.choice([-3, -1, 0, 1, 1, 2, 3, 9]) for _ in range(6)] for _ in range(150)]
    for _ in range(150):  # (10, 0, ...) and (9, a, b, ...) with a^2 + b^2 + ... = 19, moved about: cosine 0.9
        signs, places = [r.choice([-1, 1]) for _ in range(6)], r.sample(range(6), 6)
        for v in ([10, 0, 0, 0, 0, 0], r.choice([[9, 3, 3, 1, 0, 0], [9, 1, 3, 3, 0, 0], [9, 4, 1, 1, 1, 0]])):
            k = r.choice([1, 3, 0.5])
            x.append([signs[i] * v[places[i]] * k for i in range(6)])
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    links = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and any(x[i]) and any(x[j]) and dot(x[i], x[j]) / (dot(x[i], x[i]) * dot(x[j], x[j])) ** 0.5 >= 0.9]
    tied = sum(dot(x[i], x[j]) / (dot(x[i], x[i]) * dot(x[j], x[j])) ** 0.5 == 0.9 for i, j in links)
    assert tied > 200
    comp = components_of(links, range(len(x)))
    rows = [(i, [float(c) for c in v], 7, "r") for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int, rep string")).collect()}
    for i, row in got.items():
        assert (row["n_links"], row["component_id"]) == (sum(a == i for a, _ in links), comp[i])
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
    odd = spark.createDataFrame([(None, [1.0]), (None, [1.0]), (3, [1e300]), (4, [1e-300]), (5, None)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embeddings.near_duplicates(odd).collect()) == [(0, 0), (0, 0), (3, 1), (4, 1), (5, 0)]


def test_fingerprints_against_brute_force(spark):
    texts = some_texts(30)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, texts)).collect()}
    n = len(texts)
    assert len(got) == n
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % n] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        a, b, c = (set(fingerprint.units(s).tolist()) for s in (t, edited, after))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(near(a, b)) and got[i]["near_next"] == pytest.approx(near(a, c))
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == edited)


def test_url_filter(spark):
    urls = [None, "no scheme", "http://Shop.Example.ORG/es/1", "http://example.org/en/12?q", "http://x.com/fr/", "ftp://bad.net/list/", "http://good.net", "http://notorg/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/")], "verdict string, host string, path string")
    listed = spark.createDataFrame([("bad.net/list",)], "url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, listed).collect()}
    assert got == {0: ("", None, "allow"), 1: ("", None, "allow"), 2: ("shop.example.org", "example.org/es/", "block"), 3: ("example.org", "example.org/en/1", "block"), 4: ("x.com", "com/fr/", "allow"), 5: ("bad.net", None, "block"), 6: ("good.net", None, "allow"), 7: ("notorg", None, "allow")}
    assert url_filter.judge(pages, rules.where("false"), listed.where("false")).where("verdict = 'block'").count() == 0


def test_html(spark):
    page = '<body><nav><a>Menu one two</a></nav><div id="content"><h1>Title</h1><p>First &amp; more words in a line that is long.<aside>box</aside><div class="ad">Buy</div><p>Second  <b>bold</b> words here.</div><section class="comments"><p>Great article indeed, thanks.</p></section><footer>c</footer>'
    w = html_text.Weights({("p", True): 90, ("p", False): 1, ("<p", True): 30, ("<body", False): 9})
    assert html_text.extract(page, w) == "Title\n\nFirst & more words in a line that is long.\n\nSecond bold words here."
    assert [html_text.extract(h, w) for h in (None, "", "<script>x", "<p", "<<>>")][:3] == ["", "", ""]
    df = spark.createDataFrame([(1, "u", None), (1, "u", None)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_text.main_text(df, html_text.learn(df)).collect()] == [0, 0]


def test_best_region_against_every_region():
    r = random.Random(6)
    for _ in range(300):
        x = [r.choice([-6, -2, -1, 0, 1, 2, 5]) for _ in range(r.randint(0, 14))]
        first, end = html_text.best_region(x)
        assert sum(x[first:end]) == max([sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)] + [0])


def test_html_by_learned_weights():
    """Pages whose class names say nothing: what c1, c2 and c3 hold comes from labelled pages alone."""
    r = random.Random(4)
    words = lambda n: " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(n))
    links = lambda n: "".join(f"<a href=x>{words(2)}</a> " for _ in range(n))

    def page(main, text, middle=""):
        return f"<body><div class=c1>{links(20)}</div><div class=c2>{words(30)}</div><{main}><div class=c3><h2>{text[0]}</h2><p>{text[1]}</p></div>{middle}<div class=c3><p>{text[2]}</p></div></{main}><div class=c4>{words(25)}</div><div>{words(5)}</div></body>"

    counts = html_text.Counter()
    for _ in range(20):
        counts.update(html_text.observed(page("main", [words(6), words(40), words(50)])))
    learned, default = html_text.Weights(counts), html_text.Weights({})
    assert learned.left_out == {"div.c1", "div.c2", "div.c4"}
    text = [words(6), words(40), words(50)]
    plain = page("div", text, f"<div class=c2>{words(30)}</div>")
    assert html_text.extract(plain, learned) == "\n\n".join(text)
    assert html_text.extract(plain, default) != html_text.extract(plain, learned)
    scores, texts = html_text.scored(plain, learned)
    first, end = html_text.best_region(scores)
    assert 0 < first < end < len(scores) and any(t and t.strip() for t in texts[end:])  # the scan itself leaves the close out
    big = "<article>" + "<p>some words here</p>" * 200_000 + "</article>"  # 4.4 MB
    assert html_text.extract(big, learned).count("some words here") == 200_000


def test_quality_learns_from_every_passage(spark, monkeypatch):
    texts = ["word " * 40_000, "short text"]
    seen = []
    monkeypatch.setattr(quality.AttentionMil, "fit", lambda self, bags, y: seen.extend(map(len, bags)) or self)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    quality.learn(frame(spark, texts), labels, quality.F.lit(True))
    assert seen == [len(quality.features(t)) for t in texts] and seen[0] > 128


def test_passages_do_not_depend_on_slices(monkeypatch):
    r = random.Random(8)
    text = "  " + "".join(r.choice(["Ab", "cd ", "X|y. ", "12", "é\n", "same same ", "w" * 900 + " "]) for _ in range(4000))
    whole = passages.features(text)
    for size in (1, 2, 7):
        monkeypatch.setattr(passages, "SLICE", size * passages.PASSAGE)
        assert np.allclose(passages.features(text), whole, atol=1e-6)
    monkeypatch.undo()
    long = "some words, 12 of them. " * 250_000  # 6 MB
    x = passages.features(long)
    assert len(x) == 10_000 and np.allclose(x[50:-1, :15].std(0), 0, atol=0.05)
    assert len(jaccard.shingle_set(long, 5)) == 5 and fingerprint.likeness(*[fingerprint.units(long)] * 2) == 1
    assert (language.counts(long) == language.counts("some words, 12 of them. ") * 250_000).sum() > language.SIZE - 10


def test_attention_against_a_plain_loop():
    g = np.random.default_rng(3)
    bags = [g.normal(size=(int(g.integers(1, 9)), passages.SIZE)).astype(np.float32) for _ in range(60)]
    y = np.array([float(b[:, 3].max() > 1) for b in bags])
    m = quality.AttentionMil().fit(bags, y, rounds=200)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for b in bags[:10]:
        h = [np.tanh(np.clip((x - m.mean) / m.dev, -8, 8) @ m.p["W"] + m.p["b"]) for x in b]
        e = [np.exp((np.tanh(v @ m.p["V"]) * sig(v @ m.p["G"])) @ m.p["u"]) for v in h]
        z = sum(w * v for w, v in zip(e, h, strict=True)) / sum(e)
        assert m.score(b) == pytest.approx(sig(z @ m.p["w"] + m.p["c"][0]), abs=1e-6)
    assert np.mean([(m.score(b) >= 0.5) == (t > 0.5) for b, t in zip(bags, y, strict=True)]) > 0.9
    assert quality.AttentionMil().fit(bags, np.ones(60)).score(bags[0]) > 0.5 and quality.AttentionMil().fit([], np.zeros(0)).score(bags[0]) == 0.5


def test_centroids_against_a_plain_loop():
    texts = {"de": ["der die das und", "ein die und nicht", "das ist der"], "en": ["the and of that", "this is the of", "and that this"]}
    rows = [(k, language.counts(t)) for k, v in texts.items() for t in v]
    m = language.Centroids(rows, clusters=2)
    assert len(m.points) == 4 and np.allclose(np.linalg.norm(m.points, axis=1), 1, atol=1e-5)
    for t in ["das und der", "that and the", "xyz qqq"]:
        c = language.counts(t)
        v = np.log1p(c) * m.idf
        near = [float(p @ v / np.linalg.norm(v)) for p in m.points]
        best = max(range(4), key=lambda i: near[i])
        lang, score, rejected = m.predict(t)
        assert lang == m.langs[m.owner[best]] and rejected == (near[best] < m.floor[lang]) and 0 <= score <= 1
    assert m.predict("qzx jjj vvv")[2] and not m.predict("der die das und")[2]


def test_training_rows_of_languages_are_bounded(spark):
    rows = [(i, "a text of words", f"l{i % 40}" if i % 3 else "en", 1.0, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    ids = language.training_ids(docs, language.F.lit(True), per_lang=5, most=60).collect()
    by = {}
    for r in ids:
        by.setdefault(r["lang"], []).append(r["doc_id"])
    assert len(ids) == 60 and len(by) == 41 and all(len(v) <= 5 for v in by.values())
    assert sorted(by["en"]) == sorted(r["doc_id"] for r in docs.where("lang = 'en'").orderBy(language.F.xxhash64("doc_id")).limit(len(by["en"])).collect())


def test_sketches_grow_until_they_peel(monkeypatch):
    g = np.random.default_rng(1)
    sizes = []
    made = fingerprint.Sketch.__init__
    monkeypatch.setattr(fingerprint.Sketch, "__init__", lambda self, keys, cells=fingerprint.CELLS: (sizes.append(cells), made(self, keys, cells))[1])
    for common, only in ((500, 3), (500, 40), (5000, 200), (0, 900), (3, 0)):
        keys = g.integers(1, 1 << 63, common + 2 * only, dtype=np.uint64)
        a, b = keys[: common + only], np.concatenate((keys[:common], keys[common + only :]))
        sizes.clear()
        x, y = fingerprint.difference(a, b)
        assert set(x.tolist()) == set(a.tolist()) - set(b.tolist()) and set(y.tolist()) == set(b.tolist()) - set(a.tolist())
        assert max(sizes) <= max(fingerprint.CELLS, 16 * only)  # cells follow the difference, not the texts


def test_quality_and_language_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, remainder(3) != 1)
    out = quality.scored(docs, model, ["doc_id"]).join(labels, "doc_id").where(remainder(3) == 1).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in out]) > 0.95
    lang = language.learn(docs, remainder(5) != 0)
    out = language.identified(docs, lang, ["doc_id", "lang"]).where(remainder(5) == 0).collect()
    assert np.mean([r["lang"] == r["language"]["lang"] for r in out]) > 0.95
    odd = frame(spark, [None, "", "123 !!"])
    assert {r["language"]["lang"] for r in language.identified(odd, lang, ["doc_id"]).collect()} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in quality.scored(odd, model, ["doc_id"]).collect())
    assert quality.scored(odd.where("false"), model, ["doc_id"]).count() == 0
