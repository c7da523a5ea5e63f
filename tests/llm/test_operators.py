"""Brute-force versions, exact round trips and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.llm import exact_dedup, html_wrapper, line_dedup, near_dedup, packing, quality, secret_scan, sentencepiece_viterbi, sharding, url_filter
from quillspan.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, id long, n long, key string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "x y"), (4, "same text here"), (4, "same text here"), (5, "SAME text here"), (6, "é😀 " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.mark.parametrize(
    "run",
    [
        quality.judge, line_dedup.line_dedup, line_dedup.dedup_lines, quality.keep_good, secret_scan.scan, secret_scan.redact, exact_dedup.exact_dedup, near_dedup.near_dedup,
        lambda d: sharding.assign_shards(d, 40), lambda d: packing.best_fit_packing(d, tokenizer("word_bpe_49k.json")), lambda d: sentencepiece_viterbi.encode_and_check(d, tokenizer("piece_bpe_32k.model")),
    ],
)
def test_odd_and_empty_tables(spark, odd, run):
    got = run(odd).collect()
    filtering = run is quality.keep_good
    assert (len(got) <= len(ODD)) if filtering else len({(r.doc_id) for r in got}) == len({i for i, _ in ODD})
    assert run(odd.limit(0)).count() == 0


def test_exact_dedup(spark, odd):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(odd, keep="largest").collect()}
    h = hashlib.sha256(b"same text here").hexdigest()
    assert got[4, h].keep_id == 5 and got[4, h].group_size == 3 and not got[4, h].kept and got[5, h].kept
    assert got[1, hashlib.sha256(b"").hexdigest()].keep_id == 2


def test_jump_hash():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    import numpy as np

    keys = np.array([random.Random(k).getrandbits(64) for k in range(500)], np.uint64)
    for n in (1, 7, 40, 41):
        assert sharding.jump(keys, n).tolist() == [plain(int(k), n) for k in keys]


def test_shards(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('é', cast(id % 50 as int)) text")
    rows = sharding.assign_shards(docs, 40, buckets=5).collect()
    by = Counter(r.shard for r in rows)
    for s, n in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    r = next(r for r in rows if r.doc_id == 3)
    assert r.size == 22 and r.text_crc32 == zlib.crc32("ééé".encode())


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["The", "wörd's", "<|endoftext|>", "x1y2", "İstanbul", "naïve—dash", "日本", "a\x1cb", "don't", "!!"]) for _ in range(rng.choice([0, 3, 40, 900, 3000]))) for _ in range(60)]
    rows = packing.pack(packing.pieces(frame(spark, list(enumerate(texts))), path, capacity=512), 512).collect()
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.length for r in own] == [len(ids[k : k + 512]) for k in range(0, len(ids), 512)]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 512) + 2


def test_packing_memory_is_bounded_within_a_text():
    encoder = packing.WordEncoder(tokenizer("word_bpe_49k.json"), keep=100)
    encoder.encode(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2000)))
    assert sum(len(x) for x in vars(encoder).values() if isinstance(x, dict) and x is not encoder.byte) <= 200


def test_packing_encoder_shares_spellings():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    tried, make = [], encoder.stretch
    encoder.stretch = lambda s: tried.append(s) or make(s)
    variants = "tree Tree TREE tree, Tree. TREE; tree! ÉTÉ été, x"
    assert encoder.encode(variants) == encoder.pack(tok.encode(variants, add_special_tokens=False).ids)
    assert sorted(tried) == sorted(["tree", ",", ".", ";", "!", "été", "x"])
    rng = random.Random(8)
    odd = ["<|ENDOFTEXT|>", "<|endoftext|>,", "<|", "Don't", "don'", "rock'N'roll,", "X'S,", "a.,", '"b",', "é.", "×.", "÷,", "ÀÖØÞß,", "µ,", "ª.", "\xa0,", "\xad;", "a\x1c,", "a\x85.", "İ,", "ΑΣ,", "K.", "1,", "b1.", "_,", "e\u0301,", "日本,", "😀."]
    for some in (odd, [w for w in odd if "<|" not in w and max(w) <= "\xff"]):
        for _ in range(300):
            text = "".join(rng.choice(some) + rng.choice([" ", "  ", "\n", "\t", "\r", "", ""]) for _ in range(rng.randrange(9)))
            assert encoder.encode(text) == encoder.pack(tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model, lib = sentencepiece_viterbi.Viterbi(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdeéñß  \n\t.,;'-0123日本😀thenering") for _ in range(rng.randrange(80)))
        assert model.encode(text) == lib.encode(text) and model.decode(model.encode(text)) == text
    assert model.decode(model.encode("a ▁ b")) == "a ▁ b"
    long = "".join(rng.choice("aehtnr") for _ in range(20_000))
    assert list(model.stream("▁" + long)) == lib.encode(long)


def test_unigram_is_best_path():
    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece_viterbi.Viterbi(path, kind="unigram")
    for text in ("▁there", "thering", "▁the▁xq"):
        best = {0: 0.0}
        for k in range(len(text)):
            for n in range(1, model.longest + 1):
                s = model.scores.get(text[k : k + n])
                if s is not None and k + n <= len(text):
                    best[k + n] = max(best.get(k + n, float("-inf")), best[k] + s)
        assert sum(model.scores[model.texts[i]] for i in model.stream(text)) == pytest.approx(best[len(text)])


def test_quality_statistics():
    def plain(words):
        w = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        c, hit = Counter(w), set()
        for k, x in enumerate(w):
            if c[x] > 1:
                hit.update(range(k, k + 8))
        return len(hit)

    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        assert quality.statistics(" ".join(words))[4] == plain(words)
    assert quality.statistics("a b\n\na b\n#é $")[:4] == (6, 7, 2, 1)
    assert quality.ratios(("word " * 4000).encode(), __import__("zstandard").ZstdCompressor(level=3).compress)[1] == 1.0


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(40)]
    rows = []
    for k in range(400):
        words = list(base[k % 40 if k % 3 else 0])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = [set(near_dedup.shingles(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("tile", [1024, 32])
def test_near_dedup_of_a_large_family(spark, monkeypatch, tile):
    # all texts share a template, at less than 0.8; at this size the blocks and small nodes can find all pairs as well
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "TILE", tile, raising=False)
    rng = random.Random(8)
    template = [f"t{k}" for k in range(158)]
    tails = [[f"u{k}x{j}" for j in range(24)] for k in range(260)]
    rows = [(k, " ".join(template + tail)) for k, tail in enumerate(tails)]
    rows += [(1000 + k, " ".join(template + tails[k][: rng.choice((20, 21, 22))])) for k in range(40)]
    sets = {k: set(near_dedup.shingles(t, 5).tolist()) for k, t in rows}
    assert all(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for a in range(0, 40) for b in range(a))
    want = {k: k - 1000 if k >= 1000 else k for k in sets}
    assert all(100 * len(sets[k] & sets[v]) >= 80 * len(sets[k] | sets[v]) for k, v in want.items())
    for a in sets:
        for b in sets:
            assert want[a] == want[b] or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == want


def test_line_dedup(spark):
    rows = [(k, f"unique words number {'abcdefgh'[k]} here\nShared footer line {k} of the site\n\nok") for k in range(4)] + [(9, "Shared footer line 77 of the site\nAll words of one")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert "footer" in got[0] and all("footer" not in got[k] and "unique words" in got[k] for k in (1, 2, 3)) and got[9] == "All words of one"


def test_line_dedup_of_repeated_rows(spark):
    twice, other = "A line that both of them share\nfirst one alone", "A line that both of them share\nsecond one alone"
    rows = line_dedup.dedup_lines(frame(spark, [(1, twice), (1, twice), (1, twice), (2, other)]), min_docs=3).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, twice)] * 3 + [(2, other)]


def test_secret_scan(spark):
    text = "x token=token=abcdefgh secret=token:abcdefgh é password: 'abc123456' AKIA" + "Q" * 16 + " " + "0a" * 12
    r = secret_scan.scan(frame(spark, [(1, text)])).first()
    assert (r.n_assign, r.n_access, r.n_hex) == (2, 1, 1)
    first = text.index("token="), text.index(" secret")
    assert r.spans.startswith(f"assign:{first[0]}:{first[1]},")
    clean = secret_scan.redact(frame(spark, [(1, text)])).first().text
    assert "abc123456" not in clean and "AKIA" not in clean and "é" in clean
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == frozenset()


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=1>m</a></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>four</b></article><div id=comments><p>me too</p></div><footer>f</footer></body></html>"
    plain = "<body><div class=menu>x</div><div id=content><p>first long enough text {0}</p><p>second {0}</p></div><div>same for all</div></body>"
    rows = [(0, "http://a.com/1", page)] + [(k, f"http://b.org/{k}", plain.format(k)) for k in range(1, 9)] + [(20, None, None), (21, "http://c.org", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    assert got[0] == "A & B\n\none two three\n\nfour"
    assert got[3] == "first long enough text 3\n\nsecond 3" and got[20] == "" and got[21] == ""
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_html_of_mixed_templates(spark):
    marked = "<body><article><div><p>body {0}</p></div><div><p>rest {0}</p></div><ul><li><a href=1>source {0}</a></ul></article></body>"
    other = "<body><div class=content><p>words of page {0}</p></div></body>"
    beside = "<body><div class=title>title {0}</div><div class=text><p>quite a long text of page {0}</p></div><div><a href=1>link {0}</a></div></body>"
    rows = [(k, f"http://a.com/{k}", (other if k == 3 else marked).format(k)) for k in range(9)] + [(k, None, (other if k % 2 else marked).format(k)) for k in range(10, 16)]
    rows += [(k, f"http://b.org/{k}", (other if k == 23 else beside).format(k)) for k in range(20, 29)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "body 1\n\nrest 1\n\nsource 1" and got[10] == "body 10\n\nrest 10\n\nsource 10"
    assert got[3] == "words of page 3" and got[11] == "words of page 11" and got[23] == "words of page 23"
    assert got[21] == "title 21\n\nquite a long text of page 21"


def test_wrapper_alignment():
    w = html_wrapper.align(html_wrapper.wrapper_of("<ul><li>a<li>b</ul><p>x</p>"), html_wrapper.wrapper_of("<ul><li>a</ul><h2>t</h2><p>y</p>"))
    assert html_wrapper.expression(w) == "<ul>(<li>#</li>)+</ul> (<h2>'t'</h2>)? <p>#</p>"


def test_url_filter(spark):
    model = url_filter.UrlModel(url_filter.seed_urls(spark), rounds=15)
    urls = ["http://WWW.Example.com/en/1", "https://x.example.com/en/2?q=1", "http://a.com", "http://a.com/", "http://b.net/es/", "http://net/es/x", None, "nothing", "http://free-bets.example.org/en/3", "http://quiet.example.org/en/9"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, model).collect()}
    assert [got[k].rule for k in range(8)] == ["www.example.com/en/", "example.com/en/", None, "com/", "net/es/", "net/es/", None, None]
    assert (got[0].host, got[0].path, got[0].verdict, got[1].verdict, got[2].path) == ("www.example.com", "/en/1", "allow", "block", "")
    assert got[6].host == "" and got[8].verdict == "block" and got[9].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0), model).count() == 0


def test_url_model_held_out(spark):
    seed = url_filter.seed_urls(spark)
    part = F.pmod(F.xxhash64(F.regexp_extract("url", r"([a-z-]+)\.example", 1)), F.lit(4))
    held = url_filter.UrlModel(seed.where(part != 0), rounds=15).score(seed.where(part == 0)).selectExpr("avg(cast((block_score > 0) = (block = 1) as double)) a").first().a
    assert held > 0.9


def test_clashing_names_keep_their_values(spark):
    secret = "token=abcdef12 and more"
    rows = [(1, secret, "mine", "his"), (2, "A line that both of them share\nsecond", "a", "b"), (3, "A line that both of them share\nthird", "c", "d"), (4, "A line that both of them share\nfourth", None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _s_text string, _l_lost string")
    got = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert got[1].text == "[secret] and more" and got[1]._s_text == "mine" and got[4]._s_text is None
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [got[k].text for k in (2, 3, 4)] == ["A line that both of them share\nsecond", "third", "fourth"] and [got[k]._l_lost for k in (1, 2, 3, 4)] == ["his", "b", "d", "f"]


def test_long_passage_in_two_documents(spark):
    passage, short = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55)), "only four short words"
    rows = [(1, f"{passage}\n{short}\nfirst one"), (2, f"second one\n{passage}\n{short}")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: f"second one\n{short}"}


def test_redaction_against_brute_force(spark):
    import re

    rng = random.Random(4)
    parts = ["token=", "token: abcdef12", "AKIA" + "Z" * 18, "0f" * 13, "é😀", " ", "password='xyz123'", "ghp_" + "a1" * 20, "https://u:p@", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)] + ["key " + "secret=abcdef1 " * 3000]
    want = []
    for t in texts:
        spans = sorted((m.start(), m.end()) for r in secret_scan.BASE + secret_scan.MORE for m in re.finditer(r.regex, t) if len(m[r.group]) >= r.least)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        want.append(out + t[at:])
    got = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == want
    held = {(r.doc_id, r.trigram) for r in secret_scan.postings(frame(spark, list(enumerate(texts)))).collect()}
    grams = secret_scan.TrigramIndex(secret_scan.BASE + secret_scan.MORE).grams
    assert held == {(k, g) for k, t in enumerate(texts) for g in grams if g in t.lower()}


def test_html_of_hostile_pages(spark):
    deep = "<article>" + "<div>" * 100_000 + "<p>far down</p>" + "</div>" * 100_000 + "<p>and out</p></article>"
    wide = "<article>" + "<p>one more paragraph</p>" * 50_000 + "</article>"
    broken = "</div></p><<article><p>kept &amp; whole<ul><li>a<li>b</ul"
    rows = [(1, "http://a.com/1", deep), (1, "http://a.com/1", deep), (2, "http://a.com/2", wide), (3, "http://a.com/3", broken), (None, "http://a.com/4", "<article>x</article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "far down\n\nand out" and got[2][0].count("one more paragraph") == 50_000 and got[None] == ("x", 1)
    assert got[3][0].startswith("kept & whole\n\na\n\nb")


def test_html_without_telling_names(spark):
    """Unnamed blocks: positions, constants and links of the wrapper decide; the texts are known as the pages are built."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        title, paragraphs, links = say(4), [say(12) for _ in range(rng.randrange(1, 60))], [say(2) for _ in range(rng.randrange(1, 6))]
        source = f"source {say(2)}"
        menu = "".join(f"<div><a href=1>{x}</a></div>" for x in links)
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        history = f"<p class='social-history'>{title} told</p>"
        page = f"<body><div><p>We use no trackers</p></div><div><p>{title}</p></div><section>{menu}</section><div>{body}{history}<p>{source}</p></div><div><p>All rights kept</p></div></body>"
        rows.append((k, f"http://plain.org/{k}", page))
        want[k] = "\n\n".join([title, *paragraphs, f"{title} told", source])
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want


def test_html_names_inside_an_article(spark):
    page = "<article><p class='social-history'>history {0}</p><div class='share-buttons'>tell them</div><div class='post-meta'>by {0}</div><div class='related-work'><a href=1>other {0}</a></div><ul class=sources><li><a href=1>paper {0}</a></ul></article>"
    rows = [(k, f"http://a.com/{k}", page.format(k)) for k in range(8)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"history {k}\n\npaper {k}" for k in range(8)}


def test_wrappers_in_any_order():
    rng = random.Random(5)
    tags = ["div", "p", "div class=a", "section", "h2"]

    def page(depth=0):
        return "".join(f"<{t}>{rng.choice(['same', str(rng.random())])}{page(depth + 1) if depth < 2 else ''}</{t.split()[0]}>" for t in rng.choices(tags, k=rng.randrange(4)))

    pages = [page() for _ in range(40)]

    def wrapper(order):
        parts = [html_wrapper.wrapper_of(pages[k]) for k in order]
        while len(parts) > 1:  # a random tree of merges
            at = rng.randrange(len(parts) - 1)
            parts[at : at + 2] = [html_wrapper.align(parts[at], parts[at + 1])]
        return sorted((path, e["t"], e["r"]) for path, e, _ in html_wrapper._texts(parts[0]))

    first = wrapper(range(40))
    for _ in range(5):
        assert wrapper(rng.sample(range(40), 40)) == first


def test_lines_common_and_rare(spark, monkeypatch):
    """Templates above and below the bound of the broadcast, against brute force."""
    rng = random.Random(8)
    lines = ["a line that all of them have"] * 6 + [f"{chr(97 + k % 26)}{chr(97 + k // 26)} is one rarer line" for k in range(60)]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for k in range(200)]
    where: dict = {}
    for k, text in docs:
        for line in text.split("\n"):
            where.setdefault(line, set()).add(k)
    gone = lambda k, line: bool(line) and len(where[line]) >= 3 and min(where[line]) != k
    want = {k: "\n".join(x for x in text.split("\n") if not gone(k, x)) for k, text in docs}
    for bound in (1, 8, 10_000):  # none, the commonest, all by the broadcast
        monkeypatch.setattr(line_dedup, "HOT", bound)
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()} == want
