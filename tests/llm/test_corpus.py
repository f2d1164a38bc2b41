"""Corpus operators against brute force on small tables, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphlake.llm import bpe, decontaminate, html, licenses, minhash, quality, tokenfile, toxicity, urls, vectors
from graphlake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
AWKWARD = "doc_id long, text string, score double, host string, ids string, mask string, n int, cls int, label int, items string, path string, rule string, verdict string, html string, licenses string, dice string"


def awkward(spark, empty=False):
    """Null ids and texts, empty, blank, short, very long and repeated texts, and columns with clashing names."""
    long = "lorem ipsum dolor sit amet " * 20_000
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, long), (7, long + "x"), (8, "a b c d e f g h"), (8, "a b c d e f g h"), (None, "a b c d e f g h"), (9, "é" * 5), (10, "\x00 b")]
    rows = [(i, t, 0.0, "h", "i", "m", 1, 2, 3, "x", "p", "r", "v", t, "l", "d") for i, t in texts]
    return spark.createDataFrame([] if empty else rows, AWKWARD)


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        a, b = sorted((root(i), root(j)))
        up[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, size, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rng = np.random.default_rng(0)
    for k in range(120):  # a dense group of near copies of one text
        w = rows[0][1].split()[:300]
        for p in rng.integers(0, len(w), rng.integers(0, 12)):
            w[p] = f"w{rng.integers(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    sets = [shingles(t, size) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i]]
    root = components(len(rows), linked)
    want = {rows[i][0]: (len(sets[i]), rows[root[i]][0]) for i in range(len(rows))}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_awkward(spark):
    got = minhash.near_duplicates(awkward(spark), shingle=3, percent=85).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert [by[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 5]
    assert by[None].component_id is None and by[None].kept
    assert by[8].component_id == 8 and by[7].component_id in (6, 7)
    assert minhash.near_duplicates(awkward(spark, True)).count() == 0


def test_minhash_repeated_ids(spark):
    """Rows that repeat an id with different texts keep their own links, and one of equal rows stays."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(8, a), (8, b), (9, b + " more"), (10, a + " more"), (10, a + " more"), (11, "lonely words here now"), (11, "lonely words here now"), (None, a), (12, ""), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {(8, 8), (9, 8), (10, 8), (11, 11), (None, None), (12, 12)}
    left = [(r.doc_id, r.text) for r in minhash.one_of_each(docs, shingle=3, percent=85).collect()]
    assert sorted(left, key=str) == sorted([(8, a), (8, b), (11, rows[5][1]), (None, a), (12, ""), (12, "")], key=str)


def test_minhash_tiny_partitions(spark):
    """Neighbours meet across partitions of a few rows."""
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(30)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
        assert {r.component_id for r in got.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_urls_brute_force(spark):
    given = ["http://a.org/x", "https://EXAMPLE.org/es/1", "http://www.example.org/en/12?x", "http://x.example.org/en/2", "http://b.com/fr/1", "b.com/fr", "http://c.com/de/#t", "://", "http://fr.com", None, "", "http://com/fr/", "x://org?/", "http://notexample.org/es/"]
    rows = spark.createDataFrame([(k, u, "extra", "extra") for k, u in enumerate(given)], "page_id int, url string, host string, verdict string")
    for r in urls.url_verdicts(rows).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for h, p, a in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert urls.url_verdicts(rows, rules=()).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.url_verdicts(rows.limit(0)).count() == 0
    many = [(f"h{i}.org", f"/{'p' * (i % 5)}", "block") for i in range(300)]
    assert urls.url_verdicts(spark.createDataFrame([("http://x.h7.org/pppp",)], "url string"), many).first()["rule"] == "h7.org/pp"


def test_urls_many_shapes_and_clashing_names(spark):
    """One plan for any number of rule shapes; helper columns never meet the caller's."""
    rules = [(".".join(["a"] * (1 + k % 4) + [f"h{k}.org"]), "/" + "p" * k, "block") for k in range(120)]
    given = spark.createDataFrame([(f"http://x.{h}{p}q", 1, "k", "b", "d") for h, p, _ in rules] + [(None, 1, "k", "b", "d")], "url string, `rule_host` int, key string, best string, digest string")
    out = urls.url_verdicts(given, rules)
    assert out.columns == ["url", "rule_host", "key", "best", "digest", "host", "path", "rule", "verdict"]
    got = {r.url: r for r in out.collect()}
    assert all(got[f"http://x.{h}{p}q"].rule == h + p and got[f"http://x.{h}{p}q"].best == "b" for h, p, _ in rules)
    assert got[None].verdict == "allow" and got[None].rule is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_native_operators_run_no_python(spark):
    for df in (urls.url_verdicts(spark.read.parquet(f"{SF}/pages.parquet").select("url")), licenses.license_matches(awkward(spark).select("text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(k, (base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.2])).tolist(), int(rng.integers(3))) for k in range(400)]
    odd = [(900, [0.0] * 16, 1), (901, None, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [None] + [1.0] * 15, 1), (905, [], 1), (None, [1.0] * 16, 1), (906, [float("inf")] * 16, 2)]
    rows.append((500, rows[5][1], rows[5][2]))
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), tile=64).collect()
    x, lab = np.array([r[1] for r in rows]), [r[2] for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if lab[i] == lab[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98]
    links = np.bincount([i for p in linked for i in p], minlength=len(rows))
    root = components(len(rows), linked)
    want = {rows[i][0]: (links[i], rows[root[i]][0]) for i in range(len(rows))} | {r[0]: (0, r[0]) for r in odd}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(linked) > 100
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicate_vectors(empty).count() == 0


def test_vectors_of_repeated_ids_are_separate(spark):
    near = [1.0, 0.01]
    rows = [(1, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, near, 0), (3, [0.0, -1.0], 0), (4, [-0.0, 1.0], 0)]
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 1, 1)]


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    q, s, length, error = vectors.quantised(x)
    exact, near = x @ x.T, (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(exact - near) <= length[:, None] * error[None] + error[:, None] * (length + error)[None] + 1e-12).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
{article}<aside>More</aside><section id="comments"><p>First! Nice post, thanks, really, I mean it.</p></section><form>Mail <input></form><div class="ad">Buy, buy, buy.</div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<main><div class="post">{}</div></main>', '<div id="content">{}</div>'])
def test_html_keeps_the_article_only(wrap):
    body = "<h1>A  title</h1><p>Some <b>bold</b>face text, with &amp; and &lt;tags&gt;.<p>Short.</p><ul><li>one<li>two</ul><p>A last, rather long paragraph of text, so that it counts.</p>"
    assert html.main_text(PAGE.format(article=wrap.format(body))) == "A title Some boldface text, with & and <tags>. Short. one two A last, rather long paragraph of text, so that it counts."


def test_html_query_equals_the_article_of_each_page(spark):
    """All pages of the table follow one template, whose article a pattern can cut out."""
    import html as entities

    from graphlake.llm.queries import op4_html_extraction

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op4_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        raw = re.sub(r"</?(?:p|h1|br|div)[^>]*>", " ", re.sub(r"<!--.*?-->", "", article.group(1), flags=re.S)) if article else ""
        text = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", raw)).split())
        assert (r.text, r.n_chars) == (text, len(text))


def test_html_ratios_decide():
    """Paths pick the text: of two boxes without telling names the one with sentences; names only weigh."""
    long = "One sentence, of some length; and more of it. " * 4
    page = "<body><div class=x>%s</div><div class=y>%s</div></body>" % ("<a href=q>Go</a><br>" * 20, f"<p>{long}</p>" * 5 + "<p>Short.</p>")
    assert html.main_text(page).count("Go") == 0 and html.main_text(page).endswith("Short.")
    saved, html._content = html._content, lambda score: score >= 0
    try:
        assert "Go" in html.main_text(page)
    finally:
        html._content = saved
    for name in ("discussion", "share-holders", "form-factors", "notice"):
        page = f"<article><h1>T</h1><p>{long}</p><section class='{name}'><p>{long}kept</p></section></article>"
        assert html.main_text(page).endswith("kept"), name
    assert html.main_text(f"<article><p>{long}<math><mi>x</mi></math> <label>tag</label></p></article>").endswith("x tag")
    assert "mine" not in html.main_text(f"<article><p>{long}</p><div class='comment-list'><p>{long}mine</p></div></article>")


@pytest.mark.parametrize("part", ["<div>", "<a ", "<b>", "<p>x", '<a "', "<li>a", "<div><b></p>", "<i></section>"])
def test_html_time_is_linear(part):
    import time

    def seconds(n):
        start = time.process_time()
        html.main_text(part * n + "x")
        return time.process_time() - start

    assert seconds(200_000) < 60


def test_html_awkward(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain a < b & c") == "plain a < b & c"
    assert html.main_text("<p>" * 3000 + "deep") == "deep"
    got = html.extract(awkward(spark)).collect()
    assert len(got) == 12 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(awkward(spark, True)).count() == 0


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 50257, rng.integers(1, 300)) for _ in range(20)] + [np.full(500, 7), np.zeros(0, int), np.tile(rng.integers(0, 65535, 20), 30), rng.zipf(1.3, 900) % 50000]
    data = tokenfile.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, tokenfile.decode_blocks(data), strict=True))
    assert len(data[20]) < 100  # a constant block costs next to nothing
    wide = [rng.integers(0, 1 << 24, 100)]
    assert (tokenfile.decode_blocks(tokenfile.encode_blocks(wide, 3))[0] == wide[0]).all()
    broken = bytearray(data[0])
    broken[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.decode_blocks([bytes(broken)])


def test_token_blocks_are_independent():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.2, n) % 50000 for n in (20_000, 700, 1, 12_288, 5_000)]
    together = tokenfile.encode_blocks(blocks)
    assert together == [tokenfile.encode_blocks([b])[0] for b in blocks]
    assert sum(map(len, together)) < 1.6 * sum(map(len, blocks))  # under 13 bits an id
    assert (tokenfile.decode_blocks([together[3]])[0] == blocks[3]).all()


def test_pieces_equal_the_library():
    """Ids by pieces equal the plain library call, on odd strings, added tokens and long runs."""
    import random

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        ours = tokenfile.Tokenizer(f.read())
    assert ours.pieces
    odd = ["'", "'s", "'re", "'ll", "'v", "'d", " ", "  ", "\n", "\t", "a", "B", "9", "é", "世", "!", "''", "\u3000", "\u00a0", "\x1c", "\x85", "😀", "²", "٣", "<|endoftext|>", "ſ", "\u0301", "\x00"]
    random.seed(3)
    for _ in range(2000):
        texts = ["".join(random.choices(odd, k=random.randint(0, 9))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        begin, ids = ours.encode_slice(b"".join(raw), np.cumsum([0, *map(len, raw)]))
        assert [ids[begin[k] : begin[k + 1]].tolist() for k in range(3)] == [ours.plain(t) for t in texts], texts
    for run in (" ", "\n", "x", "!"):
        assert ours.encode(run * 1_000_000 + "y") == ours.plain(run * 1_000_000 + "y")


def test_crc_join():
    a, b = b"hello", b"world" * 99
    assert tokenfile.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_file_awkward(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(tokenfile.round_trip(awkward(spark), path).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in awkward(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(awkward(spark, True), path).count() == 0


def test_bpe_chunks_equal_whole():
    import random

    with open(MULTI, "rb") as f:
        coder = bpe.ByteBpe(bpe.load_ranks(f.read()), public_tokenizers.PATTERN, chunk=40, overlap=4, run=12)
    rng = random.Random(5)
    for alphabet in ("a     \t\n", "  \u3000\x1c.", "ab \n", "a  \n\t'sre ll1!é世", "x", " ", "'s't d've 12 ab.!?  \n", "aé \u00a0\u3000.!", "ab\x1c\x1f!\x85 \u2028"):
        for _ in range(60):
            t = "".join(rng.choice(alphabet) for _ in range(rng.choice([5, 90, 700])))
            ids = coder.encode(t)
            assert ids.tolist() == coder.pieces.encode_ordinary(t) and coder.decode(ids) == t.encode()


@pytest.mark.parametrize("run", [" ", "\n", "x", "\t\u3000"])
def test_bpe_long_runs(run):
    with open(MULTI, "rb") as f:
        coder = bpe.ByteBpe(bpe.load_ranks(f.read()), public_tokenizers.PATTERN)
    for text in (run * 2_000_000, "word " + run * 1_000_000 + " more"):
        assert coder.decode(coder.encode(text)) == text.encode()
    small = f"word {run * 3000} more"  # short enough for the library's pre-tokenizer
    cut = bpe.ByteBpe({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN, chunk=64, run=16)
    assert cut.encode(small).tolist() == cut.pieces.encode_ordinary(small)
    own = bpe.ByteBpe(dict(zip(coder.vocabulary, range(len(coder.vocabulary)), strict=True)), public_tokenizers.PATTERN, chunk=64, run=16)
    assert own.encode(small).tolist() == coder.pieces.encode_ordinary(small)


def test_bpe_query_equals_brute_force(spark):
    """Every row of the table against pre-tokens by the pattern and merges by rank, done plainly."""
    import regex

    from graphlake.llm.queries import op6_byte_bpe

    with open(MULTI, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    known = {}

    def merged(piece):
        if piece not in known:
            parts = [bytes([b]) for b in piece]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known[piece] = [ranks[p] for p in parts]
        return known[piece]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        ids = [i for m in regex.findall(public_tokenizers.PATTERN, t) for i in (merged(m.encode()) if m.encode() not in ranks else [ranks[m.encode()]])]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_awkward(spark):
    got = bpe.digests(awkward(spark), MULTI, public_tokenizers.PATTERN).collect()
    by = {r.doc_id: r for r in got}
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 12 and by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == by[2].decoded_sha256 == nothing
    coded = bpe.encode(awkward(spark), MULTI, public_tokenizers.PATTERN, check_col="whole")
    assert coded.filter("not whole").count() == 0
    back = bpe.decode(coded, MULTI, public_tokenizers.PATTERN)
    assert back.filter(F.col("decoded") != F.encode(F.coalesce("text", F.lit("")), "UTF-8")).count() == 0
    assert bpe.digests(awkward(spark, True), MULTI, public_tokenizers.PATTERN).count() == 0


def test_classifiers_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for name, label, least in (("op7_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)):
        got = QUERIES[name](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").select("predicted", label, "score").collect()
        assert all(0 <= r.score <= 1 for r in got)
        assert np.mean([r.predicted == r[label] for r in got]) >= least
    assert docs.count() == QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").count()


def test_quality_votes_equal_brute_force():
    """The nearest labelled vectors vote with their similarity; of ties with the last one all vote."""
    rng = np.random.default_rng(8)
    counts = rng.poisson(0.02, (90, quality.TERMS)).astype(np.float32)
    counts[40:60] = counts[10]
    labels = rng.integers(0, 2, 90)
    model = quality.Model(counts, labels)
    asked = np.concatenate([counts[:12], rng.poisson(0.02, (20, quality.TERMS)).astype(np.float32), np.zeros((1, quality.TERMS), np.float32)])
    got = model.score(asked)
    for row, score in zip(asked, got, strict=True):
        if not row.any():
            assert score == pytest.approx(labels.mean(), abs=1e-6)
            continue
        v = (np.sqrt(row / row.sum()) * model.idf) @ model.topics
        cos = model.known @ (v / np.linalg.norm(v))
        last = sorted(cos)[-quality.NEIGHBOURS]
        w = [max(c, 0) ** quality.SHARPNESS if c >= last - 1e-6 else 0 for c in cos.tolist()]
        assert score == pytest.approx(sum(x * y for x, y in zip(w, labels, strict=True)) / sum(w), abs=1e-3)


def test_classifiers_awkward(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module, scorer, label in ((quality, quality._scores, "quality"), (toxicity, toxicity.scores, "toxic")):
        for known in (labels, labels.limit(0)):
            got = quality.classify(awkward(spark), module.fit(awkward(spark), known, label_col=label), scorer=scorer).collect()
            assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
            assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        assert quality.classify(awkward(spark, True), module.fit(awkward(spark, True), labels, label_col=label), scorer=scorer).count() == 0


def test_levenshtein_trie_equals_brute_force():
    from graphlake.functions.similarity import osa_distance

    words = ["idiot", "stupid", "moron", "trash"]
    trie = toxicity.Trie(words)
    for w in ("idiot", "idi0t", "diot", "idioot", "stupd", "stupids", "trsah", "moran", "thrash", "tras", "xtrash", "none", ""):
        near = [x for x in words if lev(w, x) <= 1]
        assert trie.within_one(w) == (min(near) if near else None)
    assert osa_distance("trsah", "trash") == 1  # a swap is two edits for the automaton


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_context_windows():
    assert toxicity.context_factor('he called him "', '" and left') == toxicity.QUOTED
    assert toxicity.context_factor("she said ", ".") == toxicity.QUOTED
    assert toxicity.context_factor("you ", " go") == toxicity.ADDRESSED
    assert toxicity.context_factor("the ", " in") == 1.0


def test_misspelt_terms_count():
    lex = toxicity.Lexicon({"worthless": 6.0, "idiot": 6.0}, {"lowei": 5.0}, trusted=0.5)
    texts = ["such a worthles thing", "a WORTHLESS thing", "loweischaft hier", "nothing here", "worth less"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    strength, near = lex.strength(np.frombuffer("".join(texts).encode(), np.uint8), off)
    assert strength.tolist() == [3.0, 6.0, 5.0, 0.0, 0.0] and near == [(0, "worthles", "worthless")]


def test_decontamination_equals_brute_force(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    benchmark = [(1, item), (2, "short item"), (3, ""), (4, None), (10, item.upper()), (5, "x " * 30), (6, "one")]
    docs = [(1, f"intro {item}, end"), (2, "beta gamma delta"), (3, "a Short, ITEM b short item"), (4, None), (5, "x x x x x x x x x x x x"), (6, ""), (7, "kappa " + item.replace("mu", "nu")), (8, "One more"), (8, "One more"), (9, f"{item} {item} beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().translate(LOWER))
    windows = {}
    for i, t in benchmark:
        w = split(t)
        for k in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    b = spark.createDataFrame(benchmark, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 40):
        got = decontaminate.contamination(d, b, block_bytes=block).collect()
        for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), docs, strict=True):
            w, hit, items = split(t), set(), set()
            for win, own in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        items |= own
            digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            assert (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (i, len(w), len(hit), len(items), digest, bool(hit))
            assert sum(s.length for s in r.spans) == len(hit)
            longest = 0
            for _, other in benchmark:
                v = split(other)
                for p, q in itertools.product(range(len(w)), range(len(v))):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    longest = max(longest, n if n >= min(10, len(v)) else 0)
            assert r.longest_match == longest
            if longest:
                v = split({str(k): x for k, x in benchmark}[r.match_item])[r.match_item_start :]
                assert v[:longest] == w[r.match_start : r.match_start + longest]
        kept = {r.doc_id for r in decontaminate.clean_documents(d, b, block_bytes=block).collect()}
        assert kept == {r.doc_id for r in got if not r.contaminated}
    assert decontaminate.contamination(awkward(spark), b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(awkward(spark, True), b).count() == 0


def test_lexicon_keeps_short_terms_among_many_candidates(spark):
    rng = np.random.default_rng(0)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_500, 12))]
    pile = [words[i] for _ in range(10) for i in rng.permutation(len(words))]
    parts = [" ".join(pile[k::40]) for k in range(40)]
    rows = [(k, t + (f" left{k % 8} zorg right{k % 8}" if k < 40 else ""), int(k < 40)) for k, t in enumerate(parts + parts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert "zorg" in toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).words


def test_license_dice(spark):
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (2, "released UNDER the (mit) license"), (3, "nothing of the kind here"), (4, None), (5, "This work is licensed under the\nGNU General Public License, version 3.")], "doc_id int, text string")
    got = {r.doc_id: (r.license, len(r.licenses)) for r in licenses.license_matches(docs).collect()}
    # The first text matches twice: as a line, and as a paragraph with two more words (2 * 4 / (4 + 6) = 0.8).
    assert got == {1: ("MIT", 2), 2: ("MIT", 1), 3: (None, 0), 4: (None, 0), 5: ("GPL-3.0", 1)}
    assert licenses.license_matches(awkward(spark)).count() == 12 and licenses.license_matches(awkward(spark, True)).count() == 0


def test_license_windows(spark):
    mit, apache = licenses.WHOLE["MIT"], licenses.WHOLE["Apache-2.0"][0]
    comment = "#!/bin/sh\n#\n# " + "\n# ".join(re.findall(r".{1,60}(?: |$)", apache)) + "\n#\nexit 0"
    texts = [
        ("Copyright 2021 Acme. Released under the MIT License.", "MIT", 1.0, 1),
        ("This article is licensed under CC BY 4.0.", "CC-BY-4.0", 1.0, 1),
        ("word " * 300 + mit[0] + " word" * 300, "MIT", 1.0, 1),
        ("MIT License\n\nCopyright (c) 2020 A B\n\n" + mit[0] + "\n\n" + mit[1][len(mit[0]) :], "MIT", 1.0, None),
        (comment, "Apache-2.0", 1.0, None),
        ("We say: released under the MIT License. They say: licensed under CC BY 4.0.", "CC-BY-4.0", 1.0, 2),
        ("x\n\nReleased under the MIT License.\n\ny", "MIT", 1.0, 1),
        ("Licensed words under many of the general conditions of a permission.", None, 0.0, 0),
        ("word", None, 0.0, 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.license_matches(docs).collect()}
    for i, (text, name, dice, n) in enumerate(texts):
        assert (got[i].license, got[i].dice) == (name, dice), text[:80]
        assert n is None or len(got[i].licenses) == n, got[i].licenses
    # Every window of every template, by brute force: the best Dice of a text is found.
    for i, (text, name, dice, _) in enumerate(texts):
        w, best = licenses._words(text), 0.0
        for t in (t for g in (licenses.TEMPLATES, licenses.WHOLE) for ts in g.values() for t in ts):
            v = licenses._words(t)
            own = set(zip(v, v[1:]))
            for k in range(max(1, len(w) - len(v) + 1)):
                part = set(zip(w[k : k + len(v)], w[k + 1 : k + len(v)]))
                best = max(best, 2 * len(part & own) / (len(part) + len(own)))
        assert got[i].dice == pytest.approx(best if best >= licenses.THRESHOLD else 0.0, abs=1e-8), text[:80]


def test_queries_with_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), c.sql(sql).df()
        got, want = (x[sorted(x.columns)].astype(object).where(x.notna(), None) for x in (got, want))
        assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist()))


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = docs
    for name in list(stages)[:-1]:
        after = stages[name](spark, kept, SF).select(docs.columns).cache()
        assert after.columns == docs.columns and after.count() <= kept.count()
        kept = after
    sets = {r.doc_id: shingles(r.text, 5) for r in kept.collect()}
    ids = sorted(sets)
    assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] and sets[b])
    assert {r.doc_id for r in rows} == set(ids)


def test_pipeline_stages_awkward(spark):
    import corpus_pipeline

    def docs(empty):
        return awkward(spark, empty).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})

    for name, stage in corpus_pipeline.STAGES:
        given = docs(False)
        out = stage(spark, given, SF)
        rows = out.collect()
        assert len(rows) <= 12 and stage(spark, docs(True), SF).count() == 0
        if name != "byte_bpe":
            assert out.columns == given.columns and {r.doc_id for r in rows} <= {r.doc_id for r in given.collect()}
        if name == "near_dedup":
            # The nearly equal long texts are one group; of equal rows that repeat an id one stays; empty texts all stay.
            assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, None, 9, 10], key=str)
        if name in ("decontaminate", "byte_bpe"):
            assert len(rows) == 12


def test_html_bounds_and_entities():
    page = "<body><div id='main'><p>One &eacute;&#233;&#x2014; two,&nbsp;three. And more words, so that it is long enough.</p><p>a&lt;b</p></div><div class='comments'><p>I disagree, strongly, with all of this, and here is why.</p></div></body>"
    assert html.main_text(page) == "One éé— two, three. And more words, so that it is long enough. a<b"


def test_html_names_of_blocks():
    story = "<p>A first, rather long paragraph, with several marks; and more of it.</p><p>And a second one, which is as long as the first, or nearly so.</p>"
    page = f"<body><div class='siteHeader'>Site</div><div id='mainNav'>Menu</div><article><div class='article-header'><h1>Title</h1></div>{story}<div class='cookieNotice'>Ok?</div><div class='post-footer'>Share</div></article><div class='page_sideBar'>More</div><ol class='user-comments'><li>First, and so on, and so on.</li></ol></body>"
    assert html.main_text(page) == "Title A first, rather long paragraph, with several marks; and more of it. And a second one, which is as long as the first, or nearly so."
