"""The ten operators against brute force on small fixtures, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from parity import duck_rows, spark_rows
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, html, lattice, licenses, lines, minhash, mixing, pii, queries, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, key string, h string"


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, "en", (sources or {}).get(i, "src0"), len(t or ""), 9.0, 9, "k", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(ids, linked):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            lo = min(label[a], label[b])
            for x in (a, b):
                if label[x] != lo:
                    label[x], moved = lo, True
    return label


def family(base, n, edits, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(10_000)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_minhash_finds_every_link(spark, k, num):
    texts = family(words(120, 1), 60, 5, 2) + family(words(30, 3), 20, 2, 4) + [" ".join(words(40, s)) for s in range(20, 40)]
    texts += ["same text here", "Same TEXT here", "one", "one", "", "  \n", None, " ".join(words(30_000, 9))]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), k, num, 100).collect()}
    s = [shingles(t, k) for t in texts]
    linked = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j])]
    label = components(range(len(s)), linked)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s[i]), label[i], label[i] == i) for i in range(len(s))}


def test_minhash_repeats_nulls_and_nothing(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", "x"])
    d = d.union(d.where("doc_id = 1")).union(d.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(d, 3, 85).collect())
    assert got == [(False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False), (False, 2, 2, True), (True, 0, None, True)]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links long")


def test_lattice_counts_links(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.concatenate([base, 0.955 * base + math.sqrt(1 - 0.955**2) * side, 3 * base[:10], base[:5], base[:1].repeat(40, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 7) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0, 7), (n + 1, [0.0] * 64, 0, 7), (n + 2, [float("nan")] + [1.0] * 63, 0, 7), (n + 3, [None] + [1.0] * 63, 0, 7), (n + 4, [], 0, 7), (n + 5, [1.0, 2.0], 0, 7), (n + 6, [2.0, 4.0], 0, 7), (None, [1.0, 2.0], 0, 7)]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = [(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.95), strict=True) if i != j]
    degree = np.bincount([i for i, _ in linked], minlength=n)
    label = components(range(n), linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(vectors(spark, rows)).collect()}
    assert all(got[i] == (degree[i], label[i], label[i] == i) for i in range(n))
    assert all(got[n + i] == (0, n + i, True) for i in range(5)) and got[None] == (0, None, True)
    assert got[n + 5] == (1, n + 5, True) and got[n + 6] == (1, n + 5, False)
    assert lattice.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_lattice_splits_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 8)
    r = np.random.default_rng(1)
    x = np.ones((60, 16)) + r.normal(0, 0.05, (60, 16))
    got = lattice.near_vectors(vectors(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)])).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


@pytest.mark.parametrize("dim", [8, 64, 384])
def test_lattice_recall_at_the_threshold(spark, dim, monkeypatch):
    monkeypatch.setattr(lattice, "HEAVY", 3)
    r = np.random.default_rng(dim)
    u = r.normal(size=(1500, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = r.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    x = np.concatenate([u, 0.9505 * u + math.sqrt(1 - 0.9505**2) * w, u[:2].repeat(4, axis=0)]).astype(np.float32)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    degree = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {v.vec_id: v.n_links for v in lattice.near_vectors(vectors(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)])).collect()}
    assert all(got[i] <= degree[i] for i in got) and sum(got.values()) >= 0.995 * degree.sum()


def test_lattice_plan_at_scale():
    """Unrelated vectors that share a cell grow far slower than the table: measured on random pairs."""
    r = np.random.default_rng(6)
    u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(4000, 64)), r.normal(size=(4000, 64))))
    met, keys = {}, {}
    for n in (50_000, 5_000_000):
        tables, scale, probes = lattice.table_plan(0.95, n)
        t = lattice.Tables(64, tables, scale, 3, probes)
        met[n], keys[n] = n * lattice.meets(t.keys(u), t.keys(v)).any(axis=1).mean(), tables * probes
    print(met, keys)
    assert met[5_000_000] < 10 * met[50_000] and keys[5_000_000] < 20 * keys[50_000]


def test_decoder_finds_the_nearest_point():
    x = np.random.default_rng(2).normal(size=(300, 8)) * 2
    c = lattice.decode(x)
    assert (np.abs(c * 2 - np.rint(c * 2)) < 1e-9).all() and (c.sum(axis=1) % 2 == 0).all()
    best = ((x - c) ** 2).sum(axis=1)
    for root in lattice.roots():
        assert (best <= ((x - c - root) ** 2).sum(axis=1) + 1e-9).all()


def test_decontamination(spark):
    item = "Maria buys 12 apples for 5 dollars and Maria eats 12 apples today then sleeps"
    other = " ".join(words(20, 5))
    texts = [f"intro. {item} end", item.replace("Maria", "Tom").replace("12", "30").replace("5", "7"), "Tom buys 30 apples for 7 dollars and Ann eats 31 apples today then sleeps",
             other.upper() + "!!", " ".join(words(300, 6)), other.split(" ", 12)[-1], None, "", " ".join(words(20_000, 8)) + " " + other]
    bench = spark.createDataFrame([(1, item, 1), (2, other, 1), (3, None, 1), (4, "", 1), (5, "of the", 1), (6, other, 1), (None, item, 1)], "item_id long, text string, row long")
    d = docs(spark, texts)
    got = {r.doc_id: (r.contaminated, list(r["items"]), r.reparameterised) for r in decontaminate.decontaminate(d.union(d), bench).collect()}
    assert got == {0: (True, [1], False), 1: (True, [1], True), 2: (False, [], False), 3: (True, [2, 6], False), 4: (False, [], False), 5: (False, [], False), 6: (False, [], False), 7: (False, [], False), 8: (True, [2, 6], False)}
    assert decontaminate.decontaminate(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0


def test_decontamination_catches_every_planted_item(spark, small):
    d, b = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in b.collect()]
    expected = {r.doc_id: sorted(i for i, t in items if t in plain(r.text)) for r in d.collect()}
    assert {r.doc_id: sorted(r["items"]) for r in decontaminate.decontaminate(d, b).collect()} == expected


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licenses(spark):
    notice = licenses.NOTICES["mit"]
    texts = ["The MIT License; mit-license, GNU general PUBLIC license", "cc é by, CC BY", notice.replace("free of charge", "at no charge"), None, "", "mit " * 5000 + "license", "gnu general public"]
    d = docs(spark, texts)
    both = licenses.scan_licenses(d.union(d)).collect()
    got = {r.doc_id: r for r in both}
    assert len(both) == 2 * len(texts) and sorted(map(repr, both[:])) == sorted(2 * [repr(r) for r in got.values()])
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at = [(n, label) for p, label in BASE.items() for n in range(len(w)) if w[n : n + len(p.split())] == p.split()]
        starts = [n for n, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[2].labels == "mit" and got[2].n_base == 0
    assert licenses.scan_licenses(d.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a = "</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></ul></nav><div class="ad">Buy, now!</div><!-- x --><div id="post"><h2>Title &amp; more</h2><p><b>First, long   paragraph of text.<br>And more; of it.
<p>Second&nbsp;one &eacute;.<ul><li>item a<li>item b</ul><form>Search <input></form></div><div class="comments"><p>I agree, great post. Thanks, all.</p></div>
<aside>Other, stuff.</aside><div class="cookie-notice">We use cookies.</div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", "  "), (4, "x", "plain text"), (5, "x", "<p>" * 3000 + "deep"), (6, "x", "<script>open"), (None, "x", "<p>a<p>b")]
    d = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_text(d).collect())
    main = "Title & more\n\nFirst, long paragraph of text. And more; of it.\n\nSecond one é.\n\nitem a\n\nitem b"
    assert got == [(0, "a\n\nb", 4), (1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0), (4, "plain text", 10), (5, "deep", 4), (6, "", 0)]
    assert html.extract_text(d.limit(0)).count() == 0


def test_html_gives_the_article(spark, small):
    import html as entities

    for r in queries.op4_html_extraction(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1])
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(filter(None, parts))


def luhn(digits):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii(spark):
    r = random.Random(3)
    texts = ["a@b.c_x@d.e a@@b.c z@y.z.w.@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +1-( +49 30 1234567é@x.de", None, "", "5" * 3000, "x" * 3000 + "@"]
    texts += ["".join(r.choice("ab1 .@+-()9_é") for _ in range(300)) for _ in range(40)]
    texts += [f'see token = "{hashlib.md5(bytes([i])).hexdigest()}" ok' for i in range(6)] + [f"badge no {hashlib.md5(bytes([i])).hexdigest()} ok" for i in range(6)] + ["badge no 0123456789abcdef0123456789abcdef ok"]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in pii.find_pii(d.union(d.where("doc_id < 2"))).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert set(base) <= set(got[i].spans.split(",")) | {""}
    # The same values stand after 'token = "' and after 'badge no', so that context marks a value never seen as a token.
    last = texts[-1]
    assert f"secret:{last.index('0123')}:{last.index(' ok')}" in got[len(texts) - 1].spans
    assert pii.find_pii(d.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(5)
    common = words(300, 11)
    texts, y = [], []
    for i in range(600):
        t = [r.choice(common) for _ in range(r.randint(5, 80))]
        y.append(int(i % 4 == 0))
        if y[-1]:
            t.insert(r.randrange(len(t)), r.choice(["idiotic", "moronic"]))
        texts.append(" ".join(t))
    texts += [None, "", "moronic " + " ".join(words(20_000, 12))]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(y)] + [(0, 1, 0), (600, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(d, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5) for i in got)
    held = [i for i in range(1, 600) if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in held) >= 0.97 * len(held)
    assert got[602].predicted == 1 and got[601].predicted == 0
    # Labels of the held-out fold and every other column change nothing; a second run agrees.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(d.withColumn("lang", F.lit("xx")), turned).collect()}
    assert again == {i: got[i].score for i in got}
    assert {r.score for r in toxicity.toxicity(d, labels.limit(0)).collect()} == {0.0} and toxicity.toxicity(d.limit(0), labels).count() == 0


def test_toxicity_score_is_the_sum_over_terms_and_pairs():
    r = np.random.default_rng(3)
    n = 1 << toxicity.BITS
    m = toxicity.Machine(-0.7, r.normal(0, 0.2, n).astype(np.float32), r.normal(0, 0.2, (n, toxicity.RANK)).astype(np.float32))
    terms = toxicity.Terms()
    for text in (b"one", b"one two three", b"Some words, some more words; and a longer one: unbelievable"):
        x = terms.of(text)
        z = m.bias + sum(float(m.weights[i]) for i in x) + sum(float(m.factors[i].astype(float) @ m.factors[j].astype(float)) for a, i in enumerate(x) for j in x[:a])
        assert abs(m.score(x) - 1 / (1 + math.exp(-z))) < 1e-5


def test_pairs_of_terms_are_learned():
    r = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = r.random(2) < 0.5
        rows.append(np.array(sorted({1} | ({2} if a else set()) | ({3} if b else set())), np.int32))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y), epochs=15)
    s = [m.score(np.array(x, np.int32)) for x in ([1], [1, 2], [1, 3], [1, 2, 3])]
    assert s[3] > 0.5 > max(s[:3])


def test_mixing_and_lines_and_urls_match_sql(spark, small):
    for name in ("op8_source_mixing", "op9_line_dedup", "op10_url_filter"):
        assert spark_rows(queries.QUERIES[name](spark, small)) == duck_rows(queries.ORACLE_SQL[name], small)


def test_mixing(spark):
    texts = ["a b c", "d", None, "", " ".join(["w"] * 5000), "x y", "x y", "p q r"]
    d = docs(spark, texts, {0: "a", 1: "a", 2: "a", 3: None, 4: "b", 5: None, 6: None, 7: "c"})
    d = d.union(d.where("doc_id = 5")).union(d.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.mix(d).collect()
    assert len(got) == 10 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert taken == {s: math.floor(t) for s, t in target.items()}
    assert abs(sum(target.values()) - min(1.5 * 5016, 2 * 5016)) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(d.repartition(7)).collect()))
    assert mixing.mix(d.limit(0)).count() == 0


def test_lines(spark):
    texts = [f"menu\nunique {i}\n\n menu \nend {i}" for i in range(20)] + [None, "", "menu", "menu\r\nmenu"]
    d = docs(spark, texts, {23: None})
    got = {r.doc_id: r for r in lines.dedup_lines(d).collect()}
    assert lines.dedup_lines(d).columns == d.columns and got[0].text == "unique 0\n\nend 0" and got[0].h == "h"
    assert (got[20].text, got[21].text, got[22].text, got[23].text) == (None, "", "", "menu\r\nmenu")
    assert lines.dedup_lines(d.limit(0)).count() == 0
    lines_seen = spark_rows(lines.dedup_lines(d.union(d)))[1]
    assert len(lines_seen) == 48


def test_urls(spark):
    u = ["http://Shop.NET/", "http://net", "https://www.example.net/en/x?q=/fr/", "http://example.net/e", "ftp://a.b.example.com/de/1#x", "http://badexample.com/de/1", "//x.org/fr/", "http://org/fr/a://b", None, "", "http://",
         "http://spam-farm.example.xyz/en", "http://x.net:80/", "http://a.org?x=/fr/", "http://lucky.casino/", "http://" + "a." * 50_000 + "example.com/de/1", "http://porn.example.xyz/"]
    d = spark.createDataFrame([(i, x, "x", "y", "z") for i, x in enumerate(u)], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(d.union(d)).collect()}
    assert urls.filter_urls(d.union(d)).count() == 2 * len(u)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for i, x in enumerate(u):
        rest = x.split("://", 1)[1] if x and "://" in x else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(LOW), re.match(r"[^?#]*", rest[len(raw):])[0]
        fit = max((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
        assert got[i] == (host, path, fit and fit[0] + fit[1], fit[2] if fit else "block" if host.endswith(".casino") else "allow")
    assert urls.filter_urls(d.limit(0)).count() == 0 and urls.filter_urls(d, rules=(), further=()).where("rule is not null").count() == 0


def test_minhash_blocks_of_one_bucket(spark, monkeypatch):
    """Loose families, in which no star reaches every link, with blocks of a few documents."""
    for name, n in (("BLOCK_MEMBERS", 5), ("BLOCK_STRAYS", 3), ("BLOCK_SHINGLES", 900)):
        monkeypatch.setattr(minhash, name, n)
    texts = family(words(150, 61), 70, 8, 62) + family(words(80, 63), 50, 5, 64)
    d = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 3, 85).collect()}
    s = [shingles(t, 3) for t in texts]
    linked = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    assert got == components(range(len(s)), linked) and 5 < len(set(got.values())) < len(texts)
