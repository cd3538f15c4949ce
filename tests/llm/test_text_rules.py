"""Secrets, personal data, quality and page extraction against brute force and held-out labels."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from common import awkward, frame
from factloom.llm import htmltree, pii, quality, secretscan

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def _secret_rows(seed):
    rng = random.Random(seed)
    bits = ["password", "PassWord", "passwd", "secret", "toKen", "api_key", "APIKEY", "ſecret", "=", ":", " ", "'", '"', "abcdef", "12", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "é😀", ": ", "x.y/z"]
    return [*enumerate("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)), *[(10_000 + i, t) for i, t in awkward(seed)], (None, "token = abcdefgh")]


def test_secret_query(spark):
    rows = _secret_rows(1)
    names = ["assign", "access", "hex"]
    want = sorted((-1 if i is None else i, *(sum(k == j for _, k, _ in _secrets(t)) for j in range(3)), sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in _secrets(t)).encode()).hexdigest()) for i, t in rows)
    found = secretscan.digest(secretscan.scan_secrets(frame(spark, rows))).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == want
    assert secretscan.scan_secrets(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rule", secretscan.RULES, ids=lambda r: r.kind)
def test_trigrams_are_mandatory(rule):
    """Every match of a rule holds one alternative of its query."""
    samples = {"assign": 'Api_Key": "zzzzzz', "access": "AKIA" + "Q" * 16, "hex": "ab12" * 6, "private_key": "-----BEGIN RSA PRIVATE KEY-----", "code_host": "ghs_" + "a1" * 18, "chat": "xoxp-" + "1" * 10, "payment": "rk_live_" + "x" * 16, "web_token": "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMe", "login_url": "https://user:pass@"}
    text = samples[rule.kind]
    assert re.fullmatch(rule.pattern, text)
    q = secretscan.trigram_query(rule.pattern)
    low = text.lower().encode()
    assert (q is None) == (rule.kind == "hex")
    assert q is None or any(all(g in low for g in s) for s in q)


def test_redaction(spark):
    rows = [(1, "a password=hunter22 b AKIA" + "Z" * 16), (2, "clean"), (3, None)]
    out = secretscan.redact_secrets(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [SECRET] b [SECRET]", 2: "clean", 3: None}


def _luhn(x):
    z = 0
    for k, c in enumerate(reversed(x)):
        v = int(c) * (2 if k % 2 else 1)
        z += v - 9 if v > 9 else v
    return z % 10 == 0


def _pii(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern, ok in ((2, r"[0-9]([\x20-]?[0-9])+", lambda d: 14 <= len(d) <= 19 and _luhn(d)), (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 10 <= len(d) <= 15)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if ok(re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_pii_query(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "a@b", "x+y%", "@", ".", "é😀", "1.2.3.4", "999.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (274) 555-9629", "+1-2-", "+", "0255.00.1.2", " ", "-", "12", "\n", "a.b-c", "55", "@d.e.f.", "+12((("]
    rows = [*enumerate("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)), *[(10_000 + i, t) for i, t in awkward(3)], (20_000, "a@b" + ".c" * 20_000 + " " + "1 " * 20_000 + "9" * 20_000 + "+1" + "(" * 20_000), (None, "me@here.org")]
    names = list(pii.BASE)
    want = sorted((-1 if i is None else i, *(sum(k == j for _, k, _ in _pii(t)) for j in range(4)), sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in _pii(t)).encode()).hexdigest()) for i, t in rows if i != 20_000)
    found = pii.digest(pii.personal_data(frame(spark, rows))).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found if r.doc_id != 20_000) == want
    assert [r.n_email for r in found if r.doc_id == 20_000] == [1]
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_contexts_discover_identifiers(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{some(20)} my phone +1 (274) 555-{1000 + i} {some(9)}") for i in range(40)]
    rows += [(100, f"{some(5)} my phone 555-2001, then"), (101, f"{some(5)} code 555-2001"), (102, "only 1990 years and 12345 apples")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(frame(spark, rows))).collect() if r.doc_id >= 100}
    at = rows[40][1].index("555-")
    assert got == {100: f"found_phone:{at}:{at + 8}", 101: "", 102: ""}


def _found(spark, rows):
    """Texts of the discovered spans by document."""
    text = dict(rows)
    return {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.pii_spans if s.kind >= len(pii.BASE)] for r in pii.personal_data(frame(spark, rows)).collect()}


@pytest.mark.parametrize("known, unknown", [(5, 1), (8, 2), (400, 100)])
def test_unknown_instances_are_no_negatives(spark, known, unknown):
    rows = [(i, f"so my phone +1 (274) 555-{1000 + i} is") for i in range(known)] + [(1000 + i, f"so my phone 555-{2000 + i} is") for i in range(unknown)]
    got = _found(spark, rows)
    assert all(got[1000 + i] == [f"555-{2000 + i}"] for i in range(unknown)) and not any(got[i] for i in range(known))
    weak = [(i, f"so in the +1 (274) 555-{1000 + i} is") for i in range(6)] + [(1000 + i, f"so in the {20000 + i} is") for i in range(60)]
    assert not any(_found(spark, weak).values())


def test_discovery_goes_on_to_the_last_round(spark):
    at = [("my phone", [f"+1 (274) 555-{1000 + i}" for i in range(200)] + [f"555-{2000 + i}" for i in range(60)])]
    at += [("office line", [f"555-{2000 + i}" for i in range(60)] + [f"555-{3000 + i}" for i in range(12)])]
    at += [("desk no", [f"555-{3000 + i}" for i in range(12)] + [f"555-{4000 + i}" for i in range(2)])]
    rows = list(enumerate(f"so {label} {x} is" for label, xs in at for x in xs))
    got = _found(spark, rows)
    assert [got[i][0] for i, t in rows if " 555-" in t and "+1" not in t] == [t.split()[3] for _, t in rows if "+1" not in t]


def test_context_reaches_over_other_candidates(spark):
    rows = [(i, f"mail a{i}@b.org then c{i}@d.org ok") for i in range(40)] + [(100, "mail a77@b.org then q5@host ok"), (101, "x 12 q5@host ok"), (102, "1 2345 6789 q5@host")]
    got = _found(spark, rows)
    assert got[100] == ["q5@host"] and not got[101] and not got[102]
    occ = pii.occurrences(frame(spark, [(1, "tel 5551 5552 a=x@y.z,v@w.z 5553 to b@c 77 d@e f1")]))[1]
    words = {r.m: (pii_words(r.left), pii_words(r.right)) for r in occ.collect() if r.kind == 99}
    assert set(words) == {"5551 5552", "a=x@y.z,v@w.z", "5553", "b@c", "77", "d@e", "f1"}
    for m, (left, right) in words.items():  # three words on either side, whatever lies between, or all there are
        before, after = "tel 5551 5552 a=x@y.z,v@w.z 5553 to b@c 77 d@e f1".split(m, 1)
        assert left[-3:] == before.split()[-3:] and right[:3] == after.split()[:3], m


def pii_words(side):
    return [w for w in side.split() if w]


def _measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def _labelled(seed, count=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    out = []
    for i in range(count):
        bad = i % 4 == 0
        lines = []
        for _ in range(rng.randint(3, 9)):
            w = [rng.choice(words) for _ in range(rng.randint(8, 25))]
            if bad:
                w = rng.choice([[x + "***" for x in w], [x.upper() + "!!" for x in w], [w[0]] * len(w), [y for x in w for y in (x, "|")]])
            lines.append(" ".join(w).capitalize() + "." if not bad else " ".join(w))
        out.append((i, "\n".join(lines), 0 if bad else 1))
    return out


def test_quality_counts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab \n\t|é😀\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in [*texts, None, "", "a b c a b c", "a b c d", "x\nx\n \nx"]:
        assert quality.measure(t)[0] == _measures(t), t


def test_quality_held_out(spark):
    rows = _labelled(1)
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows[:200]] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, text string")
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    field = quality.train_field(docs, labels)
    good = total = 0
    for _, t, q in rows[200:]:
        counts, feats, sizes = quality.measure(t)
        share = sum(n for n, s in zip(sizes, field.label(feats), strict=True) if s) / counts[0]
        good, total = good + ((share >= 0.5) == bool(q)), total + 1
    assert good / total > 0.95
    kept = {r.doc_id for r in quality.judge(docs, field).where("kept").collect()}
    assert kept == {r.doc_id for r in quality.keep_good(docs, field).collect()}
    assert quality.keep_good(docs, field).columns == docs.columns


def test_quality_edges(spark):
    field = quality.train_field(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    rows = [*awkward(8, 30), (None, "word " * 60)]
    got = quality.judge(frame(spark, rows), field).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5_000}
    for i, t in rows:
        if i != 5_000:
            r, m = by[i], _measures(t) if len(t or "") < 9_000 else None
            assert m is None or [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == m
            assert r.kept == (not r.base_failed)
    assert quality.judge(frame(spark, []), field).count() == 0


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    import itertools

    for _ in range(30):
        f = quality.LineField(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
        x = rng.random((6, len(quality.FEATURES)))
        e = x @ f.emit
        best = max(itertools.product((0, 1), repeat=6), key=lambda y: sum(e[k, s] for k, s in enumerate(y)) + sum(f.move[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert f.label(x.tolist()) == list(best)


@pytest.fixture(scope="module")
def model():
    return htmltree.train_model(composed=160)


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, -1, 5])
    m = htmltree.TreeModel(rng.normal(size=len(htmltree.FEATURES)), rng.normal(size=(2, 2)))
    x = rng.random((7, len(htmltree.FEATURES)))
    e = x @ m.weight
    total, one = 0.0, np.zeros(7)
    for y in itertools.product((0, 1), repeat=7):
        p = np.exp(sum(e[k] * s for k, s in enumerate(y)) + sum(m.pair[y[parent[k]], y[k]] for k in range(7) if parent[k] >= 0))
        total += p
        one += p * np.array(y)
    assert np.allclose(m.beliefs(x, parent), one / total)


def test_extraction_held_out(model):
    wrong = 0
    pages = htmltree.composed_pages(150, seed=1234)
    for source in pages:
        page = htmltree.parse(source)
        got = model.texts([page])[0]
        wrong += got != "\n\n".join(t for e, t in page.blocks if page.mark[e])
    assert wrong / len(pages) < 0.1


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', "style='overflow: hidden'", 'class="hidden md:block"', "class=hidden", 'title="a > hidden b"', 'aria-hidden="false"', 'data-hidden'])
def test_only_the_hidden_attribute_hides(attrs):
    texts = lambda a: [t for _, t in htmltree.parse(f"<html><body {a}><div {a}><p>Some text.</p></div></body></html>").blocks]
    assert texts(attrs) == ["Some text."]


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', 'class="x" hidden', 'hidden="until-found" id=a', "style='a:b'hidden/"])
def test_hidden_attribute_hides(attrs):
    assert [t for _, t in htmltree.parse(f"<body><div {attrs}><p>Unseen.</p></div><p>Seen.</p></body>").blocks] == ["Seen."]


def test_extraction(spark, model):
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><!-- ad --><div class="ad">Buy now, it is good.</div>
    <article><h1>Big &amp; small</h1><p><b>First  line<br>goes on.<p>Second&nbsp;one &lt;ok&gt; &#233;.</p><p>Third is the last of all the paragraphs here.</article>
    <div class="comment"><p>I disagree with all of it.</p></div><footer>&copy; me &middot; all rights.</footer></body></html>"""
    rows = [(1, "u", page, None), (2, None, None, None), (3, "v", "", "x"), (4, "w", "<html><body><script>a()</script></body></html>", None), (None, "z", "<p>" * 2000, None), (1, "u", page, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltree.extract(df, model).collect())
    want = "Big & small\n\nFirst line goes on.\n\nSecond one <ok> é.\n\nThird is the last of all the paragraphs here."
    assert got == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0)]
    assert htmltree.extract(df.limit(0), model).count() == 0


def test_training_takes_one_row_per_key(spark):
    from factloom.llm import quality

    rows = [(i, f"The {i} lines of this text are plain words.\nAnd more of them follow here." if i % 2 else "menu | home | login\n$$ % # |") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once = quality.train_field(frame(spark, rows), labels)
    more = quality.train_field(frame(spark, rows + rows[:7] * 5 + [(1, "zz later text")]), labels)
    assert (once.emit == more.emit).all() and (once.move == more.move).all()
