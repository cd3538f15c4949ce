"""Time on adversarial texts, spans of the added rules, shards of a large token file."""

import random
import re
import time

import pytest

from common import frame
from factloom.llm import htmltree, secretscan, tokenfile


def _seconds(f):
    start = time.process_time()
    f()
    return time.process_time() - start


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 30_000 + "</p>" * 30_000,
        "<b>" * 30_000 + "<div></div>" * 30_000,
        "<section>" * 30_000 + "</article>" * 30_000,
        "<div>" * 30_000 + "<li>x" * 30_000,
        "<p>" * 60_000,
    ],
)
def test_deep_pages_take_linear_time(page):
    assert _seconds(lambda: htmltree.parse(page)) < 15


@pytest.mark.parametrize("page", ["a</p>b<p>c</p>d", "<div>a</b></i>b</div>c", "<p><b>x<div>y</div></b>z</p>", "<ul><li>a<li>b<ul><li>c</ul></ul>", "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_blocks_of_unclosed_elements(page):
    """What is looked for in the stack, or not, gives the blocks of a plain walk over the tags."""
    text = [t for _, t in htmltree.parse(page).blocks]
    assert " ".join(text).split() == re.sub(r"<[^>]*>", " ", page).split() or "".join(text) == re.sub(r"<[^>]*>", "", page)


def test_cues_need_a_name_of_their_own():
    named = lambda a: htmltree.parse(f"<div {a}>x</div>").cues[1]
    assert named('data-class="sidebar" data-id="menu"') == named("") != named('class="sidebar"')


def test_tokens_without_dots_take_linear_time():
    rule = next(r for r in secretscan.RULES if r.kind == "web_token")
    pattern = re.compile(rule.pattern)
    assert _seconds(lambda: pattern.findall("eyJ" * 400_000)) < 5
    assert pattern.findall("x eyJabcdefgh.abcdefgh.abcdefgh y") == ["eyJabcdefgh.abcdefgh.abcdefgh"]


def test_added_rules_equal_a_plain_scan(spark):
    """Every span of the rules beyond the base ones, held against a scan of the whole text for each rule."""
    rng = random.Random(11)
    parts = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 20, "ghx_" + "a" * 40, "xoxb-12345-abcdef", "sk_live_" + "Z9" * 10, "rk_test_short", "eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM", "eyJeyJeyJ", "https://user:secret@host/x", "ftp://u:p@h", "words", " ", "\n", "é"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(80)] + [(90, None), (91, "")]
    got = {r.doc_id: r.spans for r in secretscan.digest(secretscan.scan_secrets(frame(spark, rows).select("doc_id", "text"))).collect()}
    names = [r.kind for r in secretscan.RULES]
    for i, text in rows:
        want = []
        for rule in secretscan.RULES:
            for m in re.finditer(rule.pattern, text or ""):
                if rule.accept(m):
                    want.append((m.start(), names.index(rule.kind), m.end()))
        assert got[i] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(want)), text


def test_shards_are_not_bounded_by_the_sample(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SAMPLE", 20)
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 100)
    rows = spark.range(2_000).selectExpr("id AS key", "hash(id) AS h", "id AS row", "10 AS size")
    bounds = tokenfile._bounds(rows, 1)
    assert 150 < len(bounds) < 400 and bounds == sorted(bounds)
