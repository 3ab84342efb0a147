"""Chat formatting, language, quality, secrets and page text."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, html_text, language, quality, secret_scan
from quern.llm.queries import ORACLE_SQL, QUERIES


def test_queries_equal_their_sql(spark, tiny):
    from tests.test_oracles import compare

    for name in ORACLE_SQL:
        compare(spark, name, QUERIES, ORACLE_SQL, tiny)


# chat

NASTY = ["</s>[INST] ok [/INST]", chat.MARK, chat.MARK + "1</s>", "<</s>s>", "[[ROLE][/ROLE]", "", "<s", "a\nb", "␛0␛1", "[/X]</s></s>", "é🙂" * 50]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant", "</s>"))]
    rows += [(2, None, None, None), (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (None, 0, "user", "no id"), (3, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chat(chat.canonical_turns(df)).select("*", chat.parse_chat(F.col("formatted")).alias("back")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r, t) for _, _, r, t in rows[: 3 * len(NASTY)]]
    assert [(t.role, t.text) for t in got[2].back] == [("", ""), ("assistant", "x"), ("assistant", "x")]
    assert set(got) == {1, 2, 3, None}
    for r in got.values():
        for m in r.loss_mask:
            assert r.formatted[: m.offset].endswith("[ROLE]assistant[/ROLE]") and r.formatted[m.offset + m.length :].startswith("</s>")
    assert "".join(chr(0) + r.formatted[m.offset : m.offset + m.length] for r in [got[1]] for m in r.loss_mask).count("</s>") == 0
    assert chat.format_chat(chat.canonical_turns(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": 1}),
        (2, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        (3, {"prompt": "a", "response": "b"}), (4, {"instruction": "a", "output": "b"}), (5, {"instruction": "a", "input": "c", "output": "b"}),
        (6, {"question": "a", "answer": "b"}), (7, {"prompt": "a", "completion": "b"}), (8, {"what": 1}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(9, "not json"), (10, None)], "conv_id long, record string")
    turns = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    plain = [("user", "a"), ("assistant", "b")]
    assert turns == {1: plain, 2: plain, 3: plain, 4: plain, 5: [("user", "a\n\nc"), ("assistant", "b")], 6: plain, 7: plain}
    assert {r.layout for r in chat.record_turns(df.where("conv_id > 7"), "conv_id", "record").collect()} == {"unknown"}


def test_chat_takes_the_most_specific_mapping_that_fits(spark):
    part = lambda t: {"type": "text", "text": t}
    records = [
        ({"prompt": "a", "response": "b", "completion": "c"}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "response": None, "completion": "c"}, [("user", "a"), ("assistant", "c")]),
        ({"question": "a", "answer": "b", "input": "x"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": "x", "output": "o", "prompt": "p"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": None, "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "b"}]}, [("user", None), ("assistant", "b")]),
        ({"messages": [{"role": "user", "content": [part("a"), "b", {"type": "image", "url": "u"}, part("c")]}, {"role": "model", "content": []}]}, [("user", 'ab{"type":"image","url":"u"}c'), ("assistant", "")]),
        ({"prompt": "a", "response": None}, [("user", "a"), ("assistant", None)]),
    ]
    odd = [{"messages": []}, {"prompt": "a"}, [1], "text"]
    rows = [(i, json.dumps(r)) for i, r in enumerate([r for r, _ in records] + odd)] + [(50, "{"), (51, None), (51, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumns({c: F.lit("clash") for c in ("v", "held", "layout", "fingerprint")})
    turns = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {i: t for i, (_, t) in enumerate(records)}
    lost = chat.unknown_records(df).collect()
    assert sorted((r.conv_id, r.record or "") for r in lost) == sorted((i, r or "") for i, r in rows if i >= len(records))
    assert all(len(r.fingerprint) == 64 for r in lost) and chat.unknown_records(df.limit(0)).count() == 0


# language


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    r = QUERIES["op2_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = r.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.97 and 0 <= held[1] and held[2] <= 1


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "²³ 12 !!", None), (4, None, "en"), (5, "", "en"), (6, "the dog " * 50_000, None), (7, "hundekatze", None), (1, "the cat", "en")],
        "doc_id long, text string, lang string",
    ).withColumn("score", F.lit("clash"))
    out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()}
    got = {k[0]: v for k, v in out.items()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "en" and got[7][0] == "de"
    empty = docs.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


def test_language_backoff():
    m = language.fit([("a", "xyz xyz pqr"), ("b", "lmn lmn opq")] * 5)
    assert (m.vector("xyz") == m.values[m.tables[0]["xyz"]]).all()
    assert m.langs[m.vector("xyzz").argmax()] == "a" and m.langs[m.vector("lmno").argmax()] == "b"
    assert not m.vector("日本").any()


@pytest.mark.parametrize("n", [1, 49, 50, 500])
def test_letter_like_numerals_are_no_words(n):
    assert language.words_of("\u2167 \u2160\u2161 " * n) == [] and len(language.words_of("\u2167 " * n + "a")) == n + 1
    assert language.fit([("a", "abc"), ("b", "xyz")]).predict("\u2167 " * n) == ("und", 0.0)


# quality


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    r = QUERIES["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    got = r.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] and got[2] <= 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD!! BAD!! ") * (1 + i % 3)) for i in range(60)] + [(98, None), (99, ""), (100, "good words " * 150_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (1, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs.withColumn("score", F.lit("x")), quality.train(docs, labels)).collect()}
    assert got[11] > got[10] and got[98] == got[99] and all(0 <= s <= 1 for s in got.values()) and got[100] > 0.5
    one = {r.score for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()}
    assert min(one) > 0.99
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


# secrets

BASE = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in BASE.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    parts = ["password=", "Token : ", "api_key", "APIKEY'=\"", "AKIA", "secret", "é🙂", " ", "=", "abc123DEF", "0" * 31, "f" * 33, "A1B2C3D4E5F6G7H8", "\n", "ſecret=", "passwd:", "x.y-z_/+="]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [s for s in secret_scan.scan(text) if s[2] in secret_scan.BASE] == brute(text), text


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + body


def keys() -> dict[str, bytes]:
    number = der(2, bytes(range(1, 30)))
    pkcs1 = der(0x30, der(2, b"\0") + number * 8)
    return {"pkcs1": pkcs1, "pkcs8": der(0x30, der(2, b"\0") + der(0x30, der(6, b"*\x86H") + der(5, b"")) + der(4, pkcs1)), "sec1": der(0x30, der(2, b"\1") + der(4, bytes(32)))}


@pytest.mark.parametrize("name", ["pkcs1", "pkcs8", "sec1"])
def test_confirmed_keys(name):
    data = keys()[name]
    text = base64.b64encode(data).decode()
    assert ("der" in [s[2] for s in secret_scan.scan(f"é key {text} end")]) and secret_scan.is_der_key(data)
    assert "der" in [s[2] for s in secret_scan.scan(f"k {data.hex()} end")]
    pem = f"-----BEGIN PRIVATE KEY-----\n{text}\n-----END PRIVATE KEY-----"
    assert (2, 2 + len(pem), "pem") in secret_scan.scan("a " + pem)
    broken = base64.b64encode(data[:1] + bytes([data[1] ^ 1]) + data[2:]).decode()
    assert not {"der", "pem"} & {s[2] for s in secret_scan.scan(f"key {broken} end")}


def test_confirmed_tokens():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.abc_DEF-1"
    assert [s for s in secret_scan.scan(f"x {good}, y")] == [(2, 2 + len(good), "jwt")]
    assert not secret_scan.scan(f"x {part({'typ': 'x'})}.{part({'sub': 1})}.abc y")
    field = lambda b: struct.pack(">I", len(b)) + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(b"p" * 40) + field(b"k" * 60)
    assert "ssh" in [s[2] for s in secret_scan.scan(base64.b64encode(ssh).decode())]
    assert "ssh" not in [s[2] for s in secret_scan.scan(base64.b64encode(ssh + b"x").decode())]


def test_redaction_keeps_rows(spark):
    docs = spark.createDataFrame([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "kept"), (2, None, "a"), (3, "", None), (3, "", None), (None, "clean", "b")], "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in secret_scan.redact(docs).collect()), key=repr)
    assert got == sorted([(1, '[SECRET assign]" x', "kept"), (2, None, "a"), (3, "", None), (3, "", None), (None, "clean", "b")], key=repr)
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0
    assert secret_scan.scan("a" * 3_000_000) == [(0, 3_000_000, "hex")]


def test_digest(spark):
    r = QUERIES["op7_secrets"](spark, "/root/testdata/sf0.01").where("n_assign + n_hex > 0").first()
    base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.BASE)
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


# pages


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain &amp; text", "plain & text"), ("<p>a<b>b</b>c<p>d<br>e", "abc d e"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One&nbsp; two\n three.</p></article><footer>f</footer>", "T One two three."),
        ("<article><header><h1>T</h1><span>by x</span></header><p>Body text.</p><aside>no</aside><form>no<input></form></article>", "T Body text."),
        ("<div class='cookie-notice'>We use cookies</div><div class=content><h2>H</h2><p>Long text of the page itself, with enough words.</p><p>More of it here, and more.</p></div><div id=comments><p>A reader says so.</p></div>", "H Long text of the page itself, with enough words. More of it here, and more."),
        ("<script>var a='</p><p>x';</script><style>p{}</style><p>x &lt;b&gt; y</p><!-- c <p>no</p> -->", "x <b> y"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a b 1 2"),
        ("<p title=don't>one</p> <p data-x='a>b' y=\"c>d\">it's</p>", "one it's"), ('<a href="x>one</a> two', "one two"),
        ("a < b and c > d <3", "a < b and c > d <3"), ("<p title='a>b'>x</p>", "x"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_equal_plain_reading(spark, tiny):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in QUERIES["op9_main_text"](spark, tiny).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())
        assert (r.text, r.n_chars) == (plain, len(plain))


def test_page_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "<p>x</p>" * 20_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(len(r.text) for r in html_text.extract_text(df).collect()) == [0, 0, 39_999]
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Real text of the page.</p><p class='notice'>We moved.</p><div class='article-header'><h2>H</h2><p>by x</p></div></article>", "Real text of the page. H"),
        ("<main><h1>T</h1><p>Text of the main part, long.</p><article class=comment><p>A reader.</p></article></main>", "T Text of the main part, long."),
        ("<div id=header><h1>Site</h1></div><div><p>Words of the page, enough of them to be dense.</p></div>", "Words of the page, enough of them to be dense."),
    ],
)
def test_furniture_by_name(page, text):
    assert html_text.main_text(page) == text


LONG = "Words of the page itself, enough of them to be dense, and then some more."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='layout has-sidebar'><div class=content><p>{LONG}</p></div><div class=sidebar>Other.</div></div>", LONG),
        (f"<div class='post with-comments'><p>{LONG}</p></div><div class='post-comments'><p>A reader.</p></div>", LONG),
        (f"<div class=widget><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><section id='related-work'><p>Others did so.</p></section><p id='search-methods'>We looked.</p></article>", f"{LONG} Others did so. We looked."),
        (f"<article><p>{LONG}</p><figure aria-label='Search volume'><figcaption>Volume.</figcaption></figure><p>See <a href=x aria-label='Read the related study'>this</a>.</p></article>", f"{LONG} Volume. See this."),
        (f"<article><p>Short text.</p></article><div class=comments><p>{LONG}</p></div>", "Short text."),
        (f"<div class='site-nav'>Home</div><article><p>{LONG}</p><div class='social-share'>Share it</div></article>", LONG),
    ],
)
def test_words_in_names_cut_no_text(page, text):
    assert html_text.main_text(page) == text


MORE = "Another paragraph of the page, as long as the first one is, or nearly so."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='market-share'><p>{LONG}</p><p>{MORE}</p></div><div class=share>Share</div>", f"{LONG} {MORE}"),
        (f"<div class='social-science'><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
        (f"<article><p>{LONG}</p><p class=alert>{MORE}</p><p class=alert>Log in</p><p class=notice>{LONG}</p></article>", f"{LONG} {MORE}"),
        (f'<head><script>var s="<body class=x>";</script></head><body><p>{LONG}</p></body>', LONG),
        (f"<html><head><title>t</title><meta x><p>{LONG}</p>", LONG),
    ],
)
def test_names_are_hints(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("name", ["user-comments", "reader_comments", "comment-thread", "related-posts", "RelatedStories", "ad-slot", "google-ads", "social-media", "cookie-consent-bar", "newsletter-signup-form", "site-notice", "breadcrumb-trail"])
def test_furniture_names_of_several_words(name):
    page = f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>Something beside it.</p></div><p>{MORE}</p></article>"
    assert html_text.main_text(page) == f"T {LONG} {MORE}"


@pytest.mark.parametrize("name", ["market-share", "research-methods", "comment-dit-on", "adventure", "navigation-history-of-ships", "notice-period-law", "header-files-in-c"])
def test_names_that_only_hold_a_word(name):
    page = f"<article><p>{LONG}</p><div class='{name}'><p>{MORE}</p></div></article>"
    assert html_text.main_text(page) == f"{LONG} {MORE}"


LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i} of the page</a>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div>{LINKS}</div><div><div><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div></div><div>Small print.</div>", f"Title {LONG} {MORE}"),
        (f"<main><article><p>{LONG}</p><p>{MORE}</p></article><div class='more-stories'>{LINKS}</div></main>", f"{LONG} {MORE}"),
        (f"<body><div><div><p>{LONG}</p><p>{MORE}</p></div><div><p>{MORE}</p><p>Ok.</p></div></div><div>{LINKS}</div>", f"{LONG} {MORE} {MORE} Ok."),
        (f"<body><article><h1>T</h1><p>Yes.</p><div><p>{LONG}</p><p>{MORE}</p><p>See <a href=x>this</a>.</p></div><p>End.</p></article><div><p>{LONG}</p></div>", f"T Yes. {LONG} {MORE} See this. End."),
        (f"<article><p>Short.</p></article><div><p>{LONG}</p><p>{MORE}</p></div>", "Short."),
        (f"<div class=ad><p>{LONG}</p><p>{MORE}</p></div><div><p>Short one.</p></div>", "Short one."), (f"<div class=ad><p>{LONG}</p></div>", LONG),
        (f"<article><p>One.</p></article><article><p>Two.</p></article><div><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
        (f"<body><div>{LINKS}</div>", " ".join(f"Link number {i} of the page" for i in range(6))),
        (f"<div><h1>Title</h1><div><p>{LONG}</p><p>{MORE}</p></div></div><div>x</div>", f"Title {LONG} {MORE}"),
    ],
)
def test_density_chooses(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_article_elements(spark):
    """The text is found without its element: the same for 95 pages of 100 and more."""
    import html

    same = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())
        assert html_text.main_text(r.html) == plain
        same += html_text.main_text(re.sub("<(/?)(?:article|main)>", r"<\1div>", r.html)) == plain
        total += 1
    assert same >= 0.95 * total


@pytest.mark.parametrize("page, text", [("a <b", "a"), ("a < b", "a < b"), ("<p>a <!-- x", "a"), ("<p>a<", "a<"), ("x <!-- a <b", "x"), ("<p>x</p", "x"), ("<a " * 60_000, "<a " * 59_999)])
def test_pages_that_break_off(page, text):
    assert html_text.main_text(page) == " ".join(text.split())


def block(label: str, body: str, end: str = "\n") -> str:
    return f"-----BEGIN {label}-----{end}{body}{end}-----END {label}-----"


def kinds_in(text: str) -> list[str]:
    return [s[2] for s in secret_scan.scan(text) if s[2] not in secret_scan.BASE]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_encrypted_blocks_are_confirmed_by_their_header(end):
    blocks = base64.b64encode(bytes(range(160))).decode()
    header = f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,{'0A' * 16}{end}{end}"
    assert kinds_in("x " + block("RSA PRIVATE KEY", header + blocks[:64] + end + blocks[64:], end)) == ["pem"]
    uneven = base64.b64encode(bytes(range(161))).decode()
    assert kinds_in(block("RSA PRIVATE KEY", header + uneven, end)) == []
    assert kinds_in(block("RSA PRIVATE KEY", f"Proc-Type: 4,ENCRYPTED{end}{end}" + blocks, end)) == []
    assert kinds_in(block("ENCRYPTED PRIVATE KEY", "hello world this is not a key at all")) == []
    plain = base64.b64encode(keys()["pkcs8"]).decode()
    assert kinds_in(block("PRIVATE KEY", f"Comment: mine{end}{end}{plain}", end))[0] == "pem"


def test_blocks_without_an_end_cost_no_more_than_their_length():
    good = block("PRIVATE KEY", base64.b64encode(keys()["sec1"]).decode())
    text = "-----BEGIN RSA PRIVATE KEY-----\nab\n" * 60_000 + "-----BEGIN PRIVATE KEY-----\n" * 3 + good + "-----END RSA PRIVATE KEY-----"
    found = [s for s in secret_scan.scan(text) if s[2] == "pem"]
    assert found == [(text.index(good), text.index(good) + len(good), "pem")]


@pytest.mark.parametrize("alg", ["", "a", "none", "HS256"])
def test_short_tokens_are_found(alg):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")
    token = f"{part({'alg': alg})}.{part({})}."
    assert len(token) >= secret_scan.RUN and kinds_in(token) == kinds_in(f"a {token} b") == ["jwt"]
    assert secret_scan.added_spans(token) == [(0, len(token), "jwt")]


# language and quality against plain restatements


def slow_language(rows: list[tuple[str, str]], text: str) -> tuple[str, float]:
    """The method written out with dictionaries and fractions of counts, one word at a time."""
    import math

    words: dict[str, list[str]] = {}
    for lang, t in rows:
        words.setdefault(lang, []).extend(re.findall(r"[^\W\d_]+", t.lower()))
    langs = sorted(words)
    pad = lambda w, n: f"<{w}>" if n > 1 else w
    counts = {0: {x: {} for x in langs}} | {n: {x: {} for x in langs} for n in (1, 2, 3, 4)}
    for lang in langs:
        for w in words[lang]:
            counts[0][lang][w] = counts[0][lang].get(w, 0) + 1
        for w, k in counts[0][lang].items():
            for n in (1, 2, 3, 4):
                p = pad(w, n)
                for i in range(len(p) - n + 1):
                    counts[n][lang][p[i : i + n]] = counts[n][lang].get(p[i : i + n], 0) + min(k, 3)

    def row(n: int, item: str) -> list[float] | None:
        c = [counts[n][x].get(item, 0) for x in langs]
        if sum(c) < (2 if n == 0 else 3):
            return None
        size = len({k for x in langs for k in counts[n][x]})
        v = [math.log((k + 0.5) / (sum(counts[n][x].values()) + 0.5 * size)) for k, x in zip(c, langs)]
        return [a - sum(v) / len(v) for a in v]

    def score(w: str) -> list[float]:
        if (known := row(0, w)) is not None:
            return known
        for n in (4, 3, 2, 1):
            p = pad(w, n)
            found = [r for i in range(len(p) - n + 1) if (r := row(n, p[i : i + n])) is not None]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(langs)

    asked = re.findall(r"[^\W\d_]+", text.lower())
    total = [sum(c) for c in zip(*map(score, asked))]
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    shares = [math.exp((t - total[best]) / max(1.0, math.sqrt(len(asked)))) for t in total]
    return langs[best], 1 / sum(shares)


def test_language_equals_a_slow_scorer():
    rng = random.Random(8)
    letters = {"a": "abcdefg", "b": "efghijk", "c": "aeimoqu"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 5)))
    rows = [(x, " ".join(word(x) for _ in range(30))) for x in "abc" for _ in range(6)]
    model = language.fit(rows)
    for _ in range(60):
        text = " ".join(word(rng.choice("abc")) for _ in range(rng.randint(1, 12))) + " 12 _ !"
        got, expected = model.predict(text), slow_language(rows, text)
        assert got[0] == expected[0] and abs(got[1] - expected[1]) < 1e-4, text


def test_repeated_rows_teach_once(spark):
    rows = [(1, "the cat", "en")] * 500 + [(None, "der hund", "de")] * 500 + [(2, "the dog", "en"), (3, "die katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = docs.dropDuplicates()
    assert {r.lang_pred for r in language.identify(once, language.train(docs, sample=10**6)).collect()} == {"en", "de"}
    import pickle

    a, b = (pickle.loads(language.train(d, sample=10**6))[1] for d in (docs, once))
    assert a == b


def test_descent_reaches_the_least_loss():
    import numpy as np

    rng = np.random.default_rng(2)
    n, width = 60, 25
    dense = (rng.random((n, width)) < 0.3) * rng.normal(size=width)
    y = np.where(dense[:, 0] - dense[:, 1] + 0.2 * rng.normal(size=n) > 0, 1, -1)
    docs = [np.flatnonzero(r) for r in dense]
    norms = [float(np.sqrt((r**2).sum())) or 1.0 for r in dense]
    values = [r[f] / s for r, f, s in zip(dense, docs, norms)]
    unit = np.stack([r / s for r, s in zip(dense, norms)])
    cost = np.where(y == 1, 1.3, 0.8)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + float((cost * np.maximum(0, 1 - y * (unit @ w + b))).sum())

    # The dual by projected gradient, from its definition: maximise sum(a) - |sum a y x|^2 / 2 with 0 <= a <= cost.
    x = np.hstack([unit, np.ones((n, 1))]) * y[:, None]
    a = np.zeros(n)
    for _ in range(40_000):
        a = np.clip(a + 0.01 * (1 - x @ (a @ x)), 0, cost)
    best = a.sum() - 0.5 * ((a @ x) ** 2).sum()
    w, b = quality.descend(docs, values, y, cost, np.arange(n), epochs=2000)
    assert abs(loss(w[:width], b) - best) < 1e-2 * best
    w, b = quality.descend(docs, values, y, cost, np.arange(n))
    assert loss(w[:width], b) < 1.05 * best


def test_features_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "a", "B1", "c-d", "EE", "x" * 40 + "?", "a1b-c2_d3.e4:f5/x", "a1b-c2_d3.e4:f5/x?y=z"]) for _ in range(400))
    whole = quality.Features().of(text)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert (quality.Features().of(text) == whole).all() and len(quality.Features().of(text)) == len(whole)
    assert quality.shape("a1b-c2_d3.e4:f5/x") != quality.shape("a1b-c2_d3.e4:f5/x?y=z")
