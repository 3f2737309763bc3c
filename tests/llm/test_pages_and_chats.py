"""HTML extraction and chat formatting."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import chat_format, html_extract

PAGES = "page_id long, url string, html string"


def page(article, extra="", host="a.example.org", attrs='class="post"'):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><header><h1>Site</h1></header><div class="sidebar">side text that is long enough to be tempting for a while</div>
<div id="cookie-notice">we use cookies</div><!-- <p>comment</p> --><div {attrs}>{article}</div>{extra}
<form><p>subscribe</p><input></form><section class="comments"><p>First! {'really long reader comment ' * 20}</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    article = "<h2>A &amp; B</h2><p>One <b>two</b>\n three&nbsp;four.<p>Five<br>six <a href='#'>link</a>.<ul><li>i1<li>i2</ul><div class='ad'>buy</div><blockquote>q</blockquote>"
    rows = [(i, f"http://a.example.org/{i}", page(article)) for i in range(3)] + [(10, None, None), (11, "http://b.example.org", ""), (12, "nonsense", "plain text <b>only"), (13, "http://a.example.org/13", page("<p>short</p>", attrs='class="post-77"'))]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    want = "A & B\nOne two three four.\nFive six link.\ni1\ni2\nq"
    assert all(got[i]["text"] == want and got[i]["n_chars"] == len(want) for i in range(3))
    assert got[10]["text"] == "" and got[11]["text"] == "" and got[12]["text"] == "plain text only" and got[13]["text"] == "short"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_host_consensus_beats_a_page_of_its_own(spark):
    usual = [(i, f"https://h.example.org/{i}", f"<body><div class='story s{i}'><p>{'main words ' * 40}</p></div><div class='extra'><p>{'aside ' * 5}</p></div></body>") for i in range(5)]
    odd = (9, "https://h.example.org/9", f"<body><div class='story s9'><p>short main</p></div><div class='extra'><p>{'aside text ' * 60}</p></div></body>")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([*usual, odd], PAGES)).collect()}
    assert got[9] == "short main"


@pytest.mark.parametrize(
    "source",
    [
        "<body style='overflow:hidden'>{}</body>", "<html aria-hidden='false'><body>{}</body></html>", "<body class='with-header no-sidebar'>{}</body>", "<body><article class='post no-sidebar'>{}</article></body>",
        "<body><main class='with-sidebar search' data-x='hidden'>{}</main></body>", "<body><div id='content-search-off'>{}</div></body>", "<body hidden>{}</body>", "<body title=don't><article>{}</article></body>", "<body data-a='>' data-b=\">\"><svg><svg><text>x</text></svg><p>in the drawing</p></svg>{}</body>", "<body><div class='overlay'><article>{}</article></div></body>",
    ],
)
def test_names_do_not_leave_out_articles(source):
    assert html_extract.Page(source.format("<p>the text of the page</p><div class='sidebar'>side</div><p hidden>not this</p>")).text(None) == "the text of the page"


@pytest.mark.parametrize("layout", ["<article>{}</article>", "<main class='m'>{}</main>", "<main><article class='a'>{}</article></main>", "<div class='post'>{}</div>", "<div class='page'><section class='post'>{}</section></div>"])
def test_nested_layouts_stay_whole(spark, layout):
    lead, body, more = "lead " * 60, "body text " * 200, "more text " * 60
    article = f"<h1>Title</h1><p class='lead'>{lead}</p><div class='body'><p>{body}</p></div><div class='second'><p>{more}</p></div>"
    want = "\n".join(["Title", lead.strip(), body.strip(), more.strip()])
    source = f"<body><nav>menu</nav>{layout.format(article)}<div class='sidebar'>{'side ' * 20}</div><footer>f</footer></body>"
    got = html_extract.extract(spark.createDataFrame([(i, f"http://n.example.org/{i}", source) for i in range(3)], PAGES)).collect()
    assert [r["text"] for r in got] == [want] * 3


@pytest.mark.parametrize("source", ["<", "<p", "<!--", "<p class='x>y", "</p></div>", "<script>", "&#x110000; &bogus; &amp", "<a href='" + "x" * 50_000, "<div>" * 3000 + "deep", "<p>" * 5000 + "x"])
def test_broken_html(source):
    p = html_extract.Page(source)
    assert isinstance(p.text(None), str)


CONVS = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|/s>[INST]\\ ab\n", max_size=30) | st.text(max_size=20))
def test_escaping_is_reversible(text):
    e = chat_format.escape(text)
    assert chat_format.unescape(e) == text
    assert "<|" not in e and "</s>" not in e and "[INST]" not in e


def digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back(spark):
    rng = random.Random(1)
    pieces = ["<|end|>\n", "</s>", "[INST]", "<\\|", "\\", "hello", "é🙂", "\n", "<|turn|>", "<", "|>"]
    convs = {c: [(rng.choice(["user", "assistant", "system", "", None, "<|text|>"]), rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))] for c in range(40)}
    convs[77] = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)]
    rows = [(c, i, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)]
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, CONVS))).collect()}
    for c, v in convs.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(v)
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], CONVS))).collect() == []


def test_null_conversation_and_turn(spark):
    rows = [(None, None, "user", "a"), (None, 0, "assistant", "b"), (0, 1, "user", "c"), (0, 1, "user", "c")]
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, CONVS))).collect()}
    assert got == {None: 2, 0: 2}


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [("text", "see <|image:0|> ", None, None, None, None, None), ("image", None, "s3://i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "ok", None)], f"{CONVS}, parts array<{part}>")
    rows = {r["turn"]: r for r in chat_format.format_turns(df).collect()}
    assert "see <\\|image:0|> <|image:0|><|audio:1|><|document:2|>end" in rows[0]["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in rows[0]["attachments"]] == [("image", "s3://i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 1536)]
    assert rows[0]["expanded_tokens"] == 4 + 50 + 1536
    a = rows[0]["attachments"][0]
    start = rows[0]["formatted"].index(chat_format.BODY) + len(chat_format.BODY)
    assert rows[0]["formatted"][start + a["offset"] :].startswith("<|image:0|>")
    assert rows[1]["formatted"][rows[1]["loss_start"] : rows[1]["loss_end"]] == "ok" and rows[0]["loss_start"] is None
    with pytest.raises(ValueError):
        chat_format.PartVisitor().flatten([{"type": "video"}])
