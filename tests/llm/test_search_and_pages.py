"""Exact top-k search, HTML extraction, preference formatting."""

import math
import random
import re

import pytest

from lodestone.llm import html_template as ht
from lodestone.llm import pivot_search as ps
from lodestone.llm import preference as pf

VECTORS = "vec_id long, embedding array<float>, score string, x string"


def brute(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            scored = sorted(((-held(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in ok if i != q))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("annulus, shard", [(7, 40), (1024, None)])
def test_top_k_equals_brute_force(spark, annulus, shard):
    r = random.Random(5)
    rows = [(i, [single(r.gauss(0, 1) * (1 + (i % 3))) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # one vector many times: ties
    rows += [(400, None), (401, [1.0, None, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (440, [0.0] * 6), (None, rows[0][1]), (404, rows[0][1][:3])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], VECTORS)
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ps.search(df, annulus_rows=annulus, shard_rows=shard, pivots=8).collect()}
    assert got == brute(rows)


def test_large_components_and_repeated_ids(spark):
    r = random.Random(6)
    rows = [(i, [single(r.gauss(0, 1) * 10.0 ** r.choice([0, 8, 37])) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], VECTORS)
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ps.search(df, annulus_rows=8, shard_rows=16, pivots=4).collect()}
    assert got == brute(rows)
    twice = [(20, [2.0, 1.0]), (20, [1.0, 5.0]), (7, [1.0, 1.0]), (7, [3.0, 0.0]), (20, [1.0, 5.0])]
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ps.search(spark.createDataFrame([(i, v, "", "") for i, v in twice], VECTORS)).collect()]
    assert sorted(got) == [(20, 1, 7, 64 * 64 * 6), (20, 2, 7, 64 * 64 * 3)]


def test_walks_stop_early_on_clustered_vectors():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    centres = r.normal(size=(16, 8))
    x = np.concatenate([c / np.linalg.norm(c) + 0.01 * r.normal(size=(500, 8)) for c in centres])
    x = np.floor(6400 * x / np.linalg.norm(x, axis=1, keepdims=True))
    ids = np.arange(len(x))
    top = float((x * x).sum(1).max())
    longer = np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)
    space = ps.Space(np.stack([longer[k * 500 : (k + 1) * 500].mean(0) for k in range(16)]), top, 8)
    d = space.distances(x)
    p = d.argmin(1)
    order = np.lexsort((ids, d.min(1), p))
    batch = pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(list(x[order])), pa.array(p[order].astype(np.int32)), pa.array(d.min(1)[order])], ["vec_id", "x", "pivot", "dist"])
    shards = [ps.Shard.of(row) for b in ps._pack(8, 100, 10**6)(iter([batch])) for row in b.to_pylist()]
    made = 0
    for q in range(0, len(x), 400):
        best = ps.Best(1, 20)
        made += sum(ps.walk(space, s, ids[q : q + 1], x[q : q + 1], best) for s in shards)
        score = x @ x[q]
        score[q] = -np.inf
        assert best.ids.tolist() == np.lexsort((ids, -score))[:20].tolist()
    assert made < 0.3 * len(x) * 20


def test_fewer_candidates_than_k_and_an_empty_table(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (1, [0.5, 0.5], "", "")], VECTORS)
    assert [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ps.search(few).collect()] == [(0, 1, 1, 64 * 32 + 128 * 32)]
    assert ps.search(few.where("vec_id > 5")).count() == 0


def page(title, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>{title} &amp; co</title><style>p{{a:b}}</style><script>var x="</p><article>";</script></head><body>
<header>Site header</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- no --><div class="cookie-notice">We use cookies</div><aside class=sidebar>Side</aside>
<article><h1>{title}</h1>{body}<div class="ad">Buy!</div><form><input><button>Send</button></form><section id="comments"><p>nice post</p></section></article>{extra}<footer>&copy; host</footer></body></html>"""


CASES = {
    1: (page("A &lt;b&gt;", "<p>one\n  <b>two</b> &eacute;&nbsp;x</p><p>three<br>four"), "A <b>\none two é x\nthree four"),
    2: (page("T", "<p><b>open bold<br><p>next</p><ul><li>i<li>j</ul>"), "T\nopen bold\nnext\ni\nj"),
    3: (None, ""),
    4: ("", ""),
    5: ("just text &amp; more", "just text & more"),
    6: ("<p>a<p>b <script>if (a<b) {}</script>c", "a\nb c"),
    7: ("<article><p>broken <a href='x>y'>link</a> 1 < 2</article", "broken link 1 < 2"),
    8: (page("Same", "<p>same text</p>"), "Same\nsame text"),
    9: (page("Same", "<p>same text</p>"), "Same\nsame text"),
    10: ("<article><p>" + "word " * 30000 + "</p></article>", "word " * 29999 + "word"),
}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_main_text(spark, limit):
    rows = [(i, None if i == 5 else f"https://User@H.example:80/{i}", h, "t", "o") for i, (h, _) in CASES.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, tokens string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in ht.extract(df, broadcast_tokens=limit).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in CASES.items()}
    assert ht.extract(df.where("page_id > 99")).count() == 0


KEPT = [
    ('<body class="no-sidebar"><p>text</p></body>', "text"),
    ('<body class="sidebar"><article class="post comments"><p>text</p></article></body>', "text"),
    ('<article class="has-nav single"><div class="post-header"><h1>T</h1></div><p class="social-policy">text</p><p id="related-work">more</p></article>', "T\ntext\nmore"),
    ('<div class="widget"><article><p>text</p></article></div><div class="related"><p>away</p></div>', "text"),
    ('<form><main><p>text</p></main></form>', "text"),
    ('<article><p data-id="ad" title=" class=ad ">text</p><div class="header"><h2>T</h2></div></article>', "text\nT"),
    ('<article><p>text</p><div class="x ad">Buy!</div></article><aside><article>teaser</article></aside>', "text"),
]


def test_names_cut_nothing_but_asides():
    for html, want in KEPT:
        assert ht.main_text(html, None) == want, html
    part = '<article><p>text</p><div class="notice">Section 3</div></article>'
    events = ht.read(part)
    role = {name: r for (kind, name, _), r in zip(events, ht.roles(events), strict=True) if kind == "open"}
    assert ht.main_text(part, ht.Template(asides=frozenset({role["div.notice"]}))) == "text"
    assert ht.main_text(part, ht.Template(asides=frozenset({role["article"]}))) == "text\nSection 3"


def bare(page):
    """The page without semantic tags, classes and ids."""
    return re.sub(' (class|id|role)=("[^"]*"|[^ >]*)', "", re.sub("<(/?)(article|header|nav|footer|main|section|aside)", r"<\1div", page))


def brute_templates(pages):
    """(mains, title, cuts, asides) of every host by explicit occurrence vectors, '' being all hosts."""
    per = {}
    for host, page in pages:
        events = ht.read(page)
        tokens = ht.page_tokens(events, ht.roles(events))
        per.setdefault(host, []).append(tokens)
        per.setdefault("", []).append(tokens)
    out = {}
    for host, found in per.items():
        vector, seen = {}, {}
        for i, tokens in enumerate(found):
            for t, x in tokens.items():
                vector.setdefault(t, []).append((i, x.count))
                seen[t] = x
        classes = {}
        for t, v in vector.items():
            classes.setdefault(tuple(v), []).append(t)
        valid = [t for v, c in classes.items() if len(v) >= ht.MIN_PAGES and sum(1 if seen[t].kind == ht.TEXT else 2 for t in c) >= ht.MIN_TOKENS for t in c if seen[t].kind != ht.TEXT]
        total = lambda t, what: sum(getattr(x[t], what) for x in found if t in x)  # noqa: B023, E731
        filled = lambda t: sum(any(y.share for y in x.values()) for x in found if t in x)  # noqa: B023, E731
        heavy = {t for t in valid if seen[t].kind in (ht.CONTAINER, ht.ARTICLE) and 2 * total(t, "share") > ht.WHOLE * filled(t) and 100 * len(vector[t]) >= len(found)}
        titles = [(len(vector[t]), t) for t in valid if seen[t].kind == ht.TITLE and 2 * len(vector[t]) > len(found)]
        cuts = {t for t in valid if total(t, "chars") and total(t, "links") * 100 >= total(t, "chars") * ht.LINKED_PERCENT and 2 * len(vector[t]) > len(found)}
        if valid:
            out[host] = (heavy, max(titles)[1] if titles else None, cuts, {t for t in valid if seen[t].marked and 100 * len(vector[t]) >= len(found)})
    return out


def test_templates_equal_those_of_explicit_vectors(spark):
    from lodestone.llm.common import Scratch

    rows = [(f"h{i % 3}", i, page(f"title {i}", f"<p>{i} one two three</p>" * (i % 3 + 2)) if i % 2 else bare(page(f"title {i}", f"<p>{i} four five</p>" * (i % 4 + 2)))) for i in range(24)]
    rows += [("rare", 99, "<html><b>x</b></html>")]
    df = spark.createDataFrame([(h, hash((i, x)), x) for h, i, x in rows], "host string, page long, html string")
    got = {r["host"]: (set(r["mains"]), r["title"], set(r["cuts"]), set(r["asides"])) for r in ht.templates(df, Scratch(spark)).collect()}
    assert got == brute_templates([(h, x) for h, _, x in rows])


def test_the_template_finds_the_article_of_pages_without_semantic_tags_or_names(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice("ab bc cd de ef fg gh".split()) for _ in range(n)) + "."
    rows, want = [], {}
    for i in range(40):
        title, parts = f"Title {i}", [prose(20 + r.randrange(60)) for _ in range(1 + i % 4)]
        menu = "".join(f"<li><a href=/{k}>{prose(2)}</a></li>" for k in range(6))
        side = f"<div><ul>{menu}</ul></div>" * (i % 3)
        rows.append((i, f"http://h{i % 2}/{i}", bare(f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class=ad>{prose(5 if i % 4 else 60)}</div>{side}<article><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in parts)}</article><footer>(c) <i>h</i> {prose(6)}</footer></body></html>")))
        want[i] = "\n".join([title, *parts])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in ht.extract(df).collect()}
    assert got == want
    # Without the template some of these pages are read otherwise: it decides.
    assert any(ht.main_text(html, None) != want[i] for i, _, html in rows)


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for hostile in ("<div>" * 20000 + "x", '<a href="x>' * 20000, "<p><b>" * 10000, "<a " * 50000, "</div>" * 50000, "<i class='x" * 20000, "<div>x" * 20000, "<aside>" + "<article>" * 20000):
        ht.main_text(hostile, None)
    assert time.perf_counter() - began < 20


def test_host_of(spark):
    from pyspark.sql import functions as F

    urls = ["https://A.b:8/c", "http://u:p@x.y?q", "//z/k", "nothing", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(ht.host_of(F.col("u"))).collect()] == ["a.b", "x.y", "z", "-", "-"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string")


def test_pairs_share_a_prompt_and_mask_what_assistants_say(spark):
    system, user = (0, "system", "be kind"), (1, "user", "hé?")
    chosen = [(1, *system), (1, *user), (1, 2, "assistant", "good"), (1, 3, "user", "ok"), (1, 4, "assistant", "bye"), (2, 0, "user", "same"), (3, 0, "user", "a"), (5, 0, None, None)]
    rejected = [(1, *system), (1, *user), (1, 2, "assistant", "bad"), (2, 0, "user", "same"), (3, 0, "user", "b"), (4, 0, "assistant", "alone")]
    got = {r["pair_id"]: r for r in pf.format_preferences(turns(spark, [(*r, "p") for r in chosen]), turns(spark, [(*r, "p") for r in rejected])).collect()}
    one = got[1]
    assert one["n_prompt_turns"] == 2 and one["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhé?<|end|>\n"
    spans = [tuple(map(int, x.split(":"))) for x in one["chosen_mask"].split(",")]
    assert [one["chosen"][a:b] for a, b in spans] == ["good<|end|>", "bye<|end|>"]
    a, b = map(int, one["rejected_mask"].split(":"))
    assert one["rejected"][a:b] == "bad<|end|>"
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["n_prompt_turns"]) == ("", "", 1)
    assert got[3]["prompt"] == "" and got[3]["chosen_mask"] == ""
    assert got[4]["chosen"] == "" and got[4]["rejected_mask"] == f"{len('<|assistant|>') + 1}:{len('<|assistant|>') + 1 + len('alone<|end|>')}"
    assert got[5]["chosen"] == "<|unknown|>\n<|end|>\n"
    assert pf.format_preferences(turns(spark, []), turns(spark, [])).count() == 0


def test_conversations_stand_null_ids_equal_turns_repeats_and_long_texts(spark):
    long_text = "x" * 300_000
    rows = [(None, 0, "user", "a", "p"), (None, 0, "user", "a", "p"), (None, None, None, None, "p"), (1, 0, "user", "b", "p"), (1, 0, "assistant", "a", "p"), (1, 1, "assistant", long_text, "p")]
    gathered = {r["id"]: [(t["turn"], t["role"], t["text"]) for t in r["turns"]] for r in pf.gather(turns(spark, rows), "pair_id").collect()}
    # A null id is one conversation; equal turn numbers go by role and text, repeated turns stay.
    assert gathered[None] == [(None, "unknown", ""), (0, "user", "a"), (0, "user", "a")]
    assert gathered[1] == [(0, "assistant", "a"), (0, "user", "b"), (1, "assistant", long_text)]
    got = {r["pair_id"]: r for r in pf.format_pairs(pf.with_repeated_answer(pf.gather(turns(spark, rows), "pair_id"))).collect()}
    assert got[None]["chosen"] == got[None]["rejected"] == "" and got[1]["n_prompt_turns"] == 2
    assert len(got[1]["chosen"]) > 300_000 and got[1]["rejected"] == "<|assistant|>\na<|end|>\n"


def test_query_agrees_with_sql(spark, duck):
    from helpers import DATA, same_rows

    from lodestone.llm.oracles import ORACLES
    from lodestone.llm.queries import QUERIES

    for name in ("op2_preference", "op4_topk"):
        assert same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name])) > 0
