from __future__ import annotations

import hashlib
import math
import random
import re
from html import unescape

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from qaloom.llm import chat, embed_join, mixing, ngram_join, packing, quality, queries, secrets, sharding, url_filter, wrapper
from tests.llm.conftest import DIR


def brute(rows, cosine=0.9):
    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for _, v in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else vec
        out.append((vec, len(link[i]), comp, vec == comp))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in embed_join.embedding_components(df, **kw).collect()), key=str)


def test_embeddings_against_all_pairs(spark):
    rnd = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(40):
        v = rnd.standard_normal(24)
        for _ in range(int(rnd.integers(1, 8))):
            w = v + rnd.standard_normal(24) * rnd.choice([0.0, 0.05, 0.2, 0.35])
            rows.append((k, (w * rnd.choice([1, 3])).astype(np.float32).tolist()))
            k += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(i, [float(x) for x in v]) for i, v in rows])
    assert run(df) == want and run(df, group_bytes=4 * 24 * 16) == want and run(df, group_bytes=4 * 24 * 60) == want


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, -0.0]), (9, [1.0, 0.0, 0.0]), (None, None), (10, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS cls", "2 AS label")
    assert run(df) == brute(rows)
    assert run(df.where("false")) == []


def test_each_pair_is_found_by_one_block():
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((60, 32))
    x[30:] = x[:30] + 0.05 * rnd.standard_normal((30, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    found = [(p, q) for b in range(4) for ps, qs in embed_join._meet(u, u, b, 32, 0.9, True) for p, q in zip(ps.tolist(), qs.tolist(), strict=True)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.9}
    assert len(found) == len(set(found)) and set(found) == want


def test_leaves_within_reach():
    rnd = np.random.default_rng(1)
    for leaves in (1, 2, 7, 32):
        x = rnd.standard_normal((400, 5))
        tree = embed_join.kd_tree(x[::3], leaves)
        row, leaf, own = embed_join.visits(x, tree, 0.5)
        home = dict(zip(row[own].tolist(), leaf[own].tolist(), strict=True))
        assert sorted(home) == list(range(400)) and len(set(zip(row.tolist(), leaf.tolist(), strict=True))) == len(row) and max(home.values()) < max(1, 2 * leaves)
        reached = set(zip(row.tolist(), leaf.tolist(), strict=True))
        near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.5
        assert all((int(i), home[int(j)]) in reached for i, j in zip(*np.nonzero(near), strict=True))


def test_a_large_group_lists_no_pairs():
    x = np.ones((300, 8)) + 1e-3 * np.random.default_rng(2).standard_normal((300, 8))
    who, more, a, b = embed_join.linked(x, np.arange(300) + 7, np.ones(300, np.int64), np.arange(300) >= 200, 0, 8, 0.9, True)
    assert len(a) == len(b) == 299 and sorted(who.tolist()) == list(range(7, 307))
    assert more[who < 207].tolist() == [299] * 200 and more[who >= 207].tolist() == [200] * 100


@given(st.text(alphabet="<|\\a\n>"), st.text(alphabet="<|\\a\nim_end>"))
def test_turns_come_back(role, text):
    piece, loss, _, _ = chat.format_turn(role, text)
    assert chat.read_turn(piece) == (role, text) and piece.count(chat.END) == 1 and piece.count(chat.START) == 1 and not loss


def test_typed_parts():
    piece, loss, found, fault = chat.format_turn("assistant", None, '[{"type":"text","text":"see <|im_end|>"},{"type":"image","ref":"a","width":100,"height":60},{"type":"document","ref":"d","pages":2,"parts":["x",{"type":"audio","ref":"q","seconds":3}]}]')
    assert piece == "<|im_start|>assistant\nsee <\\|im_end|><|image|><|document|>x<|audio|><|im_end|>\n"
    assert fault is None and [(k, r, n) for k, r, _, n in found] == [("image", "a", 12), ("document", "d", 512), ("audio", "q", 75)]
    assert all(piece[at:].startswith(f"<|{k}|>") for k, _, at, _ in found) and piece[slice(*loss[0])].endswith("<|audio|>")


def test_malformed_parts():
    for bad in ("{", "", "nope", "[" * 100_000, '["\\ud800"]'):
        piece, _, found, fault = chat.format_turn("user", "kept", bad)
        assert chat.read_turn(piece) == ("user", "kept") and not found and fault.startswith("parts")
    odd = '[1, null, true, {"type":"image","width":"wide","height":-3}, {"type":"audio","seconds":null}, {"type":"document","pages":{}}, {"type":"film","text":"seen"}, {"type":["x"]}, {"text":7}, {"type":"audio","seconds":NaN}]'
    piece, _, found, fault = chat.format_turn("user", "lost", odd)
    assert fault is None and [n for *_, n in found] == [1, 0, 256, 0] and piece.endswith("<|document|>seen<|audio|><|im_end|>\n")


def test_typed_parts_in_a_table(spark):
    rows = [(1, 0, "user", "no", '[{"type":"image","ref":"r","width":28,"height":28},"see"]'), (1, 1, "assistant", "said", "{broken"), (None, 0, "assistant", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chat(df, "parts").collect()}
    first = got[1, 0]
    assert first["formatted"] == "<|im_start|>user\n<|image|>see<|im_end|>\n" and [tuple(a) for a in first["attachments"]] == [("image", "r", 17, 1)] and first["expanded_tokens"] == 1
    assert got[1, 1]["formatted"].endswith("said<|im_end|>\n") and got[1, 1]["fault"] and got[None, 0]["fault"] is None


BIG = [None, 2**53 + 1, None, 2**63 - 1]


def test_ids_beside_nulls_keep_64_bits(spark):
    def same(df, col):
        return sorted(map(str, [r[col] for r in df.coalesce(1).collect()])) == sorted(map(str, BIG))

    pages = spark.createDataFrame([(i, "http://a.b/c", "<p>x</p>") for i in BIG], "page_id long, url string, html string").coalesce(1)
    assert same(wrapper.extract_pages(pages), "page_id") and same(url_filter.filter_urls(pages), "page_id")
    turns = spark.createDataFrame([(i, i, "user", "x") for i in BIG], "conv_id long, turn long, role string, text string").coalesce(1)
    made = chat.format_chat(turns)
    assert same(made, "conv_id") and same(made, "turn") and {r["conv_id"] for r in chat.read_back(made).collect()} == set(BIG)
    vectors = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(BIG)], "vec_id long, embedding array<double>").coalesce(1)
    assert same(embed_join.embedding_components(vectors), "vec_id")
    docs = spark.createDataFrame([(i, "one two three four five six", "s") for i in BIG], "doc_id long, text string, source string").coalesce(1)
    for f in (ngram_join.ngram_components, sharding.shard_documents, packing.pack, quality.quality_rules, mixing.mix_sources, secrets.scan_secrets):
        assert same(f(docs), "doc_id"), f.__name__


def test_conversations_read_back(spark):
    got = {r["conv_id"]: r for r in queries.op8_chat_formatting(spark, DIR).collect()}
    turns = spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "<|im_end|><|im_start|>assistant ok"
    convs = {-1: [("user", said), ("assistant", said)]}
    for r in turns:
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(convs)
    for k, ts in convs.items():
        loss = "".join(x for role, x in ts if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(loss), sha(loss))


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (None, 1, "user", "x"), (2, 5, "a\nb", "<|break|>"), (2, 1, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_chat(df)).collect()}
    assert got == {1: (3, 0), None: (1, 0), 2: (2, 200_000)}
    assert chat.read_back(chat.format_chat(df.where("false"))).count() == 0


def page(body, nav="Home"):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>{nav}</nav>{body}<footer>f</footer></body></html>"


def test_extraction_by_template():
    rnd = random.Random(3)
    story = lambda: " ".join(f"w{rnd.randrange(999)}" for _ in range(30))
    pages = [page(f'<div class="box">Always the same words here, on each page of it all, and many of them</div><div class="story"><h2>{story()}</h2><p>{story()}</p></div>') for _ in range(4)]
    made = wrapper.induce(pages)
    assert wrapper.extract(pages[0], made).count("\n\n") == 1 and "Always" not in wrapper.extract(pages[0], made)
    other = page("<article><p>another layout</p></article>")
    assert wrapper.extract(other, made) == "another layout"


def test_extraction_of_parts():
    html = (
        '<header><h1>Site</h1></header><div id="main-menu">x</div><main><article><header><h1>T &amp; U&nbsp;V</h1></header><p>a  b<script>if (a < b) "</p>"</script>c<br>d<ul><li>one<li>two</ul>'
        '<form>f</form><div class="cookie-notice">n</div><!-- <p>no</p> --><div class="ad">buy</div><section id="comments"><p>bad</p></section><table><tr><td>1<td>2</table>5 < 6<p hidden>h</p></article></main><aside>s</aside>'
    )
    assert wrapper.extract(html) == "T & U V\n\na bc d\n\none\n\ntwo\n\n1 2\n\n5 < 6"
    assert wrapper.extract(None) == "" and wrapper.extract("") == "" and wrapper.extract("<div") == ""
    assert wrapper.extract("<div>" * 5000 + "deep") == "deep" and wrapper.extract("just text") == "just text"


def test_text_beside_a_heavy_child_stays():
    post = lambda k: page(f'<div class="post"><h1>Title {k}</h1><p>lede {k}</p><div class="entry"><p>{f"body{k} " * 200}</p></div></div>')
    pages = [post(k) for k in range(4)]
    made = wrapper.induce(pages)
    for k, html in enumerate(pages):
        assert wrapper.extract(html, made).startswith(f"Title {k}\n\nlede {k}\n\nbody{k} body{k}")
    assert wrapper.extract(pages[0]).startswith("Title 0\n\nlede 0\n\nbody0")


def test_names_alone_drop_no_article():
    body = f"<h1>Title</h1><p>{'long ' * 60}</p>"
    for attrs in ("id=page class='has-sidebar'", "class='content-sidebar-wrap'", "class='no-comments'", "class='social'", "id=related"):
        assert wrapper.extract(page(f"<div {attrs}>{body}</div>")).startswith("Title\n\nlong"), attrs
    heads = "<h2 id='related-work'>Related work</h2><h2 id='search'>Search</h2><h3 id='social'>Social</h3><p class='notice'>Read this</p>"
    story = f"<div class='social'><p>{'said ' * 30}</p></div>"
    text = wrapper.extract(page(f"<article>{body}{heads}{story}</article>"))
    assert all(x in text.split("\n\n") for x in ("Related work", "Search", "Social", "Read this")) and "said said" in text
    boxes = "<div class='ad'>buy</div><div class='main-menu'>a b</div><ul class='share-buttons'><li>x</ul>"
    assert wrapper.extract(page(f"<article>{body}{boxes}</article><div class='sidebar'><p>{'else ' * 20}</p></div>")) == f"Title\n\n{('long ' * 60).strip()}"


def test_templates_of_all_pages(spark):
    shared = "<p>Read more of us each week.</p><ul><li>Rate<li>Print</ul>"
    a = lambda k: page(f"<div class='main'><p>{f'a{k} ' * 20}</p>{shared}</div>")
    b = lambda k: page(f"<div class='main'><p>teaser {k}</p></div><div class='story'><p>{f'b{k} ' * 20}</p>{shared}</div>")
    c = page(f"<article><h1>Alone</h1><p>{'c ' * 9}</p></article>")
    html = [*map(a, range(12)), *map(b, range(5)), c]
    rows = [(k, "http://h.example/", h) for k, h in enumerate(html)] + [(99, "http://one.example/", a(0)), (100, "http://h.example/", c)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (f"a{k} " * 20).strip() for k in range(12))
    assert all(got[12 + k] == f"teaser {k}\n\n{(f'b{k} ' * 20).strip()}" for k in range(5))
    assert got[17] == got[100] == f"Alone\n\n{('c ' * 9).strip()}"
    assert got[99].endswith("Read more of us each week.\n\nRate\n\nPrint")


def test_near_copies_keep_their_text(spark):
    rows = [(k, "http://h/", page(f"<p>{'the same ' * 30}</p><div>seen {k}</div>")) for k in range(2)]
    got = wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith("the same the same") and r["text"].endswith(f"seen {r['page_id']}") for r in got)


def test_pages(spark):
    rows = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(text) and not any(x in text for x in ("&copy;", "track(", "©"))
        # These pages hold their article as one element, in plain markup: a second, plainer way to read it.
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", x))).split()) for x in re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div)\b[^>]*>", article)]
        assert text == "\n\n".join(x for x in blocks if x)


def planted(rnd, words):
    """A host's pages under neutral names: constant blocks here and there, also inside the article, and what varies."""
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    constant = [said(12) for _ in range(5)]
    box = lambda k: f"<div class='c{'abcde'[k]}'><p>{constant[k]}</p></div>"
    out = []
    for _ in range(rnd.randrange(5, 12)):
        paras = [said(rnd.randrange(8, 40)) for _ in range(rnd.randrange(2, 7))]
        own = [f"<p>{x}</p>" for x in paras]
        at = rnd.randrange(len(own) + 1)
        prices, year = said(9), said(7)
        own[at:at] = [f"<p>{constant[4]}</p>"]  # as constant as the rest, amid the article
        body = box(0) + f"<div class='inner'>{''.join(own)}<section class='share-prices'>{prices}</section><p class='banner-year'>{year}</p></div>" + box(1)
        paras += [prices, year]
        out.append((page(f"{box(2)}<div class='outer'>{body}</div>{box(3)}"), "\n\n".join(paras)))
    return out


def test_planted_templates(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows = [(k, f"http://h{k % 100}.example/{k}", *x) for h in range(12) for k, x in enumerate(planted(rnd, words), 100 * h)]
    rows = [(k, f"http://h{k // 100}.example/{k}", html, want) for k, _, html, want in rows]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(df).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_tree_matching_against_plain_recursion():
    rnd = random.Random(5)

    def tree(depth):
        return wrapper.Box(rnd.choice("ab"), 1, 0, 0, [rnd.randrange(4) for _ in range(2)], [tree(depth - 1).packed() for _ in range(rnd.randrange(4))] if depth else [])

    def plain(a, b):
        if a.key != b.key:
            return 0

        def forest(x, y):
            return max(forest(x[1:], y), forest(x, y[1:]), plain(x[0], y[0]) + forest(x[1:], y[1:])) if x and y else 0

        return 1 + len(a.same & b.same) + forest(a.kids, b.kids)

    for _ in range(200):
        a, b = tree(2), tree(2)
        assert wrapper.match(a, b, {}) == plain(a, b)


def test_wide_and_deep_pages_lose_nothing():
    for count in (20, 400):
        cards = lambda k: "".join(f"<div class='{'xyz'[i % 3]}'><span>card {i} of {k}</span><p>on each page</p></div>" for i in range(count))  # noqa: E731, B023
        deep = "<div>" * 100 + "<p>low {}</p>" + "</div>" * 100
        pages = [page(f"<div class='top'>{k} first{cards(k)}</div>{deep.format(k)}") for k in range(4)]
        for k, text in enumerate(wrapper.extract(p, wrapper.induce(pages)) for p in pages):
            assert text.split("\n\n") == [f"{k} first", *[f"card {i} of {k}" for i in range(count)], f"low {k}"]


def test_attributes_that_only_mention_hidden():
    text = f"<h1>Title</h1><p>{'long ' * 60}</p>"
    want = f"Title\n\n{('long ' * 60).strip()}"
    for attrs in ('aria-label="A hidden gem"', "title='not hidden = here'", 'class="js hidden until-ready"', "class=hidden", "data-hidden", 'data-x="a" data-y=" hidden "'):
        assert wrapper.extract(page(f"<article {attrs}>{text}</article>")) == want, attrs
    for attrs in ("hidden", 'class="x" hidden', "HIDDEN=''", 'hidden="until-found" id=y', 'id="z"hidden'):
        assert wrapper.extract(page(f"<article>{text}<div {attrs}><p>secret {'text ' * 40}</p></div></article>")) == want, attrs


def test_a_form_around_the_page_is_no_form():
    body = f"<h1>Title</h1><p>{'long ' * 60}</p>"
    controls = "<label>Your name<input name=n></label><select><option>a</select><textarea>t</textarea><button>Go</button>"
    want = f"Title\n\n{('long ' * 60).strip()}"
    assert wrapper.extract(page(f"<form id=aspnetForm>{body}{controls}</form>")) == want
    assert wrapper.extract(page(f"<form><article>{body}</article>{controls}<div>{'x ' * 400}</div></form>")).startswith(want)
    assert wrapper.extract(page(f"<article>{body}<form><p>Subscribe to all of it</p>{controls}</form></article>")) == want


def test_constant_headings_inside_content_stay(spark):
    rnd = random.Random(8)
    said = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    rows, want = [], {}
    for k in range(6):
        title, items, steps = said(4), [said(3) for _ in range(4)], said(20)
        listed = "".join(f"<li>{x}" for x in items)
        html = page(f"<article><h3>Our kitchen</h3><h1>{title}</h1><h2>Ingredients</h2><ul>{listed}</ul><h2>Method</h2><p>{steps}</p><h2>Share it</h2></article><div class='more'><h2>More</h2><p>from us</p></div>")
        rows.append((k, "http://cook.example/", html))
        want[k] = "\n\n".join([title, "Ingredients", *items, "Method", steps])
    got = wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def varied(rnd, k):
    """Pages of several layouts, with boxes that come and go."""
    said = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    parts = [f"<div class='a{chr(97 + j)}'><p>constant {j} of all</p></div>" for j in range(6) if rnd.random() < 0.6]
    parts.insert(rnd.randrange(len(parts) + 1), f"<div class='story'><h1>{said(5)}</h1><p>{said(30)}</p></div>")
    return page("".join(parts) + f"<section class='k{chr(97 + k % 3)}'>{said(3)}</section>")


def test_order_and_partitions_make_no_difference(spark):
    rnd = random.Random(2)
    pages = [varied(rnd, k) for k in range(40)]
    packed = lambda made: sorted((kind, str(tree.packed())) for kind, tree in made)
    first = packed(wrapper.induce(pages))
    for _ in range(50):
        rnd.shuffle(pages)
        assert packed(wrapper.induce(pages)) == first
    df = spark.createDataFrame([(k, f"http://h{k % 3}.example/", varied(rnd, k)) for k in range(120)], "page_id long, url string, html string")
    got = [sorted((r["page_id"], r["text"]) for r in wrapper.extract_pages(df.repartition(n)).collect()) for n in (1, 7, 64)]
    assert got[0] == got[1] == got[2] and sum("constant" in t for _, t in got[0]) < 12


def test_state_is_that_of_the_references():
    """Class names that differ from page to page: what is held doesn't grow with the pages."""
    made = lambda n: wrapper.induce([page(f"<div class='c{''.join(chr(97 + int(c)) for c in str(k))}'><p>own {k}</p></div><div class='box'><p>on every page</p></div>") for k in range(n)])
    nodes = lambda trees: sum(str(t.packed()).count("[") for _, t in trees)
    sizes = [nodes(made(n)) for n in (50, 400, 1600)]
    assert len(set(sizes)) == 1


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (None, "x", "<p>hi"), (3, "http://a.b/", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'h' AS host", "2 AS path", "3 AS text")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in wrapper.extract_pages(df).collect())
    assert got == [("1", 0), ("2", 0), ("2", 0), ("3", 249_999), ("None", 2)]
    assert wrapper.extract_pages(df.where("false")).count() == 0


URLS = {
    "https://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/1": ("example.org", "/en/1", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://x.com/fr/a?b": ("x.com", "/fr/a", "com/fr/", "allow"),
    "http://com/de/": ("com", "/de/", "com/de/", "block"),
    "http://x.com/de": ("x.com", "/de", None, None),
    "http://x.org?q=/": ("x.org", "", None, None),
    "http://x.org#/": ("x.org", "", None, None),
    "no scheme": ("", "", None, None),
    None: ("", "", None, None),
    "a://b://c/": ("b:", "//c/", None, None),
}


def test_url_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 AS id", "'h' AS host", "2 AS rule")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    for k, (host, path, rule, said) in enumerate(URLS.values()):
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (said is None or r["verdict"] == said) and r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(df.where("false")).count() == 0


def test_held_out_urls():
    urls, bad = url_filter.labelled_urls(2 * url_filter.SAMPLES)
    half = url_filter.SAMPLES
    host = lambda u: re.split(r"[/?#]", u.partition("://")[2])[0]
    model, seen = url_filter.train(urls[:half], bad[:half]), set(map(host, urls[:half]))
    new = [k for k in range(half, 2 * half) if host(urls[k]) not in seen]
    assert len(new) > half / 2 and ((model.score([urls[k] for k in new]) > 0) == bad[new]).mean() > 0.85


def test_samples_know_nothing_of_the_tables():
    own = {w for x in ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track") for w in x.split("-")}
    assert own.isdisjoint(url_filter.BAD_WORDS) and own.isdisjoint(url_filter.GOOD_WORDS)


def test_urls_against_sql_and_plain_trees(spark):
    got = {r["page_id"]: r for r in queries.op10_url_filters(spark, DIR).collect()}
    c = duckdb.connect()
    rules = ", ".join(f"('{v}', '{p.partition('/')[0]}', '/{p.partition('/')[2]}', '{p}')" for v, p in url_filter.RULES)
    said = c.execute(f"""
      WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)([^?#]*)', 2) AS path FROM '{DIR}/pages.parquet'),
      r(said, own, start, rule) AS (VALUES {rules}),
      fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM p JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id)
      SELECT page_id, url, host, path, rule, said FROM p LEFT JOIN fit USING (page_id)""").fetchall()
    model = url_filter.train(*url_filter.labelled_urls())
    assert len(said) == len(got)
    for page_id, url, host, path, rule, verdict in said:
        score = model.base
        x = model.features([url])[0]
        for feature, cut, leaf in model.trees:  # each tree, node by node
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if x[feature[k]] > cut[k] else 1)
            score += leaf[k - len(feature)]
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if score > 0 else "allow")) and abs(r["block_score"] - score) < 1e-9


def test_long_and_repeated_urls(spark):
    urls = ["http://h/" + "a" * 300_000, "http://h/" + "a" * 300_000, "://", "http://" + "x." * 5000 + "org/?" + "k=1&" * 20_000]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert len(got[0]["path"]) == 300_001 and got[0]["block_score"] == got[1]["block_score"] and got[2]["host"] == "" and got[3]["rule"] == "org/"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_every_query_runs(spark, name):
    assert queries.queries()[name](spark, DIR).count() > 0
