"""op2, op3, op5, op7, op8 and op10: brute force, exact round trips, held-out accuracy, and dirty tables."""

import hashlib
import re
import time
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.llm import arrow_text, op2_html_extract, op3_decontaminate, op5_bpe, op7_toxicity, op8_token_counts, op10_quality_classifier
from cladewise.llm.labelled import sample, texts_of
from cladewise.llm.vocabulary import BYTE_BPE, WORD_BPE, default_path, load
from tests.llm.helpers import LONG, crc, dirty, empty, lower, tuples, words
from tests.oracle import duck

SF = "/root/testdata/sf0.01"
ODD = ["", "a<|endoftext|>b", "\0<|endoftext|>", "<|startoftext|>Hi", "aaaaaaaaaaaa aaa", "İΣΑΣ ΑΣ. ǅ ﬁ K", "x\x1cy\x1f z\x85w　q\xa0r​t", "  lead\n\n  trail  \t", "日本語テキスト 123４５", "é café", "👍🏽 <|end", "it's we'LL I'M", "a" * 3000, "ab" * 2000, "１２ ²³ Ⅷ ½", "\r\n\r\n x", "a\ua7cbb \ua7dc"]


# ---- bytes
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\né\x0b|", max_size=30), max_size=8))
def test_words_and_hashes(found):
    data, bounds = arrow_text.texts(pa.array(found, pa.string()))
    starts, ends, rows = arrow_text.words(data, bounds)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(rows[:-1], rows[1:])]
    assert got == [words(x) for x in found]
    hashes = arrow_text.hash_words(data, starts, ends).tolist()
    flat = [lower(w) for x in got for w in x]
    assert len(dict(zip(flat, hashes))) == len(set(hashes)) and all(h == dict(zip(flat, hashes))[w] for w, h in zip(flat, hashes))


def test_pieces_change_nothing(monkeypatch):
    column = pa.array(["the quick brown fox " * 50, None, "x" * 500, "a b c"])
    one = [x.tolist() for x in __import__("cladewise.llm.op6_near_dedup", fromlist=["x"]).shingle_sets(column)]
    monkeypatch.setattr(arrow_text, "PIECE", 64)
    assert one == [x.tolist() for x in __import__("cladewise.llm.op6_near_dedup", fromlist=["x"]).shingle_sets(column)]


# ---- op2
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy the best of all things that you can have now and be happy with it.</div><article><h1>A heading</h1><p>It was the best of times, it was the worst of times; &amp; it <b>was</b> the age of wisdom&nbsp;there.</p><p>Short.</p>
<aside>See also the other page that we have for you in the same place.</aside><p class="notice">We use cookies for the good of all of you and of us, as is the law.</p><div id=comments><p>I think that this is the best of all the articles that I have read.</p></div><form><p>Mail <input></p></form><p>x < y</p></article><footer>&copy; all of us</footer>"""


def test_main_text():
    assert op2_html_extract.main_text(PAGE) == "A heading It was the best of times, it was the worst of times; & it was the age of wisdom there. Short. x < y"
    prose = "the cat is on the mat and it was a good day for all of us"
    plain = f"<body><div class=menu><a href=1>one</a> <a href=2>two</a></div><div><p>{prose}</p><p>Short one.</p></div><ul><li><a href=3>{prose}</a></ul></body>"
    assert op2_html_extract.main_text(plain) == f"{prose} Short one."
    named = f"<body><div id='cookieBanner'><p>{prose}</p></div><div id=main-content><div class='post-header'><h2>Title</h2></div><p>a | b | c</p><p>{prose}</p><ol class=commentlist><li>{prose}</ol></div><div class=right-sidebar>{prose}</div><p>{prose}</p>"
    assert op2_html_extract.main_text(named) == f"Title a | b | c {prose}"
    assert [op2_html_extract.main_text(x) for x in (None, "", "<", "<p", "&am", "</p></div>")] == ["", "", "", "", "", ""]


PROSE = ["It was the best of times and it was the worst of times, as all of them have said to us.", "She has been on the road for a year and it is not as hard as they said that it would be.", "Short one."]
SITE = "<body>{}<nav><a href=1>Home</a> <a href=2>News</a></nav><article>" + "".join(f"<p>{x}</p>" for x in PROSE) + "<div class=comments><p>I think that it is the best of all the things that I have read on it.</p></div></article><footer>of us all</footer>"


@pytest.mark.parametrize("wrapper", ['<div class="site has-sidebar">', '<div class="container no-sidebar">', '<div class="ad-free">', '<div class="commentary">', '<form id="aspnetForm">', '<div class="sidebar"><form><div id="comment-page">', ""])
def test_names_do_not_outvote_an_article(wrapper):
    assert op2_html_extract.main_text(SITE.format(wrapper)) == " ".join(PROSE)


def test_names_do_not_outvote_the_only_prose():
    body = "".join(f"<p>{x}</p>" for x in PROSE * 2)
    for wrapper in ("<form>", "<div class=ad-slot>", "<div class='promo'><section id=notice>"):
        page = f"<body>{wrapper}<div class=menu><a href=1>The one of the all</a></div><div>{body}</div><div class=sidebar><p>{PROSE[0]}</p></div>"
        assert op2_html_extract.main_text(page) == " ".join(PROSE * 2)
    # Comments beside the text stay out, however long, and so does an advert alone.
    assert op2_html_extract.main_text(f"<body><div>{body}</div><div id=comments>{body * 3}</div>") == " ".join(PROSE * 2)
    assert op2_html_extract.main_text(f"<body><div id=comments>{body * 3}<article>{body}</article></div><div class=post>{body}</div>") == " ".join(PROSE * 2)
    assert op2_html_extract.main_text(f"<body><div class=ad>{PROSE[0]}</div><p>x</p>") == ""
    # A teaser that calls itself an article does not empty the page.
    assert op2_html_extract.main_text(f"<body><article><a href=1>The one of the all</a></article><div>{body}</div>") == " ".join(PROSE * 2)


def test_pages_without_article_in_other_languages():
    japanese = "私はその本を読んでいたが、彼はそれを知らなかったので、とても静かな夜になった。"
    chinese = "我们在城市的中心看到了一座很高的塔，他说这是一百年前建的，现在不再开放了。"
    russian = "Он сказал, что это не так, и что они все были там в тот день, но не в тот час, когда это было."
    for text in (japanese, chinese, russian):
        page = f"<body><ul><li><a href=1>{text[:9]}</a><li><a href=2>{text[9:15]}</a></ul><div><p>{text}</p><p>{text[:6]}</p><p>{text}</p><p>{text}</p></div>"
        assert op2_html_extract.main_text(page) == f"{text} {text[:6]} {text} {text}"


def test_lists_between_paragraphs_and_hidden_parts():
    page = f"<body><div><p>{PROSE[0]}</p><ul><li>one thing<li>two things</ul><p hidden>not {PROSE[0]}</p><p style='display: none'>nor {PROSE[0]}</p><p>{PROSE[1]}</p></div><ul><li>three things</ul>"
    assert op2_html_extract.main_text(page) == f"{PROSE[0]} one thing two things {PROSE[1]}"


def slow_labels(n, stops, linked, inside, barred, container, heading):
    """Both passes, block by block."""
    size = range(len(n))
    prose = [n[i] >= 12 and stops[i] >= 0.12 for i in size]
    linky = [linked[i] > n[i] / 2 and not (inside[i] and prose[i] and linked[i] < n[i]) for i in size]
    first = ["not" if barred[i] or linky[i] else "text" if prose[i] or n[i] >= 12 and inside[i] else "open" for i in size]
    if "text" not in first:
        left = [i for i in size if first[i] == "open"]
        for i in left:
            mine = [j for j in left if container[j] == container[i]]
            if sum(n[j] for j in mine) >= 12 and sum(n[j] * stops[j] for j in mine) >= 0.12 * sum(n[j] for j in mine):
                first[i] = "text"
    out = []
    for i in size:
        if first[i] != "open":
            out.append(first[i] == "text")
            continue
        decided = [j for j in size if first[j] != "open" and not barred[j]]
        own = [j for j in decided if container[j] == container[i]]
        if own:
            near = min(abs(j - i) for j in own)
            said = {first[j] for j in own if abs(j - i) == near}
            out.append(said == {"text"} or len(said) == 2 and (inside[i] or heading[i]))
        else:
            before, after = [first[j] for j in decided if j < i], [first[j] for j in decided if j > i]
            out.append(bool(inside[i] or before and after and before[-1] == after[0] == "text"))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 3, 11, 12, 30]), st.sampled_from([0.0, 0.1, 0.12, 0.4]), st.sampled_from([0, 1, 6, 20]), st.booleans(), st.sampled_from([False, False, True]), st.integers(0, 2), st.sampled_from([False, False, True])), max_size=14))
def test_both_passes(rows):
    columns = [list(x) for x in zip(*rows)] or [[] for _ in range(7)]
    assert [x == 1 for x in op2_html_extract.two_passes(*columns)] == slow_labels(*columns)


def shapes(rng):
    """(name, html, words of the text) of pages of other shapes than the tables', with menus, notices, related links and comments around the same kind of prose."""
    words_ = "river stone garden winter letter market silver window morning journey harbour captain village forest".split()
    sentence = lambda n: " ".join(rng.choice(words_) if rng.random() < 0.6 else rng.choice("the of and to in it was that with as for on".split()) for _ in range(n)).capitalize() + "."
    long, short = [sentence(rng.randint(25, 60)) for _ in range(6)], [sentence(rng.randint(5, 9)) for _ in range(14)]
    menu = "".join(f"<li><a href=/{i}>{rng.choice(words_)}</a></li>" for i in range(8))
    around = f"<nav><ul>{menu}</ul></nav>", f"<div class=related><h4>More</h4><ul>{menu}</ul></div><footer>All rights reserved</footer>"
    comments = f"<p>{sentence(20)}</p><p>{sentence(30)}</p>"
    p = lambda some: "".join(f"<p>{x}</p>" for x in some)
    page = lambda body: f"<html><body>{around[0]}{body}{around[1]}</body></html>"
    return [
        ("paragraphs in a division", page(f"<div><h1>{short[0]}</h1>{p(long)}</div>"), [short[0], *long]),
        ("short paragraphs", page(f"<div>{p(short)}</div>"), short),
        ("short and long by turns", page(f"<div>{p([x for pair in zip(long, short) for x in pair])}</div>"), [x for pair in zip(long, short) for x in pair]),
        ("a table for the layout", f"<body><table><tr><td><ul>{menu}</ul></td><td>{p(long)}</td></tr></table></body>", long),
        ("line breaks alone", page(f"<div>{'<br><br>'.join(long)}</div>"), long),
        ("mostly links", page(f"<article>{p(long[:2])}<p>See <a href=x>{long[2]}</a></p>{p(long[3:])}</article>"), [*long[:2], "See", *long[2:]]),
        ("feedback below", page(f"<article>{p(long)}<div class='user-feedback'>{comments}</div></article>"), long),
        ("comments without an article", page(f"<div id=content>{p(long)}</div><section id=comment-list>{comments}</section>"), long),
        ("a quotation and a list", page(f"<div class=post>{p(long[:3])}<blockquote>{long[3]}</blockquote><ul><li>{short[0]}<li>{short[1]}</ul>{p(long[4:])}</div>"), [*long[:4], *short[:2], *long[4:]]),
        ("sections with headings", page("".join(f"<section><h2>{h}</h2>{p([x])}</section>" for h, x in zip(short, long))), [x for pair in zip(short, long) for x in pair]),
        ("a notice within", page(f"<main>{p(long[:3])}<div class=cookie-notice>{comments}</div>{p(long[3:])}</main>"), long),
        ("pre-formatted", page(f"<div><p>{long[0]}</p><pre>{long[1]}\n{long[2]}</pre>{p(long[3:])}</div>"), long),
    ]


def test_pages_of_other_shapes():
    """Words found and words found rightly, by shape, over ten pages of each."""
    import random

    found = {}
    for seed in range(10):
        for name, page, want in shapes(random.Random(seed)):
            got, right = op2_html_extract.main_text(page).split(), " ".join(want).split()
            common = sum((Counter(got) & Counter(right)).values())
            a, b, c = found.get(name, (0, 0, 0))
            found[name] = a + common, b + len(right), c + len(got)
    recall = {k: round(a / b, 3) for k, (a, b, c) in found.items()}
    precision = {k: round(a / max(1, c), 3) for k, (a, b, c) in found.items()}
    print("recall", recall, "precision", precision)
    assert min(recall.values()) >= 0.9 and min(precision.values()) >= 0.9, (recall, precision)


def test_stray_tags_take_no_time():
    began = time.process_time()
    page = "<div>" * 50_000 + "</x>" * 100_000 + "</p>" * 100_000 + f"<p>{PROSE[0]}</p>"
    assert op2_html_extract.main_text(page) == PROSE[0]
    deep = "<div class=ad><form>" * 20_000 + f"<p>{PROSE[0]}</p>" * 5_000
    assert op2_html_extract.main_text(deep) == " ".join([PROSE[0]] * 5_000)
    assert time.process_time() - began < 5


def test_pages_of_the_tables(spark):
    import html

    found = {r["page_id"]: r for r in op2_html_extract.op2_html_extract(spark, SF).collect()}
    pages = duck(SF).sql("select page_id, html from pages").fetchall()
    assert len(found) == len(pages)
    for i, page in pages:
        m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", m[1])).split())
        assert found[i]["text"] == want and found[i]["n_chars"] == len(want)


def test_dirty_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", PAGE), (3, "w", "<article>" + "<p>the words of it</p>" * 5000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = op2_html_extract.extract(df).collect()
    assert len(got) == 5 and max(len(r["text"]) for r in got) == 5000 * 16 - 1
    assert op2_html_extract.extract(df.limit(0)).count() == 0


# ---- op3
def edited(text, k):
    ws = text.split()
    return " ".join(w if (i % k) else "zzz" for i, w in enumerate(ws))


def test_leaks(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    wanted = [(i, text(30)) for i in range(6)]
    wanted += [(6, wanted[0][1].upper()), (7, "two words"), (8, None), (9, ""), (None, text(20))]
    docs, truth = [], set()
    for i in range(60):
        body = text(200)
        docs.append((i, body))
    for i, (item, x) in enumerate(wanted[:6]):
        docs += [(100 + i, f"{text(50)} {x} {text(50)}"), (200 + i, f"{text(50)} {edited(x, 6)} {text(80)}"), (300 + i, f"{x.replace(' ', ', ')}. {text(9)} {x}"), (400 + i, " ".join(x.split()[:10]) + " " + text(60))]
        truth |= {(100 + i, item), (200 + i, item), (300 + i, item)}
    docs += [(500, "here are Two Words"), (501, "two other words")]
    truth.add((500, 7))
    df = dirty(spark, docs)
    bench = spark.createDataFrame([(*x, 1) for x in wanted], "item_id long, text string, score int")
    got = op3_decontaminate.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    assert {r["n_items"] for r in got if r["item_id"] == 0} == {2} and len(got) == len(truth)
    hit = next(r for r in got if r["doc_id"] == 100)
    assert (hit["score"], hit["first_word"], hit["end_word"]) == (1.0, 50, 80)
    assert op3_decontaminate.leaks(empty(spark), bench).count() == 0 and op3_decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_copies_repeated_in_many_documents(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [text(48) for _ in range(3)]
    copies = [edited(items[0], 8), " ".join(items[1].split()[:36]), " ".join(f"{x} and" if k % 4 == 0 else x for k, x in enumerate(items[2].split()))]
    docs = [(3000 * k + i, f"{text(20)} {x} {text(20)}") for k, x in enumerate(copies) for i in range(3000)]
    docs += [(9000, items[0]), *((10000 + i, text(90)) for i in range(500))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = op3_decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3000 * k + i, k) for k in range(3) for i in range(3000)} | {(9000, 0)}


def copied(how, ws, k):
    """A copy of which every k-th word is replaced, dropped, or followed by another."""
    return [x for i, w in enumerate(ws) for x in ((w,) if (i + 1) % k else {"replaced": ("zz",), "dropped": (), "added": (w, "zz")}[how])]


def test_recall_of_edited_copies(spark):
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, truth, bench = [], set(), []
    for item in range(120):
        ws = list(rng.choice(vocabulary, int(rng.integers(12, 60))))
        bench.append((item, " ".join(ws)))
        how, k = ("replaced", "dropped", "added")[item % 3], 4 + item % 5
        docs.append((item, " ".join([*rng.choice(vocabulary, 300), *copied(how, ws, k), *rng.choice(vocabulary, 300)])))
        truth.add((item, item))
    docs += [(1000 + i, " ".join(rng.choice(vocabulary, 600))) for i in range(200)]
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and not got - truth


def kernel(doc, items, short=False):
    """The leaks of one document, without Spark: item and score."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(items))), pa.array(items)], names=["item_id", "text"])
    (seeds,) = op3_decontaminate._item_seeds(iter([batch]))
    known = op3_decontaminate._packed(pa.Table.from_batches([seeds]).append_column("n_items", pa.array([1] * len(items))))

    class Shared:
        value = known, short

    out = op3_decontaminate._copies(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([doc])], names=["doc_id", "text"])]), Shared)
    found = {}
    for b in out:
        for i, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            found[i] = max(found.get(i, 0), x)
    return found


def test_a_document_that_holds_the_whole_benchmark(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    took = {}
    for n in (800, 3200):
        items = ["what is the answer to this one " + " ".join(rng.choice(vocabulary, 30)) for _ in range(n)]
        began = time.process_time()
        assert set(kernel(" ".join(items), items)) == set(range(n))
        took[n] = time.process_time() - began
    # Four times the items, each with some five seeds that all items hold.
    assert took[3200] < 8 * took[800]
    items, few = items[:60], " ".join(items[:60])
    one = kernel(few, items)
    monkeypatch.setattr(op3_decontaminate, "PLACES", 50)
    monkeypatch.setattr(op3_decontaminate, "RARE", 1000)
    assert kernel(few, items) == one == dict.fromkeys(range(60), 1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.lists(st.integers(0, 4), min_size=3, max_size=8), min_size=1, max_size=4))
def test_windows_find_what_the_whole_text_holds(text, items):
    args = " ".join(f"w{x}" for x in text), [" ".join(f"w{x}" for x in item) for item in items]
    got = kernel(*args)
    with mock.patch.object(op3_decontaminate, "RARE", 0):
        wider = kernel(*args)
    assert all(wider.get(i, 0) >= x for i, x in got.items())
    for i, item in enumerate(items):
        seeds = {tuple(item[k : k + 3]) for k in range(len(item) - 2)} & {tuple(text[k : k + 3]) for k in range(len(text) - 2)}
        score = op3_decontaminate.align([np.array(text, np.uint64)], [np.array(item, np.uint64)])[0][0] / (2 * len(item)) if seeds else 0
        # Where the best alignment holds no whole seed, another may be found.
        assert (i in wider) <= (score >= 0.5) and wider.get(i, 0) <= score
        if not seeds or score < 0.9:
            continue
        assert got.get(i) == score


def test_copies_with_words_added(spark):
    item = [f"w{i}" for i in range(20)]
    added = " ".join(x for k, w in enumerate(item[:17]) for x in ([w, f"x{k}"] if k else [w])) + " " + " ".join(item[17:])
    bench = spark.createDataFrame([(None, " ".join(item))], "item_id long, text string")
    got = op3_decontaminate.leaks(spark.createDataFrame([(1, added), (2, "w1 w2 w3 and others")], "doc_id long, text string"), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in got] == [(1, None, 0.6)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), min_size=1, max_size=8))
def test_no_alignment_exceeds_the_bound(a, b):
    passage, item = np.array(a, np.uint64), np.array(b, np.uint64)
    score, begin, end = op3_decontaminate.align([passage], [item])
    assert score[0] <= op3_decontaminate.most(passage, item)
    assert score[0] < len(b) or end[0] - begin[0] <= 2 * len(b)


def test_parts_of_the_seeds_change_nothing(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in op3_decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(op3_decontaminate, "MAX_SEEDS", 500)
    two = {tuple(r) for r in op3_decontaminate.leaks(docs, bench).collect()}
    assert {x[:2] for x in one} == {x[:2] for x in two}
    squeeze = lambda t: f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', (t or '').lower()))} "
    con = duck(SF)
    docs, items = ([(i, squeeze(t)) for i, t in con.sql(q).fetchall()] for q in ("select doc_id, text from documents", "select item_id, text from benchmark"))
    assert {(d, i) for d, t in docs for i, x in items if x in t} == {x[:2] for x in one}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=8))
def test_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    score, begin, end = op3_decontaminate.align([np.array(a, np.uint64), np.array([9], np.uint64)], [np.array(b, np.uint64), np.array([9, 8], np.uint64)])
    assert score.tolist() == [h.max(), 2] and 0 <= begin[0] <= end[0] <= len(a)


# ---- op5 and op8
def test_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    one, two = (Tokenizer.from_file(default_path(n)) for n in (BYTE_BPE, WORD_BPE))
    found = ODD + [x[0] for x in duck(SF).sql("select text from documents limit 300").fetchall()]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in op5_bpe.round_trip(df).collect()}
    counts = {r["doc_id"]: r for r in op8_token_counts.token_counts(df).collect()}
    for i, t in enumerate(found):
        ids = one.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == one.decode(ids, skip_special_tokens=False)
        assert (counts[i]["n_tokens"], counts[i]["n_bytes"]) == (len(two.encode(t, add_special_tokens=False).ids), len(t.encode()))
    again = {r["doc_id"]: r["decoded"] for r in op5_bpe.decode(op5_bpe.encode(df)).collect()}
    assert again == {i: r["decoded"] for i, r in got.items()}
    d = {r["doc_id"]: r for r in op5_bpe.digests(op5_bpe.round_trip(df)).collect()}
    assert all(d[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, got[i]["ids"])).encode()).hexdigest() and d[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest() for i in d)


def test_stretches_and_cache_change_nothing(monkeypatch):
    found = ["the cat sat on the mat " * 3, "thethethe aaaa", "x <|endoftext|> y", ""] * 3
    encoder = op5_bpe.Encoder(default_path(BYTE_BPE))
    one = encoder.encode(found)[0].tolist()
    monkeypatch.setattr(op5_bpe, "KEPT_PIECES", 2)
    monkeypatch.setattr(op5_bpe, "FEW", 1)
    fresh = op5_bpe.Encoder(default_path(BYTE_BPE))
    assert one == sum((fresh.encode([x])[0].tolist() for x in found), [])
    v = load(default_path(BYTE_BPE))
    assert op5_bpe.decode_ids(v, v.byte_ids[[0x61, 0xC3, 0x62]]) == "a\ufffdb"


def test_dirty_tokens(spark):
    df = dirty(spark)
    a, b = op5_bpe.digests(op5_bpe.round_trip(df)).collect(), op8_token_counts.token_counts(df).collect()
    assert len(a) == len(b) == df.count()
    assert {r["ids_sha256"] for r in a if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()} and {r["n_tokens"] for r in b if r["doc_id"] in (1, 2, 3)} == {0}
    whole = hashlib.sha256(LONG.encode()).hexdigest()
    assert [r["decoded_sha256"] for r in a if r["doc_id"] == 4] == [whole]
    assert op5_bpe.digests(op5_bpe.round_trip(empty(spark))).count() == 0 == op8_token_counts.token_counts(empty(spark)).count()


# ---- op7 and op10
@pytest.mark.parametrize("module,column,least", [(op7_toxicity, "toxic", 0.93), (op10_quality_classifier, "quality", 0.97)])
def test_held_out_accuracy(spark, module, column, least):
    sf = "/root/testdata/sf0.1"
    query = module.op7_toxicity if column == "toxic" else module.op10_quality_classifier
    rows = query(spark, sf).collect()
    labels = dict(duck(sf).sql(f"select doc_id, {column} from labels").fetchall())
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (crc(r["doc_id"]) % (5 if column == "toxic" else 4) == (0 if column == "toxic" else 2)) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 10000
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > least
    hits = sum(r["predicted"] == labels[r["doc_id"]] == 1 for r in held)
    assert hits >= 0.9 * sum(labels[r["doc_id"]] == 1 for r in held) and hits >= 0.97 * sum(r["predicted"] for r in held)


@pytest.mark.parametrize("module", [op7_toxicity, op10_quality_classifier])
def test_dirty_classifiers(spark, module):
    column = "toxic" if module is op7_toxicity else "quality"
    df = dirty(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1), (7, 0), (8, 5), (-9, 0)], f"doc_id long, {column} int")
    for given_ in (labels, labels.filter(f"{column} = 0"), labels.limit(0)):
        rows = module.scores(df, module.train(df, given_)).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    model = module.train(df, labels)
    assert module.scores(empty(spark), model).count() == 0
    assert module.train(empty(spark), labels) is not None
    assert {r["label"] for r in sample(labels, column, __import__("pyspark").sql.functions.lit(False), 9, True).filter("doc_id = 4").collect()} == {1}
    if module is op7_toxicity:
        assert module.keep_rows(df, model).columns == df.columns


def test_log_count_ratios_by_hand():
    found = ["Bad bad bad words", "bad", "good words here", "", "fine words " * 90, None, "ab"]
    label = np.array([1, 1, 0, 0, 0, 0, 1])
    sums, squares = op7_toxicity.log_counts(pa.array(found, pa.string()), label)
    values = [{}, {}]
    for text, c in zip(found, label):
        text = (text or "").lower()
        counts = {}
        for n in (3, 4, 5):
            for k in range(len(text) - n + 1):
                counts[text[k : k + n]] = counts.get(text[k : k + n], 0) + 1
        for g, k in counts.items():
            values[c].setdefault(g, []).append(0.25 + 0.75 * min(1, k * 300 / max(len(text), 300)))
    place = lambda g: next(int(b[0]) for n, (_, b) in zip((3, 4, 5), op7_toxicity.grams([g])) if n == len(g))
    for c in (0, 1):
        assert len({place(g) for g in values[c]}) == len(values[c]) == (sums[c] > 0).sum()
        assert all(np.isclose(sums[c][place(g)], sum(v)) and np.isclose(squares[c][place(g)], sum(x * x for x in v)) for g, v in values[c].items())
    model = op7_toxicity.fit(pa.array(found, pa.string()), label, (4, 3))
    assert model.score(["bad words"])[0] > model.score(["good words here"])[0]


def test_a_sample_has_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(1, "b", 7), (1, "a", 8), (1, None, 9), (2, None, 1), (3, "c", 2), (None, "d", 3)] + [(5, "x", 0)] * 50, "doc_id long, text string, label int")
    chosen = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (9, 0)], "doc_id long, label int")
    assert tuples(texts_of(docs, chosen), "doc_id", "label", "text") == sorted([(1, 1, "a"), (2, 0, None), (5, 1, "x")], key=repr)


def test_forest_is_walked_as_it_grew():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(int)
    forest = op10_quality_classifier.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.98
    slow = []
    for row in x[:20]:
        z = forest.bias
        for c, t, v in zip(forest.column, forest.threshold, forest.value):
            node = 0
            for _ in range(op10_quality_classifier.DEPTH):
                node = 2 * node + 1 + int(row[c[node]] > t[node])
            z += v[node - len(c)]
        slow.append(z)
    assert np.allclose(slow, forest.margin(x[:20]))
