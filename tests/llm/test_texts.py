"""Near duplicates, benchmark passages, repeated bytes, token shards, pages, personal data and quality."""

import random
import re
import zlib

import numpy as np
import pytest

from tessitura.llm.components import components
from tessitura.llm.decontaminate import find_passages
from tessitura.llm.fm_index import FMIndex
from tessitura.llm.html import extract_text, main_text
from tessitura.llm.jaccard import _Join, near_duplicates
from tessitura.llm.pii import KINDS, Redactor, find_personal_data
from tessitura.llm.quality import score_quality
from tessitura.llm.suffix import repeated_spans
from tessitura.llm.tokens import END_ID, byte_level_path, read_documents, read_tokens, write_tokens

DOCS = "doc_id long, text string, n int, spans string"


def docs(spark, texts):
    """Rows of (id, text), or texts numbered from 0, with columns that clash with the operators' own."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Near duplicates ----------------------------------------------------------------------------------------------


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def grouped(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_match_brute_force(spark, size, percent):
    draw = random.Random(percent)
    common = [f"c{k}" for k in range(6)]
    texts = ["", None, " \t", "One", "one", "one two", "ONE\x0btwo", "a b c", "a b c d", "naïve É x", "naïve é x"]
    for _ in range(12):  # families whose members drift apart, so that chains and near misses occur
        base = [draw.choice(common) if draw.random() < 0.3 else f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 90))]
        for _ in range(12):
            base = list(base)
            for _ in range(draw.randrange(0, 4)):
                base[draw.randrange(len(base))] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(base))
            texts.append(" ".join(base).upper() if draw.random() < 0.2 else " ".join(base[: -draw.randrange(1, 9)]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, texts), size, percent).collect()}
    assert got == grouped(texts, size, percent)


def test_a_family_whose_leaders_leave_pieces(spark, monkeypatch):
    """Members of a large family link through a few others only; what is left for the rest pass stays in proportion."""
    draw = random.Random(8)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(300):  # most pairs lie below 80 %, each member has some above
        copy = list(base)
        for _ in range(draw.randrange(1, 4)):
            copy[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    made, plain = [], _Join.rest_pairs

    def counted(self, live):
        made.append((plain(self, live).count(), live.count()))
        return plain(self, live)

    monkeypatch.setattr(_Join, "rest_pairs", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, texts), 5, 80).collect()}
    assert got == grouped(texts, 5, 80)
    assert all(rows <= 2 * postings for rows, postings in made)


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    rows = [(4, "a b c d"), (4, "p q r s"), (9, "A b c d"), (7, "p q r s"), (None, "a b c d"), (None, None)]
    got = sorted(map(tuple, near_duplicates(docs(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (9, 2, 4), (7, 2, 4), (None, 2, None), (None, 0, None)], key=str)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {k: 100 for k in range(100, 140)}


# Benchmark passages -------------------------------------------------------------------------------------------


def test_fm_index_finds_every_occurrence():
    draw = np.random.default_rng(2)
    text = np.concatenate([np.append(draw.integers(1, 4, n), 0) for n in (40, 1, 300, 7, 40)])
    index = FMIndex(text, 3, sample=5)
    for width in (1, 2, 5, 9):
        phrases = np.stack([draw.integers(1, 4, width) for _ in range(30)])
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - width + 1) if (text[i : i + width] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def passages(texts, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for name, text in items:
            v = words(text)
            n = min(size, len(v))
            for a in range(len(v) - n + 1) if n and name is not None else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        found.add(str(name))
                        hit |= set(range(b, b + n))
        out[i] = (len(w), sorted(found), sorted(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_passages_match_brute_force(spark, block_bytes):
    draw = random.Random(1)
    word = lambda: draw.choice("aé b c d e f".split())
    items = [(k, " ".join(word() for _ in range(draw.randrange(1, 9)))) for k in range(12)] + [(3, "b c d e"), (None, "b"), (40, None), (41, "!!")]
    texts = [" ".join(word() for _ in range(draw.randrange(0, 120))) for _ in range(40)] + [None, "", "B-C.d", "x" * 5000 + " b c d e f"]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, passages string")
    found = find_passages(docs(spark, texts), bench, 4, into="spans", block_bytes=block_bytes, shard_bytes=2000).collect()
    got = {r["doc_id"]: (r["spans"]["n_words"], r["spans"]["items"], [k for s in r["spans"]["spans"] for k in range(s["start"], s["end"])]) for r in found}
    assert got == passages(texts, items, 4)


def test_passages_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_passages(docs(spark, []), none).count() == 0
    assert find_passages(docs(spark, ["a b"]), none).first()["passages"].asDict(True) == {"n_words": 2, "items": [], "spans": []}


# Repeated bytes -----------------------------------------------------------------------------------------------


def repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            s = b[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        out.append((i, len(b), [m.span() for m in re.finditer(b"\1+", bytes(gone))], bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram"), [(20, 9), (12, 12), (30, 5)])
def test_repeated_spans_match_brute_force(spark, length, gram):
    draw = random.Random(length)
    line = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [line(draw.randrange(10, 90)) for _ in range(8)]
    rows = [(k, "".join(draw.choice([line(draw.randrange(0, 40)), draw.choice(shared)]) for _ in range(draw.randrange(0, 9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 200), (103, "ab" * 90), (104, rows[5][1]), (None, rows[6][1]), (5, rows[5][1]), (105, "xyz" + "a" * 40)]
    found = repeated_spans(docs(spark, rows), length, gram, chunk_bytes=1500).collect()
    got = [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in found]
    assert sorted(got, key=str) == repeats(rows, length)


def test_long_text_crosses_segments(spark, monkeypatch):
    import tessitura.llm.suffix as suffix

    monkeypatch.setattr(suffix, "SEGMENT", 64)
    draw = random.Random(0)
    text = "".join(draw.choice("abc") for _ in range(700))
    table = __import__("pyarrow").table({"chunk": [0], "doc_id": [1], "text": [text + text[100:400]]})
    work = suffix._Dedup(3, 40, 11)
    first = suffix._scan(work.first_blocks(table))
    second = suffix._scan(work.window_blocks(table, first))
    out = work.spans(table, __import__("pyarrow").concat_tables([first, second]))
    assert [(1, 1000, [(s["start"], s["end"]) for s in out.column("spans")[0].as_py()], out.column("kept")[0].as_py())] == repeats([(1, text + text[100:400])], 40)


def test_no_documents_no_spans(spark):
    assert repeated_spans(docs(spark, [])).count() == 0


# Token shards -------------------------------------------------------------------------------------------------


def test_token_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_level_path())
    texts = ["Hello there, world.", "", None, "two  spaces", " lead", "trail ", "line\nbreak \n x", "naïve 東京 don't 12,345", "a" * 3000, "Ġ x Ġ"]
    rows = list(enumerate(texts)) + [(3, "two  spaces"), (3, "again"), (None, "no id"), (50, " ".join(f"w{k}" for k in range(20_000)))]
    folder = str(tmp_path / "t")
    write_tokens(docs(spark, rows), folder, byte_level_path(), END_ID)
    got = read_tokens(spark, folder).orderBy("start").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = read_documents(spark, folder, [3, 7, 99])
    assert [len(some[k]) for k in (3, 7, 99)] == [3, 1, 0]
    assert some[7][0].tolist() == [*plain.encode(texts[7], add_special_tokens=False).ids, END_ID]


def test_added_tokens_are_encoded_as_such(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_level_path())
    end = "<|endoftext|>"
    texts = [f"hello {end} world", f"a{end}b c", end, f"{end}{end} {end}", f"x {end}", f"{end}  x\n{end}", "<|endoftext| > <|end oftext|>", "hello world a"]
    folder = str(tmp_path / "t")
    write_tokens(docs(spark, texts), folder, byte_level_path(), END_ID)
    got = read_tokens(spark, folder).orderBy("start").collect()
    want = [[*plain.encode(t, add_special_tokens=False).ids, END_ID] for t in texts]
    assert [r["ids"] for r in got] == want and want[0][:-1] == [31373, 220, 50256, 995]
    assert [r["start"] for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert [r["n_tokens"] for r in got] == [len(w) for w in want]


def test_no_documents_no_shards(spark, tmp_path):
    write_tokens(docs(spark, []), str(tmp_path / "t"), byte_level_path(), END_ID)
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0


# Pages --------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use cookies and more cookies here.</div>
<main><article><h1>The   title</h1><p>A first paragraph with quite a few words &amp; a caf&eacute;.<p>Short.<div class="ad">Buy this thing now, a long advert text it is.</div>
<p>Another <b>long</b> paragraph,\n of several&nbsp;words in a row, so that it counts.</p><form><p>Your mail</p><input></form></article></main>
<section id="comments"><p>A reader's comment that is rather long and full of words, words, words.</p></section>
<aside><p>Related reading that also is a long enough text to be taken for content.</p></aside><footer>&copy; us</footer></body></html>"""


def test_main_text_leaves_furniture_out():
    assert main_text(PAGE).split("\n") == [
        "The title", "A first paragraph with quite a few words & a café.", "Short.", "Another long paragraph, of several words in a row, so that it counts."]


def test_main_text_without_an_article_element():
    body = "".join(f"<div class=item><p>Sentence number {k} of a page without landmarks.</p></div>" for k in range(5))
    assert main_text(f"<body><div class=menu>a b c</div><div id=content>{body}<p>ok</p></div>").count("\n") == 5


def sentences(start, count):
    return [f"Sentence number {k} of a text that is split over several elements." for k in range(start, start + count)]


def paragraphs(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


def test_main_text_keeps_all_sections():
    first, second, links = sentences(0, 13), sentences(13, 7), "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(9))
    page = f"<h1>Title</h1><section>{paragraphs(first)}</section><section>{paragraphs(second)}</section>"
    want = ["Title", *first, *second]
    assert main_text(f"<body><ul>{links}</ul><article>{page}</article><div>{links}</div></body>").split("\n") == want
    assert main_text(f"<body><ul>{links}</ul><div>{page}</div><div>{links}</div></body>").split("\n") == want
    assert main_text(f"<body><article>{page}</article><article>{paragraphs(first)}</article></body>").split("\n") == want + first


def test_main_text_keeps_paragraphs_beside_a_long_one():
    long, short = " ".join(sentences(0, 20)), sentences(20, 3)
    for tag in ("div", "blockquote", "figure", "details"):
        page = f"<h2>Title</h2><div>{short[0]}</div><{tag}>{long}</{tag}>{paragraphs(short[1:], 'div')}"
        for outer in ("article", "main", "div"):
            assert main_text(f"<body><nav>a b</nav><{outer}>{page}</{outer}></body>").split("\n") == ["Title", short[0], long, *short[1:]]


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "with-sidebar", "has-header", "post-with-comments", "page header", "siteSearch"])
def test_marked_wrappers_keep_the_article(name):
    some = sentences(0, 5)
    bar = "<div class=sidebar><p>Some further reading of a page beside the article.</p></div>"
    for inner in (f"<article>{paragraphs(some)}</article>", f"<main>{paragraphs(some)}</main>", f"<div>{paragraphs(some)}</div>"):
        for page in (f"<body><div class='{name}'>{inner}{bar}</div>", f"<body class='{name} comments-open'><div id='{name}'><b>{inner}</b></div>{bar}"):
            assert main_text(page).split("\n") == some


def test_marks_hold_for_what_others_wrote():
    some, more = sentences(0, 4), sentences(50, 30)
    for name in ("comments", "ad", "comment-list"):
        for tag in ("div", "article"):
            assert main_text(f"<article>{paragraphs(some)}</article><div class={name}><{tag}>{paragraphs(more)}</{tag}></div>").split("\n") == some
    assert main_text(f"<article>{paragraphs(some)}</article><div class=sidebar><article>{paragraphs(more[:2])}</article></div>").split("\n") == some


def test_what_the_article_holds_stays():
    some = sentences(0, 4)
    page = f"<article><h1>T</h1><p class=byline>By A. Writer</p><ul class=toc><li>One</ul>{paragraphs(some)}<p><math><mi>x</mi></math> is</p><p class=tags>a, b</p></article>"
    assert main_text(page).split("\n") == ["T", "By A. Writer", "One", *some, "x is", "a, b"]


def test_broken_pages():
    assert main_text("") == "" and main_text("<nav>only</nav>") == "" and main_text("just text") == "just text"
    assert main_text("<article><p>Cut off in the middle of a ta<a hre") == "Cut off in the middle of a ta"
    assert main_text("<p>one<!-- never ends <p>two") == "one" and main_text("<p>a &am") == "a &am" and main_text("<p>1 < 2</p>") == "1 < 2"
    assert len(main_text("<p>" * 3000 + "x" * 100_000)) == 100_000


def test_extract_text_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>", "t"), (1, "<p>a b</p>", "t"), (None, None, None), (2, "", "t")], "page_id long, html string, text string")
    assert sorted((str(r["page_id"]), r["text"]) for r in extract_text(df).collect()) == [("1", "a b"), ("1", "a b"), ("2", ""), ("None", "")]
    assert extract_text(df.limit(0)).count() == 0


# Personal data ------------------------------------------------------------------------------------------------


def luhn(digits):
    worth = [int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits))]
    return sum(worth) % 10 == 0


def base(text):
    only = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))


ODD = [
    None, "", "a@b.c", "x a.b+c@d-e.f.g. y@z", "a@b.c@d.e._q@r.s", "a@b..c a@.b.c @x.y a@b.", "é@x.yz 日本a@b.cd", "1.2.3.4.5.6.7.8 01.002.0255.256 1.2.3",
    "300.1.1.1 10.0.0.255", "4111 1111 1111 1111, 4111-1111--1111-1111 4111111111111112 0000000000000", "+1 (017) 555-7713 +12 +1() +44 20 7946 0958 123",
    "1 " * 5000, "a." * 5000 + "@b" + ".c" * 5000, "9" * 50_000, "x" * 50_000 + "@", "+1" * 5000, "﷐@a.b ﷑1.2.3.4 4111﷑111111111111", "5105105105105100 5105105105105100",
]


def found(spark, texts, redactor=Redactor([], ())):
    rows = find_personal_data(docs(spark, texts), into="spans", redactor=redactor).collect()
    return {r["doc_id"]: {k: [tuple(s) for s in r["spans"][k]] for k in ("base", "added")} for r in rows}


def test_base_spans_match_the_patterns(spark):
    draw = random.Random(9)
    parts = ["a@b", ".c", ".", "@", "1", "12", "255", "256", " ", "-", "+", "(", "4111111111111111", "é", "x", "4242 4242 4242 4242"]
    texts = ODD + ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 30))) for _ in range(400)]
    got = found(spark, texts)
    assert {i: g["base"] for i, g in got.items()} == {i: base(t) for i, t in enumerate(texts)}
    assert all(g["added"] == [] for g in got.values())


def test_trees_add_candidates_and_keep_base(spark):
    wanting_at = Redactor([(1.0, (0, 0.5, (1, 1000.0, 3.0, -3.0), -3.0))], (0.9, 0.9, 0.9, 0.9))
    got = found(spark, ["write to jo (at) ex (dot) org or a@b.c, 1.2.3.4", "nothing at all"], wanting_at)
    assert got[0] == {"base": base("write to jo (at) ex (dot) org or a@b.c, 1.2.3.4"), "added": [(9, 0, 29)]}
    assert got[1] == {"base": [], "added": []} and KINDS[0] == "email"


def test_fit_on_candidates_leaves_clean_text_alone(spark):
    draw = random.Random(4)

    def card():
        start = "".join(str(draw.randrange(10)) for _ in range(15))
        return next(start + c for c in "0123456789" if luhn(start + c))

    texts = [f"words 2024-05-17 page {k} of {draw.randrange(10**6)} call +1 (0{k % 90 + 10}) 555-{1000 + k} or pay {card()} then" for k in range(60)]
    texts += [f"on 2023-01-{k % 28 + 10} in room {k * 37} we saw {k} birds, then 1999-12-31" for k in range(60)]
    got = {r["doc_id"]: r["personal"] for r in find_personal_data(docs(spark, texts)).collect()}
    assert all(g["base"] == base(texts[i]) or [tuple(s) for s in g["base"]] == base(texts[i]) for i, g in got.items())
    assert all(not g["added"] for i, g in got.items() if i >= 60)
    assert find_personal_data(docs(spark, [])).count() == 0


def test_fit_adds_obfuscated_data(spark):
    draw = random.Random(5)
    texts, planted = [], []
    for k in range(480):
        number = lambda: f"{draw.randrange(100, 1000)}"
        some = (f"jo{k} (at) ex{k % 7} (dot) org", f"({number()}) {number()}-{draw.randrange(1000, 10000)}",
                "[.]".join(str(draw.randrange(1, 256)) for _ in range(4)), None)[k % 4]
        plain = f"on 2023-01-{k % 28 + 10} a@b{k}.com and 10.0.{k % 256}.7 or room {draw.randrange(10**6)} at 300[.]{k}[.]1[.]1 then"
        texts.append(f"{plain} words {some} . more" if some else f"{plain} +1 (0{k % 90 + 10}) 555-{1000 + k} more")
        planted.append([(texts[k].index(some), (0, 3, 1)[k % 4], texts[k].index(some) + len(some))] if some else [])
    got = {r["doc_id"]: r["personal"] for r in find_personal_data(docs(spark, texts)).collect()}
    assert all([tuple(s) for s in g["base"]] == base(texts[i]) for i, g in got.items())
    assert [[tuple(s) for s in got[i]["added"]] for i in range(len(texts))] == planted


# Quality ------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("aeioubcdfg") for _ in range(draw.randrange(2, 9)))
    texts = [" ".join(word() + ("%%%" if k % 4 == 0 else "") for _ in range(60)) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(400)] + [(None, 1, 0), (7, None, 0), (10**6, 1, 0)], "doc_id long, quality int, n int")
    rows = [*enumerate(texts), (None, texts[0]), (500, None), (500, ""), (501, "long " * 50_000)]
    got = score_quality(docs(spark, rows), labels, into="n").collect()
    assert len(got) == len(rows) and all(0 <= r["n"] <= 1 for r in got)
    held = [(r["doc_id"], r["n"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 80 and sum((s >= 0.5) == (i % 4 != 0) for i, s in held) >= 0.97 * len(held)
    assert len({r["n"] for r in got if r["doc_id"] == 500}) == 1


def test_quality_without_usable_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["quality_score"], 6) for r in score_quality(docs(spark, ["a", None]), none).collect()} == {0.5}
    assert score_quality(docs(spark, []), none).count() == 0
