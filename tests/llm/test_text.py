"""Rules, classifier, language and HTML operators."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinspark.llm import entry, html_text, langid, quality, rules

DATA = "/root/testdata/sf0.001"


def counted(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules(spark, odd, odd_rows, nothing):
    got = rules.measure(odd).collect()
    assert Counter((r.doc_id, *r[1:7]) for r in got) == Counter((r[0], *counted(r[1])) for r in odd_rows)
    assert all(not r.kept for r in got if r.base_failed)
    kept = rules.accepted(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert rules.measure(nothing).count() == 0 and rules.accepted(nothing).count() == 0


def test_rules_reject_each_kind(spark):
    rng = random.Random(1)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60))
    words = clean.split()
    cases = {None: clean, "symbols": " ".join(w + "***" for w in words), "bangs": " ".join(w + "!!" for w in words), "capitals": clean.upper(), "stutter": " ".join(f"{w} {w}" for w in words), "word_length": " ".join(x + "x" * 30 for x in words)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases.values())], "doc_id long, text string")
    order = rules.ordered_rules(df)
    assert {r.name for r in order} == {r.name for r in rules.RULES}
    got = {r.doc_id: r for r in rules.measure(df).collect()}
    assert [got[i].kept for i in range(len(cases))] == [k is None for k in cases]
    assert [got[i].rejected_by for i in (2, 3, 4, 5)] == ["bangs", "capitals", "stutter", "word_length"]


def test_rules_come_in_one_order_by_rejections_for_their_cost(spark):
    rng = random.Random(4)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) for _ in range(50)]
    loud = [" ".join(w + "!!" for w in t.split()) for t in clean[:20]]
    starred = [" ".join(w + "**" for w in t.split()) for t in clean[:20]]
    df = spark.createDataFrame(list(enumerate(clean + loud + starred)), "doc_id long, text string").repartition(5)
    orders = [[r.name for r in rules.ordered_rules(df)] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2]
    assert orders[0][:2] == ["symbols", "bangs"]  # both reject, the first at less cost
    dear = tuple(rules.Rule(r.name, r.rejects, "1000000" if r.name == "symbols" else r.work) for r in rules.RULES)
    assert [r.name for r in rules.ordered_rules(df, dear)][:2] == ["bangs", "symbols"]


def test_rules_equal_sql_on_odd_white_space(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab Z!\r\v\f\t\n#|\u00a0\u2028é") for _ in range(rng.randint(0, 150))) for _ in range(300)] + [None, "", "\r", "a\rb\vc\fd e f g h i j k"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)}))
    got = rules.measure(df).drop("rejected_by")
    found = c.execute(entry.oracle_sql()["op3_quality_rules"]).df()[got.columns]
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in found.itertuples(index=False))
    assert Counter(tuple(r)[1:7] for r in got.collect()) == Counter(counted(t) for t in texts)


def test_rules_repeats_at_every_offset(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    got = rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_repeat_words) for r in got} == {(d, counted(t)[4]) for d, t in rows}


@pytest.fixture(scope="module")
def truth(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_classifier_on_held_out_labels(truth):
    docs, labels = truth
    got = quality.scored(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    known = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert (known.predicted == known.quality).mean() > 0.95


def test_classifier_odd_rows(spark, odd, odd_rows, nothing, truth):
    labels = truth[1]
    got = quality.scored(odd, spark.createDataFrame([(41, 1), (42, 0), (43, 1), (44, 0), (45, 7), (None, 1)], "doc_id long, quality int")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in quality.scored(odd, none).collect()} == {0.5}
    assert quality.scored(nothing, labels).count() == 0
    kept = quality.accepted(odd, none, threshold=0.5)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert quality.accepted(odd, none).count() == 0


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = {k: rng.normal(k, 1 + k, (200, quality.D)) for k in (0, 1)}
    model = quality.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    means = [x[k].mean(0) for k in (0, 1)]
    own = [np.cov(x[k].T, bias=True) for k in (0, 1)]
    target = np.diag(np.diag(own[0] + own[1]) / 2 + quality.FLOOR)
    shrunk = [(1 - quality.SHRINK) * c + quality.SHRINK * target for c in own]
    p = rng.normal(0.5, 1, quality.D)
    log = [-0.5 * ((p - m) @ np.linalg.solve(s, p - m) + np.linalg.slogdet(s)[1]) for m, s in zip(means, shrunk, strict=True)]
    assert model.score(p[None])[0] == pytest.approx(1 / (1 + np.exp(log[0] - log[1])))


def slow_statistics(text):
    """The same twelve numbers, one character and one word at a time."""
    words = text.split()
    n, raw = len(words), text.encode()
    letters = [c for c in raw if chr(c).isalpha() and c < 128]
    lines = [x for x in text.split("\n") if x.strip()]
    count = lambda marks: sum(text.count(m) for m in set(marks))
    rate = lambda a, b: np.log(a / (b + 1) + quality.SMOOTH)
    return [
        np.log(n + 1),
        np.log((len(set(words)) + 1) / (n + 1)),
        rate(sum(x == y for x, y in zip(words, words[1:])), n),
        rate(count("#*$%&|<>"), n),
        rate(count("!?"), n),
        rate(count("|"), n),
        np.log((sum(len(w) for w in words) + 1) / (n + 1)),
        rate(sum(chr(c).isupper() for c in letters), len(letters)),
        rate(sum(chr(c).isdigit() for c in raw if c < 128), len(raw)),
        rate(count(".,;:"), n),
        rate(count("\"'()[]{}_=+/\\@^~`-"), n),
        rate(len(lines) - len(set(lines)), len(lines)),
    ]


def test_classifier_from_slow_statistics_and_whole_moments(spark, truth):
    """Statistics, moments, shrinkage and scores worked out again from the labelled texts."""
    docs, labels = (df.toPandas() for df in truth)
    texts = {d: t or "" for d, t in zip(docs.doc_id, docs.text, strict=True)}
    x = {d: np.array(slow_statistics(t)) for d, t in texts.items()}
    for d in list(texts)[:60]:
        assert np.allclose(x[d], quality.statistics(texts[d]))
    own = {k: np.array([x[d] for d, q in zip(labels.doc_id, labels.quality, strict=True) if q == k and zlib.crc32(str(d).encode()) % 4 != 2]) for k in (0, 1)}
    n = {k: len(v) for k, v in own.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    target = np.diag(np.diag(sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())) + quality.FLOOR)
    shrunk = {k: (1 - quality.SHRINK) * cov[k] + quality.SHRINK * target for k in (0, 1)}
    got = {r.doc_id: r.score for r in quality.scored(*truth).collect()}
    for d, v in x.items():
        log = [np.log(n[k] / sum(n.values())) - 0.5 * ((v - own[k].mean(0)) @ np.linalg.solve(shrunk[k], v - own[k].mean(0)) + np.linalg.slogdet(shrunk[k])[1]) for k in (0, 1)]
        assert got[d] == pytest.approx(1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40))), abs=1e-6)


def test_languages_equal_a_slow_parse(spark):
    """Choice and score of each text from phrases found by searching the samples."""
    rng = random.Random(3)
    kinds = {"a": "the stone and river of north grey".split(), "b": "der stein und fluss im norden grau".split(), "c": "la pierre et la riviere du nord".split()}
    samples = {k: " ".join(rng.choice(v) for _ in range(300)) for k, v in kinds.items()}
    rows = [(i, " ".join(rng.choice(kinds[rng.choice("abc")]) for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(90, "12 !"), (91, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    fold = lambda t: "".join(map(chr, langid.folded([t])[0]))
    for d, t in rows:
        part = fold(t or "")
        if not any(c.isalpha() for c in part):
            assert got[d] == ("und", 0.0)
            continue
        bits = {}
        for k, sample in samples.items():
            inside, n, i = fold(sample), 0, 0
            while i < len(part):
                j = i
                while j < len(part) and part[i : j + 1] in inside:
                    j += 1
                i, n = max(j, i + 1), n + 1
            bits[k] = n * np.log2(len(inside)) / len(part)
        best = min(bits, key=lambda k: (bits[k], k))
        weight = [2 ** (-(b - bits[best]) * min(sum(c.isalpha() for c in part), 64)) for b in bits.values()]
        assert got[d][0] == best and got[d][1] == pytest.approx(max(weight) / sum(weight))


def test_languages_on_held_out_documents(truth):
    docs = truth[0]
    got = langid.evaluate(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95
    assert got.score.between(0, 1).all()


def test_languages_odd_rows(odd, odd_rows, nothing):
    got = langid.evaluate(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert langid.evaluate(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_cross_parse_counts_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 17)
    samples = {"a": "the stone and the river of the north, and a grey stone", "b": "der stein und der fluss im norden und ein grauer stein"}
    model = langid.Model(samples)

    def brute(text, sample):
        codes = model.code[langid.folded([text])[0]].tolist()
        inside = "".join(chr(300 + c) for c in model.code[langid.folded([sample])[0]].tolist() if c)
        n = 0
        for b in range(0, len(codes), 17):
            part, i = "".join(chr(300 + c) for c in codes[b : b + 17]), 0
            while i < len(part):
                j = i
                while j < len(part) and part[i : j + 1] in inside:
                    j += 1
                i, n = max(j, i + 1), n + 1
        return n

    texts = ["The grey stone of the river!", "und ein fluss", "zzz 中文 ñ", "a", "stone" * 30]
    bits, letters = model.entropies(texts)
    for k, t in enumerate(texts):
        size = len(langid.folded([t])[0])
        assert [round(b * size / w) for b, w in zip(bits[:, k], model.bits, strict=True)] == [brute(t, samples[x]) for x in "ab"]
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_every_letter_of_every_script_counts():
    rng = random.Random(5)

    def text(first, n, seed):
        draw = random.Random(seed)
        vocabulary = ["".join(chr(first + draw.randrange(n)) for _ in range(draw.randint(2, 5))) for _ in range(400)]
        return lambda words: " ".join(rng.choice(vocabulary) for _ in range(words))

    # Two vocabularies of each of three scripts, Han among them with 3,000 letters.
    kinds = {f"{name}{i}": text(first, n, 10 * k + i) for k, (name, first, n) in enumerate([("cyr", 0x430, 32), ("dev", 0x905, 50), ("han", 0x4E00, 3000)]) for i in (0, 1)}
    samples = {k: make(800) for k, make in kinds.items()}
    model = langid.Model(samples)
    assert model.codes > 1000 and (model.code[np.unique(langid.folded(list(samples.values()))[0])] > 0).all()
    texts = [(k, make(30)) for k, make in kinds.items() for _ in range(10)]
    bits, _ = model.entropies([t for _, t in texts])
    assert [model.languages[i] for i in bits.argmin(0)] == [k for k, _ in texts]
    for t in (texts[0][1], texts[45][1], "中 stone " + texts[25][1]):
        points = langid.folded([t])[0]
        for k, b in zip(model.languages, model.entropies([t])[0][:, 0], strict=True):
            part, sample = "".join(map(chr, points)), "".join(map(chr, langid.folded([samples[k]])[0]))
            n = i = 0
            while i < len(part):
                j = i
                while j < len(part) and part[i : j + 1] in sample:
                    j += 1
                i, n = max(j, i + 1), n + 1
            assert round(b * len(points) / model.bits[model.languages.index(k)]) == n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies here, of course.</div>
<article><h1>Title &amp; more</h1><p><b>First</b> paragraph,<br>with a break and
   white   space.<p>Second one &#233; unclosed<div class="ad">Buy now, a long advert text that goes on and on.</div><ul><li>Item one<li>Item two</ul>
<form>Name <input></form><aside>Side text</aside></article><section id="comments"><p>A reader's long comment that says a great many things.</p></section><footer>Foot</footer></body></html>"""


def test_html():
    want = "Title & more\n\nFirst paragraph, with a break and white space.\n\nSecond one é unclosed\n\nItem one\n\nItem two"
    assert html_text.main_text(PAGE) == want
    plain = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert html_text.main_text(plain) == want
    assert html_text.main_text(PAGE[: PAGE.index("Side")]) == want
    assert html_text.main_text(PAGE[: PAGE.index("second") if "second" in PAGE else PAGE.index("Second") + 6]) == "Title & more\n\nFirst paragraph, with a break and white space.\n\nSecond"
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_html_long_paragraphs_push_nothing_out():
    for size in (8000, 20000, 60000):
        for place in (0, 15, 30):
            lines = ["Heading", "Short one.", "Short two."] + [f"{i:03d} " + "word " * 59 for i in range(31)]
            lines[3 + place] = "long " * (size // 5)
            body = "<h2>Heading</h2>" + "".join(f"<p>{x}</p>" for x in lines[1:])
            for page in (f"<body><div>{body}</div></body>", f"<body><div><div>{body[: len(body) // 2]}</div></div><ul><li><a href=x>A link</a></ul></body>"):
                got = html_text.main_text(page).split("\n\n")
                assert got[:3] == lines[:3] and "A link" not in got
                assert got[:-1] == [x.strip() for x in lines[: len(got) - 1]]
            assert html_text.main_text(f"<body><div>{body}</div></body>").split("\n\n") == [x.strip() for x in lines]


PARAGRAPHS = [f"Paragraph {i} says that the grey river runs on to the north of the hollow stone." for i in range(8)]


@pytest.mark.parametrize("wrapper", ["form id=aspnetForm", "div class='has-sidebar'", "div class='no-sidebar'", "div class='sidebar-right'", "div class='header-fixed nav-open'", "div id=comments-open", "fieldset"])
@pytest.mark.parametrize("inner", ["article", "div", "main"])
def test_html_wrappers_are_no_reason_to_skip(wrapper, inner):
    text = "<div class='entry-header'><h1>The title</h1></div>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    extra = "<div class=newsletter><form>Sign up here</form></div><div class=comment-list><p>Well said, all of it, by a reader.</p></div>"
    page = f"<body><nav>Menu</nav><{wrapper}><{inner}>{text}{extra}</{inner}></{wrapper.split()[0]}><footer>Foot</footer></body>"
    assert html_text.main_text(page).split("\n\n") == ["The title", *PARAGRAPHS]


def test_html_keeps_all_of_main_and_sibling_articles():
    p = [f"<p>{x}</p>" for x in PARAGRAPHS]
    whole = f"<main><h1>The title</h1>{p[0]}{p[1]}<article>{''.join(p[2:])}</article><p>Last words.</p></main>"
    assert html_text.main_text(whole).split("\n\n") == ["The title", *PARAGRAPHS, "Last words."]
    siblings = f"<body><article>{''.join(p[:6])}</article><article>{p[6]}</article><article>{p[7]}</article></body>"
    assert html_text.main_text(siblings).split("\n\n") == PARAGRAPHS
    remark = "<article class=comment-body><p>Something that a reader says about it, at length.</p></article>"
    talk = f"<body><article>{''.join(p)}</article><section id=comments><ol class=comment-list>{('<li class=comment>' + remark + '</li>') * 30}</ol></section></body>"
    assert html_text.main_text(talk).split("\n\n") == PARAGRAPHS


def boilerplate(rng):
    say = lambda n: " ".join(rng.choice(["stone", "river", "grey", "north", "hollow", "winter"]) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{i}'>{say(2)}</a></li>" for i in range(n)) + "</ul>"
    return {
        "nav": f"<nav>{links(rng.randint(3, 8))}</nav>",
        "head": f"<header><h1>{say(3)}</h1></header>",
        "ad": f"<div class='{rng.choice(['ad', 'ad-slot', 'sponsored-box', 'promo'])}'>{say(rng.randint(4, 14))}.</div>",
        "cookie": f"<div id='cookie-notice'>{say(9)}.</div>",
        "side": rng.choice([f"<aside><p>{say(12)}</p></aside>", f"<div class='side-bar'>{links(4)}</div>"]),
        "talk": f"<section id='comments'><p>{say(15)}</p><p>{say(10)}</p></section>",
        "form": f"<form><label>{say(3)}</label><input name=q></form>",
        "foot": f"<footer>&copy; {say(5)}</footer>",
        "related": f"<div>{links(12)}</div>",
    }


@pytest.mark.parametrize("region", ["article", "main", "div", "div class='post-body'"])
def test_html_generated_pages(region):
    """Articles of known text among boilerplate of all kinds, also inside them, with and without telling tags."""
    rng = random.Random(len(region))
    for _ in range(60):
        p = [" ".join(rng.choice(["the", "stone", "grey", "river", "runs", "north", "of", "it"]) for _ in range(rng.randint(25, 90))) + "." for _ in range(rng.randint(3, 12))]
        around, within = boilerplate(rng), boilerplate(rng)
        marks = [rng.choice(["<p>{}</p>", "<p class='legal-basis'>{}</p>", "<p class='social-history'>{}", "<div id='search-results'><p>{}</p></div>", "<p><b>x</b>{}</p>"]) for _ in p]
        body = [m.format(x) for m, x in zip(marks, p, strict=True)]
        want = ["The title", *("x" + x if "<b>" in m else x for m, x in zip(marks, p, strict=True))]
        for k in rng.sample(["ad", "related", "form", "side"], 2):
            body.insert(rng.randrange(1, len(body)), within[k])
        page = f"<html><head><title>t</title></head><body>{around['nav']}{around['head']}{around['cookie']}{around['ad']}<{region}><h1>The title</h1>{''.join(body)}</{region.split()[0]}>{around['side']}{around['talk']}{around['related']}{around['foot']}</body></html>"
        assert html_text.main_text(page).split("\n\n") == want


def test_html_ratios_decide(monkeypatch):
    """What stays hangs on the smoothed ratios, inside an article too."""
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(12))
    weak = "<div class='share-this-story'>" + "".join(f"<span>{x}</span> <i></i><b></b>" for x in "abcde") + "</div>"
    text = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    page = f"<body><article><h1>The title</h1>{text}<ul>{links}</ul>{weak}</article></body>"
    assert html_text.main_text(page).split("\n\n") == ["The title", *PARAGRAPHS]
    monkeypatch.setattr(html_text, "smoothed", lambda r: np.ones(len(r)))  # all alike: nothing is a menu
    assert html_text.main_text(page).split("\n\n") == ["The title", *PARAGRAPHS, *(f"Link {i}" for i in range(12)), "a b c d e"]
    monkeypatch.setattr(html_text, "smoothed", lambda r: np.zeros(len(r)))
    assert html_text.main_text(page) == ""


def test_html_text_after_a_last_angle_bracket():
    page = "<article><p>" + PARAGRAPHS[0] + "</p><p>Here x "
    for tail, kept in (("<b and so the text goes on to the end", "Here x <b and so the text goes on to the end"), ("< 5 and more", "Here x < 5 and more"), ('<a href="/x', "Here x"), ("<a href='/x' class=b tit", "Here x"), ("<b", "Here x"), ("<!-- cut", "Here x"), ("</p", "Here x"), ("<", "Here x")):
        assert html_text.main_text(page + tail).split("\n\n") == [PARAGRAPHS[0], kept]


def test_html_rows(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", ""), (3, "w", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert Counter(r.page_id for r in got) == Counter([1, 1, None, 2, 3])
    assert all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 3).text.count("\n\n") == 4999
    assert html_text.extract(df.limit(0)).count() == 0


def test_op3_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = entry.queries()["op3_quality_rules"](spark, DATA)
    found = c.execute(entry.oracle_sql()["op3_quality_rules"]).df()[df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r) for r in found.itertuples(index=False))


def variety(n, different):
    """n words, ``different`` of them distinct and no five-word window twice."""
    rng = random.Random(n)
    words = [f"word{i}a" for i in range(different)]
    while True:
        out = words + [rng.choice(words) for _ in range(n - different)]
        rng.shuffle(out)
        windows = [tuple(out[i : i + 5]) for i in range(n - 4)]
        if len(set(windows)) == len(windows):
            return " ".join(out)


def test_op3_share_of_different_words_falls_without_a_step(spark):
    rows = [(1, variety(999, 99)), (2, variety(999, 100)), (3, variety(1000, 99)), (4, variety(1000, 100)), (5, variety(1001, 100)), (6, variety(1001, 101)), (7, variety(4000, 199)), (8, variety(4000, 200)), (9, variety(100, 9)), (10, variety(100, 10))]
    got = {r.doc_id: r.kept for r in rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 9: False, 10: True}


def test_op3_order_does_not_hang_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    orders = [[r.name for r in rules.ordered_rules(docs.repartition(n))] for n in (1, 3, 7)]
    assert orders[0] == orders[1] == orders[2]


NAMES = "legal social search header overlay widget toolbar related copyright reply share".split()


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["section class", "p class", "p id", "div id"])
def test_html_names_alone_strike_nothing(name, tag):
    told = "A full sentence of the article stands in here, as it should."
    body = [f"<p>{x}</p>" for x in PARAGRAPHS[:4]] + [f"<{tag}={name}>{told}</{tag.split()[0]}>"] + [f"<p>{x}</p>" for x in PARAGRAPHS[4:]]
    page = f"<body><nav>Menu</nav><article><h1>The title</h1>{''.join(body)}</article></body>"
    assert html_text.main_text(page).split("\n\n") == ["The title", *PARAGRAPHS[:4], told, *PARAGRAPHS[4:]]


def test_html_keeps_references():
    works = [f"Author {i}, Title of the work number {i}, Journal of Hollow Stones, 19{i}0." for i in range(6)]
    page = "<article>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS) + "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in works) + "</ul></article>"
    assert html_text.main_text(page).split("\n\n") == PARAGRAPHS + works


def given_pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()


def untagged(page):
    """The page without tags and names that tell what a block is."""
    import re

    return re.sub(r'<div class="[^"]*">', "<div>", re.sub(r"<(/?)(article|nav|footer|ul|main|header|aside)\b[^>]*>", r"<\1div>", page))


def words_in_common(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_html_ratios_alone_find_most_articles(monkeypatch):
    pages = given_pages()
    want = [html_text.main_text(p) for p in pages]
    got = [html_text.main_text(untagged(p)) for p in pages]
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.6 * len(pages)
    assert sum(words_in_common(a, b) for a, b in zip(got, want, strict=True)) > 0.95 * len(pages)
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smoothed", lambda r: rng.random(len(r)))
    assert sum(html_text.main_text(untagged(p)) == w for p, w in zip(pages, want, strict=True)) < 0.2 * len(pages)
    assert sum(html_text.main_text(p) == w for p, w in zip(pages, want, strict=True)) < 0.8 * len(pages)


def plain_text(page):
    """The method on pages of plain structure, line by line: split at block tags, ratios, Gaussian mean, threshold, region, cluster."""
    import html
    import math
    import re

    page = re.sub(r"(?s)<head>.*?</head>|<(nav|footer|script|style)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    lines, tags, text, inside, advert = [], 0, "", False, False
    for part in re.split(r"(<[^>]*>)", page + "<p>"):
        if not part.startswith("<"):
            text += part
            continue
        name = re.match(r"</?(\w+)", part)[1]
        if name == "br":
            text += " "
        elif name not in ("b", "a"):
            if said := " ".join(html.unescape(text).split()):
                lines.append((said, max(1, tags), inside, advert))
                tags = 0
            text = ""
        tags += 1
        if name == "article":
            inside = not part.startswith("</")
        if name == "div":
            advert = "class=\"ad\"" in part
    if not lines:
        return ""

    def cut(values):
        top = sorted(values)[-1 - math.ceil(len(values) / 20)] if len(values) > 2 else max(values)
        return [min(v, top) for v in values]

    own = [r / (16 if ad else 1) for r, (*_, ad) in zip(cut([len(t) / n for t, n, *_ in lines]), lines, strict=True)]
    page_lines = [i for i, (*_, ad) in enumerate(lines) if not ad]
    ratio = list(own)
    for k, i in enumerate(page_lines):
        near = [(math.exp(-((k - m) ** 2) / 2), own[j]) for m, j in enumerate(page_lines) if abs(k - m) <= (2 if len(page_lines) > 4 else 99)]
        ratio[i] = sum(w * r for w, r in near) / sum(w for w, _ in near)
    mean = sum(ratio) / len(ratio)
    least = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    content = [r >= least and r > 0 for r in ratio]
    region = [i for i, (_, _, article, _) in enumerate(lines) if article]
    share = sum(len(lines[i][0]) for i in region if content[i]) / max(1, sum(len(lines[i][0]) for i in region))
    assert share >= 0.7 or not region
    return "\n\n".join(lines[i][0] for i in region)


def test_html_equals_a_plain_version_on_given_pages():
    for page in given_pages():
        assert html_text.main_text(page) == plain_text(page)


def test_many_languages_share_a_bounded_sample(spark):
    """Sixty made-up languages of their own syllables: the tables stay bounded, and most texts are told apart."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    of = {f"l{k:02d}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(40)] for k in range(60)}
    rows = [(60 * i + k, " ".join(rng.choice(w) for _ in range(80)), lang) for k, (lang, w) in enumerate(of.items()) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, unseen = (docs.where(f"floor(doc_id / 60) % 2 = {k}") for k in (0, 1))
    learned = langid.samples(seen, 2000, 30_000)
    assert len(learned) == 60 and all(len(x) <= 500 for x in learned.values())
    found = langid.identify(unseen, learned).collect()
    right = {d: lang for d, _, lang in rows}
    assert len(found) == 240 and sum(r.lang_pred == right[r.doc_id] for r in found) > 0.9 * len(found)
