"""Mixing, leaks, archives, grammar, classifiers, pages and tokens against
brute force, round trips and held-out labels."""

import gzip
import itertools
import random
import re

import numpy as np
import pytest

from faresight.llm import decontaminate, html_extract, mixing, quality, token_counts, toxicity, warc

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 300, "e": 5, None: 700}
    got = {r["source"]: r for r in mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", "e", None]
    weight = dict(zip(order, itertools.cycle((5, 2, 1))))
    assert {s: r["weight"] for s, r in got.items()} == weight
    total, free, want = 1.5 * sum(sizes.values()), list(order), {}
    while True:                                     # by rounds
        share = (total - sum(want.values())) / sum(weight[s] for s in free)
        above = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not above:
            break
        want.update({s: 2.0 * sizes[s] for s in above})
        free = [s for s in free if s not in above]
    want.update({s: share * weight[s] for s in free})
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)


def test_positions_invert_the_integral(spark):
    from pyspark.sql import functions as F
    for knots in mixing.SCHEDULES.values():
        df = spark.range(0, 101).select((F.col("id") / 100).alias("y"))
        got = [(r["y"], r["t"]) for r in df.select("y", mixing.position(F.col("y"), knots).alias("t")).collect()]
        xs, ws = zip(*knots)
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, xs, ws)
        integral = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        for y, t in got:
            assert np.interp(t, grid, integral / integral[-1]) == pytest.approx(y, abs=1e-6)


def test_mix_does_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = rows(mixing.assign(docs))
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 40)
    assert rows(mixing.assign(docs.repartition(7))) == one
    order = mixing.training_order(mixing.assign(docs)).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert 0 <= order[0]["position"] and order[-1]["position"] <= 1


def test_leaks_by_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = rows(decontaminate.find_leaks(docs, items))
    assert any(r[-1] for r in whole)
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert rows(decontaminate.find_leaks(docs.repartition(5), items)) == whole


def test_archive_is_the_same_however_it_is_partitioned(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    files = []
    for n, parts in ((0, 1), (1, 6)):
        folder = tmp_path / str(n)
        manifest = warc.write_archive(pages.repartition(parts), str(folder), shard_bytes=200_000, roll_bytes=20_000)
        names = sorted(r["name"] for r in manifest.collect())
        assert sorted(p.name for p in folder.glob("*.gz")) == names and not (folder / "_temporary").exists()
        files.append({x: (folder / x).read_bytes() for x in names})
    assert files[0] == files[1] and len(files[0]) > 5
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    seen = []
    for name, data in files[0].items():
        ids = []
        for record in gzip.decompress(data).split(b"WARC/1.1\r\n")[1:]:
            if b"WARC-Type: response" in record:
                key = int(re.search(rb"<urn:record:(\d+)>", record)[1])
                assert record.split(b"\r\n\r\n", 2)[2][:-4] == html[key]
                ids.append(key)
        assert ids == sorted(ids)
        seen += ids
    assert seen == sorted(html)                     # shards are ranges of the key


def test_grammar_scores_clauses():
    g = toxicity.Grammar()

    def ways(text):
        return [toxicity.WAYS[w] for w, _ in g.run([
            ("I", 2.0) if x == "idiot" else (g.words.get(x.encode(), ""), 0.0) for x in text.split()])]

    assert ways("that was an idiot move") == ["plain"]
    assert ways("you are an idiot") == ["targeted"]
    assert ways("you are not an idiot") == ["negated"]
    assert ways("he said you are an idiot") == ["reported"]
    assert ways("i will kill you") == ["threat"] and ways("we kill weeds") == []
    lexicon = {int(k): 3.0 for k in toxicity.Words(toxicity.pa.array(["idiot"]), toxicity.ALNUM).hashes().view(np.int64)}
    x = toxicity.Scorer(lexicon).features(toxicity.pa.array(["You idiot. Not you, idiot.", None, "never. idiot", "i will kill you"]))
    assert x[1].tolist() == [0] * x.shape[1] and x[0, 1] > 0
    assert x[2, 0] > 0 and x[2, 2] == 0             # the negation is in another clause
    assert x[3, 4] > 0
    p = toxicity.sigmoid(x @ toxicity.PRIOR[:-1] + toxicity.PRIOR[-1])
    assert p[0] > 0.5 > p[1]


def test_clean_long_german_texts_are_no_threats():
    noun = ("Tür", "Stadt", "Frage", "Reise", "Schule", "Arbeit", "Zeitung", "Karte")
    text = " ".join(f"Er will die {n} sehen. Ich werde die {n} morgen holen. Du wirst den Stab der {n} finden." for n in noun)
    scorer, way = toxicity.Scorer({}), toxicity.WAYS.index("threat")
    long = "I will kill time. " + "The weather is fine today. " * 200
    x = scorer.features(toxicity.pa.array([text, "You will die. He should die soon.", "They will stab you.",
                                           "I will kill you. " * 8, long, "We met the beat of a drum."]))
    assert x[0, :-1].tolist() == [0] * (x.shape[1] - 1)
    assert (x[1:4, way] > 1).all() and x[4, way] < 0.2
    assert not x[5, :-1].any()                      # a harm word alone is no mark
    assert toxicity.sigmoid(x @ toxicity.PRIOR[:-1] + toxicity.PRIOR[-1]).round().tolist()[0::3] == [0, 1]


def test_copies_of_both_labels_are_learnt_from(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text, 0), (2, text, 0), (3, text, 1)], "doc_id long, text string, label int")
    assert sorted(r["doc_id"] for r in toxicity.distinct_texts(rows).collect()) == [1, 3]


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.97), (quality, "quality", 0.98)])
def test_held_out_accuracy(spark, module, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(toxicity.held_out(labels.doc_id))
    got = module.score(docs, module.fit(docs, labels)).join(held, "doc_id").toPandas()
    assert len(got) > 500 and ((got["score"] >= 0.5) == (got[label] == 1)).mean() >= least
    clean = got[got[label] == (0 if label == "toxic" else 1)]
    assert ((clean["score"] >= 0.5) == (label == "quality")).mean() >= 0.995


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", *(
        f"CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")))
    for module in (toxicity, quality):
        assert rows(module.score(docs, module.fit(docs, labels))) == rows(module.score(docs, module.fit(docs, flipped)))


def test_best_region_is_the_maximum():
    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-3, -1, 0, 1, 2]) for _ in range(r.randrange(12))]
        lo, hi = html_extract.best_region(s)
        best = max([0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))])
        assert sum(s[lo:hi]) == best and (best > 0) == (hi > lo)


def test_pages_give_their_articles(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages, html_extract.learn_weights(pages)).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)


def test_side_elements_inside_and_around():
    side = ('<aside>Side words here</aside>', '<div class="ad-box">Buy now</div>', '<form><label>Mail</label></form>',
            '<section id="comments"><article class="comment"><p>I think that</p></article></section>',
            '<nav><ul><li><a href=x>One</a></ul></nav>', '<p class="cookie-notice">We use cookies</p>')
    body = "<p>" + "real words of the article &amp; more " * 6 + "</p>"
    want = " ".join(("real words of the article & more " * 6).split())
    for s in side:
        page = f"<html><body><header>Site</header>{s}<article><h1>Title</h1>{body}{s}{body}</article>{s}<footer>f</footer>"
        assert html_extract.main_text(page, html_extract.PRIOR) == f"Title\n\n{want}\n\n{want}"
        plain = f"<html><body><header>Site</header>{s}<div>{body}{s}{body}</div>{s}<footer>f</footer>"
        assert html_extract.main_text(plain, html_extract.PRIOR) == f"{want}\n\n{want}"


@pytest.mark.parametrize("wrap", ['class="content-sidebar-wrap"', 'class="has-sidebar"', 'class="page no-sidebar"',
                                  'id="page-header-wrap"', 'class="widget-content"', 'class="widget"'])
def test_wrappers_with_side_names(wrap):
    body = "<p>" + "real words of the article " * 6 + "</p>"
    want = ("real words of the article " * 6).strip()
    talk = '<div class="comments">' + "<p>I think that too</p>" * 40 + "</div>"
    aside = '<div class="sidebar"><p>Some other words</p></div>'
    for own in (f"<div>{body}</div>", f"<article>{body}</article>", f'<article class="post no-sidebar">{body}</article>'):
        page = f"<html><body><header>Site</header><div {wrap}>{own}{aside}</div>{talk}<footer>f</footer></body></html>"
        assert html_extract.main_text(page, html_extract.PRIOR) == want
    assert html_extract.main_text(f'<body><div class="comments">{body}</div></body>', html_extract.PRIOR) == want
    teaser = '<div class="related"><article><p>Another page to read</p></article></div>'
    assert html_extract.main_text(f"<body><article>{body}</article>{teaser}</body>", html_extract.PRIOR) == want


def test_token_counts_against_all_segmentations():
    pieces = {"▁": -1, "▁a": -5, "a": -4, "b": -4, "ab": -6, "ba": -7, "bab": -9, "▁ab": -9}
    trie = token_counts.Trie(pieces)

    def brute(word):
        word, best = "▁" + word, None
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[x:y] for x, y in zip(at, at[1:])]
            if all(p in pieces or len(p) == 1 for p in parts):
                score = sum(pieces.get(p, len(p.encode()) * trie.byte) for p in parts)
                n = sum(1 if p in pieces else len(p.encode()) for p in parts)
                best = max(best or (score, -n), (score, -n))
        return -best[1]

    words = sorted({"".join(w) for n in range(6) for w in itertools.product("abé", repeat=n)})
    assert trie.counts(words) == [brute(w) for w in words]


def test_token_counts_do_not_depend_on_what_is_held(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    v = token_counts.load_vocabulary()
    one = rows(token_counts.count_tokens(docs, v))
    trie = token_counts.Trie(v)
    few = {r["doc_id"]: r["text"] for r in docs.limit(30).collect()}
    for i, _, n in one:
        if i in few:
            assert n == sum(trie.counts([w])[0] for w in few[i].split())
    monkeypatch.setattr(token_counts, "HELD", 50)
    assert rows(token_counts.count_tokens(docs.repartition(4), v)) == one


def test_attributes_as_browsers_read_them():
    body = "<p>" + "real words of the article " * 6 + "</p>"
    want = ("real words of the article " * 6).strip()
    for tag, inner in (('<p class="a"">', 'Hello there my good "world" of text'), ("<p don't>", "Hello there my good world of text"),
                       ('<p title="a hidden comment">', "Hello there my good world of text"),
                       ("<p data-id='ad' data-class=\"menu\">", "Hello there my good world of text"),
                       ('<p title = "a > b">', "Hello there my good world of text")):
        page = f"<html><body><div>{tag}{inner}</p>{body}</div></body></html>"
        assert html_extract.main_text(page, html_extract.PRIOR) == f"{inner}\n\n{want}"
    inline = "one<nobr> two</nobr> <acronym>three</acronym> <picture><source src=x><img src=y></picture>four<script>x</script> five"
    assert html_extract.main_text(f"<p>{inline}</p>", html_extract.PRIOR) == "one two three four five"


def test_sides_longer_than_the_article():
    body = "<p>" + "real words of the article " * 8 + "</p>"
    want = ("real words of the article " * 8).strip()
    other = "<p>" + "quite other words stand here " * 16 + "</p>"
    for side in ('<div class="cookie-bar">', '<div id="cookieConsent">', '<div class="sidebar">', '<ol class="comment-list">',
                 '<div class="comments-area">', '<div class="left-sidebar widget">', '<div role="complementary">'):
        tag = side[1:].split()[0]
        for page in (f"<body>{side}{other}</{tag}><div>{body}</div></body>", f"<body><div>{body}</div>{side}{other}</{tag}></body>"):
            assert html_extract.main_text(page, html_extract.PRIOR) == want
    ads = '<div class="ad">Buy now</div>' * 8       # a run of sides doesn't part an article
    assert html_extract.main_text(f"<body><div>{body}{ads}{body}</div></body>", html_extract.PRIOR) == f"{want}\n\n{want}"


def test_deep_and_unclosed_pages_take_linear_time():
    import time
    for n, page in ((100_000, "<div>" * 100_000 + "word" + "</span>" * 100_000),
                    (20_000, '<div class="sidebar-wrap"><article>' * 20_000 + "word"),
                    (20_000, '<div class="related"><article>' * 20_000 + "word")):
        start = time.process_time()
        html_extract.main_text(page, html_extract.PRIOR)
        assert time.process_time() - start < 5, n


def test_grammar_against_all_paths():
    """The best path of each way, by walking every choice of the mark through
    every transducer apart."""
    import math
    g, r = toxicity.Grammar(), random.Random(8)
    symbols = [*toxicity.CLASSES, "I", "I", "I", "", ""] + list("UULVKHDMSTYN") * 2
    seen = set()
    for _ in range(4000):
        clause = [(x, r.choice([1.0, 2.5, 4.0]) if x == "I" else 0.0) for x in r.choices(symbols, k=r.randrange(1, 8))]
        best = {}
        for path in itertools.product(*(toxicity.READINGS.get(x, (x,)) for x, _ in clause)):
            states, weight = list(g.start), math.prod(w for (_, w), x in zip(clause, path) if x == "I!")
            for x in path:
                for i, part in enumerate(g.parts):
                    arc = part.step(states[i], x) if states[i] is not None else None
                    states[i], w = arc or (None, 0.0)
                    weight *= w
            marks = sum(x in toxicity.MARKS for x in path)
            if weight and marks == 1 and (way := g.way(tuple(states))) is not None:
                best[way] = max(best.get(way, 0.0), weight)
        got = dict(g.run(clause))
        assert got.keys() == best.keys() and all(math.isclose(got[k], best[k]) for k in best), clause
        seen |= got.keys()
    assert seen == set(range(len(toxicity.WAYS)))


def test_harms_need_a_person():
    scorer, way = toxicity.Scorer({}), toxicity.WAYS.index("threat")
    clean = ["The chef will beat the eggs. I will burn the wood. We will shoot the film.",
             "They should beat the record. We must burn calories. He will punch the ticket.",
             "I will kill time with you.", "The plant will die. It must die.", "Kill the process yourself.", ""]
    threats = ["I will kill you", "I will kill you. " + "The weather is fine today. " * 2000, "kill yourself",
               "You should be killed.", "We are gonna burn all of them!", "Ich werde dich töten", "je vais te tuer"]
    x = scorer.features(toxicity.pa.array(clean + threats))
    p = toxicity.probability(x, np.append(np.zeros(x.shape[1]), -4.0))
    assert not x[:len(clean), :-1].any() and (p[:len(clean)] < 0.1).all()
    assert (x[len(clean):, way] > 1).all() and (p[len(clean):] > 0.5).all()
    mild = scorer.features(toxicity.pa.array(["I will never kill you", "He said I will kill you"]))
    assert not mild[:, way].any() and mild[0, 2] > 0 < mild[1, 3]


def test_pseudo_labels_of_all_documents(spark, odd_docs, labels):
    """A pass over all unlabelled documents sums what plain numpy sums over
    their distinct features, and a fit with the sums lowers their loss."""
    rows = odd_docs.select("doc_id", *quality.NAMES)
    pool = quality.unlabelled(rows, labels)
    views = quality.unpack([r["x"] for r in pool.collect()])
    free = rows.where("doc_id > 11").toPandas()
    assert len(views[0]) == len(free) == 3          # ids 12 to 14, with the repeated and labelled ones gone
    b = quality.pa.RecordBatch.from_pandas(free)
    want = quality._views(b, quality.NAMES)
    for got, x in zip(views, want):
        assert np.allclose(sorted(got.tolist()), sorted(x.tolist()), atol=1e-5)
    r = np.random.default_rng(1)
    x = [r.normal(size=(60, quality.N_TEXT)), r.normal(size=(60, quality.N_META))]
    y = (x[0][:, 0] + 0.1 * x[1][:, 0] > 0).astype(float)
    model = quality.CoTrained(x, y, np.arange(60) % 3 > 0, rounds=0)
    for v in (0, 1):
        model.views[v].x, model.views[v].y = model.views[v].scaled(x[v]), y
    big = spark.createDataFrame([(bytes(p),) for p in
                                 np.column_stack([np.column_stack([x[0], x[1][:, :6]]).astype("<f4").view(np.uint8),
                                                  np.zeros((60, 2), np.uint8)])] * 2, "x binary").repartition(5)
    sums = quality._passes(big)(model)
    far = quality.unpack([r["x"] for r in big.collect()])
    for v in (0, 1):
        for label, sure in enumerate(model.sure(1 - v, far[1 - v])):
            n, g, h = sums[v].get(label, (0, 0, 0))
            assert n == sure.sum()
            if not n:
                continue
            a = np.column_stack([model.views[v].scaled(far[v][sure]), np.ones(n)])
            p = quality.sigmoid(a @ model.views[v].b)
            assert np.allclose(g, a.T @ (p - label), atol=0.05 * n) and np.allclose(
                h, a.T @ a / 4, atol=0.15 * n)
    before = [view.b.copy() for view in model.views]
    n, g, h = sums[1][1]
    rows = far[1][model.sure(0, far[0])[1]]
    loss = np.logaddexp(0, -model.views[1].logit(rows)).sum()
    model.views[1].learn({1: sums[1][1]})
    assert n and g @ (model.views[1].b - before[1]) <= 0
    assert np.logaddexp(0, -model.views[1].logit(rows)).sum() <= loss + 1e-6
